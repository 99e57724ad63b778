from __future__ import annotations

import html
import random
from html import entities

import pytest

from feedlens.functions import text as tx
from feedlens.functions import times
from feedlens.functions.terms import stem, stem_word
from feedlens.functions.urls import encode_path, normalize_url
from feedlens.operators import conform
from feedlens.operators.summarize import extract_sentences, fit_length, has_more_letters, length_score


def test_shorten_counts_bytes_and_keeps_words(values):
    cases = {
        "Short": "Short",
        "This is a very long content that should be cut": "This is a very long content...",
        "Thisisaverylongcontentwithoutanyspaces": "Thisisaverylongcontentwithouta...",
        "éééééééééééééééééééé": "é" * 15 + "...",
        "xéééééééééééééééééééé": "x" + "é" * 14 + "...",
    }
    assert values(lambda c: tx.shorten(c, 30), list(cases)) == list(cases.values())


def test_dot_stops_only_at_newline(values):
    # a carriage return or NEL inside the tag must not end the match
    texts = ["<script>a\rb</script>x", "<script>a\x85b</script>x", "<script>a\nb</script>x"]
    assert values(tx.drop_scripts, texts) == ["x", "x", "<script>a\nb</script>x"]
    assert values(lambda c: tx.drop_scripts(c, dotall=True), texts) == ["x", "x", "x"]


def test_trim_and_words_know_unicode_spaces(values):
    assert values(tx.trim_space, ["  a b　\n"]) == ["a b"]
    assert values(tx.words, [" one two \n"]) == [["one", "two"]]


def test_entities_and_markup(values):
    assert values(tx.tidy_text, ["Caf&eacute; &amp; bar", "plain", None]) == ["Café & bar", "plain", None]
    assert values(tx.tidy_title, ["&lt;b&gt;Bold&lt;/b&gt;  title"]) == ["Bold title"]
    assert values(tx.tidy_content, ["&lt;b&gt;x&lt;/b&gt; <i>y</i>\x07"]) == ["<b>x</b> y"]
    assert values(tx.page_text, ["<p>a&amp;lt;b&nbsp;</p>"]) == ["a<b"]
    assert values(tx.plain_text, ["a<b>b</b>c"]) == ["abc"]


def test_first_sentences(values):
    text = "One two. Three four! Five six seven eight nine."
    assert values(lambda c: tx.first_sentences(c, 30), [text, "", "no end"]) == ["One two. Three four.", "", "no end."]


def test_first_paragraph(values):
    cases = {
        "First paragraph with meaningful content here.\n\nSecond.": "First paragraph with meaningful content here.",
        "Too short.\n\nThis is a longer paragraph with enough content to be meaningful.": "This is a longer paragraph with enough content to be meaningful.",
        "": "",
        "<p>Fish &amp;amp; chips, &eacute;clairs and &lt;tea&gt; for everyone at home</p>\n\nNext.": "Fish &amp; chips, éclairs and <tea> for everyone at home",
    }
    assert values(tx.first_paragraph, list(cases)) == list(cases.values())


def test_wrap(values):
    assert values(lambda c: tx.wrap(c, 10, "  "), ["aaa bbb ccc dddd", "", "abcdefghijklmn op"]) == [
        "aaa bbb\n  ccc dddd", "", "abcdefghijklmn\n  op",
    ]


def test_escape_markdown(values):
    assert values(tx.escape_markdown, ["a_b <c> & [d]"]) == [r"a\_b &lt;c&gt; &amp; \[d\]"]


@pytest.mark.parametrize(
    ("word", "expected"),
    [("running", "runn"), ("programmed", "programm"), ("faster", "fast"), ("beautiful", "beauti"),
     ("development", "develop"), ("nation", "nat"), ("go", "go"), ("", ""), ("bed", "bed"), ("été", "été")],
)
def test_stem(values, word, expected):
    assert values(stem, [word]) == [expected]
    assert stem_word(word) == expected


def test_urls(values):
    cases = {
        "https://example.com/article?utm_source=twitter&utm_campaign=test&content=real": "https://example.com/article?content=real",
        "HTTPS://EXAMPLE.COM/Article": "https://example.com/Article",
        "https://example.com/article?fbclid=abc123&ref=facebook": "https://example.com/article",
        "http://x.org/?b=2&a=1+1&a=0#top": "http://x.org/?a=1+1&a=0&b=2#top",
        "http://x.org/a%zz": "http://x.org/a%zz",
        "": "",
    }
    assert values(normalize_url, list(cases)) == list(cases.values())
    assert values(encode_path, ["/Èq a/b*", "/ok(1)"]) == ["/%C3%88q%20a/b%2A", "/ok(1)"]


def test_sources_and_titles(values):
    assert values(conform.normalize_source, ["https://www.Example.com:8080/x", " WWW.Dev.to "]) == ["example.com:8080", "dev.to"]
    assert values(conform.clean_rss_title, ["RSS: [RSS] [x] Title"]) == ["Title"]
    assert values(conform.page_headline, ["Main Title | Sub - Site", "ab - c", "Simple"]) == ["Main Title", "ab - c", "Simple"]
    assert values(conform.unescape_json_content, [r"a \\n b \"c\""]) == ['a \n b "c"']


def test_chrome(values):
    page = '<nav class="x">Menu</nav><div>Main</div>\n<aside>s</aside><FOOTER>f</FOOTER><div class="ad">z</div>'
    assert values(conform.drop_page_chrome, [page]) == ["<div>Main</div>\n"]


def test_sentences(values):
    texts = [
        "", "This is a single sentence.", "First sentence. Second sentence! Third sentence? Fourth sentence.",
        "Good. Bad. This is a proper sentence with sufficient length. Yes.",
    ]
    assert [len(s) for s in values(extract_sentences, texts)] == [0, 1, 4, 1]
    assert values(length_score, ["x" * 100, "x" * 10, "x" * 301, "x" * 30]) == [1.0, 0.2, 0.3, 0.7]
    assert values(lambda c: fit_length(c, 20), ["short", "one two three four five", "x" * 30 + " y"]) == ["short", "one two three...", ""]
    assert values(lambda c: has_more_letters(c, 3), ["abc abc", "abcd", "a1b2"]) == [False, True, True]


def test_timestamps(values):
    def parse(layouts):
        return lambda c: times.parse_timestamp(c, layouts).cast("string")

    assert values(parse(times.FEED_LAYOUTS), [
        "Mon, 01 Jan 2024 12:00:00 GMT", "Mon, 01 Jan 2024 12:00:00 +0200", "2024-01-01T12:00:00Z",
        "2024-01-01T12:00:00.5-01:00", "01 Jan 24 12:00 EST", "2024-01-01 12:00:00", "junk",
    ]) == [
        "2024-01-01 12:00:00", "2024-01-01 10:00:00", "2024-01-01 12:00:00", "2024-01-01 13:00:00.5",
        "2024-01-01 12:00:00", "2024-01-01 12:00:00", None,
    ]
    assert values(parse(times.PAGE_LAYOUTS), ["Jan 1, 2024", "January 2, 2024", "2024-01-03", "04 Jan 2024"]) == [
        "2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00", "2024-01-04 00:00:00",
    ]
    assert values(parse(times.CONFORM_LAYOUTS), ["2024-01-01T12:00:00", "Mon Jan 02 15:04:05 -0700 2006"]) == [
        "2024-01-01 12:00:00", "2006-01-02 22:04:05",
    ]
    assert str(times.since_date("2024-03-31", "monthly")) == "2024-03-02"
    assert str(times.since_date("2024-03-31", "daily")) == "2024-03-30"


def test_unescape_equals_the_html_rules(spark):
    rng = random.Random(5)
    pieces = ["&", "&amp", "&amp;", "&notit;", "&notin;", "&no", "&#", "&#x", "&#x;", "&#0;", "&#xfeff;", "&#65279", "&#x1F600;", "x", ";", "#", "é", "😀", " ", "<"]
    pieces += ["&#38;lt;", "&#00000000065;", "&#x0000000041", "&#55296;", "&#xFDD0;", "&#x1FFFE;", "&#1114112;", "&#99999999999999999999;", "&#128;", "&#x9F", "&" + "y" * 40 + ";"]
    texts = [f"a&{n}b&{n.rstrip(';')}" for n in entities.html5] + [f"&#{n};&#x{n:x}" for n in [*range(300), 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x10FFFF]]
    texts += ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", tx.unescape("t").alias("got"))
    assert [(r.t, r.got) for r in rows.collect() if r.got != (None if r.t is None else html.unescape(r.t))] == []
    assert "Python" not in rows._jdf.queryExecution().toString()
