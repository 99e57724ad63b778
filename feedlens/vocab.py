"""Word lists, weights, enumerations and patterns that results depend on."""

# --- weekly digest ---------------------------------------------------------------------

CATEGORY_KEYWORDS = {
    "react": ["react", "jsx", "hooks", "redux", "next.js", "nextjs"],
    "vue": ["vue", "vuejs", "vue.js", "nuxt", "vuex", "pinia"],
    "angular": ["angular", "typescript", "rxjs", "ngrx", "ionic"],
    "nodejs": ["node.js", "nodejs", "express", "npm", "backend"],
    "typescript": ["typescript", "ts", "type", "interface"],
    "javascript": ["javascript", "js", "es6", "es2021", "es2022"],
    "css": ["css", "sass", "scss", "less", "styled-components"],
    "testing": ["test", "testing", "jest", "cypress", "playwright"],
    "webpack": ["webpack", "vite", "rollup", "bundler", "build"],
}

DIGEST_FOUND = "在 %s 到 %s 期间，共收集到 %d 篇高质量前端开发新闻。"
DIGEST_TOPICS = " 主要涉及话题：%s。"
DIGEST_EMPTY = "在 %s 到 %s 期间未找到符合条件的前端开发新闻。"
DIGEST_JOIN = "、"

# name, url, article cap, tags
DIGEST_SOURCES = [
    ("dev.to", "https://dev.to/api/articles?tag=frontend&per_page=30", 30, ["frontend", "dev.to"]),
    ("dev.to-react", "https://dev.to/api/articles?tag=react&per_page=20", 20, ["react", "dev.to"]),
    ("dev.to-vue", "https://dev.to/api/articles?tag=vue&per_page=20", 20, ["vue", "dev.to"]),
    ("dev.to-javascript", "https://dev.to/api/articles?tag=javascript&per_page=25", 25, ["javascript", "dev.to"]),
]

RELEVANCE_LEXICON = {
    "react": 0.15,
    "vue": 0.15,
    "angular": 0.15,
    "javascript": 0.12,
    "typescript": 0.12,
    "css": 0.10,
    "html": 0.08,
    "frontend": 0.10,
    "ui": 0.08,
    "ux": 0.06,
    "responsive": 0.07,
    "webpack": 0.05,
    "babel": 0.04,
    "npm": 0.04,
    "yarn": 0.04,
    "nextjs": 0.08,
    "nuxt": 0.08,
    "svelte": 0.10,
    "tailwind": 0.06,
    "bootstrap": 0.05,
}

SOURCE_BONUS = {
    "css-tricks.com": 0.1,
    "dev.to": 0.08,
    "medium.com": 0.06,
    "hackernews": 0.05,
    "smashingmagazine": 0.1,
    "a11yproject": 0.08,
}

# --- trending repositories -------------------------------------------------------------

FRONTEND_LANGUAGES = ["JavaScript", "TypeScript", "CSS", "HTML", "Vue", "Sass", "Less"]

FRONTEND_KEYWORDS = [
    "javascript", "typescript", "react", "vue", "angular", "frontend",
    "css", "html", "sass", "scss", "webpack", "vite", "next.js", "nuxt",
    "ui", "component", "framework", "library", "web", "browser",
]

REPO_CATEGORY_KEYWORDS = {
    "framework": ["framework", "react", "vue", "angular", "next.js", "nuxt", "svelte"],
    "library": ["library", "util", "helper", "component", "ui"],
    "tool": ["tool", "cli", "build", "webpack", "vite", "rollup", "babel"],
    "example": ["example", "demo", "sample", "template", "boilerplate"],
}

REPO_TOPIC_WORDS = [
    "react", "vue", "angular", "javascript", "typescript", "css", "html",
    "node", "express", "webpack", "vite", "babel", "eslint", "prettier",
    "tailwind", "bootstrap", "sass", "less", "redux", "mobx", "graphql",
    "rest", "api", "ui", "component", "library", "framework", "tool",
]

TRENDING_TOPICS = ["frontend", "react", "vue", "angular", "javascript", "typescript"]
TRENDING_MAX_SOURCES = 4
TRENDING_LANGUAGE_ROWS = 20
TRENDING_TOPIC_ROWS = 15

TRUE_WORDS = ["1", "t", "T", "TRUE", "true", "True"]

# --- topic search ----------------------------------------------------------------------

TECH_WEIGHTS = {
    "react": 1.0,
    "vue": 1.0,
    "angular": 1.0,
    "javascript": 0.9,
    "typescript": 0.9,
    "nodejs": 0.8,
    "css": 0.7,
    "html": 0.7,
    "webpack": 0.8,
    "vite": 0.8,
    "nextjs": 0.9,
    "nuxt": 0.9,
    "svelte": 0.8,
    "frontend": 0.7,
}

LANGUAGE_ALIASES = {
    "javascript": ["js", "node", "nodejs"],
    "typescript": ["ts"],
    "python": ["py"],
    "go": ["golang"],
}

# --- term scoring ----------------------------------------------------------------------

STEM_SUFFIXES = ["ing", "ed", "er", "est", "ly", "ion", "tion", "ness", "ment", "ful", "less"]

TERM_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "will", "with", "or", "but", "not", "this", "have",
]

# --- summaries -------------------------------------------------------------------------

SUMMARY_STOP_WORDS = [
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of",
    "with", "by", "is", "are", "was", "were", "be", "been", "have", "has",
    "had", "do", "does", "did", "will", "would", "could", "should", "may", "might",
    "can", "this", "that", "these", "those", "a", "an", "it", "its", "they",
    "them", "their", "we", "our", "you", "your", "he", "him", "his", "she",
    "her", "hers",
]

WORD_TRIM_CHARS = ".,!?;:\"'()[]{}~"

# --- conform ---------------------------------------------------------------------------

TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "ref", "source", "campaign_id", "ad_id",
]

SOURCE_TYPES = ["rss", "api", "html"]

TITLE_SEPARATORS = [" | ", " - ", " :: ", " — "]

RSS_TITLE_PREFIXES = [r"^RSS:[\t\n\f\r ]*", r"^\[RSS\][\t\n\f\r ]*", r"^\[.*?\][\t\n\f\r ]*"]

PAGE_CHROME = [
    r"<nav[^>]*>.*?</nav>",
    r"<header[^>]*>.*?</header>",
    r"<footer[^>]*>.*?</footer>",
    r"<aside[^>]*>.*?</aside>",
    r'<div[^>]*class="[^"]*ad[^"]*"[^>]*>.*?</div>',
    r'<div[^>]*class="[^"]*comment[^"]*"[^>]*>.*?</div>',
    r"<script[^>]*>.*?</script>",
    r"<style[^>]*>.*?</style>",
    r"<!--.*?-->",
]

# --- page extraction -------------------------------------------------------------------

LIST_PAGE_PATTERNS = [
    r"<article[^>]*>.*?<article[^>]*>",
    r'<div[^>]*class="[^"]*post[^"]*"[^>]*>.*?<div[^>]*class="[^"]*post[^"]*"[^>]*>',
    r'<div[^>]*class="[^"]*item[^"]*"[^>]*>.*?<div[^>]*class="[^"]*item[^"]*"[^>]*>',
    r"<h2[^>]*>.*?<h2[^>]*>",
    r"<h3[^>]*>.*?<h3[^>]*>",
]

BLOCK_SELECTORS = [
    r"<article[^>]*>(.*?)</article>",
    r'<div[^>]*class="[^"]*post[^"]*"[^>]*>(.*?)</div>',
    r'<div[^>]*class="[^"]*item[^"]*"[^>]*>(.*?)</div>',
    r'<div[^>]*class="[^"]*entry[^"]*"[^>]*>(.*?)</div>',
]

BLOCK_TITLE_SELECTORS = [
    r"<h[1-6][^>]*>(.*?)</h[1-6]>",
    r'<a[^>]*class="[^"]*title[^"]*"[^>]*>(.*?)</a>',
    r'<div[^>]*class="[^"]*title[^"]*"[^>]*>(.*?)</div>',
    r'<span[^>]*class="[^"]*title[^"]*"[^>]*>(.*?)</span>',
    r"<a[^>]*>(.*?)</a>",
]

TITLE_SELECTORS = [
    r"<title[^>]*>(.*?)</title>",
    r"<h1[^>]*>(.*?)</h1>",
    r"<h2[^>]*>(.*?)</h2>",
    r'<meta[^>]*property="og:title"[^>]*content="([^"]*)"',
    r'<meta[^>]*name="title"[^>]*content="([^"]*)"',
]

# matched with "." also crossing line ends
CONTENT_SELECTORS = [
    r"<main[^>]*>(.*?)</main>",
    r"<article[^>]*>(.*?)</article>",
    r'<div[^>]*class="[^"]*content[^"]*"[^>]*>(.*?)</div>',
    r'<div[^>]*class="[^"]*post[^"]*"[^>]*>(.*?)</div>',
    r'<div[^>]*id="content"[^>]*>(.*?)</div>',
    r"<body[^>]*>(.*?)</body>",
]

AUTHOR_SELECTORS = [
    r'<meta[^>]*name="author"[^>]*content="([^"]*)"',
    r'<meta[^>]*property="article:author"[^>]*content="([^"]*)"',
    r'<span[^>]*class="[^"]*author[^"]*"[^>]*>(.*?)</span>',
    r'<div[^>]*class="[^"]*author[^"]*"[^>]*>(.*?)</div>',
    r'<a[^>]*class="[^"]*author[^"]*"[^>]*>(.*?)</a>',
]

PUBLISHED_SELECTORS = [
    r'<meta[^>]*property="article:published_time"[^>]*content="([^"]*)"',
    r'<time[^>]*datetime="([^"]*)"',
    r'<span[^>]*class="[^"]*date[^"]*"[^>]*>(.*?)</span>',
    r'<div[^>]*class="[^"]*date[^"]*"[^>]*>(.*?)</div>',
]

TAG_SELECTORS = [
    r'<meta[^>]*name="keywords"[^>]*content="([^"]*)"',
    r'<meta[^>]*property="article:tag"[^>]*content="([^"]*)"',
    r'<span[^>]*class="[^"]*tag[^"]*"[^>]*>(.*?)</span>',
    r'<a[^>]*class="[^"]*tag[^"]*"[^>]*>(.*?)</a>',
]

LINK_PATTERN = r'<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
HREF_PATTERN = r'<a[^>]*href="([^"]*)"'
MAX_PAGE_LINKS = 50

# decoded in this order, so "&amp;lt;" becomes "<"
BASIC_ENTITIES = [
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
]

# --- fetch log -------------------------------------------------------------------------

FATAL_FETCH_ERRORS = ["validation failed", "invalid URL", "no collector found", "404", "401", "403"]

# --- rendering -------------------------------------------------------------------------

MARKDOWN_ESCAPES = ["\\", "*", "_", "`", "[", "]", "(", ")", "{", "}", "#", "+", "-", ".", "!", "|"]

HTML_ESCAPES = [("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")]

TIER_LINES = {
    "viral": "🔥 **Viral** repository with massive community engagement",
    "very_popular": "🌟 **Very Popular** repository with strong community support",
    "popular": "⭐ **Popular** repository with good traction",
    "gaining_traction": "📈 **Gaining Traction** - emerging repository",
    "new_or_niche": "🌱 **New or Niche** repository",
}

ACTIVITY_LINES = {
    "very_active": "🚀 **Very Active** - updated within the last week",
    "active": "✅ **Active** - updated within the last month",
    "moderate": "🔄 **Moderate** activity - updated within 3 months",
    "inactive": "💤 **Inactive** - not recently updated",
}

TIER_LABELS = {
    "viral": "Viral",
    "very_popular": "Very Popular",
    "popular": "Popular",
    "gaining_traction": "Gaining Traction",
    "new_or_niche": "New/Niche",
}

ACTIVITY_LABELS = {
    "very_active": "Very Active",
    "active": "Active",
    "moderate": "Moderate Activity",
    "inactive": "Inactive",
}

# --- access log ------------------------------------------------------------------------

# upper bound in bytes, label; the last class is open
SIZE_CLASSES = [
    (1024, "<=1KB"),
    (10 * 1024, "<=10KB"),
    (100 * 1024, "<=100KB"),
    (1024 * 1024, "<=1MB"),
    (10 * 1024 * 1024, "<=10MB"),
]
SIZE_CLASS_OPEN = ">10MB"

HEALTH_LOW_HIT_RATE = "低命中率: %.2f%%"
HEALTH_HIGH_MEMORY = "高内存使用率: %.2f%%"
HEALTH_MEMORY_ERROR = "内存使用率过高"
HEALTH_ERRORS = "发现 %d 个错误"
HEALTH_SLOW = "发现 %d 个慢操作"

ALERT_LOW_HIT_RATE = "缓存命中率过低: %.2f%%"
ALERT_HIGH_MEMORY = "内存使用率过高: %.2f%%"
ALERT_ERRORS = "错误数量过多: %d"
ALERT_SLOW = "慢操作数量过多: %d"
ALERT_UNHEALTHY = "缓存健康状态异常"

# --- request checks --------------------------------------------------------------------

REQUEST_CATEGORIES = [
    "react", "vue", "angular", "nodejs", "typescript", "javascript",
    "css", "testing", "webpack", "framework", "library", "tool", "example",
]
REQUEST_LANGUAGES = [
    "javascript", "typescript", "python", "java", "go", "rust", "c++", "c#",
    "php", "ruby", "swift", "kotlin", "dart", "html", "css", "scss", "sass",
    "vue", "jsx", "tsx",
]
REQUEST_FORMATS = ["json", "markdown", "text"]
REQUEST_SOURCES = ["dev.to", "hackernews", "reddit", "medium", "github"]
REQUEST_PLATFORMS = ["github", "stackoverflow", "reddit", "dev.to"]
REPO_CATEGORIES = ["framework", "library", "tool", "example"]
WEEKLY_SORTS = ["relevance", "quality", "date", "title"]
TOPIC_SORTS = ["relevance", "date", "popularity", "stars"]
TRENDING_SORTS = ["stars", "forks", "updated", "trending"]
TOPIC_RANGES = ["day", "week", "month", "year", "all"]
TRENDING_RANGES = ["daily", "weekly", "monthly"]
SEARCH_TYPES = ["discussions", "repositories", "articles", "all"]

QUERY_ESCAPES = [("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("&", "&amp;")]
QUERY_CHARSET = r"^[a-zA-Z0-9\t\n\f\r \-_./+#@]+$"

# message texts of the request checks
MSG_DATE_FORMAT = "日期格式必须为YYYY-MM-DD"
MSG_DATE_PARSE = "日期解析失败"
MSG_DATE_ORDER = "开始日期不能晚于结束日期"
MSG_DATE_SPAN = "时间范围不能超过90天"
MSG_START_FUTURE = "开始日期不能是未来日期"
MSG_END_FUTURE = "结束日期不能是未来日期"
MSG_CATEGORY = "分类必须是以下之一: [%s]"
MSG_LANGUAGE = "编程语言必须是以下之一: [%s]"
MSG_ENUM = "%s 必须是以下之一: [%s]"
MSG_SCORE = "%s 必须在0.0-1.0之间"
MSG_COUNT = "%s 必须在%d-%d之间"
MSG_SOURCE = "数据源 '%s' 无效，有效的数据源: [%s]"
MSG_QUERY_EMPTY = "查询关键词不能为空"
MSG_QUERY_SHORT = "查询关键词至少需要2个字符"
MSG_QUERY_LONG = "查询关键词不能超过200个字符"
MSG_QUERY_CHARS = "查询关键词包含无效字符"
MSG_STARS_NEGATIVE = "最小星标数不能为负数"
MSG_STARS_HIGH = "最小星标数不能超过100000"
MSG_INVALID = "参数验证失败"
