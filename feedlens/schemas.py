"""Column contracts of the entities and of the landed payloads."""

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())
STRING_MAP = T.MapType(T.StringType(), T.StringType())

# What every source parser returns. ``ingest_seq`` orders "first wins" decisions.
RAW_ARTICLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("published_at", T.TimestampNTZType()),
        T.StructField("tags", STRINGS),
        T.StructField("source", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("metadata", STRING_MAP),
        T.StructField("ingest_seq", T.LongType()),
    ]
)

ARTICLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("published_at", T.TimestampNTZType()),
        T.StructField("summary", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tags", STRINGS),
        T.StructField("relevance", T.DoubleType()),
        T.StructField("quality", T.DoubleType()),
        T.StructField("metadata", STRING_MAP),
        T.StructField("ingest_seq", T.LongType()),
    ]
)

REPOSITORY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("full_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("stars", T.LongType()),
        T.StructField("forks", T.LongType()),
        T.StructField("trend_score", T.DoubleType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("metadata", STRING_MAP),
        T.StructField("ingest_seq", T.LongType()),
    ]
)

# A landed response body together with the configuration of the source it came from.
PAYLOAD = T.StructType(
    [
        T.StructField("source_url", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("config_tags", STRINGS),
        T.StructField("config_language", T.StringType()),
        T.StructField("config_metadata", STRING_MAP),
        T.StructField("fetched_at", T.TimestampNTZType()),
        T.StructField("payload_seq", T.LongType()),
    ]
)

ACCESS_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("op", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("hit", T.BooleanType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

INVENTORY = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("access_count", T.LongType()),
        T.StructField("last_accessed", T.TimestampNTZType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("expiry", T.TimestampNTZType()),
    ]
)
