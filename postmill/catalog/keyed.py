"""Keyed state over events, orders, lineitem and documents."""

from pyspark.sql import functions as F

from postmill.catalog.registry import query, table
from postmill.functions.text import norm
from postmill.operators import keyed as k

SPLIT = "2024-01-01 06:00:00"


def events_around(spark, sf):
    events = table(spark, sf, "events")
    at = F.lit(SPLIT).cast("timestamp_ntz")
    return events.filter(F.col("ts") < at), events.filter(F.col("ts") >= at)


def seen_users(before):
    return before.groupBy("user_id").agg(
        F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"),
        F.min_by("event_type", "event_id").alias("event_type"),
    )


SEEN_SQL = """
WITH state AS (
  SELECT user_id, min(ts) AS f, max(ts) AS l, min_by(event_type, event_id) AS e
  FROM events WHERE ts < TIMESTAMP '2024-01-01 06:00:00' GROUP BY user_id),
batch AS (
  SELECT user_id, min(ts) AS f, max(ts) AS l, min_by(event_type, event_id) AS e
  FROM events WHERE ts >= TIMESTAMP '2024-01-01 06:00:00' GROUP BY user_id)
SELECT coalesce(s.user_id, b.user_id) AS user_id, coalesce(s.f, b.f) AS first_seen_at,
  greatest(s.l, b.l) AS last_seen_at, coalesce(s.e, b.e) AS event_type
FROM state s FULL OUTER JOIN batch b ON s.user_id = b.user_id"""


@query("seen_upsert", SEEN_SQL)
def seen_upsert(spark, sf):
    before, after = events_around(spark, sf)
    merged = k.upsert_seen(
        seen_users(before), after, ["user_id"], F.col("ts"), "event_id", ["event_type"]
    )
    return merged.orderBy(F.asc_nulls_first("last_seen_at"), "user_id")


@query(
    "new_only",
    """
SELECT event_id, user_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
  FROM events WHERE ts >= TIMESTAMP '2024-01-01 06:00:00')
WHERE rn = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-01 06:00:00')""",
)
def new_only(spark, sf):
    before, after = events_around(spark, sf)
    narrow = after.select("event_id", "user_id", "event_type")
    return k.unseen(k.keep_first(narrow, ["user_id"], "event_id"), before, ["user_id"])


@query(
    "unseen_threads",
    """
SELECT event_id, event_type, user_id FROM events e WHERE ts >= TIMESTAMP '2024-01-01 06:00:00'
AND NOT EXISTS (SELECT 1 FROM events s WHERE s.ts < TIMESTAMP '2024-01-01 06:00:00'
                AND s.event_type = e.event_type AND s.user_id = e.user_id)""",
)
def unseen_threads(spark, sf):
    before, after = events_around(spark, sf)
    return k.unseen(after.select("event_id", "event_type", "user_id"), before, ["event_type", "user_id"])


@query(
    "thread_state_replace",
    """
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS rn FROM events)
SELECT event_type, user_id, event_id, value FROM ranked WHERE rn = 1""",
)
def thread_state_replace(spark, sf):
    before, after = events_around(spark, sf)
    columns = ["event_type", "user_id", "event_id", "value"]
    keys = ["event_type", "user_id"]
    state = k.latest(before.select(*columns), keys, ["event_id"])
    return k.replace_rows(state, after.select(*columns), keys, "event_id")


@query(
    "merge_two_key_anti",
    """
WITH base AS (SELECT 'o' || o_orderkey AS job_key, 'c' || o_custkey AS external_jd_url
              FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
extra AS (SELECT 'o' || l_orderkey AS job_key,
            CASE WHEN l_returnflag = 'R' THEN '' ELSE 'c' || l_suppkey END AS external_jd_url, l_linenumber
          FROM lineitem)
SELECT 'base' AS origin, job_key, external_jd_url, CAST(NULL AS INTEGER) AS l_linenumber FROM base
UNION ALL
SELECT 'extra', job_key, external_jd_url, l_linenumber FROM extra e
WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.job_key = e.job_key)
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.external_jd_url = e.external_jd_url)""",
)
def merge_two_key_anti(spark, sf):
    base = (
        table(spark, sf, "orders")
        .filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
        .select(
            F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("job_key"),
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("external_jd_url"),
        )
    )
    extra = table(spark, sf, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("job_key"),
        F.when(F.col("l_returnflag") == "R", "")
        .otherwise(F.concat(F.lit("c"), F.col("l_suppkey").cast("string")))
        .alias("external_jd_url"),
        "l_linenumber",
        F.monotonically_increasing_id().alias("_row"),
    )
    merged = k.merge_unmatched(base, extra, ["job_key", "external_jd_url"], "_row", origin="origin")
    return merged.select("origin", "job_key", "external_jd_url", "l_linenumber")


@query(
    "dedupe_with_count",
    """
SELECT min(doc_id) AS doc_id, lang, min_by(source, doc_id) AS source, count(*) AS duplicate_count
FROM documents GROUP BY lower(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')), lang""",
)
def dedupe_with_count(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.sha1(norm("text")).alias("key"), "lang", "doc_id", "source"
    )
    return k.first_with_count(docs, ["key", "lang"], "doc_id", "duplicate_count").select(
        "doc_id", "lang", "source", "duplicate_count"
    )


@query(
    "first_per_key",
    """
SELECT doc_id, source, text FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def first_per_key(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text", F.sha1("text").alias("job_key"))
    return k.keep_first(docs, ["job_key"], "doc_id").drop("job_key")


@query(
    "progress_latest",
    """
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def progress_latest(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return k.latest(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "source_quota",
    """
SELECT event_type, event_id, user_id FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS rn FROM events
    ) WHERE rn = 1 AND ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 29 DAY)
WHERE place <= 50""",
)
def source_quota(spark, sf):
    # a source drops repeated ids before it looks at the age, and the limit counts what is left
    events = table(spark, sf, "events").select("event_type", "user_id", "event_id", "ts")
    cutoff = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 29 DAYS")
    fresh = k.keep_first(events, ["event_type", "user_id"], "event_id").filter(F.col("ts") >= cutoff)
    return k.quota(fresh, ["event_type"], [F.col("event_id").asc()], 50).drop("ts")


@query(
    "lazy_quota",
    """
WITH wanted AS (
  SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
  FROM documents WHERE n_chars < 2000)
SELECT d.doc_id, d.source, coalesce(w.rn <= 5, false) AS fetch
FROM documents d LEFT JOIN wanted w ON d.doc_id = w.doc_id""",
)
def lazy_quota(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    marked = k.mark_quota(docs, ["source"], "doc_id", 5, F.col("n_chars") < 2000, "fetch")
    return marked.drop("n_chars")


@query(
    "numbered_rows",
    """
SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part""",
)
def numbered_rows(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return k.number_rows(parts, [F.desc("p_retailprice"), F.asc("p_partkey")], "place").drop("p_retailprice")


@query(
    "run_slice",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 40",
)
def run_slice(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return k.slice_rows(orders, [F.col("o_orderkey").asc()], offset=40, limit=100)


@query(
    "resume_cache",
    """
SELECT doc_id AS thread_id, source FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)""",
)
def resume_cache(spark, sf):
    from postmill.operators.handbook import pending_threads

    posts = table(spark, sf, "documents").select(F.col("doc_id").alias("thread_id"), "source")
    cache = table(spark, sf, "labels").select(
        F.col("doc_id").alias("thread_id"), F.when(F.col("toxic") == 1, "failed").alias("error")
    )
    return pending_threads(posts, cache)
