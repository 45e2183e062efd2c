"""Composed flows: triage routing, reports, inbox, incremental stream."""

import uuid

from pyspark.sql import functions as F

from postmill.catalog.keyed import SEEN_SQL, events_around, seen_users
from postmill.catalog.registry import query, table
from postmill.catalog.rules import classified_parts
from postmill.functions.text import clamp_score
from postmill.operators import inbox, reports, rules
from postmill.plans import jobs as flow

LEVELS = rules.LevelRules(
    companies={"src1": (("en", "principal"),), "src2": (("fr", "junior"), ("en", "senior"))},
    default=(("fr", "staff"), ("es", "senior")),
    order={"junior": 1, "senior": 3, "staff": 4, "principal": 6}, min_tier="senior", max_tier="staff",
)
GEO = rules.GeoRules(non_us_keywords=("src3", "src4"))
CITY = rules.CityRules(allowed_cities=("src1", "src2", "src5", "src6", "src7", "src8", "src9"))

ROUTED = """
WITH tiered AS (
  SELECT doc_id, source, lang, text, n_chars,
    CASE WHEN source = 'src1' AND lang = 'en' THEN 'principal' WHEN source = 'src2' AND lang = 'fr' THEN 'junior'
         WHEN source = 'src2' AND lang = 'en' THEN 'senior' WHEN lang = 'fr' THEN 'staff' WHEN lang = 'es' THEN 'senior' END AS tier
  FROM documents),
banded AS (SELECT *, CASE tier WHEN 'principal' THEN 'out_of_band_too_high' WHEN 'junior' THEN 'out_of_band_too_low' ELSE 'resolved' END AS status FROM tiered),
once AS (SELECT min(doc_id) AS doc_id, count(*) AS duplicate_count FROM banded WHERE status = 'resolved'
  GROUP BY lower(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')), lang),
placed AS (SELECT b.*, o.duplicate_count,
    CASE WHEN source IN ('src3', 'src4') THEN 'non_us'
         WHEN source NOT IN ('src1','src2','src5','src6','src7','src8','src9','src10','src11','src12','src13','src14','src15','src16','src17','src18','src19') THEN 'city_filtered'
         ELSE 'kept' END AS route,
    CAST(least(100, n_chars // 40) AS INTEGER) AS match_score
  FROM once o JOIN banded b ON o.doc_id = b.doc_id),
scored AS (SELECT *, CASE WHEN match_score >= 91 THEN 'strong_match' WHEN match_score >= 71 THEN 'medium_match' ELSE 'weak_match' END AS verdict,
    lpad(CAST(match_score AS VARCHAR), CASE WHEN match_score > 99 THEN 3 ELSE 2 END, '0') || ' - ' || source || ' - ' || lang || '.md' AS opportunity_filename
  FROM placed WHERE route = 'kept' AND length(text) >= 0)
"""


def routed(spark, sf):
    """Documents as jobs: text as the key URL, lang as title, source as company and place."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("title"), F.col("source").alias("company"), F.col("source").alias("location"),
        F.sha1(F.lower(F.regexp_replace("text", r"^\s+|\s+\z", ""))).alias("external_jd_url"), "n_chars",
    )
    banded = flow.band_gate(docs, LEVELS).withColumn(
        "external_jd_status",
        F.when(F.col("external_jd_status") == "unresolved", "resolved").otherwise(F.col("external_jd_status")),
    ).withColumns({c: F.lit("") for c in ("jd_title", "jd_company", "jd_location")})
    return banded, flow.geo_split(flow.triage_candidates(banded, "doc_id"), GEO, CITY)
def scored(spark, sf):
    _, placed = routed(spark, sf)
    score = clamp_score(F.floor(F.col("n_chars") / 40))
    kept = placed.filter("route = 'kept'").withColumn("match_score", score)
    return flow.note_routing(kept.withColumn("verdict", rules.verdict_of(F.col("match_score"))))


@query("triage_route", ROUTED + "SELECT doc_id, duplicate_count, route FROM placed")
def triage_route(spark, sf):
    return routed(spark, sf)[1].select("doc_id", "duplicate_count", "route")


@query(
    "scored_notes",
    ROUTED
    + """SELECT doc_id, match_score, verdict, opportunity_filename,
   CASE WHEN match_score <= 70 THEN 'Filtered/Low Score' ELSE '' END AS folder FROM scored""",
)
def scored_notes(spark, sf):
    return scored(spark, sf).select("doc_id", "match_score", "verdict", "opportunity_filename", "folder")


@query(
    "verdict_counts",
    ROUTED
    + """SELECT company, count(*) FILTER (WHERE verdict = 'strong_match') AS strong, count(*) FILTER (WHERE verdict = 'medium_match') AS medium,
   count(*) FILTER (WHERE verdict = 'weak_match') AS weak FROM (SELECT *, source AS company FROM scored) GROUP BY company""",
)
def verdict_counts(spark, sf):
    return reports.verdict_counts(scored(spark, sf), ["company"])


@query(
    "top_strong",
    ROUTED
    + """SELECT company, doc_id, match_score, CAST(place AS INTEGER) AS place FROM (SELECT *, source AS company,
   row_number() OVER (PARTITION BY source ORDER BY match_score DESC, doc_id) AS place FROM scored WHERE verdict = 'strong_match') WHERE place <= 5""",
)
def top_strong(spark, sf):
    return reports.top_strong(scored(spark, sf), ["company"], "doc_id").select("company", "doc_id", "match_score", "place")


@query(
    "report_lines",
    ROUTED
    + """SELECT CAST(1 AS INTEGER) AS section, -match_score::BIGINT AS rank, doc_id AS at_id,
   '- **' || match_score || '** · ' || verdict || ' · [[Opportunities/' || regexp_replace(opportunity_filename, '\\.md$', '') || ']]'
   || CASE WHEN duplicate_count > 1 THEN ' | alerts=' || duplicate_count ELSE '' END AS line FROM scored
UNION ALL SELECT 2, 0, doc_id, '- ' || source || ' | ' || lang || ' | ' || source FROM banded WHERE status <> 'resolved'""",
)
def report_lines(spark, sf):
    banded, _ = routed(spark, sf)
    _, open_jobs = reports.split_resolved(banded)
    lines = reports.report_lines(scored(spark, sf), open_jobs, "doc_id")
    return lines.orderBy("section", "rank", "at").withColumnRenamed("at", "at_id")


@query(
    "resolved_counts",
    ROUTED
    + """SELECT count(*) AS job_count, count(*) FILTER (WHERE status = 'resolved') AS resolved_count,
   count(*) FILTER (WHERE status <> 'resolved') AS unresolved_count FROM banded""",
)
def resolved_counts(spark, sf):
    return reports.resolved_counts(routed(spark, sf)[0])


@query(
    "note_lookup",
    """
WITH notes AS (SELECT p_partkey % 3 AS directory_rank,
    CASE WHEN p_size % 4 = 0 THEN p_name || '.md' ELSE lpad(CAST(p_size AS VARCHAR), 2, '0') || ' - ' || p_name || '.md' END AS file_name FROM part),
ranked AS (SELECT regexp_replace(file_name, '^[0-9]{2,3} - ', '') AS bare, file_name, directory_rank,
    CASE WHEN regexp_matches(file_name, '^[0-9]{2,3} - ') THEN 1 ELSE 0 END AS form FROM notes),
best AS (SELECT bare, file_name, directory_rank, row_number() OVER (PARTITION BY bare ORDER BY form, directory_rank, file_name) AS rn FROM ranked)
SELECT p.p_partkey AS job_key, b.file_name AS existing, b.directory_rank AS existing_rank
FROM part p LEFT JOIN best b ON b.bare = p.p_name || '.md' AND b.rn = 1""",
)
def note_lookup(spark, sf):
    parts = table(spark, sf, "part")
    plain = F.concat("p_name", F.lit(".md"))
    notes = parts.select(
        (F.col("p_partkey") % 3).alias("directory_rank"),
        F.when(F.col("p_size") % 4 == 0, plain)
        .otherwise(F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(" - "), plain)).alias("file_name"),
    )
    jobs = parts.select(F.col("p_partkey").alias("job_key"), plain.alias("note_name"))
    return reports.existing_notes(jobs, notes).drop("note_name")


STATUSES = ("resolved", "linkedin_public", "ats_api", "user_supplied", "unresolved", None)


def statused(spark, sf):
    """Orders as jobs whose status goes round all there are."""
    status = F.lit(None).cast("string")
    for at, name in enumerate(STATUSES[:-1]):
        status = F.when(F.col("o_orderkey") % 6 == at, name).otherwise(status)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_key"), status.alias("external_jd_status"))


@query(
    "stats_envelope",
    """
SELECT count(*) AS job_count, count(*) FILTER (WHERE o_orderkey % 6 IN (0, 1)) AS enriched,
  count(*) FILTER (WHERE o_orderkey % 6 IN (0, 1, 2)) AS reported, count(*) FILTER (WHERE o_orderkey % 6 IN (0, 1, 2, 3)) AS triaged FROM orders""",
)
def stats_envelope(spark, sf):
    return reports.resolved_by_set(statused(spark, sf))


def report_parts(spark, sf):
    """Documents awaiting a description, scored ones with errors and repeats among them, filtered ones."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("ordinal"), F.col("doc_id").cast("string").alias("job_key"), F.col("source").alias("company"), F.col("lang").alias("title"),
        (F.col("n_chars") % 101).cast("int").alias("score"),
    )
    marked = docs.withColumns({
        "note": F.concat(F.lit("/vault/Opportunities/"), "company", F.lit(" - "), "title", F.lit(".md")),
        "error": F.when(F.col("ordinal") % 10 == 1, "no reply"), "filter_reason": F.when(F.col("ordinal") % 2 == 0, "level"),
        "filter_status": F.when(F.col("ordinal") % 3 == 0, "passes_rules").otherwise("filtered_out"),
    })
    ready = docs.filter("ordinal % 5 <> 2").withColumn("company", F.concat(F.lit("old "), "company")).unionByName(
        docs.filter("ordinal % 5 <> 2").withColumn("ordinal", F.col("ordinal") + 1_000_000_000)
    )
    return marked, ready


SCORED_REPORT = """
WITH s AS (SELECT doc_id AS ordinal, doc_id::VARCHAR AS job_key, source AS company, lang AS title, (n_chars % 101)::INTEGER AS score,
  source || ' - ' || lang || '.md' AS opportunity_filename FROM documents WHERE doc_id % 10 <> 1 AND doc_id % 5 <> 2)
"""


@query("scored_report", SCORED_REPORT + "SELECT job_key, company, title, score, '' AS verdict, opportunity_filename FROM s")
def scored_report(spark, sf):
    marked, ready = report_parts(spark, sf)
    return reports.scored_for_report(marked, ready)


@query(
    "daily_report_lines",
    SCORED_REPORT
    + """, n AS (SELECT (SELECT count(*) FROM orders) AS raw, (SELECT count(*) FROM documents) AS uniq, (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0) AS filtered,
    (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS passes, (SELECT count(*) FROM orders WHERE o_orderkey % 6 < 3) AS resolved, (SELECT count(*) FROM s) AS scored),
fixed AS (SELECT 0 AS section, 0 AS part, 0 AS "at", '# Job Report — 2026-01-02' AS line FROM n
  UNION ALL SELECT 0, 0, 1, '' FROM n UNION ALL SELECT 0, 0, 2, '## Pipeline Summary' FROM n UNION ALL SELECT 0, 0, 3, '' FROM n
  UNION ALL SELECT 0, 0, 4, '| Metric | Count |' FROM n UNION ALL SELECT 0, 0, 5, '|---|---|' FROM n
  UNION ALL SELECT 0, 1, 0, '| Raw jobs from LinkedIn alerts | ' || raw || ' |' FROM n UNION ALL SELECT 0, 1, 1, '| After dedupe (unique roles) | ' || uniq || ' |' FROM n
  UNION ALL SELECT 0, 1, 2, '| Filtered out (rules + LLM) | ' || filtered || ' |' FROM n UNION ALL SELECT 0, 1, 3, '| Passing → Pending Inbox | ' || passes || ' |' FROM n
  UNION ALL SELECT 0, 1, 4, '| Resolved by ATS resolver | ' || resolved || ' |' FROM n UNION ALL SELECT 0, 1, 5, '| Awaiting JD (in Pending JDs.md) | 0 |' FROM n
  UNION ALL SELECT 0, 1, 6, '| Scored today (incl. manual JD fills) | ' || scored || ' |' FROM n
  UNION ALL SELECT 1, 0, 0, '' FROM n UNION ALL SELECT 1, 0, 1, '## Awaiting your JD (0)' FROM n UNION ALL SELECT 1, 0, 2, '' FROM n
  UNION ALL SELECT 1, 1, 0, '_No new jobs awaiting JD this run._' FROM n
  UNION ALL SELECT 2, 0, 0, '' FROM n UNION ALL SELECT 2, 0, 1, '## Scored today (' || scored || ')' FROM n UNION ALL SELECT 2, 0, 2, '' FROM n
  UNION ALL SELECT 3, 0, 0, '' FROM n UNION ALL SELECT 3, 0, 1, '## Filtered out (' || filtered || ')' FROM n UNION ALL SELECT 3, 0, 2, '' FROM n
  UNION ALL SELECT 3, 0, 3, '<details>' FROM n UNION ALL SELECT 3, 0, 4, '<summary>Click to expand</summary>' FROM n UNION ALL SELECT 3, 0, 5, '' FROM n
  UNION ALL SELECT 3, 2, 0, '' FROM n UNION ALL SELECT 3, 2, 1, '</details>' FROM n)
SELECT section::INTEGER AS section, part::INTEGER AS part, CAST("at" AS BIGINT) AS "at", line FROM fixed
UNION ALL SELECT 2, 1, ordinal, '- [[Opportunities/' || company || ' - ' || title || ']] — ' || score || ', ' FROM s
UNION ALL SELECT 3, 1, doc_id, '- ' || source || ' — ' || lang || ' (' || CASE WHEN doc_id % 2 = 0 THEN 'level' ELSE '' END || ')' FROM documents WHERE doc_id % 3 <> 0""",
)
def daily_report_lines(spark, sf):
    marked, ready = report_parts(spark, sf)
    counts = reports.funnel(table(spark, sf, "orders"), marked, statused(spark, sf))
    scored_rows = reports.scored_for_report(marked, ready).withColumn("ordinal", F.col("job_key").cast("bigint"))
    nothing = marked.filter("ordinal < 0")
    return reports.daily_report_lines("2026-01-02", counts, nothing, scored_rows, marked.filter("filter_status = 'filtered_out'"))


@query(
    "run_counters",
    """
SELECT company_slug, new_count, locked_count, error_count, CASE WHEN error_count > 0 THEN 2 ELSE 0 END AS exit_status FROM (
  SELECT CAST(user_id AS VARCHAR) AS company_slug, count(*) FILTER (WHERE event_type = 'click') AS new_count,
    count(*) FILTER (WHERE event_type = 'view') AS locked_count, count(*) FILTER (WHERE event_type = 'error') AS error_count
  FROM events GROUP BY user_id)""",
)
def run_counters(spark, sf):
    status = F.when(F.col("event_type") == "click", "ok").when(F.col("event_type") == "view", "locked").when(
        F.col("event_type") == "error", "fetch_error"
    ).otherwise("none")
    return reports.run_counters(
        table(spark, sf, "events").select(F.col("user_id").cast("string").alias("company_slug"), status.alias("summary_status"))
    )


@query(
    "stage_funnel",
    """
WITH k AS (SELECT p_type, p_name, p_brand, row_number() OVER (PARTITION BY lower(trim(p_brand)), lower(trim(p_name)) ORDER BY p_partkey) AS rn FROM part),
j AS (SELECT CASE WHEN rn > 1 THEN 'd' WHEN lower(p_type) IN ('promo', 'economy') OR lower(p_type) NOT IN ('standard', 'small', 'medium') THEN 'f'
   WHEN lower(p_brand) IN ('brand#7', 'brand#12') THEN 'p' WHEN regexp_matches(p_name, 'anvil|ring') THEN 'f' ELSE 'p' END AS s FROM k)
SELECT (SELECT count(*) FROM part) AS raw_count, count(*) FILTER (WHERE s = 'p') AS passes_count, count(*) FILTER (WHERE s = 'f') AS filtered_count,
  (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS resolved_count, count(*) FILTER (WHERE s <> 'd') AS unique_count FROM j""",
)
def stage_funnel(spark, sf):
    enriched = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "ats_api").otherwise("user_supplied").alias("external_jd_status")
    )
    return reports.funnel(table(spark, sf, "part"), classified_parts(spark, sf), enriched)

INBOX_SQL = """
WITH open_docs AS (
  SELECT doc_id, source, lang, text, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS rn, sha1(text) AS k
  FROM documents WHERE lang <> 'en'),
known AS (SELECT DISTINCT sha1(text) AS k FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
fresh AS (SELECT * FROM open_docs WHERE rn = 1 AND k NOT IN (SELECT k FROM known))
"""


@query(
    "inbox_sections",
    INBOX_SQL
    + """SELECT doc_id, k AS job_key, '2026-04-25' AS first_seen, source AS company, lang AS title,
   'https://x/' || doc_id AS external_jd_url, length(regexp_replace(regexp_replace(regexp_replace(text, chr(10) || '{3,}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '')) >= 200 AS scorable
FROM fresh""",
)
def inbox_sections(spark, sf):
    """Append new sections, paste each document's text, read the sections back."""
    docs = table(spark, sf, "documents")
    jobs = docs.select(
        "doc_id", F.sha1("text").alias("job_key"), F.col("source").alias("company"), F.col("lang").alias("title"),
        F.lit("").alias("location"), F.lit("").alias("linkedin_url"), F.lit("").alias("filter_reason"),
        F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")).alias("external_jd_url"),
        F.when(F.col("lang") == "en", "resolved").otherwise("unresolved").alias("external_jd_status"),
    )
    labels = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    existing = docs.join(labels, "doc_id", "left_semi").select(F.sha1("text").alias("job_key"))
    added = inbox.new_sections(jobs, existing, "doc_id", F.lit("2026-04-25"))
    filled_in = added.join(docs.select("doc_id", "text"), "doc_id").select(
        "doc_id",
        F.replace("section", F.lit(inbox.fixed.INBOX_PLACEHOLDER), F.concat(F.lit(inbox.fixed.INBOX_PLACEHOLDER + "\n\n"), "text")).alias("value"),
    )
    found = inbox.read_sections(filled_in)
    scorable = inbox.ready(found).select("doc_id", F.col("company").alias("_c"))
    return found.join(scorable, "doc_id", "left").select(
        "doc_id", "job_key", "first_seen", inbox.line_after("body", "- **Company**:").alias("company"),
        inbox.line_after("body", "- **Title**:").alias("title"),
        inbox.line_after("body", "- **Source link**:").alias("external_jd_url"), F.col("_c").isNotNull().alias("scorable"),
    )


@query("stream_seen", SEEN_SQL)
def stream_seen(spark, sf):
    """The seen-state by an availableNow stream over the events file: equal to the one-shot upsert."""
    from postmill.session import shared_folder
    from postmill.state import BucketedTable
    from postmill.streaming.incremental import run_seen_stream

    base = f"{shared_folder(spark)}/seen-{uuid.uuid4().hex}"
    before, _ = events_around(spark, sf)
    states = BucketedTable(
        spark, f"{base}/state", "user_id bigint, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, event_type string", ["user_id"], 8
    )
    states.merge(seen_users(before), lambda held, new: new)
    at = F.lit("2024-01-01 06:00:00").cast("timestamp_ntz")
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).filter(F.col("ts") >= at)
    run_seen_stream(stream, states, ["user_id"], lambda: F.col("ts"), "event_id", f"{base}/checkpoint", ["event_type"])
    return states.read()


LISTED = """
SELECT CAST(o_orderkey AS VARCHAR) AS tid, o_orderpriority AS company, CASE WHEN ts < TIMESTAMP '1998-01-01' THEN 0 ELSE 1 END AS run
FROM (SELECT *, o_orderdate::TIMESTAMP + to_minutes((o_orderkey % 1440)::INTEGER) AS ts FROM orders)
WHERE ts >= TIMESTAMP '1998-01-01' - INTERVAL 360 DAY AND ts < TIMESTAMP '1998-04-01'"""


@query("listing_stream", LISTED)
def listing_stream(spark, sf):
    """Each order priority as a company whose listing has its orders, newest first: a first run of twelve months, then a second."""
    from pyspark.sql import Window

    from postmill.session import shared_folder
    from postmill.streaming.listings import run_listing_stream

    base = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}"
    at = F.timestamp_add("MINUTE", (F.col("o_orderkey") % 1440).cast("int"), F.col("o_orderdate").cast("timestamp"))
    threads = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("company"), at.alias("at"))
    key = F.col("o_orderkey").cast("string")
    row = F.concat(
        F.lit('<time title="'), F.date_format("at", "yyyy-MM-dd HH:mm:ss"), F.lit('"></time><a href="https://www.1point3acres.com/bbs/thread-'), key,
        F.lit('-1-1.html"><div class="flex-1">Order '), key, F.lit("</div></a>"),
    )
    # A page is a month's threads, the newest month first; the window sees one row per month.
    months = threads.select("company", F.trunc("at", "month").alias("month")).distinct()
    paged = months.withColumn("page", F.row_number().over(Window.partitionBy("company").orderBy(F.col("month").desc())) - 1)
    lines = threads.withColumn("month", F.trunc("at", "month")).join(paged, ["company", "month"]).withColumn("value", row)
    lines.repartition("company", "page").sortWithinPartitions("company", "page", F.col("at").desc()).select("company", "page", "value").write.partitionBy("company", "page").text(base)
    names = [r[0] for r in months.select("company").distinct().collect()]
    specs = [{"name": n, "folder": f"{base}/company={n}"} for n in names]
    for number, until in enumerate(("1998-01-01 00:00:00", "1998-04-01 00:00:00")):
        run_listing_stream(
            spark, specs, "postmill.streaming.listings:written_page", f"{base}-checkpoint",
            lambda new, _, number=number: new.select("tid", "company", F.lit(number).alias("run")).write.mode("append").parquet(f"{base}-new"), until,
        )
    return spark.read.schema("tid string, company string, run int").parquet(f"{base}-new")


def _note_sql(score: str) -> str:
    return f"lpad(({score})::VARCHAR, greatest(2, length(({score})::VARCHAR))::INTEGER, '0') || ' - ' || name"


FIRST_SCORE, NEXT_SCORE = "p_size * 2", "CASE WHEN p_partkey % 4 = 0 THEN p_size * 2 ELSE (p_size * 7 + p_partkey) % 100 END"


@query(
    "note_moves",
    f"""
WITH p AS (SELECT *, p_type || ' - ' || p_name || ' ' || p_partkey || '.md' AS name, {FIRST_SCORE} AS old, {NEXT_SCORE} AS new FROM part),
r AS (SELECT name, p_partkey % 3 > 0 AS known, CASE WHEN old <= 70 THEN 'Filtered/Low Score/' ELSE '/' END || {_note_sql("old")} AS old_path,
  CASE WHEN new <= 70 THEN 'Filtered/Low Score/' ELSE '/' END || {_note_sql("new")} AS new_path, p_partkey % 4 = 0 AS same, new FROM p)
SELECT name AS note_name, CASE WHEN NOT known THEN 'insert' WHEN old_path <> new_path THEN 'move' WHEN same THEN 'keep' ELSE 'update' END AS change,
  new_path AS path, CASE WHEN known THEN old_path END AS old_path,
  '---' || chr(10) || 'match_score: ' || new || chr(10) || 'verdict: ' || CASE WHEN same THEN 'first' ELSE 'second' END || chr(10) || 'triage_mode: jd_full' || chr(10)
    || '---' || chr(10) || chr(10) || '# ' || name || chr(10) AS head
FROM r""",
)
def note_moves(spark, sf):
    """Two runs over the parts: two thirds have a note, a fourth keeps its score, the others get a new one."""
    from postmill.operators import notes

    parts = table(spark, sf, "part").withColumn("note_name", F.concat("p_type", F.lit(" - "), "p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".md")))

    def scored(rows, score, verdict):
        number = F.expr(score).cast("int")
        return rows.select(
            "note_name", F.when(number <= 70, "Filtered/Low Score").otherwise("").alias("folder"), number.alias("score"), verdict.alias("verdict"),
            F.lit("jd_full").alias("mode"), F.concat(F.lit("# "), "note_name", F.lit("\n")).alias("note"), F.lit(False).alias("stub"), F.col("p_partkey").alias("ordinal"),
        )

    nothing = spark.createDataFrame([], notes.NOTES)
    held = notes.note_changes(nothing, scored(parts.filter("p_partkey % 3 > 0"), FIRST_SCORE, F.lit("first")))
    verdict = F.when(F.col("p_partkey") % 4 == 0, "first").otherwise("second")
    changes = notes.note_changes(held.select("note_name", "folder", "file_name", "head"), scored(parts, NEXT_SCORE, verdict))
    path = lambda folder, name: F.concat(F.col(folder), F.lit("/"), F.col(name))
    return changes.select("note_name", "change", path("folder", "file_name").alias("path"), path("old_folder", "old_file_name").alias("old_path"), "head")


@query(
    "lookup_openings",
    """SELECT p_brand AS board, p_partkey::VARCHAR AS id, trim(p_name) AS title, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS location,
  'https://jobs/' || p_partkey AS url, 'Size ' || p_size || chr(10) || 'of ' || p_type AS description, p_size % 2 = 0 AS asked_late FROM part""",
)
def lookup_openings(spark, sf):
    """Each brand as a board whose page is fetched once: half of the brands in a first run, all by a second, and a third that may not fetch."""
    from postmill.session import shared_folder
    from postmill.sources import lookup
    from postmill.state import BucketedTable

    base = f"{shared_folder(spark)}/lookup-{uuid.uuid4().hex}"
    parts = table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    job = F.to_json(F.struct(
        key.alias("id"), F.concat(F.lit(" "), "p_name").alias("title"), F.concat(F.lit("https://jobs/"), key).alias("absolute_url"),
        F.when(F.col("p_size") % 3 > 0, F.struct(F.col("p_type").alias("name"))).alias("location"),
        F.concat(F.lit("<p>Size "), F.col("p_size").cast("string"), F.lit("</p><p>of "), "p_type", F.lit("</p>")).alias("content"),
    ))
    # A board's page is one text by nature: its jobs, some hundred, are joined in their order.
    pages = parts.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", job.alias("job")))).alias("jobs"))
    listed = F.concat(F.lit('{"jobs": ['), F.array_join(F.transform("jobs", lambda j: j["job"]), ","), F.lit("]}"))
    folder = F.translate(F.col("p_brand"), "#", "-")
    pages.select(folder.alias("board"), F.lit(0).alias("page"), listed.alias("value")).repartition("board").write.partitionBy("board", "page").text(base)
    cache = BucketedTable(spark, f"{base}-cache", lookup.CACHED, lookup.KEYS, 8)
    settings = F.to_json(F.struct(F.concat(F.lit(f"{base}/board="), folder).alias("folder")))
    wanted = parts.select(F.lit("greenhouse").alias("ats"), F.col("p_brand").alias("board"), settings.alias("settings"), "p_size")
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    lookup.read_through(wanted.filter("board < 'Brand#3'"), cache, "postmill.streaming.listings:written_page", now)
    lookup.read_through(wanted, cache, "postmill.streaming.listings:written_page", now)
    held = lookup.read_through(wanted, cache, "postmill.sources.lookup:not_reached", now)
    found = lookup.greenhouse_openings(held)
    late = parts.select(key.alias("id"), (F.col("p_size") % 2 == 0).alias("asked_late"))
    return found.join(late, "id").select("board", "id", "title", "location", "url", "description", "asked_late")
