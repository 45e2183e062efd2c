"""End-to-end flows over the test tables: ingest, scan, resolution on boards, outside candidates."""

from pyspark.sql import functions as F

from postmill.catalog.matching import MATCH_CTE, boards
from postmill.catalog.registry import query, spread_table, table
from postmill.plans import jobs as flows

NOW = "2026-01-02 03:04:05"
SEEN = """job_key string, first_seen_at timestamp, last_seen_at timestamp, title string, company string, location string,
linkedin_url string, jobright_url string, external_jd_url string"""


def seen_of(jobs):
    """Seen-state that holds the keys of `jobs`."""
    stamp = F.lit("2025-12-01 00:00:00").cast("timestamp")
    blank = [F.lit("").alias(n) for n in ("title", "company", "location", "linkedin_url", "jobright_url", "external_jd_url")]
    return jobs.select("job_key", stamp.alias("first_seen_at"), stamp.alias("last_seen_at"), *blank)


@query(
    "flow_scan",
    """
WITH s AS (SELECT b AS board, p_partkey AS page, p_name AS title, p_size FROM part, (VALUES ('Acme'), ('Beta')) v(b)
  WHERE regexp_matches(p_name, 'widget|bolt') AND NOT contains(p_name, 'cold')),
f AS (SELECT * FROM s WHERE page % 5 <> 0 OR board = 'Beta'),
r AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN row_number() OVER (PARTITION BY board, p_size % 2 ORDER BY page) END AS n FROM f)
SELECT board, page, title, coalesce(n <= 60, false) AS fetch_detail FROM r""",
)
def flow_scan(spark, sf):
    """Two boards with the same payloads; every fifth posting of one of them is known already."""
    parts = spread_table(spark, sf, "part")
    job = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"),
        F.concat(F.lit("https://x.example/"), F.col("p_partkey").cast("string")).alias("absolute_url"),
        F.struct(F.lit("Remote").alias("name")).alias("location"),
        F.when(F.col("p_size") % 2 == 0, "").otherwise("<p>Text</p>").alias("content"),
    )
    payload = F.to_json(F.struct(F.array(job).alias("jobs")))
    company = F.explode(F.array(F.lit("Acme"), F.lit("Beta"))).alias("company")
    pages = parts.select(company, F.lit("greenhouse").alias("ats"), F.col("p_partkey").alias("page"), payload.alias("payload"))
    now = F.lit(NOW).cast("timestamp")
    found = flows.scan_jobs(pages, [{"name": n, "ats": "greenhouse"} for n in ("Acme", "Beta")], now)
    # A posting's key is its URL, which both boards give; the company makes it the board's own.
    found = found.withColumn("job_key", F.concat_ws("|", "board", "job_key"))
    seen = seen_of(found.filter("page % 5 = 0 and board = 'Acme'"))
    fresh, _ = flows.scan_targets(found, seen, flows.ScanRules(include=("widget", "bolt"), exclude=("cold",)), now)
    return fresh.select("board", "page", "title", "fetch_detail")


@query(
    "flow_ingest",
    """
WITH k AS (SELECT p_partkey, p_name, p_brand, 'https://jobright.ai/jobs/info/' || substr(sha1(CAST(p_partkey AS VARCHAR)), 1, 24) AS url FROM part)
SELECT substr(sha1(url), 1, 16) AS job_key, p_name AS title, p_brand AS company, url AS jobright_url FROM k WHERE p_partkey % 4 <> 0""",
)
def flow_ingest(spark, sf):
    """A mail per part with its card twice, each mail sent twice; every fourth job is known already."""
    key = F.substring(F.sha1(F.col("p_partkey").cast("string")), 1, 24)
    card = F.concat(
        F.lit('<td id="job-section"><p id="job-company-name">'), "p_brand", F.lit('</p><div id="job-title"><a href="https://jobright.ai/jobs/info/'), key,
        F.lit('?utm=1">'), "p_name", F.lit('</a></div><span id="job-tag">$'), F.col("p_size").cast("string"), F.lit("K/yr</span></td>"),
    )
    copies = F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")
    messages = spread_table(spark, sf, "part").select("p_partkey", copies, card.alias("card")).select(
        (F.col("p_partkey") * 2 + F.col("copy")).alias("ordinal"), F.lit("Jobright <no-reply@jobright.ai>").alias("sender"),
        F.lit("New jobs").alias("subject"), F.lit("d").alias("date"), F.lit("m").alias("message_id"), F.lit("").alias("text"),
        F.concat(F.lit("<html>"), "card", "card", F.lit("</html>")).alias("html"),
    )
    now = F.lit(NOW).cast("timestamp")
    link = F.concat(F.lit("https://jobright.ai/jobs/info/"), key)
    known = spread_table(spark, sf, "part").filter("p_partkey % 4 = 0").select(F.substring(F.sha1(link), 1, 16).alias("job_key"))
    fresh, _ = flows.ingest_alerts(messages, seen_of(known), now)
    return fresh.select("job_key", "title", "company", "jobright_url")


@query(
    "flow_resolve_boards",
    MATCH_CTE
    + """, won AS (SELECT b.job_id, 'https://x.example/' || b.part AS url, b.opening_title, b.match_score FROM best b
  JOIN place_pairs l ON l.jl = b.jl AND l.ol = b.ol
  WHERE rn = 1 AND match_score >= 8 AND (ls > 0 OR contains(lower(place), 'remote')) AND chars >= 200)
SELECT p_partkey AS job_key, CASE WHEN p_partkey % 7 = 0 THEN 'level_filtered' WHEN url IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS external_jd_status,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE coalesce(url, '') END AS external_jd_url,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'match_score=' || CAST(match_score AS INTEGER) END AS direct_resolver_debug
FROM part LEFT JOIN won ON job_id = p_partkey""",
)
def flow_resolve_boards(spark, sf):
    """Every job looked up on its company's board; those outside the level band stay out."""
    jobs, openings = boards(spark, sf)
    wanted = jobs.select(
        F.col("job_id").alias("job_key"), "title", F.col("board").alias("company"), "location",
        F.when(F.col("job_id") % 7 == 0, "level_filtered").otherwise("unresolved").alias("external_jd_status"),
    )
    offered = openings.withColumns({"url": F.concat(F.lit("https://x.example/"), F.col("part").cast("string")), "source": F.lit("greenhouse")})
    resolvers = {f"Brand#{n}": ("greenhouse", f"Brand#{n}") for n in range(1, 26)}
    done = flows.resolve_on_boards(wanted, offered, resolvers)
    return done.select("job_key", "external_jd_status", "external_jd_url", "direct_resolver_debug")


@query(
    "flow_candidates",
    """
WITH u AS (SELECT page_id, unnest(CASE WHEN page_id % 3 = 0 THEN ['https://a.example/x', url] ELSE [url, 'https://a.example/x'] END) AS url,
  unnest([0, 1]) AS place FROM pages WHERE url IS NOT NULL)
SELECT page_id AS job_key, CAST(place AS INTEGER) AS place, url, CASE WHEN place = 0 THEN 'external_candidates' ELSE 'links' END AS source
FROM u WHERE regexp_matches(url, '^https?://')""",
)
def flow_candidates(spark, sf):
    """Outside links of pages: repeated in both columns, and with links that do not count between them."""
    first = F.when(F.col("page_id") % 3 == 0, F.lit("https://a.example/x")).otherwise(F.col("url"))
    second = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.lit("https://a.example/x"))
    jobs = table(spark, sf, "pages").filter("url is not null").select(
        F.col("page_id").alias("job_key"), F.array(first, F.lit("https://www.linkedin.com/jobs/view/1")).alias("external_candidates"),
        F.array(F.lit("ftp://a.example"), first, second, F.lit("")).alias("links"),
    )
    return flows.external_candidates(jobs)


@query(
    "public_pages",
    """
SELECT 'job' || doc_id AS job_key, CASE WHEN doc_id % 4 = 2 THEN 'https://www.linkedin.com/comm/search?currentJobId=' || doc_id ELSE 'https://www.linkedin.com/jobs/view/' || doc_id END AS external_jd_url,
  'linkedin_public' AS external_jd_status,
  'Lines & more : ' || source || chr(10) || trim(repeat('work ', (n_chars % 80)::INTEGER)) AS jd_text,
  'Title ' || lang AS jd_title, source AS jd_company, lang AS jd_location
FROM documents WHERE doc_id % 4 IN (1, 2) AND doc_id % 5 <> 0
  AND length(regexp_replace('Lines & more : ' || source || chr(10) || trim(repeat('work ', (n_chars % 80)::INTEGER)), '\\s+', ' ', 'g')) >= 200""",
)
def public_pages(spark, sf):
    """Public posting pages as the last resort: short texts, pages without the markup, and links to other hosts or places fall out."""
    docs = table(spark, sf, "documents").withColumn("id", F.col("doc_id").cast("string"))
    jobs = docs.select(F.concat(F.lit("job"), "id").alias("job_key"), F.concat(F.lit("Title "), "lang").alias("title"), F.col("source").alias("company"), F.col("lang").alias("location"))
    link = F.expr("""CASE doc_id % 4 WHEN 0 THEN concat('https://www.linkedin.com/in/', id) WHEN 1 THEN concat('https://www.linkedin.com/jobs/view/', id)
      WHEN 2 THEN concat('https://www.linkedin.com/comm/search?currentJobId=', id) ELSE concat('https://example.com/jobs/view/', id) END""")
    text = F.concat(F.lit("<b>Lines &amp; more</b>: "), "source", F.lit("<br>"), F.expr("repeat('work ', cast(n_chars % 80 as int))"))
    mark = F.when(F.col("doc_id") % 5 == 0, "description").otherwise("show-more-less-html__markup show")
    page = F.concat(F.lit('<html><title>x</title><div class="'), mark, F.lit('" dir="ltr">'), text, F.lit("</div><div>other</div></html>"))
    fetched = docs.select(F.concat(F.lit("job"), "id").alias("job_key"), link.alias("linkedin_url"), page.alias("html"))
    return flows.resolve_from_public_page(jobs, fetched).select(
        "job_key", "external_jd_url", "external_jd_status", "jd_text", "jd_title", "jd_company", "jd_location"
    )
