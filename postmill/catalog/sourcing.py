"""Source parsers over payloads that Spark builds from part, documents and events."""

from pyspark.sql import functions as F

from postmill.catalog.registry import query, spread_table, table
from postmill.functions.text import html_to_text, let, strip
from postmill.sources import boards, mail, posts

NOW = "2024-02-01 00:00:00"
HTML = "'<p>About ' || p_name || '</p><ul><li>' || p_type || ' &amp; more</li></ul>'"
TEXT = "'About ' || p_name || chr(10) || p_type || ' & more'"
XML = "'&lt;p&gt;About ' || p_name || '&lt;/p&gt;&lt;ul&gt;&lt;li&gt;' || p_type || ' &amp;amp; more&lt;/li&gt;&lt;/ul&gt;'"
KEY = "CAST(p_partkey AS STRING)"

# adapter -> (payload as Spark SQL, settings, expected columns as SQL)
BOARDS = {
    "greenhouse": (
        f"to_json(named_struct('jobs', array(named_struct('id', p_partkey, 'title', '  ' || p_name || '  x', 'absolute_url', 'https://g/' || {KEY}, 'location', named_struct('name', p_type), 'content', {HTML}))))",
        {}, ("p_name || ' x'", "'Acme'", "p_type", "'https://g/' || p_partkey", TEXT),
    ),
    "lever": (
        f"to_json(array(named_struct('id', {KEY}, 'text', p_name, 'hostedUrl', 'https://l/' || {KEY}, 'categories', named_struct('location', p_type), 'description', CASE WHEN p_size % 2 = 0 THEN {HTML} ELSE '' END, 'descriptionPlain', p_name)))",
        {}, ("p_name", "'Acme'", "p_type", "'https://l/' || p_partkey", f"CASE WHEN p_size % 2 = 0 THEN {TEXT} ELSE p_name END"),
    ),
    "pcsx": (
        f"to_json(named_struct('data', named_struct('positions', array(named_struct('jobId', {KEY}, 'name', p_name, 'positionUrl', '/job/' || {KEY}, 'locations', array(p_type, 'B'), 'discipline', p_brand)))))",
        {"team_filter": "BRAND#"}, ("p_name", "'Acme'", "p_type || ' | B'", "'https://apply.careers.microsoft.com/job/' || p_partkey", "''"),
    ),
    "apple_jobs": (
        f"""'<script>window.__staticRouterHydrationData = JSON.parse("' || replace(to_json(named_struct('loaderData', named_struct('search', named_struct('searchResults',
          array(named_struct('id', {KEY}, 'postingTitle', p_name, 'transformedPostingTitle', 'slug', 'locations', array(named_struct('name', p_type)))), 'totalRecords', 1)))), '"', '\\\\"') || '");</script>'""",
        {}, ("p_name", "'Acme'", "p_type", "'https://jobs.apple.com/en-us/details/' || p_partkey || '/slug'", "''"),
    ),
    "amazon_jobs": (
        f"to_json(named_struct('jobs', array(named_struct('id', {KEY}, 'title', p_name, 'normalized_location', '', 'location', p_type, 'job_path', '/en/' || {KEY}, 'description_short', {HTML}))))",
        {}, ("p_name", "'Acme'", "p_type", "'https://www.amazon.jobs/en/' || p_partkey", TEXT),
    ),
    "google_careers": (
        f"""'<a class="x" href="jobs/results/' || {KEY} || '-slug?page=1" x aria-label="Learn more about ' || p_name || ' &amp; co">y</a><a href="/about/careers/applications/jobs/results/' || {KEY} || '-again" aria-label="Learn more about twice">'""",
        {}, ("p_name || ' & co'", "'Acme'", "''", "'https://www.google.com/about/careers/applications/jobs/results/' || p_partkey || '-slug'", "''"),
    ),
    "remoteok": (
        f"""'[{{"legal":"x"}},' || to_json(named_struct('id', {KEY}, 'company', p_brand, 'position', p_name, 'location', '', 'url', 'https://r/' || {KEY}, 'description', {HTML})) || ']'""",
        {}, ("p_name", "p_brand", "'Remote'", "'https://r/' || p_partkey", TEXT),
    ),
    "weworkremotely": (
        f"'<rss><channel><item><title>' || p_name || ' at ' || p_brand || '</title><link>https://w/' || {KEY} || '</link><description>' || {XML} || '</description></item></channel></rss>'",
        {}, ("p_name", "p_brand", "'Remote'", "'https://w/' || p_partkey", TEXT),
    ),
    "shopify_careers": (
        f"'<jobs><job><partnerJobId>' || {KEY} || '</partnerJobId><title>' || p_name || '</title><location>' || p_type || '</location><applyUrl>https://s/' || {KEY} || '</applyUrl><description>' || {XML} || '</description></job><job><title> </title></job></jobs>'",
        {}, ("p_name", "'Acme'", "p_type", "'https://s/' || p_partkey", TEXT),
    ),
    "ashby": (
        f"to_json(named_struct('jobs', array(named_struct('id', {KEY}, 'title', p_name, 'location', named_struct('city', p_type), 'jobUrl', 'https://a/' || {KEY}, 'descriptionHtml', {HTML}, 'secondaryLocations', array(named_struct('locationName', p_brand)))))) ",
        {}, ("p_name", "'Acme'", "p_type || ' | ' || p_brand", "'https://a/' || p_partkey", TEXT),
    ),
    "cursor_careers": (
        f"""'<a class="k" href="/careers/' || {KEY} || '"><p> ' || p_name || ' </p><span>' || p_type || ';X</span><span>·</span><span>Apply →</span></a><a href="/careers">index</a>'""",
        {}, ("p_name", "'Acme'", "p_type || ' | X'", "'https://cursor.com/careers/' || p_partkey", "''"),
    ),
    "workday": (
        f"to_json(named_struct('jobPostings', array(named_struct('title', p_name, 'locationsText', p_type, 'externalPath', '/job/' || {KEY}, 'bulletFields', array({KEY}))), 'total', 1))",
        {"tenant": "t", "pod": "wd1", "site": "S"}, ("p_name", "'Acme'", "p_type", "'https://t.wd1.myworkdayjobs.com/S/job/' || p_partkey", "''"),
    ),
    "tiktok_careers": (
        f"""to_json(named_struct('data', named_struct('count', 1, 'job_post_list', array(named_struct('id', {KEY}, 'title', p_name, 'description', {HTML}, 'requirement', '<p>Need</p>',
          'city_info', CASE WHEN p_size % 2 = 0 THEN named_struct('en_name', p_type, 'parent', named_struct('en_name', 'WA')) END, 'city_list', array(named_struct('name', 'C1'), named_struct('name', p_brand)))))))""",
        {}, ("p_name", "'Acme'", "CASE WHEN p_size % 2 = 0 THEN p_type || ', WA' ELSE 'C1 | ' || p_brand END", "'https://lifeattiktok.com/search/' || p_partkey", TEXT + " || chr(10) || chr(10) || 'Need'"),
    ),
    "phenom": (
        f"to_json(named_struct('positions', array(named_struct('id', p_partkey, 'name', p_name, 'locations', array(p_type, ''), 'canonicalPositionUrl', 'https://p/' || {KEY} || '?microsite=x'))))",
        {}, ("p_name", "'Acme'", "p_type", "'https://p/' || p_partkey", "''"),
    ),
}


def board_sql(expected: tuple[str, ...]) -> str:
    title, company, location, url, text = expected
    return f"""SELECT {title} AS title, {company} AS company, {location} AS location, {url} AS external_jd_url,
      {text} AS jd_text, CAST(p_partkey AS VARCHAR) AS ats_job_id, substr(sha1({url}), 1, 16) AS job_key FROM part"""


def board_query(ats: str, payload: str, settings: dict):
    adapter, _ = boards.ADAPTERS[ats]

    def run(spark, sf):
        pages = spread_table(spark, sf, "part").select(F.expr(payload).alias("payload"), F.col("p_partkey").alias("page"))
        now = F.lit(NOW).cast("timestamp")
        return adapter(pages, "Acme", now, **settings).select(
            "title", "company", "location", "external_jd_url", "jd_text", "ats_job_id", "job_key"
        )

    return run


for _ats, (_payload, _settings, _expected) in BOARDS.items():
    query(f"board_{_ats}", board_sql(_expected))(board_query(_ats, _payload, _settings))


@query(
    "board_details",
    f"SELECT p_partkey, {TEXT} AS workday, {TEXT} AS phenom, {TEXT} AS plain FROM part",
)
def board_details(spark, sf):
    key = F.col("p_partkey").cast("string").alias("url")
    parts = spread_table(spark, sf, "part")

    def text(ats, payload):
        found = boards.detail_text(parts.select(key, F.expr(payload).alias("payload")), ats)
        return found.select(F.col("url").cast("bigint").alias("p_partkey"), F.col("jd_text").alias(ats))

    workday = text("workday", f"to_json(named_struct('jobPostingInfo', named_struct('jobDescription', {HTML})))")
    phenom = text("phenom", f"to_json(named_struct('job_description', {HTML}))")
    plain = text("workday", HTML).withColumnRenamed("workday", "plain")
    return workday.join(phenom, "p_partkey").join(plain, "p_partkey")


@query(
    "mail_cards",
    """
SELECT p_partkey AS ordinal, p_name AS title, p_brand AS company, p_type AS location, '$' || p_size || 'K/yr' AS salary,
  'https://jobright.ai/jobs/info/' || substr(sha1(CAST(p_partkey AS VARCHAR)), 1, 24) AS jobright_url,
  CAST(p_size AS INTEGER) AS jobright_match_pct, '2 hours ago' AS jobright_time_posted, '5+ referrals' AS jobright_referrals,
  substr(sha1('https://jobright.ai/jobs/info/' || substr(sha1(CAST(p_partkey AS VARCHAR)), 1, 24)), 1, 16) AS job_key
FROM part""",
)
def mail_cards(spark, sf):
    """One mail per part: its card twice, a 'view more' card, and a card without a link."""
    key = F.substring(F.sha1(F.col("p_partkey").cast("string")), 1, 24)
    card = F.concat(
        F.lit('<td id="job-section"><p id="job-company-name" class="c">'), "p_brand",
        F.lit('</p><span id="job-match-percentage">'), F.col("p_size").cast("string"),
        F.lit('%</span><div id="job-title"><a class="t" href="https://jobright.ai/jobs/info/'), key,
        F.lit('?utm=1&amp;x=2">'), "p_name", F.lit('</a></div><span id="job-tag">$'), F.col("p_size").cast("string"),
        F.lit('K/yr</span><span id="job-tag">5+ referrals</span><span id="job-tag">'), "p_type",
        F.lit('</span><p id="job-time-posted">2 hours ago · </p></td>'),
    )
    more = F.lit('<td id="job-section"><div id="job-title"><a href="https://jobright.ai/x">View More Opportunities</a></div></td>')
    messages = spread_table(spark, sf, "part").select(
        F.col("p_partkey").alias("ordinal"), F.lit("Jobright <no-reply@jobright.ai>").alias("sender"),
        F.lit("New jobs").alias("subject"), F.lit("d").alias("date"), F.lit("m").alias("message_id"), F.lit("").alias("text"),
        F.concat(F.lit("<html>"), card, card, more, F.lit('<td id="job-section"><p>none</p></td></html>')).alias("html"),
    )
    jobs = mail.finalize(mail.alert_jobs(messages), F.lit(NOW).cast("timestamp"))
    return jobs.select(
        "ordinal", "title", "company", "location", "salary", "jobright_url", "jobright_match_pct", "jobright_time_posted",
        "jobright_referrals", "job_key",
    )


@query(
    "mail_links",
    """
SELECT p_partkey AS ordinal, p_name || ' Engineer' AS title, p_brand AS company, p_type AS location, '' AS modality,
  'https://www.linkedin.com/comm/jobs/view/1' || p_partkey || '/?trk=x' AS linkedin_url FROM part
UNION ALL SELECT p_partkey, p_name || ' Engineer', 'Second ' || p_brand, p_type, '', 'https://www.linkedin.com/comm/jobs/view/2' || p_partkey || '/?trk=x' FROM part
UNION ALL SELECT p_partkey, p_name || ' Lead', 'Stripe', p_type, 'hybrid', 'https://www.linkedin.com/comm/jobs/view/3' || p_partkey || '/?trk=x' FROM part""",
)
def mail_links(spark, sf):
    """One mail per part: two equal titles with different cards, a compound title, a repeated link, a footer."""
    key = F.col("p_partkey").cast("string")

    def anchor(lead, text):
        return F.concat(
            F.lit(f'<a href="https://www.linkedin.com/comm/jobs/view/{lead}'), key, F.lit('/?trk=x">'), text, F.lit("</a>")
        )

    title = F.concat("p_name", F.lit(" Engineer"))
    html = F.concat(
        F.lit("<html><body><p>Your job alert</p>"), anchor(1, title), F.lit("<p>"), "p_brand", F.lit(" · "), "p_type",
        F.lit("</p>"), anchor(2, title), F.lit("<p>Second "), "p_brand", F.lit(" · "), "p_type", F.lit("</p>"),
        anchor(1, F.lit("View job")),
        anchor(3, F.concat("p_name", F.lit(" Lead Stripe · "), "p_type", F.lit(" (Hybrid)"))),
        F.lit('<a href="https://www.linkedin.com/comm/jobs/search?keywords=x">See all jobs</a></body></html>'),
    )
    messages = spread_table(spark, sf, "part").select(
        F.col("p_partkey").alias("ordinal"), F.lit("jobs-noreply@linkedin.com").alias("sender"), F.lit("Job alert").alias("subject"),
        F.lit("d").alias("date"), F.lit("m").alias("message_id"), F.lit("").alias("text"), html.alias("html"),
    )
    return mail.alert_jobs(messages).select("ordinal", "title", "company", "location", "modality", "linkedin_url")


@query(
    "mail_sources",
    """
SELECT CASE p_size % 3 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'jobright' ELSE 'unknown' END AS source, count(*) AS messages
FROM part GROUP BY 1""",
)
def mail_sources(spark, sf):
    from postmill.operators.reports import source_counts

    sender = F.when(F.col("p_size") % 3 == 0, "LinkedIn <x@y>").when(F.col("p_size") % 3 == 1, "a@JobRight.ai").otherwise("z@q")
    return source_counts(table(spark, sf, "part").withColumn("sender", sender), mail.mail_source("sender"))


@query(
    "search_feed",
    f"SELECT p_partkey, 'https://f/' || p_partkey AS url, p_name AS title, p_type AS description FROM part",
)
def search_feed(spark, sf):
    feed = F.expr(f"'<rss><channel><item><title> ' || p_name || '</title><link>https://f/' || {KEY} || '</link><description>' || p_type || '</description></item><item><title>none</title></item></channel></rss>'")
    pages = spread_table(spark, sf, "part").select(feed.alias("payload"), F.col("p_partkey").alias("page"))
    return boards.search_results(pages).select(F.col("page").alias("p_partkey"), "url", "title", "description")


REDDIT = """
SELECT doc_id, 't3_' || doc_id AS source_id, source AS title, text AS body, 'https://www.reddit.com/r/' || lang || '/' || doc_id AS url,
  CAST(n_chars AS INTEGER) AS reply_count, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS posted_at
FROM documents WHERE lang <> 'de'"""


def reddit_pages(spark, sf):
    child = F.struct(
        F.struct(
            (F.col("lang") != "de").alias("is_self"), F.col("text").alias("selftext"), F.col("source").alias("title"),
            F.concat(F.lit("t3_"), F.col("doc_id").cast("string")).alias("name"), (F.col("doc_id") + 1704067200).cast("double").alias("created_utc"),
            F.concat(F.lit("/r/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("permalink"),
            F.col("n_chars").alias("num_comments"),
        ).alias("data")
    )
    page = F.to_json(F.struct(F.struct(F.array(child).alias("children")).alias("data")))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("page"), page.alias("payload"))


@query("reddit_posts", REDDIT)
def reddit_posts(spark, sf):
    found = posts.reddit_posts(reddit_pages(spark, sf), F.lit("Acme"), F.lit(NOW).cast("timestamp"))
    return found.select(
        F.col("page").alias("doc_id"), "source_id", "title", "body", "url", "reply_count",
        F.col("posted_at").cast("timestamp_ntz").alias("posted_at"),
    )


@query(
    "post_limits",
    f"""
WITH r AS ({REDDIT}), n AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS place FROM r WHERE posted_at >= TIMESTAMP '2024-01-01 00:00:30')
SELECT doc_id, title AS company, source_id FROM n WHERE place <= 3""",
)
def post_limits(spark, sf):
    found = posts.reddit_posts(reddit_pages(spark, sf), F.lit("Acme"), F.lit(NOW).cast("timestamp")).withColumn("company", F.col("title"))
    cutoff = F.lit("2024-01-01 00:00:30").cast("timestamp_ntz")
    naive = found.withColumn("posted_at", F.col("posted_at").cast("timestamp_ntz"))
    kept = posts.within_limits(naive, ["page", "at"], cutoff, 3)
    return kept.select(F.col("page").alias("doc_id"), "company", "source_id")


@query(
    "discussion_posts",
    """
SELECT page_id, CAST(page_id AS VARCHAR) AS source_id, 'Title ' || page_id AS title, 'one' || chr(10) || 'two & <three>' AS body,
  CAST(page_id % 50 AS INTEGER) AS reply_count, TIMESTAMP '2024-01-02 03:04:05' AS posted_at, '/discuss/1/a|/discuss/2/b' AS links
FROM pages""",
)
def discussion_posts(spark, sf):
    ident = F.col("page_id").cast("string")
    html = F.concat(
        F.lit("<h1 class='t'> Title "), ident,
        F.lit('</h1><time datetime="2024-01-02T03:04:05Z"></time><div class="x discuss-markdown-container y">one<br/>two &amp; &lt;three&gt;</div> <p>'),
        (F.col("page_id") % 50).cast("string"), F.lit(' comments</p><a href="/discuss/1/a"></a><a href="/discuss/2/b"></a><a href="/discuss/1/a"></a>'), "html",
    )
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("page"), F.concat(F.lit("https://leetcode.com/discuss/"), ident, F.lit("/slug")).alias("url"),
        html.alias("payload"), F.lit("").alias("visible_text"),
    )
    found = posts.leetcode_posts(pages, F.lit("Acme"), F.lit(NOW).cast("timestamp"))
    links = pages.select("page", F.array_join(posts.discussion_links("payload"), "|").alias("links"))
    return found.join(links, "page").select(
        F.col("page").alias("page_id"), "source_id", "title", "body", "reply_count",
        F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "links",
    )


@query(
    "note_file_posts",
    """
SELECT doc_id, CASE WHEN lang = 'en' THEN 'T ' || source ELSE 'note' || doc_id END AS title,
  regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS body,
  CASE WHEN lang = 'en' THEN 'https://g/' || doc_id ELSE 'file:///d/note' || doc_id || '.md' END AS url,
  CASE WHEN lang = 'en' THEN TIMESTAMP '2026-05-10 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS posted_at
FROM documents""",
)
def note_file_posts(spark, sf):
    ident = F.col("doc_id").cast("string")
    block = F.concat(F.lit("---\nurl: https://g/"), ident, F.lit("\nposted_at: 2026-05-10\ntitle: T "), "source", F.lit("\n---\n"))
    now = F.lit(NOW).cast("timestamp")
    files = table(spark, sf, "documents").select(
        F.concat(F.lit("/d/note"), ident, F.lit(".md")).alias("path"),
        F.when(F.col("lang") == "en", F.concat(block, "text")).otherwise(F.col("text")).alias("value"), now.alias("modified_at"),
    )
    found = posts.file_posts(files, F.lit("Acme"), now)
    return found.select(
        F.regexp_extract("path", r"note(\d+)", 1).cast("bigint").alias("doc_id"), "title", "body", "url",
        F.col("posted_at").cast("timestamp_ntz").alias("posted_at"),
    )


THREAD_TEXT = "translate(coalesce(text, ''), '<>&', '()+')"
THREAD_REPLIES = "CAST(doc_id % 5 AS INTEGER)"


@query(
    "thread_pages",
    f"""
WITH d AS (SELECT *, array_to_string(list_filter(list_transform(string_split({THREAD_TEXT}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> ''), chr(10))
    || CASE WHEN doc_id % 6 = 0 THEN CASE WHEN regexp_matches({THREAD_TEXT}, '\\S') THEN chr(10) ELSE '' END || '本帖隐藏的内容需要回复' ELSE '' END AS op_body FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Tab ' || doc_id ELSE 'T' || doc_id END AS title, CASE doc_id % 4 WHEN 0 THEN 'user' || doc_id WHEN 1 THEN 'plain ' || lang ELSE 'guest' END AS author,
  CASE doc_id % 3 WHEN 0 THEN '2026-04-15 23:24' WHEN 1 THEN '2026-4-5 3:24:09' ELSE '发表于 昨天' END AS posted_at, op_body, {THREAD_REPLIES} AS reply_count,
  op_body || array_to_string(list_transform(range(1, 1 + {THREAD_REPLIES}), lambda i: chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'reply ' || i || chr(10) || 'nested ' || doc_id), '') AS body,
  doc_id % 6 = 0 AS locked
FROM d""",
)
def thread_pages(spark, sf):
    """Documents as threads: their lines as the first post, nested tables in replies, empty posts, heads in several forms."""
    page = F.expr(f"""
CASE WHEN doc_id % 3 = 0 THEN concat('<title> Tab ', doc_id, '</title>') ELSE concat('<title>no</title><h1 class="ts">[tag] T', doc_id, '</h1>') END ||
CASE doc_id % 4 WHEN 0 THEN concat('<div class="authi"><a href="space-uid-7.html">user', doc_id, '</a> 2026-01-01</div>')
  WHEN 1 THEN concat('<div class="x authi"><i>plain ', lang, '</i> 2026-1-1 10:00</div>') ELSE '<div class="authi">guest 发表于 x</div>' END ||
CASE doc_id % 3 WHEN 0 THEN '<em id="authorposton1">发表于 2026-04-15 23:24</em>' WHEN 1 THEN '<em id="authorposton2">2026-4-5 3:24:09</em>' ELSE '<em id="authorposton3">发表于 <span>昨天</span></em>' END ||
'<table><tr><td class="t_f" id="postmessage_1">' || replace({THREAD_TEXT}, chr(10), '<br>') || CASE WHEN doc_id % 6 = 0 THEN '<br><b>本帖隐藏的内容需要回复</b>' ELSE '' END || '<script>x</script></td></tr></table>' ||
array_join(transform(filter(sequence(0, {THREAD_REPLIES}), i -> i > 0), i ->
  concat('<td id="postmessage_', i + 1, '">reply ', i, '<table><tr><td>nested ', doc_id, '</td></tr></table></td>')), '') || '<td id="postmessage_99"> <br> </td><td>no post</td>'""")
    pages = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("tid"), page.alias("payload"))
    return posts.thread_fields(pages).select(
        F.col("tid").cast("bigint").alias("doc_id"), "title", "author", "posted_at", "op_body", "reply_count", "body", "locked"
    )


@query(
    "thread_listings",
    """
SELECT CAST(doc_id AS VARCHAR) AS tid, 'Listed ' || doc_id || ' ' || source AS title, CASE doc_id % 3 WHEN 0 THEN lang || '|y' WHEN 1 THEN 'y' ELSE '' END AS tags,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE '2024-01-0' || (doc_id % 9 + 1) END AS posted_at FROM documents""",
)
def thread_listings(spark, sf):
    """Documents on a company's listing, one a page: dates before anchors or none, tags that do not count, ids listed again later."""
    page = F.expr("""
CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('<time title="2023-01-01">old</time><time title="2024-01-0', doc_id % 9 + 1, '">d</time>') END ||
concat('<a href="https://www.1point3acres.com/bbs/thread-', doc_id, '-1-1.html"><img></a><a class="c" href="https://www.1point3acres.com/bbs/thread-', doc_id, '-1-1.html?x"><div class="flex-1 x">Listed <b>', doc_id, '</b> ',
  source, '</div><div class="text-primary">', CASE doc_id % 3 WHEN 0 THEN concat('<span> ', lang, ' </span><span>y</span>')
  WHEN 1 THEN '<span>y</span><span>a tag that is longer than thirty letters</span>' ELSE '<span> </span>' END, '</div></a>') ||
concat('<time title="2025-01-01">n</time><a href="https://www.1point3acres.com/bbs/thread-', doc_id, '-1-1.html"><div class="flex-1">again</div></a>')""")
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), page.alias("payload"))
    return posts.thread_listings(pages).select("tid", "title", F.array_join("tags", "|").alias("tags"), "posted_at")


@query(
    "ranked_questions",
    """
SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS rank, CAST(p_partkey AS INTEGER) AS lc_number, p_name AS title,
  'p-' || p_partkey AS title_slug, CASE p_size % 3 WHEN 0 THEN 'Medium' WHEN 1 THEN 'Hard' ELSE 'Unknown' END AS difficulty,
  p_size + 0.5::DOUBLE AS acceptance
FROM part""",
)
def ranked_questions(spark, sf):
    key = F.col("p_partkey").cast("string")
    label = F.when(F.col("p_size") % 3 == 0, "Med.").when(F.col("p_size") % 3 == 1, "Hard").otherwise("")
    cells = F.concat(key, F.lit(". "), "p_name", F.lit("\n"), F.col("p_size").cast("string"), F.lit(".5%\n\n"), label)
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("at"), F.concat(F.lit("/problems/p-"), key, F.lit("?envType=company")).alias("href"), cells.alias("cells")
    )
    return posts.ranked_questions(rows).select("rank", "lc_number", "title", "title_slug", "difficulty", "acceptance")


SAFE_TEXT = "translate(coalesce(text, ''), '<>', '()')"
STATEMENT = f"'<div><div>' || doc_id || '</div><DIV class=\"x\">' || {SAFE_TEXT} || '</DIV></div><p>end'"


@query(
    "question_details",
    f"""
SELECT 'https://q/' || doc_id AS url,
  CASE doc_id % 3 WHEN 0 THEN doc_id || '. Q & A' WHEN 1 THEN 'Head ' || doc_id ELSE 'Tab ' || doc_id END AS heading,
  CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Easy' ELSE 'Hard' END AS difficulty,
  CASE WHEN doc_id % 2 = 0 THEN 'Array|' || lang ELSE '' END AS tags, CASE WHEN doc_id % 5 = 4 THEN '' ELSE {STATEMENT} END AS statement_html
FROM documents""",
)
def question_details(spark, sf):
    """Documents as question pages: three kinds of heading, three containers of the statement or none, nested elements."""
    page = F.expr(f"""
'<html><title>Tab ' || doc_id || '</title>' ||
CASE doc_id % 3 WHEN 0 THEN '<h1>no</h1><a class="t" href="/problems/q-' || doc_id || '/"><b>' || doc_id || '. Q &amp;</b> A</a>' WHEN 1 THEN '<h1 id="h">Head ' || doc_id || '</h1>' ELSE '<h1> </h1>' END ||
CASE doc_id % 4 WHEN 0 THEN '<div class="text-other">no</div>' WHEN 1 THEN '<div class="a text-difficulty-easy"><div>Easy</div></div>' ELSE '<div class="text-difficulty-hard"> Hard</div>' END ||
CASE WHEN doc_id % 2 = 0 THEN '<a href="/tag/array/">Array</a><a href="/tag/none"> </a><a href="/tag/x"><i>' || lang || '</i></a>' ELSE '<a href="/tags/y">y</a>' END ||
CASE doc_id % 5 WHEN 0 THEN '<div class="elfjS">no</div><div data-track-load="description_content">' WHEN 1 THEN '<div class="css-pre">no</div><div class="a elfjS">'
  WHEN 2 THEN '<section class="question-content__JfgR b">' WHEN 3 THEN '<div class="content__u3I1">' ELSE '<div class="elfjSx">' END || {STATEMENT} ||
CASE doc_id % 5 WHEN 2 THEN '</section><div>after</div>' WHEN 3 THEN '' ELSE '</div><div>after</div></div>' END""")
    pages = table(spark, sf, "documents").select(F.concat(F.lit("https://q/"), F.col("doc_id").cast("string")).alias("url"), page.alias("payload"))
    return posts.question_details(pages).select("url", "heading", "difficulty", F.array_join("tags", "|").alias("tags"), "statement_html")


@query(
    "embedded_postings",
    """
SELECT p_partkey, p_name AS title, p_brand AS company, p_type || ', WA, US' AS location, 'About ' || p_name AS jd_text, 'jsonld_jobposting' AS parser
FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey, 'Page ' || p_name, '', '', 'Page ' || p_name || chr(10) || 'Body ' || p_type, 'html_fallback' FROM part WHERE p_size % 2 <> 0""",
)
def embedded_postings(spark, sf):
    from postmill.functions.payload import description, json_ld_posting

    node = F.expr(
        """to_json(named_struct('@graph', array(named_struct('y', named_struct('type', 'JobPosting', 'title', ' ' || p_name,
           'description', '<p>About ' || p_name || '</p>', 'hiringOrganization', named_struct('name', p_brand),
           'jobLocation', array(named_struct('address', named_struct('addressLocality', p_type, 'addressRegion', 'WA', 'addressCountry', named_struct('code', 'US')))))))))"""
    )
    page = F.concat(
        F.lit("<html><title>Page "), "p_name", F.lit("</title>"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<script type='application/ld+json'>broken</script><script type=\"application/ld+json\">"), node, F.lit("</script>"))).otherwise(""),
        F.lit("<p>Body "), "p_type", F.lit("</p><p>Sign in</p><p>x</p>"),
    )
    found = spread_table(spark, sf, "part").select("p_partkey", page.alias("html"))
    read = found.select("p_partkey", description("html", json_ld_posting("html")).alias("d"))
    return read.select("p_partkey", "d.title", "d.company", "d.location", F.col("d.text").alias("jd_text"), "d.parser")


@query(
    "detail_pages",
    """
SELECT p_partkey, p_name AS title, p_type || ', WA' AS location, repeat(p_name || ' ', 20) || 'end' AS jd_text, CAST(p_size AS BIGINT) AS jd_salary_min,
  CAST(p_size * 2 AS BIGINT) AS jd_salary_max FROM part""",
)
def detail_pages(spark, sf):
    from postmill.functions.payload import detail_posting, detail_text

    page = F.expr(
        """'<script type="application/ld+json">' || to_json(named_struct('@type', 'JobPosting', 'title', p_name, 'description', '<p>' || repeat(p_name || '<br>  ', 20) || 'end</p>',
           'jobLocation', named_struct('address', named_struct('addressLocality', p_type, 'addressRegion', 'WA')),
           'baseSalary', named_struct('value', named_struct('minValue', p_size, 'maxValue', p_size * 2)))) || '</script>'"""
    )
    read = let(detail_posting(page), lambda d: F.struct(d.alias("d"), detail_text(d).alias("text")))
    # A filter would be moved below the shuffle, and all the reading with it; rows of an array are not.
    kept = F.filter(F.array(read), lambda r: (r["d"]["@type"] == "JobPosting") & (F.length(r["text"]) >= 100))
    rows = spread_table(spark, sf, "part").select("p_partkey", F.explode(kept).alias("r")).select("p_partkey", "r.d", "r.text")
    place = F.concat_ws(", ", F.nullif("d.jobLocation.address.addressLocality", F.lit("")), F.nullif("d.jobLocation.address.addressRegion", F.lit("")))
    return rows.select(
        "p_partkey", "d.title", place.alias("location"), F.col("text").alias("jd_text"),
        F.col("d.baseSalary.value.minValue").alias("jd_salary_min"), F.col("d.baseSalary.value.maxValue").alias("jd_salary_max"),
    )
