"""Title scores, scored lookup and candidate ranking."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill import fixed_values as fixed
from postmill.catalog.registry import query, spread_table, table
from postmill.catalog.texts import sql_collapse, sql_page_text
from postmill.functions import text as t
from postmill.functions import titles as ti
from postmill.functions import urls as u
from postmill.operators import matching as m

JOB_TITLE = """p_name || CASE p_size % 4 WHEN 0 THEN ' SWE' WHEN 1 THEN ' Engineering Manager'
  WHEN 2 THEN ' ML & Fullstack' ELSE '' END"""
JOB_PLACE = "p_type || ' zone' || (p_size % 5)"
OPEN_TITLE = """p_name || CASE p_size % 3 WHEN 0 THEN ' Engineer' WHEN 1 THEN ' Senior Software Engineer, ML'
  ELSE '' END"""
OPEN_PLACE = "CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'Remote zone' || (p_size % 5) END"
GENERIC = ", ".join(f"'{w}'" for w in fixed.GENERIC_ROLE_TOKENS)


def sql_title_norm(value: str) -> str:
    spaced = f"trim(regexp_replace(replace(replace(lower({value}), '&', ' and '), 'fullstack', 'full stack'), '[^a-z0-9]+', ' ', 'g'))"
    return f"regexp_replace(regexp_replace({spaced}, '\\bswe\\b', 'software engineer', 'g'), '\\bsde\\b', 'software development engineer', 'g')"


def sql_location_norm(value: str) -> str:
    words = f"string_split({sql_title_norm(value)}, ' ')"
    return f"array_to_string(list_sort(list_distinct([x FOR x IN {words} IF length(x) >= 3 OR regexp_matches(x, '^[0-9]+$')])), ' ')"


def sql_title_score(a: str, b: str) -> str:
    """Score of two normalised titles; `a` and `b` are column names."""
    ta, tb = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    shared = f"list_distinct(list_intersect({ta}, {tb}))"
    meaningful = f"len([x FOR x IN {shared} IF x NOT IN ({GENERIC})])"

    def has(word: str) -> str:
        return f"list_contains({shared}, '{word}')"

    def differs(word: str) -> str:
        return f"(list_contains({ta}, '{word}') <> list_contains({tb}, '{word}'))"

    return f"""(CASE WHEN {a} = {b} THEN 20 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 10 ELSE 0 END
      + {meaningful} * 4 + (len({shared}) - {meaningful})
      + CASE WHEN {meaningful} > 0 AND len({shared}) >= 3 THEN 4 ELSE 0 END
      + CASE WHEN {has('software')} AND {has('engineer')} THEN 3 ELSE 0 END
      + CASE WHEN {has('full')} AND {has('stack')} THEN 2 ELSE 0 END
      + CASE WHEN {has('ml')} THEN 2 ELSE 0 END
      - CASE WHEN {differs('manager')} THEN 3 ELSE 0 END - CASE WHEN {differs('engineer')} THEN 2 ELSE 0 END)"""


def sql_location_score(a: str, b: str) -> str:
    return f"""(CASE WHEN {a} = '' OR {b} = '' THEN 0
      WHEN len(list_intersect(string_split({a}, ' '), string_split({b}, ' '))) = 0 THEN 0
      WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 4 ELSE 2 END)"""


MATCH_CTE = f"""
WITH jobs AS (SELECT p_partkey AS job_id, p_brand AS board, {sql_title_norm(JOB_TITLE)} AS jt,
    {sql_location_norm(JOB_PLACE)} AS jl FROM part),
openings AS (SELECT row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ordinal, p_brand AS board, {sql_title_norm(OPEN_TITLE)} AS ot,
    {sql_location_norm(OPEN_PLACE)} AS ol, {OPEN_PLACE} AS place, p_partkey AS part, p_size * 20 AS chars, {OPEN_TITLE} AS opening_title FROM part),
job_titles AS (SELECT DISTINCT board, jt FROM jobs), open_titles AS (SELECT DISTINCT board, ot FROM openings),
title_pairs AS (SELECT board, jt, ot, {sql_title_score('jt', 'ot')} AS ts FROM job_titles JOIN open_titles USING (board)),
place_pairs AS (SELECT jl, ol, {sql_location_score('jl', 'ol')} AS ls
  FROM (SELECT DISTINCT jl FROM jobs) CROSS JOIN (SELECT DISTINCT ol FROM openings)),
scored AS (SELECT j.job_id, j.jl, o.ol, o.ordinal, o.place, o.part, o.chars, o.opening_title, ts + ls AS match_score
  FROM jobs j JOIN title_pairs t ON j.board = t.board AND j.jt = t.jt
  JOIN openings o ON o.board = t.board AND o.ot = t.ot
  JOIN place_pairs p ON p.jl = j.jl AND p.ol = o.ol),
best AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY match_score DESC, ordinal) AS rn FROM scored)
"""


def boards(spark, sf):
    """Jobs and openings of each brand as a board; every board numbers its openings from 0."""
    parts = spread_table(spark, sf, "part")
    jobs = parts.select(
        F.col("p_partkey").alias("job_id"), F.col("p_brand").alias("board"),
        F.expr(JOB_TITLE).alias("title"), F.expr(JOB_PLACE).alias("location"),
    )
    openings = parts.select(
        F.col("p_brand").alias("board"), F.col("p_partkey").alias("part"),
        (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).cast("bigint").alias("ordinal"),
        F.expr(OPEN_TITLE).alias("title"), F.expr(OPEN_PLACE).alias("location"),
        F.expr("repeat('d', p_size * 20)").alias("description"),
    )
    return jobs, openings


@query(
    "best_match",
    MATCH_CTE + "SELECT job_id, ordinal AS opening, CAST(match_score AS INTEGER) AS match_score FROM best WHERE rn = 1 AND match_score >= 8",
)
def best_match(spark, sf):
    return m.best_openings(*boards(spark, sf)).drop("board")


@query(
    "best_match_gated",
    MATCH_CTE
    + """SELECT b.job_id, b.ordinal AS opening, CAST(b.match_score AS INTEGER) AS match_score FROM best b
  JOIN place_pairs l ON l.jl = b.jl AND l.ol = b.ol
  WHERE rn = 1 AND match_score >= 8 AND (ls > 0 OR contains(lower(place), 'remote')) AND chars >= 200""",
)
def best_match_gated(spark, sf):
    return m.gated_matches(*boards(spark, sf)).select("job_id", "opening", "match_score")


@query(
    "title_scores",
    f"""
WITH n AS (SELECT p_partkey, {sql_title_norm(JOB_TITLE)} AS jt, {sql_location_norm(JOB_PLACE)} AS jl,
   {sql_title_norm(OPEN_TITLE)} AS ot, {sql_location_norm(OPEN_PLACE)} AS ol FROM part),
pairs AS (SELECT a.p_partkey, a.jt, a.jl, b.ot, b.ol FROM n a JOIN n b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, jt, ot, CAST({sql_title_score('jt', 'ot')} AS INTEGER) AS title_score,
  CAST({sql_location_score('jl', 'ol')} AS INTEGER) AS location_score FROM pairs""",
)
def title_scores(spark, sf):
    named = table(spark, sf, "part").select(
        "p_partkey", ti.title_norm(F.expr(JOB_TITLE)).alias("jt"), ti.location_norm(F.expr(JOB_PLACE)).alias("jl"),
        ti.title_norm(F.expr(OPEN_TITLE)).alias("ot"), ti.location_norm(F.expr(OPEN_PLACE)).alias("ol"),
    )
    following = named.select((F.col("p_partkey") - 1).alias("p_partkey"), "ot", "ol")
    return (
        named.select("p_partkey", "jt", "jl")
        .join(following, "p_partkey")
        .select(
            "p_partkey", "jt", "ot", ti.title_score(F.col("jt"), F.col("ot")).alias("title_score"),
            ti.location_score(F.col("jl"), F.col("ol")).alias("location_score"),
        )
    )


@query(
    "token_overlap",
    f"""
WITH n AS (SELECT conv_id, turn, list_distinct([x FOR x IN string_split({sql_title_norm('text')}, ' ') IF x <> '']) AS words FROM conversations),
pairs AS (SELECT a.conv_id, a.turn, a.words AS mine, b.words AS theirs FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CAST(len(list_intersect(mine, theirs)) AS INTEGER) AS shared,
  CAST(len([x FOR x IN mine IF NOT list_contains(theirs, x)]) AS INTEGER) AS only_mine,
  len([x FOR x IN mine IF NOT list_contains(theirs, x)]) = 0 AS subset,
  array_to_string(list_concat(mine, [x FOR x IN theirs IF NOT list_contains(mine, x)]), ' ') AS tags
FROM (SELECT conv_id, turn, [x FOR x IN mine IF length(x) > 3] AS mine, [x FOR x IN theirs IF length(x) > 3] AS theirs FROM (
   SELECT conv_id, turn, list_sort(mine) AS mine, list_sort(theirs) AS theirs FROM pairs))""",
)
def token_overlap(spark, sf):
    words = F.array_sort(F.array_distinct(F.filter(ti.title_tokens("text"), lambda w: F.length(w) > 3)))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", words.alias("mine"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("mine").alias("theirs"))
    extra = F.array_except("mine", "theirs")
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.size(F.array_intersect("mine", "theirs")).alias("shared"),
        F.size(extra).alias("only_mine"), (F.size(extra) == 0).alias("subset"),
        F.array_join(F.array_union("mine", "theirs"), " ").alias("tags"),
    )


JOBS = {
    "com": ("The Jobs Page", "Example Com"),
    "net": ("Reine Erth Staff", "Thth Group"),
    "org": ("That With The", "Example Labs, Inc"),
}
ALLOWED = ("example.com", "example.org")
TLD = r"\.([a-z]+)(?:[:/?#]|$)"


def hits(spark, sf):
    """Each page is a hit for the job named by its host's last label."""
    label = F.regexp_extract(u.host_of("url"), r"\.([a-z]+)$", 1)
    title, company = F.lit(""), F.lit("")
    for name, (job, owner) in JOBS.items():
        title, company = F.when(label == name, job).otherwise(title), F.when(label == name, owner).otherwise(company)
    return table(spark, sf, "pages").select(
        label.alias("job_id"), "url", F.col("page_id").alias("ordinal"), title.alias("title"),
        company.alias("company"), t.page_title("html").alias("page"), t.html_to_text("html", ended=True).alias("body"), "html",
    )


def sql_case(values: dict[str, str]) -> str:
    return "CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE 0 END"


def sql_count(words, *fields: str) -> str:
    return "(" + " + ".join(
        "CASE WHEN " + " OR ".join(f"contains({f}, '{w}')" for f in fields) + " THEN 1 ELSE 0 END" for w in words
    ) + ")"


SCORED = f"""
WITH p AS (SELECT page_id, url, html, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host,
    {sql_collapse("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')")} AS page,
    {sql_page_text('html')} AS body FROM pages),
l AS (SELECT *, regexp_extract(host, '\\.([a-z]+)$', 1) AS label, host || ' ' || lower(url) AS place,
    lower(page) || ' ' || lower({sql_collapse('body')}) AS txt, lower(url) AS lurl FROM p),
r AS (SELECT *, {sql_case({'com': sql_count(('jobs', 'page'), 'txt'), 'net': sql_count(('reine', 'erth', 'staff'), 'txt'), 'org': sql_count(('that', 'with'), 'txt')})} AS roles,
   {sql_case({'com': sql_count(('example', 'com'), 'txt', 'place'), 'net': sql_count(('thth', 'group'), 'txt', 'place'), 'org': sql_count(('example', 'labs', 'inc'), 'txt', 'place')})} AS names,
   {sql_case({'com': "CASE WHEN contains(txt, 'the jobs page') THEN 6 ELSE 0 END", 'net': "CASE WHEN contains(txt, 'reine erth staff') THEN 6 ELSE 0 END", 'org': "CASE WHEN contains(txt, 'that with the') THEN 6 ELSE 0 END"})} AS whole
  FROM l),
s AS (SELECT *, CASE WHEN ends_with(host, 'example.com') OR ends_with(host, 'example.org') THEN 6 ELSE 0 END
  + CASE WHEN regexp_matches(place, '{"|".join(fixed.JOB_HOST_HINTS)}') THEN 4 ELSE 0 END
  + CASE WHEN names > 0 THEN 4 ELSE 0 END
  + CASE WHEN roles >= 2 THEN 4 WHEN roles = 1 THEN 2 ELSE 0 END + whole
  + CASE WHEN regexp_matches(txt, 'job|career|opening') THEN 1 ELSE 0 END AS score FROM r)
"""


@query(
    "candidate_rank",
    SCORED
    + """, b AS (SELECT label, url, max(score) AS score FROM s WHERE score >= 6 GROUP BY label, url)
SELECT job_id, url, score, place FROM (SELECT label AS job_id, url, CAST(score AS INTEGER) AS score,
  CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, url) AS INTEGER) AS place FROM b) WHERE place <= 8""",
)
def candidate_rank(spark, sf):
    score = ti.candidate_score(F.col("title"), F.col("company"), F.col("url"), F.col("page"), F.col("body"), ALLOWED)
    scored = hits(spark, sf).select("job_id", "url", "ordinal", score.alias("score"))
    return m.rank_candidates(scored).select("job_id", "url", "score", "place")


@query(
    "job_page_check",
    SCORED
    + f"""SELECT page_id, NOT regexp_matches(lurl, '{"|".join(h.replace(".", "[.]") for h in fixed.BAD_PAGE_HINTS)}')
  AND NOT regexp_matches(lower(page), '{"|".join(fixed.BAD_TITLE_HINTS)}')
  AND length({sql_collapse('body')}) >= 500 AND
  (CASE WHEN ends_with(host, 'example.com') OR ends_with(host, 'example.org') OR regexp_matches(lurl, '{"|".join(fixed.JOB_HOST_HINTS)}') THEN 1 ELSE 0 END
   + CASE WHEN {sql_case({'com': sql_count(('example', 'com'), 'seen'), 'net': sql_count(('thth', 'group'), 'seen'), 'org': sql_count(('example', 'labs', 'inc'), 'seen')})} >= 1 THEN 1 ELSE 0 END
   + CASE WHEN {sql_case({'com': sql_count(('jobs', 'page'), 'head'), 'net': sql_count(('reine', 'erth', 'staff'), 'head'), 'org': sql_count(('that', 'with'), 'head')})} >= 2 THEN 1 ELSE 0 END
   + CASE WHEN {sql_count([h.replace("'", "''") for h in fixed.JOB_TEXT_HINTS], 'top')} >= 2 THEN 1 ELSE 0 END) >= 3 AS is_job_page
FROM (SELECT *, substr(lower({sql_collapse('body')}), 1, 6000) AS top,
        lower(page) || ' ' || substr(lower({sql_collapse('body')}), 1, 3000) AS head,
        lower(page) || ' ' || substr(lower({sql_collapse('body')}), 1, 3000) || ' ' || lurl AS seen FROM s)""",
)
def job_page_check(spark, sf):
    return hits(spark, sf).select(
        F.col("ordinal").alias("page_id"),
        ti.looks_like_job_page(
            F.col("title"), F.col("company"), F.col("url"), F.col("html"), F.col("body"), F.col("page"),
            F.lit("html_fallback"), ALLOWED,
        ).alias("is_job_page"),
    )


@query(
    "search_phrases",
    """
WITH t AS (SELECT p_partkey, '"' || p_name || '" "' || p_brand AS a FROM part)
SELECT p_partkey, a || ' Technologies Inc" careers' || '|' || a || ' Technologies Inc" jobs' || '|' || a || '" careers' || '|'
  || a || ' Technologies Inc" site:greenhouse.io' || '|' || a || '" site:greenhouse.io' || '|'
  || a || ' Technologies Inc" site:lever.co' || '|' || a || '" site:lever.co' || '|'
  || a || ' Technologies Inc" site:ashbyhq.com' || '|' || a || '" site:ashbyhq.com' || '|'
  || a || ' Technologies Inc" site:myworkdayjobs.com' AS phrases FROM t""",
)
def search_phrases(spark, sf):
    company = F.concat("p_brand", F.lit("  Technologies Inc"))
    return table(spark, sf, "part").select(
        "p_partkey",
        F.array_join(ti.search_queries("p_name", company, fixed.DEFAULT_SEARCH_DOMAINS), "|").alias("phrases"),
    )


@query(
    "company_aliases",
    """
SELECT c_custkey, c_name || ', FooBar Group' || '|' || c_name || ', Foo Bar Group|' || c_name || ', FooBar|' || c_name AS aliases,
  'customer|' || substr(c_name, 10) || '|foobar|group|foo|bar' AS terms FROM customer""",
)
def company_aliases(spark, sf):
    company = F.concat("c_name", F.lit(", FooBar Group"))
    return table(spark, sf, "customer").select(
        "c_custkey", F.array_join(ti.company_aliases(company), "|").alias("aliases"),
        F.array_join(ti.company_terms(company), "|").alias("terms"),
    )


@query(
    "feed_titles",
    """
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand || ' at home' WHEN 1 THEN p_brand ELSE '' END AS company,
  p_name AS title FROM part""",
)
def feed_titles(spark, sf):
    raw = (
        F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" at "), "p_brand", F.lit("  at home")))
        .when(F.col("p_size") % 3 == 1, F.concat("p_brand", F.lit(":  "), "p_name"))
        .otherwise(F.col("p_name"))
    )
    found = table(spark, sf, "part").select("p_partkey", ti.feed_title(raw).alias("f"))
    return found.select("p_partkey", "f.company", "f.title")


@query(
    "compound_titles",
    """
SELECT p_partkey,
  CASE p_size % 5 WHEN 0 THEN p_name || ' Engineer' WHEN 1 THEN p_name || ' Engineer' WHEN 2 THEN p_name || ' Manager, Ads and'
    WHEN 3 THEN p_name ELSE p_name || ' Lead (Core)' END AS title,
  CASE p_size % 5 WHEN 0 THEN 'Databricks' WHEN 1 THEN '(L5), Ads Acme Corp' WHEN 2 THEN 'Search Acme'
    WHEN 3 THEN '' ELSE 'three four five six' END AS company,
  CASE p_size % 5 WHEN 0 THEN 'Seattle, WA' WHEN 1 THEN 'NYC' WHEN 2 THEN p_type WHEN 3 THEN '' ELSE 'Here' END AS location,
  CASE p_size % 5 WHEN 0 THEN 'remote' WHEN 2 THEN 'on-site' ELSE '' END AS modality
FROM part""",
)
def compound_titles(spark, sf):
    tails = {
        0: F.lit(" Engineer databricks · Seattle, WA (Remote) Easy Apply"),
        1: F.lit(" Engineer (L5), Ads Acme Corp · NYC. $120K - $150K / yr"),
        2: F.concat(F.lit(" Manager, Ads and Search Acme · "), "p_type", F.lit(" (On-site) $60/hr")),
        3: F.lit(" Save"),
        4: F.lit(" Lead (Core) one two three four five six · Here"),
    }
    raw = F.col("p_name")
    for remainder, tail in tails.items():
        raw = F.when(F.col("p_size") % 5 == remainder, F.concat("p_name", tail)).otherwise(raw)
    found = table(spark, sf, "part").select("p_partkey", ti.split_compound(raw).alias("c"))
    return found.select(
        "p_partkey", "c.title", F.regexp_replace("c.company", "^databricks$", "Databricks").alias("company"),
        "c.location", "c.modality",
    )


@query(
    "card_tags",
    """
SELECT p_partkey, '$' || p_size || 'K/yr' AS salary, p_type AS location,
  CASE WHEN p_size % 2 = 0 THEN p_size || '+ referrals' ELSE '' END AS referrals,
  CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS clean_title, p_size % 4 = 0 AS compound
FROM part""",
)
def card_tags(spark, sf):
    size = F.col("p_size").cast("string")
    tags = F.array(
        F.concat(F.lit(" $"), size, F.lit("K/yr")), F.lit("first place"), F.lit(" "),
        F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit("+ referrals"))).otherwise(""), F.col("p_type"),
    )
    title = F.when(F.col("p_size") % 3 == 0, " View  Jobs").otherwise(F.col("p_name"))
    found = table(spark, sf, "part").select(
        "p_partkey", ti.classify_tags(tags).alias("c"), ti.clean_title(title).alias("clean_title"),
        ti.is_compound(F.when(F.col("p_size") % 4 == 0, "a · b").otherwise("a·b")).alias("compound"),
    )
    return found.select("p_partkey", "c.*", "clean_title", "compound")
