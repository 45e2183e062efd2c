"""Question counting over the lines of documents: line = question, document = thread, lang = type."""

from pyspark.sql import functions as F

from postmill.catalog.registry import query, table
from postmill.functions.text import collapse_ws
from postmill.operators import handbook as h
from postmill.session import stage

LINES = """
WITH lines AS (
  SELECT doc_id AS thread_id, lang AS type, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS name, doc_id * 1000000 + pos AS seen_at FROM (
    SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)),
asked AS (SELECT * FROM lines WHERE name <> ''),
canonical AS (SELECT type, name, count(DISTINCT thread_id) AS frequency FROM asked GROUP BY type, name)
"""


def extracted(spark, sf, kind=None):
    """Documents as posts, their lines as questions; a line's white space is collapsed once, before any use of its name."""
    lines = F.transform(F.split("text", "\n"), lambda line, pos: F.struct(
        (F.col("doc_id") * 1000000 + pos).alias("at"), collapse_ws(line).alias("name")
    ))
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("thread_id"), (F.col("lang") if kind is None else kind).alias("type"),
        F.filter(lines, lambda x: x["name"] != "").alias("questions"), F.when(F.col("doc_id") % 50 == 7, "timeout").alias("error"),
    )


def flat(posts):
    return posts.select("thread_id", "type", F.inline("questions"))


def asked(spark, sf):
    return flat(extracted(spark, sf))


def canonical(spark, sf):
    return h.canonical_questions(asked(spark, sf), "at", cluster_key=lambda name: name)


@query(
    "frequency_leaderboard",
    LINES
    + "SELECT type, name, frequency FROM canonical WHERE frequency >= 2 ORDER BY frequency DESC, name, type LIMIT 50",
)
def frequency_leaderboard(spark, sf):
    return h.leaderboard(canonical(spark, sf)).select("type", "name", "frequency")


@query(
    "normalized_clusters",
    LINES
    + """, keyed AS (SELECT *, CASE WHEN k = '' THEN name ELSE k END AS cluster FROM (
   SELECT *, trim(regexp_replace(replace(replace(lower(name), '&', ' and '), 'fullstack', 'full stack'), '[^a-z0-9]+', ' ', 'g')) AS k FROM asked))
SELECT type, min_by(name, seen_at) AS name, count(DISTINCT thread_id) AS frequency FROM keyed GROUP BY type, cluster""",
)
def normalized_clusters(spark, sf):
    return h.canonical_questions(asked(spark, sf), "at").select("type", "name", "frequency")


# What a model would have read out of a thread, derived from thread and line.
READ_OUT = {
    "round": "CASE thread_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '未注明' ELSE 'round ' || (thread_id % 3) END",
    "difficulty": "CASE WHEN thread_id % 6 = 5 THEN '未注明' WHEN thread_id % 6 > 2 THEN 'level ' || (length(name) % 3) END",
    "what": "CASE WHEN thread_id % 7 = 3 THEN 'Task: ' || name WHEN thread_id % 7 = 4 THEN '  ' END",
    "solution_hint": "CASE WHEN thread_id % 9 = 2 THEN ' Try ' || length(name) END",
    "pitfalls": "CASE WHEN thread_id % 11 = 5 THEN 'Mind ' || (length(name) % 10) END",
    "follow_ups": "CASE WHEN thread_id % 13 = 1 THEN 'Then ' || (thread_id % 10) END",
}
READ_POINTS = "CASE WHEN thread_id % 3 = 0 THEN [] ELSE ['p' || (length(name) % 5), 'p' || (thread_id % 2), ' '] END"
READ = f""", q AS (SELECT thread_id, type, name, seen_at, substr(name, 1, 4) AS cluster, {READ_POINTS} AS points,
  {", ".join(f"{sql} AS {name}" for name, sql in READ_OUT.items())} FROM asked),
types AS (SELECT cluster, type, count(DISTINCT thread_id) AS n, min(seen_at) AS s FROM q GROUP BY ALL),
rounds AS (SELECT cluster, round, count(DISTINCT thread_id) AS n, min(seen_at) AS s FROM q WHERE round <> '未注明' GROUP BY ALL),
levels AS (SELECT cluster, difficulty, count(DISTINCT thread_id) AS n, min(seen_at) AS s FROM q WHERE difficulty <> '未注明' GROUP BY ALL),
t AS (SELECT cluster, type FROM types QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, s) = 1),
r AS (SELECT cluster, round FROM rounds QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, s) = 1),
d AS (SELECT cluster, difficulty FROM levels QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, s) = 1),
c AS (SELECT cluster, min_by(name, seen_at) AS name, count(DISTINCT name) - 1 AS aliases, count(DISTINCT thread_id) AS frequency,
  min_by(trim(what), seen_at) FILTER (WHERE trim(what) <> '') AS told, min_by(trim(solution_hint), seen_at) FILTER (WHERE solution_hint IS NOT NULL) AS common_solutions,
  min_by(pitfalls, seen_at) FILTER (WHERE pitfalls IS NOT NULL) AS common_pitfalls, min_by(follow_ups, seen_at) FILTER (WHERE follow_ups IS NOT NULL) AS follow_ups FROM q GROUP BY cluster),
v AS (SELECT q.cluster, 'alias' AS kind, q.name AS value, count(DISTINCT thread_id) AS threads, min(seen_at) AS first_at FROM q JOIN c ON q.cluster = c.cluster AND q.name <> c.name GROUP BY ALL
  UNION ALL SELECT cluster, 'point', p, count(DISTINCT thread_id), min(seen_at) FROM (SELECT cluster, thread_id, seen_at, unnest(points) AS p FROM q) WHERE trim(p) <> '' GROUP BY ALL),
full_rows AS (SELECT c.cluster, name, type, frequency, aliases, (SELECT count(*) FROM v WHERE v.cluster = c.cluster AND kind = 'point') AS points,
  coalesce(round, '未注明') AS round, coalesce(difficulty, '未注明') AS difficulty,
  coalesce(told, '楼主仅提及题名，未公开具体题面/约束。建议直接查阅 thread_ids 中的原帖与楼下回复。') AS description, common_solutions, common_pitfalls, follow_ups,
  CASE WHEN told IS NULL THEN 'low' WHEN coalesce(common_solutions, follow_ups) IS NULL THEN 'medium' ELSE 'high' END AS source_quality
  FROM c JOIN t USING (cluster) LEFT JOIN r USING (cluster) LEFT JOIN d USING (cluster))
"""


def four_letters(name):
    return F.substring(name, 1, 4)


def read_out(questions):
    thread = F.col("thread_id")
    return questions.withColumns({
        **{name: F.expr(sql) for name, sql in READ_OUT.items()},
        "examination_points": F.when(thread % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(
            F.concat(F.lit("p"), (F.length("name") % 5).cast("string")), F.concat(F.lit("p"), (thread % 2).cast("string")), F.lit(" "))),
    })


@query(
    "canonical_rows",
    LINES + READ + "SELECT * FROM full_rows",
)
def canonical_rows(spark, sf):
    """Lines as questions, their first four letters as the cluster; what a model reads out derived from thread and line."""
    questions = read_out(flat(stage(extracted(spark, sf))))
    facts = h.question_facts(questions, "at", four_letters)
    return h.canonical_rows(facts, h.question_texts(questions, "at", four_letters)).drop("first_at")


@query(
    "canonical_values",
    LINES + READ + "SELECT * FROM v",
)
def canonical_values(spark, sf):
    """Aliases and points of the clusters of `canonical_rows`, a row each."""
    return h.canonical_values(h.question_facts(read_out(asked(spark, sf)), "at", four_letters))


@query(
    "type_buckets",
    LINES + "SELECT type, count(*) AS questions, min(seen_at) AS first_at FROM asked GROUP BY type",
)
def type_buckets(spark, sf):
    return h.type_buckets(asked(spark, sf), "at")


@query(
    "question_ids",
    LINES
    + """, sized AS (SELECT type, count(*) AS n, min(seen_at) AS seen FROM asked GROUP BY type),
numbered AS (SELECT c.*, row_number() OVER (ORDER BY s.n DESC, s.seen, c.frequency DESC, c.name) AS num
  FROM canonical c JOIN sized s ON c.type = s.type)
SELECT 'q' || CASE WHEN num < 1000 THEN lpad(CAST(num AS VARCHAR), 3, '0') ELSE CAST(num AS VARCHAR) END AS id, type, name, frequency
FROM numbered""",
)
def question_ids(spark, sf):
    questions = asked(spark, sf)
    return h.with_ids(canonical(spark, sf), h.type_buckets(questions, "at")).select("id", "type", "name", "frequency")


@query(
    "question_links",
    LINES
    + """, members AS (SELECT DISTINCT type, name, thread_id FROM asked),
placed AS (SELECT *, row_number() OVER (PARTITION BY type, name ORDER BY thread_id) AS place,
    count(*) OVER (PARTITION BY type, name) AS threads FROM members)
SELECT type, name, threads,
  string_agg('[#' || thread_id || '](' || CASE WHEN thread_id IN (SELECT doc_id FROM labels) THEN 'https://l/' || thread_id
    ELSE 'https://www.1point3acres.com/bbs/thread-' || thread_id || '-1-1.html' END || ')', ' · ' ORDER BY place)
  || CASE WHEN threads > 8 THEN ' + ' || (threads - 8) || ' 帖' ELSE '' END AS links
FROM placed WHERE place <= 8 GROUP BY type, name, threads""",
)
def question_links(spark, sf):
    listings = table(spark, sf, "labels").select(
        F.col("doc_id").alias("thread_id"), F.concat(F.lit("https://l/"), F.col("doc_id").cast("string")).alias("href")
    )
    return h.source_links(asked(spark, sf), listings, ["type", "name"])


TYPED = LINES.replace("lang AS type", "CASE lang WHEN 'en' THEN 'coding' WHEN 'fr' THEN 'sd' WHEN 'de' THEN 'math' ELSE 'other' END AS type")
LABEL = "CASE type WHEN 'coding' THEN 'Coding' WHEN 'sd' THEN 'System Design' WHEN 'math' THEN 'Math / Reasoning' ELSE type END"


@query(
    "handbook_lines",
    TYPED
    + f""", board AS (SELECT * FROM canonical WHERE frequency >= 2 ORDER BY frequency DESC, name, type LIMIT 50)
SELECT CAST(1 AS INTEGER) AS part, CAST(0 AS INTEGER) AS section, -frequency AS rank, name, '| **' || name || '** | ' || {LABEL} || ' | ' || frequency || ' |' AS line FROM board
UNION ALL SELECT 2, CASE type WHEN 'coding' THEN 1 WHEN 'sd' THEN 2 ELSE 5 END, -frequency, name, '## ' || name || ' _(频次 ' || frequency || ' · ' || {LABEL} || ')_'
  FROM canonical WHERE type <> 'other'
UNION ALL SELECT 3, 0, -frequency, name, '- **' || name || '** _' || {LABEL} || '_' FROM canonical WHERE frequency = 1""",
)
def handbook_lines(spark, sf):
    kind = F.when(F.col("type") == "en", "coding").when(F.col("type") == "fr", "sd").when(F.col("type") == "de", "math").otherwise("other")
    found = h.canonical_questions(asked(spark, sf).withColumn("type", kind), "at", cluster_key=lambda name: name)
    return h.handbook_lines(found)


@query(
    "handbook_document",
    TYPED
    + READ
    + f""", f AS (SELECT full_rows.*, {LABEL} AS label, CASE type WHEN 'coding' THEN 1 WHEN 'sd' THEN 2 WHEN 'math' THEN 5 END AS place, threads[1] AS thread,
  array_to_string(list_transform(threads[:8], lambda i: '[#' || i || '](https://www.1point3acres.com/bbs/thread-' || i || '-1-1.html)'), ' · ')
    || CASE WHEN len(threads) > 8 THEN ' + ' || (len(threads) - 8) || ' 帖' ELSE '' END AS links
  FROM full_rows JOIN (SELECT cluster, list_sort(list_distinct(list(thread_id))) AS threads FROM q GROUP BY cluster) USING (cluster)),
n AS (SELECT (SELECT count(*) FROM documents) AS posts, (SELECT count(*) FROM asked) AS raw, (SELECT count(*) FROM documents WHERE doc_id % 50 = 7) AS failed, (SELECT count(*) FROM f) AS questions,
  (SELECT count(*) FROM f WHERE frequency = 1) AS rare, (SELECT count(*) FROM f WHERE frequency >= 2) AS often),
ends AS (SELECT cluster, min(value) AS lo, max(value) AS hi FROM v WHERE kind = 'alias' GROUP BY cluster),
body AS (
  SELECT f.*, unnest([0, 1, 17, 18]) AS "at", '' AS item, unnest(['## ' || name || ' _(频次 ' || frequency || ' · ' || label || CASE WHEN round = '未注明' THEN '' ELSE ' · ' || round END || ')_', '', '---', '']) AS line FROM f
  UNION ALL SELECT f.*, 3, '', '' FROM f WHERE aliases > 0
  UNION ALL SELECT f.*, unnest([4, 6]), '', unnest(['**考查点**：', '']) FROM f WHERE points > 0
  UNION ALL SELECT f.*, unnest([7, 8]), '', unnest(['**题面**' || CASE source_quality WHEN 'high' THEN '' WHEN 'medium' THEN ' _(题面综合自有限描述)_' ELSE ' ⚠️ _(楼主未给题面，仅题名记录)_' END || '：' || description, '']) FROM f
  UNION ALL SELECT f.*, unnest([9, 10]), '', unnest(['**主要解法**：' || common_solutions, '']) FROM f WHERE common_solutions IS NOT NULL
  UNION ALL SELECT f.*, unnest([11, 12]), '', unnest(['**踩坑**：' || common_pitfalls, '']) FROM f WHERE common_pitfalls IS NOT NULL
  UNION ALL SELECT f.*, unnest([13, 14]), '', unnest(['**Follow-up**：' || follow_ups, '']) FROM f WHERE follow_ups IS NOT NULL
  UNION ALL SELECT f.*, unnest([15, 16]), '', unnest(['**来源**：' || links, '']) FROM f
  UNION ALL SELECT f.*, 2, value, CASE WHEN value = lo THEN '**别名**：' ELSE '' END || value || CASE WHEN value = hi THEN '' ELSE ',' END
    FROM f JOIN v USING (cluster) JOIN ends USING (cluster) WHERE kind = 'alias'
  UNION ALL SELECT f.*, 5, value, '- ' || value FROM f JOIN v USING (cluster) WHERE kind = 'point'),
fixed AS (
  SELECT 0 AS part, 0 AS section, ['# Acme 面试复习手册', '', '> **来源**：[1point3acres Acme 面试经验](https://jobs.1point3acres.com/companies/acme/interview)',
    '> **数据范围**：' || posts || ' 帖（前 20 页，约 2025–2026）', '> **抓取日期**：2026-01-02', '> **聚合后题目数**：' || questions, '', '---', ''] AS lines FROM n
  UNION ALL SELECT 1, 0, ['## 速览：高频题榜（≥2 次）', ''] || CASE WHEN often > 0 THEN ['| # | 题目 | 类型 | 频次 | 难度 | 主要场次 |', '|---|---|---|---|---|---|'] ELSE ['（暂无频次 ≥2 的题——数据可能太少）'] END FROM n
  UNION ALL SELECT 1, 2, ['', '---', ''] FROM n
  UNION ALL SELECT 3, 0, ['## 罕见题（频次 = 1，共 ' || rare || ' 道）', '', '_仅出现过一次，复习时可略过；准备充分后再扫一遍。_', ''] FROM n WHERE rare > 0
  UNION ALL SELECT 3, 2, [''] FROM n WHERE rare > 0
  UNION ALL SELECT 4, 0, ['---', '', '## 元信息', '', '- 抓取脚本：`handbook.py`', '- 模型：`rules`（两阶段：map + reduce）', '- 帖子总数：' || posts, '- 抽出原始题数：' || raw, '- 聚合后不同题数：' || questions]
    || CASE WHEN failed > 0 THEN ['- ⚠️ Stage1 LLM 失败：' || failed || ' 帖'] ELSE [] END FROM n),
board AS (SELECT *, row_number() OVER (ORDER BY frequency DESC, name, type, cluster) AS k FROM f WHERE frequency >= 2 QUALIFY k <= 50)
SELECT part::INTEGER AS part, section::INTEGER AS section, 0::BIGINT AS rank, '' AS name, '' AS cluster, (unnest(generate_series(1, len(lines))) - 1)::INTEGER AS "at", '' AS item, unnest(lines) AS line FROM fixed
UNION ALL SELECT 1, 1, 0, '', '', (k - 1)::INTEGER, '', '| ' || k || ' | **' || name || '** | ' || label || ' | ' || frequency || ' | ' || difficulty || ' | ' || round || ' |' FROM board
UNION ALL SELECT 2, place, -frequency, name, cluster, "at"::INTEGER, item, line FROM body WHERE place IS NOT NULL
UNION ALL SELECT 3, 1, -frequency, name, cluster, 0, '', '- **[' || name || '](https://www.1point3acres.com/bbs/thread-' || thread || '-1-1.html)** _' || label || '_ — '
  || CASE WHEN length(description) > 120 THEN substr(description, 1, 120) || '…' ELSE description END FROM f WHERE frequency = 1""",
)
def handbook_document(spark, sf):
    """The handbook of all lines, clustered by their first four letters, with texts, links and counts."""
    kind = F.when(F.col("lang") == "en", "coding").when(F.col("lang") == "fr", "sd").when(F.col("lang") == "de", "math").otherwise("other")
    posts = stage(extracted(spark, sf, kind))
    questions = read_out(flat(posts))
    facts = h.question_facts(questions, "at", four_letters)
    found = h.canonical_rows(facts, h.question_texts(questions, "at", four_letters))
    members = questions.select(four_letters("name").alias("cluster"), "thread_id")
    none = table(spark, sf, "labels").select(F.col("doc_id").alias("thread_id"), F.lit("").alias("href")).filter("thread_id < 0")
    counts = h.handbook_counts(posts, found)
    links = h.source_links(members, none, ["cluster"])
    return h.handbook_document(found, h.canonical_values(facts), links, counts, "Acme", "2026-01-02", script="handbook.py", model="rules")
