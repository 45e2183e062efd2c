"""Canonical questions in long form and the handbook written from them."""

from pyspark.sql import functions as F

from postmill.catalog import questions as q
from postmill.operators import handbook as h

QUESTIONS = "thread_id string, name string, type string, round string, difficulty string, what string, solution_hint string, pitfalls string, follow_ups string, examination_points array<string>, at int"
ROWS = [
    ("1", "GPU Credit", "coding", "60min", None, " ", None, None, None, ["heap", " "], 1),
    ("2", "gpu credit", "coding", "未注明", "hard", " Keep credits ", "", "Expiry", "Refunds", ["time", "heap"], 2),
    ("2", "gpu-credit", "sd", "60min", "未注明", "later", "Sort by expiry", None, "", None, 3),
    ("3", "GPU CREDIT", "coding", "onsite", "hard", None, None, None, None, [], 4),
    ("4", "Chat", "sd", None, None, None, None, None, None, None, 5),
    ("5", "Ranker", "ml-coding", None, None, "x" * 130, None, None, None, None, 6),
    ("6", None, "coding", None, None, None, None, None, None, None, 7),
]


def parts(spark, rows=ROWS):
    questions = spark.createDataFrame(rows, QUESTIONS)
    facts = h.question_facts(questions, "at")
    return questions, h.canonical_rows(facts, h.question_texts(questions, "at")), h.canonical_values(facts)


def test_canonical_rows_and_values(spark):
    _, canonical, values = parts(spark)
    found = {r.cluster: r.asDict() for r in canonical.collect()}
    assert set(found) == {"gpu credit", "chat", "ranker"}
    credit = found["gpu credit"]
    assert (credit["name"], credit["type"], credit["frequency"], credit["aliases"], credit["points"]) == ("GPU Credit", "coding", 3, 3, 2)
    assert (credit["round"], credit["difficulty"], credit["source_quality"]) == ("60min", "hard", "high")
    assert (credit["description"], credit["common_solutions"], credit["common_pitfalls"], credit["follow_ups"]) == ("Keep credits", "Sort by expiry", "Expiry", "Refunds")
    assert (found["chat"]["source_quality"], found["ranker"]["source_quality"]) == ("low", "medium")
    assert found["chat"]["description"].startswith("楼主仅提及题名")
    assert sorted((r.kind, r.value, r.threads) for r in values.collect()) == [
        ("alias", "GPU CREDIT", 1), ("alias", "gpu credit", 1), ("alias", "gpu-credit", 1), ("point", "heap", 2), ("point", "time", 1),
    ]


def written(spark, minimum, rows=ROWS, **meta):
    questions, canonical, values = parts(spark, rows)
    keyed = questions.filter("name IS NOT NULL").select(h._named(F.col("name")).alias("cluster"), "thread_id")
    listings = spark.createDataFrame([("5", "https://l/5")], "thread_id string, href string")
    counts = spark.createDataFrame([(6, len(rows), 0, canonical.count())], "posts long, raw_questions long, failed_posts long, questions long")
    out = h.handbook_document(canonical, values, h.source_links(keyed, listings, ["cluster"]), counts, "Acme", "2026-01-02", minimum, **meta)
    return [r.line for r in out.orderBy("part", "section", "rank", "name", "cluster", "at", "item").collect()]


def test_handbook_text(spark):
    lines = written(spark, 2, script="s.py", model="m")
    at = lines.index("## GPU Credit _(频次 3 · Coding · 60min)_")
    site = "https://www.1point3acres.com/bbs/thread-"
    assert lines[at : at + 22] == [
        "## GPU Credit _(频次 3 · Coding · 60min)_", "", "**别名**：GPU CREDIT,", "gpu credit,", "gpu-credit", "",
        "**考查点**：", "- heap", "- time", "", "**题面**：Keep credits", "", "**主要解法**：Sort by expiry", "", "**踩坑**：Expiry", "",
        "**Follow-up**：Refunds", "", f"**来源**：[#1]({site}1-1-1.html) · [#2]({site}2-1-1.html) · [#3]({site}3-1-1.html)", "", "---", "",
    ]
    assert "| 1 | **GPU Credit** | Coding | 3 | hard | 60min |" in lines and "## 罕见题（频次 = 1，共 2 道）" in lines
    assert any(line.startswith("**题面** ⚠️ _(楼主未给题面，仅题名记录)_：楼主") for line in lines)
    assert "**题面** _(题面综合自有限描述)_：" + "x" * 130 in lines
    assert "- **[Ranker](https://l/5)** _ML Coding_ — " + "x" * 120 + "…" in lines
    assert "- 抓取脚本：`s.py`" in lines and "- 模型：`m`（两阶段：map + reduce）" in lines


def test_all_in_the_leaderboard_and_nothing_at_all(spark):
    lines = written(spark, 1)
    assert "## 速览：题目总览（全部 3 题，按频次降序）" in lines and not any("罕见题" in line or "模型" in line for line in lines)
    empty = written(spark, 2, rows=ROWS[-1:])
    assert "（暂无频次 ≥2 的题——数据可能太少）" in empty and "- 聚合后不同题数：0" in empty


def test_a_cluster_with_all_questions_gathers_nothing(spark):
    many = spark.range(20000).select(
        F.col("id").cast("string").alias("thread_id"), F.concat(F.lit("Same "), F.col("id").cast("string")).alias("name"), F.lit("coding").alias("type"),
        F.lit(None).cast("string").alias("round"), F.array(F.concat(F.lit("p"), (F.col("id") % 7000).cast("string"))).alias("examination_points"), F.col("id").alias("at"),
    )
    facts = h.question_facts(many, "at", lambda name: F.substring(name, 1, 4))
    canonical, values = h.canonical_rows(facts), h.canonical_values(facts)
    (row,) = canonical.collect()
    assert (row.frequency, row.aliases, row.points, row.name, row.source_quality) == (20000, 19999, 7000, "Same 0", None)
    assert {r.kind: r["count"] for r in values.groupBy("kind").count().collect()} == {"alias": 19999, "point": 7000}
    for df in (canonical, values):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "collect_" not in plan and "Window" not in plan


def test_documents_are_read_once(spark, monkeypatch):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        reads.add(1)
        return text

    def table(spark, sf, name):
        rows = spark.createDataFrame([(1, "Abcd  one\n\nAbcd two", "en"), (2, "Abcd one", "fr"), (3, None, "de")], "doc_id long, text string, lang string")
        return rows.withColumn("text", counted("text")) if name == "documents" else rows

    monkeypatch.setattr(q, "table", table)
    assert [(r["name"], r["frequency"], r["aliases"]) for r in q.canonical_rows(spark, "").collect()] == [("Abcd one", 2, 1)]
    assert reads.value == 3
    lines = [r.line for r in q.handbook_document(spark, "").collect()]
    assert "## Abcd one _(频次 2 · Coding · round 2)_" in lines and "- 抽出原始题数：3" in lines
    assert reads.value == 6
