"""Smaller operators: lookup boards, notes, archive folders, incremental helpers."""

import json
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from postmill.functions import payload
from postmill.functions import text as t
from postmill.functions import urls as u
from postmill.operators import archive, reports, rules
from postmill.sources import boards, posts
from postmill.streaming import incremental

NOW = "2026-04-25 00:00:00"


def test_post_cells_hold_few_pages_as_strings(spark):
    page = '<td id="postmessage_1">' + "x" * 20_000 + '<table><tr><td>n</td></tr></table></td><td>no post</td>'
    pages = pa.array([page, None, ""] * 500)
    tracemalloc.start()  # Arrow's own bytes don't count
    cells = posts.post_cells.func(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(cells) == 1500 and cells[:3].to_pylist() == [[page[23:-21]], [], []]
    assert posts.post_cells.func(pages[:0]).to_pylist() == []
    assert peak < 10e6  # the 500 pages are 10 MB, their cells as many


def test_lookup_boards(spark):
    opening = '{"id":"0a1b2c3d-0000-0000-0000-000000000001","title":"Eng \\u0026 Ops","updatedAt":"x","a":1,"locationName":"SF","workplaceType":null,"z":0,"secondaryLocations":[{"locationName":"NYC"},{"locationName":"LA"}]}'
    page = spark.createDataFrame([(f"<script>[{opening}]</script>", 0)], "payload string, page int")
    row = boards.ashby_openings(page, "b").first()
    assert (row["title"], row["location"]) == ("Eng & Ops", "SF | NYC | LA") and row["url"].endswith(row["id"])
    listing = json.dumps({"content": [{"id": 7, "name": "T", "location": {"fullLocation": "Here"}}]})
    pages = spark.createDataFrame([(listing, 0), (listing, 5)], "payload string, page int")
    assert [(r["id"], r["location"]) for r in boards.smartrecruiters_openings(pages, "b").collect()] == [("7", "Here")] * 2
    assert [(r["id"], r["location"]) for r in boards.smartrecruiters_openings(pages, "b", max_pages=3).collect()] == [("7", "Here")]
    detail = json.dumps({"jobAd": {"sections": {"qualifications": {"title": "Q", "text": "<p>b</p>"}, "companyDescription": {"title": "", "text": "<p>a</p>"}, "jobDescription": {"title": "x", "text": " "}}}})
    df = spark.createDataFrame([(detail,)], "d string").select(F.from_json("d", boards.SMARTRECRUITERS_DETAIL).alias("d"))
    assert df.select(payload.smartrecruiters_text(F.col("d.jobAd.sections")).alias("x")).first()["x"] == "a\n\nQ\nb"


def test_location_text(spark):
    values = [[{"address": {"addressLocality": " X ", "addressCountry": {"name": "US"}}}, "Remote"], {"name": "N", "addressRegion": "R"}, "plain  text", None, ""]
    df = spark.createDataFrame([(json.dumps(v),) for v in values], "v string")
    assert [r["x"] for r in df.select(payload.location_text("v").alias("x")).collect()] == ["X, US | Remote", "N, R", "plain text", "", ""]


def test_company_selection(spark):
    df = spark.createDataFrame([("a", True), ("b", False)], "slug string, enabled boolean")
    assert [r["slug"] for r in rules.select_companies(df).collect()] == ["a"]
    assert [r["slug"] for r in rules.select_companies(df, "b").collect()] == ["b"]
    named = spark.createDataFrame([("UBER ",), ("The Trade Desk",)], "c string")
    got = named.select(rules.company_setting("c", {"Uber": "uber-x", "uber": "no"}, t.kebab("c")).alias("x"))
    assert [r["x"] for r in got.collect()] == ["uber-x", "the-trade-desk"]


def test_incremental_helpers(spark, tmp_path):
    rows = [(0, "2026-04-01 00:00:00"), (1, "2020-01-01 00:00:00"), (1, None)]
    listings = spark.createDataFrame(rows, "page int, at string").withColumn("at", F.col("at").cast("timestamp"))
    now = F.lit(NOW).cast("timestamp")
    assert incremental.backfill_or_head(listings, True, "at", now).count() == 2
    assert incremental.backfill_or_head(listings, False, "at", now).count() == 1
    state = spark.createDataFrame([("a", "ok"), ("b", "fetch_error"), ("c", None)], "tid string, summary_status string")
    assert incremental.retryable(state).count() == 2 and incremental.retryable(state, False).count() == 3
    events = spark.createDataFrame([("k", "2026-01-01 00:00:00"), ("k", "2026-01-01 00:00:05"), ("j", "2026-01-01 00:00:07")], "k string, ts string")
    events.select("k", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    query = incremental.first_in_stream(stream, ["k"], "ts", "1 minute").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == 2


def test_threads_to_posts(spark):
    threads = spark.createDataFrame([("1", "", "me", "2026-01-02 03:04", "body", 2, True)], "tid string, title string, author string, posted_at string, body string, reply_count int, locked boolean")
    listings = spark.createDataFrame([("1", 0, 0, "Listed", ["x"])], "tid string, page int, at int, title string, tags array<string>")
    row = posts.thread_posts(threads, listings, F.lit("Acme"), F.lit(NOW).cast("timestamp")).first()
    assert (row["title"], row["locked"], row["posted_at"].hour) == ("Listed", True, 3)
    both = posts.all_posts([posts.thread_posts(threads, listings, F.lit(c), F.lit(NOW).cast("timestamp")) for c in ("A", "B")])
    assert both.count() == 2 and tuple(both.columns) == posts.POST_COLUMNS
    assert both.select(u.post_key(F.col("source"), F.col("source_id")).alias("k")).first()["k"] == "1p3a:1"


def test_archive_folder(spark, tmp_path):
    (tmp_path / "01-a").mkdir()
    (tmp_path / "images").mkdir()
    (tmp_path / "01-a" / "02-x.md").write_text("---\nsection: X\nsection_idx: 2\n---\nbody")
    (tmp_path / "00-top.md").write_text("no block")
    (tmp_path / "README.md").write_text("index")
    (tmp_path / "images" / "n.md").write_text("skip")
    found = archive.sections(archive.read_archive(spark, str(tmp_path)))
    got = {r["rel_path"]: (r["title"], r["chapter"], r["section_idx"]) for r in found.collect()}
    assert got == {"01-a/02-x.md": ("X", "01-a", 2), "00-top.md": ("00-top", "Sections", 999)}
    toc = spark.createDataFrame([(2, "First", 0), (2, "Second", 1)], "section_idx int, toc_title string, place int")
    assert {r["title"] for r in archive.with_toc_titles(found, toc).collect()} == {"First", "00-top"}
    lines = archive.chapter_index(found, relative=True).orderBy("chapter_at", "kind", "at").collect()
    assert [r["line"] for r in lines] == ["### Sections", "- [00-top](00-top.md)", "### 01-a", "- [X](01-a/02-x.md)"]


def test_notes_and_blocks(spark):
    row = [("Acme", "Eng", "SF", "src", "https://u", "text", 80, "medium_match", ["s1"], [], "go", "sum")]
    df = spark.createDataFrame(row, "company string, title string, location string, external_jd_source string, external_jd_url string, jd_text string, match_score int, verdict string, top_strengths array<string>, key_gaps array<string>, quick_recommendation string, jd_summary string")
    df = df.withColumns({c: F.lit("") for c in ("jd_company", "jd_title", "jd_location", "jd_text_preview")})
    note = df.select(reports.opportunity_note(F.col("match_score"), F.col("verdict"), F.lit("jd_full")).alias("x")).first()["x"]
    assert note.startswith("---\nmatch_score: 80\nverdict: medium_match\n") and "# Acme — Eng" in note
    review = df.select(reports.review_section("r1").alias("x")).first()["x"]
    assert "- s1" in review and "- None captured" in review and review.endswith("### JD excerpt\ntext")
    docs = spark.createDataFrame([("old\n\n", "new \n"), (None, "new")], "a string, b string")
    got = [r["x"] for r in docs.select(t.append_section(F.col("a"), F.col("b"), "Report").alias("x")).collect()]
    assert got == ["old\n\n---\n\nnew\n", "# Report\n\nnew\n"]
    block = spark.createDataFrame([("T", "u", "", "", ["a", "b"])], "t string, u string, w string, p string, g array<string>")
    text = block.select(reports.thread_block(F.col("t"), F.col("u"), F.col("w"), F.col("p"), F.col("g"), "now").alias("x")).first()["x"]
    assert text.splitlines() == ["## 日期未注明 · [T](u)", "**抓取**: now · **作者**: 匿名", "**标签**: `a` `b`"]


def test_pages_of_many_forms_are_assembled(spark):
    html = "<h2>Sub</h2><pre>x = 1\ny = 2</pre><pre>x = 1\nz = 3</pre><pre></pre>" + '<img src="/images/courses/1.png" alt="One">'
    body = "02\nTitle\nFigure 2. Caption text here\nIntro\nx = 1\ny = 2\nafter\n  x = 1\nz = 3\nx = 1\na\tb\tc\nd\te\tf\tg\nFigure 2 again\nFigure 1\nSub\n"
    rows = [(1, body, html), (2, "", ""), (3, None, None), (4, "Only", "<h3>Only</h3>"), (5, "T\nx = 1\nother", html), (6, "T\na\tb\tc\nplain\na\tb", "")]
    df = spark.createDataFrame(rows, "k int, body string, html string")
    page = archive.assemble(F.col("body"), F.col("html"), F.array(F.lit("f.png")), "https://c.example")
    got = {r["k"]: r["m"] for r in df.select("k", page.alias("m")).collect()}
    assert got[1]["markdown"] == (
        "# Title\n\n> *Figure 2 — image not captured*\nIntro\n\n```\nx = 1\ny = 2\n```\n\nafter\n\n```\nx = 1\nz = 3\n```\n\nx = 1\n\n"
        "| a | b | c |  |\n|---|---|---|---|\n| d | e | f | g |\n\nFigure 2 again\n\n![One](images/f.png)\n\n## Sub\n"
    )
    assert tuple(got[1])[2:] == (1, 2, 1, 1)
    assert {tuple(got[k]) for k in (2, 3)} == {("Untitled", "# Untitled\n", 0, 0, 0, 0)}
    assert tuple(got[4])[:2] == ("Only", "# Only\n")
    assert got[5]["markdown"] == "# T\n\n\n```\nx = 1\ny = 2\n```\n\nother".replace("\n\n\n", "\n\n")
    assert got[6]["markdown"] == "# T\n\na\tb\tc\nplain\na\tb" and got[6]["tables"] == 0


def test_places_of_postings(spark):
    places = [
        ('{"address": {"addressLocality": " X ", "addressCountry": {"name": "US"}}}', "X, US"),
        ('[{"address": {"addressRegion": "R"}}, "Remote", {"name": "N"}, {}, 7]', "R | Remote | N | 7"),
        ('{"address": {}, "name": "Office", "addressLocality": "L"}', "Office, L"),
        ('{"address": "plain"}', ""), ('"one  line"', "one line"), ("[]", ""), ("broken", ""), (None, ""),
    ]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(places)], "k int, v string")
    got = {r["k"]: r["x"] for r in df.select("k", payload.location_text("v").alias("x")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(places)}
