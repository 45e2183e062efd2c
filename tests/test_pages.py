"""Elements of pages, question pages, and texts kept whole or cut by a parameter."""

import pytest
from pyspark.sql import functions as F

from postmill.functions.text import fallback_lines, inner_markup
from postmill.operators.reports import review_section
from postmill.sources import posts

MARK = 'id="m"'
CASES = [
    (None, None), ("", None), ("<p>none</p>", None), ('<div id="m"></div>', ""), ('x<div id="m">a<div>b</div>c</div>d</div>', "a<div>b</div>c"),
    ('<DIV class="z" id="m">a<div\n>b</DIV>c</div>d', "a<div\n>b</DIV>c"), ('<b id="m">never <b>closed', "never <b>closed"),
    ('<div id="m">a<divx>b</divx></div>c', "a<divx>b</divx>"), ('<p>1</p><span id="m">$1 \\Q</span><div id="m">2</div>', "$1 \\Q"),
    ('<div id="m">' + "<div>" * 500 + "x" + "</div>" * 500 + "</div>y", "<div>" * 500 + "x" + "</div>" * 500),
    ('<div id="m">' + "line\n" * 50000 + "</div>y", "line\n" * 50000),
]


@pytest.mark.parametrize("html, inner", CASES)
def test_inner_markup(spark, html, inner):
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(inner_markup("html", MARK).alias("x")).first().x == inner


def test_question_pages(spark):
    page = (
        '<title> Tab\n</title><a href="/problems/two-sum/">1. <b>Two</b> Sum</a><div class="x text-difficulty-easy">Easy</div><a href="/tag/array/">Array</a>'
        '<div data-track-load="description_content"><p>Given &lt;nums&gt;</p><div><p>Return</p></div></div><div>else</div>'
    )
    df = spark.createDataFrame([("u1", page), ("u2", "<title>Only</title>"), ("u3", None)], "url string, payload string")
    got = {r.url: tuple(r)[1:] for r in posts.question_details(df).collect()}
    assert got["u1"] == ("1. Two Sum", "Easy", ["Array"], "<p>Given &lt;nums&gt;</p><div><p>Return</p></div>", "Given <nums>\nReturn")
    assert got["u2"][0] == "Only" and got["u2"][2:] == ([], "", "") and got["u3"][2:] == ([], "", "")
    assert posts.question_details(df.limit(0)).count() == 0


def test_texts_are_whole_unless_a_limit_is_given(spark):
    long = "word " * 9000
    note = spark.createDataFrame([("/n/a.md", long)], "path string, value string").withColumn("modified_at", F.current_timestamp())
    bodies = [posts.file_posts(note, F.lit("c"), F.current_timestamp(), n).first().body for n in (None, 7)]
    assert bodies == [long.strip(), "word wo"]
    page = spark.createDataFrame([("".join(f"<p>a useful line {i}</p>" for i in range(400)),)], "html string")
    assert tuple(page.select(F.size(fallback_lines("html")), F.size(fallback_lines("html", 250))).first()) == (400, 250)
    job = spark.createDataFrame([(long, "", 90, "strong", ["a"], ["b"], "go", "sum")], "jd_text string, jd_text_preview string, match_score int, verdict string, top_strengths array<string>, key_gaps array<string>, quick_recommendation string, jd_summary string")
    whole, cut = job.select(review_section("r"), review_section("r", 7)).first()
    assert whole.endswith(long.strip()) and cut.endswith("\nword wo")


def test_a_folder_of_notes_becomes_posts(spark, tmp_path):
    (tmp_path / "one note.md").write_text("---\ntitle: Asked\nurl: https://g/1\nposted_at: 2026-02-03\n---\nBody\n")
    (tmp_path / "two.md").write_text("plain")
    (tmp_path / "three.txt").write_text("no note")
    rows = posts.file_posts(posts.read_note_folder(spark, str(tmp_path)), F.lit("Acme"), F.current_timestamp()).collect()
    found = {r.title: (r.body, r.url.rsplit("/", 1)[1], str(r.posted_at)[:10]) for r in rows}
    assert found["Asked"] == ("Body", "1", "2026-02-03") and found["two"][:2] == ("plain", "two.md") and len(rows) == 2
