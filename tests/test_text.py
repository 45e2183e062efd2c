"""Text expressions against the standard library."""

import html

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from postmill.functions import text as t
from postmill.functions import titles as ti
from postmill.functions import urls as u

PIECES = ["a", " ", "&amp;", "&lt;", "&nbsp;", "&copy;", "&notit;", "&", ";", "&#65;", "&#x1F600;", "&#128;", "&#0;", "&#xD800;", "&#1;", "&Aacute", "é", "\n", "&amp;lt;", "&#99999999999;", "&ampere;"]


def rows(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["x"] for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), min_size=30, max_size=60))
def test_unescape(spark, values):
    assert rows(spark, values, t.unescape("c")) == [html.unescape(v) for v in values]


def test_whitespace(spark):
    values = ["  a\t b\n", " \x1f x \x1c", " y ", "", "\x85z"]
    assert rows(spark, values, t.collapse_ws("c")) == [" ".join(v.split()) for v in values]
    assert rows(spark, values, t.strip("c")) == [v.strip() for v in values]


def test_html_to_text(spark):
    page = "<h1>A &amp; B</h1>\r\n<p> one <b>two</b>\n\n three</p><script>x</script> &nbsp; <br/>end"
    assert rows(spark, [page, None], t.html_to_text("c")) == ["A & B\none two\nthree\nx\nend", ""]


def test_lines_and_excerpt(spark):
    values = ["a\r\nb\x0bc\n", "", "x\n\ny", "\n"]
    assert rows(spark, values, t.lines_of(t.filled("c"))) == [v.splitlines() for v in values]
    long = "\n".join(["x" * 300, " ", "y" * 300, "z"])
    assert rows(spark, [long, "\n".join("abcdefghij")], t.excerpt("c")) == ["x" * 300 + "\n" + "y" * 300, "\n".join("abcdefgh")]


@pytest.mark.parametrize(
    "raw,want",
    [("//x.com/a", "https://x.com/a"), ("mailto:a@b", ""), ("javascript:x", ""), ("#top", ""), ("https://x.com/?a=1#f", "https://x.com/?a=1#f"),
     ("https://r.com/?u=https%3A%2F%2Fb.com%2F%3Furl%3Dhttps%253A%252F%252Fc.com", "https://c.com"), ("https://x.com/?dest=%zz", "%zz"),
     ("https://x.com/?u=second&url=first", "first")],
)
def test_unwrap(spark, raw, want):
    assert rows(spark, [raw], u.unwrap("c")) == [want]


def test_hosts(spark):
    values = ["https://user:p@Sub.X.com:80/a", "no url", "//h.io?x", None]
    assert rows(spark, values, u.host_of("c")) == ["sub.x.com", "", "h.io", ""]
    jobs = ["https://www.linkedin.com/comm/jobs/view/1/", "https://linkedin.com/feed?currentJobId=3", "https://notlinkedin.com/jobs/view/1"]
    assert rows(spark, jobs, u.is_linkedin_job("c")) == [True, True, False]
    api = rows(spark, ["https://s.wd12.myworkdayjobs.com/Site/job/SF/Eng/1", "https://x"], u.workday_api_url("c"))
    assert api == ["https://s.wd12.myworkdayjobs.com/wday/cxs/s/Site/job/SF/Eng/1", None]


def test_notes(spark):
    old = "---\nmatch_score: 1\n---\nbody"
    assert rows(spark, [old, "plain", "---\ntriage_mode: x\n---\nb"], t.add_triage_mode(t.col("c"))) == [
        "---\nmatch_score: 1\ntriage_mode: metadata_only\n---\nbody", "plain", "---\ntriage_mode: x\n---\nb",
    ]
    assert rows(spark, ["a/b:c", "..", ""], t.sanitize_filename("c")) == ["a-b-c", "untitled", "untitled"]


def test_titles(spark):
    values = ["SWE, ML & Fullstack", "sde/SWE2", ""]
    assert rows(spark, values, ti.title_norm("c")) == ["software engineer ml and full stack", "software development engineer swe2", ""]
    assert rows(spark, ["FooBar Technologies, Inc"], ti.company_aliases("c")) == [
        ["FooBar Technologies, Inc", "Foo Bar Technologies, Inc", "FooBar ,", "FooBar Technologies"]
    ]


def test_ended_entities_only(spark):
    """A page that ends in the middle of an entity: only what ends in ';' is decoded where the SQL reads pages so."""
    values = ["<title>a &amp</title>b &middot; c&ampd &lt;", "x &copy y &amp; &#65 &#66; &notit;", "&quot &am &", None]
    assert rows(spark, values, t.html_to_text("c", ended=True)) == ["a &amp b · c&ampd <", "x &copy y & &#65 B &notit;", "&quot &am &", ""]
    escaped = [v and html.escape(v, quote=False) for v in values]
    assert rows(spark, escaped, t.html_fragment_to_text("c", ended=True)) == rows(spark, values, t.html_to_text("c", ended=True))
    assert rows(spark, values, t.fallback_lines("c", ended=True)) == [["a &amp b · c&ampd <"], ["x &copy y & &#65 B &notit;"], ["&quot &am &"], []]
