"""Forum and question-list sources, all ending in the one Post row."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill import fixed_values as fixed
from postmill.functions.text import (
    body_after_front_matter, collapse_ws, filled, first_present, front_matter, html_to_text, inner_markup, is_locked, markdown_post_text,
    page_title, parse_date, present, strip, strip_tags, unescape,
)
from postmill.functions.urls import file_post_id
from postmill.operators.keyed import quota, top_k


POST_COLUMNS = (
    "source", "source_id", "company", "title", "body", "url", "posted_at", "author", "reply_count", "locked", "raw",
)
THREAD = T.ArrayType(T.StringType())
PAGES_AT_ONCE = 100


def _at_most(text: Column, chars: int | None) -> Column:
    """`text`, whole where no limit is given (`fixed.POST_BODY_CHARS` is the usual one)."""
    return text if chars is None else F.substring(text, 1, chars)


def post(source: str, company: Column, **fields: Column) -> list[Column]:
    values = {
        "source": F.lit(source), "company": company, "author": F.lit(""), "reply_count": F.lit(0),
        "locked": F.lit(False), "raw": F.lit(None).cast("string"), **fields,
    }
    return [values[name].alias(name) for name in POST_COLUMNS]


def within_limits(posts: DataFrame, order: Sequence[str], cutoff: Column, limit: int) -> DataFrame:
    """Per company and source: first of equal ids, then the age cutoff, then the limit."""
    keys = ["company", "source"]
    once = top_k(posts, [*keys, "source_id"], [F.col(c) for c in order], 1)
    return quota(once.filter(F.col("posted_at") >= cutoff), keys, [F.col(c) for c in order], limit)


def reddit_posts(pages: DataFrame, company: Column, now: Column, body_chars: int | None = None) -> DataFrame:
    """Search result pages: self posts with a title or a body."""
    schema = """data struct<children:array<struct<data:struct<is_self:boolean,selftext:string,title:string,name:string,id:string,
      created_utc:double,permalink:string,author:string,num_comments:int,subreddit:string,score:int,upvote_ratio:double>>>>"""
    items = pages.select(
        "page", F.posexplode(F.from_json("payload", schema)["data"]["children"]).alias("at", "child"), company.alias("_company")
    )
    d = F.col("child")["data"]
    link = filled(d["permalink"])
    body, title = filled(d["selftext"]), filled(d["title"])
    return items.filter(F.coalesce(d["is_self"], F.lit(False)) & ((body != "") | (title != ""))).select(
        "page", "at",
        *post(
            "reddit", F.col("_company"), source_id=first_present(d["name"], d["id"]), title=title,
            body=_at_most(body, body_chars),
            url=F.when(link.startswith("/"), F.concat(F.lit("https://www.reddit.com"), link)).otherwise(link),
            posted_at=F.coalesce(F.when(d["created_utc"] != 0, F.timestamp_millis((d["created_utc"] * 1000).cast("bigint"))), now),
            author=filled(d["author"]), reply_count=F.coalesce(d["num_comments"], F.lit(0)),
            raw=F.to_json(F.struct(d["subreddit"].alias("subreddit"), d["score"].alias("score"), d["upvote_ratio"].alias("upvote_ratio"))),
        ),
    )


def discussion_links(html: Column | str) -> Column:
    """Distinct discussion paths of a result page, in page order."""
    return F.array_distinct(F.regexp_extract_all(filled(html), F.lit(r'href="(/discuss/\d+/[^"#?]+)"'), F.lit(1)))


def leetcode_posts(pages: DataFrame, company: Column, now: Column, body_chars: int | None = None) -> DataFrame:
    """Rendered discussion pages (`url`, `payload`, `visible_text`) to posts."""
    html = filled("payload")
    heading = strip(F.regexp_extract(html, r"<h1[^>]*>([^<]+)</h1>", 1))
    tab = strip(F.substring_index(F.regexp_extract(html, r"<title>([^<]+)</title>", 1), " - LeetCode", 1))
    inner = F.regexp_extract(html, r'(?s)<div[^>]*class="[^"]*discuss-markdown-container[^"]*"[^>]*>(.*?)</div>\s*<', 1)
    stamp = F.regexp_replace(F.regexp_extract(html, r'datetime="([^"]+)"', 1), "Z", "+00:00")
    return pages.select(
        "page",
        *post(
            "leetcode", company, source_id=F.regexp_extract("url", r"/discuss/(\d+)/", 1), title=first_present(heading, tab),
            body=_at_most(F.when(inner != "", markdown_post_text(inner)).otherwise(filled("visible_text")), body_chars),
            url=F.col("url"), posted_at=F.coalesce(stamp.try_cast("timestamp"), now),
            reply_count=F.coalesce(F.regexp_extract(html, r"(?i)(\d+)\s+comments?", 1).try_cast("int"), F.lit(0)),
            raw=F.to_json(F.struct(F.length(html).alias("original_html_len"))),
        ),
    ).filter("source_id != ''")


def file_posts(files: DataFrame, company: Column, now: Column, body_chars: int | None = None) -> DataFrame:
    """Pasted notes (`path`, `value`, `modified_at`) with optional front matter."""
    meta = files.withColumn("_m", front_matter("value"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")

    def field(name: str) -> Column:
        return present(F.try_element_at(F.col("_m"), F.lit(name)))

    url = F.coalesce(field("url"), F.concat(F.lit("file://"), "path"))
    has_block = filled("value").rlike(r"(?s)\A---\n.*?\n---\n")
    body = F.when(has_block, body_after_front_matter("value")).otherwise(F.col("value"))
    return meta.select(
        "path",
        *post(
            "glassdoor", company, source_id=file_post_id(url), title=F.coalesce(field("title"), stem),
            body=_at_most(strip(body), body_chars), url=url,
            posted_at=F.when(field("posted_at").isNotNull(), parse_date(field("posted_at"), now)).otherwise(F.col("modified_at")),
            raw=F.to_json(F.struct(F.col("path").alias("file"))),
        ),
    )


def read_note_folder(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(folder)
        .select(
            F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"), "value",
            F.col("_metadata.file_modification_time").alias("modified_at"),
        )
    )


def _cells(html: str) -> list[str]:
    """Inner markup of post cells; nested tables are kept whole by counting cell depth."""
    cells, depth, start = [], 0, None
    for tag in re.finditer(r"<(/?)td\b([^>]*)>", html, re.I):
        if tag[1]:
            depth -= 1
            if start is not None and depth == opened:
                cells.append(html[start : tag.start()])
                start = None
        else:
            if start is None and re.search(r'id="postmessage_\d+', tag[2]):
                start, opened = tag.end(), depth
            depth += 1
    return cells


@F.arrow_udf(THREAD)
def post_cells(html: pa.Array) -> pa.Array:
    """Cells of each page; only `PAGES_AT_ONCE` pages of a batch are Python strings at a time, the rest stay Arrow's bytes."""
    kind = pa.list_(pa.string())
    found = [
        pa.array([_cells(page.as_py() or "") for page in html.slice(at, PAGES_AT_ONCE)], kind)
        for at in range(0, len(html), PAGES_AT_ONCE)
    ]
    return pa.concat_arrays(found) if found else pa.array([], kind)


def cell_text(cell: Column) -> Column:
    """Text nodes of a cell, each stripped, one per line; scripts and styles are left out."""
    clean = F.regexp_replace(cell, r"(?is)<(script|style|ignore_js_op)\b[^>]*>.*?</\1>", "")
    nodes = F.transform(F.split(F.regexp_replace(clean, r"(?s)<!--.*?-->|<[^>]+>", "\x00"), "\x00"), lambda n: strip(unescape(n)))
    return F.regexp_replace(F.array_join(F.filter(nodes, lambda n: n != ""), "\n"), r"\n{3,}", "\n\n")


def thread_listings(pages: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """Company listing pages to thread rows, first of equal ids over all pages.

    A listing's date is the last <time title> before its anchor. A page may come in parts, each with the number of
    `marks` before it and the date (`dated`) that they leave. `kept` names columns of a page that its rows keep.
    """
    groups = [
        F.regexp_extract_all(filled("payload"), F.lit(fixed.LISTING_MARK), F.lit(g)).alias(n)
        for g, n in ((1, "time"), (2, "url"), (3, "tid"), (4, "body"))
    ]
    company = F.col("company") if "company" in pages.columns else F.lit(None).cast("string")
    in_parts = "marks" in pages.columns
    before = F.col("marks") if in_parts else F.lit(0)
    left = F.col("dated") if in_parts else F.lit("")
    dealt = pages.select(
        company.alias("company"), "page", "payload", before.alias("_before"), left.alias("_left"), *kept, F.xxhash64("payload").alias("_text")
    ).repartition("company", "page", "_before", "_text")
    marks = dealt.select("company", "page", "_before", "_left", *kept, "_text", F.posexplode(F.arrays_zip(*groups)).alias("_at", "a")).withColumn("at", F.col("_before") + F.col("_at"))
    # The last date is carried on to the anchors behind it along the page's marks, which one sort puts in order.
    behind = Window.partitionBy("company", "page", "_before", "_text").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_time = F.col("a")["tid"] == ""
    dated = marks.withColumn("time", filled(F.coalesce(F.last(F.when(is_time, F.col("a")["time"]), ignorenulls=True).over(behind), "_left")))
    found = dated.filter(~is_time)
    body = F.col("a")["body"]
    title = F.regexp_extract(body, fixed.LISTING_TITLE, 1)
    tagged = F.regexp_extract(body, fixed.LISTING_TAGS, 1)
    tags = F.filter(
        F.transform(F.regexp_extract_all(tagged, F.lit(r"(?s)<span[^>]*>(.*?)</span>"), F.lit(1)), lambda s: strip(unescape(F.regexp_replace(s, "<[^>]+>", "")))),
        lambda s: (s != "") & (F.length(s) <= 30) & ~s.contains("\n"),
    )
    rows = found.select(
        "company", "page", "at", F.col("a")["tid"].alias("tid"), F.col("a")["url"].alias("url"),
        strip(unescape(F.regexp_replace(title, "<[^>]+>", ""))).alias("title"), tags.alias("tags"),
        F.col("time").alias("posted_at"),
        F.lit(None).cast("int").alias("messages"), F.lit(None).cast("int").alias("likes"), *kept,
    ).filter("title != ''")
    return top_k(rows, ["tid"], [F.col("page"), F.col("at")], 1)


def before_cutoff(listings: DataFrame, cutoff: Column, company: str = "company") -> DataFrame:
    """Each company's listing up to its first thread older than the cutoff; undated threads stay.

    The stop is one row per company; the smaller side of the join is broadcast only where Spark
    finds it small.
    """
    posted = F.regexp_replace("posted_at", " ", "T").try_cast("timestamp")
    stops = listings.filter(posted < cutoff).groupBy(F.col(company).alias("_company")).agg(F.min(F.struct("page", "at")).alias("_stop"))
    met = listings.join(stops, F.col(company).eqNullSafe(F.col("_company")), "left")
    return met.filter(F.col("_stop").isNull() | (F.struct("page", "at") < F.col("_stop"))).drop("_company", "_stop")


def thread_fields(pages: DataFrame) -> DataFrame:
    """Thread pages (`tid`, `payload`): first post, replies and head data; replies joined once."""
    html = filled("payload")
    cells = pages.withColumn("cells", post_cells("payload")).withColumn("texts", F.transform("cells", cell_text))
    body = F.coalesce(F.try_element_at("texts", F.lit(1)), F.lit(""))
    replies = F.filter(F.slice("texts", 2, F.greatest(F.size("texts"), F.lit(1))), lambda r: r != "")
    heading = strip(unescape(F.regexp_replace(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " ")))
    tab = strip(unescape(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1)))
    owner = F.regexp_extract(html, fixed.THREAD_OWNER, 1)
    profile = strip(F.regexp_replace(F.regexp_extract(owner, fixed.THREAD_PROFILE, 1), "<[^>]+>", ""))
    plain = collapse_ws(F.substring_index(unescape(F.regexp_replace(owner, "<[^>]+>", " ")), "发表于", 1))
    posted = strip(unescape(F.regexp_replace(F.regexp_extract(html, fixed.THREAD_POSTED, 1), "<[^>]+>", "")))
    clock = F.regexp_extract(posted, fixed.THREAD_CLOCK, 1)
    return cells.select(
        "tid",
        F.when(heading != "", strip(F.regexp_replace(heading, r"^\[[^\]]+\]\s*", ""))).otherwise(tab).alias("title"),
        F.coalesce(present(profile), present(F.regexp_extract(plain, fixed.THREAD_OWNER_DATED, 1)), F.substring_index(plain, " ", 1)).alias("author"),
        first_present(clock, posted).alias("posted_at"),
        F.concat_ws("\n\n---\n\n", F.array(body), replies).alias("body"), body.alias("op_body"),
        replies.alias("replies"), F.size(replies).alias("reply_count"),
        is_locked(F.replace(body, F.lit("\n"), F.lit(" "))).alias("locked"),
    )


def thread_posts(threads: DataFrame, listings: DataFrame, company: Column, now: Column) -> DataFrame:
    """Fetched threads with their listing to posts."""
    both = listings.select("tid", "page", "at", F.col("title").alias("_listed"), "tags").join(threads, "tid")
    stamp = F.regexp_replace("posted_at", "Z", "+00:00").try_cast("timestamp")
    return both.select(
        "page", "at",
        *post(
            "1p3a", company, source_id=F.col("tid"), title=first_present("title", "_listed"), body=F.col("body"),
            url=F.concat(F.lit("https://www.1point3acres.com/bbs/thread-"), "tid", F.lit("-1-1.html")),
            posted_at=F.coalesce(stamp, now), author=F.col("author"), reply_count=F.col("reply_count"), locked=F.col("locked"),
            raw=F.to_json(F.struct("tags")),
        ),
    )


def ranked_questions(rows: DataFrame) -> DataFrame:
    """Company question list cells (`at`, `href`, `cells`) to ranked questions, first of equal slugs."""
    slug = F.regexp_extract("href", r"/problems/([^/?#]+)", 1)
    usable = rows.filter(F.col("href").contains("envType=company") & (slug != "")).withColumn("title_slug", slug)
    once = top_k(usable, ["title_slug"], [F.col("at")], 1)
    from postmill.operators.keyed import number_rows

    parts = F.filter(F.transform(F.split(filled("cells"), "\n"), strip), lambda p: p != "")
    head = F.try_element_at("parts", F.lit(1))
    numbered = r"^\s*(\d+)\.\s*(.+?)\s*$"
    label = F.lit(None).cast("string")
    for shown, name in fixed.DIFFICULTY_LABELS.items():
        label = F.when(F.col("_d") == shown, name).otherwise(label)
    share = F.try_element_at(F.filter("parts", lambda p: p.rlike(r"^\d+\.?\d*\s*%$")), F.lit(1))
    ranked = number_rows(once, [F.col("at").asc()], "idx").withColumn("parts", parts)
    named = ranked.withColumn(
        "_d", F.try_element_at(F.filter("parts", lambda p: p.isin(*fixed.DIFFICULTY_LABELS)), F.lit(1))
    )
    return named.select(
        F.col("idx").cast("int").alias("idx"), F.col("idx").cast("int").alias("rank"),
        F.coalesce(F.regexp_extract(filled(head), numbered, 1).try_cast("int"), F.lit(0)).alias("lc_number"),
        F.coalesce(present(F.regexp_extract(filled(head), numbered, 2)), head, F.initcap(F.replace("title_slug", F.lit("-"), F.lit(" ")))).alias("title"),
        "title_slug", F.coalesce(label, F.lit("Unknown")).alias("difficulty"),
        F.regexp_extract(share, r"^(\d+\.?\d*)", 1).try_cast("double").alias("acceptance"),
        F.concat(F.lit("https://leetcode.com/problems/"), "title_slug", F.lit("/")).alias("url"),
    )


def question_details(pages: DataFrame) -> DataFrame:
    """Rendered question pages (`url`, `payload`): heading, difficulty, tags, and the statement as markup and as text.

    The heading is the first link to a question, else the first h1, else the page's title. The statement is
    the first of three containers that the page has, with all that is nested in it; empty without one.
    """
    html = filled("payload")
    link = r'(?is)<a\b[^>]*\bhref="/problems/[^"]*"[^>]*>(.*?)</a>'
    named = F.when(html.rlike(link), F.regexp_extract(html, link, 1)).otherwise(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    tags = F.transform(F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*\bhref="/tag/[^"]*"[^>]*>(.*?)</a>'), F.lit(1)), strip_tags)
    statement = F.coalesce(*[inner_markup("payload", mark) for mark in fixed.QUESTION_STATEMENT], F.lit(""))
    read = pages.select(
        "url", first_present(strip_tags(named), page_title("payload")).alias("heading"),
        strip_tags(inner_markup("payload", fixed.QUESTION_DIFFICULTY)).alias("difficulty"),
        F.filter(tags, lambda t: t != "").alias("tags"), statement.alias("statement_html"),
    )
    return read.withColumn("statement_text", html_to_text("statement_html"))


def source_config(name: str, slug: str | None = None, overrides: dict[str, dict] | None = None) -> dict[str, dict]:
    """Settings per source of one company: defaults, overridden, disabled ones dropped."""
    short = slug or re.sub(r"[^a-z0-9]+", "-", name.strip().lower()).strip("-")
    terms = {"search_terms": [f"{name} interview", f"{name} OA"]}
    defaults = {"1p3a": {"slug": short}, "leetcode": terms, "reddit": terms, "glassdoor": {"slug": short}}
    merged = {s: {**base, **(overrides or {}).get(s, {})} for s, base in defaults.items()}
    return {
        s: {k: v for k, v in settings.items() if k != "enabled"}
        for s, settings in merged.items()
        if settings.get("enabled") is not False
    }


def all_posts(sources: Sequence[DataFrame]) -> DataFrame:
    """Bag union of sources in the one Post shape."""
    out = sources[0].select(*POST_COLUMNS)
    for other in sources[1:]:
        out = out.unionByName(other.select(*POST_COLUMNS))
    return out
