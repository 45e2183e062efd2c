"""Course archive operators over documents, events, parts and pages."""

from pyspark.sql import functions as F

from postmill.catalog.registry import query, spread_table, table
from postmill.operators import archive as a


# Where a document lies in the archive: flat, in a folder by source, among assets, or as a folder's README.
FOLDER = "CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'images' ELSE coalesce(source, 'none') END"
STEM = "CASE WHEN doc_id % 13 = 5 THEN 'README' ELSE coalesce(lang, 'xx') || ' ' || doc_id END"
INDEX = "CASE WHEN doc_id % 11 = 4 THEN 'soon' ELSE CAST(doc_id % 97 AS STRING) END"


def archived(spark, sf):
    """Each document as an archived Markdown file: with all fields, some or none before its whole text."""
    head = f"""CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('---\ncourse: World\nsection: "Part ', doc_id, '"\nchapter: Topic ', doc_id % 40, '\nsection_idx: ', {INDEX}, '\n---\n')
      ELSE concat('---\nsection_idx: ', {INDEX}, '\ncourse:\n---\nsection: no\n') END"""
    note = F.concat(F.expr(head), F.coalesce("text", F.lit("")))
    path = F.concat_ws("/", F.nullif(F.expr(FOLDER), F.lit("")), F.concat(F.expr(STEM), F.lit(".md")))
    return a.sections(table(spark, sf, "documents").select(note.alias("value"), path.alias("rel_path")))


SECTIONS = f"""
WITH placed AS (SELECT doc_id % 3 AS fields, {FOLDER} AS chapter_dir, {STEM} AS stem, TRY_CAST({INDEX} AS INTEGER) AS idx, doc_id FROM documents),
s AS (SELECT chapter_dir, stem || '.md' AS section_file, CASE WHEN fields = 1 THEN 'Part ' || doc_id ELSE stem END AS title,
  CASE WHEN fields = 1 THEN 'Topic ' || doc_id % 40 WHEN chapter_dir = '' THEN 'Sections' ELSE chapter_dir END AS chapter,
  CASE WHEN fields = 0 THEN 999 ELSE coalesce(idx, 999) END AS section_idx, CASE WHEN fields = 1 THEN 'World' END AS course,
  CASE WHEN chapter_dir = '' THEN '' ELSE chapter_dir || '/' END || stem AS place
  FROM placed WHERE stem <> 'README' AND chapter_dir <> 'images')
"""


@query("archived_sections", SECTIONS + "SELECT chapter_dir, section_file, title, chapter, section_idx, course FROM s")
def archived_sections(spark, sf):
    return archived(spark, sf).select("chapter_dir", "section_file", "title", "chapter", "section_idx", "course")


@query(
    "chapter_index",
    SECTIONS
    + """SELECT first.chapter_dir AS chapter_dir, CAST(0 AS INTEGER) AS kind, first.section_idx AS idx, '### ' || chapter AS line FROM (
    SELECT chapter, min(struct_pack(chapter_dir, section_idx, section_file)) AS first FROM s GROUP BY chapter)
  UNION ALL SELECT chapter_dir, 1, section_idx, '- [[' || place || '|' || title || ']]' FROM s""",
)
def chapter_index(spark, sf):
    lines = a.chapter_index(archived(spark, sf)).orderBy("chapter_at", "kind", "at")
    return lines.select("at.chapter_dir", "kind", F.col("at.section_idx").alias("idx"), "line")


@query(
    "progress_counts",
    """
SELECT count(*) FILTER (WHERE event_type = 'click') AS archived, count(*) AS total FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def progress_counts(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("user_id").alias("section_idx"), "event_id",
        F.when(F.col("event_type") == "click", "ok").otherwise("partial").alias("status"),
    )
    return a.progress_counts(log, "event_id")


def course_page(parts):
    """HTML and visible text of a made-up lesson around each part's own names."""
    html = F.concat(
        F.lit("<nav><h3>"), "p_name", F.lit("</h3></nav><h2 class='x'> "), "p_name",
        F.lit(" </h2><pre><code>def f():\n  return &quot;"), "p_brand", F.lit('&quot;</code></pre><img src="/logo.png" alt="l">'),
        F.lit('<img class="c" src="/_next/image?url=%2Fimages%2Fcourses%2F'), F.col("p_partkey").cast("string"),
        F.lit('.png&w=1" alt="Alt of '), "p_type", F.lit('. And more text."/>'),
    )
    body = F.concat(
        F.lit("02\nLesson "), "p_name", F.lit("\nFigure 1\n"), "p_name", F.lit("\ndef f():\n  return \""), "p_brand",
        F.lit('"\na\tb\tc\n1\t2\nx\ty\tz\n1\t2\t3\nFigure 1 again\nFigure 9\nend'),
    )
    return parts.select("p_partkey", html.alias("html"), body.alias("body"))


@query(
    "page_features",
    """
SELECT p_partkey, p_name || '=2' AS headings, 'def f():' || chr(10) || '  return "' || p_brand || '"' AS code, 'python' AS language,
  '/images/courses/' || p_partkey || '.png' AS image_path, 'https://c.example/images/courses/' || p_partkey || '.png' AS image_url,
  '07-slug-fig1.png' AS image_file FROM part""",
)
def page_features(spark, sf):
    pages = course_page(spread_table(spark, sf, "part")).select(
        "p_partkey", a.headings("html").alias("h"), a.code_blocks("html").alias("c"), a.images("html", "https://c.example/").alias("i")
    )
    return pages.select(
        "p_partkey",
        F.array_join(F.transform("h", lambda h: F.concat(h["text"], F.lit("="), h["level"].cast("string"))), ",").alias("headings"),
        F.array_join("c", "|").alias("code"), a.guess_language(F.element_at("c", 1)).alias("language"),
        F.array_join(F.transform("i", lambda i: i["path"]), "|").alias("image_path"),
        F.array_join(F.transform("i", lambda i: i["url"]), "|").alias("image_url"),
        F.array_join(a.image_filenames(F.col("i"), F.lit(7), F.lit("slug")), "|").alias("image_file"),
    )


@query(
    "assembled_pages",
    """
WITH n AS (SELECT *, chr(10) AS nl, chr(10) || chr(10) AS gap FROM part)
SELECT p_partkey, 'Lesson ' || p_name AS title,
  '# Lesson ' || p_name || gap || '![Alt of ' || p_type || '.](images/f.png)' || gap || '## ' || p_name || gap || '```python' || nl || 'def f():' || nl
  || '  return "' || p_brand || '"' || nl || '```' || gap || 'a' || chr(9) || 'b' || chr(9) || 'c' || nl || '1' || chr(9) || '2' || gap
  || '| x | y | z |' || nl || '|---|---|---|' || nl || '| 1 | 2 | 3 |' || gap || 'Figure 1 again' || nl || '> *Figure 9 — image not captured*' || nl || 'end' AS markdown,
  CAST(1 AS INTEGER) AS images, CAST(1 AS INTEGER) AS code_blocks, CAST(1 AS INTEGER) AS tables, CAST(1 AS INTEGER) AS headings
FROM n""",
)
def assembled_pages(spark, sf):
    pages = course_page(spread_table(spark, sf, "part"))
    done = pages.select(
        "p_partkey", a.assemble(F.col("body"), F.col("html"), F.array(F.lit("f.png")), "https://c.example").alias("m")
    )
    return done.select("p_partkey", "m.*")
