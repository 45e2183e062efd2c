"""The pending inbox: sections of one marker-delimited document as rows, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import fixed_values as fixed
from postmill.functions.text import after_marker, filled, first_present, line_after
from postmill.operators.keyed import keep_first, unseen


def section(key: Column, today: Column) -> Column:
    """One job as a section; null where the key cannot stand in a marker."""
    safe = (filled(key) != "") & ~filled(key).rlike(r"(?U)\s|-->")
    c = F.col
    head = F.concat(F.lit("<!-- JOB-START id="), key, F.lit(" first_seen="), today, F.lit(" -->"))
    lines = [
        head,
        F.concat(F.lit("## "), filled("company"), F.lit(" — "), filled("title")),
        F.lit(""),
        *[
            F.concat(F.lit(f"- **{label}**: "), value)
            for label, value in (
                ("Company", filled("company")), ("Title", filled("title")), ("Location", filled("location")),
                ("First seen", today), ("Source link", first_present("linkedin_url", "external_jd_url")),
                ("Filter verdict", filled("filter_reason")),
            )
        ],
        F.lit(""), F.lit("### Job Description"), F.lit(""), F.lit(fixed.INBOX_PLACEHOLDER), F.lit(""),
        F.concat(F.lit("<!-- JOB-END id="), key, F.lit(" -->")),
    ]
    return F.when(safe, F.concat_ws("\n", *lines))


def read_sections(documents: DataFrame, text: str = "value") -> DataFrame:
    """Every section of each document: key, first_seen, body and place."""
    groups = [
        F.regexp_extract_all(filled(text), F.lit(fixed.INBOX_SECTION), F.lit(g)).alias(n)
        for g, n in ((1, "job_key"), (2, "first_seen"), (3, "body"))
    ]
    rest = [c for c in documents.columns if c != text]
    return documents.select(*rest, F.posexplode(F.arrays_zip(*groups)).alias("at", "s")).select(
        *rest, "at", "s.job_key", filled("s.first_seen").alias("first_seen"), "s.body"
    )


def ready(sections: DataFrame, minimum: int = fixed.MIN_DESCRIPTION_CHARS) -> DataFrame:
    """Sections whose pasted description is long enough, as scorable jobs."""
    text = after_marker("body", "### Job Description")
    filled_in = sections.withColumn("jd_text", text).filter(F.length("jd_text") >= minimum)
    fields = {
        "company": line_after("body", "- **Company**:"), "title": line_after("body", "- **Title**:"),
        "location": line_after("body", "- **Location**:"), "external_jd_url": line_after("body", "- **Source link**:"),
    }
    jobs = filled_in.withColumns(fields)
    return jobs.withColumns(
        {
            "external_jd_status": F.lit("user_supplied"), "external_jd_source": F.lit("pending_inbox_manual"),
            "jd_text_preview": F.substring("jd_text", 1, fixed.PREVIEW_CHARS), "jd_title": F.col("title"),
            "jd_company": F.col("company"), "jd_location": F.col("location"),
        }
    ).drop("body", "at", "first_seen")


def new_sections(jobs: DataFrame, existing: DataFrame, ordinal: str, today: Column) -> DataFrame:
    """Sections for unresolved jobs that the inbox does not hold yet; a second run adds none."""
    open_jobs = jobs.filter(
        F.coalesce("external_jd_status", F.lit("")).isin("", "unresolved") & (filled("job_key") != "")
    )
    fresh = unseen(keep_first(open_jobs, ["job_key"], ordinal), existing, ["job_key"])
    return fresh.select(ordinal, "job_key", section(F.col("job_key"), today).alias("section"))


def without_sections(document: Column, keys: Column) -> Column:
    """The document minus the sections of `keys` (an array); dividers left over collapse.

    Everything outside those marker pairs stays as the user left it.
    """
    pieces = F.regexp_extract_all(document, F.lit(r"(?s)(.*?)(<!--\s*JOB-START.*?<!--\s*JOB-END\s+id=\S+\s*-->|\z)"), F.lit(0))

    def keep(piece: Column) -> Column:
        key = F.regexp_extract(piece, r"<!--\s*JOB-START\s+id=(\S+)", 1)
        return F.when(F.array_contains(keys, key), F.regexp_replace(piece, r"(?s)<!--\s*JOB-START.*\z", "")).otherwise(piece)

    text = F.array_join(F.transform(pieces, keep), "")
    text = F.regexp_replace(text, r"\n---[ \t]*\n(?:\s*(?<=\n)---[ \t]*(?:\n|\z))+", "\n---\n\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    bare = F.regexp_replace(text, r"\n---\s*\n*\z", "\n")
    text = F.when(text.contains("JOB-START"), text).otherwise(bare)
    return F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit("\n"))
