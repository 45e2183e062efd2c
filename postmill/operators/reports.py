"""Counts, verdicts, note lookup and report text as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import fixed_values as fixed
from postmill.functions.text import filled, first_present, note_front_matter, note_link, strip
from postmill.operators.keyed import top_k


def source_counts(messages: DataFrame, source: Column) -> DataFrame:
    return messages.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("messages"))


def resolved_counts(jobs: DataFrame, accepted: Sequence[str] = fixed.RESOLVED_STATUSES) -> DataFrame:
    hit = F.coalesce(F.col("external_jd_status").isin(*accepted), F.lit(False))
    return jobs.agg(
        F.count(F.lit(1)).alias("job_count"), F.count_if(hit).alias("resolved_count"),
        F.count_if(~hit).alias("unresolved_count"),
    )


def resolved_by_set(jobs: DataFrame) -> DataFrame:
    """Resolved jobs under each of the accepted sets: right after enriching, in the report, in triage."""

    def among(accepted: Sequence[str], name: str) -> Column:
        return F.count_if(F.coalesce(F.col("external_jd_status").isin(*accepted), F.lit(False))).alias(name)

    return jobs.agg(
        F.count(F.lit(1)).alias("job_count"), among(fixed.RESOLVED_STATUSES_ENRICH, "enriched"),
        among(fixed.RESOLVED_STATUSES_REPORT, "reported"), among(fixed.RESOLVED_STATUSES, "triaged"),
    )


def passing_jobs(classified: DataFrame) -> DataFrame:
    """What goes on to the resolver: rows the rules let pass."""
    return classified.filter(F.col("filter_status") == "passes_rules")


def scored_for_report(scored: DataFrame, ready: DataFrame) -> DataFrame:
    """Scored jobs with the names of their ready entry, the last one of equal keys; errored and unknown ones drop out.

    `scored`: job_key, score, note (a path), error. `ready`: job_key, company, title, ordinal.
    """
    last = ready.groupBy("job_key").agg(F.max_by(F.struct(filled("company").alias("company"), filled("title").alias("title")), "ordinal").alias("_r"))
    return scored.filter(F.col("error").isNull()).join(last, "job_key").select(
        "job_key", "_r.company", "_r.title", F.coalesce("score", F.lit(0)).alias("score"), F.lit("").alias("verdict"),
        F.regexp_extract(F.regexp_replace("note", "/+$", ""), r"([^/]*)$", 1).alias("opportunity_filename"),
    )


def daily_report_lines(day: str, counts: DataFrame, awaiting: DataFrame, scored: DataFrame, filtered: DataFrame) -> DataFrame:
    """The daily report as rows (section, part, at, line): order by the first three to write it.

    `counts` is the one row of `funnel`. `awaiting`, `scored` and `filtered` carry an `ordinal`; their
    numbers come from themselves. Sections stay rows, so none is gathered in a task; an empty one
    has its placeholder.
    """
    counted = [
        part.agg(F.count(F.lit(1)).alias(name))
        for name, part in (("awaiting_count", awaiting), ("scored_count", scored), ("filtered_count", filtered))
    ]
    known = counts.select("raw_count", "unique_count", "passes_count", "resolved_count")
    for one in counted:
        known = known.unionByName(one, allowMissingColumns=True)
    totals = known.agg(*[F.sum(c).alias(c) for c in known.columns])

    def number(name: str) -> Column:
        return F.col(name).cast("string")

    def fixed_line(section: int, part: int, at: int, line: Column | str) -> Column:
        text = F.lit(line) if isinstance(line, str) else line
        return F.struct(F.lit(section).alias("section"), F.lit(part).alias("part"), F.lit(at).cast("bigint").alias("at"), text.alias("line"))

    head = [fixed_line(0, 0, i, t) for i, t in enumerate((f"# Job Report — {day}", "", "## Pipeline Summary", "", "| Metric | Count |", "|---|---|"))]
    table = [
        fixed_line(0, 1, i, F.concat(F.lit(f"| {label} | "), number(name), F.lit(" |"))) for i, (name, label) in enumerate(fixed.REPORT_COUNTS)
    ]

    def title(section: int, text: str, name: str, *more: str) -> list[Column]:
        opening = fixed_line(section, 0, 1, F.concat(F.lit(f"## {text} ("), number(name), F.lit(")")))
        return [fixed_line(section, 0, 0, ""), opening, *[fixed_line(section, 0, 2 + i, line) for i, line in enumerate(("", *more))]]

    def none(section: int, name: str, text: str) -> Column:
        return F.when(F.col(name) == 0, fixed_line(section, 1, 0, text))

    frame = [
        *head, *table,
        *title(1, "Awaiting your JD", "awaiting_count"), none(1, "awaiting_count", "_No new jobs awaiting JD this run._"),
        *title(2, "Scored today", "scored_count"), none(2, "scored_count", "_No jobs scored this run._"),
        *title(3, "Filtered out", "filtered_count", "<details>", "<summary>Click to expand</summary>", ""),
        none(3, "filtered_count", "_None._"), fixed_line(3, 2, 0, ""), fixed_line(3, 2, 1, "</details>"),
    ]
    still = totals.select(F.explode(F.array_compact(F.array(*frame))).alias("x")).select("x.*")

    def listed(section: int, rows: DataFrame, *line: Column) -> DataFrame:
        return rows.select(
            F.lit(section).alias("section"), F.lit(1).alias("part"), F.col("ordinal").cast("bigint").alias("at"), F.concat(*line).alias("line")
        )

    who, role = filled("company"), filled("title")
    note = F.regexp_replace("opportunity_filename", r"(?s)...\z", "")
    score = F.coalesce(F.col("score").cast("string"), F.lit("?"))
    return (
        still.unionByName(listed(1, awaiting, F.lit("- [[Pending JDs#"), who, F.lit(" — "), role, F.lit("]]")))
        .unionByName(listed(2, scored, F.lit("- [[Opportunities/"), note, F.lit("]] — "), score, F.lit(", "), F.coalesce("verdict", F.lit("?"))))
        .unionByName(listed(3, filtered, F.lit("- "), who, F.lit(" — "), role, F.lit(" ("), filled("filter_reason"), F.lit(")")))
    )


def split_resolved(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    hit = F.coalesce(F.col("external_jd_status").isin(*fixed.RESOLVED_STATUSES), F.lit(False))
    return jobs.filter(hit), jobs.filter(~hit)


def funnel(raw: DataFrame, classified: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row: raw, unique, filtered, passing, resolved. Unique falls back to raw when nothing was judged."""
    judged = classified.agg(
        F.count_if(F.col("filter_status") == "passes_rules").alias("passes_count"),
        F.count_if(F.col("filter_status") == "filtered_out").alias("filtered_count"),
    )
    done = enriched.agg(
        F.count_if(F.col("external_jd_status").isin(*fixed.RESOLVED_STATUSES_REPORT)).alias("resolved_count")
    )
    parts = raw.agg(F.count(F.lit(1)).alias("raw_count"))
    for part in (judged, done):
        parts = parts.unionByName(part, allowMissingColumns=True)
    counted = parts.agg(*[F.sum(c).alias(c) for c in parts.columns])
    both = F.col("passes_count") + F.col("filtered_count")
    return counted.withColumn("unique_count", F.when(both > 0, both).otherwise(F.col("raw_count")))


def verdict_counts(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    names = ("strong", "medium", "weak")
    counts = [F.count_if(F.col("verdict") == f"{n}_match").alias(n) for n in names]
    return scored.groupBy(*keys).agg(*counts) if keys else scored.agg(*counts)


def top_strong(scored: DataFrame, keys: Sequence[str], ordinal: str, k: int = 5) -> DataFrame:
    strong = scored.filter(F.col("verdict") == "strong_match")
    return top_k(strong, keys, [F.col("match_score").desc(), F.col(ordinal).asc()], k, rank="place")


def report_lines(scored: DataFrame, unresolved: DataFrame, ordinal: str) -> DataFrame:
    """Daily report body as ordered rows: scored notes by score, then what stayed unresolved."""
    twice = F.coalesce(F.col("duplicate_count"), F.lit(1))
    notes = scored.select(
        F.lit(1).alias("section"), (-F.col("match_score")).cast("bigint").alias("rank"), F.col(ordinal).alias("at"),
        F.concat(
            F.lit("- **"), F.col("match_score").cast("string"), F.lit("** · "), "verdict", F.lit(" · "),
            note_link(F.col("opportunity_filename")),
            F.when(twice > 1, F.concat(F.lit(" | alerts="), twice.cast("string"))).otherwise(""),
        ).alias("line"),
    )
    rest = unresolved.select(
        F.lit(2).alias("section"), F.lit(0).cast("bigint").alias("rank"), F.col(ordinal).alias("at"),
        F.concat(F.lit("- "), F.concat_ws(" | ", filled("company"), filled("title"), filled("location"))).alias("line"),
    )
    return notes.unionByName(rest)


def existing_notes(jobs: DataFrame, notes: DataFrame) -> DataFrame:
    """For each job the note it already has: exact name before a scored one, directory by directory.

    `jobs`: job_key, note_name (bare). `notes`: directory_rank, file_name.
    """
    bare = notes.select(
        "directory_rank", "file_name", F.regexp_replace("file_name", r"^\d{2,3} - ", "").alias("_bare"),
        F.lit(1).alias("_form"),
    ).filter("_bare != file_name")
    exact = notes.select("directory_rank", "file_name", F.col("file_name").alias("_bare"), F.lit(0).alias("_form"))
    best = (
        exact.unionByName(bare)
        .groupBy("_bare")
        .agg(F.min(F.struct("_form", "directory_rank", "file_name")).alias("_note"))
    )
    return jobs.join(best, F.col("note_name") == F.col("_bare"), "left").select(
        *jobs.columns, F.col("_note.file_name").alias("existing"), F.col("_note.directory_rank").alias("existing_rank")
    )


def bullet_lines(items: Column, limit: int = 6) -> Column:
    shown = F.transform(F.slice(items, 1, limit), lambda i: F.concat(F.lit("- "), i))
    return F.when(F.size(items) > 0, F.array_join(shown, "\n")).otherwise("- None captured")


def opportunity_note(score: Column, verdict: Column, mode: Column) -> Column:
    """Head of a note for the job columns in scope."""
    company, role = first_present("jd_company", "company"), first_present("jd_title", "title")
    rows = (
        ("Company", company), ("Role", role), ("Location", first_present("jd_location", "location")),
        ("Source", filled("external_jd_source")), ("JD URL", filled("external_jd_url")),
    )
    body = F.concat_ws("\n", *[F.concat(F.lit(f"- **{k}:** "), v) for k, v in rows])
    return F.concat(note_front_matter(score, verdict, mode), F.lit("# "), company, F.lit(" — "), role, F.lit("\n\n"), body, F.lit("\n"))


def review_section(run_label: str, excerpt_chars: int | None = None) -> Column:
    """One scoring run as a note section, from the triage columns in scope; the text whole or its first `excerpt_chars` (2500 is usual)."""
    excerpt = first_present("jd_text_preview", "jd_text")
    excerpt = strip(excerpt if excerpt_chars is None else F.substring(excerpt, 1, excerpt_chars))
    parts = (
        ("Top strengths", bullet_lines(F.col("top_strengths"))), ("Key gaps", bullet_lines(F.col("key_gaps"))),
        ("Quick recommendation", filled("quick_recommendation")), ("JD summary", filled("jd_summary")),
        ("JD excerpt", excerpt),
    )
    head = F.concat(
        F.lit(f"## Review — {run_label}\n\n- **Match score:** "), F.col("match_score").cast("string"),
        F.lit("\n- **Verdict:** "), F.coalesce("verdict", F.lit("unknown")),
    )
    return F.concat_ws("\n\n", head, *[F.concat(F.lit(f"### {k}\n"), v) for k, v in parts])


#: Openings that a notification names.
TOP_NAMED = 5


def summary_message(report_date: str, counts: DataFrame, top: DataFrame) -> DataFrame:
    """The run's notification, one row, at most 2000 characters; names the first five of `top`, however many it has."""
    names = top.orderBy("place").limit(TOP_NAMED).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("place", "company", "title", "match_score"))),
                lambda r: F.concat(r["company"], F.lit(" "), r["title"], F.lit(" ("), r["match_score"].cast("string"), F.lit(")")),
            ),
            ", ",
        ).alias("names")
    )
    total = F.col("strong") + F.col("medium") + F.col("weak")

    named = names.scalar()

    def line(count: str, *parts: Column | str) -> Column:
        return F.when(F.col(count) > 0, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))

    text = F.concat_ws(
        "\n",
        F.concat(F.lit(f"📊 **Job Report {report_date}** — "), total.cast("string")),
        line("strong", "🔥 Strong (", F.col("strong").cast("string"), "): ", named),
        line("medium", "✅ Medium: ", F.col("medium").cast("string")),
        line("weak", "❌ Weak: ", F.col("weak").cast("string")),
    )
    mark = "\n…（截断）"
    short = F.when(F.length(text) > 2000, F.concat(F.substring(text, 1, 1980), F.lit(mark))).otherwise(text)
    return counts.select(short.alias("message"))


def thread_block(title: Column, url: Column, author: Column, posted_at: Column, tags: Column, fetched_at: str) -> Column:
    """Head lines of a thread's Markdown block."""
    marks = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("`"), t, F.lit("`"))), " ")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("## "), first_present(posted_at, F.lit("日期未注明")), F.lit(" · ["), title, F.lit("]("), url, F.lit(")")),
        F.concat(F.lit(f"**抓取**: {fetched_at} · **作者**: "), first_present(author, F.lit("匿名"))),
        F.when(F.size(tags) > 0, F.concat(F.lit("**标签**: "), marks)),
    )


def run_counters(outcomes: DataFrame) -> DataFrame:
    """Per company: new, locked and failed threads; exit status 2 when anything failed."""
    per = outcomes.groupBy("company_slug").agg(
        F.count_if(F.col("summary_status") == "ok").alias("new_count"),
        F.count_if(F.col("summary_status") == "locked").alias("locked_count"),
        F.count_if(F.col("summary_status").endswith("_error")).alias("error_count"),
    )
    return per.withColumn("exit_status", F.when(F.col("error_count") > 0, 2).otherwise(0))
