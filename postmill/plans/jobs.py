"""Alert ingest, target scan, merge, resolution and triage as composed DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import fixed_values as fixed
from postmill.functions.payload import description, json_ld_posting
from postmill.functions.text import collapse_ws, filled, first_of_equal, first_present, linkedin_description, norm, scored_filename
from postmill.functions.titles import looks_like_job_page
from postmill.functions.urls import is_http, is_linkedin, is_linkedin_job
from postmill.operators import keyed, matching, rules
from postmill.sources import mail
from postmill.sources.boards import ADAPTERS


@dataclass(frozen=True)
class ScanRules:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    own: dict[str, dict[str, Sequence[str]]] = field(default_factory=dict)
    city: rules.CityRules = rules.CityRules()
    max_details: int = 60


def ingest_alerts(messages: DataFrame, seen: DataFrame, now: Column, include_seen: bool = False) -> tuple[DataFrame, DataFrame]:
    """Alert mails to (new jobs, next seen-state). New means unknown before this run."""
    jobs = mail.finalize(mail.alert_jobs(messages), now).withColumn("_row", F.struct("ordinal", "at"))
    once = keyed.keep_first(jobs, ["job_key"], "_row")
    attributes = ["title", "company", "location", "linkedin_url", "jobright_url", "external_jd_url"]
    entering = once.withColumn("external_jd_url", F.lit(""))
    state = keyed.upsert_seen(seen, entering, ["job_key"], now, "_row", attributes)
    fresh = once if include_seen else keyed.unseen(once, seen, ["job_key"])
    return fresh.drop("_row"), state


def scan_jobs(pages: DataFrame, specs: Sequence[dict], now: Column) -> DataFrame:
    """Fetched listing pages (company, ats, page, payload) to jobs with their `board`.

    Boards of one kind with equal settings share a branch, so the pages are read once per kind,
    not once per company. Boards without an adapter and failed pages add nothing.
    """
    kinds: dict[tuple, list[str]] = {}
    for spec in specs:
        if spec["ats"].lower() in ADAPTERS and spec.get("enabled", True):
            settings = tuple(sorted(spec.get("settings", {}).items()))
            kinds.setdefault((spec["ats"].lower(), settings), []).append(spec["name"])
    if not kinds:
        raise ValueError("no enabled board has an adapter")
    out = None
    for (ats, settings), names in kinds.items():
        own = pages.filter((F.lower("ats") == ats) & F.col("company").isin(names)).select(
            "payload", "page", F.col("company").alias("board")
        )
        jobs = ADAPTERS[ats][0](own, F.col("board"), now, **dict(settings))
        out = jobs if out is None else out.unionByName(jobs)
    return out


def scan_targets(
    jobs: DataFrame, seen: DataFrame, scan: ScanRules, now: Column, include_seen: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Title filter, place filter, then the unseen ones, with the next seen-state.

    The state takes in everything that passed the place filter. `fetch_detail` marks the first
    rows per company that still lack text, up to the limit.
    """
    matched = jobs.filter(
        rules.title_matches_by_company("title", "board", scan.include, scan.exclude, scan.own)
        & rules.passes_city_at_scan("location", scan.city)
    ).withColumn("_row", F.struct("board", "page", "at", "job_key"))
    attributes = ["title", "company", "location", "linkedin_url", "jobright_url", "external_jd_url"]
    state = keyed.upsert_seen(
        seen, matched.withColumn("jobright_url", F.lit("")), ["job_key"], now, "_row", attributes
    )
    fresh = matched if include_seen else keyed.unseen(matched, seen, ["job_key"])
    lacking = filled("jd_text") == ""
    chosen = keyed.top_k(
        fresh.filter(lacking).select("board", "_row"), ["board"], [F.col("_row").asc()], scan.max_details
    ).select(F.col("_row").alias("_pick"))
    marked = fresh.join(chosen, F.col("_row") == F.col("_pick"), "left")
    return marked.withColumn("fetch_detail", F.col("_pick").isNotNull()).drop("_pick", "_row"), state


def band_gate(jobs: DataFrame, levels: rules.LevelRules) -> DataFrame:
    """Level tier and band; jobs outside the band are settled here, before anything costly."""
    tiered = jobs.withColumn("level_tier", rules.tier_of("title", "company", levels))
    banded = tiered.withColumn("level_band_verdict", rules.band_of(F.col("level_tier"), levels))
    return banded.withColumn("external_jd_status", rules.band_status(F.col("level_band_verdict")))


def resolve_on_boards(jobs: DataFrame, openings: DataFrame, resolvers: dict[str, tuple[str, str]]) -> DataFrame:
    """Banded jobs (job_key unique) matched against openings of their company's board.

    `openings`: board, ordinal, title, location, url, description, source. Jobs without a
    winner that passes all gates stay unresolved.
    """
    spec = rules.resolver_for("company", resolvers)
    wanted = jobs.filter("external_jd_status = 'unresolved'").select(
        F.col("job_key").alias("job_id"), spec["board"].alias("board"), "title", "location"
    ).filter("board IS NOT NULL")
    won = matching.gated_matches(wanted, openings, carry=("url", "description", "source")).withColumnRenamed("source", "_via")
    found = jobs.join(won.drop("board").withColumnRenamed("job_id", "job_key"), "job_key", "left")
    hit = F.col("opening").isNotNull()
    return found.select(
        *[c for c in jobs.columns if c != "external_jd_status"],
        F.when(hit, "resolved").otherwise(F.col("external_jd_status")).alias("external_jd_status"),
        filled("url").alias("external_jd_url"), filled("_via").alias("external_jd_source"),
        filled("description").alias("jd_text"),
        F.substring(filled("description"), 1, fixed.PREVIEW_CHARS).alias("jd_text_preview"),
        first_present("opening_title", "title").alias("jd_title"), filled("company").alias("jd_company"),
        first_present("opening_location", "location").alias("jd_location"),
        F.concat(F.lit("match_score="), F.col("match_score").cast("string")).alias("direct_resolver_debug"),
    )


def external_candidates(jobs: DataFrame) -> DataFrame:
    """Outside links of each job with the column they came from, first of equal URLs."""
    tagged = F.concat(
        F.transform(F.coalesce("external_candidates", F.array().cast("array<string>")), lambda u: F.struct(u.alias("url"), F.lit("external_candidates").alias("source"))),
        F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda u: F.struct(u.alias("url"), F.lit("links").alias("source"))),
    )
    usable = F.filter(tagged, lambda t: is_http(t["url"]) & ~is_linkedin(t["url"]))
    first = first_of_equal(usable, lambda t: t["url"])
    return jobs.select("job_key", F.posexplode(first).alias("place", "c")).select("job_key", "place", "c.url", "c.source")


def resolve_from_pages(jobs: DataFrame, fetched: DataFrame, allowed: Sequence[str] = fixed.DEFAULT_SEARCH_DOMAINS) -> DataFrame:
    """First candidate page per job that holds a real posting.

    `jobs`: job_key, title, company, location. `fetched`: job_key, place, url, source, html.
    """
    read = fetched.withColumn("d", description("html", json_ld_posting("html"))).filter(
        F.length(collapse_ws("d.text")) >= fixed.MIN_DESCRIPTION_CHARS
    )
    judged = read.join(jobs.select("job_key", "title", "company", "location"), "job_key").filter(
        looks_like_job_page(
            F.col("title"), F.col("company"), F.col("url"), F.col("html"), F.col("d.text"), F.col("d.title"),
            F.col("d.parser"), allowed,
        )
    )
    return keyed.top_k(judged, ["job_key"], [F.col("place").asc()], 1).select(
        "job_key", F.lit("resolved").alias("external_jd_status"), F.col("url").alias("external_jd_url"),
        F.col("source").alias("external_jd_source"), F.col("d.text").alias("jd_text"),
        F.col("d.parser").alias("jd_parser"), first_present("d.title", "title").alias("jd_title"),
        first_present("d.company", "company").alias("jd_company"), first_present("d.location", "location").alias("jd_location"),
    )


def resolve_from_public_page(jobs: DataFrame, fetched: DataFrame) -> DataFrame:
    """Last resort: the public posting page. `fetched`: job_key, linkedin_url, html."""
    text = linkedin_description("html")
    read = fetched.filter(is_linkedin_job("linkedin_url")).withColumn("jd_text", text)
    return read.filter(F.length(collapse_ws("jd_text")) >= fixed.MIN_DESCRIPTION_CHARS).join(
        jobs.select("job_key", "title", "company", "location"), "job_key"
    ).select(
        "job_key", F.lit("linkedin_public").alias("external_jd_status"), F.col("linkedin_url").alias("external_jd_url"),
        F.lit("linkedin_public").alias("external_jd_source"), "jd_text", F.lit("linkedin_markup").alias("jd_parser"),
        F.col("title").alias("jd_title"), F.col("company").alias("jd_company"), F.col("location").alias("jd_location"),
    )


def triage_candidates(jobs: DataFrame, ordinal: str) -> DataFrame:
    """Resolved jobs, first per (url, title), with how many alerts named them."""
    resolved = jobs.filter(F.col("external_jd_status").isin(*fixed.RESOLVED_STATUSES))
    keyed_jobs = resolved.withColumns(
        {"_url": norm("external_jd_url"), "_title": norm(first_present("jd_title", "title"))}
    )
    return keyed.first_with_count(keyed_jobs, ["_url", "_title"], ordinal, "duplicate_count").drop("_url", "_title")


def geo_split(jobs: DataFrame, geo: rules.GeoRules, city: rules.CityRules) -> DataFrame:
    """`route`: non_us, city_filtered or kept."""
    place = first_present("jd_location", "location")
    us = rules.us_location(place, geo)["is_us"]
    return jobs.withColumn(
        "route",
        F.when(~us, "non_us").when(~rules.passes_city_at_triage(place, city), "city_filtered").otherwise("kept"),
    )


def note_routing(scored: DataFrame) -> DataFrame:
    """Note name and folder of each scored job; 70 and below is low."""
    company, title = first_present("jd_company", "company"), first_present("jd_title", "title")
    return scored.withColumns(
        {
            "note_name": scored_filename(None, company, title),
            "opportunity_filename": scored_filename(F.col("match_score"), company, title),
            "folder": F.when(F.col("match_score") <= 70, "Filtered/Low Score").otherwise(""),
        }
    )
