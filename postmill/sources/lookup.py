"""The lookup side of boards: their pages through a cache, and the openings on them for scored matching.

Pages are kept by board in a bucketed table with the time of their fetching. A run fetches the boards
that its jobs need and that the table lacks or holds too old, one task per board; all other
jobs of those boards, in this run and later ones, read the table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.payload import smartrecruiters_text
from postmill.functions.text import collapse_ws, filled, html_to_text, present
from postmill.session import stage
from postmill.sources.boards import SMARTRECRUITERS_DETAIL, _items, ashby_openings, cursor_careers, smartrecruiters_openings
from postmill.sources.datasource import Board, PagedReader
from postmill.state import BucketedTable

#: Rows of the cache; its keys are ats and board.
CACHED = "ats string, board string, page int, payload string, error string, fetched_at timestamp"
KEYS = ["ats", "board"]


def read_through(wanted: DataFrame, cache: BucketedTable, fetch: str, now: Column, max_age_days: float = 1.0) -> DataFrame:
    """Cached pages (CACHED) of the boards `wanted` (ats, board, settings: JSON or null), fetched where they are not at hand.

    `fetch` is `module:function`, called as fetch(spec, page) as for the paged boards. A board whose fetching failed has
    an error row, is not counted as held, and is fetched again by the next run. Rows without a board are left out.
    """
    boards = wanted.filter("ats IS NOT NULL AND board IS NOT NULL").groupBy(*KEYS).agg(F.max("settings").alias("settings"))
    held = cache.read_for(boards).groupBy(*KEYS).agg(F.min("fetched_at").alias("since"), F.count("error").alias("errors"))
    fresh = held.filter((F.col("errors") == 0) & (F.col("since") >= now - F.make_dt_interval(secs=F.lit(max_age_days * 86400.0))))
    due = boards.join(fresh, KEYS, "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = PagedReader({"specs": "[]", "fetch": fetch})
        for frame in batches:
            for row in frame.itertuples():
                spec = {**json.loads(row.settings or "{}"), "name": row.board, "ats": row.ats}
                pages = [(row.ats, row.board, page, payload, error) for _, _, page, payload, error in reader.read(Board(spec))]
                # A board without any page is held as such.
                yield pd.DataFrame(pages or [(row.ats, row.board, -1, None, None)], columns=["ats", "board", "page", "payload", "error"])

    schema = "ats string, board string, page int, payload string, error string"
    spread = due.repartition(*KEYS)
    # Written out once, so that no board is fetched for a second reading.
    fetched = stage(spread.mapInPandas(run, schema).withColumn("fetched_at", now.cast("timestamp")))
    if not fetched.isEmpty():
        cache.merge(fetched, lambda old, new: old.join(new.select(*KEYS).distinct(), KEYS, "left_anti").unionByName(new))
    return cache.read_for(boards).join(boards.select(*KEYS), KEYS, "left_semi")


def greenhouse_openings(pages: DataFrame, board: str | None = None) -> DataFrame:
    """Openings of boards' pages with their text; `pages` names the board of each where `board` is not given."""
    schema = "jobs array<struct<id:string,title:string,absolute_url:string,location:struct<name:string>,content:string>>"
    j = F.col("j")
    return _items(pages, F.from_json("payload", schema)["jobs"]).select(
        (F.col("board") if board is None else F.lit(board)).alias("board"), "page", "at", j["id"].alias("id"), collapse_ws(j["title"]).alias("title"),
        filled(j["location"]["name"]).alias("location"), filled(j["absolute_url"]).alias("url"), html_to_text(j["content"]).alias("description"),
    )


def cursor_openings(pages: DataFrame, board: str, now: Column) -> DataFrame:
    """Openings linked on the careers page, the first of equal links."""
    found = cursor_careers(pages, board, now)
    return found.select(F.lit(board).alias("board"), "page", "at", F.col("ats_job_id").alias("id"), "title", "location", F.col("external_jd_url").alias("url"))


def smartrecruiters_detail(postings: DataFrame, board: str) -> DataFrame:
    """Pages of single postings (`id`, `payload`) to id, title, company, location, url and description."""
    read = postings.select("id", F.from_json("payload", SMARTRECRUITERS_DETAIL).alias("j")).filter("j IS NOT NULL")
    own = F.concat(F.lit(f"https://jobs.smartrecruiters.com/{board}/"), "id")
    return read.select(
        "id", filled("j.name").alias("title"), collapse_ws("j.company.name").alias("company"), filled("j.location.fullLocation").alias("location"),
        F.coalesce(present(F.trim("j.applyUrl")), present(F.trim("j.postingUrl")), own).alias("url"),
        smartrecruiters_text(F.col("j.jobAd.sections")).alias("description"),
    )


OPENINGS = {"greenhouse": greenhouse_openings, "ashby": ashby_openings, "smartrecruiters": smartrecruiters_openings, "cursor_careers": cursor_openings}


def not_reached(spec: dict, page: int) -> str | None:
    """A fetch for runs that must find all their boards in the cache."""
    raise ConnectionError(f"{spec['name']} is not in the cache")
