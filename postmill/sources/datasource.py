"""A Python Data Source that pages through a listing: one task per board.

The page loop sits inside the reader. It ends with the listing: at a page that is empty, holds no
item, holds fewer items than a full page, or brings no item that an earlier page did not; when
as many items as the board counts have been read; or at the board's page limit. What one page
request does is a callable named by an option (`module:function`), called as
fetch(spec, page) -> text or None. A spec's `max_pages` replaces the board's limit.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from postmill.sources.boards import PAGING

#: Pages of a board that states no limit of its own; a listing that goes on behind them ends in an error row.
MOST_PAGES = 1_000
#: Where a JSON listing keeps its items, and their number over all pages.
ITEMS = {
    "pcsx": ("data.positions", "data.count"), "amazon_jobs": ("jobs", "hits"), "workday": ("jobPostings", "total"),
    "tiktok_careers": ("data.job_post_list", "data.count"), "tiktok_usds": ("data.job_post_list", "data.count"),
    "phenom": ("positions", "count"),
}
#: What names an item in a listing that is a page of markup.
MARKS = {"google_careers": r"jobs/results/(\d+)-", "apple_jobs": r'positionId\\*":\\*"([^"\\]+)'}

SCHEMA = "company string, ats string, page int, payload string, error string"


def _within(node, path: str):
    for name in path.split("."):
        node = node.get(name) if isinstance(node, dict) else None
    return node


def page_items(ats: str, payload: str) -> tuple[list[str], int | None] | None:
    """What a page lists, one text per item, and how many there are in all; None if it can't be told."""
    if ats in MARKS:
        return list(dict.fromkeys(re.findall(MARKS[ats], payload))), None
    if ats not in ITEMS:
        return None
    try:
        read = json.loads(payload)
    except ValueError:
        return [], None
    items, total = (_within(read, path) for path in ITEMS[ats])
    listed = items if isinstance(items, list) else []
    return [json.dumps(i, sort_keys=True) for i in listed], total if isinstance(total, int) and total > 0 else None


class Board(InputPartition):
    def __init__(self, spec: dict):
        self.spec = spec


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.specs = json.loads(options["specs"])
        self.fetch = options["fetch"]

    def partitions(self) -> list[Board]:
        return [Board(spec) for spec in self.specs if spec.get("enabled", True)]

    def read(self, partition: Board) -> Iterator[tuple]:
        module, name = self.fetch.split(":")
        fetch = getattr(importlib.import_module(module), name)
        spec = partition.spec
        full, limit = PAGING.get(spec["ats"], (None, 1))
        seen: set[str] = set()
        own = spec.get("max_pages") or limit
        for page in range(own or MOST_PAGES):
            try:
                payload = fetch(spec, page)
            except Exception as exc:  # one failing board or page leaves the others alone
                yield spec["name"], spec["ats"], page, None, str(exc)
                return
            if not payload:
                return
            listed = page_items(spec["ats"], payload)
            if listed is None:
                yield spec["name"], spec["ats"], page, payload, None
                continue
            items, total = listed
            if seen.issuperset(items):
                return
            yield spec["name"], spec["ats"], page, payload, None
            seen.update(items)
            if (full and len(items) < full) or (total and len(seen) >= total):
                return
        if not own:
            yield spec["name"], spec["ats"], MOST_PAGES, None, f"listing goes on after {MOST_PAGES} pages"


class PagedBoards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_boards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def read_boards(spark: SparkSession, specs: list[dict], fetch: str):
    spark.dataSource.register(PagedBoards)
    return spark.read.format("paged_boards").option("specs", json.dumps(specs)).option("fetch", fetch).load()


def recorded_page(spec: dict, page: int) -> str | None:
    """A page saved under `spec['folder']` as 0.txt, 1.txt, ...; none ends the listing."""
    from pathlib import Path

    path = Path(spec["folder"]) / f"{page}.txt"
    return path.read_text() if path.exists() else None
