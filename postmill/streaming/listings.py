"""Company listings as a stream: each run reads the threads posted since the run before.

An offset is, for each company, the moment up to which its listing has been read. A batch is
one span of time per company, (since, until), read by one task: pages from the newest on, until one ends
in a thread older than `since`. Before the first run `since` is the cutoff, some months ago. Spans
follow on each other, so a dated thread falls into one of them whatever page it stands on by then.
A page that can't be fetched fails the batch, whose spans are then read again.

A page may be long: it is handed on in parts, cut behind a mark, so that no task but its reader holds it whole.
"""

from __future__ import annotations

import importlib
import json
import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from postmill import fixed_values as fixed
from postmill.files import opened
from postmill.sources.posts import thread_listings

SCHEMA = "company string, page int, marks int, dated string, payload string, since timestamp, until timestamp"
MONTH = timedelta(days=30)
PART = 1 << 18  # characters
MARK = re.compile(fixed.LISTING_MARK.replace(r"\d", "[0-9]"))
UNSURE = re.compile(r"<a[^\x00-\x7f]")
TIME = re.compile(r'<time[^>]*title="(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2})?)')


def moment(text: str) -> datetime:
    """A date and time, in UTC unless it says otherwise."""
    read = datetime.fromisoformat(text)
    return read if read.tzinfo else read.replace(tzinfo=UTC)


def parts(payload: str, most: int = PART) -> Iterator[tuple[int, str, str]]:
    """A page in parts of about `most` characters: marks before the part, the last date among them, the part's text.

    A cut is behind a mark, where the search for marks starts anew, so the parts have the page's marks. Whether a
    letter behind `<a` that is not ASCII belongs to the tag's name, Java and Python may see differently; a page with one stays whole.
    """
    begin, before, dated, time = 0, 0, "", ""
    if len(payload) > most and not UNSURE.search(payload):
        for number, mark in enumerate(MARK.finditer(payload), 1):
            if mark[3] is None:
                time = mark[1]
            if mark.end() - begin >= most:
                yield before, dated, payload[begin : mark.end()]
                begin, before, dated = mark.end(), number, time
    if begin < len(payload):
        yield before, dated, payload[begin:]


class Span(InputPartition):
    def __init__(self, spec: dict, since: str, until: str):
        self.spec, self.since, self.until = spec, since, until


class ListingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.specs = {s["name"]: s for s in json.loads(options["specs"])}
        self.fetch = options["fetch"]
        self.until = options.get("until")
        self.months = int(options.get("months", 12))

    def _now(self) -> datetime:
        return moment(self.until) if self.until else datetime.now(UTC)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {name: self._now().isoformat() for name in self.specs}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        spans = []
        for name, until in sorted(end.items()):
            since = start.get(name) or (moment(until) - self.months * MONTH).isoformat()
            if name in self.specs and moment(since) < moment(until):
                spans.append(Span(self.specs[name], since, until))
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        module, name = self.fetch.split(":")
        fetch = getattr(importlib.import_module(module), name)
        since, until = moment(partition.since), moment(partition.until)
        page = 0
        while payload := fetch(partition.spec, page):
            yield partition.spec["name"], page, payload, since, until
            last = deque(TIME.finditer(payload), 1)
            if last and moment(last[0][1]) < since:
                return
            page += 1


class PagedReader(ListingReader):
    """Hands each part of a page on as a batch of its own: Spark would gather thousands of them into one."""

    def read(self, partition: Span) -> Iterator:
        import pyarrow as pa

        stamp = pa.timestamp("us", tz="UTC")
        kinds = pa.schema([
            ("company", pa.string()), ("page", pa.int32()), ("marks", pa.int32()), ("dated", pa.string()), ("payload", pa.string()), ("since", stamp), ("until", stamp),
        ])
        for company, page, payload, since, until in super().read(partition):
            for part in parts(payload):
                row = (company, page, *part, since, until)
                yield pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in zip(row, kinds.types, strict=True)], schema=kinds)


class ListingStream(DataSource):
    """Format `listing_pages`. Options: specs (JSON, each with a name), fetch (module:function), months, until (default now)."""

    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def in_span(pages: DataFrame) -> DataFrame:
    """Listing rows of a batch that were posted in their company's span; undated threads stay, the seen-state tells them."""
    posted = F.regexp_replace("posted_at", " ", "T").try_cast("timestamp")
    met = thread_listings(pages, ["since", "until"]).filter(F.col("company").isNotNull())
    return met.filter(posted.isNull() | ((posted >= F.col("since")) & (posted < F.col("until")))).drop("since", "until")


def run_listing_stream(
    spark: SparkSession, specs: Sequence[dict], fetch: str, checkpoint: str, on_new: Callable[[DataFrame, int], None],
    until: str | None = None, months: int = 12,
) -> None:
    """Read every company's listing from where the last run ended, then stop; `on_new` takes the threads of a batch."""
    spark.dataSource.register(ListingStream)
    source = spark.readStream.format("listing_pages").option("specs", json.dumps(list(specs))).option("fetch", fetch).option("months", months)
    if until:
        source = source.option("until", until)

    def apply(batch: DataFrame, number: int) -> None:
        # A batch's pages are fetched once, however often its rows are used; the rows are kept, not the pages.
        rows = in_span(batch).persist()
        on_new(rows, number)
        rows.unpersist()

    query = source.load().writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def written_page(spec: dict, page: int) -> str | None:
    """A page that Spark wrote as text under `spec['folder']`/page=N; none ends the listing."""
    from pyarrow import fs

    system, folder = opened(spec["folder"])
    found = system.get_file_info(fs.FileSelector(f"{folder}/page={page}", allow_not_found=True))
    texts = [system.open_input_file(i.path).read().decode() for i in sorted(found, key=lambda i: i.path) if i.base_name.startswith("part-")]
    return "".join(texts) or None
