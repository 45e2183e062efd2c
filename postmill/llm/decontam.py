"""Benchmark decontamination by suffix arrays of the training text.

Tasks cut the documents into shards. A shard's words become the benchmark's word numbers (other
words are 0), and the suffixes that start with a benchmark word are sorted: by their first words
packed into one integer, then, where these are equal, by the next ones. Every suffix of every
benchmark item is looked up in every shard by binary search; an interval of the array that
shares its window of words is a verbatim match, its entries are the locations. Runs of windows
along one diagonal are longer matches.

The benchmark goes to the tasks in blocks of bounded size; beyond one block the documents are
scanned again for each. Documents are never shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.batches import ALNUM, LOWER, filter_batches, map_batches, utf8, word_bounds, word_hashes

WINDOW = 10
#: Bytes of benchmark text that one broadcast holds at most (one longer item makes a block of its own).
BLOCK_BYTES = 16 << 20
SHARD_ROWS = 1024


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and for each text the index of its first word (n + 1)."""
    data, offsets = utf8(column)
    folded = LOWER[data]
    starts, ends, first = word_bounds(folded, offsets, ALNUM)
    return word_hashes(folded, starts, ends), first


def bisect(values: np.ndarray, low: np.ndarray, high: np.ndarray, target: np.ndarray, after: bool) -> np.ndarray:
    """Insertion points of `target` in the sorted slices values[low:high], after equal values or before them."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) // 2
        seen = values[np.minimum(mid, len(values) - 1)]
        up = open_ & ((seen <= target) if after else (seen < target))
        low = np.where(up, mid + 1, low)
        high = np.where(open_ & ~up, mid, high)


class Packing:
    """Word numbers of up to `words` in a row packed into unsigned integers, a few to each."""

    def __init__(self, vocabulary: int, words: int):
        self.bits = max(1, int(vocabulary).bit_length())
        self.each = max(1, 63 // self.bits)
        self.levels = -(-words // self.each)

    def key(self, ids: np.ndarray, at: np.ndarray, level: int, room: int | np.ndarray = 1 << 60, fill: int = 0) -> np.ndarray:
        """Packed words level * each ... of the sequences that start at `at`; words from `room` on are `fill`."""
        out = np.zeros(len(at), np.uint64)
        for k in range(level * self.each, (level + 1) * self.each):
            word = ids[np.minimum(at + k, len(ids) - 1)].astype(np.uint64)
            word = np.where((at + k < len(ids)) & (k < room), word, np.uint64(fill) if isinstance(fill, int) else fill)
            out = (out << np.uint64(self.bits)) | word
        return out


class Index:
    """A block of benchmark items: vocabulary, distinct windows with their items, packed bounds of each."""

    def __init__(self, items: list[str], column: pa.Array, window: int):
        hashes, first = words_of(column)
        self.items = items
        self.vocabulary = np.unique(hashes)
        self.packing = Packing(len(self.vocabulary), window)
        ids = (np.searchsorted(self.vocabulary, hashes) + 1).astype(np.int64)
        starts, rooms, owners = [], [], []
        for item in range(len(items)):
            low, high = int(first[item]), int(first[item + 1])
            room = min(window, high - low)
            at = np.arange(low, high - room + 1) if room else np.zeros(0, np.int64)
            starts.append(at)
            rooms.append(np.full(len(at), room))
            owners.append(np.full(len(at), item))
        at, room = np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.int64), *rooms])
        full = (1 << self.packing.bits) - 1
        low = [self.packing.key(ids, at, k, room) for k in range(self.packing.levels)]
        high = [self.packing.key(ids, at, k, room, full) for k in range(self.packing.levels)]
        rows = np.array([*low, *high]).T.reshape(len(at), 2 * self.packing.levels)
        distinct, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        which = which.reshape(-1)
        self.low, self.high = distinct[:, : self.packing.levels].T.copy(), distinct[:, self.packing.levels :].T.copy()
        self.room = np.zeros(len(distinct), np.int64)
        self.room[which] = room
        pairs = np.unique(np.stack([which, np.concatenate([np.zeros(0, np.int64), *owners])]), axis=1)
        self.owner_at = np.searchsorted(pairs[0], np.arange(len(distinct) + 1))
        self.owner = pairs[1]

    def suffix_array(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places of benchmark words in the order of their suffixes' first words, and the packed keys in that order."""
        at = np.flatnonzero(ids)
        key = self.packing.key(ids, at, 0)
        order = np.argsort(key, kind="stable")
        at, keys = at[order], [key[order]]
        tied = np.zeros(len(at), bool)
        group = np.zeros(len(at), np.int64)
        for level in range(1, self.packing.levels):
            same = keys[-1][1:] == keys[-1][:-1]
            if level > 1:
                same &= tied[1:] & tied[:-1] & (group[1:] == group[:-1])
            group = np.concatenate(([0], np.cumsum(~same))) if len(at) else group
            tied = np.zeros(len(at), bool)
            tied[1:] |= same
            tied[:-1] |= same
            places = np.flatnonzero(tied)
            key = np.zeros(len(at), np.uint64)
            if len(places):
                part = self.packing.key(ids, at[places], level)
                order = np.lexsort((part, group[places]))
                # A group keeps its slots, so only the order inside it changes.
                at[places] = at[places][order]
                key[places] = part[order]
            untied = np.flatnonzero(~tied)
            key[untied] = self.packing.key(ids, at[untied], level) if len(untied) else key[untied]
            keys.append(key)
        return at, keys

    def find(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matches in a shard of documents as (place of the word, window)."""
        slot = np.minimum(np.searchsorted(self.vocabulary, hashes), max(0, len(self.vocabulary) - 1))
        known = self.vocabulary[slot] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
        # A 0 behind every document keeps windows inside it.
        ids = np.zeros(len(hashes) + len(first), np.int64)
        doc = np.searchsorted(first, np.arange(len(hashes)), side="right") - 1
        ids[np.arange(len(hashes)) + doc] = np.where(known, slot + 1, 0)
        at, keys = self.suffix_array(ids)
        low, high = np.zeros(len(self.room), np.int64), np.full(len(self.room), len(at), np.int64)
        live = np.arange(len(self.room))
        if not len(at) or not len(live):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        for level, key in enumerate(keys):
            begin = bisect(key, low[live], high[live], self.low[level][live], after=False)
            end = bisect(key, low[live], high[live], self.high[level][live], after=True)
            low[live], high[live] = begin, end
            live = live[end > begin]
        count = high[live] - low[live]
        shift = np.repeat(low[live] - np.concatenate(([0], np.cumsum(count)[:-1])), count) if len(live) else count
        place = at[np.arange(count.sum()) + shift] if len(live) else np.zeros(0, np.int64)
        return place, np.repeat(live, count)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> list[Broadcast]:
    """The benchmark's items as broadcast indexes of bounded size; items without a word make none."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // (BLOCK_BYTES // 2))
    out = []
    for at in range(count):
        part = rows if count == 1 else rows.filter(F.pmod(F.xxhash64("id"), F.lit(count)) == at)
        got = sorted((r["id"], r["text"]) for r in part.collect())
        out.append(spark.sparkContext.broadcast(Index([g[0] for g in got], pa.array([g[1] for g in got], pa.string()), window)))
    return out


def _judged(index: Index, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per document; and of each match its document, first word in it, words, and window."""
    hashes, first = words_of(column)
    place, window = index.find(hashes, first)
    doc = np.searchsorted(first[1:] + np.arange(1, len(first)), place, side="right")
    return np.diff(first), doc, place - first[doc] - doc, index.room[window], window


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (id, n_words, spans, items) for every row of `docs`.

    `spans` are the maximal stretches of words inside matches, as (at, words); `items` the sorted
    ids, as text, of the items with a match. A null text has no words. An item of fewer words
    than `window` matches as a whole; null items, items without a word and an empty benchmark
    match nothing. Repeated ids are judged row by row.
    """
    indexes = blocks(benchmark, item_col, item_text_col, window)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, n_words bigint, spans array<struct<at:bigint,words:bigint>>, items array<string>"
    if len(indexes) > 1:
        return _many_blocks(rows, indexes, kind).withColumnRenamed("id", id_col)
    index = indexes[0] if indexes else docs.sparkSession.sparkContext.broadcast(Index([], pa.array([], pa.string()), window))
    return map_batches(rows, schema, lambda batch: _scanned(index.value, batch), SHARD_ROWS).withColumnRenamed("id", id_col)


def _scanned(index: Index, batch: pa.RecordBatch) -> dict:
    n_words, doc, at, room, window = _judged(index, batch.column(1))
    spans: list[list[dict]] = [[] for _ in n_words]
    items: list[list[str]] = [[] for _ in n_words]
    if len(doc):
        order = np.lexsort((at, doc))
        d, a, e = doc[order], at[order], (at + room)[order]
        # The furthest end so far, kept apart by document: a stretch starts where it falls behind.
        far = int(e.max()) + 1
        reach = np.maximum.accumulate(e + d * far)
        begins = np.flatnonzero(np.concatenate(([True], (a[1:] + d[1:] * far > reach[:-1]) | (d[1:] != d[:-1]))))
        ends = np.concatenate((begins[1:], [len(d)])) - 1
        for b, z in zip(begins.tolist(), ends.tolist(), strict=True):
            spans[d[b]].append({"at": int(a[b]), "words": int(reach[z] - d[b] * far - a[b])})
        for one, w in np.unique(np.stack([doc, window]), axis=1).T.tolist():
            items[one] += [index.items[i] for i in index.owner[index.owner_at[w] : index.owner_at[w + 1]]]
    return {"id": batch.column(0), "n_words": n_words, "spans": spans, "items": [sorted(set(i)) for i in items]}


def _many_blocks(rows: DataFrame, indexes: list[Broadcast], kind: str) -> DataFrame:
    """One scan per block; stretches and items of equal rows are put together."""
    schema = f"id {kind}, mark bigint, n_words bigint, spans array<struct<at:bigint,words:bigint>>, items array<string>"
    marked = rows.select("id", "text", F.xxhash64("text").alias("mark"))

    def one(index: Broadcast) -> DataFrame:
        def run(batch: pa.RecordBatch) -> dict:
            return {**_scanned(index.value, batch), "mark": batch.column(2)}

        return map_batches(marked, schema, run, SHARD_ROWS)

    found = one(indexes[0])
    for index in indexes[1:]:
        found = found.unionAll(one(index))
    grouped = found.groupBy("id", "mark").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.count("*").alias("copies"),
    )
    start = F.array().cast("array<struct<at:bigint,words:bigint>>")

    def joined(done, span):
        last = F.element_at(done, -1)
        end = F.greatest(last["at"] + last["words"], span["at"] + span["words"])
        grown = F.struct(last["at"].alias("at"), (end - last["at"]).alias("words"))
        return F.when((F.size(done) > 0) & (span["at"] <= last["at"] + last["words"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(
            F.concat(done, F.array(span))
        )

    again = F.explode(F.sequence(F.lit(1), (F.col("copies") / len(indexes)).cast("int"))).alias("copy")
    return grouped.select("id", "n_words", F.aggregate("spans", start, joined).alias("spans"), "items", again).drop("copy")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of `scan` as counts: n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["words"])
    return found.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows of `docs`, all columns, in which no window of any item occurs.

    Repeated rows go or stay alike; null and empty texts hold no window and stay. Null and empty items, and an
    empty benchmark, remove nothing; repeated items count once. An empty `docs` gives no rows.
    """
    for index in blocks(benchmark, item_col, item_text_col, window):

        def keep(batch: pa.RecordBatch, index: Broadcast = index) -> np.ndarray:
            n_words, doc, *_ = _judged(index.value, batch.column(0))
            clean = np.ones(len(n_words), bool)
            clean[doc] = False
            return clean

        docs = filter_batches(docs, [text_col], keep, SHARD_ROWS)
    return docs


def oracle(window: int = WINDOW) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), {window}) AS m, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS i
        FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m)),
hits AS (SELECT r, i, m, item_id FROM dw JOIN bw USING (m, g)),
per AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM hits)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS h
  FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (r) LEFT JOIN its USING (r)"""
