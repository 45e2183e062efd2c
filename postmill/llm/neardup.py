"""Near-duplicate documents by a MinHash LSH forest.

A document's set is its distinct word shingles; documents with equal sets meet first, by a
128-bit digest of the set, and one of them stands for all. Each tree of the forest orders the
signatures by its own few hashes. Neighbours in that order are those with the longest common prefix: the
region of a document is all that share its prefix of DEPTHS[0] hashes, and where more than a block
share it, of one hash more. The threshold sets the number of trees, so that a pair at it meets in
at least one of the deeper regions except once in 100,000. Regions are found by counting prefixes; in a region sorted
neighbours, next ones first, are screened on whole signatures, which finds candidate
components. Each document's full set then moves once, to its candidate component, where links
are confirmed. Regions and components of any size are dealt into blocks that others stream past;
blocks give spanning forests, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.batches import (
    LOWER,
    NOT_SPACE,
    arrow_schema,
    gram_hashes,
    map_batches,
    mixed,
    record_batch,
    stars,
    utf8,
    word_bounds,
    word_hashes,
)
from postmill.llm.components import components
from postmill.session import stage

TREE_HASHES = 4
#: Prefix lengths of a region: the first, and the one for regions beyond a block.
DEPTHS = (3, 4)
#: Bounds of the probability that a pair at the threshold shares no deeper region, and that the screening drops it.
MISS_REGIONS = 1e-5
MISS_SCREEN = 3e-6
BLOCK = 512
#: Shingles of the full sets in one block.
BLOCK_SHINGLES = 1 << 20


class Forest:
    """Trees and hashes for a threshold in percent, and `least`: equal hashes from which a pair's full sets are compared.

    The number of trees grows with the inverse fourth power of the threshold: 16 at 85, 22 at 80, 179 at 50.
    """

    def __init__(self, percent: float):
        if not 0 < percent <= 100:
            raise ValueError("percent must be above 0 and at most 100")
        share = percent / 100
        apart = 1 - share ** DEPTHS[1]
        self.trees = max(1, int(np.ceil(np.log(MISS_REGIONS) / np.log(apart)))) if apart > 0 else 1
        self.hashes = self.trees * TREE_HASHES
        seeds = np.random.default_rng(20240229).integers(0, 1 << 63, (2, self.hashes), dtype=np.uint64)
        self.xor, self.times = seeds[0], seeds[1] * np.uint64(2) + np.uint64(1)
        self.least, fewer = 0, 0.0
        while self.least < self.hashes:
            # The exact binomial probability of at most `least` equal hashes.
            fewer += comb(self.hashes, self.least) * share**self.least * (1 - share) ** (self.hashes - self.least)
            if fewer > MISS_SCREEN:
                break
            self.least += 1


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; shorter texts make one of all their words."""
    data, offsets = utf8(column)
    folded = LOWER[data]
    starts, ends, first = word_bounds(folded, offsets, NOT_SPACE)
    hashes = word_hashes(folded, starts, ends)
    for doc in range(len(offsets) - 1):
        own = hashes[first[doc] : first[doc + 1]]
        yield np.unique(gram_hashes(own, min(words, len(own)))) if len(own) else own


def signature(shingles: np.ndarray, forest: Forest) -> np.ndarray:
    """The least values of the set under each hash, 32 bits of each."""
    low = np.full(forest.hashes, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        piece = shingles[at : at + 2048, None]
        low = np.minimum(low, ((piece ^ forest.xor) * forest.times).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    return int(shingles.sum().view(np.int64)), int(mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))


def sketch(df: DataFrame, words: int, forest: Forest) -> DataFrame:
    """Rows (id, n, f1, f2, sig) of (id, text): set size, digest of the set, signature (none for empty sets)."""

    def run(batch: pa.RecordBatch) -> dict:
        n, f1, f2, sig = [], [], [], []
        for shingles in shingle_sets(batch.column(1), words):
            digest = set_digest(shingles) if len(shingles) else (0, 0)
            n.append(len(shingles)), f1.append(digest[0]), f2.append(digest[1])
            sig.append(signature(shingles, forest).tobytes() if len(shingles) else None)
        return {"id": batch.column(0), "n": n, "f1": f1, "f2": f2, "sig": sig}

    kind = df.schema["id"].dataType.simpleString()
    return map_batches(df.select("id", "text"), f"id {kind}, n bigint, f1 bigint, f2 bigint, sig binary", run)


def prefixes(reps: DataFrame, kind: str, forest: Forest) -> DataFrame:
    """Rows (rep, shorter, longer): hashes of the two prefixes of every tree."""

    def run(batch: pa.RecordBatch) -> dict:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, forest.trees, TREE_HASHES).astype(np.uint64)
        keys = []
        h = np.broadcast_to(np.arange(1, forest.trees + 1, dtype=np.uint64), sig.shape[:2]).copy()
        for k in range(TREE_HASHES):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k] + np.uint64(1))
            if k + 1 in DEPTHS:
                keys.append(h.reshape(-1).view(np.int64).copy())
        return {"rep": batch.column(0).take(pa.array(np.repeat(np.arange(len(sig)), forest.trees))), "shorter": keys[0], "longer": keys[1]}

    return map_batches(reps.select("rep", "sig"), f"rep {kind}, shorter bigint, longer bigint", run)


def dealt(rows: DataFrame, key: str, size: Column, columns: list[str]) -> DataFrame:
    """Rows (key, block, role, columns) in task order: members of their block, then visitors from earlier blocks.

    `size` is the number of blocks of the row's key.
    """
    own = rows.withColumn("blocks", size).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    members = own.select(key, "block", F.lit(0).alias("role"), *columns)
    later = own.filter(F.col("block") + 1 < F.col("blocks")).select(
        key, F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), *columns
    )
    return members.unionAll(later).repartition(key, "block").sortWithinPartitions(key, "block", "role", *columns[:1])


def regions(trees: DataFrame) -> DataFrame:
    """Rows (rep, region, blocks): each tree's region of more than one document that a document lies in."""
    short = trees.groupBy("shorter").agg(F.count("*").alias("n")).filter("n > 1")
    met = trees.join(short, "shorter")
    wide = met.filter(F.col("n") > BLOCK)
    long = wide.groupBy("longer").agg(F.count("*").alias("m")).filter("m > 1")
    narrow = met.filter(F.col("n") <= BLOCK).select("rep", F.col("shorter").alias("region"), F.lit(1).cast("bigint").alias("blocks"))
    deep = wide.join(long, "longer").select("rep", F.col("longer").alias("region"), F.ceil(F.col("m") / BLOCK).alias("blocks"))
    return narrow.unionAll(deep)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end where a run of equal first columns ends, with the numbers of their runs, if runs are short."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [table.column(i).to_numpy() for i in range(keys)]
        changed = np.zeros(table.num_rows - 1, bool)
        for c in columns:
            changed |= c[1:] != c[:-1]
        ends = np.flatnonzero(changed)
        if len(ends):
            cut = int(ends[-1]) + 1
            yield table.slice(0, cut), np.concatenate(([0], np.cumsum(changed[: cut - 1])))
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [table.column(i).to_numpy() for i in range(keys)]
        changed = np.zeros(table.num_rows - 1, bool)
        for c in columns:
            changed |= c[1:] != c[:-1]
        yield table, np.concatenate(([0], np.cumsum(changed)))


def _alike(sig: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, share: float, least: int) -> np.ndarray:
    """Which pairs of rows have enough equal hashes and sizes close enough for the threshold."""
    near = 100 * np.minimum(n[a], n[b]) >= share * np.maximum(n[a], n[b])
    out = np.zeros(len(a), bool)
    at = np.flatnonzero(near)
    for low in range(0, len(at), 1 << 15):
        part = at[low : low + (1 << 15)]
        out[part] = (sig[a[part]] == sig[b[part]]).sum(axis=1) >= least
    return out


def candidates(reps: DataFrame, kind: str, percent: float, forest: Forest) -> DataFrame:
    """Links (a, b) of a spanning forest of the pairs that some region's screening keeps."""
    wanted = ["rep", "n", "sig"]
    placed = regions(prefixes(reps, kind, forest)).join(reps.select(*wanted), "rep")
    order = dealt(placed, "region", F.col("blocks"), wanted)
    out = f"a {kind}, b {kind}"
    fields = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A run holds a block and its visitors: its members come first.
        for table, group in _grouped(_capped(batches), 2):
            role = table.column(2).to_numpy()
            rep, n = table.column(3).combine_chunks(), table.column(4).to_numpy()
            sig = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint32).reshape(-1, forest.hashes).astype(np.uint16)
            found_a, found_b = [], []
            bounds = np.searchsorted(group, np.arange(group[-1] + 2))
            longest = int(np.diff(bounds).max())
            members = np.add.reduceat((role == 0).astype(np.int64), bounds[:-1])
            last_member = np.repeat(bounds[:-1] + members, np.diff(bounds))
            here = np.arange(len(role))
            for k in range(1, longest):
                # The k-th neighbour onwards; of visitors only members are neighbours.
                a = here[: len(here) - k]
                a = a[group[a] == group[a + k]]
                if not len(a):
                    break
                a = a[a < last_member[a]]
                hit = _alike(sig, n, a, a + k, percent, forest.least)
                found_a.append(a[hit])
                found_b.append(a[hit] + k)
            a, b = np.concatenate([np.zeros(0, int), *found_a]), np.concatenate([np.zeros(0, int), *found_b])
            if len(a):
                label = stars(len(role), a, b)
                at = np.flatnonzero(label != np.arange(len(label)))
                yield record_batch({"a": rep.take(pa.array(at)), "b": rep.take(pa.array(label[at]))}, fields)

    return order.mapInArrow(run, out)


def _capped(batches: Iterator[pa.RecordBatch], most: int = 8 * BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows, but a run's visitors beyond `most` rows come as a run of their own behind its members again."""
    members: list[pa.RecordBatch] = []
    key, held, part = None, 0, 0
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        role = batch.column(2).to_pylist()
        low = 0
        while low < len(keys):
            high = low + 1
            while high < len(keys) and keys[high] == keys[low] and role[high] == role[low]:
                high += 1
            if keys[low] != key:
                key, members, held, part = keys[low], [], 0, 0
            piece = batch.slice(low, high - low)
            if role[low] == 0:
                members.append(piece)
                yield _renumbered(piece, part)
            else:
                for at in range(0, piece.num_rows, BLOCK):
                    if held >= most:
                        part, held = part + 1, 0
                        for m in members:
                            yield _renumbered(m, part)
                    some = piece.slice(at, BLOCK)
                    held += some.num_rows
                    yield _renumbered(some, part)
            low = high


def _renumbered(batch: pa.RecordBatch, part: int) -> pa.RecordBatch:
    """The block column made distinct for each part of a run."""
    if not part:
        return batch
    block = pa.array(batch.column(1).to_numpy() + (part << 32))
    return pa.RecordBatch.from_arrays([batch.column(0), block, *batch.columns[2:]], names=batch.schema.names)


class SetBlock:
    """Full sets of one block's members, and a forest over them."""

    def __init__(self, percent: int):
        self.percent = percent
        self.rep: list = []
        self.sets: list[np.ndarray] = []
        self.index: tuple | None = None

    def load(self, rep, shingles: np.ndarray) -> None:
        self.rep.append(rep)
        self.sets.append(shingles)
        self.index = None

    def _ready(self) -> None:
        if self.index is None:
            flat = np.concatenate(self.sets)
            vocabulary, ids = np.unique(flat, return_inverse=True)
            sizes = np.array([len(s) for s in self.sets])
            self.index = (vocabulary, ids.astype(np.int32), np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)

    def shared(self, shingles: np.ndarray) -> np.ndarray:
        """Members that the set is linked with."""
        vocabulary, ids, starts, sizes = self.index
        slot = np.minimum(np.searchsorted(vocabulary, shingles), len(vocabulary) - 1)
        mark = np.zeros(len(vocabulary), np.int32)
        mark[slot[vocabulary[slot] == shingles]] = 1
        both = np.add.reduceat(mark[ids], starts)
        return np.flatnonzero(100 * both >= self.percent * (sizes + len(shingles) - both))

    def meet(self, shingles: np.ndarray) -> list[int]:
        if not self.rep:
            return []
        self._ready()
        return self.shared(shingles).tolist()

    def finish(self) -> tuple[list, list]:
        """Links of the members' own forest; `label` holds each one's root."""
        label = self.label = np.arange(len(self.rep))
        if len(label) > 1:
            self._ready()
            for i in range(1, len(label)):
                roots = np.unique(label[self.shared(self.sets[i])])
                if len(roots) > 1:
                    label[np.isin(label, roots)] = roots[0]
        at = np.flatnonzero(label != np.arange(len(label))).tolist()
        return [self.rep[i] for i in at], [self.rep[label[i]] for i in at]


def confirmed(docs: DataFrame, grouped: DataFrame, kind: str, words: int, percent: int) -> DataFrame:
    """Links (a, b) of a spanning forest of the pairs whose full sets are similar enough.

    `grouped` is (rep, f1, f2, n, part): documents and their candidate components.
    """
    sizes = grouped.groupBy("part").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    texts = docs.join(grouped.join(sizes, "part"), F.col("id") == F.col("rep")).select("part", "blocks", "rep", "f1", "f2", "text")

    def sets(batch: pa.RecordBatch) -> dict:
        keep, found = [], []
        digests = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
        for row, (shingles, digest) in enumerate(zip(shingle_sets(batch.column(5), words), digests, strict=True)):
            if len(shingles) and set_digest(shingles) == digest:
                keep.append(row)
                found.append(shingles.tobytes())
        rows = pa.array(keep, pa.int64())
        return {**{n: batch.column(i).take(rows) for i, n in enumerate(("part", "blocks", "rep"))}, "shingles": found}

    full = map_batches(texts, f"part {kind}, blocks bigint, rep {kind}, shingles binary", sets, 256)
    order = dealt(full, "part", F.col("blocks"), ["rep", "shingles"])
    out = f"a {kind}, b {kind}"
    fields = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, key, open_ = SetBlock(percent), None, True
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            role, rep = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for row in range(batch.num_rows):
                if keys[row] != key:
                    if open_:
                        a, b = block.finish()
                        yield record_batch({"a": a, "b": b}, fields)
                    block, key, open_ = SetBlock(percent), keys[row], True
                shingles = np.frombuffer(batch.column(4)[row].as_py(), np.uint64)
                if role[row] == 0:
                    block.load(rep[row], shingles)
                    continue
                if open_:
                    a, b = block.finish()
                    yield record_batch({"a": a, "b": b}, fields)
                    open_ = False
                # A visitor's links to members of one tree are one link; it makes their trees one.
                roots = sorted({int(block.label[i]) for i in block.meet(shingles)})
                if roots:
                    block.label[np.isin(block.label, roots)] = roots[0]
                    yield record_batch({"a": [rep[row]] * len(roots), "b": [block.rep[r] for r in roots]}, fields)
        if open_ and key is not None:
            a, b = block.finish()
            yield record_batch({"a": a, "b": b}, fields)

    return order.mapInArrow(run, out)


def near_duplicates(df: DataFrame, percent: int = 85, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id, kept) for every row of `df`; links need 100 * shared >= percent * all.

    Null texts and texts without words have empty sets and stand alone. Repeated rows have equal
    sets and so one component; rows that share an id but not a text are judged by their texts. A
    null id is never the smallest while others are linked with it; alone its component is null and it is kept.
    """
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    forest = Forest(percent)
    sketched = stage(sketch(docs, words, forest))
    reps = sketched.filter((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.any_value("sig").alias("sig"))
    reps = stage(reps)
    tried = components(candidates(reps, kind, percent, forest))
    both = tried.select(F.col("node").alias("rep"), F.col("component").alias("part"))
    both = both.unionAll(tried.select(F.col("component").alias("rep"), F.col("component").alias("part")).distinct())
    grouped = stage(both.join(reps.select("rep", "n", "f1", "f2"), "rep"))
    joined = components(confirmed(docs, grouped, kind, words, percent))
    known = reps.join(joined, F.col("rep") == joined["node"], "left").select(
        F.col("n").alias("n_"), F.col("f1").alias("f1_"), F.col("f2").alias("f2_"), F.coalesce("component", "rep").alias("root")
    )
    same = (F.col("n") == F.col("n_")) & (F.col("f1") == F.col("f1_")) & (F.col("f2") == F.col("f2_"))
    out = sketched.select("id", "n", "f1", "f2").join(known, same, "left")
    root = F.coalesce("root", "id")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), root.alias("component_id"),
        F.coalesce(F.col("id") == root, F.col("root").isNull()).alias("kept"),
    )


def oracle(percent: int = 85, words: int = 5) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM (SELECT doc_id, w, least(len(w), {words}) AS m FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, c = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id"""
