"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into halves with a codebook of centres each; the pair of nearest centres is
the cell of a product grid. A vector visits the cells whose distance bound is least, in the
order of the two halves' bounds added up, until the cells left cannot hold a near vector at the
target recall: a centre's bound is how far the vector lies on its own centre's side of the
border to that centre. Two vectors at the threshold are sqrt(2 - 2t) apart; noise of that size
crosses a border `SIGMAS` standard deviations away once in millions, and a border further away
than all of that size never. What a visit finds is verified in double precision.

Exact copies meet first and count by weight. A cell's members are dealt into blocks of bounded
size and a block's visitors stream past it, so no task holds a cell. Blocks give counts and a
spanning forest of their links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.batches import arrow_schema, map_batches, record_batch
from postmill.llm.components import components
from postmill.session import stage

SIGMAS = 5.0
BLOCK = 512
#: Vectors that the codebooks learn from, those with the least hash of their id.
SAMPLE = 8_192
MEMBERS_PER_CELL = 128
MOST_CENTRES = 256
BORDERS = 4


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length one in double precision, safe for very large and very small components."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Codebook:
    """Centres of one half."""

    def __init__(self, rows: np.ndarray, centres: int, rounds: int = 12):
        distinct = np.unique(rows, axis=0)
        pick = np.random.default_rng(0).permutation(len(distinct))[:centres]
        self.centres = distinct[np.sort(pick)]
        for _ in range(rounds):
            near = self.distances(rows).argmin(axis=1)
            for c in range(len(self.centres)):
                if (near == c).any():
                    self.centres[c] = rows[near == c].mean(axis=0)
        gaps = self.centres[:, None] - self.centres[None]
        self.gaps = np.sqrt((gaps * gaps).sum(axis=2))

    def distances(self, rows: np.ndarray) -> np.ndarray:
        """Squared distances to the centres."""
        c = self.centres
        return np.maximum((rows * rows).sum(axis=1)[:, None] - 2 * rows @ c.T + (c * c).sum(axis=1), 0)

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each row, and for all centres the least distance into their region."""
        d = self.distances(rows)
        near = np.argsort(d, axis=1, kind="stable")[:, :BORDERS]
        bound = np.zeros_like(d)
        for k in range(near.shape[1]):
            c = near[:, k]
            with np.errstate(divide="ignore", invalid="ignore"):
                across = (d - d[np.arange(len(d)), c][:, None]) / (2 * self.gaps[c])
            bound = np.maximum(bound, np.where(self.gaps[c] > 0, across, 0))
        return near[:, 0], bound


class Grid:
    """Both codebooks and the reach of a visit."""

    def __init__(self, rows: np.ndarray, centres: int, threshold: float, sigmas: float = SIGMAS):
        self.half = (rows.shape[1] + 1) // 2
        self.books = [Codebook(rows[:, : self.half], centres), Codebook(rows[:, self.half :], centres)]
        apart = np.sqrt(max(0.0, 2 - 2 * threshold))
        self.reach = min(apart, sigmas * apart / np.sqrt(rows.shape[1])) + 1e-9

    def visits(self, rows: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Each row's cell, and the cells of higher number that it visits."""
        (c1, b1), (c2, b2) = (book.bounds(part) for book, part in zip(self.books, (rows[:, : self.half], rows[:, self.half :]), strict=True))
        width = b2.shape[1]
        cell = c1 * width + c2
        visited = []
        for i in range(len(rows)):
            first = np.flatnonzero(b1[i] <= self.reach)
            second = np.flatnonzero(b2[i] <= self.reach)
            total = b1[i][first][:, None] ** 2 + b2[i][second][None] ** 2
            near = (first[:, None] * width + second[None])[total <= self.reach**2]
            visited.append(near[near > cell[i]].tolist())
        return cell, visited


def train(vectors: DataFrame, threshold: float) -> Grid | None:
    """A grid from a bounded sample of distinct vectors (rep, label, vec of equal length); None without any."""
    sizes = vectors.groupBy("label").count().agg(F.max("count")).first()[0]
    if not sizes:
        return None
    centres = 4
    while centres < MOST_CENTRES and centres * centres * MEMBERS_PER_CELL < sizes:
        centres *= 2
    rows = vectors.orderBy(F.xxhash64("rep"), "rep", "f1").limit(SAMPLE).select("vec").collect()
    return Grid(unit(np.array([r["vec"] for r in rows], np.float64)), centres, threshold)


def links(vectors: DataFrame, grid: Grid, threshold: float) -> DataFrame:
    """Rows (kind, node, other, n): kind 0 gives a node's links found in one block, kind 1 a link of the forest.

    `vectors` are distinct (rep, label, n, vec), checkpointed.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(grid)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batch: pa.RecordBatch) -> dict:
        cell, visited = shared.value.visits(unit(matrix(batch.column(3))))
        return {**{n: batch.column(i) for i, n in enumerate(("rep", "label", "n", "vec"))}, "cell": cell, "visited": visited}

    schema = f"rep {kinds['rep']}, label {kinds['label']}, n bigint, vec {kinds['vec']}, cell bigint, visited array<bigint>"
    placed = map_batches(vectors.select("rep", "label", "n", "vec"), schema, run)
    sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    # Members sit in one block of their cell, and visit the later blocks of it and all blocks of the cells they visit.
    at = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    own = placed.select("rep", "label", "n", "vec", "cell").join(sizes, ["label", "cell"]).withColumn("block", at)
    members = own.select("label", "cell", "block", F.lit(0).alias("role"), "rep", "n", "vec")
    later = own.filter(F.col("block") + 1 < F.col("blocks")).select(
        "label", "cell", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "rep", "n", "vec"
    )
    probes = placed.select("rep", "label", "n", "vec", F.explode("visited").alias("cell")).join(sizes, ["label", "cell"])
    probes = probes.select(
        "label", "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "rep", "n", "vec"
    )
    keys = ["label", "cell", "block"]
    dealt = members.unionAll(later).unionAll(probes).repartition(*keys).sortWithinPartitions(*keys, "role")
    out = f"kind int, node {kinds['rep']}, other {kinds['rep']}, n bigint"
    fields = arrow_schema(out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, key = None, None
        for batch in batches:
            names = [batch.column(i).to_pylist() for i in range(3)]
            role = np.array(batch.column(3).to_pylist())
            vecs = unit(matrix(batch.column(6)))
            rep, n = batch.column(4).to_pylist(), np.array(batch.column(5).to_pylist(), np.int64)
            at = 0
            while at < len(role):
                here = (names[0][at], names[1][at], names[2][at])
                if here != key:
                    if block is not None:
                        yield record_batch(block.finish(), fields)
                    block, key = Block(threshold), here
                end = at + 1
                while end < len(role) and role[end] == role[at] and (names[0][end], names[1][end], names[2][end]) == here:
                    end += 1
                if role[at] == 0:
                    block.load(rep[at:end], n[at:end], vecs[at:end])
                else:
                    yield record_batch(block.meet(rep[at:end], n[at:end], vecs[at:end]), fields)
                at = end
        if block is not None:
            yield record_batch(block.finish(), fields)

    return dealt.mapInArrow(meet, out)


class Block:
    """Members of one block, their link counts so far, and a forest over them."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.rep: list = []
        self.n = np.zeros(0, np.int64)
        self.vecs: np.ndarray | None = None
        self.count = np.zeros(0, np.int64)
        self.root: list[int] = []

    def load(self, rep: list, n: np.ndarray, vecs: np.ndarray) -> None:
        self.rep += rep
        self.n = np.concatenate((self.n, n))
        self.vecs = vecs if self.vecs is None else np.concatenate((self.vecs, vecs))
        self.count = np.zeros(len(self.rep), np.int64)
        self.root = list(range(len(self.rep)))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, hits: np.ndarray) -> list[int]:
        """Distinct roots of the members that one vector links; they are one tree from now on."""
        roots = sorted({self.find(i) for i in hits.tolist()})
        for r in roots[1:]:
            self.root[r] = roots[0]
        return roots

    def meet(self, rep: list, n: np.ndarray, vecs: np.ndarray) -> dict:
        kind, node, other, count = [], [], [], []
        for low in range(0, len(rep) if self.rep else 0, BLOCK):
            near = vecs[low : low + BLOCK] @ self.vecs.T >= self.threshold
            self.count += (near * n[low : low + BLOCK][:, None]).sum(axis=0)
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                hits = np.flatnonzero(near[i])
                kind.append(0), node.append(rep[low + i]), other.append(None), count.append(int(self.n[hits].sum()))
                for r in self.join(hits):
                    kind.append(1), node.append(rep[low + i]), other.append(self.rep[r]), count.append(0)
        return {"kind": kind, "node": node, "other": other, "n": count}

    def finish(self) -> dict:
        kind, node, other, count = [], [], [], []
        if not self.rep:
            return {"kind": kind, "node": node, "other": other, "n": count}
        near = self.vecs @ self.vecs.T >= self.threshold
        np.fill_diagonal(near, False)
        self.count += near.astype(np.int64) @ self.n
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            mine = self.find(i)
            for r in self.join(np.append(np.flatnonzero(near[i]), i)):
                if r != mine:
                    kind.append(1), node.append(self.rep[i]), other.append(self.rep[r]), count.append(0)
        for i in np.flatnonzero(self.count).tolist():
            kind.append(0), node.append(self.rep[i]), other.append(None), count.append(int(self.count[i]))
        return {"kind": kind, "node": node, "other": other, "n": count}


def near_duplicates(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows (id, n_links, component_id, kept) for every row of `df`.

    Vectors are compared when their labels are equal and not null and their lengths are equal.
    Null, empty and zero vectors, and vectors with null or non-finite components, link with nothing,
    nor do rows without an id, whose component is null and which are kept. Repeated rows link with
    each other; rows that share an id are one node. With no row to compare all stand alone.
    """
    vec = F.col("vec")
    sound = (
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(vec) > 0)
        & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))
    )
    base = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    keyed = base.select("id", "label", "vec", F.xxhash64("label", "vec").alias("f1"), F.hash("vec", "label").alias("f2"), F.coalesce(sound, F.lit(False)).alias("sound"))
    valid = keyed.filter("sound")
    distinct = stage(
        valid.groupBy("label", "f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.any_value("vec").alias("vec"))
    )
    found: DataFrame | None = None
    for size in sorted(r[0] for r in distinct.select(F.size("vec")).distinct().collect()):
        part = distinct.filter(F.size("vec") == size)
        grid = train(part, threshold)
        if grid is not None:
            more = links(part, grid, threshold)
            found = more if found is None else found.unionAll(more)
    spark: SparkSession = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    if found is None:
        found = spark.createDataFrame([], f"kind int, node {kind}, other {kind}, n bigint")
    found = stage(found)
    counts = found.filter("kind = 0").groupBy("node").agg(F.sum("n").alias("linked"))
    joined = components(found.filter("kind = 1"), "node", "other")
    known = distinct.select("f1", "f2", "label", "rep", "n").join(counts, F.col("rep") == counts["node"], "left").drop("node")
    known = known.join(joined, F.col("rep") == joined["node"], "left").select(
        F.col("f1").alias("g1"), F.col("f2").alias("g2"),
        (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root"),
    )
    narrow = keyed.select("id", "sound", "f1", "f2")
    out = narrow.join(known, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & F.col("sound"), "left")
    root = F.coalesce("root", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"),
    )


def oracle(threshold: float = 0.98) -> str:
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(c, e.vec_id) AS component_id, coalesce(c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = e.vec_id"""
