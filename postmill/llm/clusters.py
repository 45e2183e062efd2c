"""Exact centroid clustering with Ns-bounds.

Every vector keeps, for each centroid, the distance it last measured and the round it did so in.
The history of centroids stays too, so a stored distance is loosened by the norm of the
centroid's total displacement since that round, ||c_now - c_then||, which is never more than the sum
of its drifts round by round, and far less when it wanders back and forth. A vector whose loosened lower
bounds all exceed its loosened upper bound keeps its cluster unmeasured; one that fails measures
its own centroid, then only those that still might be nearer, in exact integers, ties to the
smaller number.

A round is one pass without a shuffle: it reads the table that the round before wrote, and writes
vectors with their bounds and, beside them, each task's sums per cluster. The sums, some thousand
numbers, are all that is combined and reaches the driver; the history has rounds x clusters
vectors. The table before is deleted once the next one stands, so disk holds two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.batches import arrow_schema, record_batch, sliced
from postmill.llm.integers import Totals, alike, as_lists, collect_totals, floors, longs, narrow, rectangle, roots, sound, squares
from postmill.llm.written import forget, new_path

CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
WIDTH = 64
SEED = 3
#: Relative slack of bounds, far above the rounding of single precision.
SLACK = 1e-6
ROWS = 4096


def single(distances: np.ndarray) -> np.ndarray:
    """In single precision, infinite beyond it."""
    with np.errstate(over="ignore"):
        return distances.astype(np.float32)


class Rounds:
    """The centroids of every round so far, as matrices of whole numbers."""

    def __init__(self, centroids: list[np.ndarray]):
        self.centroids = centroids
        self.now = centroids[-1]
        #: For each earlier round and centroid the norm of its displacement until now.
        self.moved = np.zeros((len(centroids), len(self.now)))
        for t, then in enumerate(centroids):
            a, b = alike(self.now, then)
            self.moved[t] = roots(((a - b) ** 2).sum(axis=1))

    def measure_all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, stored distances, their round, measurements and squared distance of rows without bounds."""
        d = squares(*alike(x, self.now))
        near = d.argmin(axis=1)
        at = np.full(d.shape, len(self.centroids) - 1, np.int16)
        return near, single(roots(d)), at, np.full(len(x), d.shape[1]), d[np.arange(len(x)), near]

    def follow(self, x: np.ndarray, near: np.ndarray, stored: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for rows with bounds: cluster, stored distances, their round, measurements."""
        at, near = at.copy(), near.copy()
        used = np.zeros(len(x), np.int64)
        moved = self.moved[at, np.arange(stored.shape[1])]
        stored = stored.astype(np.float64)
        with np.errstate(invalid="ignore"):
            slack = SLACK * (stored + moved)
            lower, upper = stored - moved - slack, stored + moved + slack
        rows = np.arange(len(x))
        # What is not a number or infinite bounds nothing.
        beyond = np.isfinite(lower) & (lower > upper[rows, near][:, None])
        beyond[rows, near] = True
        failed = np.flatnonzero(~beyond.all(axis=1))
        if not len(failed):
            return near, single(stored), at, used
        own, now = alike(x[failed], self.now)
        mine = near[failed]
        exact = np.full((len(failed), len(now)), np.inf, object if own.dtype == object else np.float64)
        here = np.arange(len(failed))
        exact[here, mine] = ((own - now[mine]) ** 2).sum(axis=1)
        tight = roots(exact[here, mine]) * (1 + SLACK)
        rest = ~(np.isfinite(lower[failed]) & (lower[failed] > tight[:, None]))
        rest[here, mine] = False
        i, j = np.nonzero(rest)
        exact[i, j] = ((own[i] - now[j]) ** 2).sum(axis=1)
        rest[here, mine] = True
        i, j = np.nonzero(rest)
        stored[failed[i], j] = roots(exact[i, j])
        at[failed[i], j] = len(self.centroids) - 1
        used[failed] = rest.sum(axis=1)
        near[failed] = exact.argmin(axis=1)
        return near, single(stored), at, used


def first_centroids(rows: DataFrame, clusters: int, scale: int, width: int, seed: int) -> list[list[int]]:
    """Scaled vectors of the rows with the least SHA-256 of `seed:id`; the vector decides between equal ids."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    least = rows.select(F.sha2(text.cast("binary"), 256).alias("h"), "vec").orderBy("h", "vec").limit(clusters).collect()
    return [[int(v) for v in floors(np.array([r.vec], np.float64).reshape(1, width), scale)[0]] for r in least]


def cluster(
    df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: int = SEED,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """Rows (id, cluster, distance, cluster_inertia, inertia, centroid_sha256, evaluations) of the vectors kept.

    Kept are vectors of `width` components, none null or non-finite, as floor(scale * x). With fewer
    vectors than clusters there are as many clusters as vectors; with none no rows come out. Rows
    that share an id, repeated ones too, are vectors of their own; a null id counts as an empty text
    in the choice of first centroids and comes out as null. Squared distances and sums of them
    that no long holds are null, everything else about such vectors is exact. `evaluations` counts
    the distances measured for a vector, at most (rounds + 1) x clusters. Other columns are not looked at.
    """
    spark = df.sparkSession
    kind, held = df.schema[id_col].dataType.simpleString(), df.schema[vec_col].dataType.simpleString()
    vec = F.col("vec")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter((F.size(vec) == width) & sound(vec))
    history = [narrow(first_centroids(rows, clusters, scale, width, seed))]
    k = len(history[0])
    result = f"{id_col} {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, evaluations int"
    if not k:
        return spark.createDataFrame([], result)
    schema = (
        f"id {kind}, vec {held}, cluster int, stored array<float>, at array<smallint>, evaluations int, distance bigint, "
        "key int, limb int, sums array<bigint>"
    )
    fields = arrow_schema(schema)
    columns = ["id", "vec", "cluster", "stored", "at", "evaluations"]

    def one_round(state: DataFrame, history: list[np.ndarray], last: bool) -> DataFrame:
        known = Rounds(history)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = Totals(k, width + 2)
            for batch in sliced(batches, ROWS):
                x = floors(rectangle(batch.column(1), width), scale)
                n = len(x)
                if len(history) == 1:
                    near, stored, at, used, d = known.measure_all(x)
                else:
                    near = batch.column(2).to_numpy(zero_copy_only=False)
                    before = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, k) for c in (3, 4)]
                    near, stored, at, used = known.follow(x, near, *before)
                    used = used + batch.column(5).to_numpy(zero_copy_only=False)
                if last:
                    a, b = alike(x, known.now)
                    d = ((a - b[near]) ** 2).sum(axis=1)
                for c in np.unique(near).tolist():
                    mine = near == c
                    totals.add(c, 0, mine.sum())
                    totals.add(c, slice(1, width + 1), x[mine].sum(axis=0))
                    if last:
                        # A sum of many distances may be more than float64 holds exactly.
                        totals.add(c, width + 1, sum(map(int, d[mine].tolist())))
                none = pa.nulls(n)
                yield record_batch(
                    {
                        "id": batch.column(0), "vec": batch.column(1), "cluster": near, "stored": as_lists(stored, pa.float32()),
                        "at": as_lists(at, pa.int16()), "evaluations": used, "distance": longs(d.tolist()) if last else none,
                        "key": none, "limb": none, "sums": none,
                    },
                    fields,
                )
            key, limb, sums = totals.limbs()
            none = pa.nulls(len(key))
            yield record_batch({**dict.fromkeys(fields.names, none), "key": key, "limb": limb, "sums": sums}, fields)

        return state.mapInArrow(run, schema)

    state, path, final = rows, None, rounds == 0
    while True:
        before, path = path, new_path(spark, "clusters")
        one_round(state, history, final).write.parquet(path)
        table = spark.read.schema(schema).parquet(path)
        if before:
            forget(spark, before)
        totals = collect_totals(table.filter(F.col("limb").isNotNull()), k, width + 2)
        state = table.filter(F.col("limb").isNull()).select(*columns)
        if final:
            break
        old = [[int(v) for v in c] for c in history[-1].tolist()]
        new = [[s // t[0] for s in t[1 : width + 1]] if t[0] else c for t, c in zip(totals, old, strict=True)]
        history.append(narrow(new))
        # Centroids that stay where they are stay there in all rounds to come.
        final = len(history) > rounds or new == old
    inertias = [t[-1] for t in totals]
    digests = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in history[-1].tolist()]

    def of_cluster(values: list, to: str):
        return F.element_at(F.array(*[F.lit(v).cast(to) for v in values]), F.col("cluster") + 1)

    return table.filter(F.col("limb").isNull()).select(
        F.col("id").alias(id_col), "cluster", "distance", of_cluster(longs(inertias), "bigint").alias("cluster_inertia"),
        F.lit(longs([sum(inertias)])[0]).cast("bigint").alias("inertia"), of_cluster(digests, "string").alias("centroid_sha256"), "evaluations",
    )


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: int = SEED) -> str:
    def assigned(r: int) -> str:
        return f"""
a{r} AS MATERIALIZED (SELECT rid, arg_min(c, d * {clusters} + c) AS c, min(d) AS d FROM (
  SELECT rid, c, (list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y))::BIGINT AS d FROM kept CROSS JOIN c{r}) GROUP BY rid),"""

    steps = ""
    for r in range(rounds):
        steps += assigned(r) + f"""
s{r} AS (SELECT c, pos, sum(v::HUGEINT) AS s, count(*)::HUGEINT AS n FROM (
  SELECT c, unnest(range({width})) AS pos, unnest(x) AS v FROM kept JOIN a{r} USING (rid)) GROUP BY c, pos),
c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.y, o.y) AS y FROM c{r} o LEFT JOIN (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY pos) AS y FROM s{r} GROUP BY c) m ON m.c = o.c),"""
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) = {width} AND list_count(embedding) = {width} AND len(list_filter(embedding, lambda v: isnan(v) OR isinf(v))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS y FROM (
  SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM kept ORDER BY h, x LIMIT {clusters})),{steps}{assigned(rounds)}
t AS (SELECT c, sum(d) AS own, sum(sum(d)) OVER () AS whole FROM a{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, own::BIGINT AS cluster_inertia, whole::BIGINT AS inertia,
  sha256(array_to_string(list_transform(y, lambda v: v::BIGINT), ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (rid) JOIN c{rounds} USING (c) JOIN t USING (c)"""
