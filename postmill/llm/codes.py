"""Vector code compression with LAESA pivots.

Vectors are cut into equal parts, and each part position has a codebook. Some entries of the
first codebook are its pivots for good: every part's distances to them are measured once and
written beside the vector. In a round only the few distances between pivots and entries are new;
by the triangle inequality a part's distance to an entry is at least the greatest difference of
their distances to a pivot. Entries are tried in the order of that bound, measured in exact integers,
until the bound exceeds the best distance so far, so every part gets its nearest entry, ties to the lower index.

A round is a pass over the written table without a shuffle; tasks send sums per entry, which
Spark adds up: parts x entries x components numbers, whatever the input's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.batches import arrow_schema, map_batches, record_batch, sliced
from postmill.llm.integers import Totals, alike, as_lists, collect_totals, floors, longs, narrow, rectangle, roots, sound, squares
from postmill.llm.written import written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Pivots of a part position.
PIVOTS = 3
#: Relative slack of bounds, far above the rounding of single precision.
SLACK = 1e-6
ROWS = 2048


def spread_out(entries: np.ndarray, pivots: int) -> list[int]:
    """Indexes of the first entry and of those that in turn lie furthest from all taken before."""
    taken = [0]
    least = roots(squares(entries, entries[:1]))[:, 0]
    while len(taken) < min(pivots, len(entries)):
        taken.append(int(least.argmax()))
        least = np.minimum(least, roots(squares(entries, entries[taken[-1:]]))[:, 0])
    return taken


class Books:
    """The codebooks (parts, entries, components) of one round, and the pivots (parts, pivots, components) of all."""

    def __init__(self, books: list[np.ndarray], pivots: list[np.ndarray]):
        self.books, self.pivots = books, pivots
        self.between = [roots(squares(*alike(p, b))) for p, b in zip(pivots, books, strict=True)]

    def nearest(self, part: int, rows: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each row's nearest entry, their squared distance, and how many distances were measured."""
        rows, book = alike(rows, self.books[part])
        best = np.full(len(rows), np.inf, rows.dtype)
        entry = np.full(len(rows), len(book), np.int64)
        bound = np.zeros((len(rows), len(book)))
        with np.errstate(invalid="ignore"):
            for m, between in enumerate(self.between[part]):
                own = to_pivots[:, m : m + 1].astype(np.float64)
                bound = np.fmax(bound, np.abs(own - between) - SLACK * (own + between))
        # Infinite distances bound nothing.
        bound[~np.isfinite(bound)] = 0
        order = bound.argsort(axis=1, kind="stable")
        open_, measured = np.arange(len(rows)), 0
        for step in range(len(book)):
            j = order[open_, step]
            go = bound[open_, j] <= roots(best[open_])
            open_, j = open_[go], j[go]
            if not len(open_):
                break
            d = ((rows[open_] - book[j]) ** 2).sum(axis=1)
            measured += len(open_)
            better = (d < best[open_]) | ((d == best[open_]) & (j < entry[open_]))
            best[open_[better]], entry[open_[better]] = d[better], j[better]
        return entry, best, measured


def codes(
    df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, pivots: int = PIVOTS,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Rows (id, code, error, label_error, codebooks_sha256, evaluations) of the vectors kept.

    Dropped are vectors that are null or hold null or non-finite components; components count as floor(scale * x).
    Vectors shorter than the longest, or than the next multiple of `parts`, end in zeros. Rows that
    share an id, repeated ones too, are vectors of their own; where ids are equal the vector
    decides which starts a codebook, and null ids come last. With fewer vectors than `entries` the
    codebooks are as short; with none no rows come out. Sums of squared distances that no long holds are null.
    `evaluations` counts the distances to entries measured in all rounds for all vectors. Other columns are not looked at.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index of two hex digits needs 1 to 256 entries")
    spark = df.sparkSession
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, vec_col, label_col)}
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec")).filter(sound(F.col("vec")))
    longest = rows.agg(F.max(F.size("vec"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], f"{id_col} {kinds[id_col]}, code string, error bigint, label_error bigint, codebooks_sha256 string, evaluations bigint")
    each = max(1, -(-longest // parts))
    width = parts * each

    first = rows.orderBy(F.asc_nulls_last("id"), "vec").limit(entries).select("vec").collect()
    start = floors(rectangle(pa.array([r.vec for r in first], pa.list_(pa.float64())), width), scale).reshape(len(first), parts, each)
    books = [narrow([[int(v) for v in e] for e in start[:, p].tolist()]) for p in range(parts)]
    fixed = [b[spread_out(b, pivots)] for b in books]
    m = len(fixed[0])

    def cut(vec: pa.Array) -> np.ndarray:
        x = floors(rectangle(vec, width), scale)
        return x.reshape(len(x), parts, each)

    def measure(batch: pa.RecordBatch) -> dict:
        x = cut(batch.column(2))
        with np.errstate(over="ignore"):
            far = np.concatenate([roots(squares(*alike(x[:, p], fixed[p]))) for p in range(parts)], axis=1).astype(np.float32)
        return {**{n: batch.column(i) for i, n in enumerate(("id", "label", "vec"))}, "pivots": as_lists(far, pa.float32())}

    schema = f"id {kinds[id_col]}, label {kinds[label_col]}, vec {kinds[vec_col]}, pivots array<float>"
    table = written(map_batches(rows, schema, measure, ROWS), "parts")

    def assigned(known: Books, vec: pa.Array, far: pa.Array):
        x = cut(vec)
        d = far.flatten().to_numpy(zero_copy_only=False).reshape(len(x), parts, m)
        return x, [known.nearest(p, x[:, p], d[:, p]) for p in range(parts)]

    limbs = "key int, limb int, sums array<bigint>"
    limb_fields = arrow_schema(limbs)

    def sums(known: Books):
        n = len(known.books[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = Totals(parts, n * (each + 1) + 1)
            for batch in sliced(batches, ROWS):
                x, found = assigned(known, batch.column(0), batch.column(1))
                for p, (entry, _, measured) in enumerate(found):
                    totals.add(p, n * (each + 1), measured)
                    here = np.zeros((n, each + 1), x.dtype)
                    np.add.at(here, entry, np.concatenate([np.ones((len(x), 1), x.dtype), x[:, p]], axis=1))
                    totals.add(p, slice(0, n * (each + 1)), here.reshape(-1))
            key, limb, values = totals.limbs()
            yield record_batch({"key": key, "limb": limb, "sums": values}, limb_fields)

        return run

    evaluations = 0
    for _ in range(rounds):
        n = len(books[0])
        totals = collect_totals(table.select("vec", "pivots").mapInArrow(sums(Books(books, fixed)), limbs), parts, n * (each + 1) + 1)
        evaluations += sum(t[-1] for t in totals)
        for p, t in enumerate(totals):
            old = [[int(v) for v in e] for e in books[p].tolist()]
            for e in range(n):
                count, *values = t[e * (each + 1) : (e + 1) * (each + 1)]
                if count:
                    old[e] = [v // count for v in values]
            books[p] = narrow(old)

    known = Books(books, fixed)
    digest = hashlib.sha256(",".join(str(int(v)) for b in books for e in b.tolist() for v in e).encode()).hexdigest()

    def code(batch: pa.RecordBatch) -> dict:
        x, found = assigned(known, batch.column(2), batch.column(3))
        index = np.stack([entry for entry, _, _ in found], axis=1).astype(np.uint8)
        text = index.tobytes().hex()
        error = np.zeros(len(x), object)
        for _, d, _ in found:
            error += np.array(list(map(int, d.tolist())), object)
        limits = [v if v < 10**38 else None for v in error.tolist()]
        return {
            "id": batch.column(0), "label": batch.column(1), "code": [text[i * 2 * parts : (i + 1) * 2 * parts] for i in range(len(x))],
            "error": longs(error.tolist()), "exact": [None if v is None else str(v) for v in limits],
            "measured": [sum(f[2] for f in found)] + [0] * (len(x) - 1),
        }

    coded = f"id {kinds[id_col]}, label {kinds[label_col]}, code string, error bigint, exact string, measured bigint"
    done = written(map_batches(table, coded, code, ROWS), "codes")
    # An error beyond 38 digits makes its label's sum null, like a sum beyond a long.
    exact = F.col("exact").cast("decimal(38,0)")
    whole = F.when(F.count("*") == F.count("exact"), F.sum(exact))
    labels = written(
        done.groupBy("label").agg(F.when(whole <= (1 << 63) - 1, whole).cast("bigint").alias("label_error"), F.sum("measured").alias("measured")), "labels"
    )
    evaluations += labels.agg(F.coalesce(F.sum("measured"), F.lit(0))).first()[0]
    same = F.col("label").eqNullSafe(F.col("label_"))
    joined = done.join(labels.select(F.col("label").alias("label_"), "label_error"), same)
    return joined.select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"),
        F.lit(int(evaluations)).cast("bigint").alias("evaluations"),
    )


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    def assigned(r: int) -> str:
        return f"""
a{r} AS MATERIALIZED (SELECT rid, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM (
  SELECT rid, part, entry, (list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y))::BIGINT AS d
  FROM cut JOIN b{r} USING (part)) GROUP BY rid, part),"""

    steps = ""
    for r in range(rounds):
        steps += assigned(r) + f"""
s{r} AS (SELECT part, entry, pos, sum(v::HUGEINT) AS s, count(*)::HUGEINT AS n FROM (
  SELECT part, entry, unnest(range(len(x))) AS pos, unnest(x) AS v FROM cut JOIN a{r} USING (rid, part)) GROUP BY part, entry, pos),
b{r + 1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(m.y, o.y) AS y FROM b{r} o LEFT JOIN (
  SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY pos) AS y FROM s{r} GROUP BY part, entry) m ON m.part = o.part AND m.entry = o.entry),"""
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)) AS x FROM embeddings
  WHERE list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda v: isnan(v) OR isinf(v))) = 0),
cut AS MATERIALIZED (SELECT rid, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x FROM (SELECT rid, x, unnest(range({parts})) AS part FROM kept)),
b0 AS MATERIALIZED (SELECT part, entry, cut.x AS y FROM (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS entry FROM kept
  ORDER BY entry LIMIT {entries}) JOIN cut USING (rid)),{steps}{assigned(rounds)}
e AS (SELECT rid, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda v: v::BIGINT), ','), ',' ORDER BY part, entry)) AS h FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN e USING (rid) CROSS JOIN books"""
