"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts count as labelled; all other texts, toxic ones among them, are
unlabelled. With the class prior p, the risk of calling text clean is estimated from the
unlabelled texts less p times the same loss on the toxic ones; where that estimate of a loss turns negative the
fit has gone beyond the data, and the step goes back along its gradient instead. The model is
linear in all hashed words and in-word byte 4- and 5-grams that toxic text holds several times as
often as, after the same prior correction, clean text; no number bounds them, as words of a
language with few toxic texts have less signal than any gram of a common insult.

Learning takes a bounded sample; scoring reads whole texts in one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.batches import LOWER, filter_batches, map_batches, utf8, word_bounds, word_hashes
from postmill.llm.learning import descend, sigmoid
from postmill.session import stage

BUCKETS = 1 << 18
#: Bounds of the learning sample, in texts: those with the least hash of their id.
TOXIC_ROWS = 1_500
UNLABELLED_ROWS = 6_000
#: Every feature is kept that is at least so many times as frequent in toxic as in clean text.
LIFT = 3.0
#: And its share of toxic texts is at least this much higher.
SUPPORT = 0.01
#: Used where no labelled row tells a share of toxic texts.
PRIOR = 0.1
PIECE = 1 << 21

#: Letters, digits and all bytes beyond ASCII make words.
_INSIDE = np.zeros(256, bool)
_INSIDE[[b for b in range(256) if b > 127 or chr(b).isalnum()]] = True
_FOLD = np.where(_INSIDE, LOWER, 32).astype(np.uint8)


def features(column: pa.Array):
    """For each text the distinct hashed features it holds, as arrays of buckets."""
    data, offsets = utf8(column)
    folded = _FOLD[data]
    starts, ends, first = word_bounds(folded, offsets, _INSIDE)
    words = (word_hashes(folded, starts, ends) >> np.uint64(46)).astype(np.uint32)
    for doc in range(len(offsets) - 1):
        found = [words[first[doc] : first[doc + 1]]]
        low, high = int(offsets[doc]), int(offsets[doc + 1])
        for at in range(low, high, PIECE):
            # A blank before and after marks the ends; four bytes of overlap keep grams across a seam.
            part = np.concatenate(([32], folded[max(low, at - 4) : min(at + PIECE, high)], [32])).astype(np.uint32)
            four = sum(part[k : len(part) - 3 + k] * np.uint32(m) for k, m in enumerate((0x01000193, 0x9E3779B1, 0x85EBCA77, 0x27D4EB2F)))
            four = four[: max(0, len(part) - 3)]
            five = four[:-1] * np.uint32(31) + part[4:] * np.uint32(0xC2B2AE3D)
            for h in (four, five + np.uint32(0x165667B1)):
                h = h ^ (h >> np.uint32(15))
                found.append((h * np.uint32(0x2C1B3C6D)) >> np.uint32(14))
        yield np.unique(np.concatenate(found))


class Held:
    """A matrix of ones and zeros by the columns each row holds; every row ends in a 1 in the last column."""

    def __init__(self, rows: list[np.ndarray], columns: int):
        sizes = np.array([len(r) + 1 for r in rows], np.int64)
        self.shape = (len(rows), columns)
        self.row = np.repeat(np.arange(len(rows)), sizes)
        self.starts = np.cumsum(sizes) - sizes
        self.column = np.concatenate([np.zeros(0, np.int64), *(part for r in rows for part in (r, [columns - 1]))]).astype(np.int64)

    def __len__(self) -> int:
        return self.shape[0]

    def __matmul__(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.column].astype(np.float64), self.starts)

    @property
    def T(self) -> Turned:
        return Turned(self)


class Turned:
    """A `Held` matrix with rows and columns exchanged."""

    def __init__(self, held: Held):
        self.held = held

    def __matmul__(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.held.column, weights=values[self.held.row], minlength=self.held.shape[1])


class Model:
    """Kept buckets, their weights and the bias."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray):
        self.table = np.full(BUCKETS, -1, np.int32)
        self.table[kept] = np.arange(len(kept))
        self.weights = weights

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for found in features(column):
            at = self.table[found]
            out.append(self.weights[at[at >= 0]].sum() + self.weights[-1])
        return sigmoid(np.array(out, np.float64))


def choose(found: DataFrame, toxic: int, unlabelled: int, prior: float) -> np.ndarray:
    """All buckets that tell toxic texts, of rows (toxic, found); counted on the executors."""

    def run(batch: pa.RecordBatch) -> dict:
        marks = np.array(batch.column(0).to_pylist(), bool)
        rows = [np.frombuffer(f, "<u4") for f in batch.column(1).to_pylist()]
        counts = [np.bincount(np.concatenate([np.zeros(0, np.uint32), *(r for r, m in zip(rows, marks, strict=True) if m == side)]), minlength=BUCKETS) for side in (True, False)]
        seen = np.flatnonzero(counts[0] + counts[1])
        return {"bucket": seen, "p": counts[0][seen], "u": counts[1][seen]}

    counted = map_batches(found, "bucket int, p bigint, u bigint", run).groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    share_p, share_u = F.col("p") / toxic, F.col("u") / unlabelled
    share_n = F.greatest(share_u - prior * share_p, F.lit(0.0)) / (1 - prior)
    told = counted.filter(share_p >= LIFT * share_n + SUPPORT).select("bucket")
    return np.sort(np.array([r[0] for r in told.collect()], np.int64))


def fit(xp: np.ndarray | Held, xu: np.ndarray | Held, prior: float, l2: float = 6e-4, steps: int = 300) -> np.ndarray:
    """Weights and bias that minimise the non-negative risk with the logistic loss; rows end in a 1."""
    start = np.zeros(xp.shape[1], np.float32)
    start[-1] = np.log(prior / (1 - prior))
    if not len(xp) or not len(xu):
        return start

    def gradient(w):
        zp, zu = xp @ w, xu @ w
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        sp, su = sigmoid(zp), sigmoid(zu)
        g_clean = xu.T @ su / len(xu) - prior * (xp.T @ sp) / len(xp)
        g = -g_clean if clean < 0 else g_clean + prior * (xp.T @ (sp - 1)) / len(xp)
        g[:-1] += l2 * w[:-1]
        return g.astype(np.float32)

    return descend(gradient, start, steps, 0.03)


def sample(df: DataFrame, of: DataFrame, rows: int, toxic: bool) -> DataFrame:
    """(toxic, found) of the texts of (id, text) that belong to the `rows` ids of `of` with the least hash; only features move."""
    ids = of.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(rows)
    chosen = df.join(F.broadcast(ids), "id").select("text")

    def run(batch: pa.RecordBatch) -> dict:
        found = [f.astype("<u4").tobytes() for f in features(batch.column(0))]
        return {"toxic": [toxic] * len(found), "found": found}

    return map_batches(chosen, "toxic boolean, found binary", run, 64)


def train(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None
) -> Model:
    """Learn from rows of `df` that `labels` calls toxic, and from any rows of `df` as unlabelled.

    Ids of `labels` that `df` lacks, null labels and null texts are left out. `prior` is by default
    the share of toxic rows among the labelled ones, counted over all of them.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(F.col("label").isNotNull())
    if prior is None:
        counted = marks.agg(F.avg(F.when(F.col("label") == 1, 1.0).otherwise(0.0))).first()[0]
        prior = min(max(counted, 0.001), 0.999) if counted else PRIOR
    # Which toxic ids `df` holds is settled between ids alone, however many others `labels` names.
    toxic = docs.select("id").join(marks.filter(F.col("label") == 1).select("id").distinct(), "id", "left_semi")
    found = stage(sample(docs, toxic, TOXIC_ROWS, True).unionAll(sample(docs, docs, UNLABELLED_ROWS, False)))
    sizes = {r[0]: r[1] for r in found.groupBy("toxic").count().collect()}
    both = True in sizes and False in sizes
    kept = choose(found, sizes[True], sizes[False], prior) if both else np.zeros(0, np.int64)

    def held(batch: pa.RecordBatch) -> dict:
        rows = [np.flatnonzero(np.isin(kept, np.frombuffer(f, "<u4"))) for f in batch.column(1).to_pylist()]
        return {"toxic": batch.column(0), "row": [r.astype("<u4").tobytes() for r in rows]}

    rows = sorted((r[0], bytes(r[1])) for r in map_batches(found, "toxic boolean, row binary", held).collect()) if both else []
    x = [Held([np.frombuffer(r, "<u4") for t, r in rows if t == side], len(kept) + 1) for side in (True, False)]
    return Model(kept, fit(x[0], x[1], prior))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score, predicted) for every row of `df`, from whole texts; `predicted` is 1 from 0.5 on.

    Null and empty texts hold no feature and get the score of the bias alone. Repeated rows get
    repeated scores.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        scores = shared.value.scores(batch.column(1))
        return {"id": batch.column(0), "score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, f"id {kind}, score double, predicted int", run, 256).withColumnRenamed("id", id_col)


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of `df`, all columns, that score below 0.5.

    Each row is judged by its own text: repeated rows go or stay alike, null and empty texts get the
    bias alone. An empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    return filter_batches(df, [text_col], lambda batch: shared.value.scores(batch.column(0)) < 0.5, 256)
