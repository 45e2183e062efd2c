"""Language identification by error-correcting output codes.

Each language has a codeword of bits, far from all others. One binary classifier per bit, a
logistic regression on hashed byte n-grams, predicts that bit. Decoding weighs each bit by its
loss: the language whose codeword has the least summed logistic loss under the bits' margins
wins, and a win by little is flagged as ambiguous. All bits learn on the driver from a bounded
sample; prediction reads whole texts in one pass without a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.batches import LOWER, filter_batches, map_batches, texts, utf8
from postmill.llm.learning import logistic

BUCKETS = 4096
#: Bound of the learning sample: rows of each language, those with the least hash of their id.
ROWS_PER_LANGUAGE = 600
#: Least gap between the best two languages' shares; below it a prediction is ambiguous.
GAP = 0.2
UNKNOWN = "und"
ASCII_LETTER = re.compile("[A-Za-z]")
PIECE = 1 << 21

_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def profiles(column: pa.Array) -> np.ndarray:
    """A row for each text: square roots of its shares of hashed byte bi- and trigrams, letters only."""
    data, offsets = utf8(column)
    out = np.zeros((len(offsets) - 1, BUCKETS), np.float32)
    folded = _FOLD[data]
    for doc in range(len(offsets) - 1):
        # Long texts go piece by piece; two bytes of overlap keep the n-grams across the seam.
        for at in range(int(offsets[doc]), int(offsets[doc + 1]), PIECE):
            part = folded[max(int(offsets[doc]), at - 2) : min(at + PIECE, int(offsets[doc + 1]))].astype(np.uint32)
            if len(part) < 2:
                continue
            two = part[:-1] * np.uint32(0x01000193) + part[1:] * np.uint32(0x9E3779B1)
            three = two[:-1] * np.uint32(31) + part[2:] * np.uint32(0x85EBCA77)
            for h in (two, three):
                out[doc] += np.bincount((h * np.uint32(0xC2B2AE3D)) >> np.uint32(20), minlength=BUCKETS)
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def codewords(languages: int) -> np.ndarray:
    """A row of bits for each language, of which each column splits the languages.

    Up to seven languages take all splits; more take the candidates that keep the rows furthest apart.
    """
    if languages < 2:
        return np.zeros((languages, 1), np.float32)
    if languages <= 7:
        bits = [[(code >> (languages - 1 - i)) & 1 for i in range(languages)] for code in range(1, 1 << (languages - 1))]
        return np.array(bits, np.float32).T
    length = int(np.ceil(10 * np.log2(languages)))
    best, distance = None, -1
    for seed in range(200):
        code = np.random.default_rng(seed).integers(0, 2, (languages, length))
        apart = (code[:, None] != code[None]).sum(axis=2) + length * np.eye(languages, dtype=int)
        if apart.min() > distance and 0 < code.mean(axis=0).min() and code.mean(axis=0).max() < 1:
            best, distance = code, apart.min()
    return best.astype(np.float32)


class Model:
    """Languages, their codewords, and the weights of one classifier per bit."""

    def __init__(self, languages: list[str], rows: np.ndarray, labels: np.ndarray):
        self.languages = languages
        self.codes = codewords(len(languages))
        if len(languages) > 1:
            counts = np.bincount(labels, minlength=len(languages))
            self.centre = rows.mean(axis=0)
            self.weights = logistic(
                (rows - self.centre) * 30, self.codes[labels], 1e-4, steps=80, rate=0.02, weight=1.0 / counts[labels]
            )

    def shares(self, rows: np.ndarray) -> np.ndarray:
        """For each row a share per language, from the loss of each codeword."""
        if len(self.languages) < 2:
            return np.ones((len(rows), len(self.languages)))
        margins = np.clip(((rows - self.centre) * 30) @ self.weights[:-1] + self.weights[-1], -8, 8)
        loss = np.logaddexp(0, -margins[:, None] * (2 * self.codes - 1)[None]).sum(axis=2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return share / share.sum(axis=1, keepdims=True)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from at most `rows` whole texts of each non-null language; null texts are left out.

    Rows equal in id, language and text count once. The bound is one per language, so the driver
    holds `rows` profiles for each, however many languages there are.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "hash")
    known = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.withColumn("hash", F.xxhash64("text"))
    # The rows are chosen without their texts; only the chosen rows' texts move, repeated ones combined.
    names = known.select("id", "lang", "hash").distinct().withColumn("at", F.row_number().over(order)).filter(F.col("at") <= rows)
    names = names.select(F.col("id").alias("id_"), F.col("lang").alias("lang_"), F.col("hash").alias("hash_"))
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("lang") == F.col("lang_")) & (F.col("hash") == F.col("hash_"))
    chosen = known.join(F.broadcast(names), same, "left_semi").groupBy("id", "lang", "hash").agg(F.min("text").alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        found = profiles(batch.column(0)).astype(np.float16)
        return {"lang": batch.column(1), "row": [r.tobytes() for r in found]}

    got = map_batches(chosen.select("text", "lang"), "lang string, row binary", run, 64).collect()
    got = sorted((r["lang"], bytes(r["row"])) for r in got)
    languages = sorted({lang for lang, _ in got})
    at = {lang: i for i, lang in enumerate(languages)}
    data = np.frombuffer(b"".join(r for _, r in got), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    return Model(languages, data, np.array([at[lang] for lang, _ in got], np.int64))


def has_letter(text: str) -> bool:
    return bool(ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text)))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", gap: float = GAP) -> DataFrame:
    """Rows (id, lang_pred, score, ambiguous) for every row of `df`, from whole texts.

    Null texts and texts without a letter are `und` with score 0 and ambiguous; so is everything
    when no language was learned. `score` is the winner's share; equal shares go to the language
    that sorts first. Repeated rows get repeated predictions.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        learned = shared.value
        share = learned.shares(profiles(batch.column(1)))
        known = np.array([has_letter(t) for t in texts(batch.column(1))], bool) & bool(learned.languages)
        if not learned.languages:
            return {"id": batch.column(0), "lang_pred": [UNKNOWN] * len(known), "score": np.zeros(len(known)), "ambiguous": ~known}
        best = share.argmax(axis=1)
        top = np.sort(share, axis=1)[:, ::-1]
        second = top[:, 1] if share.shape[1] > 1 else np.zeros(len(top))
        return {
            "id": batch.column(0),
            "lang_pred": [learned.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)],
            "score": np.where(known, top[:, 0], 0.0),
            "ambiguous": ~known | (top[:, 0] - second < gap),
        }

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, f"id {kind}, lang_pred string, score double, ambiguous boolean", run, 256).withColumnRenamed("id", id_col)


def keep_known(df: DataFrame, model: Model, text_col: str = "text", allowed: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of `df`, all columns, whose text is in a learned language (of `allowed`, if given) and not ambiguous.

    Each row is judged by its own text: repeated rows go or stay alike. Null and empty texts and those without
    a letter go; a model without a language keeps no row. An empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def keep(batch: pa.RecordBatch) -> np.ndarray:
        learned = shared.value
        known = np.array([has_letter(t) for t in texts(batch.column(0))], bool)
        if not learned.languages:
            return np.zeros(len(known), bool)
        share = learned.shares(profiles(batch.column(0)))
        top = np.sort(share, axis=1)[:, ::-1]
        clear = top[:, 0] - top[:, 1] >= GAP if share.shape[1] > 1 else np.ones(len(top), bool)
        wanted = np.array([allowed is None or lang in allowed for lang in learned.languages], bool)
        return known & clear & wanted[share.argmax(axis=1)]

    return filter_batches(df, [text_col], keep, 256)
