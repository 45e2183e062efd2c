"""URL filters: host and path rules, and for the rest a model of the URL's own letters.

The model is a logistic regression on hashed character n-grams of host and path. Each n-gram counts
twice: as one of its part, and as one of the URL, so that a word learnt in hosts is known in paths. It
learns on the driver from the small table of `url_labels`; its weights are a broadcast array of fixed
size. Judging is per row, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm import url_labels
from postmill.llm.batches import map_batches, texts
from postmill.llm.learning import logistic, sigmoid

BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
WORD_ENDS = re.compile(r"[^a-z0-9\x80-\U0010ffff]+", re.ASCII | re.IGNORECASE)
#: (host, path, allow): fits the host and its subdomains where the URL's path starts with the rule's.
RULES = (
    ("com", "/", True),
    ("example.com", "/en/", False),
    ("www.example.com", "/en/", True),
    ("net", "/es/", False),
    ("net", "/fr/", False),
)

def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without one."""
    rest = F.substring_index(_after(url), "/", 1)
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    rest = _after(url)
    tail = F.substr(rest, F.length(host_of(url)) + 1)
    return F.substring_index(F.substring_index(tail, "?", 1), "#", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, bool]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (of equal length the one with the longer host) as text, and whether it allows."""
    text, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule_host, rule_path, allows in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        allow = F.when(fits, F.lit(allows)).otherwise(allow)
    return text, allow


def features(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the n-grams of host and path, each with its words' ends marked alike."""
    found = set()
    for kind, part in ((0x51ED270B, host), (0x9E3779B9, path)):
        data = ("^" + WORD_ENDS.sub("^", part) + "^").encode("utf-8", "replace")
        for n in GRAMS:
            for i in range(len(data) - n + 1):
                gram = data[i : i + n]
                found.add(zlib.crc32(gram, n) % BUCKETS)
                found.add(zlib.crc32(gram, kind + n) % BUCKETS)
    return np.fromiter(found, np.int64, len(found))


def train(labelled: Sequence[tuple[str, str, bool]]) -> np.ndarray:
    """Weights and bias; P(block) of a URL is the sigmoid of its buckets' mean weight and the bias."""
    if not labelled:
        return np.zeros(BUCKETS + 1, np.float32)
    x = np.zeros((len(labelled), BUCKETS), np.float32)
    y = np.array([[not allow] for _, _, allow in labelled], np.float32)
    for row, (host, path, _) in enumerate(labelled):
        hit = features(host, path)
        x[row, hit] = 1.0 / np.sqrt(max(1, len(hit)))
    # Classes keep their sizes: what holds nothing known leans to the larger one, which is plain.
    return logistic(x, y, 1e-5, steps=150, rate=0.1)[:, 0]


def judge(
    urls: DataFrame,
    labelled: Sequence[tuple[str, str, bool]] | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, bool]] = RULES,
) -> DataFrame:
    """Rows (id, host, path, rule, verdict, score) for all rows of `urls`.

    The model learns from `labelled`, by default `url_labels.learnt()`. A null URL, or one without `://`, has an empty host and path; no rule fits it and the model
    judges it like any other. `score` is the model's P(block), also where a rule decides. Equal
    URLs get equal verdicts; at 0.5 and above the model blocks. An empty table gives no rows.
    """
    model = urls.sparkSession.sparkContext.broadcast(train(url_labels.learnt() if labelled is None else labelled))

    def run(batch: pa.RecordBatch) -> dict:
        weights = model.value
        scores = []
        for host, path in zip(texts(batch.column(1)), texts(batch.column(2)), strict=True):
            hit = features(host, path)
            scores.append(float(weights[hit].sum() / np.sqrt(max(1, len(hit))) + weights[-1]))
        return {"id": batch.column(0), "host": batch.column(1), "path": batch.column(2), "score": sigmoid(np.array(scores, np.float64))}

    kind = urls.schema[id_col].dataType.simpleString()
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = urls.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    scored = map_batches(rows, f"id {kind}, host string, path string, score double", run)
    rule, allow = rule_of(F.col("host"), F.col("path"), rules)
    blocks = F.coalesce(~allow, F.col("score") >= 0.5)
    return scored.select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"),
        F.when(blocks, "block").otherwise("allow").alias("verdict"), "score",
    )
