"""Token counts that follow edits.

A document's pre-tokens (the pieces its text is split into before merging) are kept as leaves of
a segment tree; a leaf holds some consecutive pieces, and every node the sums of characters, pieces and
tokens below it. An edit is located by descending on characters. Splitting starts again at the
leaf border that lies at least three pieces before the edit, since a piece may depend on the two
characters after it, and goes on until a new piece starts where an old leaf started behind the edit: from
there on the old pieces stand. Only that region is encoded anew; its leaves and the sums above
them are updated.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.batches import map_batches

LEAF_PIECES = 64
CONTEXT_PIECES = 3
CACHE_PIECES = 400_000
EDITS_PER_ROUND = 10_000
EDITS = "array<struct<at:bigint,cut:bigint,put:string>>"
LEAVES = "array<struct<chars:bigint,pieces:bigint,tokens:bigint>>"


class Pieces(dict):
    """Piece -> its number of tokens; forgets all when full."""

    def __init__(self, ranks: str, pattern: str):
        super().__init__()
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.pattern = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 64:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = n
        return n


@lru_cache(maxsize=2)
def pieces_of(ranks: str, pattern: str) -> Pieces:
    return Pieces(ranks, pattern)


class Tree:
    """Sums over leaves in an implicit binary tree: node 1 is the root, node i has 2i and 2i + 1 below it."""

    def __init__(self, leaves: np.ndarray):
        self.width = 1 << max(0, int(len(leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 3), np.int64)
        self.sums[self.width : self.width + len(leaves)] = leaves
        level = self.width
        while level > 1:
            level //= 2
            self.sums[level : 2 * level] = self.sums[2 * level : 4 * level].reshape(level, 2, 3).sum(axis=1)

    @classmethod
    def of(cls, text: str, pieces: Pieces) -> Tree:
        found = pieces.pattern.findall(text)
        if not found:
            return cls(np.zeros((1, 3), np.int64))
        rows = np.ones((len(found), 3), np.int64)
        rows[:, 0] = np.fromiter(map(len, found), np.int64, len(found))
        rows[:, 2] = np.fromiter(map(pieces.__getitem__, found), np.int64, len(found))
        return cls(np.add.reduceat(rows, np.arange(0, len(found), LEAF_PIECES), axis=0))

    def leaves(self) -> np.ndarray:
        return self.sums[self.width :]

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 2])

    def locate(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one that is not empty, beyond the end) and where it starts."""
        node, start = 1, 0
        while node < self.width:
            left = int(self.sums[2 * node, 0])
            if at < start + left or not self.sums[2 * node + 1, 0]:
                node = 2 * node
            else:
                node, start = 2 * node + 1, start + left
        return node - self.width, start

    def put(self, leaf: int, row: tuple[int, int, int]) -> None:
        node = self.width + leaf
        change = np.array(row, np.int64) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, text: str, at: int, cut: int, put: str, pieces: Pieces) -> tuple[str, int]:
        """Replace `cut` characters from `at` by `put`; the new text and how many characters were encoded anew."""
        at = min(max(at, 0), len(text))
        cut = min(max(cut, 0), len(text) - at)
        new = text[:at] + put + text[at + cut :]
        first, start = self.locate(max(0, at - 1))
        # Pieces before the edit in the first leaf are unknown, so whole leaves before it give the context.
        held = 0
        while first and held < CONTEXT_PIECES:
            first -= 1
            held += int(self.sums[self.width + first, 1])
            start -= int(self.sums[self.width + first, 0])
        last, border = self.locate(at + cut)
        border += int(self.sums[self.width + last, 0])
        shift = len(put) - cut
        rows, here = [], start
        for match in pieces.pattern.finditer(new, start):
            while last + 1 < self.width and border + shift < here:
                last += 1
                border += int(self.sums[self.width + last, 0])
            if here == border + shift and border >= at + cut and border < len(text):
                break
            rows.append((match.end() - here, 1, pieces[match[0]]))
            here = match.end()
        else:
            last = self.width - 1
        whole = np.array(rows, np.int64).reshape(-1, 3)
        slots = last - first + 1
        parts = np.array_split(whole, slots) if len(whole) >= slots else [whole[i : i + 1] for i in range(slots)]
        for leaf, part in zip(range(first, last + 1), parts, strict=True):
            self.put(leaf, tuple(part.sum(axis=0)) if len(part) else (0, 0, 0))
        return new, here - start

    def grown(self) -> bool:
        """Whether edits have made a leaf several times as large as a new one."""
        return bool((self.leaves()[:, 1] > 8 * LEAF_PIECES).any())


def _shared(df: DataFrame, vocabulary: str, pattern: str):
    with open(vocabulary, encoding="ascii") as file:
        return df.sparkSession.sparkContext.broadcast((file.read(), pattern))


def build_trees(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, leaves, n_tokens), one per row of `df`; a null text reads as empty."""
    spec = _shared(df, vocabulary, pattern)

    def run(batch: pa.RecordBatch) -> dict:
        pieces = pieces_of(*spec.value)
        trees = [Tree.of(t or "", pieces) for t in batch.column(1).to_pylist()]
        return {"id": batch.column(0), "text": batch.column(1), "leaves": _rows(trees), "n_tokens": [t.tokens for t in trees]}

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_batches(rows, f"id {kind}, text string, leaves {LEAVES}, n_tokens bigint", run).withColumnRenamed("id", id_col)


def _rows(trees: list[Tree]) -> list[list[dict]]:
    return [[dict(zip(("chars", "pieces", "tokens"), map(int, row), strict=True)) for row in t.leaves()] for t in trees]


def edit_trees(trees: DataFrame, edits: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, text, leaves, n_tokens) after all edits (id, seq, at, cut, put) in the order of `seq`.

    Positions are characters of the text as it stands when the edit's turn comes; beyond the text
    they are drawn to its end; null positions, lengths and texts read as 0, 0 and empty. Edits of ids
    without a tree do nothing; equal `seq` go by position, length and text. A document takes at
    most EDITS_PER_ROUND edits in one pass, so that an often edited document's edits never meet in
    one row; trees of repeated ids are all edited.
    """
    spec = _shared(trees, vocabulary, pattern)
    turn = F.row_number().over(Window.partitionBy("id").orderBy("seq", "at", "cut", "put"))
    plain = edits.select(
        F.col(id_col).alias("id"), "seq", F.coalesce(F.col("at"), F.lit(0)).cast("bigint").alias("at"),
        F.coalesce(F.col("cut"), F.lit(0)).cast("bigint").alias("cut"), F.coalesce(F.col("put"), F.lit("")).alias("put"),
    ).filter(F.col("id").isNotNull())
    numbered = plain.withColumn("turn", turn - 1)
    rounds = numbered.agg(F.max("turn")).first()[0]

    def run(batch: pa.RecordBatch) -> dict:
        pieces = pieces_of(*spec.value)
        texts, done = [], []
        for text, leaves, changes in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            tree = Tree(np.array([[r["chars"], r["pieces"], r["tokens"]] for r in leaves], np.int64).reshape(-1, 3))
            for change in changes or []:
                text, _ = tree.edit(text, change["at"], change["cut"], change["put"], pieces)
                if tree.grown():
                    tree = Tree.of(text, pieces)
            texts.append(text)
            done.append(tree)
        return {"id": batch.column(0), "text": texts, "leaves": _rows(done), "n_tokens": [t.tokens for t in done]}

    kind = trees.schema[id_col].dataType.simpleString()
    out = trees.select(F.col(id_col).alias("id"), "text", "leaves", "n_tokens")
    for at in range(0 if rounds is None else rounds // EDITS_PER_ROUND + 1):
        part = numbered.filter(F.floor(F.col("turn") / EDITS_PER_ROUND) == at)
        listed = part.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "at", "cut", "put"))).alias("edits"))
        joined = out.join(listed, "id", "left").select("id", "text", "leaves", "edits")
        out = map_batches(joined, f"id {kind}, text string, leaves {LEAVES}, n_tokens bigint", run)
    return out.withColumnRenamed("id", id_col)


def count_edits(df: DataFrame, vocabulary: str, pattern: str, edits: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Build, edit and count in one pass: `edits` is an array column of (at, cut, put) of the row itself.

    Rows (id, n_chars, n_tokens, n_edits, n_chars_after, n_tokens_after, n_chars_encoded), one per
    row of `df`. A null text reads as empty, null edits as none; null fields as 0, 0 and empty.
    """
    spec = _shared(df, vocabulary, pattern)
    names = ["n_chars", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "n_chars_encoded"]

    def run(batch: pa.RecordBatch) -> dict:
        pieces = pieces_of(*spec.value)
        found = []
        for text, changes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text, changes = text or "", changes or []
            tree = Tree.of(text, pieces)
            before, encoded = (len(text), tree.tokens), 0
            for change in changes:
                text, n = tree.edit(text, change["at"] or 0, change["cut"] or 0, change["put"] or "", pieces)
                encoded += n
                if tree.grown():
                    tree = Tree.of(text, pieces)
            found.append((*before, len(changes), len(text), tree.tokens, encoded))
        columns = list(zip(*found, strict=True)) or [()] * len(names)
        return {"id": batch.column(0), **{n: c for n, c in zip(names, columns, strict=True)}}

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), edits.cast(EDITS).alias("edits"))
    return map_batches(rows, f"id {kind}, " + ", ".join(f"{n} bigint" for n in names), run).withColumnRenamed("id", id_col)
