"""BPE encoding and decoding by a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that the merges produce. It starts as one
state with an arc for each base symbol. Each merge (u, v) -> w is one gadget: arcs on u are led
to a copy of u's state that lacks the arc on v, and wherever an arc on u stood, an arc on w is
added that leads to v's state. All arcs on one token always lead to one state, so the states
and arcs can be kept as parent links and looked up by walking them, newest first; looked-up
arcs are kept in a table. The state before merge r never changes after r.

A word's prefix has one accepted path, so encoding goes from left to right and finds for each
position the one token that ends there and has an arc from the state where it starts: work is
linear in the word, however long. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.batches import map_batches, texts

CACHE_WORDS = 400_000
ARC_ENTRIES = 500_000
#: Beyond this letter Unicode versions differ.
LATIN_END = "\u024f"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Automaton:
    """Compiled merges.

    By token: `left` part, `born` (merge that made it), `goes` (where its arcs lead), `copies` (the
    states made for it, with their merges in `copied`). By state: `parent`, `owner` (the token it
    was made for), `made` (merge). `lacks` holds each dropped arc (owner, token) with its merge.
    """

    def __init__(self, labels: list[str], ids: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.labels, self.ids, self.suffix = labels, ids, suffix
        self.left = [-1] * len(labels)
        self.born = [-1] * len(labels)
        self.twin = [False] * len(labels)
        self.goes = [0] * len(labels)
        self.parent, self.owner, self.made = [-1], [-1], [-1]
        self.copies: list[list[int]] = [[] for _ in labels]
        self.copied: list[list[int]] = [[] for _ in labels]
        self.lacks: dict[int, int] = {}
        self.dead: set[int] = set()
        self.arcs: dict[int, bool] = {}
        for order, (u, v) in enumerate(merges):
            self._gadget(order, ids[u], ids[v], ids[u + v])
        self.arcs = {}
        self.longest = max(map(len, labels), default=1)

    def _gadget(self, order: int, u: int, v: int, w: int) -> None:
        source, target = self.goes[u], self.goes[v]
        if self.born[w] >= 0 or u in self.dead or v in self.dead or not self._arc(source, v):
            self.dead.update([w] if self.born[w] < 0 else [])
            return
        self.left[w], self.born[w], self.twin[w] = u, order, u == v
        self.copies[u].append(len(self.parent))
        self.copied[u].append(order)
        self.lacks[u << 20 | v] = order
        self.goes[u] = len(self.parent)
        self.parent.append(source)
        self.owner.append(u)
        self.made.append(order)
        self.goes[w] = target

    def _arc(self, state: int, token: int) -> bool:
        while True:
            made, born = self.made[state], self.born[token]
            if made > born:
                owner = self.owner[state]
                if self.lacks.get(owner << 20 | token, made + 1) <= made:
                    return False
                before = bisect_right(self.copied[owner], born)
                state = self.copies[owner][before - 1] if before else self.parent[self.copies[owner][0]]
            elif born > made:
                token = self.left[token]
            elif born < 0:
                return True
            elif self.twin[token]:
                return False
            else:
                state, token = self.parent[state], self.left[token]

    def arc(self, key: int) -> bool:
        """Look up an arc by state << 20 | token and keep it in the table."""
        if len(self.arcs) >= ARC_ENTRIES:
            self.arcs.clear()
        found = self.arcs[key] = self._arc(key >> 20, key & 0xFFFFF)
        return found

    def word(self, letters: str) -> list[int]:
        """Ids of one pre-split word given as byte letters."""
        n = len(letters)
        if not n:
            return []
        find, dead, goes, suffix, arcs, longest = self.ids.get, self.dead, self.goes, self.suffix, self.arcs, self.longest
        state = [0] + [-1] * n
        token = [-1] * (n + 1)
        start = [0] * (n + 1)
        for end in range(1, n + 1):
            tail = suffix if end == n else ""
            for begin in range(max(0, end - longest), end):
                t = find(letters[begin:end] + tail)
                if t is None or t in dead:
                    continue
                key = state[begin] << 20 | t
                if arcs[key] if key in arcs else self.arc(key):
                    state[end], token[end], start[end] = goes[t], t, begin
                    break
        out = []
        while n:
            out.append(token[n])
            n = start[n]
        return out[::-1]


class _Words(dict):
    """Pre-split word -> its ids as little-endian bytes; forgets all when full."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.letters = automaton, byte_letters()

    def __missing__(self, word: str) -> bytes:
        letters = "".join([self.letters[b] for b in word.encode("utf-8", "replace")])
        found = np.array(self.automaton.word(letters), dtype="<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=2)
def _older_classes(pattern: str) -> tuple[regex.Pattern, regex.Pattern]:
    """Letters and digits that only newer Unicode tables hold, and the pattern without them.

    The regex module's tables are newer than those in public tokenizers. The interpreter's are at
    Unicode 15.1: letters and digits first assigned later than that count as neither here.
    """
    unassigned = "".join(c for c in map(chr, range(0x250, 0x110000)) if unicodedata.category(c) == "Cn")
    newer = "".join(regex.findall(r"[\p{L}\p{N}]", unassigned)) or "\uffff"
    listed = "[" + "".join(map(regex.escape, newer)) + "]"
    letters, digits = f"(?:(?!{listed})\\p{{L}})", f"(?:(?!{listed})\\p{{N}})"
    other = f"(?:{listed}|[^\\s\\p{{L}}\\p{{N}}])"
    old = pattern.replace("[^\\s\\p{L}\\p{N}]", other).replace("[\\p{L}]", letters).replace("[\\p{N}]", digits)
    return regex.compile(listed), regex.compile(old)


class Tokenizer:
    """Normalising, splitting and the automaton, from a vocabulary file's parsed JSON.

    Covers files of the kind of `word_bpe_49k.json`: NFC, white space as one blank, lower case,
    a split pattern whose matches are the words, byte letters, an end-of-word suffix.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        ids = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = [""] * (max([*ids.values(), *special.values()]) + 1)
        for text, i in [*ids.items(), *special.items()]:
            labels[i] = text
        self.automaton = Automaton(labels, ids, merges, model.get("end_of_word_suffix") or "")
        self.labels, self.special = labels, special
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        self.newer, self.old_split = _older_classes(pattern)
        self.ascii_split = re.compile(pattern.replace("\\p{L}", "a-z").replace("\\p{N}", "0-9"), re.ASCII)
        self.cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.words = _Words(self.automaton)

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for found in self.cut.finditer(text):
            out += [self._plain(text[at : found.start()]), np.array([self.special[found[0]]], "<u4").tobytes()]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            words = self.ascii_split.findall(text.lower())
        else:
            plain = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            split = self.old_split if max(plain) > LATIN_END and self.newer.search(plain) else self.split
            words = split.findall(plain)
        return b"".join(map(self.words.__getitem__, words))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def tokenizer_of(text: str) -> Tokenizer:
    return Tokenizer(json.loads(text))


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_tokens, ids) for each input row; `ids` is little-endian unsigned 32-bit.

    `vocabulary` is the path of the file on the driver; its text, a few MB, is broadcast, and each
    Python worker compiles the automaton once. A null text reads as empty and has no ids. Repeated
    rows give repeated results; other columns are not looked at.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batch: pa.RecordBatch) -> dict:
        tokenizer = tokenizer_of(spec.value)
        ids = [tokenizer.ids(t) for t in texts(batch.column(1))]
        return {"id": batch.column(0), "n_tokens": [len(i) // 4 for i in ids], "ids": ids}

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, f"id {kind}, n_tokens bigint, ids binary", run).withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row (id, text) for each input row: the labels of its ids, blank between; null ids give an empty text."""
    with open(vocabulary, encoding="utf-8") as file:
        spec = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batch: pa.RecordBatch) -> dict:
        tokenizer = tokenizer_of(spec.value)
        return {"id": batch.column(0), "text": [tokenizer.decode(i or b"") for i in batch.column(1).to_pylist()]}

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return map_batches(rows, f"id {kind}, text string", run).withColumnRenamed("id", id_col)


def digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass over the texts; per row n_tokens and SHA-256 of ids and decoded text.

    The same as `encode` followed by `decode` and hashing, without moving ids and texts, which are
    several times the input, between Spark and Python.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batch: pa.RecordBatch) -> dict:
        tokenizer = tokenizer_of(spec.value)
        n, ids_sha, text_sha = [], [], []
        for text in texts(batch.column(1)):
            ids = tokenizer.ids(text)
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(tokenizer.decode(ids).encode()).hexdigest())
        return {"id": batch.column(0), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_batches(rows, schema, run).withColumnRenamed("id", id_col)
