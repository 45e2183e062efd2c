"""Operators 11 to 13 against brute force on hard rows: nulls, huge numbers, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from postmill.llm import clusters, codes
from postmill.llm import fingerprint as fp
from postmill.llm.integers import Totals


def single(x):
    return float(np.float32(x))


def long_or_none(v):
    return v if v < 2**63 else None


def drawn(n):
    rnd = np.random.default_rng(0)
    return [(i, [single(x) for x in rnd.normal(size=64) * 0.1 + (i % 5) * 0.05], i % 4 if i % 7 else None) for i in range(n)]


def hard():
    own = drawn(9)
    bad = [None, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] * 64]
    return [(5, own[5][1], 1), (5, own[6][1], 1), (None, own[7][1], 9)] + [(1000 + i, v, 1) for i, v in enumerate(bad)]


def scaled(vectors, scale, width=None):
    sound = [r for r in vectors if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(*r, [math.floor(Fraction(x) * scale) for x in r[1]]) for r in sound if width in (None, len(r[1]))]


def moved(own, assigned, number):
    mine = [v for v, a in zip(own, assigned, strict=True) if a == number]
    return [sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else None


def nearest(x, centres):
    return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))


def table(spark, vectors, kind="float"):
    df = spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    return df.withColumn("id", F.lit("clash")).withColumn("cluster", F.lit(7)).withColumn("vec", F.lit(None).cast("int"))


FEW = drawn(40)
WIDE = [(2000 + i, [single(1e30 * (i + 1))] * 64, i) for i in range(3)]
WIDEST = [(2000 + i, [1e308 * (1 - 0.3 * i)] * 64, 3) for i in range(3)]
TIES = [(i, [0.5 * ((i >> b) & 1) for b in range(3)] + [0.0] * 61, 0) for i in range(100)]
TABLES = {
    "many": (drawn(300) + hard(), "float"), "few": (drawn(3), "float"), "unsound": (hard()[3:], "float"), "wide": (FEW + WIDE, "float"),
    "widest": (FEW + WIDEST, "double"), "ties": (TIES, "float"), "none": ([], "float"),
}


# 11. Clusters -------------------------------------------------------------------------------------


def brute_clusters(vectors):
    kept = scaled(vectors, 1024, 64)
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    own, centres = [r[3] for r in kept], [r[3] for r in order[:8]]
    for _ in range(10):
        assigned = [nearest(x, centres)[1] for x in own]
        centres = [moved(own, assigned, j) or c for j, c in enumerate(centres)]
    last = [nearest(x, centres) for x in own]
    inertia = [sum(d for d, a in last if a == j) for j in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    whole = long_or_none(sum(inertia))
    return sorted(((r[0], a, long_or_none(d), long_or_none(inertia[a]), whole, digest[a]) for r, (d, a) in zip(kept, last, strict=True)), key=repr)


@pytest.mark.parametrize("name", TABLES)
def test_clusters_are_those_of_brute_force(spark, name):
    vectors, kind = TABLES[name]
    got = clusters.cluster(table(spark, vectors, kind)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == brute_clusters(vectors)
    if name == "many":
        assert sum(r.evaluations for r in got) < 0.4 * 11 * 8 * len(got)


def test_bounds_use_the_whole_displacement():
    # A centroid that comes back has not moved, however far it went.
    there = np.array([[0.0, 0.0], [100.0, 0.0]])
    away = np.array([[30.0, 0.0], [100.0, 0.0]])
    known = clusters.Rounds([there, away, there])
    assert known.moved.tolist() == [[0, 0], [30, 0], [0, 0]]
    near, stored, at, used = known.follow(np.array([[40.0, 0.0]]), np.array([0]), np.array([[40.0, 60.0]], np.float32), np.zeros((1, 2), np.int16))
    assert (near.tolist(), used.tolist()) == ([0], [0])
    known = clusters.Rounds([there, away])
    near, stored, at, used = known.follow(np.array([[60.0, 0.0]]), np.array([1]), np.array([[60.0, 40.0]], np.float32), np.zeros((1, 2), np.int16))
    assert (near.tolist(), used.tolist(), at.tolist(), stored.tolist()) == ([0], [2], [[1, 1]], [[30, 40]])


# 12. Codes ----------------------------------------------------------------------------------------


def brute_codes(vectors, parts=16):
    kept = scaled(vectors, 256)
    if not kept:
        return []
    each = max(1, -(-max(len(r[3]) for r in kept) // parts))
    cut = [[(r[3] + [0] * (each * parts))[p * each : (p + 1) * each] for p in range(parts)] for r in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:64]
    books = [[cut[k][p] for k in order] for p in range(parts)]
    for _ in range(2):
        for p in range(parts):
            own = [c[p] for c in cut]
            assigned = [nearest(x, books[p])[1] for x in own]
            books[p] = [moved(own, assigned, j) or e for j, e in enumerate(books[p])]
    last = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in row) for row in last]
    labels = {}
    for r, e in zip(kept, errors, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    rows = [(r[0], "".join(f"{j:02x}" for _, j in row), long_or_none(e), long_or_none(labels[r[2]]), digest) for r, row, e in zip(kept, last, errors, strict=True)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", [*TABLES, "ragged", "hollow"])
def test_codes_are_those_of_brute_force(spark, name):
    ragged = [(i, [0.5 * ((i >> b) & 1) for b in range(3)] + [0.0] * (i % 40), 0) for i in range(80)]
    vectors, kind = {**TABLES, "ragged": (ragged, "float"), "hollow": ([(i, [], None) for i in range(3)], "float")}[name]
    got = codes.codes(table(spark, vectors, kind).drop("cluster")).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_codes(vectors)
    if name == "many":
        assert 0 < got[0].evaluations < 0.2 * 16 * 64 * 3 * len(got)


def test_pivots_prune_only_what_is_further():
    rnd = np.random.default_rng(5)
    rows, book = rnd.integers(-40, 40, (500, 4)).astype(float), rnd.integers(-40, 40, (64, 4)).astype(float)
    fixed = book[codes.spread_out(book, 3)]
    far = np.sqrt(((rows[:, None] - fixed) ** 2).sum(axis=2)).astype(np.float32)
    entry, best, measured = codes.Books([book], [fixed]).nearest(0, rows, far)
    full = ((rows[:, None] - book) ** 2).sum(axis=2)
    assert (entry == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all() and measured < 0.3 * full.size


def test_sums_of_any_size_go_in_limbs():
    rnd = random.Random(2)
    want = [0] * 6
    parts = []
    for _ in range(5):
        totals = Totals(1, 6)
        values = [rnd.randint(-(1 << b), 1 << b) for b in (3, 31, 32, 63, 64, 900)]
        totals.add(0, slice(0, 6), values)
        want = [a + b for a, b in zip(want, values, strict=True)]
        parts += list(zip(*totals.limbs(), strict=True))
    assert all(-(1 << 32) <= v <= 1 << 32 for _, _, row in parts for v in row)
    assert [sum(row[i] << (32 * n) for _, n, row in parts) for i in range(6)] == want


# 13. Fingerprints ---------------------------------------------------------------------------------


def brute_sketch(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(fp.UPPER, fp.LOWER)))
    n = min(5, len(words))
    digests = {hashlib.md5(" ".join(words[i : i + n]).encode()).hexdigest()[:16] for i in range(len(words) - n + 1)} if words else set()
    return sorted(d for d in digests if d < fp.BELOW) or sorted(digests)[:1]


def brute_like(a, b):
    a, b = set(a), set(b)
    return round(len(a & b) / len(a | b), 9) if a | b else 1.0


def brute_fingerprints(rows):
    order, out = sorted((i is not None, i or 0, t or "") for i, t in rows), []
    for k, (known, i, text) in enumerate(order):
        other = order[(k + 1) % len(order)][2]
        q = len(text) // 4
        edited = text[: len(text) - q] + other[:q]
        own, changed = brute_sketch(text), brute_sketch(edited)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i if known else None, len(text), digest, "".join(own), "".join(changed), brute_like(own, changed), brute_like(own, brute_sketch(other))))
    return sorted(out, key=repr)


def fingerprint_rows():
    rnd = random.Random(3)
    words = ["Alpha ", "beta\n", "naïve ", "日本 ", "\U0001f600x "]
    rows = [(i * 3, "".join(rnd.choice([*words, f"w{rnd.randrange(99)} "]) for _ in range(rnd.choice([0, 1, 3, 9, 60, 300])))) for i in range(60)]
    again = [(13, "twice told tale of a")] * 41
    return rows + [(7, None), (8, ""), (10, "x" * 5000), (11, "lorem ipsum " * 30_000), (None, "no id")] + again


@pytest.mark.parametrize(("stretch", "piece"), [(256, 10_000), (4, 7)])
def test_fingerprints_are_those_of_brute_force(spark, monkeypatch, stretch, piece):
    monkeypatch.setattr(fp, "STRETCH", stretch)
    monkeypatch.setattr(fp, "PIECE", piece)
    full = fingerprint_rows()
    for rows in (full, full[:1], full[:5], full[:8], []):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("rank", F.lit(1)).withColumn("sketch", F.lit("x"))
        got = [(*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in fp.fingerprints(df).collect()]
        assert sorted(got, key=repr) == brute_fingerprints(rows)


def test_sketches_merge_and_contain(spark):
    rnd = random.Random(8)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(4000)]
    parts = [" ".join(words[at : at + 404]) for at in range(0, 4000, 400)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([" ".join(words), *parts, "w x", "", None])], "k int, text string")
    rows = df.select("k", fp.sketch(F.col("text")).alias("sketch"))
    sketches = {r.k: r.sketch for r in rows.collect()}
    assert (len(sketches[11]), sketches[12], sketches[13]) == (1, [], [])
    keyed = rows.withColumn("whole", F.when(F.col("k") == 0, "all").when(F.col("k") < 12, "parts").when(F.col("k") < 14, None))
    got = {r.whole: r.sketch for r in fp.merge_by(keyed, ["whole"]).collect()}
    assert set(sketches[0]) <= set(got["parts"]) == {d for k in range(1, 11) for d in sketches[k]} and got[None] == []
    one = keyed.filter("whole = 'parts'").agg(F.collect_list("sketch").alias("p")).select(fp.merged(F.col("p")).alias("m")).first()
    assert one.m == got["parts"]
    pair = rows.filter("k = 3").select(F.col("sketch").alias("small")).crossJoin(rows.filter("k = 0").select(F.col("sketch").alias("large")))
    inside, back, like = pair.select(fp.containment(F.col("small"), F.col("large")), fp.containment(F.col("large"), F.col("small")), fp.likeness(F.col("small"), F.col("large"))).first()
    assert inside == 1.0 and 0.05 < back < 0.16 and abs(like - back) < 1e-9
    assert fp.merge_by(keyed.limit(0), ["whole"]).count() == 0
