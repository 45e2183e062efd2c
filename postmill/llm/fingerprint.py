"""Document fingerprints by a threshold-scaled sketch.

A text's set holds the digests of its distinct shingles of five words. The sketch keeps every
digest below a fixed fraction of the range, whatever the set's size, so its size follows the
document's: one of 200 words and one of 200,000 are compared on the same part of the digests, and
the share of the smaller one's digests found in the larger one estimates containment. Sketches
of parts merge into the sketch of the whole by union. A set with nothing below the threshold
keeps its least digest, so only texts without words have an empty sketch; a merge drops such a
digest as soon as another part has one below the threshold.

Everything is SQL functions. A text is read by tasks that see only their own rows; the next
document of each comes from an order over ids alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import let
from postmill.llm.written import written
from postmill.operators.keyed import number_rows

#: A digest is kept if its 16 hex digits sort below this: one of eight.
BELOW = "2"
DIGITS = 16
WORDS = 5
#: Documents whose texts one group of the order holds.
STRETCH = 256
#: Repeated rows that one task writes at a time.
PIECE = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sketch(text: Column, below: str = BELOW, words: int = WORDS) -> Column:
    """Sorted distinct digests of the text's shingles below `below`, else its least one; fewer words are one shingle.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Null is like an empty text.
    """

    def digests(w: Column) -> Column:
        last = F.greatest(F.size(w) - words, F.lit(0))
        places = F.when(F.size(w) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            places, lambda i: F.substring(F.md5(F.concat_ws(" ", *[F.get(w, i + k) for k in range(words)]).cast("binary")), 1, DIGITS)
        )

    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return let(
        F.regexp_extract_all(lowered, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)),
        lambda w: let(digests(w), lambda d: retained(d, below)),
    )


def retained(digests: Column, below: str = BELOW) -> Column:
    """The sketch of a set of digests."""
    return let(
        F.filter(digests, lambda d: d < below),
        lambda low: F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(F.slice(F.array_sort(digests), 1, 1)),
    )


def merged(parts: Column, below: str = BELOW) -> Column:
    """The sketch of a union from the sketches (an array of them) of its parts."""
    return let(F.flatten(parts), lambda d: retained(d, below))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles in all shingles of both; 1 if neither has any."""
    return let(
        F.size(F.array_intersect(a, b)),
        lambda both: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both)),
    )


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first one's shingles that the second has; 1 if the first has none."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge_by(df: DataFrame, keys: list[str], col: str = "sketch", below: str = BELOW) -> DataFrame:
    """Rows (keys, `col`): one sketch for each key, merged from its rows' sketches.

    Digests meet as rows, so a hot key is combined before the shuffle and no task holds its rows;
    what comes out is as large as the sketch of the union. Keys whose sketches are all empty or
    null get an empty one; null keys are one key.
    """
    each = df.select(*keys, F.explode_outer(col).alias("_digest"))
    # The least digest tells whether a key needs one above the threshold.
    least = each.groupBy(*keys).agg(F.min("_digest").alias("_least"))
    low = each.filter(F.col("_digest") < below).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("_digest")).alias("_low"))
    named = [F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    out = least.join(low.select("_low", *named), same, "left")
    alone = F.when(F.col("_least").isNotNull(), F.array("_least")).otherwise(F.array().cast("array<string>"))
    return out.select(*keys, F.coalesce("_low", alone).alias(col))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, sketch, next_text, next_sketch) for every row of `df`.

    The next document is the one with the next id, after the last the first; rows that share an id
    stand in order of their texts' hashes, repeated rows one behind the other, null ids first.
    Ids are ranked in a narrow table. Texts move to stretches of `STRETCH` ranks, in which each sees
    the next; the first of a stretch goes to the one before as well. Repeated rows move as one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("hash", F.xxhash64("text"))
    groups = rows.groupBy("id", "hash").agg(F.count("*").alias("copies"))
    ranked = written(number_rows(groups, [F.asc_nulls_first("id"), F.asc("hash")], "rank"), "ranks")
    last, most = ranked.agg(F.coalesce(F.max("rank"), F.lit(1)), F.coalesce(F.max("copies"), F.lit(1))).first()
    known = ranked.select(F.col("id").alias("id_"), F.col("hash").alias("hash_"), "copies", (F.col("rank") - 1).alias("rank"))
    placed = rows.join(known, F.col("id").eqNullSafe(F.col("id_")) & (F.col("hash") == F.col("hash_"))).select("id", "text", "copies", "rank")
    if most > 1:
        again = placed.filter("copies > 1").groupBy("id", "rank", "copies").agg(F.any_value("text").alias("text"))
        placed = placed.filter("copies = 1").unionByName(again)
    stretch = F.floor(F.col("rank") / STRETCH)
    # Where a stretch begins its first document is the next one of the stretch before; the first of all follows the last.
    ahead = F.when(F.col("rank") == 0, F.lit((last - 1) // STRETCH)).when(F.col("rank") % STRETCH == 0, stretch - 1)
    place = F.when(F.col("rank") == 0, F.lit(last)).otherwise(F.col("rank"))
    seats = F.array(
        F.struct(stretch.alias("stretch"), F.col("rank").alias("place"), F.lit(True).alias("own")),
        F.struct(ahead.alias("stretch"), place.alias("place"), F.lit(False).alias("own")),
    )
    seated = placed.withColumn("seat", F.explode(F.filter(seats, lambda s: s["stretch"].isNotNull())))
    seated = seated.select("id", "text", "copies", "seat.stretch", "seat.place", "seat.own").repartition("stretch")
    seated = seated.withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("stretch").orderBy("place")
    seen = seated.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).filter("own")
    columns = ["id", "text", "sketch", "next_text", "next_sketch"]
    if most == 1:
        return seen.select(*columns)
    # All but the last of repeated rows are followed by their like; numbers of copies are dealt out in pieces.
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 2) / PIECE))).alias("piece")
    pieces = seen.filter("copies > 1").select("id", "text", "sketch", "copies", piece).repartition("id", "text", "piece")
    size = F.least(F.lit(PIECE), F.col("copies") - 1 - F.col("piece") * PIECE)
    like = pieces.select("id", "text", "sketch", F.col("text").alias("next_text"), F.col("sketch").alias("next_sketch"), F.explode(F.sequence(F.lit(1).cast("bigint"), size)))
    return seen.select(*columns).unionAll(like.select(*columns))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its fingerprint, that of its edited text, and how alike its own is to that and to the next document's.

    Edited, a text's last fourth (rounded down, in code points) gives way to the first as many of the
    next document. Null and empty texts have no words: their fingerprint is empty, and like only to an empty one.
    Repeated rows come out as often as they stand, each before the next; an only row is its own
    next. An empty table gives no rows. Other columns are not looked at.
    """
    fourth = "cast(floor(length(text) / 4) as int)"
    edited = F.expr(f"concat(substring(text, 1, length(text) - {fourth}), substring(next_text, 1, {fourth}))")
    rows = with_next(df, id_col, text_col).withColumn("edited", edited)
    # Through an array of one, so that each sketch is made once.
    rows = rows.select(
        "id", F.length("text").cast("bigint").alias("n_chars"), "sketch", "next_sketch",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.array(sketch(F.col("edited")))).alias("edited_sketch"),
    )
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        F.concat_ws("", "sketch").alias("fingerprint"), F.concat_ws("", "edited_sketch").alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def oracle() -> str:
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) - 1 AS r, count(*) OVER () AS n FROM documents),
e AS (SELECT a.r, a.doc_id, a.text, (a.r + 1) % a.n AS nr,
    substring(a.text, 1, length(a.text) - length(a.text) // 4) || substring(b.text, 1, length(a.text) // 4) AS edited
  FROM t a JOIN t b ON b.r = (a.r + 1) % a.n),
words AS (SELECT r, kind, regexp_extract_all(translate(x, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM (SELECT r, 0 AS kind, text AS x FROM e UNION ALL SELECT r, 1, edited FROM e)),
digests AS (SELECT DISTINCT r, kind, substring(md5(array_to_string(w[i : i + m - 1], ' ')), 1, {DIGITS}) AS d
  FROM (SELECT r, kind, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT r, kind, w, least(len(w), {WORDS}) AS m FROM words WHERE len(w) > 0))),
sketches AS (SELECT r, kind, CASE WHEN min(d) < '{BELOW}' THEN list(d ORDER BY d) FILTER (WHERE d < '{BELOW}') ELSE [min(d)] END AS s FROM digests GROUP BY r, kind),
all_of AS (SELECT e.*, coalesce(o.s, []) AS own, coalesce(x.s, []) AS ed, coalesce(y.s, []) AS nx
  FROM e LEFT JOIN sketches o ON o.r = e.r AND o.kind = 0 LEFT JOIN sketches x ON x.r = e.r AND x.kind = 1
  LEFT JOIN sketches y ON y.r = e.nr AND y.kind = 0)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
  array_to_string(own, '') AS fingerprint, array_to_string(ed, '') AS edited_fingerprint,
  CASE WHEN len(own) + len(ed) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(own, ed))::DOUBLE / (len(own) + len(ed) - len(list_intersect(own, ed))) END AS near_edited,
  CASE WHEN len(own) + len(nx) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(own, nx))::DOUBLE / (len(own) + len(nx) - len(list_intersect(own, nx))) END AS near_next
FROM all_of"""
