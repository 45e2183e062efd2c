"""Consistent placement by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table: it starts at
an offset and goes on by a step, both from a digest of its name. The shards take turns; on its
turn a shard claims the first slot in its order that is still free, until none is. A key's slot
is its digest modulo the table size, so placing a row is one lookup in a broadcast table whose
size depends on its two parameters alone. When a shard leaves, few other keys move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
#: Prime, and over a hundred slots a shard: the largest shard then holds about 1 % more than the mean.
SLOTS = 6421


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def digest_number(text: Column, at: int = 1) -> Column:
    """The eight hex digits of the text's MD5 from position `at` as a number."""
    return F.conv(F.substring(F.md5(text), at, 8), 16, 10).cast("bigint")


def names(shards: int) -> list[str]:
    return [f"shard-{i}" for i in range(shards)]


def slot_table(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """Rows (slot, shard): `slots` rows, `shard` the position in `shards`.

    The fill is one fold over the turns whose state is the free slots and the claims so far. A
    slot's place in a shard's order is ((slot - offset) / step) modulo the prime, so a turn takes
    the free slot with the least place.
    """
    if not _prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("the table size must be prime, and the shards distinct and no more than its slots")
    orders = []
    for name in shards:
        hexed = hashlib.md5(name.encode()).hexdigest()
        step = int(hexed[8:16], 16) % (slots - 1) + 1 if slots > 2 else 1
        orders.append((int(hexed[:8], 16) % slots, pow(step, -1, slots)))
    order = F.array(*[F.struct(F.lit(o).cast("bigint").alias("offset"), F.lit(i).cast("bigint").alias("inverse")) for o, i in orders])
    free = F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint"))

    def turn(state: Column, t: Column) -> Column:
        mine = F.element_at(state["orders"], (t % len(shards) + 1).cast("int"))
        # Binding through a one-element array evaluates the choice once.
        places = F.transform(
            F.array(mine),
            lambda m: F.array_min(
                F.transform(
                    state["free"],
                    lambda s: ((s - m["offset"] + slots) * m["inverse"]) % slots * slots + s,
                )
            )
            % slots,
        )
        return F.element_at(
            F.transform(
                places,
                lambda slot: F.struct(
                    F.array_remove(state["free"], slot).alias("free"),
                    F.array_append(state["claims"], slot).alias("claims"),
                    state["orders"].alias("orders"),
                ),
            ),
            1,
        )

    start = F.struct(free.alias("free"), F.array().cast("array<bigint>").alias("claims"), F.col("orders").alias("orders"))
    claims = F.aggregate(F.col("turns"), start, turn, lambda state: state["claims"])
    # A row of a range, not a literal: the fold then runs in a task and not while the plan is made.
    one = spark.range(1).select(
        F.sequence(F.col("id"), F.col("id") + (slots - 1)).alias("turns"),
        F.when(F.col("id") >= 0, order).alias("orders"),
    )
    claimed = one.select(F.posexplode(claims).alias("turn", "slot"))
    return claimed.select("slot", (F.col("turn") % len(shards)).cast("int").alias("shard"))


def place(df: DataFrame, key: str = "doc_id", shards: Sequence[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """`key` of every row with its `slot` and `shard`; no shuffle of `df`.

    A null key is placed like an empty text. Repeated rows are placed alike; other columns are not
    looked at. An empty table gives no rows.
    """
    table = slot_table(df.sparkSession, shards or names(SHARDS), slots)
    slot = digest_number(F.coalesce(F.col(key).cast("string"), F.lit(""))) % slots
    keyed = df.select(F.col(key), slot.alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select(key, "slot", "shard")


def oracle(table: str = "documents", key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> str:
    return f"""
WITH RECURSIVE orders AS (
  SELECT i, ('0x' || substr(md5('shard-' || i), 1, 8))::BIGINT % {slots} AS first,
         1 + ('0x' || substr(md5('shard-' || i), 9, 8))::BIGINT % {slots - 1} AS step
  FROM range({shards}) t(i)),
inverses AS (
  SELECT i, first, x AS inverse FROM orders JOIN range(1, {slots}) r(x) ON x * step % {slots} = 1),
fill AS (
  SELECT 0::BIGINT AS turn, range({slots}) AS free, -1::BIGINT AS slot
  UNION ALL
  SELECT turn + 1, list_filter(free, lambda s: s <> pick), pick
  FROM (SELECT turn, free, list_min(list_transform(free,
          lambda s: ((s - first + {slots}) * inverse) % {slots} * {slots} + s)) % {slots} AS pick
        FROM fill JOIN inverses ON i = turn % {shards} WHERE turn < {slots}))
SELECT {key}, f.slot, ((f.turn - 1) % {shards})::INTEGER AS shard
FROM (SELECT {key}, ('0x' || substr(md5(coalesce({key}::VARCHAR, '')), 1, 8))::BIGINT % {slots} AS slot FROM {table}) d
JOIN fill f ON f.slot = d.slot AND f.turn > 0"""
