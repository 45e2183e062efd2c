"""Keyed state: first-wins dedup, quotas, anti joins, upserts, latest rows, numbering.

"First" is always the smallest value of an explicit ordinal. Three shapes keep a hot key
off any single task: aggregates that combine before the shuffle, `row_number() <= k`
filters (Spark keeps only k rows per key and task before the shuffle), and joins on the
unique ordinal instead of on the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import filled
from postmill.session import stage


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """First `k` rows per key under a total `order`; `rank` names a kept position column."""
    name = rank or "_rank"
    out = df.withColumn(
        name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def keep_first(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    return top_k(df, keys, [F.col(ordinal).asc()], 1)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key; later entries replace earlier ones."""
    return top_k(df, keys, [F.col(c).desc() for c in order], 1)


def mark_duplicates(
    df: DataFrame, keys: dict[str, Column], ordinal: str, flag: str, exempt: Column | None = None
) -> DataFrame:
    """Flag every row but the first of its key; rows under `exempt` are never duplicates.

    The first ordinals come from a combining aggregate over (keys, ordinal) only. They are
    unique, so the join back spreads evenly whatever the keys look like.
    """
    named = [key.alias(f"_k{i}") for i, key in enumerate(keys.values())]
    narrow = df if exempt is None else df.filter(~exempt)
    firsts = (
        narrow.select(F.col(ordinal).alias("_o"), *named)
        .groupBy(*[f"_k{i}" for i in range(len(named))])
        .agg(F.min("_o").alias("_first"))
        .select("_first")
    )
    joined = df.join(firsts, F.col(ordinal) == F.col("_first"), "left")
    later = F.col("_first").isNull()
    return joined.withColumn(flag, later if exempt is None else later & ~exempt).drop("_first")


def first_with_count(df: DataFrame, keys: Sequence[str], ordinal: str, count: str) -> DataFrame:
    """One row per key: its first row, and how many rows shared the key."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(
            F.min_by(F.struct(*rest), F.col(ordinal)).alias("_row"),
            F.count(F.lit(1)).alias(count),
        )
        .select(*keys, "_row.*", count)
    )


def quota(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    return top_k(df, keys, order, limit)


def mark_quota(
    df: DataFrame, keys: Sequence[str], ordinal: str, limit: int, wanted: Column, flag: str
) -> DataFrame:
    """Flag the first `limit` rows per key among those under `wanted`; all rows stay.

    The chosen ordinals are few (limit x keys); the join back is on the unique ordinal.
    """
    chosen = top_k(
        df.filter(wanted).select(*keys, ordinal), keys, [F.col(ordinal).asc()], limit
    ).select(F.col(ordinal).alias("_chosen"))
    joined = df.join(chosen, F.col(ordinal) == F.col("_chosen"), "left")
    return joined.withColumn(flag, F.col("_chosen").isNotNull()).drop("_chosen")


def unseen(df: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the state does not hold; null keys count as unseen."""
    return df.join(state.select(*keys).distinct(), list(keys), "left_anti")


def _spread_blank(key: Column, ordinal: Column) -> Column:
    """Blank keys match nothing; give each its own value so that they do not pile up."""
    return F.when(filled(key) != "", key).otherwise(F.concat(F.lit("\x00"), ordinal.cast("string")))


def merge_unmatched(
    base: DataFrame, extra: DataFrame, keys: Sequence[str], ordinal: str, origin: str | None = None
) -> DataFrame:
    """`base` plus the rows of `extra` that match it on none of `keys`.

    One anti join per key: a single join on an OR would be a nested loop. Blank keys never
    match, and rows of `extra` are not deduplicated among themselves.
    """
    left = extra
    for key in keys:
        known = base.filter(filled(key) != "").select(F.col(key).alias("_known")).distinct()
        left = (
            left.withColumn("_probe", _spread_blank(F.col(key), F.col(ordinal)))
            .join(known, F.col("_probe") == F.col("_known"), "left_anti")
            .drop("_probe")
        )
    if origin:
        base = base.withColumn(origin, F.lit("base"))
        left = left.withColumn(origin, F.lit("extra"))
    return base.unionByName(left, allowMissingColumns=True)


def upsert_seen(
    state: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    seen_at: Column,
    ordinal: str,
    attributes: Sequence[str] = (),
) -> DataFrame:
    """Known keys move only `last_seen_at`; new keys enter with both times and their attributes.

    The batch is combined to one row per key before the shuffle, so both join sides hold
    unique keys.
    """
    usable = batch
    for key in keys:
        usable = usable.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    fresh = usable.groupBy(*keys).agg(
        F.min(seen_at).alias("_in"),
        F.max(seen_at).alias("_out"),
        *(
            [F.min_by(F.struct(*attributes), F.col(ordinal)).alias("_new")] if attributes else []
        ),
    )
    held = state.select(
        *keys,
        F.col("first_seen_at").alias("_first"),
        F.col("last_seen_at").alias("_last"),
        *([F.struct(*attributes).alias("_old")] if attributes else []),
    )
    merged = held.join(fresh, list(keys), "full_outer")
    kept = [
        F.when(F.col("_first").isNotNull(), F.col("_old")[a]).otherwise(F.col("_new")[a]).alias(a)
        for a in attributes
    ]
    return merged.select(
        *keys,
        F.coalesce("_first", "_in").alias("first_seen_at"),
        F.greatest("_last", "_out").alias("last_seen_at"),
        *kept,
    )


def replace_rows(state: DataFrame, batch: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Whole-row upsert: the batch's last row per key replaces what the state held."""
    newest = latest(batch, keys, [ordinal])
    kept = state.join(newest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(newest.drop(ordinal) if ordinal not in state.columns else newest)


def number_rows(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Global running number 1..n in `order` without a single-task window.

    Rows are range-partitioned and sorted, staged once, and each partition's offset is the
    sum of the sizes before it. The offset table has one row per partition.
    """
    staged = stage(
        df.orderBy(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    sizes = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_at") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    return (
        staged.join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_before") + place + 1)
        .drop("_part", "_at", "_before")
    )


def slice_rows(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 0) -> DataFrame:
    """The run's slice in input order; limit 0 means all."""
    out = df.orderBy(*order).offset(offset) if offset else df.orderBy(*order)
    return out.limit(limit) if limit > 0 else out
