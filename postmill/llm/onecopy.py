"""One row of each group of near-duplicates, decided row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.neardup import near_duplicates
from postmill.session import stage


def one_of_each(df: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `df`, all columns: of each group of near-duplicates the one with the smallest id, null ids last.

    A row is known by its id and a hash of its text, so rows that share an id but not a text are
    judged each by its own text. Of repeated rows of a group one stays. Null texts and texts without
    words belong to no group and all stay. An empty table gives no rows. What goes is looked up by a key
    that is unique but for repeated rows, so the join is even however large a group is.
    """
    number = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    own = F.concat(F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")), F.lit(":"), F.hex(number))
    keyed = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), own.alias("key"))
    found = near_duplicates(keyed, percent, words, "key", "text").filter("n_shingles > 0")
    nodes = stage(found.groupBy("key").agg(F.min("component_id").alias("component"), F.count("*").alias("copies")))
    known = F.regexp_extract("key", "(?s)^=(.*):[0-9A-F]+$", 1).cast(df.schema[id_col].dataType)
    id_ = F.when(F.col("key").startswith("="), known)
    first = nodes.groupBy("component").agg(F.min(F.struct(id_.isNull().alias("none"), id_.alias("id"), F.col("key"))).alias("first"))
    gone = nodes.select("key").join(first.select(F.col("first.key").alias("key")), "key", "left_anti")
    marked = df.withColumn("_key", own)
    kept = marked.join(gone.withColumnRenamed("key", "_key"), "_key", "left_anti")
    repeated = nodes.filter("copies > 1").select(F.col("key").alias("_key"))
    if not repeated.isEmpty():
        # Of equal keys only the first row of a task goes on to the shuffle.
        again = kept.join(repeated, "_key", "left_semi").withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy("_key")))
        kept = kept.join(repeated, "_key", "left_anti").unionByName(again.filter("_nth = 1").drop("_nth"))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
