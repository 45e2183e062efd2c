"""Sinks: snapshot with history, append logs, text documents."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postmill.files import Folder

HISTORY_KEYS = (
    "generated_at", "report_date", "source", "message_count", "job_count", "resolved_count",
    "total_jobs", "resolved_unique_jobs", "unresolved_jobs",
)


def run_parts(now: datetime) -> tuple[str, str]:
    return now.strftime("%Y-%m-%d"), now.strftime("%Y-%m-%dT%H%M%SZ")


def write_snapshot(df: DataFrame, root: str, group: str, now: datetime, summary: dict | None = None) -> str:
    """Dated copy of this run, the pointer that makes it the group's snapshot, and one log row.

    The pointer is one small file, put in place by a rename after the copy stands whole, so a reader sees
    the snapshot before or this one, and a failed write changes nothing.
    """
    day, slug = run_parts(now)
    history = f"{root}/history/{group}/report_date={day}/{slug}"
    df.write.mode("overwrite").parquet(history)
    Folder(df.sparkSession, root).write(f"{group}.current", json.dumps({"path": history, "schema": df.schema.json()}), replace=True)
    kept = {k: str(v) for k, v in (summary or {}).items() if k in HISTORY_KEYS}
    row = [(now.isoformat(), day, slug, f"{root}/{group}.current", history, kept)]
    schema = "logged_at string, report_date string, run_slug string, snapshot_path string, history_path string, summary map<string,string>"
    append_json(df.sparkSession.createDataFrame(row, schema), f"{root}/history/{group}_log")
    return history


def read_snapshot(spark: SparkSession, root: str, group: str) -> DataFrame | None:
    """The group's snapshot, null before the first one."""
    text = Folder(spark, root).read(f"{group}.current")
    if text is None:
        return None
    at = json.loads(text)
    return spark.read.schema(StructType.fromJson(json.loads(at["schema"]))).parquet(at["path"])


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that do not parse are left out; `bad_json_lines` has them."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def bad_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows (file, line) of the lines that `read_json_lines` leaves out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter(F.trim("line") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    return lines.filter(F.from_json("line", f"{schema}, _bad string", options)["_bad"].isNotNull())


def write_document(lines: DataFrame, order: list[Column], path: str, text: str = "line") -> None:
    """Ordered lines as text part files whose name order is the line order.

    Range partitions keep any single task from holding the document.
    """
    lines.orderBy(*order).select(F.col(text).alias("value")).write.mode("overwrite").text(path)
