"""Opportunity notes that follow their score: a change set against the notes held, and an idempotent file writer.

A note is known by its bare name. Its path holds its latest score, so a new score moves it. Reviews are
rows of their own, keyed by note, run and ordinal: a repeated run writes the same keys again and changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.files import opened
from postmill.functions.text import update_note_front_matter
from postmill.operators.keyed import top_k
from postmill.state import BucketedTable

NOTES = "note_name string, folder string, file_name string, head string"
REVIEWS = "note_name string, run_label string, ordinal bigint, review string"
HISTORY = "\n## Review history\n\n"


def scored_path_name(fresh: DataFrame):
    """`NN - name`, two digits at least."""
    text = F.col("score").cast("string")
    return F.concat(F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text), F.lit(" - "), F.col("note_name"))


def note_changes(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """What a run does to its notes: note_name, change, folder, file_name, head, old_folder, old_file_name.

    `held`: NOTES. `fresh`: note_name, folder, score, verdict, mode, note (the text of a new note), stub, ordinal.
    The run's last scored row of a note decides its score and place, the first one the text of a new note.
    A stub (a note filed without a score) only stands in where there is none. `change` is insert, move, update or keep.
    """
    name = ["note_name"]
    first = top_k(fresh, name, [F.col("stub").asc(), F.col("ordinal").asc()], 1).select("note_name", "note")
    last = top_k(fresh, name, [F.col("stub").asc(), F.col("ordinal").desc()], 1).drop("note")
    met = last.join(first, name).join(held.withColumnsRenamed({"folder": "old_folder", "file_name": "old_file_name", "head": "old_head"}), name, "left")
    known = F.col("old_file_name").isNotNull()
    stays = known & F.col("stub")
    scored = update_note_front_matter(F.when(known, F.col("old_head")).otherwise(F.col("note")), F.col("score"), F.col("verdict"), F.col("mode"))
    head = F.when(stays, F.col("old_head")).when(F.col("stub"), F.col("note")).otherwise(scored)
    placed = met.select(
        "note_name", "old_folder", "old_file_name", "old_head", head.alias("head"),
        F.when(stays, F.col("old_folder")).otherwise(F.col("folder")).alias("folder"),
        F.when(stays, F.col("old_file_name")).otherwise(scored_path_name(met)).alias("file_name"),
    )
    moved = (F.col("folder") != F.col("old_folder")) | (F.col("file_name") != F.col("old_file_name"))
    change = (
        F.when(F.col("old_file_name").isNull(), "insert").when(moved, "move").when(F.col("head") != F.col("old_head"), "update").otherwise("keep")
    )
    return placed.select("note_name", change.alias("change"), "folder", "file_name", "head", "old_folder", "old_file_name")


def record_notes(notes: BucketedTable, reviews: BucketedTable, fresh: DataFrame, run_label: str) -> DataFrame:
    """Take a run into both tables; returns the change set.

    `fresh` also has `review`. A run that is repeated, after a failure half way too, leaves the same notes
    and reviews: reviews go by key, and a note that has its place and score is kept.
    """
    written = fresh.filter(~F.col("stub")).select("note_name", F.lit(run_label).alias("run_label"), F.col("ordinal").cast("bigint").alias("ordinal"), "review")
    reviews.merge(written, lambda held, new: held.join(new, ["note_name", "run_label", "ordinal"], "left_anti").unionByName(new))
    before = notes.newest()
    # Against the version before, which stays readable: what this run did to it.
    changes = note_changes(notes.read(before) if before >= 0 else notes.spark.createDataFrame([], NOTES), fresh)
    columns = ["note_name", "folder", "file_name", "head"]

    def apply(held: DataFrame, new: DataFrame) -> DataFrame:
        now = note_changes(held, new).select(*columns)
        return held.join(now, "note_name", "left_anti").unionByName(now)

    notes.merge(fresh, apply)
    return changes


def write_note_files(changes: DataFrame, reviews: DataFrame, root: str) -> None:
    """Bring files under `root` (a folder or a URI that all tasks reach) in line with a change set.

    Each note's head and reviews stream in order into a draft, which takes its place by a rename; then the
    old path goes. Running it again gives the same files.
    """
    heads = changes.select("note_name", F.lit("").alias("run_label"), F.lit(-1).cast("bigint").alias("ordinal"), F.col("head").alias("text"), "folder", "file_name", "old_folder", "old_file_name")
    none = [F.lit(None).cast("string").alias(c) for c in ("folder", "file_name", "old_folder", "old_file_name")]
    asked = reviews.join(changes.select("note_name"), "note_name", "left_semi")
    pieces = heads.unionByName(asked.select("note_name", "run_label", "ordinal", F.col("review").alias("text"), *none))
    ordered = pieces.repartition("note_name").sortWithinPartitions("note_name", "run_label", "ordinal")
    ordered.foreachPartition(lambda rows: _write_files(rows, root))


def _write_files(rows: Iterator, root: str) -> None:
    from pyarrow import fs

    system, base = opened(root)
    out = draft = note = None

    def close() -> None:
        if out is None:
            return
        out.close()
        path = f"{base}/{note.folder}/{note.file_name}".replace("//", "/")
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        system.move(draft, path)
        old = f"{base}/{note.old_folder}/{note.old_file_name}".replace("//", "/")
        if note.old_file_name is not None and old != path and system.get_file_info(old).type == fs.FileType.File:
            system.delete_file(old)

    first = True
    for row in rows:
        if row.file_name is not None:
            close()
            system.create_dir(base, recursive=True)
            note, draft, first = row, f"{base}/.draft-{uuid.uuid4().hex}", True
            out = system.open_output_stream(draft, compression=None)
        elif first:
            out.write(HISTORY.encode())
            first = False
        out.write((row.text or "").encode() + (b"" if row.file_name is not None else b"\n"))
    close()
