"""Key state in buckets: a batch rewrites the buckets that its keys fall into and leaves the others alone.

A row's bucket is a hash of its key. Each write puts the touched buckets' new rows into folders of its own
and then one manifest, a numbered file that names every bucket's folder, in place by a rename. A
version counts once its manifest stands: a lost executor repeats tasks, a lost driver leaves the
version before, and of two writers that start from one version the second fails.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.files import Folder

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class BucketedTable:
    """Rows of `schema` by `keys`, in `buckets` folders; the manifest has a line for each, so its size is bounded by that."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, list(keys), buckets
        self.folder = Folder(spark, path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self) -> dict[int, str]:
        """Number -> manifest name of each version that stands."""
        named = (re.fullmatch(r"v(\d{8})\.json", n) for n in self.folder.names("versions"))
        return {int(m[1]): m[0] for m in named if m}

    def newest(self) -> int:
        return max(self.versions(), default=-1)

    def marked(self, mark: str) -> bool:
        """Whether a version that is still kept carries `mark`."""
        return any(json.loads(self.folder.read(f"versions/{name}"))["mark"] == mark for name in self.versions().values())

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """Bucket -> folder of its rows; without a version the newest, empty before the first."""
        held = self.versions()
        at = max(held, default=-1) if version is None else version
        if at < 0:
            return {}
        read = json.loads(self.folder.read(f"versions/{held[at]}"))
        if read["buckets"] != self.buckets or read["keys"] != self.keys:
            raise ValueError(f"{self.path} holds {read['buckets']} buckets by {read['keys']}")
        return {int(b): f for b, f in read["folders"].items()}

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows of a version, or those of some buckets."""
        held = self.manifest(version)
        paths = [f"{self.path}/{held[b]}" for b in sorted(held) if buckets is None or b in set(buckets)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets that the batch's keys fall into."""
        return sorted(r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect())

    def read_for(self, batch: DataFrame) -> DataFrame:
        """The state that the batch's keys can meet."""
        return self.read(buckets=self.touched(batch))

    def merge(self, batch: DataFrame, merge: Merge, mark: str = "", keep: int | None = None) -> int:
        """Write merge(state, batch) for the touched buckets as the next version; returns its number.

        `merge` may keep, change, add or leave out rows; it must not move a row to another key. A `mark`
        that a version carries already is passed over. With `keep` only so many versions stay.
        """
        if mark and self.marked(mark):
            return self.newest()
        before = self.newest()
        folders = self.manifest(before)
        buckets = self.touched(batch)
        held = self.read(before, buckets)
        name = f"data/{uuid.uuid4().hex}"
        rows = merge(held, batch).withColumn("_bucket", self.bucket())
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        written = {int(n[8:]) for n in self.folder.names(name) if n.startswith("_bucket=")}
        if not written <= set(buckets):
            raise ValueError("the merge moved rows to buckets that its batch does not touch")
        folders = {b: f for b, f in folders.items() if b not in buckets} | {b: f"{name}/_bucket={b}" for b in written}
        manifest = {"buckets": self.buckets, "keys": self.keys, "mark": mark, "folders": {str(b): folders[b] for b in sorted(folders)}}
        # A number that another writer took meanwhile is an error: the rows here were made from the version before that.
        self.folder.write(f"versions/v{before + 1:08d}.json", json.dumps(manifest))
        if keep is not None:
            self._forget(keep)
        return before + 1

    def _forget(self, keep: int) -> None:
        """Delete all but the newest versions, and the bucket folders that none of these names."""
        held = self.versions()
        stay = sorted(held)[-max(1, keep):]
        used = {f for v in stay for f in self.manifest(v).values()}
        gone = {f for v in held if v not in stay for f in self.manifest(v).values()} - used
        for version in set(held) - set(stay):
            self.folder.delete(f"versions/{held[version]}")
        for name in gone:
            self.folder.delete(name)
