"""Keyed tables in hash buckets: a version writes pieces of the buckets it touches, and reads no other bucket.

    <path>/rows/bucket=<n>/piece=<version>-<delta|base>/part-*.parquet
    <path>/versions/version=<v>/part-*.parquet     one row: the version is complete; ``top`` is a number kept beside it

A delta holds the newest rows of some keys, a base all rows of a bucket up to its version. The state of a bucket is its
newest base and the deltas behind it. Nothing is ever changed in place: a version that is written again after a failure
replaces its own pieces only, and files of untouched buckets stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MERGE_AFTER = 8  # deltas of a bucket that are merged into a base


def _names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Values in the names ``prefix=value`` of a folder's folders."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return []
    found = [s.getPath().getName() for s in files.listStatus(target)]
    return sorted(n[len(prefix) + 1 :] for n in found if n.startswith(prefix + "="))


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@dataclass(frozen=True)
class Piece:
    bucket: int
    version: int
    base: bool
    path: str


@dataclass(frozen=True)
class BucketedTable:
    """A table with one live row per ``keys``; ``by`` (some of the keys) decide the bucket. Rows have the columns of
    ``struct`` and no others. If it has a boolean column ``live``, rows that are not live are deletions."""

    spark: SparkSession
    path: str
    struct: T.StructType
    keys: tuple[str, ...]
    by: tuple[str, ...]
    buckets: int = 64
    merge_after: int = MERGE_AFTER

    @property
    def columns(self) -> list[str]:
        return self.struct.names

    def bucket(self, *by: Column) -> Column:
        return F.pmod(F.xxhash64(*(by or [F.col(c) for c in self.by])), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, *by: Column) -> list[int]:
        """The buckets of ``rows``: at most ``buckets`` numbers."""
        return sorted(r["b"] for r in rows.select(self.bucket(*by).alias("b")).distinct().collect())

    # ---- versions ------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(v) for v in _names(self.spark, f"{self.path}/versions", "version")]

    def last(self, before: int | None = None) -> int:
        """The newest complete version (older than ``before``); -1 if there is none."""
        return max((v for v in self.versions() if before is None or v < before), default=-1)

    def top(self, version: int) -> int:
        """The number kept beside a version; -1 before the first."""
        return self.spark.read.parquet(f"{self.path}/versions/version={version}").first()["top"] if version >= 0 else -1

    def close(self, version: int, top: int = -1) -> None:
        """Declare the version complete. Its older marks are not needed any more but for the one before."""
        self.spark.range(1).select(F.lit(top).cast("long").alias("top")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")
        for v in self.versions():
            if v < version - 1:
                _remove(self.spark, f"{self.path}/versions/version={v}")

    # ---- pieces --------------------------------------------------------------------------------------

    def pieces(self, upto: int, touched: list[int] | None = None) -> list[Piece]:
        """What makes up the state at ``upto``: of each bucket the newest base and the deltas behind it."""
        rows = f"{self.path}/rows"
        out: list[Piece] = []
        for name in _names(self.spark, rows, "bucket"):
            if touched is not None and int(name) not in touched:
                continue
            own = []
            for piece in _names(self.spark, f"{rows}/bucket={name}", "piece"):
                version, kind = piece.split("-")
                own.append(Piece(int(name), int(version), kind == "base", f"{rows}/bucket={name}/piece={piece}"))
            own = [p for p in own if p.version <= upto]
            base = max((p.version for p in own if p.base), default=-1)
            out += [p for p in own if (p.base and p.version == base) or (not p.base and p.version > base)]
        return out

    def write(self, rows: DataFrame, version: int, base: bool = False) -> None:
        """One piece of each bucket that ``rows`` touch. Rows meet by bucket, so that a piece is one file, or as many as a
        large bucket is worth."""
        piece = f"{version:012d}-{'base' if base else 'delta'}"
        rows = rows.select(*self.columns, self.bucket().alias("bucket"), F.lit(piece).alias("piece")).hint("rebalance", "bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "piece").parquet(f"{self.path}/rows")

    def _load(self, pieces: list[Piece], columns: list[str]) -> DataFrame:
        wanted = T.StructType([f for f in self.struct if f.name in columns])
        full = T.StructType([*wanted, T.StructField("bucket", T.IntegerType()), T.StructField("piece", T.StringType())])
        if not pieces:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.path}/rows").parquet(*[p.path for p in pieces])

    def read(self, upto: int | None = None, touched: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
        """The newest row of each key at a version, of some buckets and columns (keys always). Deletions are left out.

        Only rows in deltas are compared by version; rows of a base whose key is in no delta pass through.
        """
        columns = [c for c in self.columns if columns is None or c in columns or c in self.keys or c == "live"]
        pieces = self.pieces(self.last() if upto is None else upto, touched)
        deltas, bases = [p for p in pieces if not p.base], [p for p in pieces if p.base]
        out = self._load(bases, columns).select(*columns)
        if deltas:
            payload = [c for c in columns if c not in self.keys] or [self.keys[0]]
            newest = self._load(deltas, columns).groupBy(*self.keys).agg(F.max_by(F.struct(*payload), "piece").alias("_v"))
            newest = newest.select(*[F.col(f"_v.{c}").alias(c) if c not in self.keys else F.col(c) for c in columns])
            if bases:
                pairs = [out[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
                out = out.join(newest.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]), pairs, "left_anti").unionByName(newest)
            else:
                out = newest
        return out.filter("live").drop("live") if "live" in columns else out

    def compact(self, upto: int, keep: Column | None = None) -> list[int]:
        """Merge buckets with ``merge_after`` deltas or more, as they are at the complete version ``upto``; the buckets merged.

        A job that fails in between finds either the deltas or the base. Rows that do not satisfy ``keep`` are let go.
        """
        pieces = self.pieces(upto)
        count: dict[int, int] = {}
        for p in pieces:
            count[p.bucket] = count.get(p.bucket, 0) + (not p.base)
        merged = sorted(b for b, n in count.items() if n >= self.merge_after)
        if merged:
            rows = self.read(upto, merged)
            rows = rows.filter(keep) if keep is not None else rows
            rows = rows.withColumn("live", F.lit(True)) if "live" in self.columns else rows
            self.write(rows, upto, base=True)
            # a bucket whose rows are all deleted has no base now; older pieces go first, deletions last
            for p in pieces:
                if p.bucket in merged and not (p.base and p.version == upto):
                    _remove(self.spark, p.path)
        return merged
