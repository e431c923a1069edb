"""Static snapshot of the read views as JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noticelake.session import kept, shuffles_freed


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, json) with nulls kept as null."""
    rest = [c for c in rows.columns if c != key]
    return rows.select(key, F.to_json(F.struct(key, *rest), {"ignoreNullFields": "false"}).alias("json"))


def export_snapshot(items: DataFrame, details: DataFrame, meta: DataFrame, path: str, detail_key: str = "asked_id", file_bytes: int = 64 << 20) -> None:
    """``notices`` (list), ``meta``, ``details`` and ``detail_index``, as JSON lines.

    One file per notice would be millions of tiny files. Details are sorted by key into files of about ``file_bytes``
    of JSON, however many that makes; the index holds the least and the largest key of each, so that a reader of one
    copy opens the files that can hold it (``read_details``): one, unless a key has more rows than a file. The list and
    the details are gzip files, as they carry texts.
    """
    with shuffles_freed(details.sparkSession):
        # kept packed until the number of files is known; their bounds are then found in the key's column alone
        octets = Observation()
        counted = details.observe(octets, F.sum(F.octet_length(F.to_json(F.struct(*details.columns)))).alias("n"))
        with kept(counted, "details") as packed:
            files = max(1, -(-(octets.get["n"] or 0) // file_bytes))
            _write(packed.repartitionByRange(files, detail_key).sortWithinPartitions(detail_key), f"{path}/details")
        schema = f"{detail_key} {details.schema[detail_key].dataType.simpleString()}"
        stored = details.sparkSession.read.schema(schema).json(f"{path}/details")
        index = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.min(detail_key).alias("least"), F.max(detail_key).alias("largest"), F.count("*").alias("rows"))
        index.coalesce(1).write.mode("errorifexists").json(f"{path}/detail_index")
        _write(items, f"{path}/notices")
        meta.write.mode("errorifexists").json(f"{path}/meta")


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}).json(path)


def read_details(spark: SparkSession, path: str, schema: StructType, keys: list, detail_key: str = "asked_id") -> DataFrame:
    """Rows of the given keys, from the files that the index names for them."""
    kind = schema[detail_key].dataType
    index = spark.read.schema(StructType().add("file", "string").add("least", kind).add("largest", kind)).json(f"{path}/detail_index")
    between = reduce(lambda a, b: a | b, [F.lit(k).between(F.col("least"), F.col("largest")) for k in keys], F.lit(False))
    names = [r["file"] for r in index.filter(between).select("file").collect()]  # files of the keys asked for
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path}/details/{n}" for n in names]).filter(F.col(detail_key).isin(keys))
