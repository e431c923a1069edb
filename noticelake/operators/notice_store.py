"""Stored notices in hash buckets: a batch is classified, applied and grouped by reading the buckets it touches.

Five keyed tables make up a store. ``notices`` holds the rows, ``checked`` the last crawl of unchanged ones, ``groups`` the
canonical row of each id. ``by_key`` holds the same-notice candidates, bucketed by duplicate key and day, so that even a
key with very many posts is read a few days at a time; ``by_root`` holds the copies of each canonical row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.dims import DEDUP_WINDOW_DAYS
from noticelake.functions import text
from noticelake.operators import resolve
from noticelake.operators.cdc import KEY, classify_upsert
from noticelake.operators.skew import with_global_index
from noticelake.session import ensure_checkpoint_dir
from noticelake.sources.bucketed import BucketedTable

BUCKETS = 64
_OWN = ["id", *KEY, "crawled_at", "content_updated_at"]
_SPOT = ["dedup_key", "published_at"]


def _days(rows: DataFrame) -> DataFrame:
    """(dedup_key, published_at) of all places within reach of these rows."""
    near = F.sequence(F.date_sub("published_at", DEDUP_WINDOW_DAYS), F.date_add("published_at", DEDUP_WINDOW_DAYS))
    return rows.filter("dedup_key is not null and published_at is not null").select("dedup_key", F.explode(near).alias("published_at")).distinct()


class NoticeStore:
    """Notices under ``path`` with the content columns of ``schema`` (of crawled rows, or of stored ones).

    ``grouped`` also keeps canonical groups; rows then need title and published_at. ``buckets`` is fixed for a store:
    ``rebucket`` writes a larger one. A batch is a version; the versions before it stay readable until the batch after.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, grouped: bool = False, buckets: int = BUCKETS, **options):
        ensure_checkpoint_dir(spark)
        self.spark, self.path, self.grouped, self.buckets, self.options = spark, path, grouped, buckets, options
        self.content = T.StructType([f for f in schema if f.name not in (*_OWN, "dup_of")])
        own = "id long, source string, source_notice_id string, crawled_at timestamp, content_updated_at timestamp"

        def table(name: str, columns: str, keys: list[str], by: list[str], more: T.StructType | None = None) -> BucketedTable:
            fields = T.StructType([*T.StructType.fromDDL(columns), *(more or [])])
            return BucketedTable(spark, f"{path}/{name}", fields, tuple(keys), tuple(by), buckets, **options)

        self.notices = table("notices", own, KEY, KEY, self.content)
        self.checked = table("checked", "source string, source_notice_id string, crawled_at timestamp", KEY, KEY)
        self.groups = table("groups", "id long, dup_of long", ["id"], ["id"])
        self.by_key = table("by_key", "dedup_key string, published_at date, id long, source string, dup_of long, live boolean", [*_SPOT, "id"], _SPOT)
        self.by_root = table("by_root", "root long, id long, live boolean", ["root", "id"], ["root"])
        self.tables = [self.checked, *([self.groups, self.by_key, self.by_root] if grouped else []), self.notices]

    @property
    def version(self) -> int:
        return self.notices.last()

    def snapshot(self, version: int | None = None) -> DataFrame:
        """Every stored notice with all its columns, as of a version."""
        version = self.version if version is None else version
        checked = self.checked.read(version).withColumnRenamed("crawled_at", "_checked")
        rows = self.notices.read(version).join(checked, KEY, "left")
        rows = rows.withColumn("crawled_at", F.greatest("crawled_at", "_checked")).drop("_checked")
        return rows.join(self.groups.read(version), "id", "left") if self.grouped else rows

    def seed(self, rows: DataFrame) -> None:
        """The first version: stored rows with their ids. Groups are worked out from scratch."""
        full = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(self.notices.struct[c].dataType).alias(c) for c in self.notices.columns])
        self.notices.write(full, 0, base=True)
        if self.grouped:
            keyed = full.select("id", "source", "published_at", text.dedup_key(F.col("title")).alias("dedup_key")).checkpoint()
            placed = keyed.join(resolve.assign_canonical(keyed), "id").withColumn("live", F.lit(True)).checkpoint()
            self._write_groups(placed, placed.filter("dup_of is not null").select(F.col("dup_of").alias("root"), "id", "live"), placed, 0, base=True)
        self.notices.close(0, full.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top")).first()["top"])

    def rebucket(self, path: str, buckets: int) -> NoticeStore:
        """The same notices under another path and with another number of buckets."""
        other = NoticeStore(self.spark, path, self.content, self.grouped, buckets, **self.options)
        for mine, its in zip(self.tables, other.tables, strict=True):
            rows = mine.read(self.version)
            its.write(rows.withColumn("live", F.lit(True)) if "live" in mine.columns else rows, 0, base=True)
        other.notices.close(0, self.notices.top(self.version))
        return other

    # ---- a batch ---------------------------------------------------------------------------------------

    def apply(self, incoming: DataFrame, version: int, order: list[str]) -> DataFrame:
        """Store a batch of crawled rows (one per key) as a version; (source, source_notice_id, id, status, changed, crawled_at).

        New rows get ids above all stored ones, in ``order``. A change takes all content columns that ``incoming`` has
        and keeps the others; unchanged rows only have their crawl time noted. In a grouped store, edits are placed
        first in id order, then the new rows in theirs. A version that is applied again replaces its own pieces.
        """
        before = self.notices.last(version)
        for t in self.tables:
            t.compact(before)
        touched = self.notices.touched(incoming)
        facts = list(dict.fromkeys([*KEY, "title", "content_hash", "crawled_at", *order]))
        stored = self.notices.read(before, touched, ["id", "title", "content_hash"])
        narrow = incoming.select(*facts)
        marked = narrow.join(classify_upsert(narrow, stored), KEY).checkpoint()
        found = {r["status"]: r["count"] for r in marked.groupBy("status").count().collect()}
        fresh = with_global_index(marked.filter("status = 'new'").select(*list(dict.fromkeys([*KEY, *order]))), [F.col(c).asc() for c in [*order, *KEY]], "id")
        fresh = fresh.select(*KEY, (F.col("id") + self.notices.top(before) + 1).alias("id"))
        edited = marked.filter("status = 'updated'").select(*KEY, F.col("stored_id").alias("id"))
        if "new" in found or "updated" in found:
            self._write_rows(incoming, fresh, edited, before, touched, version)
        if "unchanged" in found:
            self.checked.write(marked.filter("status = 'unchanged'").select(*KEY, "crawled_at"), version)
        if self.grouped:
            self._group(incoming, fresh, marked.filter("status = 'updated'"), before, touched, version)
        self.notices.close(version, self.notices.top(before) + found.get("new", 0))
        ids = fresh.withColumnRenamed("id", "_new")
        return marked.join(ids, KEY, "left").select(*KEY, F.coalesce("stored_id", "_new").alias("id"), "status", "changed", "crawled_at")

    def _write_rows(self, incoming: DataFrame, fresh: DataFrame, edited: DataFrame, before: int, touched: list[int], version: int) -> None:
        given = [c for c in self.content.names if c in incoming.columns]
        carried = [c for c in self.content.names if c not in incoming.columns]
        # rows and their texts meet the ids of new and edited ones once
        ids = fresh.withColumn("_edited", F.lit(False)).unionByName(edited.withColumn("_edited", F.lit(True)))
        rows = incoming.select(*KEY, "crawled_at", *given).join(ids, KEY)
        rows = rows.withColumn("content_updated_at", F.when(F.col("_edited"), F.col("crawled_at")))
        if carried:
            rows = rows.join(self.notices.read(before, touched, carried).select(*KEY, *carried), KEY, "left")
        self.notices.write(rows, version)

    def _group(self, incoming: DataFrame, fresh: DataFrame, updated: DataFrame, before: int, touched: list[int], version: int) -> None:
        spot = incoming.select(*KEY, "published_at", text.dedup_key(F.col("title")).alias("dedup_key"))
        arrived = spot.join(fresh, KEY).select("id", "source", *_SPOT).checkpoint()
        old = self.notices.read(before, touched, ["id", "title", "published_at"])
        old = old.select("id", "published_at", text.dedup_key(F.col("title")).alias("dedup_key"))
        edits = spot.withColumnsRenamed({"dedup_key": "new_key", "published_at": "new_day"}).join(
            updated.select(*KEY, F.col("stored_id").alias("id"), F.array_contains("changed", "title").alias("regroup")), KEY)
        edits = edits.join(old, "id").filter("regroup or not (published_at <=> new_day)").drop("source_notice_id").checkpoint()
        ids = edits.select("id")
        edits = edits.join(self.groups.read(before, self.groups.touched(ids)), "id", "left").checkpoint()

        asked = edits.filter("regroup").select(F.col("new_key").alias("dedup_key"), F.col("new_day").alias("published_at")).unionByName(arrived.select(*_SPOT))
        wanted = _days(asked).checkpoint()
        near = self.by_key.read(before, self.by_key.touched(wanted)).join(wanted, _SPOT, "left_semi")
        still = near.join(ids, "id", "left_anti").checkpoint()
        copies = self.by_root.read(before, self.by_root.touched(ids, F.col("id")))
        copies = copies.join(ids, "id", "left_anti").join(ids.select(F.col("id").alias("root")), "root", "left_semi")
        moved = resolve.regroup(edits, still, copies.select(F.col("root").alias("id")).distinct())
        edits = edits.join(moved.select("id", "new_dup_of"), "id").checkpoint()

        now = edits.select("id", "source", F.col("new_key").alias("dedup_key"), F.col("new_day").alias("published_at"), F.col("new_dup_of").alias("dup_of"))
        known = still.select("id", "source", *_SPOT, "dup_of").unionByName(now)
        placed = resolve.place_new(arrived, known.select("id", "source", *_SPOT, F.coalesce("dup_of", "id").alias("root")))
        placed = arrived.join(placed, "id").checkpoint()

        live, gone = F.lit(True).alias("live"), F.lit(False).alias("live")
        place_changed = "not (dedup_key <=> new_key and published_at <=> new_day)"
        group_changed = edits.filter("not (dup_of <=> new_dup_of)")
        left = edits.filter(place_changed).select(*_SPOT, "id", "source", "dup_of", gone)
        spots = placed.select(*_SPOT, "id", "source", "dup_of", live).unionByName(now.select(*_SPOT, "id", "source", "dup_of", live)).unionByName(left)
        roots = placed.select(F.col("dup_of").alias("root"), "id", live).unionByName(group_changed.select(F.col("new_dup_of").alias("root"), "id", live))
        roots = roots.unionByName(group_changed.select(F.col("dup_of").alias("root"), "id", gone)).filter("root is not null")
        self._write_groups(spots, roots, placed.select("id", "dup_of").unionByName(group_changed.select("id", F.col("new_dup_of").alias("dup_of"))), version)

    def _write_groups(self, spots: DataFrame, roots: DataFrame, groups: DataFrame, version: int, base: bool = False) -> None:
        self.by_key.write(spots.filter("dedup_key is not null and published_at is not null"), version, base)
        self.by_root.write(roots, version, base)
        self.groups.write(groups.select("id", "dup_of"), version, base)


def upsert(store: NoticeStore, incoming: DataFrame, order: list[str]) -> DataFrame:
    """Apply a batch as the next version; what happened to each of its rows."""
    return store.apply(incoming, store.version + 1, order)


def bytes_behind(table: BucketedTable, rows: DataFrame, *by: Column) -> int:
    """Bytes of the files that a batch of ``rows`` has to look at."""
    spark = table.spark
    total = 0
    for piece in table.pieces(table.last(), table.touched(rows, *by)):
        target = spark._jvm.org.apache.hadoop.fs.Path(piece.path)
        total += target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    return total
