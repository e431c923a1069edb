"""Cross-posted copies: same-notice rule, canonical assignment and re-assignment.

Two posts are the same notice when they come from different boards, share a non-null duplicate key
and were published at most three days apart. A row joins its *lowest-id* match and takes that row's
root, so groups are stars around a canonical row, not connected components.

Pairs are never produced. Rows are first reduced to cells (key, board, day) with the lowest id and a
count; a popular key has at most boards x days cells however many rows it has. Everything a row needs
to know is then one lookup of its own cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.dims import DEDUP_WINDOW_DAYS
from noticelake.functions.dates import days_apart
from noticelake.operators.skew import hot_lookup_join
from noticelake.session import ensure_checkpoint_dir

CELL = ["dedup_key", "source", "published_at"]


def is_same_notice(a: Column, b: Column) -> Column:
    """The rule for two given rows (structs with source, dedup_key, published_at)."""
    return F.coalesce(
        (a["source"] != b["source"])
        & (a["dedup_key"] == b["dedup_key"])
        & (days_apart(a["published_at"], b["published_at"]) <= DEDUP_WINDOW_DAYS),
        F.lit(False),
    )


def _cells(notices: DataFrame) -> DataFrame:
    keyed = notices.filter(F.col("dedup_key").isNotNull() & F.col("published_at").isNotNull())
    return keyed.groupBy(*CELL).agg(F.min("id").alias("m"), F.count("*").alias("n"))


def _reach(cells: DataFrame) -> DataFrame:
    """Every cell once per day it can be matched from."""
    w = DEDUP_WINDOW_DAYS
    days = F.sequence(F.date_sub("published_at", w), F.date_add("published_at", w))
    return (
        cells.withColumn("day", F.explode(days))
        .groupBy("dedup_key", "day", "source")
        .agg(F.min("m").alias("m"), F.sum("n").alias("n"))
    )


def _two_best(reach: DataFrame) -> DataFrame:
    """Per (key, day): the lowest id and the lowest id of any other board."""
    w = Window.partitionBy("dedup_key", "day").orderBy("m")
    top = reach.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 2)
    return top.groupBy("dedup_key", "day").agg(
        F.min(F.when(F.col("rn") == 1, F.col("m"))).alias("m1"),
        F.min(F.when(F.col("rn") == 1, F.col("source"))).alias("s1"),
        F.min(F.when(F.col("rn") == 2, F.col("m"))).alias("m2"),
    )


def _cell_matches(notices: DataFrame) -> DataFrame:
    """Cells with ``hit``: the lowest id another board has within reach of the cell's day."""
    cells = _cells(notices)
    best = _two_best(_reach(cells)).withColumnRenamed("day", "published_at")
    hit = F.when(F.col("s1") != F.col("source"), F.col("m1")).otherwise(F.col("m2"))
    return cells.join(best, ["dedup_key", "published_at"], "left").withColumn("hit", hit).drop("m1", "s1", "m2")


def same_notice_partners(notices: DataFrame) -> DataFrame:
    """Per row: how many rows are the same notice, and the lowest such id (null when none)."""
    cells = _cells(notices)
    reach = _reach(cells)
    totals = reach.groupBy("dedup_key", "day").agg(F.sum("n").alias("n_all"))
    own = reach.select("dedup_key", F.col("day").alias("published_at"), "source", F.col("n").alias("n_own"))
    cell = (
        _cell_matches(notices)
        .join(totals.withColumnRenamed("day", "published_at"), ["dedup_key", "published_at"], "left")
        .join(own, CELL, "left")
        .select(*CELL, "n", "hit", (F.col("n_all") - F.col("n_own")).alias("n_partners"))
    )
    rows = notices.select("id", *CELL)
    out = hot_lookup_join(rows, cell, CELL, "id", "n")
    return out.select("id", F.coalesce("n_partners", F.lit(0)).alias("n_partners"), F.col("hit").alias("lowest_partner"))


def _roots(pointers: DataFrame) -> DataFrame:
    """(m, parent) with parent < m to (m, root) by pointer jumping; each round halves the depth."""
    ensure_checkpoint_dir(pointers.sparkSession)
    cur = pointers.select("m", F.col("parent").alias("root")).checkpoint()
    while True:
        up = cur.select(F.col("m").alias("root"), F.col("root").alias("up"))
        nxt = (
            cur.join(up, "root", "left")
            .select("m", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved"))
            .checkpoint()
        )
        if nxt.filter("moved").isEmpty():
            return nxt.select("m", "root")
        cur = nxt.select("m", "root")


def assign_canonical(notices: DataFrame) -> DataFrame:
    """(id, dup_of) for rows inserted in id order; ``dup_of`` is null for canonical rows.

    Needs id, source, published_at and dedup_key. These narrow rows are checkpointed first, so titles are
    read and normalised once however many jobs follow. Keys are as long as titles and every cell is shuffled once per
    day in reach, so 128 bits of their SHA-256 stand for them.
    """
    ensure_checkpoint_dir(notices.sparkSession)
    digest = F.unhex(F.substring(F.sha2(F.col("dedup_key").cast("string"), 256), 1, 32))
    notices = notices.withColumn("dedup_key", digest).select("id", *CELL).checkpoint()
    cells = _cell_matches(notices)
    pointers = cells.filter(F.col("hit") < F.col("m")).select("m", F.col("hit").alias("parent"))
    roots = _roots(pointers).withColumnsRenamed({"m": "hit"})
    cell = cells.join(roots, "hit", "left").select(*CELL, "n", "hit", F.coalesce("root", "hit").alias("root"))
    rows = hot_lookup_join(notices, cell, CELL, "id", "n")
    return rows.select("id", F.when(F.col("hit") < F.col("id"), F.col("root")).alias("dup_of"))


def place_new(arrived: DataFrame, known: DataFrame) -> DataFrame:
    """(id, dup_of) of newly arrived rows (id, source, published_at, dedup_key), placed in id order.

    ``known``: id, source, published_at, dedup_key and root of rows placed before, or of the lowest id of each of their
    cells. Ids of arrived rows are above all of them. A known row's root is taken as it is stored.
    """
    ensure_checkpoint_dir(arrived.sparkSession)
    arrived = arrived.select("id", *CELL)
    keyed = known.filter(F.col("dedup_key").isNotNull() & F.col("published_at").isNotNull())
    cells = keyed.groupBy(*CELL).agg(F.min("id").alias("id"), F.min_by("root", "id").alias("root")).checkpoint()
    matches = _cell_matches(arrived.unionByName(cells.select("id", *CELL))).checkpoint()
    placed = cells.select(F.col("id").alias("m"), F.col("root").alias("known_root"))
    pointers = matches.join(placed, "m", "left").filter("known_root is null and hit < m").select("m", F.col("hit").alias("parent"))
    ends = _roots(pointers).select(F.col("m").alias("hit"), F.col("root").alias("end"))
    cell = matches.join(ends, "hit", "left").withColumn("end", F.coalesce("end", "hit"))
    cell = cell.join(placed.withColumnRenamed("m", "end"), "end", "left")
    cell = cell.select(*CELL, "n", "hit", F.coalesce("known_root", "end").alias("root"))
    out = hot_lookup_join(arrived, cell, CELL, "id", "n")
    return out.select("id", F.when(F.col("hit") < F.col("id"), F.col("root")).alias("dup_of"))


def with_groups(notices: DataFrame, assigned: DataFrame | None = None) -> DataFrame:
    """Notices plus ``dup_of`` and ``group_id`` (the canonical row's id). ``assigned``: kept rows of ``assign_canonical``."""
    assigned = assign_canonical(notices) if assigned is None else assigned
    return notices.join(assigned, "id").withColumn("group_id", F.coalesce("dup_of", "id"))


def orphan_groups(notices: DataFrame) -> DataFrame:
    """``group_id`` where a copy whose canonical row is missing stands on its own, listed last."""
    # one row per canonical with its copy count, so a canonical with very many copies is spread
    parents = notices.select(F.col("id").alias("dup_of"), F.lit(True).alias("has_parent"))
    sizes = notices.groupBy("dup_of").agg(F.count("*").alias("n")).filter("dup_of is not null")
    lookup = sizes.join(parents, "dup_of", "left")
    rows = hot_lookup_join(notices, lookup, ["dup_of"], "id", "n")
    orphan = F.col("dup_of").isNotNull() & F.col("has_parent").isNull()
    group = F.when(F.col("dup_of").isNull() | orphan, F.col("id")).otherwise(F.col("dup_of"))
    return rows.select("*", orphan.alias("is_orphan"), group.alias("group_id")).drop("has_parent")


def reassign_changed(store: DataFrame, changed: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """Re-assignment after title edits: (id, old_dup_of, new_dup_of) for the changed rows.

    ``store``: id, source, published_at, dedup_key and dup_of before the edits. ``changed``: id and new_key.
    """
    base = store.select("id", "source", "published_at", "dedup_key", "dup_of")
    fresh = base.join(changed.select("id", "new_key"), "id").withColumns({"new_day": F.col("published_at"), "regroup": F.lit(True)})
    still = base.join(changed.select("id"), "id", "left_anti")
    wanted = changed.filter("new_key is not null").select(F.col("new_key").alias("dedup_key")).distinct()
    copies = still.filter("dup_of is not null").select(F.col("dup_of").alias("id")).distinct()
    return regroup(fresh, still.join(wanted, "dedup_key", "left_semi"), copies, bucket)


def regroup(fresh: DataFrame, still: DataFrame, copies_kept: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """(id, old_dup_of, new_dup_of) of edited rows, from these and the rows that they can meet alone.

    ``fresh``: id, source, published_at, dedup_key and dup_of before the edits, new_day and new_key after them, and
    regroup (false: the row takes its new place but keeps its group). ``still``: id, source, published_at, dedup_key and
    dup_of of all other rows with one of the new keys within reach of a new day; more do no harm. ``copies_kept``: ids that
    have a copy among rows that are not edited.

    Rows are edited in id order; each looks at the store as it is at its turn. All ids count as
    candidates, not only earlier ones. A row that still has copies at its turn stays where it is.

    At the turn of row r a changed row q counts with its new key when q < r, else with its old key. So
    the hit is the lowest of: unchanged rows, changed rows before r (new keys), changed rows after r
    (old keys). Which rows keep their place depends only on rows with smaller ids, so repeating the
    assignment until nothing moves gives the sequential result; the number of rounds is the depth of
    that dependency, not the number of rows.
    """
    ensure_checkpoint_dir(fresh.sparkSession)
    fresh = fresh.select("id", "source", "published_at", "dedup_key", "dup_of", "new_day", "new_key", "regroup").checkpoint()
    base = still.select("id", "dup_of").unionByName(fresh.select("id", "dup_of"))
    new_rows = fresh.select("id", "source", F.col("new_day").alias("published_at"), F.col("new_key").alias("dedup_key"))
    static_best = _two_best(_reach(_cells(still))).checkpoint()
    fresh_best = _two_best(_reach(_cells(new_rows))).checkpoint()

    def best(table: DataFrame, name: str) -> DataFrame:
        hit = F.when(F.col("s1") != F.col("source"), F.col("m1")).otherwise(F.col("m2"))
        rows = new_rows.join(table.withColumnRenamed("day", "published_at"), ["dedup_key", "published_at"], "left")
        return rows.select("id", hit.alias(name))

    hits = best(static_best, "static_hit").join(best(fresh_best, "early_hit"), "id").join(_next_old(fresh, bucket), "id", "left")
    early = F.when(F.col("early_hit") < F.col("id"), F.col("early_hit"))
    plan = fresh.select("id", "dup_of", "regroup").join(hits.select("id", F.least("static_hit", early, "late_hit").alias("hit"), early.alias("early")), "id")
    # where an already edited row is the hit, its new place is followed; otherwise the stored one
    follow = F.col("hit") == F.col("early")
    stored = base.select(F.col("id").alias("hit"), F.coalesce("dup_of", "id").alias("stored_root"))
    plan = plan.join(stored, "hit", "left").select("id", "dup_of", "regroup", "hit", "stored_root", follow.alias("follow"))
    later_copy = fresh.groupBy(F.col("dup_of").alias("root")).agg(F.max("id").alias("last_copy"))
    stays = (
        plan.join(copies_kept.withColumn("kept", F.lit(True)), "id", "left")
        .join(later_copy.withColumnRenamed("root", "id"), "id", "left")
        .select("*", (~F.col("regroup") | F.col("kept").isNotNull() | F.coalesce(F.col("last_copy") > F.col("id"), F.lit(False))).alias("fixed"))
        .drop("kept", "last_copy", "regroup")
        .checkpoint()
    )
    start = F.when(F.col("fixed"), F.col("dup_of")).otherwise(F.when(~F.coalesce("follow", F.lit(False)), F.col("stored_root")))
    cur = stays.select("id", start.alias("new_dup_of")).checkpoint()
    while True:
        place = cur.select(F.col("id").alias("hit"), F.coalesce("new_dup_of", "id").alias("place"))
        joined_by_earlier = (
            cur.filter("new_dup_of is not null").groupBy(F.col("new_dup_of").alias("id")).agg(F.min("id").alias("first_copy"))
        )
        step = (
            stays.join(place, "hit", "left")
            .join(joined_by_earlier, "id", "left")
            .join(cur, "id")
            .withColumn("stay", F.col("fixed") | F.coalesce(F.col("first_copy") < F.col("id"), F.lit(False)))
            .withColumn(
                "next",
                F.when(F.col("stay"), F.col("dup_of")).otherwise(F.when(F.col("follow"), F.col("place")).otherwise(F.col("stored_root"))),
            )
            .select("id", "dup_of", F.col("next"), (~F.col("next").eqNullSafe(F.col("new_dup_of"))).alias("moved"))
            .checkpoint()
        )
        if step.filter("moved").isEmpty():
            return step.select("id", F.col("dup_of").alias("old_dup_of"), F.col("next").alias("new_dup_of"))
        cur = step.select("id", F.col("next").alias("new_dup_of"))


def _next_of_other_board(rows: DataFrame, part: list[str]) -> DataFrame:
    """Per asking row: the next candidate (by pos) of another board. Running windows, linear in the rows."""
    before = Window.partitionBy(*part).orderBy(F.desc("pos"), F.desc("is_ask")).rowsBetween(Window.unboundedPreceding, -1)
    cand = F.when(~F.col("is_ask"), F.struct("m", "source"))
    near = rows.withColumn("n1", F.last(cand, ignorenulls=True).over(before))
    turn = F.when(~F.col("is_ask") & (F.col("n1.source") != F.col("source")), F.col("n1.m"))
    near = near.withColumn("n2", F.last(turn, ignorenulls=True).over(before)).filter("is_ask")
    return near.withColumn("next", F.when(F.col("n1.source") != F.col("source"), F.col("n1.m")).otherwise(F.col("n2")))


def _next_old(fresh: DataFrame, bucket: int) -> DataFrame:
    """Per changed row: the lowest later changed row whose *old* key matches the row's new key.

    "Lowest later id" is a successor search. Ids are cut into buckets: the row's own bucket is searched
    row by row, later buckets through the first row each board has in them.
    """
    w = DEDUP_WINDOW_DAYS
    b = F.floor(F.col("id") / bucket)
    days = F.explode(F.sequence(F.date_sub("published_at", w), F.date_add("published_at", w)))
    ask = fresh.filter("new_key is not null and new_day is not null").select(
        F.col("new_key").alias("key"), F.col("new_day").alias("day"), "source", F.col("id").alias("m"), b.alias("b"))
    old = (
        fresh.filter("dedup_key is not null and published_at is not null")
        .select(F.col("dedup_key").alias("key"), days.alias("day"), "source", F.col("id").alias("m"), b.alias("b"))
        .join(ask.select("key").distinct(), "key", "left_semi")
    )
    rows = old.withColumn("is_ask", F.lit(False)).unionByName(ask.withColumn("is_ask", F.lit(True)))
    own = _next_of_other_board(rows.withColumn("pos", F.col("m")), ["key", "day", "b"])
    own = own.select(*["key", "day", "b", "source"], F.col("m").alias("id"), F.col("next").alias("in_bucket"))

    heads = old.groupBy("key", "day", "b", "source").agg(F.min("m").alias("m"))
    heads = heads.select("key", "day", "b", "source", "m", F.lit(False).alias("is_ask"), F.col("m").alias("pos"))
    cells = ask.select("key", "day", "b", "source").distinct()
    cells = cells.select("*", F.lit(None).cast("long").alias("m"), F.lit(True).alias("is_ask"), ((F.col("b") + 1) * bucket - 1).alias("pos"))
    beyond = _next_of_other_board(heads.unionByName(cells), ["key", "day"]).select(
        "key", "day", "b", "source", F.col("next").alias("beyond"))
    out = own.join(beyond, ["key", "day", "b", "source"], "left")
    return out.select("id", F.coalesce("in_bucket", "beyond").alias("late_hit"))
