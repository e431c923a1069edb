"""Copy resolution against a row-by-row simulation on random fixtures."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from noticelake.functions.text import dedup_key
from noticelake.operators import resolve
from noticelake.operators.skew import hot_lookup_join, rank_in_group, with_global_index
from noticelake.streaming import jobs

SCHEMA = "id long, source string, published_at date, dedup_key string, dup_of long"


class Store:
    """Sequential rule: look for the lowest-id match and take its root."""

    def __init__(self):
        self.rows = {}

    def place(self, i):
        me = self.rows[i]
        if any(r["dup_of"] == i for r in self.rows.values()):
            return
        me["dup_of"] = None
        for j in sorted(self.rows):
            other = self.rows[j]
            if (
                j != i and me["key"] and other["key"] == me["key"] and other["source"] != me["source"]
                and me["day"] and other["day"] and abs((other["day"] - me["day"]).days) <= 3
            ):
                me["dup_of"] = other["dup_of"] if other["dup_of"] is not None else j
                return

    def insert(self, i, source, day, key):
        self.rows[i] = {"source": source, "day": day, "key": key, "dup_of": None}
        self.place(i)


def random_store(seed, size=40):
    rnd, store = random.Random(seed), Store()
    for n in range(size):
        key = rnd.choice([None, *[f"s{seed}k{k}" for k in range(3)]])
        day = rnd.choice([None, *[date(2026, 9, 1) + timedelta(days=d) for d in range(9)]])
        store.insert(seed * 1000 + n, f"board{rnd.randrange(4)}", day, key)
    return rnd, store


def frame(spark, stores):
    rows = [(i, r["source"], r["day"], r["key"], r["dup_of"]) for s in stores for i, r in s.rows.items()]
    return spark.createDataFrame(rows, SCHEMA)


def test_assignment_equals_row_by_row_simulation(spark):
    stores = [random_store(seed)[1] for seed in range(40)]
    got = {r["id"]: r["dup_of"] for r in resolve.assign_canonical(frame(spark, stores).drop("dup_of")).collect()}
    want = {i: r["dup_of"] for s in stores for i, r in s.rows.items()}
    assert got == want
    roots = {v for v in got.values() if v is not None}
    assert all(got[r] is None for r in roots)  # groups have depth one


def test_chain_ends_at_first_notice(spark):
    days = [date(2026, 9, 1), date(2026, 9, 4), date(2026, 9, 7)]
    rows = [(n + 1, f"b{n % 2}", d, "samekey", None) for n, d in enumerate(days)]
    got = {r["id"]: r["dup_of"] for r in resolve.assign_canonical(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: None, 2: 1, 3: 1}


def test_partner_counts(spark):
    stores = [random_store(seed)[1] for seed in range(6)]
    df = frame(spark, stores)
    a, b = df.alias("a"), df.alias("b")
    same = resolve.is_same_notice(F.struct("a.*"), F.struct("b.*"))
    want = {r["id"]: (r["n"], r["low"]) for r in a.join(b, F.expr("a.dedup_key = b.dedup_key")).filter(same).groupBy("a.id").agg(
        F.count("*").alias("n"), F.min("b.id").alias("low")).collect()}
    got = {r["id"]: (r["n_partners"], r["lowest_partner"]) for r in resolve.same_notice_partners(df).collect()}
    assert {i: v for i, v in got.items() if v[0]} == want


def test_reassignment_equals_row_by_row_simulation(spark):
    stores, before, changes = [], [], []
    for seed in range(60):
        rnd, store = random_store(seed, 24)
        before += [(i, r["source"], r["day"], r["key"], r["dup_of"]) for i, r in store.rows.items()]
        for i in sorted(rnd.sample(sorted(store.rows), 12)):
            key = rnd.choice([None, *[f"s{seed}k{k}" for k in range(3)]])
            changes.append((i, key))
            store.rows[i]["key"] = key
            store.place(i)
        stores.append(store)
    out = resolve.reassign_changed(spark.createDataFrame(before, SCHEMA), spark.createDataFrame(changes, "id long, new_key string"), bucket=5)
    got = {r["id"]: r["new_dup_of"] for r in out.collect()}
    want = {i: r["dup_of"] for s in stores for i, r in s.rows.items()}
    assert got == {i: want[i] for i, _ in changes}


def test_stream_of_small_files_equals_batch(spark, tmp_path):
    stores = [random_store(seed, 30)[1] for seed in range(3)]
    df = frame(spark, stores).drop("dup_of").cache()
    bounds = [0, 700, 1010, 1020, 2005, 9999]
    for n, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        df.filter(F.col("id").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={n}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    jobs.stream_canonical(stream, str(tmp_path / "out")).awaitTermination()
    got = {r["id"]: r["dup_of"] for r in spark.read.parquet(str(tmp_path / "out/groups")).collect()}
    assert len(spark.read.parquet(str(tmp_path / "out/groups")).select("batch_id").distinct().collect()) == 5
    assert got == {i: r["dup_of"] for s in stores for i, r in s.rows.items()}


def test_orphans_stand_alone(spark):
    rows = [(1, "a", None, None, None), (2, "b", None, None, 1), (3, "b", None, None, 99)]
    out = {r["id"]: (r["group_id"], r["is_orphan"]) for r in resolve.orphan_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: (1, False), 2: (1, False), 3: (3, True)}


def test_title_keys(spark):
    titles = [
        "2026학년도 2학기 수강신청 포기 안내", "[학부] 2026학년도 2학기 수강신청 포기 안내", "(학부)2026학년도 2학기 수강신청·포기 안내!",
        "★[인재개발팀] 2026학년도 2학기  수강신청 포기 안내★", "ＩＣＰＣ 2026 안내", "icpc 2026 안내", "[대학원] 2026학년도 2학기 추가 복학 신청 안내",
        "[학부/대학원] AI활용 윤리 가이드라인", "AI활용 윤리 가이드라인", "[공지] 안내",
    ]
    df = spark.createDataFrame(list(enumerate(titles)), "i int, title string")
    keys = {r["i"]: r["k"] for r in df.select("i", dedup_key(F.col("title")).alias("k")).collect()}
    assert keys[0] == keys[1] == keys[2] == keys[3] == "2026학년도2학기수강신청포기안내"
    assert keys[4] == keys[5] == "icpc2026안내"
    assert keys[6] == "grad:2026학년도2학기추가복학신청안내"
    assert keys[7] == keys[8] and keys[9] is None


def test_hot_keys_are_spread_and_give_the_same_rows(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, None).otherwise(
        F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"))
    lookup = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    plain = rows.join(lookup.drop("n"), "k", "left").select("id", "first")
    salted = hot_lookup_join(rows, lookup, ["k"], "id", "n", hot_rows=10, salts=8).select("id", "first")
    assert sorted(map(tuple, plain.fillna(-1).collect())) == sorted(map(tuple, salted.fillna(-1).collect()))


def test_global_index_and_rank(spark):
    df = spark.range(1000).select("id", F.pmod(F.hash("id"), F.lit(97)).alias("v"), (F.col("id") % 3).alias("g"))
    want = sorted((r["v"], r["id"]) for r in df.collect())
    got = with_global_index(df, [F.col("v").asc(), F.col("id").asc()], "n").collect()
    assert {r["id"]: r["n"] for r in got} == {i: n for n, (_, i) in enumerate(want)}
    ranked = rank_in_group(df, ["g"], [F.col("v").desc(), F.col("id").asc()], "id").collect()
    for g in range(3):
        order = sorted(((-r["v"], r["id"], r["pos"]) for r in ranked if r["g"] == g))
        assert [o[2] for o in order] == list(range(1, len(order) + 1))
    assert with_global_index(df.filter("id < 0"), [F.col("id").asc()], "n").count() == 0
