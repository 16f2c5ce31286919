import random

import pytest
from pyspark.sql import functions as F

from dwellkit.operators.prefix import hash_key, index_rows, join_totals, mark_first_by_hash, number_by_hash, recut, value_totals, with_value_part


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(40), i) for i in range(400)]
    return spark.createDataFrame(data, "k long, t long, i long").cache()


@pytest.mark.parametrize("hot", [1, 100, 10_000])
def test_index_rows(rows, hot):
    df = index_rows(rows, "k", ["t", "i"], F.col("t"), hot_rows=hot)
    got = df.orderBy("k", "sample_idx").collect()
    want = {}
    for k, t, i in sorted(map(tuple, rows.collect())):
        want.setdefault(k, []).append(i)
    assert {k: [r.i for r in got if r.k == k] for k in want} == want
    for k, ids in want.items():
        assert [r.sample_idx for r in got if r.k == k] == list(range(len(ids)))
    assert (max(r.chunk for r in got) > 5) == (hot < 400)


def test_number_by_hash(rows):
    hashed = rows.withColumn("h", hash_key("i"))
    got = number_by_hash(hashed, "h", ["i"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 401))
    assert [r.h for r in got] == sorted(r.h for r in got)


@pytest.mark.parametrize("n_groups", [3, None])
@pytest.mark.parametrize("quotas", [{1: 10, 2: 0, 3: 10_000}, {1: 1, 3: 7}])
def test_mark_first_by_hash(spark, rows, quotas, n_groups):
    hashed = rows.withColumn("h", hash_key("i"))
    quota = spark.createDataFrame(list(quotas.items()), "k long, quota_rows long")
    got = mark_first_by_hash(hashed, "k", "h", ["i"], quota, n_groups, "hit").collect()
    assert len(got) == 400
    for k in (1, 2, 3):
        group = sorted((r.h, r.i, r.hit) for r in got if r.k == k)
        assert [x[2] for x in group] == [j < quotas.get(k, 0) for j in range(len(group))]


@pytest.mark.parametrize("steps", [1, 3, 1 << 14])
@pytest.mark.parametrize("descending", [False, True])
def test_value_totals(rows, steps, descending):
    counted = rows.groupBy("k", (F.col("t") / 3).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    got = value_totals(counted, ["k"], "v", ["n"], steps=steps, descending=descending).collect()
    for k in (1, 2, 3):
        mine = sorted((r for r in got if r.k == k), key=lambda r: -r.v if descending else r.v)
        so_far = 0
        for r in mine:
            so_far += r.n
            assert r.cum_n == so_far
        assert {r.all_n for r in mine} == {so_far}


def test_value_totals_without_keys(rows):
    counted = rows.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    got = sorted(value_totals(counted, [], "t", ["n"], n_keys=1, steps=2).collect(), key=lambda r: r.t)
    assert got[-1].cum_n == 400 and [r.cum_n - r.n for r in got[1:]] == [r.cum_n for r in got[:-1]]


def test_value_part_is_ordered_and_fine_at_both_ends(spark):
    rng = random.Random(8)
    crowds = [rng.random() * 10.0**-k for k in range(12) for _ in range(30)]
    xs = sorted({0.0, 1.0, 0.5, *crowds, *[1 - c for c in crowds], *[2.0**-k for k in range(50)]})
    df = spark.createDataFrame([(x, 0.0, 1.0) for x in xs], "x double, lo double, hi double")
    got = [r.value_part for r in with_value_part(df, "x", "lo", "hi", 16).orderBy("x").collect()]
    assert got == sorted(got)
    assert len(set(got)) > 0.4 * len(got)
    flat = with_value_part(spark.createDataFrame([(3.0, 3.0, 3.0)], "x double, lo double, hi double"), "x", "lo", "hi", 16)
    assert flat.first().value_part == 0


def test_outlier_does_not_gather_a_key(spark):
    rows = [(float(i), 0.0, 1e15, 1) for i in range(500)] + [(1e15, 0.0, 1e15, 1)]
    df = spark.createDataFrame(rows, "v double, lo double, hi double, n long")
    parts = with_value_part(df, "v", "lo", "hi", 1 << 14).groupBy("value_part").count()
    assert parts.agg(F.max("count")).first()[0] <= 2
    assert value_totals(df.select("v", "n"), [], "v", ["n"], n_keys=1).filter("v = 250").first().cum_n == 251


@pytest.mark.parametrize("hot", [1, 90, 10_000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_totals(rows, hot, how):
    totals = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("s"), F.max("i").alias("top"))
    totals = totals.filter("k <> 2")
    got = join_totals(rows, totals, ["k"], "n", F.col("i"), how, hot_rows=hot)
    want = rows.join(totals.drop("n"), "k", how).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_join_totals_spreads_a_hot_key(spark):
    """With broadcasts limited to the hot list, the rows of the hot key leave its
    partition."""
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        ids = spark.range(0, 40_000, 1, 4)
        df = ids.select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 500).alias("k"), "id")
        totals = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
        got = join_totals(df, totals, ["k"], "n", F.col("id"), hot_rows=1000)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 1
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 1.3 * 40_000 / 4
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_mass_between_two_outliers_is_cut(spark):
    """All values but two lie within a billionth of the range's middle."""
    n, bound = 6000, 200
    rng = random.Random(1)
    xs = [0.0, 1.0] + sorted({0.5 + rng.random() * 1e-9 for _ in range(n)})
    df = spark.createDataFrame([(x, 0.0, 1.0, 1) for x in xs], "v double, lo double, hi double, n long").repartition(6)
    coarse = with_value_part(df, "v", "lo", "hi", 1 << 6)
    assert coarse.groupBy("value_part").count().agg(F.max("count")).first()[0] > n / 4
    fine = recut(coarse, ["value_part"], F.col("v"), "value_part", bound)
    assert fine.columns == coarse.columns
    assert fine.groupBy("value_part").count().agg(F.max("count")).first()[0] <= 2 * bound
    parts = [r.value_part for r in fine.orderBy("v").collect()]
    assert parts == sorted(parts) and len(parts) == len(xs)
    totals = value_totals(df.select("v", "n"), [], "v", ["n"], n_keys=1, steps=4, part_rows=bound).collect()
    assert [r.cum_n for r in sorted(totals, key=lambda r: r.v)] == list(range(1, len(xs) + 1))


def test_equal_values_stay_together_and_empty_tables_stay_empty(spark):
    df = spark.createDataFrame([(1, 7.0, 0)] * 500 + [(1, float(i), 0) for i in range(100)], "k int, v double, p long")
    got = recut(df, ["k", "p"], F.col("v"), "p", 50)
    assert got.where("v = 7").select("p").distinct().count() == 1 and got.count() == 600
    assert recut(df.limit(0), ["k", "p"], F.col("v"), "p", 50).collect() == []


def test_burst_in_a_hot_recording_is_spread(spark):
    """Nearly all samples of a long recording lie in a fifth of a second of a day."""
    n, bound = 20_000, 1000
    burst = spark.range(n).select((F.lit(40_000.0) + F.col("id") * (0.2 / n)).alias("t"))
    rest = spark.range(24).select((F.col("id") * 3600.0).alias("t"))
    rows = burst.union(rest).select(F.lit(1).alias("k"), "t").repartition(5)
    got = index_rows(rows, "k", ["t"], F.col("t"), hot_rows=bound)
    sizes = got.groupBy("chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * bound
    ordered = got.orderBy("t").collect()
    assert [r.sample_idx for r in ordered] == list(range(n + 24))
    assert [r.chunk for r in ordered] == sorted(r.chunk for r in ordered)
