"""Operators against plain windows and plain Python, on skewed and awkward rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnledger.operators import ordered
from turnledger.operators.joins import lookup
from turnledger.operators.ranking import at_rank, nearest_rank, top_k, with_ranks
from turnledger.operators.sampling import sample_n, sample_per_stratum


@pytest.fixture(scope="module")
def skewed(spark):
    """One trace holds most rows; times repeat, so ties need the id."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        trace = "hot" if i % 3 else f"t{i % 50}"
        at = datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(0, 4000))
        rows.append((trace, i, at, rng.choice([None, i])))
    return spark.createDataFrame(rows, "trace_id string, id long, timestamp timestamp, v long").repartition(7)


def _same(a, b):
    key = lambda r: tuple(str(x) for x in r)
    return sorted(map(key, a.collect())) == sorted(map(key, b.select(a.columns).collect()))


ORDER = ["timestamp", "id"]


def test_lag_equals_window(skewed):
    w = Window.partitionBy("trace_id").orderBy(*ORDER)
    plain = skewed.withColumn("prev_v", F.lag("v").over(w)).withColumn("prev_id", F.lag("id").over(w))
    plain = plain.withColumn("low", F.min("v").over(Window.partitionBy("trace_id")))
    mine = ordered.lag(
        skewed, ["trace_id"], ordered.time_slice("timestamp", 60), ORDER, {"prev_v": "v", "prev_id": "id"}, {"low": "v"}
    )
    assert _same(mine, plain)


def test_positions_and_running_sum_equal_window(skewed):
    w = Window.partitionBy("trace_id").orderBy(*ORDER)
    plain = skewed.withColumn("position", F.row_number().over(w))
    assert _same(ordered.positions(skewed, ["trace_id"], ordered.time_slice("timestamp", 60), ORDER), plain)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = skewed.withColumn("s", F.sum(F.coalesce("v", F.lit(0))).over(run))
    mine = ordered.running_sums(
        skewed, ["trace_id"], ordered.time_slice("timestamp", 300), ORDER, {"s": F.coalesce("v", F.lit(0))}
    )
    assert _same(mine, plain)


def test_carry_forward_equals_window(skewed):
    run = Window.partitionBy("trace_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    plain = skewed.withColumn("v", F.last("v", ignorenulls=True).over(run))
    assert _same(ordered.carry_forward(skewed, ["trace_id"], ordered.time_slice("timestamp", 60), ORDER, ["v"]), plain)


@pytest.mark.parametrize("n", [1, 2, 11, 12, 137, 5000])
def test_nearest_rank_equals_sorted_list(spark, n):
    rng = random.Random(n)
    values = [rng.randrange(1, 9000) for _ in range(n)]
    hist = (
        spark.createDataFrame([("a", v) for v in values], "g string, v long")
        .groupBy("g", "v")
        .agg(F.count("*").alias("n"))
    )
    row = nearest_rank(hist, ["g"], "v", "n", {"p50": 0.5, "p95": 0.95}).first()
    ordered_values = sorted(values)
    for name, p in (("p50", 0.5), ("p95", 0.95)):
        assert row[name] == ordered_values[int(round(p * (n - 1)))]


def test_top_k_plan_limits_before_the_exchange(skewed):
    df = top_k(skewed, ["trace_id"], [F.desc("timestamp"), "id"], 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert df.where("trace_id = 'hot'").count() == 3


def test_samples_do_not_depend_on_partitioning(skewed):
    a = sample_n(skewed, "id", 20).select("id")
    b = sample_n(skewed.repartition(3, "v"), "id", 20).select("id")
    assert _same(a, b)
    per = sample_per_stratum(skewed, ["trace_id"], "id", 2)
    assert per.groupBy("trace_id").count().agg(F.max("count")).first()[0] == 2


def test_lookup_spreads_rows_without_a_key(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, F.col("id") % 50).alias("k"))
    table = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup(rows, table, "k", "id")
        placed = joined.select("k", "v", F.spark_partition_id().alias("p")).groupBy("p").agg(F.count_if(F.col("k").isNull()).alias("n"))
        sizes = [r["n"] for r in placed.collect()]
        assert _same(joined.select("id", "k", "v"), rows.join(table, "k", "left").select("id", "k", "v"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 1500


def test_ranked_aggregates_over_blocks(spark):
    """Percentiles of positive values from ranked blocks, null keys and values included."""
    rng = random.Random(3)
    values = [None, 0, *(rng.randrange(1, 9000) for _ in range(400))]
    cells = {(k, v): rng.randrange(1, 5) for k in ("a", None) for v in values}
    slim = spark.createDataFrame([(k, v, n) for (k, v), n in cells.items()], "k string, v long, n long")
    rows = with_ranks(slim, ["k"], "v", "n").groupBy("k").agg(
        F.sum("n").alias("n"), at_rank("v", 0.5).alias("p50"), at_rank("v", 0.95).alias("p95")
    )
    for row in rows.collect():
        mine = {v: n for (k, v), n in cells.items() if k == row["k"]}
        flat = sorted(v for v, n in mine.items() if v for _ in range(n))
        assert row["n"] == sum(mine.values())
        assert row["p50"] == flat[round(0.5 * (len(flat) - 1))]
        assert row["p95"] == flat[round(0.95 * (len(flat) - 1))]
