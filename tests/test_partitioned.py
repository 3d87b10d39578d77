"""Ordered work in buckets equals plain ordered work, also with a hot key and shuffled input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelattice.operators import joins as J
from tidelattice.operators import partitioned as P


@pytest.fixture(scope="module")
def log():
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abcd"), n))
    ts = np.sort(rng.integers(0, 40 * 3600, n)) * 1_000_000
    ts[key == "a"] += 500 * 3_600_000_000
    return pd.DataFrame({"k": key, "ts_us": ts, "seq": np.arange(n), "v": np.round(rng.normal(size=n), 3)})


def test_previous_crosses_buckets(spark, log):
    df = spark.createDataFrame(log.sample(frac=1, random_state=1)).repartition(7)
    got = P.with_previous(df, ["k"], ["ts_us", "seq"], ["v"], P.time_bucket("ts_us", 600)).select("seq", "prev.v").toPandas()
    want = log.sort_values(["ts_us", "seq"]).assign(p=lambda d: d.groupby("k")["v"].shift()).set_index("seq")["p"]
    pd.testing.assert_series_equal(got.set_index("seq")["v"].sort_index(), want.sort_index(), check_names=False)


def test_next_is_the_mirror(spark, log):
    df = spark.createDataFrame(log)
    got = P.with_next(df, ["k"], ["v"], 600, tie="seq").select("seq", "next.v").toPandas()
    want = log.sort_values(["ts_us", "seq"]).assign(p=lambda d: d.groupby("k")["v"].shift(-1)).set_index("seq")["p"]
    pd.testing.assert_series_equal(got.set_index("seq")["v"].sort_index(), want.sort_index(), check_names=False)


def test_numbers_and_sums(spark, log):
    df = spark.createDataFrame(log.sample(frac=1, random_state=2))
    bucket = P.time_bucket("ts_us", 900)
    numbered = P.number_rows(df, ["k"], ["ts_us", "seq"], bucket, "rn", "n")
    summed = P.running_sum(numbered, ["k"], ["ts_us", "seq"], bucket, F.col("v"), "total").toPandas().set_index("seq").sort_index()
    want = log.sort_values(["ts_us", "seq"]).assign(
        rn=lambda d: d.groupby("k").cumcount() + 1, total=lambda d: d.groupby("k")["v"].cumsum(), n=lambda d: d.groupby("k")["v"].transform("size")
    ).set_index("seq").sort_index()
    assert (summed["rn"] == want["rn"]).all() and (summed["n"] == want["n"]).all()
    assert np.allclose(summed["total"], want["total"])


def test_halo_gives_each_chunk_its_neighbours(spark):
    df = spark.range(1, 26).withColumnRenamed("id", "rn")
    rows = P.with_halo(df, "rn", 10, 3, 3).toPandas()
    assert rows["own"].sum() == 25
    for chunk, part in rows.groupby("chunk"):
        assert set(part["rn"]) == set(range(max(1, chunk * 10 - 2), min(25, chunk * 10 + 13) + 1))


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_ranked_percentiles_are_exact(spark, log, accuracy):
    df = spark.createDataFrame(log)
    ps = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = P.ranked_percentiles(df, ["k"], "v", ps, accuracy).toPandas().set_index("k")
    for key, part in log.groupby("k"):
        assert np.allclose(got.loc[key, list(ps)].astype(float), np.percentile(part["v"], [0, 50, 95, 100]))
    whole = P.ranked_percentiles(df, [], "v", {"m": 0.5}, accuracy).first()["m"]
    assert whole == pytest.approx(np.median(log["v"]))


def test_both_percentile_paths_agree(spark, log):
    df = spark.createDataFrame(log)
    small = P.exact_percentiles(df, ["k"], "v", {"q": 0.31}).toPandas().sort_values("k")["q"].to_numpy()
    large = P.exact_percentiles(df, ["k"], "v", {"q": 0.31}, gather_limit=10).toPandas().sort_values("k")["q"].to_numpy()
    assert np.allclose(small, large)


def test_both_percentile_paths_give_equal_bits(spark):
    rng = np.random.default_rng(12)
    data = pd.DataFrame({"k": rng.integers(0, 40, 6000), "v": np.round(rng.normal(size=6000), 3)})
    df = spark.createDataFrame(data)
    wanted = {"a": 0.1, "b": 0.5, "c": 0.9, "d": 1 / 3}
    one = P.exact_percentiles(df, ["k"], "v", wanted).orderBy("k").collect()
    two = P.exact_percentiles(df, ["k"], "v", wanted, gather_limit=1, accuracy=50).orderBy("k").select("k", *wanted).collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in two]


def test_rows_of_a_key_are_dealt_over_partitions_of_bounded_size(spark):
    """More rows make more partitions, not larger ones; a key stays in one."""
    rows = spark.range(4_000).select((F.col("id") % 200).alias("event_id"), F.col("id").alias("station_id"))
    for each, least in ((100, 40), (50, 80)):
        parts = J.dealt(rows, ["event_id"], each).select("event_id", F.spark_partition_id().alias("p"))
        assert parts.rdd.getNumPartitions() == least
        assert parts.groupBy("event_id").agg(F.countDistinct("p").alias("n")).where("n > 1").isEmpty()
