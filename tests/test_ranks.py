"""Quantiles, ranks, box statistics, histograms against numpy and pandas, also when skewed."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from taktspur.operators import grouped as gr, ranks, shape
from taktspur.operators.joins import lookup, split_join, station_lookup


def skewed(n=6000, seed=3):
    """A third of the rows share one value and one group; the rest is heavy-tailed."""
    rng = np.random.default_rng(seed)
    value = np.where(rng.random(n) < 0.33, 0.0, np.round(rng.standard_cauchy(n) * 50, 1))
    group = np.where(rng.random(n) < 0.4, "S", rng.choice(list("abcdefg"), n))
    return pd.DataFrame({"g": group, "v": value})


@pytest.fixture(scope="module")
def frame(spark):
    pdf = skewed()
    return pdf, spark.createDataFrame(pdf).cache()


AT = {"p00": 0.0, "p05": 0.05, "p50": 0.5, "p999": 0.999, "p100": 1.0}


def test_quantiles_of_all_rows(frame):
    pdf, df = frame
    row = ranks.quantiles(df, "v", AT).first()
    for name, p in AT.items():
        assert row[name] == pytest.approx(np.quantile(pdf.v, p), abs=1e-9)


def test_quantiles_per_group(frame):
    pdf, df = frame
    got = {r.g: r for r in ranks.quantiles(df, "v", AT, ["g"]).collect()}
    assert set(got) == set(pdf.g)
    for g, part in pdf.groupby("g"):
        for name, p in AT.items():
            assert got[g][name] == pytest.approx(np.quantile(part.v, p), abs=1e-9)


def test_ordered_bits_are_the_image_of_a_double(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([
        rng.integers(0, 2 ** 64, 4000, np.uint64).view(np.float64),
        2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1074, 1024), 0),
        np.nextafter(2.0 ** np.arange(-1074, 1023), np.inf), [0.0, -0.0, np.inf, -np.inf, 5e-324, 1.7976931348623157e308]])
    values = values[~np.isnan(values)]
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = ranks.with_ordered_bits(df, "v", "b").toPandas()
    assert list(got.columns) == ["v", "b"]
    image = np.abs(got.v.to_numpy()).view(np.int64)
    assert (got.b.to_numpy() == np.where(got.v < 0, -image, image)).all()


@pytest.mark.parametrize("most", [1, 7, 400, 100_000])
@pytest.mark.parametrize("by", [None, ["g"]])
def test_running_totals_do_not_depend_on_the_size_of_buckets(frame, most, by):
    pdf, df = frame
    got = ranks.running_totals(ranks.value_counts_by(df, "v", by), by, most=most).toPandas()
    for _, part in got.groupby(by) if by else [(None, got)]:
        part = part.sort_values("value")
        assert (part["n"].cumsum() == part["upto"]).all() and (part["total"] == part["n"].sum()).all()
    assert got["n"].sum() == len(pdf) and len(got) == len(pdf.drop_duplicates(["g", "v"] if by else "v"))


@pytest.mark.parametrize("most", [1, 30])
def test_quantiles_from_split_buckets(frame, most):
    pdf, df = frame
    row = ranks.quantiles(df, "v", AT, most=most).first()
    for name, p in AT.items():
        assert row[name] == pytest.approx(np.quantile(pdf.v, p), abs=1e-9)
    got = {r.g: r.p50 for r in ranks.quantiles(df, "v", {"p50": 0.5}, ["g"], most=most).collect()}
    assert got == pytest.approx(pdf.groupby("g").v.median().to_dict())


def test_values_that_share_their_leading_bits_are_split_further(spark):
    # All in one exponent and closely packed: only the fourth digit of twelve bits tells them apart.
    pdf = pd.DataFrame({"v": 1.0 + np.arange(3000) * 2.0 ** -44})
    df = spark.createDataFrame(pdf)
    assert ranks.quantiles(df, "v", {"q": 0.37}, most=100).first().q == np.quantile(pdf.v, 0.37)
    got = ranks.running_totals(ranks.value_counts_by(df, "v"), most=100).toPandas().sort_values("value")
    assert got["upto"].tolist() == list(range(1, 3001))


def test_average_ranks(frame):
    pdf, df = frame
    got = ranks.running_totals(ranks.value_counts_by(df, "v")).select(
        "value", ranks.average_rank().alias("r")).toPandas().set_index("value")["r"]
    expected = pdf.v.rank().groupby(pdf.v).first()
    pd.testing.assert_series_equal(got.sort_index(), expected.sort_index(), check_names=False)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=40), st.floats(0, 1))
def test_quantile_of_any_list(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    got = ranks.quantiles(df, "v", {"q": p}).first().q
    assert got == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-6)


def test_describe_against_pandas(frame):
    pdf, df = frame
    row = shape.describe(df, "v").first()
    assert row.n == len(pdf) and row["mean"] == pytest.approx(pdf.v.mean())
    assert row.sd == pytest.approx(pdf.v.std()) and row.p99 == pytest.approx(pdf.v.quantile(0.99))
    assert row.pct_late == pytest.approx(100 * (pdf.v > 180).mean())
    assert row.pct_early_or_punctual == pytest.approx(100 * (pdf.v <= 0).mean())
    rough = shape.describe(df, "v", approximate=True).first()
    assert rough.median == pytest.approx(row.median, abs=5)


def test_histogram_against_numpy(frame):
    pdf, df = frame
    clipped = pdf.v.clip(-60, 600)
    n, edges = np.histogram(clipped, bins=50)
    got = shape.histogram(df.withColumn("c", F.greatest(F.lit(-60.0), F.least(F.lit(600.0), "v"))), "c")
    got = got.orderBy("bin").toPandas()
    assert got["n"].tolist() == n.tolist()
    assert np.allclose(got["bin_low"], edges[:-1]) and np.allclose(got["bin_high"], edges[1:])


def test_histogram_of_one_value(spark):
    got = shape.histogram(spark.createDataFrame([(5.0,)] * 3, "v double"), "v", bins=10).toPandas()
    assert got["n"].sum() == 3 and got["bin_low"].min() == 4.5 and got["bin_high"].max() == 5.5


def test_box_stats_against_numpy(frame):
    pdf, df = frame
    for by, parts in ((None, [(None, pdf)]), ("g", list(pdf.groupby("g")))):
        rows = shape.box_stats(df, "v", by).collect()
        got = {r["g"] if by else None: r for r in rows}
        for key, part in parts:
            q1, med, q3 = np.quantile(part.v, [0.25, 0.5, 0.75])
            inside = part.v[(part.v >= q1 - 1.5 * (q3 - q1)) & (part.v <= q3 + 1.5 * (q3 - q1))]
            r = got[key]
            assert (r.n, r.q1, r.median, r.q3) == (len(part), pytest.approx(q1), pytest.approx(med), pytest.approx(q3))
            assert r.whisker_low == pytest.approx(min(inside.min(), q1))
            assert r.whisker_high == pytest.approx(max(inside.max(), q3))


def test_split_join_equals_plain_join(spark):
    left = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(3000)], "k int, i int")
    right = left.groupBy("k").agg(F.count("*").alias("rows")).withColumn("tag", F.col("k") * 2)
    got = split_join(left, right, ["k"], "rows", share=0.01)
    plain = left.join(right, "k")
    assert got.count() == plain.count() == 3000
    assert got.select(*plain.columns).exceptAll(plain).isEmpty()


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_lookup_keeps_every_event_on_both_ways(spark, limit):
    events = spark.createDataFrame([(None if i % 4 == 0 else i % 7, i) for i in range(200)], "k int, i int")
    table = spark.createDataFrame([(k, f"s{k}") for k in range(5)], "k int, name string")
    events = events.withColumn("m", F.create_map(F.lit("a"), "i"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        got = lookup(events, table, ["k"])
        assert got.columns == ["k", "i", "m", "name"] and got.count() == 200
        for r in got.collect():
            assert r.m == {"a": r.i} and r.name == (f"s{r.k}" if r.k is not None and r.k < 5 else None)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_doubled_station_does_not_double_events(spark):
    events = spark.createDataFrame([(1, 5.0), (2, 6.0), (None, 7.0)], "bpuic int, v double")
    stations = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "number int, name string")
    got = station_lookup(events, stations, {"name": "station"}).orderBy("v").collect()
    assert [(r.bpuic, r.station) for r in got] == [(1, "a"), (2, "c"), (None, None)]


@pytest.mark.parametrize("n", [1, 5, 60])
def test_samples_are_the_first_rows_by_hash(spark, n):
    rng = np.random.default_rng(n)
    groups = np.where(rng.random(30_000) < 0.6, "hot", rng.choice(list("abc"), 30_000))
    pdf = pd.DataFrame({"g": groups, "i": np.arange(30_000)})
    pdf.loc[:3, "g"] = "few"
    df = spark.createDataFrame(pdf).withColumn("h", gr.seeded(n, "i"))
    # In group b all hashes share their leading 40 bits, in c they reach both ends of the numbers.
    tight = F.when(F.col("g") == "b", F.expr("shiftrightunsigned(h, 40)")).when(
        (F.col("g") == "c") & (F.col("i") % 2 == 0), F.lit(2 ** 63 - 1) - F.col("i")).otherwise(F.col("h"))
    df = df.withColumn("h", tight).persist()
    full = df.toPandas()
    got = gr.sample_per_group(df, "g", n, F.col("h")).toPandas()
    for g, part in full.groupby("g"):
        assert sorted(got[got.g == g].i) == sorted(part.sort_values("h").i[:n])
    ends = gr._upper_ends(df.withColumn("_order", F.col("h")), "g", n).toPandas().set_index("g")["_top"]
    reach = full[full.h <= full.g.map(ends)].groupby("g").size()
    assert (reach <= 3 * n).all() or n > 9000
    assert sorted(gr.sample_rows(df, n, F.col("h")).toPandas().i) == sorted(full.sort_values("h").i[:n])
