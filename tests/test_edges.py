"""Edge cases of the survey operators, one for each quirk and null rule."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canvass.functions.columns import nan_to_null, numeric_columns, round_even
from canvass.functions.quantiles import exact_quantiles
from canvass.functions.student import critical
from canvass.operators import charts, clean, estimate, pivot, profile, schema
from canvass.plans import narrative, report
from canvass.sources import readers, sinks, synth
from canvass.sources.registry import Registry


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_mode_is_smallest_on_ties(spark):
    df = spark.createDataFrame([(x,) for x in (3, 1, 3, 1, 2, None)], "v int")
    out, changes = clean.impute(df, "mode")
    assert rows(out)[-1] == (1,) and changes == [clean.Change("impute mode", "v", 1, 1)]


def test_all_null_column(spark):
    df = spark.createDataFrame([(None, 1.0)] * 3, "v double, w double")
    out, changes = clean.impute(df, "mean", ["v"])
    assert rows(out.select("v")) == [(None,)] * 3 and changes[0].changed == 0
    with pytest.warns(UserWarning):
        assert clean.remove_outliers(df)[0].count() == 0


def test_interpolated_quartiles_both_ways(spark):
    values = [1.0, 2.0, 3.0, 4.0, None, 10.0]
    df = spark.createDataFrame([(x,) for x in values], "v double")
    assert exact_quantiles(df, ["v"], [0.25, 0.75])["v"] == [2.0, 4.0]
    draw = random.Random(5)
    many = [draw.choice([draw.gauss(0, 1), 1.0]) for _ in range(60_000)]
    df = spark.createDataFrame(pd.DataFrame({"v": many}))
    expected = np.quantile(many, [0.25, 0.5, 0.9]).tolist()
    assert exact_quantiles(df, ["v"], [0.25, 0.5, 0.9], interval_rows=10)["v"] == pytest.approx(expected, abs=1e-12)


def test_pivot_nulls(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", None), (None, 3.0), ("c", None), ("a", None)], "g string, v double")
    assert rows(pivot.pivot(df, "g", "v")) == [("b", 1.0)]
    assert rows(pivot.pivot(df, "g", "v", "sum")) == [("a", 0.0), ("b", 1.0), ("c", 0.0)]
    assert rows(pivot.pivot(df, "g", "v", "count")) == [("a", 0), ("b", 1), ("c", 0)]


@pytest.mark.parametrize(("call", "error"), [
    (lambda d: pivot.pivot(d, [], "v"), ValueError), (lambda d: pivot.pivot(d, "g", "x"), KeyError), (lambda d: pivot.pivot(d, "g", "g"), ValueError),
    (lambda d: pivot.pivot(d, "v", "g"), TypeError), (lambda d: pivot.pivot(d, "g", "v", "kurt"), ValueError), (lambda d: pivot.pivot(d, "g", "v", "first"), ValueError),
    (lambda d: schema.rename(d, {"g": "v"}), ValueError), (lambda d: clean.impute(d, "guess"), ValueError),
    (lambda d: clean.apply_rules(d, clean.Rules((clean.Range("g", 0, 1),))), TypeError),
])
def test_errors_come_before_jobs(spark, call, error):
    with pytest.raises(error):
        call(spark.createDataFrame([("a", 1.0)], "g string, v double"))


def test_pivot_skew_matches_pandas(spark):
    frame = pd.DataFrame({"g": list("aaaabb"), "v": [1.0, 2.0, 4.0, 9.0, 1.0, 2.0]})
    (row,) = rows(pivot.pivot(spark.createDataFrame(frame), "g", "v", "skew"))
    assert row == ("a", pytest.approx(frame[frame.g == "a"].v.skew()))


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (None, None), (None, None), (1, "x"), (2, "y")], "a int, b string")
    assert rows(profile.duplicate_row_count(df)) == [(4,)]
    marked = df.withColumn("id", F.monotonically_increasing_id())
    assert profile.duplicate_row_members(marked, "id").count() == 4
    df = spark.createDataFrame([(1, 1.0, 1), (2, 2.0, 2)], "a int, b double, c int")
    assert rows(profile.duplicate_columns(df)) == [("a == c",)]
    wide = df.select("a", *[(F.col("a") * k).alias(f"k{k}") for k in range(2, 50)], F.col("a").alias("z"))
    assert rows(profile.duplicate_columns(wide)) == [("a == z",)]
    assert len(rows(profile.duplicate_columns(df.where("a > 5")))) == 1
    assert profile.profile(df, "f.csv")["row_count"] == 2


def test_target_as_weight_and_zero_weights(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0)], "v double, z double")
    assert estimate.weighted_estimates(df, ["v"], "v").first().n_effective == 1.8
    first = estimate.weighted_estimates(df, ["v"], "z").first()
    assert first.n_sample == 2 and first["mean"] is None and first.ci_95_lower is None
    assert estimate.weighted_estimates(df.limit(1), ["v"], "z").count() == 0
    assert estimate.weighted_estimates(df, ["nothing"], "z").count() == 0


def test_estimate_against_numpy(spark):
    frame = pd.DataFrame({"x": [3.0, 5.0, 9.0, 4.0, None], "w": [1.0, 2.0, 0.5, 1.5, 9.0], "g": ["a"] * 5})
    x, w = frame.x[:4].to_numpy(), frame.w[:4].to_numpy()
    mean, size = (w * x).sum() / w.sum(), w.sum() ** 2 / (w * w).sum()
    se = math.sqrt((w * (x - mean) ** 2).sum() / w.sum() * 4 / 3) / math.sqrt(size)
    df = spark.createDataFrame(frame)
    df = nan_to_null(df)
    got = estimate.weighted_estimates(df, ["x"], "w", 100).first()
    assert (got.n_sample, got["mean"], got.std_error) == (4, round(mean, 4), round(se, 4))
    assert got.margin_of_error == pytest.approx(critical(size - 1) * se, abs=1e-4) and got.population_estimate == pytest.approx(mean * 100, abs=0.01)
    by = estimate.weighted_estimates_by(df, ["g"], "x", "w").first()
    assert (by["mean"], by.margin_of_error) == (got["mean"], got.margin_of_error)


def test_t_quantile():
    assert [critical(v) for v in (1, 10, 30)] == pytest.approx([12.7062047, 2.2281389, 2.0422725], abs=1e-7)
    assert critical(0) is None and critical(199.999) == pytest.approx(critical(200.001), abs=1e-6)


def test_half_even_rounding_and_nan(spark):
    assert rows(spark.range(1).select(round_even(F.lit(0.12345), 4))) == [(0.1234,)]
    df = nan_to_null(spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double"))
    assert rows(profile.missing_cells(df)) == [(1,)]


def test_range_with_null_and_open_bound(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "v int")
    out, changes = clean.apply_rules(df, clean.Rules.of({"range": [{"col": "v", "min": 2, "max": None}, {"col": "absent"}]}))
    assert rows(out) == [(3,)] and changes[0].found == 2


def test_negative_mean_reads_high(spark):
    df = spark.createDataFrame([("a", -1.0, 5.0)], "column string, mean double, std_error double")
    assert estimate.reliability(df).first().reliability == "high" and estimate.reliability(df, absolute=True).first().reliability == "low"


def test_sequential_drop_counts(spark):
    draw = np.random.default_rng(3)
    frame = pd.DataFrame(draw.normal(size=(400, 2)), columns=["a", "b"]).mask(draw.random((400, 2)) < 0.2)
    a = int(frame.a.isna().sum())
    b = int(frame[frame.a.notna()].b.isna().sum())
    out, changes = clean.impute(nan_to_null(spark.createDataFrame(frame)), "drop")
    assert [c.found for c in changes] == [a, b] and out.count() == 400 - a - b


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3), min_size=2, max_size=20), st.floats(0.1, 50))
def test_equal_weights_and_scale(spark, values, k):
    df = spark.createDataFrame([(x, k) for x in values], "x double, w double")
    got = estimate.weighted_estimates(df, ["x"], "w").first()
    assert got.n_effective == pytest.approx(len(values), abs=0.01) and got["mean"] == pytest.approx(np.mean(values), abs=1e-3)
    if got.ci_95_lower is not None:
        assert got["mean"] - got.ci_95_lower == pytest.approx(got.ci_95_upper - got["mean"], abs=3e-4)


def test_csv_types_and_tokens(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('id,x,flag,t,none\n1,2.5,True,007,NA\n2,NA,False,"a, ""b""",null\n')
    df = readers.load(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "flag": "boolean", "t": "string", "none": "double"}
    assert rows(df)[1] == (2, None, False, 'a, "b"', None) and numeric_columns(df) == ["id", "x", "none"]


def test_batch(spark, tmp_path):
    good = tmp_path / "a b.csv"
    good.write_text("x\n1\n")
    got = readers.load_batch(spark, [str(good), str(tmp_path / "no.txt"), str(tmp_path / "gone.csv")])
    assert list(got.tables) == ["a_b.csv"] and len(got.failures) == 2
    for bad in ([], ["x.csv"] * 6):
        with pytest.raises(ValueError):
            readers.load_batch(spark, bad)


def test_constant_and_empty_charts(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert rows(charts.histogram(df, "v")) == [(1, 1.5, 2.5, 2)]
    assert charts.histogram(df.where("v > 5"), "v").count() == 0 and charts.box_stats(df.select(F.lit("a").alias("s")), ["s"]) is None
    spread = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    area = charts.density(spread, "v").toPandas()
    assert np.trapezoid(area.density, area.x) == pytest.approx(1, abs=0.01)


def test_storyline(spark, tmp_path):
    registry = Registry()
    registry.put("s.csv", synth.survey(spark.range(1000), "id").cache())
    registry.put("s.csv", schema.rename(registry.get("s.csv"), {"Q1_Age_Years": "Age"}), "mapped")
    cleaned, changes = clean.clean(registry.get("s.csv"), "mean", True, clean.DEFAULT_RULES)
    registry.put("s.csv", cleaned, "cleaned")
    assert {c.step for c in changes} >= {"impute mean", "outliers"} and cleaned.where("Age < 0 or Income is null").count() == 0
    done = report.analyse(registry, "s.csv", ["Income"], "Survey_Weight", estimate.parse_population("1000"))
    page = report.report(done, report.visuals(done)["summary"], {"box": None}, [*registry.log, "<b>"])
    assert "Income" in page and "&lt;b&gt;" in page and "None" not in page and sinks.records(done.estimates)[0]["column"] == "Income"
    sinks.write_html(page, str(tmp_path / "r.html"))
    assert narrative.summary(done.estimates.where("false")) == narrative.NOTHING
    with pytest.raises(ValueError):
        report.analyse(registry, "s.csv", [], "Survey_Weight")


def test_stream(spark, tmp_path):
    from canvass.streaming.running import windowed_weighted_mean

    spark.sql("select timestamp'2024-01-01 00:10' as t, 2.0d as x, 1.0d as w union all select timestamp'2024-01-01 00:20', 4.0d, 3.0d").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, x double, w double").parquet(str(tmp_path / "in"))
    q = windowed_weighted_mean(stream, "t", "x", "w").writeStream.format("memory").queryName("running").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.sql("select n_sample, n_effective, mean from running")) == [(2, 1.6, 3.5)]
