"""Operators that spread one large group, file or table over many tasks, against plain computation."""

import csv
import io
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canvass.functions import scan
from canvass.functions.quantiles import exact_quantiles, grouped_quantiles
from canvass.operators import pivot, profile
from canvass.scratch import Scratch, setting
from canvass.sources import readers, records


def skewed(spark, n=4000, seed=1):
    draw = np.random.default_rng(seed)
    rows = [(i, "most" if draw.random() < 0.9 else f"k{draw.integers(3)}", None if draw.random() < 0.05 else float(round(draw.normal() * 5) if draw.random() < 0.7 else draw.lognormal(3, 2))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, key string, v double").repartition(5), pd.DataFrame(rows, columns=["id", "key", "v"])


def test_running_sum_and_rank_of_one_large_group(spark):
    df, frame = skewed(spark)
    sums = {r.id: r.v for r in pivot.group_transform(df, ["key"], "v", "cumsum", "id", rows_a_range=40).collect()}
    ranks = {r.id: r.v for r in pivot.group_transform(df, ["key"], "v", "rank", "id", rows_a_range=40).collect()}
    grouped = frame.groupby("key").v
    for found, expected in ((sums, grouped.cumsum()), (ranks, grouped.rank())):
        for i, x in zip(frame.id, expected, strict=True):
            assert (found[i] is None) == np.isnan(x) and (found[i] is None or found[i] == pytest.approx(x, rel=1e-9))


@pytest.mark.parametrize("kind", ["long", "double", "string", "date", "timestamp_ntz", "decimal(20,3)"])
def test_ranges_follow_the_order_and_are_even(spark, kind):
    made = {"string": F.lpad(F.col("id").cast("string"), 6, "0"), "date": F.date_add(F.lit("1990-01-01"), F.col("id").cast("int")), "timestamp_ntz": F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(0, id)")}
    df = spark.range(6000).select("id", made.get(kind, F.col("id").cast(kind)).alias("at"))
    found = scan.in_ranges(df, "at", "range", rows_a_range=60).toPandas().sort_values("id")
    assert found["range"].is_monotonic_increasing
    assert found["range"].nunique() >= (32 if kind == "string" else 90) and found["range"].value_counts().max() <= 400
    assert scan.in_ranges(df.where("false"), "at", "range").count() == 0


def test_ranges_of_unordered_types(spark):
    with pytest.raises(TypeError, match="ordered by"):
        scan.in_ranges(spark.range(3).select(F.array("id").alias("a")), "a", "range")


PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("interval_rows", [5, 60, 20_000])
def test_grouped_quantiles(spark, interval_rows):
    df, frame = skewed(spark, 3000, 2)
    extra = spark.createDataFrame([(9000, "one", 4.0), (9001, None, 1.0), (9002, "none", None), *[(9100 + i, "tied", 7.0) for i in range(300)], *[(9500 + i, "edge", float("inf") if i % 3 else -float("inf")) for i in range(60)]], df.schema)
    got = {r[0]: list(r[1:]) for r in grouped_quantiles(df.unionByName(extra), ["key"], "v", PROBABILITIES, interval_rows).collect()}
    assert got.keys() == {*frame.key.unique(), "one", "tied", "edge"}
    for key, values in frame.dropna().groupby("key").v:
        assert got[key] == pytest.approx(list(np.quantile(values, PROBABILITIES)), rel=1e-12, abs=1e-12)
    assert got["one"] == [4.0] * 6 and got["tied"] == [7.0] * 6 and got["edge"][2] == -float("inf") and got["edge"][5] == float("inf")


@pytest.mark.parametrize("interval_rows", [3, 200])
def test_quantiles_of_columns_by_intervals(spark, interval_rows):
    draw = np.random.default_rng(5)
    frame = pd.DataFrame({"a": np.round(draw.normal(size=3000), 1), "b": draw.lognormal(0, 4, 3000), "c": [1.0] * 2990 + [0.0, 2.0] * 5})
    got = exact_quantiles(spark.createDataFrame(frame), ["a", "b", "c"], PROBABILITIES, interval_rows)
    for c in frame:
        assert got[c] == pytest.approx(list(np.quantile(frame[c], PROBABILITIES)), rel=1e-12)


def test_quantile_results_in_pivots(spark):
    df, frame = skewed(spark, 1500, 3)
    df = df.withColumn("w", F.col("v") * 2)
    got = pivot.pivot(df, "key", ["w", "v"], ["median", "sum", "describe"], interval_rows=30).toPandas().set_index("key")
    told = frame.groupby("key").v.describe()
    assert list(got.columns[:2]) == ["v_median", "v_sum"] and np.allclose(got["v_25%"], told["25%"]) and np.allclose(got.w_median, 2 * told["50%"]) and np.allclose(got.v_std, told["std"])
    only = pivot.pivot(df, "key", "v", "median").toPandas()
    assert np.allclose(only.v, told["50%"])
    with pytest.raises(ValueError, match="would be named"):
        pivot.pivot(df.withColumnRenamed("key", "v_sum"), "v_sum", "v", ["sum"])


def some_csv(draw: random.Random, rows: int) -> tuple[str, list]:
    cells = ["", "plain", "two\nlines", 'a "quoted" word', "comma, here", "\r\nx\r\n", '"', '""', "\n\n", "é🙂\n" * 3, " space ", "x" * 300]
    made = [[str(k), draw.choice(cells), draw.choice(cells)] for k in range(rows)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=draw.choice(["\n", "\r\n"]))
    writer.writerow(["id", "name, of\nit", "b"])
    writer.writerows(made)
    return out.getvalue(), made


@pytest.mark.parametrize("split_bytes", [64, 600, None])
def test_csv_cells_with_line_ends_in_splits(spark, tmp_path, split_bytes):
    draw, expected = random.Random(4), []
    for k in range(3):
        text, rows = some_csv(draw, 40)
        (tmp_path / f"part{k}.csv").write_bytes(text.encode() + b"\n \n" * k)
        expected += rows
    df = readers.read_csv(spark, str(tmp_path), row_label="row", split_bytes=split_bytes)
    assert df.columns == ["id", "name, of\nit", "b", "row"]
    got = [tuple(r) for r in df.orderBy("row").collect()]
    clean = lambda x: None if x in readers.NA_TOKENS else x
    assert got == [(int(a), clean(b), clean(c), k) for k, (a, b, c) in enumerate(expected)]
    same = readers.read_csv(spark, str(tmp_path), split_bytes=split_bytes)
    assert sorted(map(repr, same.collect())) == sorted(map(repr, df.drop("row").collect()))
    scratch = Scratch(spark, "test")
    found, sound = records.records(spark, str(tmp_path), scratch, split_bytes)
    splits = found.select("file", "block").distinct().count()
    assert sound and splits >= {64: 30, 600: 6}.get(split_bytes, 3)
    assert split_bytes is None or records.lines(spark, str(tmp_path)).count() and len(scratch.read("pieces").inputFiles()) > 1


def test_many_small_splits_take_few_tasks(spark, tmp_path):
    text, rows = some_csv(random.Random(5), 400)
    (tmp_path / "a.csv").write_bytes(text.encode())
    scratch = Scratch(spark, "test")
    found, sound = records.records(spark, str(tmp_path), scratch, 64)
    assert sound and found.count() == len(rows) + 1
    assert found.select("file", "block").distinct().count() > 100
    assert len(scratch.read("pieces").inputFiles()) <= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("split_bytes", [64, 600])
def test_csv_with_too_many_splits_for_a_broadcast(spark, tmp_path, split_bytes, monkeypatch):
    expected = []
    for k in range(3):
        text, rows = some_csv(random.Random(k), 300)
        (tmp_path / f"part{k}.csv").write_bytes(text.encode())
        expected += rows
    monkeypatch.setattr(records, "broadcast_by_bytes", lambda df: df)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"), setting(spark, "spark.sql.adaptive.autoBroadcastJoinThreshold", "-1"):
        df = readers.read_csv(spark, str(tmp_path), row_label="row", split_bytes=split_bytes)
        got = [tuple(r) for r in df.orderBy("row").collect()]
    clean = lambda x: None if x in readers.NA_TOKENS else x
    assert got == [(int(a), clean(b), clean(c), k) for k, (a, b, c) in enumerate(expected)]


def test_csv_with_stray_quotes_is_read_whole(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b\n1,5" pipe\n2,"two\nlines"\n')
    got = readers.read_csv(spark, str(path)).collect()
    assert len(got) >= 1 and got[0].b == '5" pipe'
    with pytest.raises(ValueError, match="stray quotes"):
        readers.read_csv(spark, str(path), row_label="row")
    (tmp_path / "b.csv").write_text("row,b\n1,2\n")
    with pytest.raises(ValueError, match="has a column"):
        readers.read_csv(spark, str(tmp_path / "b.csv"), row_label="row")


def test_row_labels_of_parquet_files(spark, tmp_path):
    for k, name in enumerate("abc"):
        pd.DataFrame({"x": [10.0 * k + i for i in range(7)], "file": name, "at": [1] * 7}).to_parquet(tmp_path / f"{name}.parquet", row_group_size=3)
    got = readers.read_parquet(spark, str(tmp_path), row_label="label")
    assert got.columns == ["x", "file", "at", "label"]
    assert {r.label: r.x for r in got.collect()} == {7 * k + i: 10.0 * k + i for k in range(3) for i in range(7)}


def test_duplicate_members_by_label(spark):
    rows = [(0, "a", None), (1, "b", 1.0), (2, "a", None), (3, "b", 2.0), (4, None, None), (5, None, None)]
    df = spark.createDataFrame(rows, "row long, hash string, `a.b` double")
    assert sorted(r.row for r in profile.duplicate_row_members(df, "row").collect()) == [0, 2, 4, 5]
    assert profile.duplicate_row_members(df, "row").columns == df.columns


def jobs_of(spark, run) -> int:
    """Spark jobs that a call starts."""
    import uuid

    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_counts_come_with_the_cleaned_table(spark, tmp_path):
    from canvass.operators import clean

    df = spark.createDataFrame([(i, float(i) if i % 7 else None, 10_000.0 if i % 50 == 1 else float(i % 5)) for i in range(400)], "i long, a double, b double")
    rules = clean.Rules((clean.Range("a", 20, 380), clean.Range("b", 1, None)), ("a",))
    for method in (None, "drop", "mean", "median", "mode"):
        plain, expected = clean.clean(df, method, True, rules)
        path = str(tmp_path / str(method))
        assert clean.clean_to(df, path, method, True, rules) == expected and len(expected) >= 2
        assert sorted(spark.read.parquet(path).collect()) == sorted(plain.collect())
    fewer = jobs_of(spark, lambda: clean.clean_to(df, str(tmp_path / "again"), "mean", True, rules))
    more = jobs_of(spark, lambda: clean.clean(df, "mean", True, rules)[0].write.parquet(str(tmp_path / "more")))
    assert fewer < more


def test_modes_of_all_columns_in_one_pass(spark):
    from canvass.operators import clean

    df = spark.createDataFrame([(3, "b", None), (1, "a", None), (3, "a", None), (1, "b", None), (2, None, None)], "v int, `s.t` string, n double")
    assert clean.column_modes(df, ["v", "s.t", "n"]) == {"v": 1, "s.t": "a", "n": None}
    assert clean.column_modes(df.where("false"), ["v"]) == {"v": None} and clean.column_modes(df, []) == {}


def by_hand(frame: pd.DataFrame, digits=4) -> tuple:
    x, w = frame.x.to_numpy(), frame.w.to_numpy()
    mean = np.average(x - x[0], weights=w) + x[0]
    size = w.sum() ** 2 / (w**2).sum()
    variance = (w * (x - mean) ** 2).sum() / w.sum() * len(x) / (len(x) - 1)
    return mean, np.sqrt(variance / size), size


def test_estimates_far_from_zero(spark):
    from canvass.operators import estimate

    draw = np.random.default_rng(8)
    frame = pd.DataFrame({"g": draw.integers(0, 4, 4000), "w": draw.uniform(0.5, 2, 4000)})
    frame["x"] = np.array([0.0, 1e9, -1e9, 5.0])[frame.g] + draw.normal(size=4000) * np.array([1.0, 1.0, 0.01, 0.0])[frame.g]
    frame["y"] = 1e9 + draw.normal(size=4000)
    frame.loc[0, "y"] = 1e12  # the first rows need not be near the others
    df = spark.createDataFrame(frame).withColumn("mean_", F.lit(1))
    got = {r.g: r for r in estimate.weighted_estimates_by(df, ["g"], "x", "w").collect()}
    for g, part in frame.groupby("g"):
        mean, error, size = by_hand(part)
        assert got[g].mean == pytest.approx(mean, abs=1e-3) and got[g].std_error == pytest.approx(error, abs=6e-5) and got[g].n_effective == pytest.approx(size, abs=0.006)
    y = by_hand(frame.assign(x=frame.y))
    one = estimate.weighted_estimates(df, ["y", "x"], "w").collect()
    assert one[0].std_error == pytest.approx(y[1], rel=1e-6) and one[1].mean == pytest.approx(by_hand(frame)[0], rel=1e-9)
    named = df.withColumnsRenamed({"g": "n", "mean_": "sw"})
    assert estimate.weighted_estimates_by(named, ["n", "sw"], "x", "w").count() == 4
    with pytest.raises(ValueError, match="names of results"):
        estimate.weighted_estimates_by(df.withColumnRenamed("g", "mean"), ["mean"], "x", "w")


def test_estimates_take_one_pass(spark):
    from canvass.operators import estimate

    read = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(0, 8000, 1, 16).selectExpr("cast(id % 9 as double) x", "1.0D + id % 3 w", "id % 2 g").mapInArrow(watched, "x double, w double, g long")
    assert len(estimate.weighted_estimates(df, ["x"], "w").collect()) == 1 and 8000 <= read.value < 12_000
    before = read.value
    assert estimate.weighted_estimates_by(df, ["g"], "x", "w").count() == 2 and read.value - before < 12_000


def test_registry_that_outlives_the_session(spark, tmp_path):
    from canvass.sources.registry import Conflict, StoredRegistry

    root = str(tmp_path / "tables")
    first = StoredRegistry(spark, root)
    assert first.names() == [] and first.get("a b/ü.csv") is None and first.log().count() == 0
    assert first.put("a b/ü.csv", spark.range(3)) == 1 and first.put("other", spark.range(1)) == 1
    held = first.get("a b/ü.csv")
    second = StoredRegistry(spark.newSession(), root)
    assert second.put("a b/ü.csv", second.spark.range(5).selectExpr("id", "id * 2 twice"), "mapped", after=1) == 2
    assert held.count() == 3 and first.get("a b/ü.csv").columns == ["id", "twice"] and first.get("a b/ü.csv", 1).count() == 3 and first.get("a b/ü.csv", 9) is None
    assert dict(first.versions) == {"a b/ü.csv": 2, "other": 1} and second.history("a b/ü.csv") == [1, 2]
    with pytest.raises(Conflict):
        first.put("a b/ü.csv", spark.range(1), after=1)
    (tmp_path / "tables/tables/other/2.json").write_text("{}")  # another session commits first
    listed = first.history
    first.history = lambda name: [x for x in listed(name) if name != "other" or x < 2]
    with pytest.raises(Conflict, match="another session"):
        first.put("other", spark.range(1))
    assert [(r.name, r.version, r.rows) for r in second.log().orderBy("at").collect()] == [("a b/ü.csv", 1, 3), ("other", 1, 1), ("a b/ü.csv", 2, 5)]
    with pytest.raises(ValueError):
        first.put("", spark.range(1))


def test_outlier_points_are_a_fair_sample(spark):
    from canvass.operators import charts

    rows = [(i, float(i % 10), float(i) if i % 4 == 0 else 0.0, None, "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, near double, far double, none double, text string").repartition(7)
    got = charts.outlier_points(df, ["near", "far", "none", "text"], ["id"], most=50)
    values = sorted(r.value for r in got.where("column = 'far'").collect())
    assert got.select("column").distinct().count() == 1 and len(values) == 50
    assert values == sorted(r.value for r in charts.outlier_points(df.repartition(3), ["far"], ["id"], most=50).collect())
    assert values != sorted(r.value for r in charts.outlier_points(df, ["far"], ["id"], most=50, seed=1).collect())
    means = [np.mean([r.value for r in charts.outlier_points(df, ["far"], ["id"], most=100, seed=s).collect()]) for s in range(8)]
    assert abs(np.mean(means) - 1000) < 150  # of all places alike
    assert charts.outlier_points(df, ["far"]).count() == 200 and charts.outlier_points(df, ["text"]).count() == 0 and charts.outlier_points(df.where("false"), ["far"]).count() == 0
    twice = df.union(df)
    assert charts.outlier_points(twice, ["far"], ["id"], most=2000).count() == 998


def test_classes_of_many_columns(spark):
    data = {f"a{i}": [i % 3, None, 5] for i in range(30)} | {f"b{i}": [float(i % 2), None, 5.0] for i in range(12)} | {"lone": ["x", None, "y"]}
    kinds = {"a": "int", "b": "double", "l": "string"}
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(f"{c} {kinds[c[0]]}" for c in data))
    classes = profile.column_classes(df)
    assert [len(c) for c in classes] == [10, 10, 10, 6, 6, 1] and sum(classes, []) != list(df.columns)
    pairs = [r.pair for r in profile.duplicate_columns(df).collect()]
    assert len(pairs) == 3 * 45 + 2 * 15 and pairs[0] == "a0 == a3" and "b0 == b2" in pairs
    assert profile.duplicate_columns(df.where("false")).count() == 30 * 29 // 2 + 12 * 11 // 2


def test_classes_when_fingerprints_agree_by_chance(spark, monkeypatch):
    monkeypatch.setattr(profile.F, "bit_xor", lambda x: F.max(F.lit(1)))
    df = spark.createDataFrame([(1, 1, 2, 2, 1), (3, 3, 4, 5, 3)], "a int, b int, c int, d int, e int")
    assert profile.column_classes(df) == [["a", "b", "e"], ["c"], ["d"]]
