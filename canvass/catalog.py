"""Registered queries of the survey operators, and their SQL.

The driver's tables hold no missing values, so queries on missing values plant them by rule, alike in both engines.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.functions import quantiles
from canvass.functions.columns import numeric_columns, round_even
from canvass.functions.student import Z
from canvass.operators import charts, clean, estimate, pivot, profile, schema
from canvass.plans import narrative, report
from canvass.scratch import Scratch
from canvass.sources import readers, registry, sinks, synth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with missing values, types and users."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 20 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 15 != 0, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 33 != 0, F.col("event_type")).alias("event_type"),
    )


PLANTED = """planted AS (SELECT event_id, CASE WHEN event_id % 20 <> 0 THEN value END AS value,
    CASE WHEN event_id % 15 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 33 <> 0 THEN event_type END AS event_type FROM events)"""


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: round_even(F.col(n), digits) for n in names})


def changes(spark: SparkSession, found: list[clean.Change]) -> DataFrame:
    return spark.createDataFrame([(c.step, c.column, c.found, c.changed) for c in found], "step string, column string, found long, changed long")


@query(f"WITH {PLANTED} SELECT CAST(sum((event_id IS NULL)::INT + (value IS NULL)::INT + (user_id IS NULL)::INT + (event_type IS NULL)::INT) AS BIGINT) AS missing_count FROM planted")
def profile_missing_cells(spark, sf_dir):
    return profile.missing_cells(planted(spark, sf_dir))


@query(
    f"WITH {PLANTED} "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS missing FROM planted" for c in ("event_id", "value", "user_id", "event_type"))
)
def profile_missing_by_column(spark, sf_dir):
    return profile.missing_by_column(planted(spark, sf_dir))


PAIRS = "pairs AS (SELECT event_id, event_type, CAST(floor(value) AS BIGINT) AS v FROM events)"


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.floor("value").cast("long").alias("v"))


@query(f"WITH {PAIRS} SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM pairs GROUP BY event_type, v HAVING count(*) > 1)")
def profile_duplicate_rows(spark, sf_dir):
    return profile.duplicate_row_count(_pairs(spark, sf_dir).drop("event_id"))


@query(f"WITH {PAIRS} SELECT event_id, event_type, v FROM (SELECT *, count(*) OVER (PARTITION BY event_type, v) AS n FROM pairs) WHERE n > 1")
def profile_duplicate_row_members(spark, sf_dir):
    return profile.duplicate_row_members(_pairs(spark, sf_dir), "event_id")


COPIES = """copies AS (SELECT l_quantity, l_discount, l_quantity + 0 AS same, CASE WHEN l_orderkey = 1 THEN -1.0 ELSE l_quantity END AS nearly,
    CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END AS holed, CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END AS holed_too FROM lineitem)"""


@query(
    f"WITH {COPIES} "
    + " UNION ALL ".join(
        f"SELECT '{a} == {b}' AS pair WHERE NOT EXISTS (SELECT 1 FROM copies WHERE {a} IS DISTINCT FROM {b})"
        for a, b in itertools.combinations(("l_quantity", "l_discount", "same", "nearly", "holed", "holed_too"), 2)
    )
)
def profile_duplicate_columns(spark, sf_dir):
    quantity, holed = F.col("l_quantity"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax"))
    nearly = F.when(F.col("l_orderkey") == 1, -1.0).otherwise(quantity)
    return profile.duplicate_columns(table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", (quantity + 0).alias("same"), nearly.alias("nearly"), holed.alias("holed"), holed.alias("holed_too")))


@query("SELECT (SELECT CAST(count(*) AS BIGINT) FROM lineitem) AS row_count, CAST(count(*) AS BIGINT) AS col_count FROM (DESCRIBE lineitem)")
def profile_shape(spark, sf_dir):
    return profile.shape(table(spark, sf_dir, "lineitem"))


@query('SELECT column_name AS header FROM (DESCRIBE orders)')
def profile_headers(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in profile.profile(table(spark, sf_dir, "orders"), "orders")["headers"]], "header string")


@query("SELECT c_custkey AS id, c_name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer")
def schema_rename(spark, sf_dir):
    return schema.rename(table(spark, sf_dir, "customer"), {"c_custkey": "id", "c_acctbal": "balance", "absent": "x"})


@query("SELECT column_name AS \"column\" FROM (DESCRIBE lineitem) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE')")
def schema_numeric_columns(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in numeric_columns(table(spark, sf_dir, "lineitem"))], "column string")


@query(f"WITH {PLANTED} SELECT event_id, round_even(coalesce(value, (SELECT avg(value) FROM planted)), 6) AS value FROM planted")
def impute_mean(spark, sf_dir):
    return rounded(clean.impute(planted(spark, sf_dir).select("event_id", "value"), "mean", ["value"])[0], "value", digits=6)


@query(f"WITH {PLANTED} SELECT event_id, round_even(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM planted)), 6) AS value FROM planted")
def impute_median(spark, sf_dir):
    return rounded(clean.impute(planted(spark, sf_dir).select("event_id", "value"), "median", ["value"])[0], "value", digits=6)


@query(
    """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_size END AS p_size FROM part),
    m AS (SELECT p_size FROM p WHERE p_size IS NOT NULL GROUP BY p_size ORDER BY count(*) DESC, p_size LIMIT 1)
    SELECT p_partkey, coalesce(p_size, (SELECT p_size FROM m)) AS p_size FROM p"""
)
def impute_mode(spark, sf_dir):
    holed = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_size")).alias("p_size"))
    return clean.impute(holed, "mode")[0]


@query("SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 6 <> 0 THEN n_regionkey % 2 END, (SELECT min(v) FROM (SELECT v FROM (SELECT n_regionkey % 2 AS v, count(*) AS n FROM nation WHERE n_nationkey % 6 <> 0 GROUP BY v) QUALIFY n = max(n) OVER ()))) AS v FROM nation")
def impute_mode_grouped_ties(spark, sf_dir):
    holed = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 6 != 0, F.col("n_regionkey") % 2).alias("v"))
    return clean.impute(holed, "mode", ["v"])[0]


@query("SELECT n_nationkey, coalesce(CASE WHEN n_nationkey > 0 THEN n_nationkey END, 1) AS v FROM nation")
def impute_mode_all_tied(spark, sf_dir):
    return clean.impute(table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") > 0, F.col("n_nationkey")).alias("v")), "mode", ["v"])[0]


@query(f"WITH {PLANTED} SELECT event_id, value, user_id FROM planted WHERE value IS NOT NULL AND user_id IS NOT NULL")
def impute_drop(spark, sf_dir):
    return clean.impute(planted(spark, sf_dir).select("event_id", "value", "user_id"), "drop")[0]


@query(
    f"""WITH {PLANTED}, a AS (SELECT CASE WHEN value IS NULL THEN 'value' WHEN user_id IS NULL THEN 'user_id' END AS "column" FROM planted)
    SELECT 'impute drop' AS step, "column", CAST(count(*) AS BIGINT) AS found, CAST(count(*) AS BIGINT) AS changed FROM a WHERE "column" IS NOT NULL GROUP BY "column" """
)
def impute_drop_counts(spark, sf_dir):
    return changes(spark, clean.impute(planted(spark, sf_dir).select("value", "user_id"), "drop")[1])


def _band(c: str, source: str) -> str:
    q = f"(SELECT quantile_cont({c}, %s) FROM {source})"
    a, b = q % "0.25", q % "0.75"
    return f"{c} BETWEEN {a} - 1.5 * ({b} - {a}) AND {b} + 1.5 * ({b} - {a})"


@query(f"SELECT event_id, value FROM events WHERE {_band('value', 'events')}")
def outliers_iqr_single(spark, sf_dir):
    return clean.remove_outliers(table(spark, sf_dir, "events").select("event_id", "value"), ["value"])[0]


LINES = """lines AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 50 <> 0 THEN l_quantity END AS l_quantity,
    l_extendedprice * l_extendedprice AS price, l_discount FROM lineitem)"""


def _lines(spark, sf_dir):
    price = (F.col("l_extendedprice") * F.col("l_extendedprice")).alias("price")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 50 != 0, F.col("l_quantity")).alias("l_quantity"), price, "l_discount")


@query(f"WITH {LINES} SELECT * FROM lines WHERE {_band('l_quantity', 'lines')} AND {_band('price', 'lines')} AND {_band('l_discount', 'lines')}")
def outliers_iqr_multi(spark, sf_dir):
    return clean.remove_outliers(_lines(spark, sf_dir), ["l_quantity", "price", "l_discount"])[0]


BALANCE = clean.Rules((clean.Range("c_acctbal", 0, 8000), clean.Range("c_nationkey", None, 19)))


@query("SELECT * FROM customer WHERE c_acctbal BETWEEN 0 AND 8000 AND c_nationkey <= 19")
def rules_range(spark, sf_dir):
    return clean.apply_rules(table(spark, sf_dir, "customer"), BALANCE)[0]


@query(
    """WITH a AS (SELECT CASE WHEN NOT (c_acctbal BETWEEN 0 AND 8000) THEN '0: range c_acctbal' WHEN c_nationkey > 19 THEN '1: range c_nationkey' END AS "column" FROM customer)
    SELECT 'rules' AS step, "column", CAST(count(*) AS BIGINT) AS found, CAST(count(*) AS BIGINT) AS changed FROM a WHERE "column" IS NOT NULL GROUP BY "column" """
)
def rules_range_sequential_counts(spark, sf_dir):
    return changes(spark, clean.apply_rules(table(spark, sf_dir, "customer"), BALANCE)[1])


PEOPLE = "people AS (SELECT c_custkey, c_custkey % 150 - 10 AS \"Age\", CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal * 2000 END AS \"Income\" FROM customer)"


def _people(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", (key % 150 - 10).alias("Age"), F.when(key % 9 != 0, F.col("c_acctbal") * 2000).alias("Income"))


@query(f'WITH {PEOPLE} SELECT * FROM people WHERE "Age" BETWEEN 0 AND 120 AND "Income" BETWEEN 0 AND 10000000')
def rules_default(spark, sf_dir):
    return clean.apply_rules(_people(spark, sf_dir), clean.DEFAULT_RULES)[0]


@query(
    f"""WITH {PEOPLE}, a AS (SELECT CASE WHEN NOT "Age" BETWEEN 0 AND 120 THEN '0: range Age|0 to 120' WHEN NOT coalesce("Income" BETWEEN 0 AND 10000000, false) THEN '1: range Income|0 to 10000000' END AS r FROM people)
    SELECT split_part(r, '|', 1) AS "column", split_part(r, '|', 2) AS detail, CAST(count(*) AS BIGINT) AS changed FROM a WHERE r IS NOT NULL GROUP BY ALL"""
)
def rules_default_log(spark, sf_dir):
    found = clean.apply_rules(_people(spark, sf_dir), clean.DEFAULT_RULES)[1]
    return spark.createDataFrame([(c.column, c.detail, c.changed) for c in found], "column string, detail string, changed long")


@query(f"WITH {PLANTED} SELECT * FROM planted WHERE value IS NOT NULL AND event_type IS NOT NULL")
def rules_mandatory(spark, sf_dir):
    return clean.apply_rules(planted(spark, sf_dir), clean.Rules.of({"mandatory": ["value", "event_type", "absent"]}))[0]


FROM_5_TO_100 = clean.Rules((clean.Range("value", 5, 100),))


@query(
    f"""WITH {PLANTED}, filled AS (SELECT event_id, coalesce(value, (SELECT avg(value) FROM planted)) AS value FROM planted),
    inside AS (SELECT * FROM filled WHERE {_band('value', 'filled')} AND {_band('event_id', 'filled')})
    SELECT event_id, round_even(value, 6) AS value FROM inside WHERE value BETWEEN 5 AND 100"""
)
def clean_pipeline(spark, sf_dir):
    df = planted(spark, sf_dir).select("event_id", "value")
    return rounded(clean.clean(df, "mean", True, FROM_5_TO_100, clean.Observed())[0], "value", digits=6)


@query(
    f"""WITH {PLANTED}, filled AS (SELECT event_id, coalesce(value, (SELECT avg(value) FROM planted)) AS value FROM planted),
    inside AS (SELECT * FROM filled WHERE {_band('value', 'filled')} AND {_band('event_id', 'filled')}),
    found(step, "column", n) AS (
        SELECT 'impute mean', 'value', (SELECT count(*) FROM planted WHERE value IS NULL) UNION ALL SELECT 'outliers', 'all', (SELECT count(*) FROM filled) - (SELECT count(*) FROM inside)
        UNION ALL SELECT 'rules', '0: range value', (SELECT count(*) FROM inside WHERE NOT value BETWEEN 5 AND 100))
    SELECT step, "column", CAST(n AS BIGINT) AS found, CAST(n AS BIGINT) AS changed FROM found WHERE n > 0"""
)
def clean_pipeline_counts(spark, sf_dir):
    """What the steps change, counted by the job that writes the cleaned table."""
    path = Scratch(spark, "cleaned").path("table")
    return changes(spark, clean.clean_to(planted(spark, sf_dir).select("event_id", "value"), path, "mean", True, FROM_5_TO_100))


def _grouped(select: str, keys: str = "l_returnflag", source: str = "lineitem") -> str:
    return f"SELECT {keys}, {select} FROM {source} GROUP BY {keys}"


@query(_grouped("round_even(avg(l_extendedprice), 4) AS l_extendedprice"))
def pivot_mean(spark, sf_dir):
    return rounded(pivot.pivot(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice"), "l_extendedprice")


@query(_grouped("CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber"))
def pivot_sum(spark, sf_dir):
    return pivot.pivot(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", "sum")


@query(_grouped("CAST(count(l_quantity) AS BIGINT) AS l_quantity"))
def pivot_count(spark, sf_dir):
    return pivot.pivot(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "count")


@query(_grouped("round_even(avg(l_tax), 4) AS l_tax", "l_returnflag, l_linestatus"))
def pivot_multi_key(spark, sf_dir):
    return rounded(pivot.pivot(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_tax"), "l_tax")


@query(_grouped("round_even(avg(l_discount), 4) AS l_discount, round_even(avg(l_quantity), 4) AS l_quantity"))
def pivot_multi_value(spark, sf_dir):
    return rounded(pivot.pivot(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"]), "l_discount", "l_quantity")


@query(_grouped("max(l_quantity) AS l_quantity, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber", "l_returnflag, l_linestatus"))
def pivot_per_column_agg(spark, sf_dir):
    return pivot.pivot(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], agg={"l_quantity": "max", "l_linenumber": "sum"})


@query(_grouped("CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber_sum, min(l_linenumber) AS l_linenumber_min"))
def pivot_list_of_aggs(spark, sf_dir):
    return pivot.pivot(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", ["sum", "min"])


NULLED = f"{PLANTED}, nulled AS (SELECT event_id, event_type, CASE WHEN event_type <> 'click' THEN value END AS value FROM planted)"


def _nulled(spark, sf_dir):
    return planted(spark, sf_dir).select("event_id", "event_type", F.when(F.col("event_type") != "click", F.col("value")).alias("value"))


@query(
    f"""WITH {NULLED} SELECT event_type, round_even(coalesce(sum(value), 0), 2) AS value_sum, CAST(count(value) AS BIGINT) AS value_count
    FROM nulled WHERE event_type IS NOT NULL GROUP BY event_type"""
)
def pivot_null_semantics(spark, sf_dir):
    return rounded(pivot.pivot(_nulled(spark, sf_dir), "event_type", "value", ["sum", "count"]), "value_sum", digits=2)


@query(f"WITH {NULLED} SELECT event_type, round_even(avg(value), 4) AS value FROM nulled WHERE event_type IS NOT NULL GROUP BY event_type HAVING count(value) > 0")
def pivot_null_groups_dropped(spark, sf_dir):
    return rounded(pivot.pivot(_nulled(spark, sf_dir), "event_type", "value", "mean"), "value")


def _typed(select: str) -> str:
    return f"WITH {PLANTED} SELECT event_type, {select} FROM planted WHERE event_type IS NOT NULL GROUP BY event_type"


def _by_type(spark, sf_dir, agg, value="value"):
    return pivot.pivot(planted(spark, sf_dir), "event_type", value, agg, row_id="event_id")


@query(_typed("round_even(quantile_cont(value, 0.5), 4) AS value_median, round_even(quantile_cont(value, 0.5), 4) AS value_quantile"))
def pivot_median(spark, sf_dir):
    return rounded(_by_type(spark, sf_dir, ["median", "quantile"]), "value_median", "value_quantile")


@query(_typed("min(value) AS value_min, max(value) AS value_max"))
def pivot_min_max(spark, sf_dir):
    return _by_type(spark, sf_dir, ["min", "max"])


@query(_typed("round_even(stddev_samp(value), 4) AS value_std, round_even(var_samp(value), 2) AS value_var, round_even(stddev_samp(value) / sqrt(count(value)), 4) AS value_sem"))
def pivot_std_var_sem(spark, sf_dir):
    return rounded(rounded(_by_type(spark, sf_dir, ["std", "var", "sem"]), "value_std", "value_sem"), "value_var", digits=2)


@query(_typed("CAST(count(DISTINCT user_id) AS BIGINT) AS user_id"))
def pivot_nunique(spark, sf_dir):
    return _by_type(spark, sf_dir, "nunique", "user_id")


@query(_typed("arg_min(value, event_id) FILTER (WHERE value IS NOT NULL) AS value_first, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value_last"))
def pivot_first_last(spark, sf_dir):
    return _by_type(spark, sf_dir, ["first", "last"])


@query(_typed("bool_or(value <> 0) AS value_any, bool_and(value > -1e300 AND value <> 0) AS value_all"))
def pivot_any_all(spark, sf_dir):
    return _by_type(spark, sf_dir, ["any", "all"])


@query(_typed("round_even(skewness(value), 4) AS value"))
def pivot_skew(spark, sf_dir):
    return rounded(_by_type(spark, sf_dir, "skew"), "value")


@query(
    f"""WITH {PLANTED}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS hi,
    row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS lo FROM planted WHERE event_type IS NOT NULL AND value IS NOT NULL)
    SELECT event_type, max(event_id) FILTER (WHERE hi = 1) AS value_idxmax, max(event_id) FILTER (WHERE lo = 1) AS value_idxmin FROM r GROUP BY event_type"""
)
def pivot_idxmax_idxmin(spark, sf_dir):
    return _by_type(spark, sf_dir, ["idxmax", "idxmin"])


@query("SELECT n_regionkey, round_even(product(n_nationkey + 1), 0) AS n FROM nation GROUP BY n_regionkey")
def pivot_prod(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select("n_regionkey", (F.col("n_nationkey") + 1).alias("n"))
    return rounded(pivot.pivot(df, "n_regionkey", "n", "prod"), "n", digits=0)


@query(
    _typed(
        """CAST(count(value) AS BIGINT) AS value_count, round_even(avg(value), 4) AS value_mean, round_even(stddev_samp(value), 4) AS value_std, min(value) AS value_min,
        round_even(quantile_cont(value, 0.25), 4) AS "value_25%", round_even(quantile_cont(value, 0.5), 4) AS "value_50%", round_even(quantile_cont(value, 0.75), 4) AS "value_75%", max(value) AS value_max"""
    )
)
def pivot_describe(spark, sf_dir):
    return rounded(_by_type(spark, sf_dir, "describe"), "value_mean", "value_std", "value_25%", "value_50%", "value_75%")


@query(
    f"""WITH {PLANTED} SELECT event_id, round_even(CASE WHEN value IS NOT NULL THEN sum(value) OVER (PARTITION BY event_type ORDER BY event_id) END, 2) AS value
    FROM planted WHERE event_type IS NOT NULL"""
)
def pivot_cumsum(spark, sf_dir):
    return rounded(pivot.group_transform(planted(spark, sf_dir), ["event_type"], "value", "cumsum", "event_id"), "value", digits=2)


@query(
    f"""WITH {PLANTED} SELECT event_id, CASE WHEN value IS NOT NULL THEN rank() OVER (PARTITION BY event_type ORDER BY value NULLS LAST)
    + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 END AS value FROM planted WHERE event_type IS NOT NULL"""
)
def pivot_rank(spark, sf_dir):
    return pivot.group_transform(planted(spark, sf_dir), ["event_type"], "value", "rank", "event_id")


def _t(v: str) -> str:
    z = repr(Z) + "e0"  # a double, not a decimal
    p = lambda k: "*".join([z] * k)
    return (
        f"({z} + ({p(3)}+{z})/(4*({v})) + (5*{p(5)}+16*{p(3)}+3*{z})/(96*({v})*({v})) + (3*{p(7)}+19*{p(5)}+17*{p(3)}-15*{z})/(384*({v})*({v})*({v}))"
        f" + (79*{p(9)}+776*{p(7)}+1482*{p(5)}-1920*{p(3)}-945*{z})/(92160*({v})*({v})*({v})*({v})))"
    )


def _estimate_sql(target: str, population: str = "CAST(NULL AS DOUBLE)", source: str = "lineitem", weight: str = "l_quantity") -> str:
    found = f"""SELECT '{target}' AS "column", CAST(n AS BIGINT) AS n_sample, round_even(size, 2) AS n_effective, round_even(mean, 4) AS mean, round_even(se, 4) AS std_error,
        round_even({_t('size - 1')} * se, 4) AS margin_of_error, round_even(mean - {_t('size - 1')} * se, 4) AS ci_95_lower, round_even(mean + {_t('size - 1')} * se, 4) AS ci_95_upper,
        round_even(mean * {population}, 2) AS population_estimate
        FROM (SELECT any_value(n) AS n, any_value(size) AS size, any_value(m) AS mean,
            sqrt(sum(l_quantity * ({target} - m) * ({target} - m)) / any_value(sw) * any_value(n) / (any_value(n) - 1)) / sqrt(any_value(size)) AS se
            FROM lineitem, (SELECT count(*) AS n, sum(l_quantity) AS sw, sum(l_quantity) * sum(l_quantity) / sum(l_quantity * l_quantity) AS size,
                sum(l_quantity * {target}) / sum(l_quantity) AS m FROM lineitem))"""
    return found.replace("l_quantity", weight).replace("lineitem", source)


def _estimates(spark, sf_dir, targets, population=None):
    return estimate.weighted_estimates(table(spark, sf_dir, "lineitem"), targets, "l_quantity", population)


@query("SELECT round_even(sum(l_quantity) * sum(l_quantity) / sum(l_quantity * l_quantity), 4) AS n_effective FROM lineitem")
def weighted_ess(spark, sf_dir):
    return rounded(estimate.effective_sample_size(table(spark, sf_dir, "lineitem"), "l_quantity"), "n_effective")


@query(_estimate_sql("l_extendedprice"))
def weighted_estimate(spark, sf_dir):
    return _estimates(spark, sf_dir, ["l_extendedprice"])


@query(" UNION ALL ".join(map(_estimate_sql, ("l_extendedprice", "l_discount", "l_tax"))))
def weighted_estimate_multi(spark, sf_dir):
    return _estimates(spark, sf_dir, ["l_extendedprice", "absent", "l_discount", "l_tax"])


@query(_estimate_sql("l_extendedprice", "1000000.0"))
def weighted_estimate_population(spark, sf_dir):
    return _estimates(spark, sf_dir, ["l_extendedprice"], estimate.parse_population(" 1000000 "))


def _few(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_acctbal", (F.col("s_nationkey") + 1).cast("double").alias("weight"))


# Under 200 degrees of freedom the library inverts the distribution; the expansion agrees to nine digits at these sizes.
@query("WITH few AS (SELECT s_acctbal, CAST(s_nationkey + 1 AS DOUBLE) AS weight FROM supplier) " + _estimate_sql("s_acctbal", source="few", weight="weight"))
def weighted_estimate_small(spark, sf_dir):
    return estimate.weighted_estimates(_few(spark, sf_dir), ["s_acctbal"], "weight")


@query(
    """WITH s AS (SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS sw, sum(l_quantity * l_quantity) AS sww, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS m FROM lineitem GROUP BY 1),
    d AS (SELECT l_returnflag, sum(l_quantity * (l_extendedprice - m) * (l_extendedprice - m)) AS d FROM lineitem JOIN s USING (l_returnflag) GROUP BY 1),
    e AS (SELECT l_returnflag, n, sw * sw / sww AS size, m, sqrt(d / sw * n / (n - 1) / (sw * sw / sww)) AS se FROM s JOIN d USING (l_returnflag))
    SELECT l_returnflag, CAST(n AS BIGINT) AS n_sample, round_even(size, 2) AS n_effective, round_even(m, 4) AS mean, round_even(se, 4) AS std_error,
    """
    + f"round_even({_t('size - 1')} * se, 4) AS margin_of_error, round_even(m - {_t('size - 1')} * se, 4) AS ci_95_lower, round_even(m + {_t('size - 1')} * se, 4) AS ci_95_upper FROM e"
)
def weighted_estimate_by_group(spark, sf_dir):
    return estimate.weighted_estimates_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")


HIGH = "high AS (SELECT l_returnflag, l_quantity, 1e9 + l_discount * 100 AS price FROM lineitem)"


@query(f"WITH {HIGH} " + _estimate_sql("price", source="high"))
def weighted_estimate_far_from_zero(spark, sf_dir):
    """A mean of a thousand million with a spread of a few: plain sums of squares would lose it."""
    high = table(spark, sf_dir, "lineitem").select("l_quantity", (F.lit(1e9) + F.col("l_discount") * 100).alias("price"))
    return estimate.weighted_estimates(high, ["price"], "l_quantity")


@query(
    f"""SELECT "column", round_even(std_error / mean * 100, 1) AS cv, CASE WHEN std_error / mean * 100 < 5 THEN 'high' WHEN std_error / mean * 100 < 15 THEN 'moderate' ELSE 'low' END AS reliability
    FROM ({_estimate_sql('l_extendedprice')} UNION ALL {_estimate_sql('l_tax')})"""
)
def weighted_reliability(spark, sf_dir):
    return estimate.reliability(_estimates(spark, sf_dir, ["l_extendedprice", "l_tax"])).select("column", "cv", "reliability")


@query(
    """WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events), w AS (SELECT lo, (hi - lo) / 30 AS width FROM b),
    c AS (SELECT least(CAST(floor((value - lo) / width) AS INT), 29) + 1 AS bin, count(*) AS n FROM events, w GROUP BY 1)
    SELECT CAST(k AS INT) AS bin, round_even(lo + (k - 1) * width, 6) AS low, round_even(lo + k * width, 6) AS high, CAST(coalesce(n, 0) AS BIGINT) AS count
    FROM (SELECT unnest(range(1, 31)) AS k) CROSS JOIN w LEFT JOIN c ON c.bin = k"""
)
def chart_histogram(spark, sf_dir):
    return rounded(charts.histogram(table(spark, sf_dir, "events"), "value", 30), "low", "high", digits=6)


@query(
    """WITH b AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events),
    k AS (SELECT *, CAST(ceil((hi - lo) / least(greatest(2 * iqr * pow(n, -1.0 / 3), (hi - lo) / (2 * sqrt(n))), (hi - lo) / (log2(n) + 1))) AS INT) AS bins FROM b),
    w AS (SELECT *, (hi - lo) / bins AS width FROM k),
    c AS (SELECT least(CAST(floor((value - lo) / width) AS INT), bins - 1) + 1 AS bin, count(*) AS n FROM events, w GROUP BY 1)
    SELECT CAST(k AS INT) AS bin, round_even(lo + (k - 1) * width, 6) AS low, round_even(lo + k * width, 6) AS high, CAST(coalesce(c.n, 0) AS BIGINT) AS count
    FROM (SELECT w.*, unnest(range(1, bins + 1)) AS k FROM w) LEFT JOIN c ON c.bin = k"""
)
def chart_histogram_auto(spark, sf_dir):
    return rounded(charts.histogram(table(spark, sf_dir, "events"), "value"), "low", "high", digits=6)


@query(
    """WITH b AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS h FROM events),
    c AS (SELECT lo + (least(floor((value - lo) / ((hi - lo) / 1000)), 999) + 0.5) * ((hi - lo) / 1000) AS middle, count(*) AS n FROM events, b GROUP BY 1),
    g AS (SELECT lo - 3 * h + k * ((hi - lo + 6 * h) / 199) AS x FROM b, (SELECT unnest(range(200)) AS k))
    SELECT round_even(x, 6) AS x, round_even(sum(exp(-((x - middle) / h) * ((x - middle) / h) / 2) * c.n) / any_value(b.n * h * sqrt(2 * pi())), 9) AS density
    FROM g, c, b GROUP BY x"""
)
def chart_kde(spark, sf_dir):
    return rounded(rounded(charts.density(table(spark, sf_dir, "events"), "value"), "x", digits=6), "density", digits=9)


def _box_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", q1, median, q3, (SELECT min({c}) FROM lineitem WHERE {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
        (SELECT max({c}) FROM lineitem WHERE {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
        (SELECT CAST(count(*) AS BIGINT) FROM lineitem WHERE NOT {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
        FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3 FROM lineitem)"""


BOXED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query('SELECT "column", round_even(q1, 4) AS q1, round_even(median, 4) AS median, round_even(q3, 4) AS q3, whisker_low, whisker_high, outliers FROM (' + " UNION ALL ".join(map(_box_sql, BOXED)) + ")")
def chart_box_stats(spark, sf_dir):
    return rounded(charts.box_stats(table(spark, sf_dir, "lineitem"), [*BOXED, "l_returnflag"]), "q1", "median", "q3")


TOLD = f"({_estimate_sql('l_extendedprice', '1000000.0')} UNION ALL {_estimate_sql('l_tax', '1000000.0')})"


@query(
    f"""WITH told AS (SELECT *, std_error / mean * 100 AS cv FROM {TOLD})
    SELECT '<b>Summary of lineitem</b><br><br>Weighted estimates were made for 2 variables.<br><br>'
    || string_agg(format('<b>{{}}</b>: the weighted mean is {{:,.2f}} (95% interval {{:,.2f}} to {{:,.2f}}), with a standard error of {{:,.4f}} at an effective sample of {{:,.2f}}, of ',
        "column", mean, ci_95_lower, ci_95_upper, std_error, n_effective)
        || CASE WHEN cv < 5 THEN 'high' WHEN cv < 15 THEN 'moderate' ELSE 'low' END
        || format(' reliability at a coefficient of variation of {{:.1f}}%. Projected to the population, the total is {{:,.2f}}.', round_even(cv, 1), population_estimate), '<br><br>' ORDER BY "column")
    || '<br><br>Method: design weights, effective sample size after Kish, Student intervals on its degrees of freedom.' AS summary FROM told"""
)
def narrative_summary(spark, sf_dir):
    return spark.createDataFrame([(narrative.summary(_estimates(spark, sf_dir, ["l_extendedprice", "l_tax"], 1e6), "lineitem"),)], "summary string")


@query(
    f"""SELECT format('<tr><td>{{}}</td><td>{{:,.4f}}</td><td>{{:,.4f}}</td><td>{{:,.4f}} to {{:,.4f}}</td><td>{{:,.4f}}</td></tr>', "column", mean, std_error, ci_95_lower, ci_95_upper, population_estimate) AS line FROM {TOLD}
    UNION ALL SELECT '<li>loaded</li>' UNION ALL SELECT '<li>a &lt; b</li>'"""
)
def report_lines(spark, sf_dir):
    """The rows of the report's estimate table and of its log."""
    tables = registry.Registry()
    tables.put("lineitem", table(spark, sf_dir, "lineitem"))
    page = report.report(report.analyse(tables, "lineitem", ["l_extendedprice", "l_tax"], "l_quantity", 1e6), log=["loaded", "a < b"])
    return spark.createDataFrame([(x,) for x in re.findall(r"<tr><td>.*?</tr>|<li>.*?</li>", page)], "line string")


@query("SELECT n_nationkey, n_name, n_regionkey, 2 AS version FROM nation")
def registry_replace(spark, sf_dir):
    """A table put twice under one name is the second, of version 2, also as a view."""
    tables = registry.Registry()
    tables.put("survey file.csv", table(spark, sf_dir, "region"))
    version = tables.put("survey file.csv", table(spark, sf_dir, "nation"))
    return spark.table(tables.view("survey file.csv")).withColumn("version", F.lit(version))


@query("SELECT * FROM (VALUES (0, 'regions version 1: loaded'), (1, 'regions version 2: cleaned'), (2, 'done')) AS t(line, message)")
def registry_log(spark, sf_dir):
    tables = registry.Registry()
    tables.put("regions", table(spark, sf_dir, "region"))
    tables.put("regions", table(spark, sf_dir, "region"), "cleaned")
    tables.note("done")
    return spark.createDataFrame([(i, x.split(": ", 1)[1]) for i, x in enumerate(tables.log)], "line int, message string")


@query(
    """SELECT 'region.parquet' AS name, true AS loaded, CAST(count(*) AS BIGINT) AS n FROM region UNION ALL SELECT 'nation.parquet', true, CAST(count(*) AS BIGINT) FROM nation
    UNION ALL SELECT * FROM (VALUES ('notes.txt', false, 0), ('absent.parquet', false, 0))"""
)
def load_batch(spark, sf_dir):
    """Of a batch, the files that load and those that don't: one bad file doesn't stop the others."""
    found = readers.load_batch(spark, [f"{sf_dir}/region.parquet", f"{sf_dir}/notes.txt", f"{sf_dir}/absent.parquet", f"{sf_dir}/nation.parquet"])
    rows = [(name, True, df.count()) for name, df in found.tables.items()] + [(path.rsplit("/", 1)[-1], False, 0) for path in found.failures]
    return spark.createDataFrame(rows, "name string, loaded boolean, n long")


@query("SELECT * FROM (VALUES ('s_weight'), ('s_age')) AS t(missing)")
def schema_missing_columns(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in schema.missing_columns(table(spark, sf_dir, "supplier"), ["s_weight", "s_name", "s_age", "s_acctbal"])], "missing string")


@query("SELECT l_returnflag, CAST(count(l_tax) AS BIGINT) AS l_tax FROM lineitem GROUP BY l_returnflag")
def records_response(spark, sf_dir):
    """A pivot as the row dictionaries of a response."""
    found = sinks.records(pivot.pivot(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_tax", "count"))
    return spark.createDataFrame([(r["l_returnflag"], r["l_tax"]) for r in found], "l_returnflag string, l_tax long")


@query(
    'SELECT unnest([\'l_extendedprice\', \'l_discount\']) AS "column", round_even(unnest([(SELECT quantile_cont(l_extendedprice, 0.25) FROM lineitem), (SELECT quantile_cont(l_discount, 0.25) FROM lineitem)]), 6) AS q1, '
    "round_even(unnest([(SELECT quantile_cont(l_extendedprice, 0.75) FROM lineitem), (SELECT quantile_cont(l_discount, 0.75) FROM lineitem)]), 6) AS q3"
)
def quantiles_by_brackets(spark, sf_dir):
    """Quartiles by narrowed brackets, as for tables too large for one percentile aggregate."""
    found = quantiles.exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_discount"], [0.25, 0.75], interval_rows=100)
    return rounded(spark.createDataFrame([(c, *map(float, x)) for c, x in found.items()], "column string, q1 double, q3 double"), "q1", "q3", digits=6)


@query(
    """SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT c_custkey) AS BIGINT) AS respondents, true AS ages, true AS some_bad_ages, true AS some_missing, true AS households, true AS weights FROM customer"""
)
def synth_survey_invariants(spark, sf_dir):
    age, income, n = F.col("Q1_Age_Years"), F.col("Income"), F.count("*")
    return synth_survey(spark, sf_dir).agg(
        n.alias("n"), F.count_distinct("Respondent_ID").alias("respondents"), F.bool_and((age == -5) | age.between(18, 79)).alias("ages"),
        (F.count_if(age == -5) / n).between(0.001, 0.03).alias("some_bad_ages"), (F.count_if(income.isNull()) / n).between(0.02, 0.09).alias("some_missing"),
        F.bool_and(F.col("Household_Size").between(1, 5)).alias("households"), F.bool_and((F.col("Survey_Weight") >= 0.8) & (F.col("Survey_Weight") < 1.5)).alias("weights"),
    )


@query()
def synth_survey(spark, sf_dir):
    """A survey of all customers."""
    return synth.survey(table(spark, sf_dir, "customer"), "c_custkey")


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def csv_roundtrip(spark, sf_dir):
    path = Scratch(spark, "region").path("csv")
    sinks.write_csv(table(spark, sf_dir, "region").coalesce(1), path)
    return readers.read_csv(spark, path)


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, lang, md5(text) AS text, source, n_chars FROM documents WHERE trim(text) <> ''")
def csv_line_ends(spark, sf_dir):
    """Whole texts, with the line ends and quotes in them, from CSV files that are read in splits of 64 kB."""
    path = Scratch(spark, "documents").path("csv")
    df = table(spark, sf_dir, "documents").where("trim(text) <> ''").select("doc_id", "lang", "text", "source", "n_chars")
    sinks.write_csv(df, path, quoteAll=True)
    return readers.read_csv(spark, path, split_bytes=1 << 16).withColumn("text", F.md5("text"))


@query(
    """WITH rows AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row, event_type, CAST(floor(value) AS BIGINT) AS v FROM events)
    SELECT row, event_type, v FROM rows QUALIFY count(*) OVER (PARTITION BY event_type, v) > 1"""
)
def profile_duplicate_row_labels(spark, sf_dir):
    """Rows that repeat, by their number in the file, which the reader gives: the table has no key."""
    path = Scratch(spark, "events").path("csv")
    sinks.write_csv(_pairs(spark, sf_dir).orderBy("event_id").drop("event_id").coalesce(1), path)
    return profile.duplicate_row_members(readers.read_csv(spark, path, row_label="row", split_bytes=1 << 15), "row")


@query("SELECT event_id AS row, event_id, event_type FROM events WHERE event_id % 100 = 7")
def parquet_row_labels(spark, sf_dir):
    """The rows' places in a Parquet file; event_id counts them as well."""
    return readers.read_parquet(spark, f"{sf_dir}/events.parquet", row_label="row").where("event_id % 100 = 7").select("row", "event_id", "event_type")


MOSTLY = "mostly AS (SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 'rest' ELSE 'most' END AS part, CASE WHEN event_id % 20 <> 0 THEN CAST(floor(value) AS BIGINT) END AS v FROM events)"


def _mostly(spark, sf_dir):
    """events with nine rows of ten in one group."""
    key, value = F.when(F.col("event_id") % 10 == 3, "rest").otherwise("most"), F.when(F.col("event_id") % 20 != 0, F.floor("value").cast("long"))
    return table(spark, sf_dir, "events").select("event_id", key.alias("part"), value.alias("v"))


@query(f"WITH {MOSTLY} SELECT event_id, CASE WHEN v IS NOT NULL THEN CAST(sum(v) OVER (PARTITION BY part ORDER BY event_id) AS BIGINT) END AS v FROM mostly")
def pivot_cumsum_one_key(spark, sf_dir):
    return pivot.group_transform(_mostly(spark, sf_dir), ["part"], "v", "cumsum", "event_id", rows_a_range=100)


@query(f"WITH {MOSTLY} SELECT event_id, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY part ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY part, v) - 1) / 2.0 END AS v FROM mostly")
def pivot_rank_one_key(spark, sf_dir):
    return pivot.group_transform(_mostly(spark, sf_dir), ["part"], "v", "rank", "event_id", rows_a_range=10)


PRICES = "prices AS (SELECT CASE WHEN l_orderkey % 10 = 3 THEN 'rest' ELSE 'most' END AS part, l_extendedprice AS price, l_quantity FROM lineitem)"


@query(
    f"""WITH {PRICES} SELECT part, CAST(count(price) AS BIGINT) AS price_count, round_even(avg(price), 4) AS price_mean, round_even(stddev_samp(price), 4) AS price_std, min(price) AS price_min,
    round_even(quantile_cont(price, 0.25), 4) AS "price_25%", round_even(quantile_cont(price, 0.5), 4) AS "price_50%", round_even(quantile_cont(price, 0.75), 4) AS "price_75%", max(price) AS price_max,
    round_even(quantile_cont(l_quantity, 0.5), 4) AS l_quantity_median FROM prices GROUP BY part"""
)
def pivot_describe_one_key(spark, sf_dir):
    """Quantiles of groups too large to be sorted, by narrowed intervals; l_quantity has many equal values."""
    part = F.when(F.col("l_orderkey") % 10 == 3, "rest").otherwise("most")
    df = table(spark, sf_dir, "lineitem").select(part.alias("part"), F.col("l_extendedprice").alias("price"), "l_quantity")
    told = pivot.pivot(df, "part", ["price"], ["describe"], interval_rows=200)
    told = told.join(pivot.pivot(df, "part", ["l_quantity"], ["median"], interval_rows=200), "part")
    return rounded(told, *[c for c in told.columns if c not in ("part", "price_count", "price_min", "price_max")])


@query("SELECT CAST(1 AS BIGINT) AS version, CAST(r_regionkey AS BIGINT) AS key, r_name AS name FROM region UNION ALL SELECT 2, n_nationkey, n_name FROM nation")
def registry_reopened(spark, sf_dir):
    """Both versions of a table that was put twice, read from another session; a plan made before the second stays with the first."""
    root = Scratch(spark, "registry").root
    tables = registry.StoredRegistry(spark, root)
    tables.put("survey file.csv", table(spark, sf_dir, "region").selectExpr("cast(r_regionkey as long) key", "r_name name"))
    before = tables.get("survey file.csv").withColumn("version", F.lit(1).cast("long"))
    tables.put("survey file.csv", table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as long) key", "n_name name"), "mapped", after=1)
    again = registry.StoredRegistry(spark.newSession(), root)
    latest = spark.read.parquet(*again.get("survey file.csv").inputFiles()).withColumn("version", F.lit(again.versions["survey file.csv"]).cast("long"))
    return before.unionByName(latest).select("version", "key", "name")


@query(
    """SELECT 'events' AS name, CAST(1 AS BIGINT) AS version, CAST(count(*) AS BIGINT) AS rows, 'events version 1: loaded' AS message FROM events
    UNION ALL SELECT 'events', 2, count(*), 'events version 2: cleaned' FROM events WHERE value >= 5 UNION ALL SELECT NULL, NULL, NULL, 'done'"""
)
def registry_stored_log(spark, sf_dir):
    """The log of a registry, whose row counts come from the jobs that write the tables."""
    tables = registry.StoredRegistry(spark, Scratch(spark, "registry").root)
    tables.put("events", table(spark, sf_dir, "events"))
    tables.put("events", clean.apply_rules(tables.get("events"), clean.Rules((clean.Range("value", 5),)), clean.Observed())[0], "cleaned")
    tables.note("done")
    return tables.log().drop("at")


@query(
    " UNION ALL ".join(
        f"""(SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS value FROM {{t}} WHERE NOT ({_band(c, '{t}')}) ORDER BY md5('7|{c}|' || event_id) LIMIT 50)""".replace("{t}", "wide") for c in ("value", "squared")
    ).join(("WITH wide AS (SELECT event_id, value, value * value AS squared FROM events) SELECT * FROM (", ")"))
)
def chart_outlier_points(spark, sf_dir):
    """Of each column the 50 values outside its fences with the least hashes, in one job."""
    wide = table(spark, sf_dir, "events").select("event_id", "value", (F.col("value") * F.col("value")).alias("squared"))
    return charts.outlier_points(wide, ["value", "squared"], by=["event_id"], most=50, seed=7)


def _wide_column(i: int) -> str:
    """An expression of both engines: column i equals column i % 37, but for some that differ in one row."""
    plain = f"c_acctbal * {i % 37}" if i % 37 < 30 else f"c_acctbal + {i % 37}"
    return f"CASE WHEN c_custkey = 7 THEN -1.5 ELSE {plain} END" if i % 50 == 49 else plain


WIDE = 200


@query(
    "WITH wide AS (SELECT c_custkey, " + ", ".join(f"CAST({_wide_column(i)} AS DOUBLE) AS x{i}" for i in range(WIDE)) + " FROM customer), "
    "cells AS (UNPIVOT wide ON COLUMNS(* EXCLUDE c_custkey) INTO NAME name VALUE v), held AS (SELECT name, list(v ORDER BY c_custkey) AS vs FROM cells GROUP BY name) "
    "SELECT a.name || ' == ' || b.name AS pair FROM held a JOIN held b ON a.vs = b.vs AND CAST(substr(a.name, 2) AS INT) < CAST(substr(b.name, 2) AS INT)"
)
def profile_duplicate_columns_wide(spark, sf_dir):
    """200 columns in classes of some five."""
    columns = [F.expr(_wide_column(i)).cast("double").alias(f"x{i}") for i in range(WIDE)]
    return profile.duplicate_columns(table(spark, sf_dir, "customer").select(*columns))


@query(
    """WITH b AS (SELECT min(p_size) AS lo, max(p_size) AS hi, count(p_size) AS n, quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) AS iqr FROM part),
    k AS (SELECT *, CAST(ceil((hi - lo) / greatest(1, least(greatest(2 * iqr * pow(n, -1.0 / 3), (hi - lo) / (2 * sqrt(n))), (hi - lo) / (log2(n) + 1)))) AS INT) AS bins FROM b),
    w AS (SELECT *, (hi - lo) / bins AS width FROM k),
    c AS (SELECT least(CAST(floor((p_size - lo) / width) AS INT), bins - 1) + 1 AS bin, count(*) AS n FROM part, w GROUP BY ALL)
    SELECT CAST(k AS INT) AS bin, round_even(lo + (k - 1) * width, 6) AS low, round_even(lo + k * width, 6) AS high, CAST(coalesce(c.n, 0) AS BIGINT) AS count
    FROM (SELECT w.*, unnest(range(1, bins + 1)) AS k FROM w) LEFT JOIN c ON c.bin = k"""
)
def chart_histogram_whole(spark, sf_dir):
    """Automatic bins of whole numbers are at least one wide."""
    return rounded(charts.histogram(table(spark, sf_dir, "part"), "p_size"), "low", "high", digits=6)


@query(
    f"""WITH b AS ({_box_sql('l_extendedprice')} UNION ALL {_box_sql('l_tax')}), h AS (SELECT count(l_extendedprice) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT 'box' AS part, "column" AS name, round_even(q1, 4) AS low, round_even(q3, 4) AS high, outliers AS n FROM b
    UNION ALL SELECT 'histogram', 'l_extendedprice', round_even(lo, 4), round_even(hi, 4), CAST(n AS BIGINT) FROM h
    UNION ALL SELECT 'points', "column", NULL, NULL, least(outliers, 200) FROM b WHERE outliers > 0
    UNION ALL SELECT 'summary', 'lineitem', NULL, NULL, CAST(2 AS BIGINT)"""
)
def report_visuals(spark, sf_dir):
    """What one call gives for the charts of a report: histogram, box statistics, outlier points and summary."""
    tables = registry.Registry()
    tables.put("lineitem", table(spark, sf_dir, "lineitem"))
    found = report.visuals(report.analyse(tables, "lineitem", ["l_extendedprice", "l_tax"], "l_quantity"))
    told = len(re.findall("the weighted mean is", found["summary"]))
    rows = rounded(found["box"].selectExpr("'box' part", "column name", "q1 low", "q3 high", "outliers n"), "low", "high")
    bins = found["histogram"].agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("count").alias("n"))
    rows = rows.unionByName(rounded(bins.selectExpr("'histogram' part", "'l_extendedprice' name", "low", "high", "n"), "low", "high"))
    rows = rows.unionByName(found["points"].groupBy("column").agg(F.count("*").alias("n")).selectExpr("'points' part", "column name", "cast(null as double) low", "cast(null as double) high", "n"))
    return rows.unionByName(spark.createDataFrame([("summary", "lineitem", None, None, told)], rows.schema))


@query(
    """SELECT event_id, CASE WHEN event_id % 7 > 2 THEN event_id END AS holed, CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS mixed,
    CASE WHEN event_id % 3 = 0 THEN event_id + 0.5 ELSE event_id END AS fraction, CAST(NULL AS DOUBLE) AS nothing, event_id % 2 = 0 AS flag FROM events"""
)
def csv_missing_and_mixed(spark, sf_dir):
    """Cells that mean a missing value, and columns whose type follows from all of their cells."""
    path, i = Scratch(spark, "mixed").path("csv"), F.col("event_id")
    text = i.cast("string")
    df = table(spark, sf_dir, "events").select(
        "event_id", F.when(i % 7 == 0, "NA").when(i % 7 == 1, "n/a").when(i % 7 == 2, "#N/A").otherwise(text).alias("holed"), F.when(i % 5 == 0, "x").otherwise(text).alias("mixed"),
        F.when(i % 3 == 0, F.concat(text, F.lit(".5"))).otherwise(text).alias("fraction"), F.when(i % 2 == 0, "nan").alias("nothing"), F.when(i % 2 == 0, "True").otherwise("False").alias("flag"),
    )
    sinks.write_csv(df, path)
    return readers.read_csv(spark, path)


@query(
    f"""WITH {PLANTED}, p AS (SELECT value, user_id, event_type FROM planted)
    SELECT 'row_count' AS name, CAST(count(*) AS BIGINT) AS n FROM p UNION ALL SELECT 'col_count', 3
    UNION ALL SELECT 'missing_count', CAST(sum((value IS NULL)::INT + (user_id IS NULL)::INT + (event_type IS NULL)::INT) AS BIGINT) FROM p
    UNION ALL SELECT 'duplicate_rows', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM p GROUP BY value, user_id, event_type HAVING count(*) > 1)
    UNION ALL SELECT 'numeric ' || c, 1 FROM (VALUES ('value'), ('user_id')) AS t(c) UNION ALL SELECT 'header ' || c, 1 FROM (VALUES ('value'), ('user_id'), ('event_type')) AS t(c)"""
)
def profile_response(spark, sf_dir):
    """The upload profile as one document."""
    told = profile.profile(planted(spark, sf_dir).drop("event_id"), "events.csv")
    rows = [(k, told[k]) for k in ("row_count", "col_count", "missing_count", "duplicate_rows")]
    rows += [(f"numeric {c}", 1) for c in told["numeric_columns"]] + [(f"header {c}", 1) for c in told["headers"]] + [(f"equal {c}", 1) for c in told["duplicate_cols"]]
    return spark.createDataFrame(rows, "name string, n long")
