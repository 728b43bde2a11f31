"""Stored summaries: within their bounds, and merged ones as good as those of all rows."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from millrace import queries
from millrace.operators import sketches


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(200_000).select((F.col("id") % 30).cast("int").alias("day"), F.pmod(F.xxhash64("id"), F.lit(50_000)).alias("user"), (F.pmod(F.hash("id"), F.lit(10_000)) / 7).alias("value"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).cast("int").alias("n"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), F.pmod(F.hash("id"), F.lit(300)))).alias("word"))
    return df.unionByName(df.limit(5).select(F.col("day"), *[F.lit(None).cast(t).alias(c) for c, t in df.dtypes[1:]])).persist()


def test_merged_days(spark, rows, tmp_path):
    """Days are stored, read and merged: in pairs, then all; estimates keep their bounds."""
    sketches.states(rows, ["day"], ["user", "word"], ["value", "n"], ["word"]).write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    assert days.count() == 30
    kinds = {"n": "bigint"}
    pairs = sketches.merged(days.withColumn("pair", F.floor(F.col("day") / 2)), ["pair"], kinds)
    whole, at_once = sketches.merged(pairs, [], kinds), sketches.states(rows, [], ["user", "word"], ["value", "n"], ["word"])
    shown = lambda df: df.select("rows", *[sketches.distinct_count(f"distinct_{c}").alias(c) for c in ("user", "word")], *[sketches.quantile("quantiles_value", q).alias(f"q{int(100 * q)}") for q in (0.01, 0.5, 0.99)], sketches.quantile("quantiles_n", 0.5, "bigint").alias("n"), sketches.frequent_items("frequent_word", 3).alias("top")).first()
    a, b = shown(whole), shown(at_once)
    users = rows.select("user").where("user IS NOT NULL").distinct().count()
    assert a["rows"] == b["rows"] == 200_005
    assert abs(a.user - users) <= 4 * 1.04 / math.sqrt(2**sketches.DISTINCT) * users and a.user == b.user and abs(a.word - 301) <= 10
    values = sorted(r.value for r in rows.select("value").where("value IS NOT NULL").collect())
    for got in (a, b):
        for q in (1, 50, 99):
            low, high = (values[max(0, min(len(values) - 1, round(len(values) * (q / 100 + d))))] for d in (-0.0265, 0.0265))
            assert low <= got[f"q{q}"] <= high
        assert abs(got.n - 500) <= 30
        counts = collections.Counter(r.word for r in rows.select("word").collect())
        assert got.top[0]["item"] == "hot" and all(abs(counts[t["item"]] - t["count"]) <= 200_005 / sketches.ITEMS for t in got.top)


def test_states_of_nothing(spark, rows):
    none = sketches.states(rows.where("user IS NULL"), ["day"], ["user"], ["value"])
    assert none.count() == 5 and none.select(sketches.distinct_count("distinct_user").alias("d"), sketches.quantile("quantiles_value", 0.5).alias("q")).distinct().collect() == [(0, None)]
    assert sketches.merged(none.limit(0), ["day"]).count() == 0
    with pytest.raises(ValueError):
        sketches.states(rows, ["day"], numbers=["word"])


def test_where_no_item_stands_out(spark, tmp_path):
    """More users than a sketch tracks, none frequent: counts told and not told keep the bound, and the query says so."""
    n, users = 480_000, 120_000
    df = spark.range(n).select(F.timestamp_seconds(F.col("id") % 4 * 86_400).cast("timestamp_ntz").alias("ts"), F.pmod(F.xxhash64("id"), F.lit(users)).alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") % 1000).cast("double").alias("value"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    assert queries.merged_sketches(spark, str(tmp_path)).collect() == [("view", n, True, True, True)]
    days = sketches.states(df.withColumn("day", F.to_date("ts")), ["day"], frequent=["user_id"])
    told = {t["item"]: t["count"] for t in sketches.merged(days, []).select(sketches.frequent_items("frequent_user_id", sketches.TRACKED).alias("t")).first().t}
    exact = {r.user_id: r["count"] for r in df.groupBy("user_id").count().collect()}
    assert all(abs(k - told.get(u, 0)) <= n / sketches.ITEMS for u, k in exact.items())
