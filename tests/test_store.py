"""The bucketed store: lookups move nothing, appends are whole or nothing, the first row of a key stays."""

import pytest
from pyspark.sql import functions as F

from veilmark.operators import store

KIND = "cache_key string, text string, latency_trustworthy boolean"


def rows(spark, *pairs):
    return spark.createDataFrame([(k, t, True) for k, t in pairs], KIND).repartition(3)


def held(s):
    return sorted((r.cache_key, r.text) for r in s.rows.collect())


def test_first_rows_stay_and_folders_open_again(spark, tmp_path):
    path = str(tmp_path / "a's layer")
    one = store.Store(spark, path, KIND, buckets=4)
    assert held(one) == []
    one.append(rows(spark, ("a", "1"), ("b", "1"), (None, "1")))
    one.append(rows(spark, ("b", "2"), ("c", "2"), ("c", "2")))
    one.append(rows(spark))
    assert held(one) == [("a", "1"), ("b", "1"), ("c", "2")]
    spark.sql(f"DROP TABLE {one.name}")
    assert held(store.Store(spark, path, KIND, buckets=4)) == held(one)


def test_lookups_move_nothing(spark, tmp_path):
    asked = store.Store(spark, str(tmp_path / "asked"), "cache_key string, n bigint", buckets=4)
    asked.append(spark.range(100).select(F.concat(F.lit("k"), "id").alias("cache_key"), F.col("id").alias("n")))
    layers = [store.Store(spark, str(tmp_path / f"layer{i}"), KIND, buckets=4) for i in range(2)]
    for i, layer in enumerate(layers):
        for part in range(2):  # several files a bucket
            layer.append(rows(spark, *((f"k{j}", str(i)) for j in range(part, 60 + 20 * i, 2 + i))))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hit, none = store.lookup(asked, layers), store.missing(asked, layers)
        for df in (hit, none):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        first, second = ({f"k{j}" for p in range(2) for j in range(p, 60 + 20 * i, 2 + i)} for i in range(2))
        assert {(r.cache_key, r.layer, r.text, r.latency_trustworthy) for r in hit.collect()} == {(k, 0, "0", False) for k in first} | {(k, 1, "1", False) for k in second - first}
        assert {r.cache_key for r in none.collect()} == {f"k{j}" for j in range(100)} - first - second
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    with pytest.raises(ValueError, match="buckets"):
        store.lookup(asked, [store.Store(spark, str(tmp_path / "other"), KIND, buckets=8)])


def test_a_failed_append_leaves_nothing(spark, tmp_path):
    one = store.Store(spark, str(tmp_path / "layer"), KIND, buckets=4)
    one.append(rows(spark, ("a", "1")))
    late = F.when(F.col("cache_key") == "k77", F.raise_error(F.lit("lost"))).otherwise(F.col("text"))
    with pytest.raises(Exception, match="lost"):
        one.append(rows(spark, *((f"k{i}", "2") for i in range(200))).withColumn("text", late))
    assert held(one) == [("a", "1")]
    one.append(rows(spark, ("k1", "3")))
    assert held(one) == [("a", "1"), ("k1", "3")]
