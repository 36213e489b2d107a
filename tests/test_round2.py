"""Replacing stored data, join plans, several sub-fibers, geometry kinds and other repaired behaviour."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from skein.operators import joins, maintain, mutate, pattern, setops
from skein.plans.engram import normalize_fields
from skein.plans.transfer import run_fiber, transfer
from skein.sinks.files import dull_path, upsert_path
from skein.sources.files import scan_csv, scan_geojson, scan_json
from skein.storage import dataset_exists


def test_unreadable_target_is_left_alone(spark, tmp):
    path = tmp + "/store"
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1).write.parquet(path)
    part = glob.glob(path + "/part-*.parquet")[0]
    whole = open(part, "rb").read()
    with open(part, "wb") as f:
        f.write(whole[:-20])
    for crc in glob.glob(path + "/.*.crc"):
        os.remove(crc)
    with pytest.raises(Exception):
        upsert_path(spark.createDataFrame([(1, "z")], "k int, v string"), path, ["k"])
    assert open(part, "rb").read() == whole[:-20]
    assert [f for f in os.listdir(tmp) if f.startswith("store__")] == []


def test_version_set_aside_is_put_back(spark, tmp):
    path = tmp + "/store"
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(path)
    os.rename(path, tmp + "/store__old-deadbeef")  # a job died between the two renames
    assert dataset_exists(spark, path)
    upsert_path(spark.createDataFrame([(2, "b")], "k int, v string"), path, ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2]
    assert dull_path(spark, path, {"k": 1}) == 1 and spark.read.parquet(path).count() == 1


@pytest.mark.parametrize("model", ["json", "csv", "parquet", "table"])
def test_keyed_terminals(spark, tmp, model):
    name = f"keyed_{model}_{os.path.basename(tmp)}".replace("-", "_")
    terminal = {"smt": {"model": model, "locus": "" if model == "table" else tmp, "schema": name, "key": "=Foo"}, "options": {"addHeader": True}}
    for rows in ([("a", 1), ("b", 2)], [("b", 3)], [("c", 4), ("c", 4)]):
        transfer(spark, spark.createDataFrame(rows, "Foo string, Baz bigint"), [], terminal)
    got = spark.table(name) if model == "table" else scan_csv(spark, f"{tmp}/{name}") if model == "csv" else getattr(spark.read, model)(f"{tmp}/{name}")
    assert sorted((r.Foo, int(r.Baz)) for r in got.collect()) == [("a", 1), ("b", 3), ("c", 4)]


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    q = df._jdf.queryExecution()
    df.collect()
    return q.executedPlan().toString()


def test_small_lookup_is_broadcast_without_shuffling_the_driving_side(spark):
    left = spark.range(200_000).select((F.col("id") % 500).alias("k"), "id")
    look = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"), F.lit("y").alias("y"))
    plan = final_plan(joins.adjoin(left, look, {"k": "=k"}, ["x", "y"]))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan.split("BroadcastHashJoin")[0]


def test_hot_key_is_split(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        left = spark.range(0, 300_000, 1, 8).select(F.when(F.col("id") % 10 < 9, 7).otherwise(F.col("id") % 5000).alias("k"), "id", F.md5(F.col("id").cast("string")).alias("pad"))
        look = spark.range(5000).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("x"), (F.col("id") * 2).alias("y"))
        out = joins.adjoin(left, look, {"k": "=k"}, ["x", "y"])
        assert "skew=true" in final_plan(out) and out.count() == 300_000
    finally:
        for k in small:
            spark.conf.set(k, keep[k]) if k in keep else spark.conf.unset(k)


def test_adjoin_orders_nulls_and_maps(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    look = spark.createDataFrame([(1, None, "none", {"a": 1}), (1, 5, "five", {"b": 2}), (1, 9, "nine", {}), (2, None, "only", None)], "k int, o int, v string, m map<string,int>")
    up = {r.k: (r.v, r.m) for r in joins.adjoin(left, look, {"k": "=k"}, ["v", "m"], order=["o"]).collect()}
    down = {r.k: r.v for r in joins.adjoin(left, look, {"k": "=k"}, ["v", "m"], order={"o": "desc"}).collect()}
    assert up == {1: ("five", {"b": 2}), 2: ("only", None), None: (None, None)} and down == {1: "nine", 2: "only", None: None}
    by_text = {r.k: r.v for r in joins.adjoin(left, look, {"k": "=k"}, ["v"], order={"v": "desc"}).collect()}
    assert by_text[1] == "none"
    words = spark.createDataFrame([("1",), ("abc",)], "k string")
    assert {r.k: r.v for r in joins.adjoin(words, look, {"k": "=k"}, ["v"], order=["o"]).collect()} == {"1": "five", "abc": None}


def test_versioned_upsert_and_map_columns(spark):
    t = spark.createDataFrame([(1, 5, {"a": 1}), (2, 1, None), (None, 0, None)], "k int, v int, m map<string,int>")
    s = spark.createDataFrame([(1, 3, {"b": 1}), (2, 1, {"c": 1}), (3, 1, None)], "k int, v int, m map<string,int>")
    got = {r.k: (r.v, r.m) for r in maintain.upsert(t, s, ["k"], order=["v"]).collect()}
    assert got == {1: (5, {"a": 1}), 2: (1, {"c": 1}), 3: (1, None), None: (0, None)}


def test_replicate_spreads_one_row(spark):
    one = spark.createDataFrame([("x", 1_000_000), ("y", 2), ("z", 0)], "v string, n bigint")
    out = setops.replicate(one, "n")
    placed = out.withColumn("p", F.spark_partition_id())
    by = {r.v: (r.n, r.parts) for r in placed.groupBy("v").agg(F.count("*").alias("n"), F.count_distinct("p").alias("parts")).collect()}
    assert by["x"][0] == 1_000_000 and by["x"][1] > 1 and by["y"] == (2, 1) and "z" not in by


def test_compose_conflict_and_edges(spark):
    with pytest.raises(ValueError):
        mutate.compose(spark.createDataFrame([(1, 2)], "a int, a_b int"))
    assert mutate.compose(spark.createDataFrame([(1, 2, 3)], "_id int, a_b int, c_ int")).columns == ["_id", "a", "c_"]


def test_scan_with_two_fibers(spark, tmp):
    for name, rows in (("one", [1, 2]), ("two", [3])):
        with open(f"{tmp}/{name}.json", "w") as f:
            f.write("\n".join(json.dumps({"n": r}) for r in rows))
    fiber = {"action": "scan", "origin": {"smt": f"json|{tmp}|*.json|*"}, "fibers": [
        {"transforms": [{"transform": "filter", "match": {"n": {"gte": 2}}}], "terminal": {"smt": f"parquet|{tmp}/out|big|*"}},
        {"transforms": [{"transform": "mutate", "map": {"schema": "=schema", "n": "=n"}}], "terminal": {"smt": {"model": "json", "locus": tmp + "/each", "schema": "${schema}.json"}}}]}
    run_fiber(spark, fiber)
    assert sorted(int(r.n) for r in spark.read.parquet(f"{tmp}/out/big").collect()) == [2, 3]
    assert sorted(os.listdir(f"{tmp}/each"))[-2:] == ["schema=one", "schema=two"]


def test_foreach_with_two_fibers(spark):
    data = {"left": spark.createDataFrame([(1,), (2,)], "n int")}
    driver = spark.createDataFrame([("left", 1), ("left", 2)], "ds string, at int")
    fiber = {"action": "foreach", "origin": "driver", "fibers": [
        {"origin": "${ds}", "transforms": [{"transform": "filter", "match": {"n": "=${at}"}}]},
        {"origin": "${ds}", "transforms": [{"transform": "filter", "match": {"n": "=${at}"}}, {"transform": "mutate", "assign": {"n": 10}}]}]}
    got = run_fiber(spark, fiber, {"driver": driver, **data})
    assert sorted(r.n for r in got.collect()) == [1, 2, 10, 10]


def test_schema_action_and_primed_codify(spark, tmp):
    name = "schema_action_" + os.path.basename(tmp).replace("-", "_")
    enc = {"fields": [{"name": "a", "type": "integer"}]}
    spec = {"action": "schema", "origin": {"smt": f"table||{name}|*", "options": {"encoding": enc}}}
    assert run_fiber(spark, spec | {"method": "create"})["status"] == 0 and run_fiber(spark, spec | {"method": "create"})["status"] == 409
    assert run_fiber(spark, spec)["data"]["fields"][0]["name"] == "a" and run_fiber(spark, spec | {"method": "dull"})["status"] == 0
    src = spark.createDataFrame([("1", "x")], "a string, b string")
    out = run_fiber(spark, {"action": "codify", "origin": {"smt": "src", "options": {"encoding": {"fields": [{"name": "a", "type": "integer", "label": "A"}]}}},
                            "terminal": {"smt": f"json|{tmp}|enc.json|*"}}, {"src": src})
    assert out["fields"][0]["label"] == "A" and [f["name"] for f in out["fields"]] == ["a", "b"]
    assert json.loads(spark.read.text(f"{tmp}/enc.json").first().value) == out


def test_points_and_lines(spark, tmp):
    shapes = [("Point", [1, 2]), ("LineString", [[0, 0], [4, 4]]), ("MultiPoint", [[1, 1]]), ("Polygon", [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]])]
    features = [{"type": "Feature", "properties": {"n": t}, "geometry": {"type": t, "coordinates": c}} for t, c in shapes]
    with open(tmp + "/f.json", "w") as f:
        json.dump({"type": "FeatureCollection", "features": features}, f)
    g = scan_geojson(spark, tmp + "/f.json")
    got = {r.geometry.type: r.geometry.coordinates for r in g.collect()}
    assert got["Point"] == [[[[1.0, 2.0]]]] and got["LineString"] == [[[[0.0, 0.0], [4.0, 4.0]]]] and len(got["Polygon"][0][0]) == 5
    assert [r.geometry.type for r in pattern.match(g, {"geometry": {"contains": [1, 2]}}).collect()] == ["Polygon"]


def test_member_order_over_all_records(spark, tmp):
    with open(tmp + "/a.json", "w") as f:
        f.write("\n".join([json.dumps({"z": 1, "y": 2})] * 300 + [json.dumps({"z": 1, "b": {"k": 1, "a": 2}, "y": 2})]))
    df = scan_json(spark, tmp + "/a.json", lines=True)
    assert df.columns == ["z", "b", "y"] or df.columns == ["z", "y", "b"]
    assert df.schema["b"].dataType.names == ["k", "a"]


def test_long_zero_padded_integers_and_types_only(spark):
    from skein.functions import coerce

    df = spark.createDataFrame([("0" * 30 + "42",), ("-" + "0" * 25 + "7.0",)], "v string")
    assert [r[0] for r in df.select(coerce.to_integer(F.col("v"))).collect()] == [42, -7]
    assert [f["name"] for f in normalize_fields(["integer", "text"])] == ["_c0", "_c1"]


def test_compare_levels(spark, tmp):
    for name, rows in (("a", [{"n": 1, "s": "x"}, {"n": 2, "s": None}]), ("b", [{"n": 9, "s": "y"}, {"n": 2, "s": None}])):
        with open(f"{tmp}/{name}.json", "w") as f:
            json.dump(rows, f)
    fiber = {"action": "compare", "expected": tmp + "/a.json", "output": tmp + "/b.json"}
    assert run_fiber(spark, fiber).count() == 2
    assert run_fiber(spark, fiber | {"compareValues": 1}).count() == 0
    assert run_fiber(spark, fiber | {"compareValues": 0}).count() == 0
