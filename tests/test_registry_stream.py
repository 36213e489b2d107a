import json
import os
import time

from fixtures import FOO_SCHEMA, FOOFILE_JSON, write
from pyspark.sql import functions as F

from skein.plans import registry as R
from skein.plans.transfer import register_transform, transfer


def _reg(spark):
    return R.registry_frame(spark, [
        {"realm": "foo", "name": "foo_schema", "type": "engram", "smt": "json|/x|foofile.json|*", "fields": FOO_SCHEMA["fields"]},
        {"realm": "foo", "name": "foo_schema_two", "type": "engram", "smt": "json|/x|two.json|*"},
        {"realm": "foo", "name": "foo_alias", "type": "alias", "source": "foo:foo_schema"},
        {"realm": "foo", "name": "alias_of_alias", "type": "alias", "source": "foo:foo_alias"},
    ])


def test_registry_store_recall_retrieve_dull(spark):
    reg = _reg(spark)
    new = R.registry_frame(spark, [{"realm": "foo", "name": "foo_schema_two", "type": "engram", "description": "v2"},
                                   {"realm": "foo", "name": "bad", "type": "widget"}])
    reg2, rejected = R.registry_store(reg, new)
    assert [r.name for r in rejected.collect()] == ["bad"]
    assert reg2.where(F.col("urn") == "foo:foo_schema_two").first()["description"] == "v2"
    assert reg2.count() == 4
    got = R.registry_retrieve(reg2, {"match": {"name": {"wc": "foo_schema*"}}})
    assert sorted(r.name for r in got.collect()) == ["foo_schema", "foo_schema_two"]
    assert R.registry_dull(reg2, "foo:foo_schema_two").count() == 3


def test_alias_resolves_one_hop(spark):
    reg = _reg(spark)
    one = R.registry_recall(reg, "foo:foo_alias", resolve=True).first()
    assert one["type"] == "engram" and one["name"] == "foo_schema"
    two = R.registry_recall(reg, "foo:alias_of_alias", resolve=True).first()
    assert two["type"] == "alias" and two["source"] == "foo:foo_schema"


def test_open_dataset_by_urn(spark, tmp):
    write(tmp, "foofile.json", FOOFILE_JSON)
    reg = R.registry_frame(spark, [{"realm": "foo", "name": "jsonfile", "type": "engram",
                                    "smt": f"json|{tmp}|foofile.json|*", "fields": FOO_SCHEMA["fields"]}])
    df = R.open_dataset(spark, reg, "foo:jsonfile")
    assert df.schema["Baz"].dataType.simpleString() == "bigint" and df.count() == 8


def test_schema_create_exists_drop(spark):
    spark.sql("DROP TABLE IF EXISTS foo_schema_tbl")
    assert R.schema_create(spark, "foo_schema_tbl", FOO_SCHEMA)["status"] == 0
    assert R.schema_create(spark, "foo_schema_tbl", FOO_SCHEMA)["status"] == 409
    enc = R.schema_encoding(spark, "foo_schema_tbl")["data"]
    assert [f["name"] for f in enc["fields"]] == ["Foo", "Bar", "Baz", "Fobe", "Dt Test", "enabled"]
    assert R.schema_dull(spark, "foo_schema_tbl")["status"] == 0
    assert R.schema_dull(spark, "foo_schema_tbl")["status"] == 404


def test_registered_transform_and_tee(spark, tmp):
    write(tmp, "foofile.json", FOOFILE_JSON)
    register_transform("upper_foo", lambda df, spec, ctx: df.withColumn("Foo", F.upper("Foo")))
    out = transfer(spark, {"smt": f"json|{tmp}|foofile.json|*", "options": {"encoding": FOO_SCHEMA}}, [
        {"transform": "tee", "transforms": [{"transform": "filter", "match": {"Bar": "row"}}],
         "terminal": {"smt": f"json|{tmp}|tee_out|*"}},
        {"transform": "upper_foo"},
    ], terminal=[{"smt": f"parquet|{tmp}|a|*"}, {"smt": f"csv|{tmp}|b|*", "options": {"addHeader": True}}])
    assert spark.read.json(tmp + "/tee_out").count() == 2
    assert sorted(r.Foo for r in spark.read.parquet(tmp + "/a").collect())[0] == "EIGHTH"
    assert out.columns[0] == "Foo"


def test_stream_equals_batch(spark, tmp):
    from skein.streaming.stream import transfer_stream

    os.makedirs(tmp + "/in")
    lines = "\n".join(json.dumps(r) for r in FOOFILE_JSON)
    write(tmp + "/in", "part1.json", lines)
    steps = [{"transform": "filter", "match": {"Bar": "row"}},
             {"transform": "mutate", "map": {"foo": "=Foo", "baz": "=Baz"}}]
    q = transfer_stream(spark, tmp + "/in", steps, tmp + "/out", tmp + "/ckpt", fmt="json", engram=FOO_SCHEMA)
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(tmp + "/out").collect())
    batch = transfer(spark, {"smt": f"jsonl|{tmp}/in|part1.json|*", "options": {"encoding": FOO_SCHEMA}}, steps)
    assert got == sorted(tuple(r) for r in batch.collect()) == [("first", 123), ("second", 456)]
    # a second run with no new files adds nothing (checkpointed)
    q = transfer_stream(spark, tmp + "/in", steps, tmp + "/out", tmp + "/ckpt", fmt="json", engram=FOO_SCHEMA)
    q.awaitTermination(120)
    assert spark.read.parquet(tmp + "/out").count() == 2
    time.sleep(0)


def test_foreach_batch_fanout_is_idempotent(spark, tmp):
    from skein.sinks.files import upsert_path
    from skein.streaming.stream import foreach_batch, read_stream

    os.makedirs(tmp + "/in")
    write(tmp + "/in", "a.json", "\n".join(json.dumps(r) for r in FOOFILE_JSON))
    src = read_stream(spark, tmp + "/in", "json", engram=FOO_SCHEMA)
    seen = []

    def to_store(batch, batch_id):
        upsert_path(batch.select("Foo", "Baz"), tmp + "/store", ["Foo"])

    def to_log(batch, batch_id):
        seen.append((batch_id, batch.count()))

    q = foreach_batch(src, [to_store, to_log], tmp + "/ck")
    q.awaitTermination(120)
    write(tmp + "/in", "b.json", json.dumps({"Foo": "first", "Baz": "999"}))
    q = foreach_batch(src, [to_store, to_log], tmp + "/ck")
    q.awaitTermination(120)
    store = {r.Foo: r.Baz for r in spark.read.parquet(tmp + "/store").collect()}
    assert len(store) == 8 and store["first"] == 999
    assert [n for _, n in seen] == [8, 1]


def test_stream_adjoin_static_lookup(spark, tmp):
    from skein.streaming.stream import transfer_stream

    os.makedirs(tmp + "/in")
    write(tmp + "/in", "p1.json", "\n".join(json.dumps(r) for r in FOOFILE_JSON))
    spark.createDataFrame([("first", "gold"), ("second", "silver")], "Foo string, tier string") \
        .createOrReplaceTempView("tiers")
    steps = [{"transform": "adjoin", "smt": "memory||tiers|*", "lookup": {"Foo": "=Foo"}, "inject": ["tier"]},
             {"transform": "mutate", "select": ["Foo", "tier"]}]
    q = transfer_stream(spark, tmp + "/in", steps, tmp + "/out", tmp + "/ck", fmt="json", engram=FOO_SCHEMA)
    q.awaitTermination(120)
    got = {r.Foo: r.tier for r in spark.read.parquet(tmp + "/out").collect()}
    assert len(got) == 8 and got["first"] == "gold" and got["third"] is None


def test_sync_stream_appends_only_new_files(spark, tmp):
    from skein.streaming.stream import sync_stream

    os.makedirs(tmp + "/src")
    spark.createDataFrame([(1,), (2,)], "x int").write.mode("append").parquet(tmp + "/src")
    sync_stream(spark, tmp + "/src", tmp + "/dst", tmp + "/ck").awaitTermination(120)
    spark.createDataFrame([(3,)], "x int").write.mode("append").parquet(tmp + "/src")
    sync_stream(spark, tmp + "/src", tmp + "/dst", tmp + "/ck").awaitTermination(120)
    assert sorted(r.x for r in spark.read.parquet(tmp + "/dst").collect()) == [1, 2, 3]


def test_read_through_spec_fills_cache_once(spark, tmp):
    write(tmp, "foofile.json", FOOFILE_JSON)
    origin = {"smt": f"parquet|{tmp}|cache|*",
              "source_fiber": {"origin": {"smt": f"json|{tmp}|foofile.json|*", "options": {"encoding": FOO_SCHEMA}},
                               "transforms": [{"transform": "filter", "match": {"Bar": {"search": "row boat"}}}],
                               "terminal": {"smt": f"parquet|{tmp}|cache|*"}}}
    first = transfer(spark, origin)
    assert first.count() == 4 and spark.read.parquet(tmp + "/cache").count() == 4
    second = transfer(spark, origin)
    assert second.count() == 4


def test_codify_option_types_a_text_origin(spark, tmp):
    write(tmp, "f.csv", "a,b\n1,x\n2,y\n")
    out = transfer(spark, {"smt": f"csv|{tmp}|f.csv|*", "options": {"codify": True}})
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["bigint", "string"]


def test_python_data_source_format(spark, tmp):
    from pyspark.sql.datasource import DataSource, DataSourceReader

    from skein.plans.transfer import register_format

    class CountReader(DataSourceReader):
        def __init__(self, options):
            self.n = int(options.get("n", 3))

        def read(self, partition):
            for i in range(self.n):
                yield (i, f"row{i}")

    class CountSource(DataSource):
        @classmethod
        def name(cls):
            return "skein_count_test"

        def schema(self):
            return "i int, label string"

        def reader(self, schema):
            return CountReader(self.options)

    register_format("counter", reader=CountSource, spark=spark)
    out = transfer(spark, {"smt": "counter|x|y|*", "options": {"n": 4}})
    assert sorted(r.i for r in out.collect()) == [0, 1, 2, 3]


def test_adjoin_spec_by_urns(spark, tmp):
    from fixtures import WIDGETS

    write(tmp, "foofile.json", FOOFILE_JSON)
    write(tmp, "foo_widgets.json", WIDGETS)
    widgets_fields = [{"name": "Foo", "type": "keyword"}, {"name": "Baz", "type": "integer"},
                      {"name": "tags", "type": "list", "_list": {"type": "keyword"}},
                      {"name": "widgets", "type": "list", "_list": {"type": "map", "fields": [
                          {"name": "part", "type": "keyword"}, {"name": "count", "type": "integer"}]}}]
    reg = R.registry_frame(spark, [
        {"realm": "foo", "name": "jsonfile_foo_schema", "type": "engram", "smt": f"json|{tmp}|foofile.json|*",
         "fields": FOO_SCHEMA["fields"]},
        {"realm": "foo", "name": "json_widgets", "type": "engram", "smt": f"json|{tmp}|foo_widgets.json|*",
         "fields": widgets_fields}])
    out = transfer(spark, "foo:jsonfile_foo_schema", [
        {"transform": "adjoin", "smt": "foo:json_widgets", "lookup": {"Baz": "=Baz", "Foo": "=Foo"},
         "inject": ["tags", "widgets"]}], registry=reg)
    rows = {r["Foo"]: r for r in out.collect()}
    assert len(rows) == 8 and rows["first"]["tags"] == ["fun", "fast"] and rows["sixth"]["widgets"] is None
    assert rows["seventh"]["widgets"][0]["part"] == "gear"


def test_tee_data_golden_order_and_fanout(spark, tmp):
    import glob

    write(tmp, "foofile.json", FOOFILE_JSON)
    origin = {"smt": f"json|{tmp}|foofile.json|*", "options": {"encoding": FOO_SCHEMA},
              "pattern": {"match": {"Bar": {"search": "row boat"}}, "order": {"Foo": "asc"}}}
    transfer(spark, origin, terminal=[{"smt": f"parquet|{tmp}|foo_cache|*"}, {"smt": f"json|{tmp}|tee_data|*"}])
    rows = [json.loads(line) for p in sorted(glob.glob(tmp + "/tee_data/part-*")) for line in open(p)]
    assert [r["Foo"] for r in rows] == ["first", "fourth", "second", "third"]
    assert rows[1] == {"Foo": "fourth", "Bar": " boat ", "Baz": 0, "Fobe": 4.3,
                       "Dt Test": "2018-10-10T14:13:30.500Z", "enabled": False}
    assert spark.read.parquet(tmp + "/foo_cache").count() == 4


def test_conjoin_spec_with_pick(spark, tmp):
    forecasts = [{"cwa": "TOP", "periods": [{"number": 1, "name": "Today"}, {"number": 2, "name": "Tonight"}]},
                 {"cwa": "LSX", "periods": [{"number": 1, "name": "Today"}]}]
    write(tmp, "forecast.json", forecasts)
    spark.createDataFrame([("TOP", 31), ("DMX", 7)], "cwa string, gridX int").createOrReplaceTempView("points")
    out = transfer(spark, "points", [{"transform": "conjoin", "smt": f"json|{tmp}|forecast.json|*",
                                      "options": {"pick": "periods"}, "on": {"cwa": "=cwa"}}],
                   datasets={"points": spark.table("points")})
    assert out.columns == ["cwa", "gridX", "number", "name"]
    assert sorted((r.cwa, r.number, r.name) for r in out.collect()) == [("TOP", "1", "Today"), ("TOP", "2", "Tonight")]


def test_registry_save_and_load(spark, tmp):
    reg = _reg(spark)
    R.save_registry(reg, tmp + "/registry")
    again = R.load_registry(spark, tmp + "/registry")
    assert sorted(r.urn for r in again.collect()) == sorted(r.urn for r in reg.collect())
    # saving a registry derived from what is stored at the same path goes through staging
    R.save_registry(R.registry_dull(again, "foo:foo_alias"), tmp + "/registry")
    assert R.load_registry(spark, tmp + "/registry").count() == 3
    assert R.load_registry(spark, tmp + "/missing").count() == 0


def test_jdbc_column_types_from_sizes():
    from skein.sources.jdbc import varchar_columns

    assert varchar_columns(FOO_SCHEMA) == "`Foo` VARCHAR(64), `Bar` VARCHAR(256)"


def test_scan_transfer_runs_one_pipeline_per_dataset(spark, tmp):
    import glob as g

    from skein.plans.transfer import scan_transfer

    os.makedirs(tmp + "/many")
    write(tmp + "/many", "one.json", "\n".join(json.dumps(r) for r in FOOFILE_JSON[:4]))
    write(tmp + "/many", "two.json", "\n".join(json.dumps(r) for r in FOOFILE_JSON[4:]))
    write(tmp + "/many", "skip.json", json.dumps(FOOFILE_JSON[0]))
    out = scan_transfer(spark, tmp + "/many", "*.json", exclude=["skip*"],
                        transforms=[{"transform": "filter", "match": {"Bar": {"search": "row boat data"}}}],
                        out_path=tmp + "/split", read_options={"primitivesAsString": True})
    assert sorted((r.schema, r.Foo) for r in out.collect()) == [
        ("one", "first"), ("one", "fourth"), ("one", "second"), ("one", "third"), ("two", "eighth"),
        ("two", "seventh")]
    assert sorted(os.path.basename(p) for p in g.glob(tmp + "/split/schema=*")) == ["schema=one", "schema=two"]


def test_foreach_over_registry_entries(spark, tmp):
    from fixtures import FOOFILE_CSV

    from skein.plans.transfer import foreach

    write(tmp, "foofile.json", FOOFILE_JSON)
    write(tmp, "foofile.csv", FOOFILE_CSV)
    reg = R.registry_frame(spark, [
        {"realm": "foo", "name": "json_foo", "type": "engram", "tags": ["bar"], "smt": f"json|{tmp}|foofile.json|*",
         "fields": FOO_SCHEMA["fields"]},
        {"realm": "foo", "name": "csv_foo", "type": "engram", "tags": ["bar"], "smt": f"csv|{tmp}|foofile.csv|*",
         "fields": FOO_SCHEMA["fields"]},
        {"realm": "foo", "name": "other", "type": "engram", "tags": ["baz"], "smt": f"json|{tmp}|missing.json|*"}])
    driving = R.registry_retrieve(reg, {"match": {"tags": "bar"}})
    fiber = {"origin": {"smt": "=${smt}", "options": {"encoding": {"fields": "=${fields}"}},
                        "pattern": {"match": {"Foo": "second"}}}}
    out = foreach(spark, driving, fiber, terminal={"smt": f"json|{tmp}|foreach_out|*"})
    assert [(r.Foo, r.Baz) for r in out.collect()] == [("second", 456), ("second", 456)]
    assert spark.read.json(tmp + "/foreach_out").count() == 2


def test_run_fiber_actions(spark, tmp):
    from fixtures import FOOFILE_CSV

    from skein.plans.transfer import run_fiber

    write(tmp, "foofile.csv", FOOFILE_CSV)
    out = run_fiber(spark, {"action": "transfer",
                            "origin": {"smt": f"csv|{tmp}|foofile.csv|*", "options": {"encoding": FOO_SCHEMA, "hasHeader": True}},
                            "transforms": [{"transform": "filter", "match": {"Bar": "row"}, "drop": {"Baz": 456}}],
                            "terminal": {"output": "ignored.json"}})
    assert [r.Foo for r in out.collect()] == ["first"]
    eng = run_fiber(spark, {"action": "codify", "name": "codify csv",
                            "origin": {"smt": f"csv|{tmp}|foofile.csv|*", "options": {"hasHeader": True}}})
    assert [f["type"] for f in eng["fields"]] == ["keyword", "text", "integer", "number", "date", "boolean"]
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(tmp + "/ds")
    assert run_fiber(spark, {"action": "dull", "origin": {"smt": f"parquet|{tmp}|ds|*",
                                                          "pattern": {"match": {"v": "a"}}}}) == {"deleted": 1}
    listing = run_fiber(spark, {"action": "list", "origin": {"smt": f"csv|{tmp}|*.csv|*"}})
    assert [r.name for r in listing.collect()] == ["foofile.csv"]


def test_streaming_aggregate_equals_batch(spark, tmp):
    from skein.operators.aggregate import aggregate
    from skein.streaming.stream import foreach_batch, read_stream

    os.makedirs(tmp + "/in")
    rows = [{"category": c, "cost": str(v)} for c, v in [("a", 1), ("b", 2), ("a", 3)]]
    write(tmp + "/in", "p1.json", "\n".join(json.dumps(r) for r in rows))
    eng = {"fields": [{"name": "category", "type": "keyword"}, {"name": "cost", "type": "number"}]}
    spec = {"n": ("count", "*"), "total": ("sum", "cost")}

    def totals_sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(tmp + "/totals")  # complete mode: full current totals

    def run():
        src = read_stream(spark, tmp + "/in", "json", engram=eng)
        foreach_batch(aggregate(src, ["category"], spec), [totals_sink], tmp + "/ck",
                      output_mode="complete").awaitTermination(120)

    run()
    write(tmp + "/in", "p2.json", json.dumps({"category": "b", "cost": "5"}))
    run()
    got = {r.category: (r.n, r.total) for r in spark.read.parquet(tmp + "/totals").collect()}
    assert got == {"a": (2, 4.0), "b": (2, 7.0)}
