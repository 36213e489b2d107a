import pytest
from fixtures import FOO_SCHEMA, FOOFILE_CSV, FOOFILE_JSON, SUBOBJ1, WIDGETS, rows_as_json, write
from pyspark.sql import functions as F

from skein.operators import joins, maintain, mutate, pattern
from skein.plans.transfer import transfer
from skein.sources.files import scan_csv, scan_json


@pytest.fixture()
def foo(spark, tmp):
    return scan_csv(spark, write(tmp, "foofile.csv", FOOFILE_CSV), engram=FOO_SCHEMA)


def test_transform_filter_mutate(spark, tmp):
    p = write(tmp, "foofile.csv", FOOFILE_CSV)
    out = transfer(spark, {"smt": f"csv|{tmp}|foofile.csv|*", "options": {"encoding": FOO_SCHEMA, "hasHeader": True}}, [
        {"transform": "filter", "match": {"Bar": "row"}, "drop": {"Baz": 456}},
        {"transform": "mutate", "default": {"fie": "where's fum?"},
         "map": {"foo": "=Foo", "bar": "=Bar", "baz": "=Baz", "fobe": "=Fobe", "dt_test": "=Dt Test"},
         "remove": ["fobe"], "assign": {"state": "unknown"}},
    ])
    assert p
    assert out.columns == ["fie", "foo", "bar", "baz", "dt_test", "state"]
    assert rows_as_json(out) == [{"fie": "where's fum?", "foo": "first", "bar": "row", "baz": 123,
                                  "dt_test": "2018-10-07T00:00:00.000Z", "state": "unknown"}]


def test_drop_is_null_safe(spark):
    df = spark.createDataFrame([(1, 456), (2, None), (3, 5)], "id int, Baz int")
    assert sorted(r.id for r in pattern.drop(df, {"Baz": 456}).collect()) == [2, 3]
    assert [r.id for r in pattern.match(df, {"Baz": {"gt": 100}}).collect()] == [1]


def test_range_and_wildcard(foo):
    assert sorted(r.Foo for r in pattern.match(foo, {"Baz": {"gt": 400, "lt": 800}}).collect()) == ["second", "third"]
    assert sorted(r.Foo for r in pattern.match(foo, {"Foo": {"wc": "*th"}}).collect()) == \
        ["eighth", "fifth", "fourth", "seventh", "sixth"]
    assert pattern.match(foo, "*").count() == 8


def test_fulltext_search(foo):
    got = [r.Foo for r in pattern.match(foo, {"Bar": {"search": "row boat"}}).orderBy("Baz").collect()]
    assert sorted(got) == ["first", "fourth", "second", "third"]


def test_multifield_search(foo):
    got = pattern.match(foo, {"_": {"search": "first row boat", "fields": ["Foo", "Bar"]}})
    assert sorted(r.Foo for r in got.collect()) == ["first", "fourth", "second", "third"]


def test_order_desc_and_topk(foo):
    got = [r.Foo for r in pattern.top(foo, {"Baz": "desc"}, 3).collect()]
    assert got == ["seventh", "third", "second"]
    got = [r.Foo for r in pattern.order_by(foo, {"Foo": "asc"}).collect()]
    assert got == sorted(got)


def test_list_membership(spark):
    df = spark.createDataFrame([(1, ["foo", "bar"]), (2, ["baz"]), (3, None)], "id int, tags array<string>")
    assert [r.id for r in pattern.match(df, {"tags": "bar"}).collect()] == [1]
    assert [r.id for r in pattern.match(df, {"tags": {"neq": "bar"}}).collect()] == [2]
    assert sorted(r.id for r in pattern.match(df, {"tags": ["baz", "foo"]}).collect()) == [1, 2]


def test_dull_nested_path(spark, tmp):
    rows = [dict(r, subObj1=SUBOBJ1[r["Foo"]]) for r in FOOFILE_JSON]
    df = scan_json(spark, write(tmp, "foofile_01.json", rows))
    assert maintain.dull_count(df, {"subObj1.state": "running"}).first()["deleted"] == 4
    kept = sorted(r.Foo for r in maintain.dull(df, {"subObj1.state": "running"}).collect())
    assert kept == sorted(["second", "third", "fifth", "sixth"])
    ex = pattern.match(df, {"subObj1.ex-state": "down"})
    assert [r.Foo for r in ex.collect()] == ["fifth"]


def test_adjoin_injects_lookup_fields(spark, tmp, foo):
    widgets = scan_json(spark, write(tmp, "foo_widgets.json", WIDGETS), engram={"fields": [
        {"name": "Foo", "type": "keyword"}, {"name": "Baz", "type": "integer"},
        {"name": "tags", "type": "list", "_list": {"type": "keyword"}},
        {"name": "widgets", "type": "list", "_list": {"type": "map", "fields": [
            {"name": "part", "type": "keyword"}, {"name": "count", "type": "integer"}]}}]})
    out = joins.adjoin(foo, widgets, lookup={"Baz": "=Baz", "Foo": "=Foo"}, inject=["tags", "widgets"])
    assert out.count() == 8
    rows = {r["Foo"]: r for r in rows_as_json(out)}
    assert rows["first"]["tags"] == ["fun", "fast"]
    assert rows["first"]["widgets"] == [{"part": "core", "count": 12}, {"part": "screw", "count": 9}]
    assert "tags" not in rows["seventh"] and rows["seventh"]["widgets"][0] == {"part": "gear", "count": 12}
    assert "widgets" not in rows["sixth"]


def test_adjoin_keeps_row_count_with_duplicate_lookups(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    out = joins.adjoin(left, right, {"k": "=k"}, ["v"], prefix="r_")
    assert sorted((r.k, r.r_v) for r in out.collect() if r.k is not None) == [(1, "a"), (2, "c")]
    assert out.count() == 3


def test_adjoin_name_collision_raises(spark):
    left = spark.createDataFrame([(1, "x")], "k int, v string")
    right = spark.createDataFrame([(1, "y")], "k int, v string")
    with pytest.raises(ValueError):
        joins.adjoin(left, right, {"k": "=k"}, ["v"])


def test_conjoin_parent_first_inner(spark):
    parent = spark.createDataFrame([("TOP", 31), ("LSX", 1)], "cwa string, gridX int")
    child = spark.createDataFrame([("TOP", 1, "Today"), ("TOP", 2, "Tonight")], "cwa string, number int, name string")
    out = joins.conjoin(parent, child, on={"cwa": "=cwa"})
    assert out.columns == ["cwa", "gridX", "number", "name"]
    assert sorted(r.number for r in out.collect()) == [1, 2]


def test_mutate_default_expression_and_nested_assign(spark, tmp):
    rows = [{"type": "Feature", "properties": {"FID": 1}, "geometry": {"type": "Polygon"}}]
    df = scan_json(spark, write(tmp, "f.json", rows))
    out = mutate.mutate(df, default={"id": "=geometry.type+properties.FID"})
    assert out.columns[0] == "id" and out.first()["id"] == "Polygon1"
    out = mutate.mutate(df, assign={"properties.STATEFP": "19"})
    assert out.first()["properties"]["STATEFP"] == "19"


def test_rename_flatten_compose(spark):
    df = spark.createDataFrame([(("on", 3), "x")], "State struct<Enabled:string,n:int>, Name string")
    r = mutate.rename(df, {"State.Enabled": "enabled", "Name": "info.name"})
    assert r.columns == ["enabled", "info"] and r.first()["info"]["name"] == "x"
    f = mutate.flatten(df)
    assert f.columns == ["State_Enabled", "State_n", "Name"]
    c = mutate.compose(f)
    assert c.first()["State"]["n"] == 3


def test_regex_first_match_and_template(spark):
    from skein.functions.expr import compile_value

    df = spark.createDataFrame([("State Senate District 01", "TOP", 31, 80)], "d string, cwa string, x int, y int")
    got = df.select(compile_value(["d", "State Senate District (..)", "0$1"], df).alias("a"),
                    compile_value("https://x/${cwa}/${x},${y}/", df).alias("b"),
                    compile_value("!cwa+':'+x", df).alias("c")).first()
    assert (got.a, got.b, got.c) == ("001", "https://x/TOP/31,80/", "TOP:31")


def test_upsert_source_wins_and_versions(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int")
    s = spark.createDataFrame([(2, "B", 0), (3, "c", 1)], "k int, v string, ver int")
    assert sorted(tuple(r) for r in maintain.upsert(t, s, ["k"]).collect()) == [(1, "a", 1), (2, "B", 0), (3, "c", 1)]
    assert sorted(tuple(r) for r in maintain.upsert(t, s, ["k"], order=["ver"]).collect()) == \
        [(1, "a", 1), (2, "b", 1), (3, "c", 1)]


def test_sync_increment_empty_destination(spark):
    src = spark.createDataFrame([(1,), (5,)], "t int")
    dst = spark.createDataFrame([], "t int")
    assert maintain.sync_increment(src, dst, "t").count() == 2
    dst = spark.createDataFrame([(3,)], "t int")
    assert [r.t for r in maintain.sync_increment(src, dst, "t").collect()] == [5]


def test_compare_bag_difference(spark):
    from skein.operators.setops import compare, compare_counts

    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(tuple(r) for r in compare(a, b).collect()) == [(1, "expected_only"), (2, "expected_only"),
                                                                 (3, "actual_only")]
    assert sorted(tuple(r) for r in compare_counts(a, b).collect()) == [(1, 2, 1), (2, 1, 0), (3, 0, 1)]


def test_aggregate(spark):
    from skein.operators.aggregate import aggregate, with_metrics

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "category string, cost double")
    got = {r.category: (r.n, r.total, r.mx) for r in aggregate(df, ["category"], {
        "n": ("count", "*"), "total": ("sum", "cost"), "mx": ("max", "cost")}).collect()}
    assert got == {"a": (2, 4.0, 3.0), "b": (1, 2.0, 2.0)}
    observed, obs = with_metrics(df)
    observed.write.format("noop").mode("overwrite").save()
    assert obs.get["count"] == 3


def test_compare_files_with_pick(spark, tmp):
    import json as _json

    from skein.operators.setops import compare_files

    write(tmp, "exp.json", _json.dumps({"results": [{"id": 1}, {"id": 2}]}))
    write(tmp, "act.json", _json.dumps({"results": [{"id": 2}, {"id": 3}]}))
    got = compare_files(spark, tmp + "/exp.json", tmp + "/act.json", pick="results", options={"multiLine": True})
    assert sorted(tuple(r) for r in got.collect()) == [(1, "expected_only"), (3, "actual_only")]


def test_size_shuffles(spark):
    from skein.session import size_shuffles

    n = size_shuffles(spark, 100 * (1 << 40))
    assert n == 409600
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "409600"
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def test_replicate_small_and_nested_paths(spark):
    from skein.operators.setops import replicate

    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 3), ("d", 4096), ("e", 4096 * 5 + 17)], "k string, n long")
    got = {r.k: r.c for r in replicate(df, "n").groupBy("k").agg(F.count("*").alias("c")).collect()}
    assert got == {"b": 1, "c": 3, "d": 4096, "e": 4096 * 5 + 17}
