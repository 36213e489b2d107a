import glob
import io
import json
import os
import zipfile

from fixtures import FOO_MISSING_CSV, FOO_SCHEMA, FOOFILE_CSV, FOOFILE_JSON, POLYGONS, write
from pyspark.sql import functions as F

from skein.operators.codify import codify, codify_frame, merge_engram, profile
from skein.operators.pattern import match
from skein.plans.engram import from_struct, normalize_fields, to_struct
from skein.sinks.documents import to_documents, write_documents
from skein.sinks.files import tee_write, write_json, write_split
from skein.sources.files import inventory, pick, read_through, scan_csv, scan_geojson, scan_json, scan_many

CODIFY_FOO = [
    {"name": "Foo", "type": "keyword", "size": 7},
    {"name": "Bar", "type": "text", "size": 13},
    {"name": "Baz", "type": "integer"},
    {"name": "Fobe", "type": "number"},
    {"name": "Dt Test", "type": "date"},
    {"name": "enabled", "type": "boolean"},
]


def test_codify_json_csv_and_missing(spark, tmp):
    assert codify(scan_json(spark, write(tmp, "foofile.json", FOOFILE_JSON)))["fields"] == CODIFY_FOO
    assert codify(scan_csv(spark, write(tmp, "foofile.csv", FOOFILE_CSV)))["fields"] == CODIFY_FOO
    assert codify(scan_csv(spark, write(tmp, "foo_missing.csv", FOO_MISSING_CSV)), missing="*")["fields"] == CODIFY_FOO


def test_codify_formats_and_merge(spark, tmp):
    df = scan_json(spark, write(tmp, "foofile.json", FOOFILE_JSON))
    assert codify(df, format="types_only")["fields"] == ["keyword", "text", "integer", "number", "date", "boolean"]
    full = codify(df, format="all")["fields"][0]
    assert set(full) >= {"name", "type", "size", "nullable", "default", "key", "label"}
    a = {"fields": [{"name": "x", "type": "integer"}, {"name": "s", "type": "keyword", "size": 3}]}
    b = {"fields": [{"name": "x", "type": "number"}, {"name": "s", "type": "text", "size": 9}, {"name": "y", "type": "date"}]}
    assert merge_engram(a, b)["fields"] == [{"name": "x", "type": "number"}, {"name": "s", "type": "text", "size": 9},
                                            {"name": "y", "type": "date"}]


def test_codify_nested_lists_one_job(spark):
    df = spark.createDataFrame([(["a", "bb"], [("p", 1)]), (None, [])],
                               "tags array<string>, widgets array<struct<part:string,count:bigint>>")
    rows = {r.field: (r.type, r.size) for r in codify_frame(df).collect()}
    assert rows["tags"] == ("list", None) and rows["tags._list"] == ("keyword", 2)
    assert rows["widgets._list"] == ("map", None) and rows["widgets._list.count"] == ("integer", None)


def test_engram_spellings_roundtrip():
    typesonly = {"fields": {"Foo": {"type": "keyword", "key": 1}, "Bar": "text", "Baz": "integer"}}
    fs = normalize_fields(typesonly["fields"])
    assert [f["name"] for f in fs] == ["Foo", "Bar", "Baz"] and fs[0]["key"] == 1
    st = to_struct(FOO_SCHEMA)
    assert [f.dataType.simpleString() for f in st.fields] == ["string", "string", "bigint", "double", "timestamp", "boolean"]
    back = from_struct(st)
    assert [f["type"] for f in back["fields"]] == ["keyword", "text", "integer", "number", "date", "boolean"]


def test_defaults_fill_missing(spark, tmp):
    eng = {"fields": [{"name": "category", "type": "keyword"}, {"name": "quantity", "type": "integer", "default": 0},
                      {"name": "cost", "type": "number", "default": 0.0}]}
    p = write(tmp, "d.csv", "category,quantity\nA,5\nB,\n")
    got = [tuple(r) for r in scan_csv(spark, p, engram=eng).collect()]
    assert got == [("A", 5, 0.0), ("B", 0, 0.0)]


def test_profile(spark):
    df = spark.createDataFrame([("ab", 1), (None, 22)], "s string, n int")
    got = {r.field: (r.n_rows, r.n_null, r.max_len) for r in profile(df).collect()}
    assert got == {"s": (2, 1, 2), "n": (2, 0, 2)}


def test_template_document(spark, tmp):
    df = scan_json(spark, write(tmp, "foofile.json", FOOFILE_JSON), engram=FOO_SCHEMA)
    from skein.sinks.files import json_ready

    parts = to_documents(json_ready(df), {"name": "${name}", "description": "json template file", "data": []}, "data",
                         params={"name": "template_transfer"})
    write_documents(parts, tmp + "/doc")
    text = "".join(open(p).read() for p in sorted(glob.glob(tmp + "/doc/part-*")))
    doc = json.loads(text)
    assert doc["name"] == "template_transfer" and doc["description"] == "json template file"
    assert len(doc["data"]) == 8 and {r["Foo"] for r in doc["data"]} == {r["Foo"] for r in FOOFILE_JSON}
    assert doc["data"][0]["Dt Test"] in {"2018-10-07T00:00:00.000Z", "2018-10-07T05:00:00.000Z",
                                         "2018-10-18T05:00:00.000Z", "2018-10-10T14:13:30.500Z",
                                         "2018-10-10T19:13:30.000Z", "2018-10-10T05:00:00.000Z", None}


def test_template_document_per_group(spark, tmp):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "g int, v string")
    parts = to_documents(df, {"name": "g-${g}", "rows": []}, "rows", by=["g"])
    write_documents(parts, tmp + "/docs", by=["g"])
    for g, n in ((1, 2), (2, 1)):
        text = "".join(open(p).read() for p in sorted(glob.glob(f"{tmp}/docs/g={g}/part-*")))
        doc = json.loads(text)
        assert doc["name"] == f"g-{g}" and len(doc["rows"]) == n


def test_geojson_scan_and_point_in_polygon(spark, tmp):
    g = scan_geojson(spark, write(tmp, "polygons.json", POLYGONS))
    assert [r["properties"]["FID"] for r in g.collect()] == ["0", "1", "2"]

    def hits(x, y):
        return sorted(r["properties"]["FID"] for r in match(g, {"geometry": {"contains": [x, y]}}).collect())

    assert hits(0.5, 0.5) == ["0", "1"]      # inside the square and the outer ring
    assert hits(2.5, 2.5) == ["2"]           # in the hole of 1, inside a part of the multipolygon
    assert hits(4.5, 4.5) == ["2"]           # second part of the multipolygon
    assert hits(9, 9) == []


def test_inventory_and_scan_many(spark, tmp):
    os.makedirs(tmp + "/d/sub")
    for name, n in (("a.csv", 2), ("b.csv", 3), ("skip.csv", 1), ("sub/c.csv", 1)):
        write(tmp + "/d", name, "x\n" + "".join(f"{i}\n" for i in range(n)))
    inv = inventory(spark, tmp + "/d", "*.csv", recursive=True)
    assert sorted(r.name for r in inv.collect()) == ["a.csv", "b.csv", "c.csv", "skip.csv"]
    many = scan_many(spark, tmp + "/d", "*.csv", exclude=["skip*"], fmt="csv", merge_schema=False,
                     options={"header": True})
    counts = {r.schema: r["count"] for r in many.groupBy("schema").count().collect()}
    assert counts == {"a": 2, "b": 3}


def test_pick_nested_array(spark, tmp):
    doc = {"results": [{"columns": [{"name": "item_id"}], "items": [{"item_id": 1, "enabled": "y"},
                                                                    {"item_id": 2, "enabled": "n"}]}]}
    df = scan_json(spark, write(tmp, "extract.json", [doc]))
    items = pick(df, "results.items")
    assert sorted(r.item_id for r in items.collect()) == ["1", "2"]


def test_read_through_and_tee(spark, tmp):
    empty = spark.createDataFrame([], "x int")
    src = spark.createDataFrame([(1,), (2,)], "x int")
    got = read_through(empty, src, lambda d: d.write.mode("overwrite").parquet(tmp + "/cache"))
    assert got.count() == 2 and spark.read.parquet(tmp + "/cache").count() == 2
    cached = spark.read.parquet(tmp + "/cache")
    assert read_through(cached, src).count() == 2
    tee_write(src, [lambda d: write_json(d, tmp + "/t1"), lambda d: d.write.mode("overwrite").parquet(tmp + "/t2")])
    assert spark.read.json(tmp + "/t1").count() == 2 and spark.read.parquet(tmp + "/t2").count() == 2


def test_split_writer(spark, tmp):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    write_split(df, tmp + "/split", "k")
    assert sorted(os.path.basename(p) for p in glob.glob(tmp + "/split/k=*")) == ["k=a", "k=b"]


def test_archive_members(spark, tmp):
    from skein.sources.archive import archive_lines, scan_archive

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("foofile.csv", FOOFILE_CSV)
        zf.writestr("notes.txt", "x")
    open(tmp + "/foo.zip", "wb").write(buf.getvalue())
    members = scan_archive(spark, tmp, "*.csv")
    assert [r.name for r in members.collect()] == ["foofile.csv"]
    lines = archive_lines(members)
    assert lines.count() == 9
    parsed = lines.where(F.col("line_no") > 0).select(F.from_csv("line", "Foo string, Bar string").alias("r"))
    assert parsed.where(F.col("r.Foo") == "first").count() == 1


def test_dull_and_upsert_on_file_dataset(spark, tmp):
    from skein.sinks.files import dull_path, upsert_path

    path = tmp + "/ds"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string").write.parquet(path)
    assert dull_path(spark, path, {"v": "b"}) == 1
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 3]
    upsert_path(spark.createDataFrame([(3, "C"), (4, "d")], "k int, v string"), path, ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "C"), (4, "d")]


def test_gzip_input_and_catalog_listing(spark, tmp):
    import gzip

    from skein.sources.files import list_catalog_tables

    with gzip.open(tmp + "/foofile.csv.gz", "wt") as fh:
        fh.write(FOOFILE_CSV)
    assert scan_csv(spark, tmp + "/foofile.csv.gz", engram=FOO_SCHEMA).count() == 8
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("foo_listing_view")
    names = [r.name for r in list_catalog_tables(spark, "foo_listing*").collect()]
    assert names == ["foo_listing_view"]


def test_transform_csv_terminal_and_stats(spark, tmp):
    from fixtures import FOO_SCHEMA as ENG

    from skein.plans.transfer import transfer

    write(tmp, "foofile.json", FOOFILE_JSON)
    stats = {}
    transfer(spark, {"smt": f"json|{tmp}|foofile.json|*", "options": {"encoding": ENG}}, [
        {"transform": "filter", "match": {"Bar": "row"}, "drop": {"Baz": 456}},
        {"transform": "mutate", "default": {"fie": "where's fum?"},
         "map": {"foo": "=Foo", "bar": "=Bar", "baz": "=Baz", "fobe": "=Fobe", "dt_test": "=Dt Test"},
         "remove": ["fobe"], "assign": {"state": "unknown"}},
    ], terminal={"smt": f"csv|{tmp}|transform_csv|*", "options": {"addHeader": True}}, stats=stats)
    text = "".join(open(p).read() for p in sorted(glob.glob(tmp + "/transform_csv/part-*")))
    assert text == '"fie","foo","bar","baz","dt_test","state"\n"where\'s fum?","first","row",123,2018-10-07,"unknown"\n'
    assert stats["count"] == 1 and stats["elapsed"] > 0


def test_split_writer_spreads_a_hot_value(spark, tmp):
    df = spark.range(0, 2000).select(F.when(F.col("id") < 1500, "hot").otherwise("cold").alias("k"), "id")
    write_split(df, tmp + "/hot", "k", fmt="parquet")
    # three quarters of the rows: at least half of the tasks, the rare value in few
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(glob.glob(tmp + "/hot/k=hot/part-*")) >= tasks // 2
    assert len(glob.glob(tmp + "/hot/k=cold/part-*")) <= tasks // 2 + 1
    assert spark.read.parquet(tmp + "/hot").count() == 2000


def test_codify_polygons_golden(spark, tmp):
    g = scan_geojson(spark, write(tmp, "polygons.json", POLYGONS), properties={"fields": []})
    got = codify(g)["fields"]
    lst = {"name": "_list", "type": "integer"}
    for _ in range(3):
        lst = {"name": "_list", "type": "list", "_list": lst}
    assert got == [
        {"name": "type", "type": "keyword", "size": 7},
        {"name": "properties", "type": "map", "fields": [{"name": "FID", "type": "integer"}]},
        {"name": "geometry", "type": "map", "fields": [{"name": "type", "type": "keyword", "size": 12},
                                                       {"name": "coordinates", "type": "list", "_list": lst}]},
    ]


def test_json_array_output(spark, tmp):
    p = write(tmp, "foofile.json", FOOFILE_JSON)
    df = scan_json(spark, p, engram=FOO_SCHEMA)
    write_json(df, tmp + "/arr", array=True)
    text = "".join(open(x).read() for x in sorted(glob.glob(tmp + "/arr/part-*")))
    rows = json.loads(text)
    sixth = [r for r in rows if r["Foo"] == "sixth"]
    assert len(rows) == 8 and sixth == [{"Foo": "sixth", "Bar": None, "Baz": None, "Fobe": None,
                                         "Dt Test": None, "enabled": None}]


def test_codify_each_file_in_one_job(spark, tmp):
    from skein.operators.codify import codify_each, merge_engram

    os.makedirs(tmp + "/m")
    write(tmp + "/m", "a.json", '{"x": "1", "y": "alpha"}\n{"x": "2", "y": "beta"}\n')
    write(tmp + "/m", "b.json", '{"x": "2.5", "z": "true"}\n')
    many = scan_many(spark, tmp + "/m", "*.json", fmt="json", merge_schema=False, options={"primitivesAsString": True})
    each = codify_each(many.drop("name", "rpath"), by="schema")
    assert each["a"]["fields"] == [{"name": "x", "type": "integer"}, {"name": "y", "type": "keyword", "size": 5}]
    assert each["b"]["fields"] == [{"name": "x", "type": "number"}, {"name": "z", "type": "boolean"}]
    merged = merge_engram(each["a"], each["b"])["fields"]
    assert merged == [{"name": "x", "type": "number"}, {"name": "y", "type": "keyword", "size": 5},
                      {"name": "z", "type": "boolean"}]


def test_template_document_with_duplicate_rows_and_order(spark, tmp):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (2, "c"), (2, "c")]
    df = spark.createDataFrame(rows, "g int, v string")
    parts = to_documents(df, {"g": "${g}", "rows": []}, "rows", by=["g"], order=["v"])
    write_documents(parts, tmp + "/dup", by=["g"])
    docs = {}
    for g in (1, 2):
        text = "".join(open(p).read() for p in sorted(glob.glob(f"{tmp}/dup/g={g}/part-*")))
        docs[g] = json.loads(text)
    assert [r["v"] for r in docs[1]["rows"]] == ["a", "a", "b"]
    assert [r["v"] for r in docs[2]["rows"]] == ["c", "c", "c"]
    empty = spark.createDataFrame([], "v string")
    write_documents(to_documents(empty, None, None), tmp + "/empty")
    assert json.loads("".join(open(p).read() for p in sorted(glob.glob(tmp + "/empty/part-*")))) == []


def test_geojson_feature_lines(spark, tmp):
    feats = [dict(f, properties={"FID": i}) for i, f in enumerate(POLYGONS["features"])]
    p = write(tmp, "features.jsonl", "\n".join(json.dumps(f) for f in feats))
    g = scan_geojson(spark, p, properties={"fields": [{"name": "FID", "type": "integer"}]}, lines=True)
    hit = match(g, {"geometry": {"contains": [2.5, 2.5]}})
    assert [r["properties"]["FID"] for r in hit.collect()] == [2]
