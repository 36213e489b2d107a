"""Parameterised joins, keyed comparison, keyed stores, range reading and the scan action."""

import datetime as dt
import glob
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from skein.operators import joins, keyed, param_joins
from skein.operators.geometry import normalize_geometry
from skein.operators.maintain import upsert
from skein.operators.param_joins import param_join
from skein.plans.transfer import run_fiber, transfer, write_terminal
from skein.sinks import files as sinks
from skein.sinks import store
from skein.sources import csv_ranges
from skein.sources.files import json_kinds, scan_csv, scan_json

# --- joins by ranges, wildcards, areas ---


def no_nested_loop(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan, plan
    return df


@pytest.mark.parametrize("ops", [("gte", "lt"), ("gt", "lte"), ("gte",), ("lt",), ("gt", "lt", "gte")])
def test_ranges_equal_all_pairs(spark, ops):
    rng = random.Random(len(ops))
    facts = [(i, rng.choice([None, float("nan"), 7.0, 7.0, rng.uniform(-50, 50), rng.gauss(0, 3)])) for i in range(400)]
    drive = [(k, rng.choice([None, -60.0, 7.0, rng.uniform(-50, 50)]), rng.choice([None, 60.0, 7.0, rng.uniform(-50, 50)])) for k in range(60)]
    d = spark.createDataFrame(drive, "k int, low double, high double")
    f = spark.createDataFrame(facts, "id int, v double")
    spec = {op: "=low" if op[0] == "g" else "=high" for op in ops}
    got = no_nested_loop(param_join(d, f, {"v": spec}))
    test = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}

    def value(x):
        return float("inf") if x != x else x  # NaN is above all numbers

    want = sorted((k, i) for k, lo, hi in drive for i, v in facts if v is not None
                  and all((lo if op[0] == "g" else hi) is not None and test[op](value(v), lo if op[0] == "g" else hi) for op in ops))
    assert sorted((r.k, r.id) for r in got.collect()) == want
    assert got.columns == ["k", "low", "high", "id", "v"]
    assert param_join(d.limit(0), f, {"v": spec}).count() == 0 and param_join(d, f.limit(0), {"v": spec}).count() == 0


def test_ranges_meet_little_more_than_they_select(spark):
    facts = spark.range(40_000).select(F.col("id").alias("k"), ((F.col("id") - 20_000) / 4).alias("v"))
    drive = spark.range(300).select((F.col("id") * 31 - 4600).cast("double").alias("low")).withColumn("high", F.col("low") + 1)
    types = {"low": drive.schema["low"].dataType, "high": drive.schema["high"].dataType}
    left, right = param_joins._by_range(drive, facts, "v", ["low"], ["high"], types, facts.schema["v"].dataType)
    met = left.join(right, "__key")
    chosen = met.where("v >= low and v < high")
    assert chosen.count() == chosen.select("low", "k").distinct().count() == 1200
    assert met.count() <= 2 * 1200


def test_ranges_of_few_sizes_equal_all_pairs(spark):
    """Single values, borders of cells, values far apart in size, facts outside of all ranges."""
    values = [0.0, -0.0, 1.0, 2.0, 2.5, -3.0, 1e-9, 4.0, 8.0, 1e15, -1e15, float("nan"), float("inf"), None]
    ranges = [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 8.0), (-3.0, 5.0), (1.0, 9.0), (8.0, 4.0), (None, 1.0), (1.0, None)]
    for extra in ([], [(1e15, 1e15)], [(-1e15, 1e-9), (0.0, float("inf"))]):
        f = spark.createDataFrame(list(enumerate(values)), "id int, v double")
        d = spark.createDataFrame(ranges + extra, "low double, high double")
        got = param_joins.param_join(d, f, {"v": {"gte": "=low", "lte": "=high"}}, fields=["id"])
        want = d.crossJoin(f).where("v >= low and v <= high").select("low", "high", "id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ranges_of_other_types(spark):
    day = dt.date(2020, 1, 1)
    d = spark.createDataFrame([(1, day, day + dt.timedelta(3), "b", "bz"), (2, day, day, "a", "c")], "k int, a date, b date, s string, t string")
    f = spark.createDataFrame([(i, day + dt.timedelta(i), "abc"[i % 3] + str(i), str(i)) for i in range(9)], "id int, day date, name string, text string")
    assert sorted((r.k, r.id) for r in no_nested_loop(joins.conjoin(d, f, {"day": {"gte": "=a", "lte": "=b"}})).collect()) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]
    assert sorted((r.k, r.id) for r in param_join(d, f, {"name": {"gte": "=s", "lt": "=t"}}).collect()) == [(1, 1), (1, 4), (1, 7), (2, 0), (2, 1), (2, 3), (2, 4), (2, 6), (2, 7)]
    # text against a number is compared as a number; a constant condition reaches the other side alone
    got = param_join(d, f, {"text": {"gt": "=k"}, "id": {"lt": 4}}, keep=["k"], fields=["id"])
    assert sorted((r.k, r.id) for r in got.collect()) == [(1, 2), (1, 3), (2, 3)]
    # an equality is the key, the range is checked on what meets
    assert sorted((r.k, r.id) for r in param_join(d, f, {"id": "=k", "day": {"gt": "=a"}}).collect()) == [(1, 1), (2, 2)]
    assert [r.id for r in joins.foreach_join(d.where("k = 2"), f, {"name": {"gte": "=s", "lt": "=t"}, "id": {"neq": "=k"}}).select("id").orderBy("id").collect()] == [0, 1, 3, 4, 6, 7]


def test_wildcards_equal_all_pairs(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab%_\\c") for _ in range(rng.randint(0, 6))) for _ in range(150)] + [None]
    wishes = ["a*", "*b", "*", "?", "a?c*", "*ab*", "%*", "_b", "\\*", "abcabcabcabc*", "", None, "a*b", "*_c"]
    d = spark.createDataFrame([(w,) for w in wishes], "wish string")
    f = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    import fnmatch
    import re

    def fits(t, w):
        return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in w), t, re.S) is not None

    assert fnmatch.fnmatchcase("ab", "a*")
    want = sorted((w, i) for w in wishes if w is not None for i, t in enumerate(texts) if t is not None and fits(t, w))
    got = no_nested_loop(param_join(d, f, {"t": {"wc": "=wish"}}))
    assert sorted((r.wish, r.id) for r in got.collect()) == want


def test_areas_contain_points(spark):
    rng = random.Random(4)
    squares = [(i, rng.uniform(-40, 40), rng.uniform(-40, 40), 10 ** rng.uniform(-3, 2)) for i in range(60)]
    areas = spark.createDataFrame([(i, "Polygon", json.dumps([[[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]])) for i, x, y, s in squares]
                                  + [(900, "Point", "[1, 1]"), (901, "Polygon", None)], "id int, t string, c string") \
        .select("id", normalize_geometry(F.col("t"), F.col("c")).alias("area"))
    points = [(k, rng.choice([None, rng.uniform(-45, 45)]) if k % 9 == 0 else rng.uniform(-45, 45), rng.uniform(-45, 45)) for k in range(200)]
    d = spark.createDataFrame(points, "k int, x double, y double")
    want = sorted((k, i) for k, px, py in points if px is not None for i, x, y, s in squares if x < px < x + s and y < py < y + s)
    assert sorted((r.k, r.id) for r in no_nested_loop(joins.conjoin(d, areas, {"area": {"contains": ["=x", "=y"]}})).collect()) == want and want


# --- comparison by key ---


def test_compare_keyed(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", None), (3, "z", 3.0), (None, "n", 0.0), (5, "p", 1.0), (5, "q", 2.0), (6, "r", 1.0), (6, "s", 2.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 1, "m"), (2, None, 7, "m"), (4, "w", 4, None), (None, "N", 0, None), (5, "q", 2, None), (5, "p", 1, None), (6, "r", 2, None), (6, "s", 1, None)], "k int, s string, v int, extra string")
    got = {r.k: (r.status, r.fields) for r in keyed.compare_keyed(a, b, ["k"], buckets=8).collect()}
    assert got == {1: ("changed", ["extra"]), 2: ("changed", ["s", "v", "extra"]), 3: ("removed", []), 4: ("added", []), None: ("changed", ["s"]), 6: ("changed", [])}
    assert keyed.compare_keyed(a, a, "k").count() == 0
    assert keyed.compare_keyed(a.limit(0), a.limit(0), "k").count() == 0


def test_equal_buckets_drop_out(spark):
    a = spark.range(20_000).withColumn("v", F.col("id") * 3)
    b = a.withColumn("v", F.when(F.col("id") == 77, 0).otherwise(F.col("v"))).coalesce(2)
    assert keyed.unequal_buckets(a, b, ["id"], 256).count() == 1
    out = keyed.compare_keyed(a, b, ["id"], 256)
    assert [(r.id, r.status, r.fields) for r in out.collect()] == [(77, "changed", ["v"])]
    # of 40,000 rows only those of one bucket reach the shuffle by key
    bucket = a.where(keyed.bucket_of(a, ["id"], 256) == keyed.unequal_buckets(a, b, ["id"], 256).first()["bucket"]).count()
    shuffles = _exchanged(out)
    assert max(shuffles) <= 2 * bucket


def _exchanged(df):
    """Rows that each shuffle of the final plan has written."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            if name == "Exchange":
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


# --- keyed stores ---


def _files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(path + "/__bucket=*/part-*")}


def test_one_key_rewrites_one_bucket(spark, tmp):
    path = tmp + "/store"
    base = spark.range(500).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    store.upsert_store(base, path, ["k"], buckets=16)
    before = _files(path)
    assert store.upsert_store(spark.createDataFrame([(7, "seven", 1)], "k long, v string, more int"), path, ["k"]) == 1
    after = _files(path)
    gone = {os.path.dirname(f) for f in set(before) - set(after)}
    assert len(gone) == 1 and all(os.path.dirname(f) in gone for f in set(after) - set(before))
    rows = {r.k: (r.v, r.more) for r in store.read_store(spark, path).collect()}
    assert len(rows) == 500 and rows[7] == ("seven", 1) and rows[8] == ("8", None)
    # columns that only the store has are kept as columns; the change's row has no value there
    store.upsert_store(spark.createDataFrame([(8, 9)], "k long, more int"), path, ["k"])
    rows = {r.k: (r.v, r.more) for r in store.read_store(spark, path).collect()}
    assert rows[8] == (None, 9) and rows[7] == ("seven", 1) and rows[9] == ("9", None)
    picked = store.read_keys(spark, path, spark.createDataFrame([(7,), (9999,)], "k long"))
    assert [r.v for r in picked.collect()] == ["seven"]
    assert len({f.rsplit("/", 2)[1] for f in picked.inputFiles()}) >= 1
    assert store.delete_from_store(spark, path, spark.createDataFrame([(7,), (8,)], "k long")) in (1, 2)
    assert store.read_store(spark, path).count() == 498
    with pytest.raises(ValueError, match="is bigint"):
        store.upsert_store(spark.createDataFrame([("7",)], "k string"), path, ["k"])
    with pytest.raises(ValueError, match="keyed by"):
        store.upsert_store(base, path, ["v"])


def test_store_survives_a_death_in_between(spark, tmp, monkeypatch):
    path = tmp + "/store"
    base = spark.range(40).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    store.upsert_store(base, path, ["k"], buckets=4)
    real = store._exchange
    monkeypatch.setattr(store, "_exchange", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError, match="died"):
        store.upsert_store(spark.createDataFrame([(1, "new"), (99, "new")], "k long, v string"), path, ["k"])
    monkeypatch.setattr(store, "_exchange", real)
    # the written change is finished by the next access
    got = {r.k: r.v for r in store.read_store(spark, path).collect()}
    assert got[1] == got[99] == "new" and len(got) == 41
    assert not glob.glob(tmp + "/store__change-*") and not os.path.exists(path + "/_change.json")


def test_store_versions_nulls_and_empty(spark, tmp):
    path = tmp + "/store"
    schema = "k long, v string, n int"
    store.upsert_store(spark.createDataFrame([(1, "b", 2), (2, "x", 1), (None, "keyless", 0)], schema), path, ["k"], ["n"])
    store.upsert_store(spark.createDataFrame([(1, "late", 1), (2, "y", 1), (2, "z", 3)], schema), path, ["k"], ["n"])
    assert sorted((str(r.k), r.v) for r in store.read_store(spark, path).collect()) == [("1", "b"), ("2", "z"), ("None", "keyless")]
    assert store.upsert_store(spark.createDataFrame([], schema), path, ["k"]) == 0
    empty = tmp + "/empty"
    store.upsert_store(spark.createDataFrame([], schema), empty, ["k"])
    assert store.read_store(spark, empty).collect() == [] and store.store_exists(spark, empty)
    with pytest.raises(FileNotFoundError):
        store.read_store(spark, tmp + "/none")


def test_sync_keeps_its_mark(spark, tmp):
    path = tmp + "/synced"
    rows = [(i, dt.datetime(2024, 1, 1 + i // 3)) for i in range(12)]
    src = spark.createDataFrame(rows + [(50, None)], "k int, at timestamp")
    assert store.sync_store(src.where("k in (0, 1, 3)"), path, "at", ["k"], buckets=4) == 3
    # rows 4 and 5 arrive late, with the value of the mark
    assert store.sync_store(src.where("k < 6"), path, "at", ["k"]) == 2
    assert store.sync_store(src.where("k < 6"), path, "at", ["k"]) == 0
    store.sync_store(src, path, "at", ["k"])
    assert sorted(r.k for r in store.read_store(spark, path).collect()) == [0, 1, 3, *range(4, 12)]


def test_replayed_batches_change_nothing(spark, tmp):
    path = tmp + "/store"
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    assert store.upsert_store(one, path, ["k"], batch=("s", 0)) == 1
    later = spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert store.upsert_store(later, path, ["k"], batch=("s", 1)) > 0
    assert store.upsert_store(one, path, ["k"], batch=("s", 0)) == 0
    assert store.upsert_store(later, path, ["k"], batch=("s", 1)) == 0
    assert store.upsert_store(one.limit(0), path, ["k"], batch=("s", 2)) == 0
    assert store.upsert_store(one, path, ["k"], batch=("s", 2)) == 0  # the empty batch was noted
    assert sorted((r.k, r.v) for r in store.read_store(spark, path).collect()) == [(1, "b"), (2, "b")]
    assert store.upsert_store(one, path, ["k"], batch=("other", 0)) == 1


def test_upsert_keeps_columns_of_both_sides(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, only_a int")
    b = spark.createDataFrame([(2, "B", 0.5)], "k int, x string, only_b double")
    for order in (None, ["x"]):
        got = upsert(a, b, ["k"], order)
        assert got.columns == ["k", "x", "only_a", "only_b"]
        assert sorted(tuple(r) for r in got.collect()) == ([(1, "a", 1, None), (2, "B", None, 0.5)] if order is None else [(1, "a", 1, None), (2, "b", 2, None)])


# --- text stores ---


def test_keyed_json_terminal_keeps_what_is_there(spark, tmp):
    os.makedirs(tmp + "/s")
    with open(tmp + "/s/store.json", "w") as f:
        json.dump([{"Foo": "one", "n": 1, "extra": {"a": [1, 2]}}, {"Foo": "two", "n": "many", "extra": None}], f, indent=2)
    new = spark.createDataFrame([("two", 2.0), ("three", 3.0)], "Foo string, n double")
    write_terminal(new, {"smt": f"json|{tmp}/s|store.json|=Foo"})
    got = {r["Foo"]: r for r in map(json.loads, "".join(open(f).read() for f in glob.glob(tmp + "/s/store.json/part-*")).splitlines())}
    assert set(got) == {"one", "two", "three"}
    assert got["one"]["extra"] == {"a": [1, 2]} and got["one"]["n"] == "1" and got["three"]["n"] == "3"  # "many" is no number: the column is text
    # again, over JSON Lines now
    write_terminal(spark.createDataFrame([("four", "4")], "Foo string, n string"), {"smt": f"json|{tmp}/s|store.json|=Foo"})
    assert scan_json(spark, tmp + "/s/store.json", lines=None).count() == 4


def test_keyed_csv_terminal_keeps_what_is_there(spark, tmp):
    os.makedirs(tmp + "/s")
    with open(tmp + "/s/store.csv", "w") as f:
        f.write('id,name,when\n1,"a, b",2020-01-02\n2,two,never\n')
    new = spark.createDataFrame([(2, "zwei", True)], "id int, name string, flag boolean")
    write_terminal(new, {"smt": f"csv|{tmp}/s|store.csv|=id", "options": {"addHeader": True}})
    got = {r.id: (r.name, r.when, r.flag) for r in scan_csv(spark, tmp + "/s/store.csv").collect()}
    assert got == {"1": ("a, b", "2020-01-02", None), "2": ("zwei", None, "true")}
    with open(tmp + "/s/bad.csv", "w") as f:
        f.write("id,name\nx1,a\n")
    with pytest.raises(ValueError, match="key 'id'"):
        write_terminal(new, {"smt": f"csv|{tmp}/s|bad.csv|=id", "options": {"addHeader": True}})
    assert open(tmp + "/s/bad.csv").read() == "id,name\nx1,a\n"


def test_a_broken_record_raises(spark, tmp):
    os.makedirs(tmp + "/s")
    with open(tmp + "/s/store.json", "w") as f:
        f.write('{"k": 1}\n{"k": 2, "v"\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        write_terminal(spark.createDataFrame([(1,)], "k int"), {"smt": f"json|{tmp}/s|store.json|=k"})
    assert open(tmp + "/s/store.json").read().startswith('{"k": 1}')


def test_json_files_are_read_as_they_are(spark, tmp):
    os.makedirs(tmp + "/j")
    for name, text in (("a.json", '[{"k": 1},\n {"k": 2}]'), ("b.json", '{"k": 3}\n{"k": 4}\n'), ("c.json", '{\n "k": 5\n}'), ("d.json", "\n")):
        with open(f"{tmp}/j/{name}", "w") as f:
            f.write(text)
    kinds = json_kinds(spark, tmp + "/j")
    assert {k: [os.path.basename(f) for f in v] for k, v in kinds.items()} == {"whole": ["a.json", "c.json"], "lines": ["b.json"]}
    assert sorted(r.k for r in scan_json(spark, tmp + "/j", lines=None).collect()) == ["1", "2", "3", "4", "5"]
    assert transfer(spark, f"json|{tmp}|j|*").count() == 5


def test_dull_keeps_headers_arrays_and_nulls(spark, tmp):
    with open(tmp + "/a.csv", "w") as f:
        f.write('id,name\n1,"x\ny"\n2,\n3,z\n')
    assert run_fiber(spark, {"action": "dull", "origin": {"smt": f"csv|{tmp}|a.csv|*", "pattern": {"match": {"id": "3"}}}}) == {"deleted": 1}
    assert [(r.id, r.name) for r in scan_csv(spark, tmp + "/a.csv").orderBy("id").collect()] == [("1", "x\ny"), ("2", None)]
    with open(tmp + "/a.json", "w") as f:
        json.dump([{"k": "a", "v": None}, {"k": "b", "v": "1"}], f, indent=1)
    assert run_fiber(spark, {"action": "dull", "origin": {"smt": f"json|{tmp}|a.json|*", "pattern": {"match": {"k": "b"}}}}) == {"deleted": 1}
    assert [json.loads(x) for f in glob.glob(tmp + "/a.json/part-*") for x in open(f)] == [{"k": "a", "v": None}]
    # nothing left: the header stays
    assert run_fiber(spark, {"action": "dull", "origin": {"smt": f"csv|{tmp}|a.csv|*", "pattern": {"match": "*"}}}) == {"deleted": 2}
    assert scan_csv(spark, tmp + "/a.csv").columns == ["id", "name"]


def test_empty_csv_has_its_header(spark, tmp):
    df = spark.createDataFrame([], "a int, b string")
    sinks.write_csv(df, tmp + "/e", header=True)
    assert scan_csv(spark, tmp + "/e").columns == ["a", "b"] and scan_csv(spark, tmp + "/e").count() == 0


def test_table_comes_back_after_a_death_between_renames(spark):
    name = "round3_table"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    sinks.upsert_table(spark.createDataFrame([(1, "a")], "k int, v string"), name, ["k"])
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}__old_12345678")  # as if the job had died here
    sinks.upsert_table(spark.createDataFrame([(2, "b")], "k int, v string"), name, ["k"])
    assert sorted(tuple(r) for r in spark.table(name).collect()) == [(1, "a"), (2, "b")]
    spark.sql(f"DROP TABLE {name}")


# --- ranges of large text files ---


def _csv_cases():
    rng = random.Random(6)
    cells = ["", "a", " b ", 'say "hi"', "two\nlines", "\n\n", ",", '"', "x" * 40, 'end"', "ü€😀", "1", 'a""b', '",\n"']
    return [[rng.choice(cells) for _ in range(3)] for _ in range(300)]


@pytest.mark.parametrize("size", [37, 200, 5000])
def test_csv_ranges_equal_the_whole_read(spark, tmp, size):
    rows = _csv_cases()
    with open(tmp + "/one.csv", "w", newline="") as f:
        f.write("h1,h2,h3\n")
        for r in rows:
            f.write(",".join('"' + c.replace('"', '""') + '"' if c else "" for c in r) + "\n")
    limit, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = [tuple(r) for r in scan_csv(spark, tmp + "/one.csv", ranges=False).collect()]
    spark.conf.set(limit, str(size))
    try:
        df = scan_csv(spark, tmp + "/one.csv")
        got = [tuple(r) for r in df.collect()]
        assert df.columns == ["h1", "h2", "h3"] and df.rdd.getNumPartitions() > 1
        key = lambda t: tuple((x is None, x or "") for x in t)
        assert sorted(got, key=key) == sorted(want, key=key) and len(got) == 300
        plain = scan_csv(spark, tmp + "/one.csv", header=False, names=["a", "b", "c"], ranges=True)
        assert plain.count() == 301
    finally:
        spark.conf.set(limit, before)


def test_csv_ranges_follow_each_header_and_odd_quotes(spark, tmp):
    os.makedirs(tmp + "/d")
    for name, text in (("a.csv", 'k|v\r\n1|5" pipe\r\n2|"a|b\r\nc"\r\n\r\n3|\r\n'), ("b.csv", "\nv|k|w\nx|4|y\n"), ("c.csv", "k|v"), ("empty.csv", "")):
        with open(f"{tmp}/d/{name}", "w", newline="") as f:
            f.write(text)
    got = scan_csv(spark, tmp + "/d", sep="|", ranges=True)
    assert sorted(got.columns) == ["k", "v", "w"]
    rows = sorted((r.k, r.v, r.w) for r in got.collect())
    assert [(k, (v or "").replace("\r", ""), w) for k, v, w in rows] == [("1", '5" pipe', None), ("2", "a|b\nc", None), ("3", "", None), ("4", "x", "y")]


def test_many_headers_are_read_by_executors(spark, tmp):
    os.makedirs(tmp + "/many")
    for i in range(20):
        with open(f"{tmp}/many/{i}.csv", "w") as f:
            f.write(f"a,b\n{i},x\n" if i % 2 else f"b,a\nx,{i}\n")
    got = scan_csv(spark, tmp + "/many")
    assert sorted(int(r.a) for r in got.collect()) == list(range(20)) and {r.b for r in got.collect()} == {"x"}


def test_quote_automaton():
    q = csv_ranges.Quotes(",")
    assert not q.after('a,b"c,d', False) and not q.after('"a ""b"" c",d', False)
    assert q.after('"a ""b', False) and q.after('x,"', False) and not q.after('b""c",d', True)
    assert q.after('b""', True) and not q.after('b"""', True) and not q.after('x"y,z', True) and q.after('x"y,"z', True)


# --- scan with sub-fibers ---


def _scanned(tmp):
    os.makedirs(tmp + "/in/sub")
    for name, rows in (("one.json", [{"name": "a", "n": "1"}, {"name": "b", "n": "2"}]), ("two.json", [{"name": "c", "n": "x"}])):
        with open(f"{tmp}/in/{name}", "w") as f:
            json.dump(rows, f, indent=2)
    with open(tmp + "/in/skip.json", "w") as f:
        f.write("[]")
    with open(tmp + "/in/three four.json", "w") as f:
        f.write('{"name": "d", "n": "4"}\n{"name": "e", "n": "5"}\n')
    with open(tmp + "/in/a.csv", "w") as f:
        f.write("Foo;Bar\nx;1\n")
    return tmp + "/in"


def _lines(path):
    return sorted((json.loads(x) for f in glob.glob(path + "/part-*") for x in open(f)), key=str)


def test_scan_runs_sub_fibers_as_written(spark, tmp):
    src = _scanned(tmp)
    fiber = {"action": "scan", "origin": {"smt": f"json|{src}/|*.json|*", "options": {"exclude": ["skip*"], "recursive": False}}, "fibers": [
        {"action": "transfer", "origin": {"smt": f"json|{src}/|${{name}}|*", "options": {"codify": True}}, "terminal": {"smt": f"json|{tmp}/out/|${{name}}|*"}},
        {"action": "transfer", "origin": {"smt": f"json|{src}/|${{name}}|*"}, "transforms": [
            {"transform": "mutate", "map": {"who": "=name", "from": "${schema}", "tag": "=n+'/${rpath}'"}}], "terminal": {"smt": f"json|{tmp}/mapped|${{schema}}/x.json|*"}},
        {"action": "codify", "origin": {"smt": f"json|{src}/|${{name}}|*", "options": {"count": 1}}, "terminal": {"output": "ignored.json"}}]}
    _, mapped, found = run_fiber(spark, fiber)
    assert _lines(tmp + "/out/one.json") == [{"name": "a", "n": 1}, {"name": "b", "n": 2}]
    assert _lines(tmp + "/out/two.json") == [{"name": "c", "n": "x"}]
    assert _lines(tmp + "/out/three four.json") == [{"name": "d", "n": 4}, {"name": "e", "n": 5}]
    assert not os.path.exists(tmp + "/out/skip.json") and not glob.glob(tmp + "/out/__*")
    assert _lines(tmp + "/mapped/one/x.json") == [{"who": "a", "from": "one", "tag": "1/one.json"}, {"who": "b", "from": "one", "tag": "2/one.json"}]
    assert sorted((r.who, r["from"], r["name"]) for r in mapped.collect())[3:] == [("d", "three four", "three four.json"), ("e", "three four", "three four.json")]
    assert {f["name"]: f["type"] for f in found["fields"]}["name"] == "keyword" and {f["name"] for f in found["fields"]} == {"name", "n"}


def test_scan_reads_with_the_options_of_its_origin(spark, tmp):
    src = _scanned(tmp)
    got = run_fiber(spark, {"action": "scan", "origin": {"smt": f"csv|{src}|*.csv|*", "options": {"separator": ";"}}, "fibers": [{"transforms": []}]})
    assert [(r.Foo, r.Bar, r.schema) for r in got.collect()] == [("x", "1", "a")]
    # all datasets into one keyed store
    fiber = {"action": "scan", "origin": {"smt": f"json|{src}|*.json|*", "options": {"exclude": ["skip*"]}}, "fibers": [
        {"origin": {"smt": f"json|{src}|${{name}}|*", "options": {"encoding": {"fields": [{"name": "name", "type": "keyword"}, {"name": "n", "type": "integer"}]}}},
         "terminal": {"smt": f"parquet|{tmp}|keyed|=name"}}]}
    run_fiber(spark, fiber)
    assert sorted((r.name, r.n) for r in spark.read.parquet(tmp + "/keyed").collect()) == [("a", 1), ("b", 2), ("c", None), ("d", 4), ("e", 5)]


def test_scan_aggregates_each_dataset_and_encodes_each(spark, tmp):
    src = _scanned(tmp)
    origin = {"smt": f"json|{src}|${{name}}|*"}
    fiber = {"action": "scan", "origin": {"smt": f"json|{src}|*.json|*", "options": {"exclude": ["skip*"]}}, "fibers": [
        {"origin": origin, "transforms": [{"transform": "aggregate", "aggs": {"rows": ["count", "name"]}}], "terminal": {"smt": f"csv|{tmp}/counts|${{schema}}.csv|*", "options": {"addHeader": True}}},
        {"action": "codify", "origin": origin, "terminal": {"smt": f"json|{tmp}/engrams|${{schema}}.engram.json|*"}}]}
    _, found = run_fiber(spark, fiber)
    assert {k: [r.rows for r in scan_csv(spark, f"{tmp}/counts/{k}.csv").collect()] for k in ("one", "two", "three four")} == {"one": ["2"], "two": ["1"], "three four": ["2"]}
    assert set(found) == {"one.json", "two.json", "three four.json"}
    assert {f["name"]: f["type"] for f in found["one.json"]["fields"]} == {"name": "keyword", "n": "integer"}
    assert json.loads(open(glob.glob(tmp + "/engrams/two.engram.json/part-*")[0]).read())["name"] == "two"


def test_a_transform_that_loses_the_dataset_raises(spark, tmp):
    from skein.plans.transfer import register_transform

    register_transform("forgetful", lambda df, spec, ctx: df.select("n"))
    with pytest.raises(ValueError, match="tell a scan's datasets apart"):
        run_fiber(spark, {"action": "scan", "origin": {"smt": f"json|{_scanned(tmp)}|*.json|*"}, "fibers": [{"transforms": [{"transform": "forgetful"}]}]})


def test_foreach_over_nothing_ends(spark):
    driver = spark.createDataFrame([], "smt string")
    assert run_fiber(spark, {"action": "foreach", "origin": "d", "fibers": [{"origin": {"smt": "=${smt}"}}]}, datasets={"d": driver}).count() == 0


def test_wildcards_meet_by_both_literals(spark):
    """A pattern's rows are found by its beginning and its end together; jokers and text between them count."""
    from skein.operators import param_joins

    names = [f"Item#{i:05d}" for i in range(400)] + ["", "Item#00012x", "a\nb", "100%_\\", "Item", "ItemItem", None]
    wishes = ["Item*#*123", "Item#001??", "*", "?", "", "Item", "It*em", "*m#*0?1", "100%*\\", "a?b", "Item#00012?", None, "*7", "Item*Item", "??em#00*"]
    facts = spark.createDataFrame(list(enumerate(names)), "n int, name string")
    driver = spark.createDataFrame(list(enumerate(wishes)), "w int, wish string")
    got = {(r.w, r.n) for r in param_join(driver, facts, {"name": {"wc": "=wish"}}, ["w"], ["n"]).collect()}
    fits = lambda p, t: re.fullmatch("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in p), t, re.S)
    want = {(w, n) for w, p in enumerate(wishes) for n, t in enumerate(names) if p is not None and t is not None and fits(p, t)}
    assert got == want
    # of a pattern with a selective end, only rows with that end are candidates
    left, right = param_joins._by_wildcard(driver.where("wish = 'Item*#*123'").withColumnsRenamed({"wish": "__p0"}), facts, "name", "__p0")
    assert left.join(right, "__key").count() == 1


def test_areas_have_few_candidates(spark):
    from skein.operators import geometry, param_joins

    ring = "[[[0,0],[40,0],[0,40],[0,0]],[[4,4],[8,4],[4,8],[4,4]]]"
    areas = spark.range(1).select(F.lit(1).alias("a"), geometry.normalize_geometry(F.lit("Polygon"), F.lit(ring)).alias("area"))
    points = spark.createDataFrame([(x * 1000 + y, x + 0.5, y + 0.25) for x in range(-64, 128) for y in range(-64, 128)], "p int, x double, y double")
    got = {r.p for r in param_join(points, areas, {"area": {"contains": ["=x", "=y"]}}, ["p"], ["a"]).collect()}
    inside = lambda x, y, x0, y0, n: x > x0 and y > y0 and (x - x0) + (y - y0) < n
    assert got == {x * 1000 + y for x in range(-64, 128) for y in range(-64, 128) if inside(x + 0.5, y + 0.25, 0, 0, 40) and not inside(x + 0.5, y + 0.25, 4, 4, 4)}
    left, right = param_joins._by_area(points.withColumnsRenamed({"x": "__p0", "y": "__p1"}), areas, "area", "__p0", "__p1")
    assert left.join(right, "__key").count() <= 48 * 48


def test_queries_build_their_files_in_parts(spark, tmp, monkeypatch):
    """Neither the CSV of csv_ranges nor an array of scan_fibers is made by one task for the whole table."""
    from skein import workloads_keyed as wk

    spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source")) \
        .repartition(3).write.parquet(f"{tmp}/in/documents.parquet")
    spark.range(300).select(F.col("id").alias("c_custkey"), F.lit("name").alias("c_name"), F.lit(1.5).alias("c_acctbal"), (F.col("id") % 2).alias("c_nationkey")) \
        .coalesce(1).write.parquet(f"{tmp}/in/customer.parquet")
    paths = []
    monkeypatch.setattr(wk, "_scratch", lambda _, name: paths.append(f"{tmp}/{name}") or paths[-1])
    limit = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(1 << 30))  # an input file is a partition
    try:
        assert wk.q_csv_ranges(spark, f"{tmp}/in").count() == 300
    finally:
        spark.conf.set(limit, before)
    assert len([f for f in os.listdir(paths[0]) if f.startswith("part-")]) == 3
    monkeypatch.setattr(wk, "SCAN_ROWS", 100)
    got = wk.q_scan_fibers(spark, f"{tmp}/in")
    assert sorted((r.key, r.dataset) for r in got.collect()) == [(i, i % 2) for i in range(300)]
    sizes = [sum(1 for _ in open(f"{paths[1]}/part0.json/{f}")) for f in os.listdir(f"{paths[1]}/part0.json") if f.startswith("part-")]
    assert len(sizes) > 1 and max(sizes) <= 100
