"""Registered queries of parameterised joins, keyed comparison and keyed stores, and their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import geometry, joins, keyed
from .plans.transfer import run_fiber, write_terminal
from .session import scratch_path, staged
from .sinks import files as sinks
from .sinks import store
from .sources import files as sources
from .workloads import table


SCAN_ROWS = 20_000  # rows of one array file


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def q_foreach_range(spark, d):
    """Orders in each customer's price range (J4): a range per driving row, no nested loop."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") * 25).alias("low"), (F.col("c_acctbal") * 25 + 40).alias("high"))
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return joins.conjoin(c.select("c_custkey", "low", "high"), o, {"o_totalprice": {"gte": "=low", "lt": "=high"}}, fields=["o_orderkey"]).select("c_custkey", "o_orderkey")


def q_foreach_dates(spark, d):
    """Open orders of the week after a supplier's day (J4): a date range and a constant condition."""
    s = table(spark, d, "supplier").select("s_suppkey", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") % 700).cast("int")).cast("timestamp_ntz").alias("day"))
    s = s.withColumn("week", F.col("day") + F.expr("interval 7 days"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_orderstatus")
    found = joins.conjoin(s, o, {"o_orderdate": {"gt": "=day", "lte": "=week"}, "o_orderstatus": {"eq": "O"}}, fields=["o_orderkey"])
    return found.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


def q_conjoin_wildcard(spark, d):
    """Customers whose name fits each supplier's wildcard (J2, P6): half by the end, half by the beginning."""
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Cust*#*"), F.substring("s_name", -3, 3)))
                                           .otherwise(F.concat(F.lit("Customer#0000"), F.substring("s_name", -4, 3), F.lit("??"))).alias("wish"))
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return joins.conjoin(s, c, {"c_name": {"wc": "=wish"}}, fields=["c_custkey"]).select("s_suppkey", "c_custkey")


def q_conjoin_areas(spark, d):
    """Triangles around suppliers that contain each customer's point (J2, P13), by a grid cover."""
    x, y, n = F.col("s_suppkey") % 90, F.col("s_suppkey") % 31, F.col("s_nationkey") % 5 + 1
    corner = [F.concat(F.lit("["), a.cast("string"), F.lit(","), b.cast("string"), F.lit("]")) for a, b in ((x, y), (x + n, y), (x, y + n), (x, y))]
    ring = F.concat(F.lit("[["), F.concat_ws(",", *corner), F.lit("]]"))
    areas = table(spark, d, "supplier").select("s_suppkey", geometry.normalize_geometry(F.lit("Polygon"), ring).alias("area"))
    points = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 97 + 0.5).cast("double").alias("px"), (F.col("c_custkey") % 37 + 0.25).cast("double").alias("py"))
    return joins.conjoin(points, areas, {"area": {"contains": ["=px", "=py"]}}, fields=["s_suppkey"]).select("c_custkey", "s_suppkey")


def q_compare_keyed(spark, d):
    """Customers against a changed copy, by key (U2): added, removed, and changed with the fields that differ."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    copy = c.where(k % 200 != 7).select("c_custkey", F.when(k % 150 == 3, F.lit("changed")).otherwise(F.col("c_name")).alias("c_name"),
                                        F.when(k % 100 == 3, None).otherwise(F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")
    copy = copy.unionByName(c.where(k % 300 == 9).withColumn("c_custkey", k + 10_000_000))
    out = keyed.compare_keyed(c, copy, ["c_custkey"])
    return out.select("c_custkey", "status", F.concat_ws(",", "fields").alias("fields"))


def q_upsert_store(spark, d):
    """A bucketed keyed store (K4): created, changed with a new column, changed by one key, deleted from."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = _scratch(spark, "keyed-store")
    store.upsert_store(c, path, ["c_custkey"])
    store.upsert_store(c.where("c_custkey % 10 = 1").select("c_custkey", F.concat("c_name", F.lit("-b")).alias("c_name"), F.lit("new").alias("note")), path, ["c_custkey"])
    one = spark.createDataFrame([(-5, "one")], c.select("c_custkey", "c_name").schema)
    store.upsert_store(one, path, ["c_custkey"])
    store.delete_from_store(spark, path, c.where("c_custkey % 50 = 2").select("c_custkey"))
    return store.read_store(spark, path)


def q_sync_state(spark, d):
    """Increments by order date with the mark kept in the store (D-2): a late row at the mark comes through."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice")
    path, day = _scratch(spark, "synced"), F.lit("1996-06-30").cast("date")
    store.sync_store(o.where((F.col("o_orderdate") < day) | (F.col("o_orderdate") == day) & (F.col("o_orderkey") % 2 == 0)), path, "o_orderdate", ["o_orderkey"])
    store.sync_store(o.where(F.col("o_orderdate") <= day), path, "o_orderdate", ["o_orderkey"])
    store.sync_store(o, path, "o_orderdate", ["o_orderkey"])
    return store.read_store(spark, path)


def q_stream_upsert(spark, d):
    """Order versions arriving as files, merged into a keyed store batch by batch, each once."""
    from .streaming.stream import read_stream, upsert_stream

    src, path, ck = (_scratch(spark, x) for x in ("versions", "latest", "checkpoint"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    for k in range(3):
        o.where(F.col("o_orderkey") % 3 == k).coalesce(2).write.mode("append").parquet(src)
    arriving = read_stream(spark, src, "parquet", schema=o.schema, max_files_per_trigger=2)
    upsert_stream(arriving, path, ["o_custkey"], ck, order=["o_orderdate", "o_orderkey"], name="latest").awaitTermination()
    store.upsert_store(o.where("o_orderkey < 100"), path, ["o_custkey"], batch=("latest", 0))  # a replayed batch
    return store.read_store(spark, path)


def q_csv_ranges(spark, d):
    """Large files with quoted line breaks, one per partition of the table, read by ranges (S3)."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit('"a", b\n\n,"'), F.col("text"), F.lit("\r\n;")).alias("text"), "source")
    path, limit = _scratch(spark, "one-csv"), "spark.sql.files.maxPartitionBytes"
    sinks.write_csv(docs, path, header=True)
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(256 << 10))  # small ranges, so that many records span two of them
    try:
        got = sources.scan_csv(spark, path).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"), "source")
        return staged(got, "csv-ranges-read")
    finally:
        spark.conf.set(limit, before)


def q_upsert_text_store(spark, d):
    """Keyed terminals over stored text (K4): a pretty array with a further column, then a CSV with one."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path, csv = _scratch(spark, "pretty"), _scratch(spark, "keyed-csv")
    text = F.concat(F.lit("[\n  "), F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("n_nationkey", "n_name", F.col("n_regionkey").alias("extra"))))), ",\n  "), F.lit("\n]"))
    n.agg(text.alias("value")).coalesce(1).write.text(path)
    changes = n.where("n_nationkey % 5 = 0").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), F.lower("n_name").alias("n_name"), F.lit(1.5).alias("more"))
    changes = changes.unionByName(changes.limit(1).select(F.lit(99).cast("bigint").alias("n_nationkey"), F.lit("new").alias("n_name"), F.lit(2.5).alias("more")))
    folder, _, name = path.rpartition("/")
    write_terminal(changes, {"smt": f"json|{folder}|{name}|=n_nationkey"})
    sinks.write_csv(n, csv, header=True)
    folder, _, name = csv.rpartition("/")
    write_terminal(changes.select("n_nationkey", "more"), {"smt": f"csv|{folder}|{name}|=n_nationkey", "options": {"addHeader": True}})
    a = spark.read.schema("n_nationkey bigint, n_name string, extra bigint, more double").json(path)
    b = sources.scan_csv(spark, csv)
    return a.select("n_nationkey", "n_name", "extra", "more", F.lit("json").alias("kind")).unionByName(
        b.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("bigint").alias("extra"), F.col("more").cast("double").alias("more"), F.lit("csv").alias("kind")))


def q_scan_fibers(spark, d):
    """A scan with two sub-fibers (S14): a transfer with a map, an output per dataset; and one encoding of all."""
    src, out = _scratch(spark, "scanned"), _scratch(spark, "scan-out")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    for k in range(3):
        # a dataset is a folder of arrays of SCAN_ROWS rows at most; one without rows is an empty array
        rows = c.where(F.col("c_nationkey") % 3 == k).select(F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")).alias("row"), F.monotonically_increasing_id().alias("i"))
        rows = rows.unionByName(spark.range(1).select(F.lit(None).cast("string").alias("row"), F.lit(0).cast("bigint").alias("i")))
        arrays = rows.groupBy(F.expr(f"i div {SCAN_ROWS}").alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ",\n"), F.lit("]")).alias("value"))
        arrays.select("value").write.option("maxRecordsPerFile", 1).text(f"{src}/part{k}.json")
    sinks.write_json(c.select("c_custkey", "c_name").limit(3), f"{src}/skipped.json")
    fiber = {"action": "scan", "origin": {"smt": f"json|{src}|*.json|*", "options": {"exclude": ["skip*"]}}, "fibers": [
        {"action": "transfer", "origin": {"smt": f"json|{src}|${{name}}|*", "options": {"codify": True}},
         "transforms": [{"transform": "mutate", "map": {"key": "=c_custkey", "label": "=c_name+'@${schema}'"}}], "terminal": {"smt": f"json|{out}|${{schema}}.out|*"}},
        {"action": "codify", "origin": {"smt": f"json|{src}|${{name}}|*"}, "terminal": {"output": "scan.engram.json"}}]}
    _, found = run_fiber(spark, fiber)
    types = ",".join(f"{f['name']}:{f['type']}" for f in found["fields"])
    frames = [spark.read.schema("key bigint, label string").json(f"{out}/part{k}.out").withColumn("dataset", F.lit(k)) for k in range(3)]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).withColumn("types", F.lit(types))


QUERIES = {
    "foreach_range": q_foreach_range, "foreach_dates": q_foreach_dates, "conjoin_wildcard": q_conjoin_wildcard, "conjoin_areas": q_conjoin_areas,
    "compare_keyed": q_compare_keyed, "upsert_store": q_upsert_store, "sync_state": q_sync_state, "stream_upsert": q_stream_upsert,
    "csv_ranges": q_csv_ranges, "upsert_text_store": q_upsert_text_store, "scan_fibers": q_scan_fibers,
}

ORACLE = {
    "foreach_range": """select c_custkey, o_orderkey from customer join orders
        on o_totalprice >= c_acctbal * 25 and o_totalprice < c_acctbal * 25 + 40""",
    "foreach_dates": """select s_suppkey, count(*) as n, min(o_orderkey) as first_key from supplier join orders
        on o_orderdate > date '1995-01-01' + (s_suppkey % 700)::int and o_orderdate <= date '1995-01-08' + (s_suppkey % 700)::int
        where o_orderstatus = 'O' group by s_suppkey""",
    "conjoin_wildcard": """select s_suppkey, c_custkey from supplier join customer
        on case when s_suppkey % 2 = 0 then c_name like 'Cust%#%' || right(s_name, 3)
                else c_name like 'Customer#0000' || left(right(s_name, 4), 3) || '__' end""",
    "conjoin_areas": """with p as (select c_custkey, c_custkey % 97 + 0.5 as px, c_custkey % 37 + 0.25 as py from customer),
        a as (select s_suppkey, s_suppkey % 90 as x, s_suppkey % 31 as y, s_nationkey % 5 + 1 as n from supplier)
        select c_custkey, s_suppkey from p join a on px > x and py > y and (px - x) + (py - y) < n""",
    "compare_keyed": """with c as (select c_custkey, c_name, c_acctbal from customer)
        select c_custkey, 'removed' as status, '' as fields from c where c_custkey % 200 = 7
        union all select c_custkey + 10000000, 'added', '' from c where c_custkey % 300 = 9
        union all select c_custkey, 'changed', concat_ws(',', case when c_custkey % 150 = 3 then 'c_name' end, case when c_custkey % 100 = 3 then 'c_acctbal' end)
        from c where c_custkey % 200 <> 7 and (c_custkey % 150 = 3 or (c_custkey % 100 = 3 and c_acctbal is not null))""",
    "upsert_store": """select c_custkey, case when c_custkey % 10 = 1 then c_name || '-b' else c_name end as c_name,
        case when c_custkey % 10 <> 1 then c_acctbal end as c_acctbal, case when c_custkey % 10 = 1 then 'new' end as note
        from customer where c_custkey % 50 <> 2
        union all select -5, 'one', null, null""",
    "sync_state": "select o_orderkey, cast(o_orderdate as date) as o_orderdate, o_totalprice from orders",
    "stream_upsert": """select o_custkey, o_orderkey, cast(o_orderdate as date) as o_orderdate from orders
        qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""",
    "csv_ranges": """select doc_id, md5('"a", b' || chr(10) || chr(10) || ',"' || text || chr(13) || chr(10) || ';') as text_md5, source from documents""",
    "upsert_text_store": """with n as (select cast(n_nationkey as bigint) as k, n_name, cast(n_regionkey as bigint) as r from nation)
        select k as n_nationkey, case when k % 5 = 0 then lower(n_name) else n_name end as n_name, case when k % 5 <> 0 then r end as extra,
               case when k % 5 = 0 then 1.5::double end as more, 'json' as kind from n
        union all select k, case when k % 5 <> 0 then n_name end, case when k % 5 <> 0 then r end, case when k % 5 = 0 then 1.5::double end, 'csv' from n
        union all select 99, 'new', null, 2.5::double, 'json' union all select 99, null, null, 2.5::double, 'csv'""",
    "scan_fibers": """select c_custkey as key, c_name || '@part' || (c_nationkey % 3) as label, (c_nationkey % 3)::int as dataset,
        'c_custkey:integer,c_name:keyword,c_acctbal:number' as types from customer""",
}
