"""Registered queries of sources, sinks, coercion and maintenance: what they write goes to the shared
scratch folder and is read back, so the result shows what a user would find there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import coerce, expr
from .operators import aggregate as agg_ops
from .operators import codify as codify_ops
from .operators import geometry, joins, maintain, mutate, pattern
from .plans.engram import apply_engram
from .session import scratch_path
from .sinks import files as sinks
from .sinks.documents import to_documents, write_documents
from .sources import files as sources
from .workloads import table


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def q_csv_roundtrip(spark, d):
    """Texts with separators, quotes and line breaks, written and scanned again."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit('"a", b\n'), F.col("text")).alias("text"), "source")
    path = _scratch(spark, "csv")
    sinks.write_csv(docs, path, header=True)
    return sources.scan_csv(spark, path).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"), "source")


def q_csv_header_order(spark, d):
    """Two files of one folder whose headers name the columns in different order."""
    c, path = table(spark, d, "customer"), _scratch(spark, "swapped")
    sinks.write_csv(c.where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_name").alias("v")), path, header=True)
    sinks.write_csv(c.where("c_custkey % 2 = 1").select(F.col("c_name").alias("v"), F.col("c_custkey").cast("string").alias("k")), path, header=True, mode="append")
    return sources.scan_csv(spark, path).select(F.col("k").cast("bigint").alias("k"), "v")


def q_csv_separators(spark, d):
    """Header-less files with another separator, blanks kept."""
    path = _scratch(spark, "pipes")
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("a"), F.concat(F.lit(" "), F.col("n_name"), F.lit("  ")).alias("b"))
    sinks.write_csv(n, path, sep="|")
    got = sources.scan_csv(spark, path, header=False, sep="|", names=["a", "b"])
    return got.select(F.col("a").cast("bigint").alias("a"), "b", F.length("b").cast("bigint").alias("b_length"))


def q_json_lines(spark, d):
    """JSON Lines out and in: explicit nulls, numbers as numbers, the file's own member order."""
    path = _scratch(spark, "jsonl")
    sinks.write_json(table(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"), "s_nationkey"), path)
    back = sources.scan_json(spark, path, lines=True)
    order = "/".join(back.columns)
    return back.select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name", F.col("balance").cast("double").alias("balance"), F.lit(order).alias("member_order"))


def q_sample_head(spark, d):
    """The count option: as many rows as asked for, all of them from the table."""
    o = table(spark, d, "orders").select("o_orderkey")
    head = sources.sample_head(o, 100)
    return head.join(o, "o_orderkey", "left_semi").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_distinct"))


def q_inventory(spark, d):
    """Files of a split output, without reading their contents."""
    path = _scratch(spark, "inventory")
    table(spark, d, "customer").repartition(3, "c_custkey").write.parquet(path)
    found = sources.inventory(spark, path, "part-*.parquet")
    rows = spark.read.parquet(path)
    return found.agg((F.count("*") > 0).alias("some"), (F.min("size") > 0).alias("sizes")).crossJoin(rows.agg(F.count("*").alias("n_rows")))


def q_split_write(spark, d):
    path = _scratch(spark, "split")
    sinks.write_split(table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", "l_quantity"), path, ["l_linestatus"], fmt="parquet")
    back = spark.read.parquet(path)
    return back.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(28,2)").alias("q"))


def q_documents_text(spark, d):
    """Template documents: the parts of a group, in file order, are its document, element for element."""
    c, path = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name"), _scratch(spark, "documents")
    parts = to_documents(c, {"name": "nation-${c_nationkey}", "data": []}, "data", by=["c_nationkey"], row_json=F.to_json(F.struct("c_custkey", "c_name")), order=["c_custkey"])
    write_documents(parts, path, by=["c_nationkey"])
    text = spark.read.text(path)
    at = text.select("c_nationkey", F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("i"), "value")
    whole = at.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("f", "i", "value"))).alias("x"))
    return whole.select(F.col("c_nationkey").cast("int").alias("c_nationkey"), F.md5(F.array_join(F.col("x.value"), "")).alias("doc_md5"))


def q_load_append(spark, d):
    """Create once, then append (K3)."""
    name = f"skein_load_{uuid.uuid4().hex[:12]}"
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    sinks.load_table(n, name)
    sinks.load_table(n.where("n_nationkey < 5"), name)
    path = _scratch(spark, "loaded")
    spark.table(name).write.parquet(path)
    spark.sql(f"DROP TABLE {name}")
    return spark.read.parquet(path)


def q_fan_out(spark, d):
    """One computed dataset written to two terminals, and a side output on the way (K8, K9)."""
    a, b, side = (_scratch(spark, x) for x in ("left", "right", "side"))
    o = pattern.match(table(spark, d, "orders"), {"o_orderpriority": "1-URGENT"}).select("o_orderkey", "o_totalprice")
    teed = sinks.tee(o, lambda x: x.select("o_orderkey"), lambda x: x.write.parquet(side))
    sinks.tee_write(teed, [lambda x: x.write.parquet(a), lambda x: sinks.write_json(x, b)])
    teed.unpersist()
    counts = [spark.read.parquet(a).agg(F.count("*").alias("n"), F.sum(F.col("o_orderkey")).alias("s")).select(F.lit("parquet").alias("sink"), "n", "s"),
              spark.read.schema("o_orderkey bigint").json(b).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s")).select(F.lit("json").alias("sink"), "n", "s"),
              spark.read.parquet(side).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s")).select(F.lit("side").alias("sink"), "n", "s")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def q_upsert_insert(spark, d):
    """New keys, changed keys, and two changes of one key: the larger row of the two wins."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = c.where("c_custkey % 10 = 1").select("c_custkey", F.concat("c_name", F.lit("-b")).alias("c_name"), "c_acctbal")
    again = c.where("c_custkey % 20 = 1").select("c_custkey", F.concat("c_name", F.lit("-a")).alias("c_name"), "c_acctbal")
    fresh = c.where("c_custkey % 10 = 2").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), "c_name", "c_acctbal")
    path = _scratch(spark, "store")
    sinks.upsert_path(c, path, ["c_custkey"])
    sinks.upsert_path(changed.unionByName(again).unionByName(fresh), path, ["c_custkey"])
    return spark.read.parquet(path)


def q_upsert_versioned(spark, d):
    """The newest version of a key stays, whichever side it comes from."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return maintain.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), keys=["o_custkey"], order=["o_orderdate", "o_orderkey"]) \
        .groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("x")).select("o_custkey", "x.o_orderkey", "x.o_totalprice")


def q_adjoin_duplicates(spark, d):
    """Several lookup rows per key: the dearest order, then the largest key, is injected."""
    c = table(spark, d, "customer").select("c_custkey")
    return joins.adjoin(c, table(spark, d, "orders"), lookup={"o_custkey": "=c_custkey"}, inject=["o_orderkey", "o_orderpriority"],
                        order={"o_totalprice": "desc", "o_orderkey": "desc"})


def q_integer_from_double(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 1e7).alias("big"), F.col("l_extendedprice").alias("price"))
    return apply_engram(li, [{"name": "l_orderkey", "type": "integer"}, {"name": "l_linenumber", "type": "integer"}, {"name": "big", "type": "integer"},
                             {"name": "price", "type": "integer"}])


def q_json_text_coerce(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(
        F.expr("format_number(o_custkey, 0)").alias("k"), F.when(F.col("o_orderstatus") == "F", "Y").otherwise("n").alias("b"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("d"))).alias("doc"))
    typed = apply_engram(o, [{"name": "o_orderkey", "type": "integer"}, {"name": "doc", "type": "map", "fields": [
        {"name": "k", "type": "integer"}, {"name": "b", "type": "boolean"}, {"name": "d", "type": "date"}]}])
    return typed.select("o_orderkey", F.col("doc.k").alias("k"), F.col("doc.b").alias("b"), F.date_format("doc.d", "yyyy-MM-dd").alias("day"))


def q_regex_lookaround(spark, d):
    p = table(spark, d, "part")
    return mutate.mutate(p, map={"p_partkey": "=p_partkey", "behind": ["p_brand", "(?<=#)\\d", "<$0>"], "inner": ["p_name", "\\Ba\\B", "_"],
                                 "every": ["p_brand", ".*", "X"], "twice": ["p_name", "(.)(.)", "$2$1"]})


def q_aggregate_empty(spark, d):
    none = pattern.match(table(spark, d, "lineitem"), {"l_quantity": {"lt": -1}})
    return agg_ops.aggregate(none, aggs={"n": ("count", "*"), "suppliers": ("count_distinct", "l_suppkey"), "most": ("max", "l_quantity")})


def q_ntz_format(spark, d):
    """A zone-less time is UTC wall clock, written directly or through an encoding."""
    ev = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    coded = apply_engram(ev, [{"name": "event_id", "type": "integer"}, {"name": "ts", "type": "date"}]).select("event_id", coerce.iso_utc(F.col("ts")).alias("coded"))
    return ev.select("event_id", coerce.iso_utc(F.col("ts")).alias("direct")).join(coded, "event_id")


def q_coerce_dates_all(spark, d):
    """Every accepted shape of a date."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    shapes = {"iso": "yyyy-MM-dd", "stamp": "yyyy-MM-dd'T'HH:mm:ss'Z'", "us": "MM/dd/yyyy", "us_short": "M/d/yy", "dashed": "MM-dd-yy", "named": "dd-MMM-yy", "named_long": "dd-MMM-yyyy"}
    return o.select("o_orderkey", *[F.date_format(coerce.to_timestamp(F.date_format("day", f)), "yyyy-MM-dd").alias(k) for k, f in shapes.items()],
                    F.date_format(coerce.to_timestamp(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T05:30:00+05:30"))), "yyyy-MM-dd HH:mm").alias("offset"))


def q_order_rank(spark, d):
    """The sorted order itself: ranks follow from the place in the sorted result."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_acctbal") > 500, F.col("s_acctbal")).alias("bal"))
    placed = pattern.order_by(s, {"s_nationkey": "asc", "bal": "desc", "s_suppkey": "asc"}).withColumn("place", F.monotonically_increasing_id())
    from pyspark.sql import Window

    return placed.select("s_suppkey", "s_nationkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("place")).alias("rank"))


def q_patterns(spark, d):
    """Equality, everything, dotted paths and number fields compared with text."""
    o = mutate.compose(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    hit = pattern.match(pattern.match(o, "*"), {"o.orderstatus": {"eq": "F"}, "o.totalprice": {"gte": "150000"}})
    none = pattern.match(o, {"o.orderkey": "abc"})
    return hit.unionByName(none).select(F.col("o.orderkey").alias("o_orderkey"))


def q_contains(spark, d):
    """Squares around customers: which of them hold a point; points and lines hold none."""
    k = (F.col("c_custkey") % 20).cast("string")
    ring = F.concat(F.lit("[["), k, F.lit(",0],["), k, F.lit(",4],[30,4],[30,0],["), k, F.lit(",0]]"))
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "Polygon").when(F.col("c_custkey") % 3 == 1, "LineString").otherwise("Point").alias("t"), ring.alias("ring"), k.alias("k"))
    text = F.when(F.col("t") == "Polygon", F.concat(F.lit("["), F.col("ring"), F.lit("]"))).when(F.col("t") == "LineString", F.col("ring")).otherwise(F.concat(F.lit("["), F.col("k"), F.lit(",0]")))
    g = c.withColumn("geometry", geometry.normalize_geometry(F.col("t"), text))
    first = F.col("geometry.coordinates")[0][0][0][0]
    return g.select("c_custkey", first.alias("x0"), F.coalesce(geometry.contains_point(F.col("geometry"), 10.5, 2.0), F.lit(False)).alias("inside"))


def q_select_values(spark, d):
    """Listed fields in list order; whole values and urns."""
    docs = table(spark, d, "documents").withColumn("urn", expr.urn(F.col("source"), F.col("doc_id")))
    out = mutate.mutate(docs, select=["urn", "lang", "doc_id"])
    return out.select("urn", "lang", expr.urn_realm(F.col("urn")).alias("realm"), expr.urn_name(F.col("urn")).cast("bigint").alias("id"))


def q_missing_values(spark, d):
    """A missing-value token of a whole cell is null; inside longer text it stays."""
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, " * ").otherwise(F.concat(F.col("p_brand"), F.lit("*"))).alias("brand"))
    return apply_engram(p, [{"name": "p_partkey", "type": "integer"}, {"name": "brand", "type": "text"}], missing_value="*")


def q_codify_merge(spark, d):
    """Encodings of two tables merged, in the full and the types-only form."""
    c = codify_ops.codify(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal")))
    s = codify_ops.codify(table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))
    from .plans.engram import normalize_fields

    both = codify_ops.merge_engram(c, s)
    full = codify_ops.format_engram(both, "all")["fields"]
    types = [f["type"] for f in normalize_fields(codify_ops.format_engram(both, "types_only")["fields"])]
    return spark.createDataFrame([(f["name"], f["type"], t) for f, t in zip(full, types)],
                                 T.StructType([T.StructField(n, T.StringType()) for n in ("field", "type", "positional_type")]))


def q_stream_transfer(spark, d):
    """A pipeline over arriving files (availableNow) gives what the batch gives."""
    from .streaming.stream import transfer_stream

    src, out, ck = (_scratch(spark, x) for x in ("arriving", "streamed", "checkpoint"))
    ev = table(spark, d, "events").select("event_id", "ts")
    ev.repartition(4, "event_id").write.parquet(src)
    steps = [{"transform": "filter", "match": {"event_id": {"gte": 100}}}, {"transform": "mutate", "assign": {"tag": "=event_id+'!'"}}]
    transfer_stream(spark, src, steps, out, ck, fmt="parquet", schema=ev.schema).awaitTermination()
    return spark.read.parquet(out).select("event_id", "tag")


QUERIES = {
    "csv_roundtrip": q_csv_roundtrip, "csv_header_order": q_csv_header_order, "csv_separators": q_csv_separators, "json_lines": q_json_lines,
    "sample_head": q_sample_head, "inventory": q_inventory, "split_write": q_split_write, "documents_text": q_documents_text, "load_append": q_load_append,
    "fan_out": q_fan_out, "upsert_insert": q_upsert_insert, "upsert_versioned": q_upsert_versioned, "adjoin_duplicates": q_adjoin_duplicates,
    "integer_from_double": q_integer_from_double, "json_text_coerce": q_json_text_coerce, "regex_lookaround": q_regex_lookaround,
    "aggregate_empty": q_aggregate_empty, "ntz_format": q_ntz_format, "coerce_dates_all": q_coerce_dates_all, "order_rank": q_order_rank,
    "patterns": q_patterns, "contains": q_contains, "select_values": q_select_values, "missing_values": q_missing_values,
    "codify_merge": q_codify_merge, "stream_transfer": q_stream_transfer,
}

_DAY = "strftime(o_orderdate, '%Y-%m-%d')"

ORACLE = {
    "csv_roundtrip": """select doc_id, md5('"a", b' || chr(10) || text) as text_md5, source from documents""",
    "csv_header_order": "select c_custkey as k, c_name as v from customer",
    "csv_separators": "select cast(n_nationkey as bigint) as a, ' ' || n_name || '  ' as b, cast(length(n_name) + 3 as bigint) as b_length from nation",
    "json_lines": """select cast(s_suppkey as bigint) as s_suppkey, s_name, case when s_acctbal > 0 then s_acctbal end as balance,
        's_suppkey/s_name/balance/s_nationkey' as member_order from supplier""",
    "sample_head": "select least(100, count(*)) as n, least(100, count(*)) as n_distinct from orders",
    "inventory": "select true as some, true as sizes, count(*) as n_rows from customer",
    "split_write": """select l_linestatus, count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as decimal(28,2)) as q
        from lineitem group by l_linestatus""",
    "documents_text": """select c_nationkey, md5('{"name":"nation-' || c_nationkey || '","data":['
        || string_agg(to_json({'c_custkey': c_custkey, 'c_name': c_name})::varchar, ',' order by c_custkey) || ']}') as doc_md5
        from customer group by c_nationkey""",
    "load_append": "select n_nationkey, n_name from nation union all select n_nationkey, n_name from nation where n_nationkey < 5",
    "fan_out": """with x as (select count(*) as n, cast(sum(o_orderkey) as bigint) as s from orders where o_orderpriority = '1-URGENT')
        select 'parquet' as sink, n, s from x union all select 'json', n, s from x union all select 'side', n, s from x""",
    "upsert_insert": """select c_custkey, case when c_custkey % 10 = 1 then c_name || '-b' else c_name end as c_name, c_acctbal from customer
        union all select c_custkey + 10000000, c_name, c_acctbal from customer where c_custkey % 10 = 2""",
    "upsert_versioned": """select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (
        partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders) where rn = 1""",
    "adjoin_duplicates": """select c_custkey, o_orderkey, o_orderpriority from customer left join (
        select * from (select o_custkey, o_orderkey, o_orderpriority, row_number() over (
          partition by o_custkey order by o_totalprice desc, o_orderkey desc) rn from orders) where rn = 1) on o_custkey = c_custkey""",
    "integer_from_double": """select cast(l_orderkey as bigint) as l_orderkey, cast(l_linenumber as bigint) as l_linenumber,
        cast(l_quantity * 1e7 as bigint) as big, case when l_extendedprice = floor(l_extendedprice) then cast(l_extendedprice as bigint) end as price
        from lineitem""",
    "json_text_coerce": f"""select cast(o_orderkey as bigint) as o_orderkey, cast(o_custkey as bigint) as k, o_orderstatus = 'F' as b,
        {_DAY} as day from orders""",
    "regex_lookaround": """select p_partkey, regexp_replace(p_brand, '#([0-9])', '#<\\1>') as behind,
        regexp_replace(p_name, '([A-Za-z0-9_])a([A-Za-z0-9_])', '\\1_\\2') as inner, 'X' as every,
        regexp_replace(p_name, '(.)(.)', '\\2\\1') as twice from part""",
    "aggregate_empty": "select cast(0 as bigint) as n, cast(0 as bigint) as suppliers, cast(null as double) as most",
    "ntz_format": """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as direct,
        strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as coded from events""",
    "coerce_dates_all": f"""select o_orderkey, {', '.join(f'{_DAY} as {k}' for k in ('iso', 'stamp', 'us', 'us_short', 'dashed', 'named', 'named_long'))},
        {_DAY} || ' 00:00' as "offset" from orders""",
    "order_rank": """select s_suppkey, s_nationkey, cast(row_number() over (partition by s_nationkey
        order by case when s_acctbal > 500 then s_acctbal end desc nulls last, s_suppkey) as integer) as rank from supplier""",
    "patterns": "select o_orderkey from orders where o_orderstatus = 'F' and o_totalprice >= 150000",
    "contains": """select c_custkey, cast(c_custkey % 20 as double) as x0, c_custkey % 3 = 0 and c_custkey % 20 < 10.5 as inside from customer""",
    "select_values": "select source || ':' || doc_id as urn, lang, source as realm, doc_id as id from documents",
    "missing_values": """select cast(p_partkey as bigint) as p_partkey, case when p_size > 25 then null else p_brand || '*' end as brand from part""",
    "codify_merge": """select * from (values ('key', 'integer', 'integer'), ('name', 'keyword', 'keyword'), ('bal', 'number', 'number'),
        ('nation', 'integer', 'integer')) t(field, type, positional_type)""",
    "stream_transfer": "select event_id, cast(event_id as varchar) || '!' as tag from events where event_id >= 100",
}
