"""The registered queries: each runs one engine operator over the driver tables.

Every query reads whole tables (no id subsets or row caps); ``limit`` appears only in the top-k
query, where it is the feature. Column names match the oracle SQL in ``ORACLE`` exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import coerce
from .operators import aggregate as agg_ops
from .operators import joins, maintain, mutate, pattern, setops
from .sinks.documents import to_documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def q_filter_match_drop(spark, d):
    o = table(spark, d, "orders")
    return pattern.filter_rows(o, {"o_orderpriority": "3-MEDIUM"},
                               {"o_totalprice": {"gt": 100000, "lt": 150000}}).select("o_orderkey", "o_totalprice")


def q_mutate(spark, d):
    c = table(spark, d, "customer")
    return mutate.mutate(c, map={"id": "=c_custkey", "name": "=c_name", "k": "=c_mktsegment+'-'+c_nationkey"},
                         assign={"fie": "unknown"})


def q_mutate_default_remove(spark, d):
    s = table(spark, d, "supplier")
    return mutate.mutate(s, default={"s_acctbal": 0.0, "origin": "=s_name+'@'+s_nationkey"},
                         remove=["s_name"], assign={"tier": "standard"})


def q_adjoin(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = pattern.match(table(spark, d, "customer"), {"c_mktsegment": "FURNITURE"})
    return joins.adjoin(o, c, lookup={"c_custkey": "=o_custkey"}, inject=["c_name", "c_mktsegment"]) \
        .select("o_orderkey", "c_name", "c_mktsegment")


def q_conjoin(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name")
    return joins.conjoin(n, c, on={"c_nationkey": "=n_nationkey"}, fields=["c_custkey", "c_name"]) \
        .select("n_name", "c_custkey", "c_name")


def q_foreach(spark, d):
    # each FURNITURE customer drives a sub-query over its orders; results share one output
    drv = pattern.match(table(spark, d, "customer"), {"c_mktsegment": "FURNITURE"})
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return joins.foreach_join(drv, o, on={"o_custkey": "=c_custkey"})


def q_aggregate(spark, d):
    li = table(spark, d, "lineitem")
    return agg_ops.aggregate(li, by=["l_returnflag", "l_linestatus"], aggs={
        "n": ("count", "*"),
        "q": ("sum", F.col("l_quantity").cast("decimal(18,2)")),
        "mn": ("min", "l_extendedprice"),
        "mx": ("max", "l_extendedprice"),
        "ds": ("count_distinct", "l_suppkey"),
    })


def q_search(spark, d):
    docs = table(spark, d, "documents")
    return pattern.match(docs, {"text": {"search": "the schpfö"}}).select("doc_id", "lang")


def q_search_multifield(spark, d):
    conv = table(spark, d, "conversations")
    return pattern.match(conv, {"_": {"search": "assistant refund", "fields": ["role", "text"]}}) \
        .select("conv_id", "turn")


def q_wildcard(spark, d):
    p = table(spark, d, "part")
    return pattern.match(p, {"p_name": {"wc": "small*"}}).select("p_partkey", "p_name")


def q_topk(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return pattern.top(o, {"o_totalprice": "desc", "o_orderkey": "asc"}, 10)


def q_sync(spark, d):
    ev = table(spark, d, "events")
    dst = pattern.match(ev, {"ts": {"lt": "2024-01-15 00:00:00"}})
    return maintain.sync_increment(ev, dst, "ts").select("event_id", "ts")


def q_upsert(spark, d):
    c = table(spark, d, "customer")
    changes = pattern.match(c, {"c_mktsegment": "FURNITURE"}).withColumn("c_acctbal", F.lit(0.0))
    return maintain.upsert(c, changes, keys=["c_custkey"])


def q_compare(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return setops.compare(c, s)


def q_json_path(spark, d):
    # the JSON text column is typed by an encoding (a nested map field), then read by dotted path
    from .plans.engram import apply_engram

    ev = apply_engram(table(spark, d, "events"), {"fields": [
        {"name": "event_id", "type": "integer"},
        {"name": "props", "type": "map", "fields": [{"name": "k", "type": "integer"}]}]})
    return mutate.mutate(ev, map={"event_id": "=event_id", "k": "=props.k"}).select(
        "event_id", F.col("k").cast("int").alias("k"))


def q_regex(spark, d):
    p = table(spark, d, "part")
    return mutate.mutate(p, map={"p_partkey": "=p_partkey", "brand": ["p_brand", "Brand#(.*)", "0$1"]})


def q_coerce_date(spark, d):
    o = table(spark, d, "orders")
    txt = F.date_format("o_orderdate", "MM/dd/yyyy")
    parsed = coerce.to_timestamp(txt)
    # rendered in the session zone: a month-first date is local midnight wherever the job runs
    return o.select("o_orderkey", txt.alias("txt"), F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("iso"))


def q_coerce_number(spark, d):
    o = table(spark, d, "orders")
    txt = F.expr("format_number(o_totalprice, '#,##0.##########')")
    return o.select("o_orderkey", coerce.to_number(txt).alias("val"),
                    coerce.to_integer(F.format_number(F.floor("o_totalprice"), 0)).alias("whole"))


def q_coerce_boolean(spark, d):
    lab = table(spark, d, "labels")
    yn = F.when(F.col("toxic") == 1, F.lit(" Y")).otherwise(F.lit("n "))
    tf = F.when(F.col("quality") == 1, F.lit("TRUE")).otherwise(F.lit("false"))
    return lab.select("doc_id", coerce.to_boolean(yn).alias("toxic_b"), coerce.to_boolean(tf).alias("quality_b"))


def q_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return setops.union_all([c, s])


def q_documents(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name")
    parts = to_documents(c, {"name": "nation-${c_nationkey}", "data": []}, "data", by=["c_nationkey"],
                         row_json=F.to_json(F.struct("c_custkey", "c_name")))
    return parts.groupBy("c_nationkey").agg(
        F.sum(F.when(F.col("part") == 1, 1).otherwise(0)).alias("n_items"),
        F.sum(F.length("text")).alias("doc_chars"))


def q_dull(spark, d):
    li = table(spark, d, "lineitem")
    return maintain.dull(li, {"l_returnflag": "R", "l_discount": {"gte": 0.05}}).select("l_orderkey", "l_linenumber")


def q_dull_count(spark, d):
    li = table(spark, d, "lineitem")
    return maintain.dull_count(li, {"l_returnflag": "R", "l_discount": {"gte": 0.05}})


def q_list_membership(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.split("c_name", "#").alias("parts"))
    return pattern.match(c, {"parts": "Customer"}).select("c_custkey")


def q_split_counts(spark, d):
    li = table(spark, d, "lineitem")
    return agg_ops.aggregate(li, by=["l_linestatus"], aggs={"n": ("count", "*")})


def q_order(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return pattern.retrieve(s, {"match": {"s_acctbal": {"gt": 0}}, "order": {"s_nationkey": "asc", "s_acctbal": "desc"}})


def q_codify(spark, d):
    from .operators.codify import codify_frame

    return codify_frame(table(spark, d, "part")).select("field", "type", "size")


def q_profile(spark, d):
    from .operators.codify import profile

    return profile(table(spark, d, "customer"))


def q_scan_many(spark, d):
    from .sources.files import scan_many

    many = scan_many(spark, d, "*.parquet", exclude=["documents*", "pages*"])
    return many.groupBy("schema").agg(F.count(F.lit(1)).alias("n"))


def q_template(spark, d):
    o = table(spark, d, "orders")
    return mutate.mutate(o, map={"o_orderkey": "=o_orderkey",
                                 "url": "https://orders.example/${o_custkey}/${o_orderkey}?p=${o_orderpriority}"})


def q_rename_flatten(spark, d):
    c = table(spark, d, "customer")
    nested = mutate.rename(c, {"c_custkey": "id", "c_name": "info.name", "c_mktsegment": "info.segment",
                               "c_nationkey": "info.nation"})
    return mutate.flatten(nested)


def q_codify_nested(spark, d):
    from .operators.codify import codify_frame

    o = mutate.compose(table(spark, d, "orders"))
    return codify_frame(o).select("field", "type", "size")


def q_coerce_encoding(spark, d):
    # lineitem rendered as text the way loose files carry it, then typed back by an encoding
    from .plans.engram import apply_engram

    li = table(spark, d, "lineitem")
    txt = li.select(
        F.concat(F.lit(" "), F.col("l_orderkey").cast("string")).alias("l_orderkey"),
        F.col("l_linenumber").cast("string").alias("l_linenumber"),
        F.expr("format_number(l_extendedprice, '#,##0.##########')").alias("l_extendedprice"),
        F.date_format("l_shipdate", "M/d/yy").alias("l_shipdate"),
        F.when(F.col("l_returnflag") == "R", F.lit("Y")).otherwise(F.lit("n")).alias("returned"))
    typed = apply_engram(txt, {"fields": [
        {"name": "l_orderkey", "type": "integer"}, {"name": "l_linenumber", "type": "integer"},
        {"name": "l_extendedprice", "type": "number"}, {"name": "l_shipdate", "type": "date"},
        {"name": "returned", "type": "boolean"}]})
    return typed.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


def q_adjoin_ordered(spark, d):
    # several orders per customer: the earliest (then lowest key) is injected, row count kept
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    o = table(spark, d, "orders")
    return joins.adjoin(c, o, lookup={"o_custkey": "=c_custkey"}, inject=["o_orderkey", "o_totalprice"],
                        order=["o_orderdate", "o_orderkey"])


def q_adjoin_lineitem(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = table(spark, d, "part")
    return joins.adjoin(li, p, lookup={"p_partkey": "=l_partkey"}, inject=["p_brand", "p_size"]) \
        .drop("l_partkey")


def q_retrieve(spark, d):
    docs = table(spark, d, "documents")
    return pattern.retrieve(docs, {"match": {"lang": "en", "text": {"search": "the"}},
                                   "fields": ["doc_id", "n_chars"],
                                   "order": {"n_chars": "desc", "doc_id": "asc"}, "count": 20})


def q_pick(spark, d):
    from .sources.files import pick

    e = table(spark, d, "embeddings")
    out = pick(e, "embedding", keep=["vec_id"], position="pos")
    return out.select("vec_id", "pos", F.col("value").cast("double").alias("value"))


def q_union_missing(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                                           F.col("c_acctbal").alias("bal"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"),
                                         F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return setops.union_all([c, s, n])


def q_dull_search(spark, d):
    docs = table(spark, d, "documents")
    return maintain.dull(docs, {"text": {"search": "license token"}}).select("doc_id", "lang")


def q_mutate_nested(spark, d):
    o = mutate.compose(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    o = mutate.mutate(o, assign={"o.flag": "=o.orderstatus+'/'+o.orderkey"}, remove=["o.totalprice"])
    return mutate.flatten(o)


def q_compare_counts(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return setops.compare_counts(c, s)


def q_page_domains(spark, d):
    pages = table(spark, d, "pages")
    hosts = mutate.mutate(pages, map={"domain": ["url", "^[a-z]+://([^/?#]+).*$", "$1"]})
    return agg_ops.aggregate(hosts, by=["domain"], aggs={"n": ("count", "*")})


def q_labels_by_lang(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    labels = table(spark, d, "labels")
    joined = joins.adjoin(docs, labels, lookup={"doc_id": "=doc_id"}, inject=["quality", "toxic"])
    return agg_ops.aggregate(joined, by=["lang"], aggs={
        "n_docs": ("count", "*"), "n_labelled": ("count", "quality"),
        "n_quality": ("sum", "quality"), "n_toxic": ("sum", "toxic")})


QUERIES = {
    "filter_match_drop": q_filter_match_drop,
    "mutate": q_mutate,
    "mutate_default_remove": q_mutate_default_remove,
    "adjoin": q_adjoin,
    "conjoin": q_conjoin,
    "foreach": q_foreach,
    "aggregate": q_aggregate,
    "search": q_search,
    "search_multifield": q_search_multifield,
    "wildcard": q_wildcard,
    "topk": q_topk,
    "sync": q_sync,
    "upsert": q_upsert,
    "compare": q_compare,
    "json_path": q_json_path,
    "regex": q_regex,
    "coerce_date": q_coerce_date,
    "coerce_number": q_coerce_number,
    "coerce_boolean": q_coerce_boolean,
    "union": q_union,
    "documents": q_documents,
    "dull": q_dull,
    "dull_count": q_dull_count,
    "list_membership": q_list_membership,
    "split_counts": q_split_counts,
    "order": q_order,
    "codify": q_codify,
    "profile": q_profile,
    "scan_many": q_scan_many,
    "template": q_template,
    "rename_flatten": q_rename_flatten,
    "codify_nested": q_codify_nested,
    "coerce_encoding": q_coerce_encoding,
    "adjoin_ordered": q_adjoin_ordered,
    "adjoin_lineitem": q_adjoin_lineitem,
    "retrieve": q_retrieve,
    "pick": q_pick,
    "union_missing": q_union_missing,
    "dull_search": q_dull_search,
    "mutate_nested": q_mutate_nested,
    "compare_counts": q_compare_counts,
    "page_domains": q_page_domains,
    "labels_by_lang": q_labels_by_lang,
}


def _codify_sql(col: str, table_name: str, kind: str) -> str:
    if kind == "number":  # whole values of a fractional column count as integers
        return (f"select '{col}' as field, case when count({col}) > 0 and count(case when {col} = floor({col}) "
                f"then 1 end) = count({col}) then 'integer' else 'number' end as type, "
                f"cast(null as bigint) as size from {table_name}")
    if kind != "string":
        return f"select '{col}' as field, '{kind}' as type, cast(null as bigint) as size from {table_name}"
    v = f"nullif(trim({col}), '')"
    return f"""select '{col}' as field, case
          when count({v}) = 0 then 'text'
          when count(try_cast(replace({v}, ',', '') as bigint)) = count({v}) then 'integer'
          when count(try_cast(replace({v}, ',', '') as double)) = count({v}) then 'number'
          when count(case when lower({v}) in ('true', 'false') then 1 end) = count({v}) then 'boolean'
          when max(length({col})) <= 64 and not bool_or(regexp_matches({col}, '\\s')) then 'keyword'
          else 'text' end as type,
        case when count({v}) > 0 then max(length({col})) end as size from {table_name}"""


def _codify_oracle() -> str:
    cols = [("p_partkey", "integer"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
            ("p_size", "integer"), ("p_retailprice", "number")]
    sel = [_codify_sql(c, "part", k) + (" limit 1" if k not in ("string", "number") else "") for c, k in cols]
    return "\nunion all\n".join(f"({q})" for q in sel)


def _profile_oracle() -> str:
    cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    return "\nunion all\n".join(
        f"select '{c}' as field, count(*) as n_rows, count(*) - count({c}) as n_null, "
        f"cast(max(length(cast({c} as varchar))) as bigint) as max_len from customer" for c in cols)


def _codify_nested_oracle() -> str:
    cols = [("orderkey", "integer"), ("custkey", "integer"), ("orderstatus", "string"), ("totalprice", "number"),
            ("orderdate", "date"), ("orderpriority", "string")]
    parts = ["select 'o' as field, 'map' as type, cast(null as bigint) as size"]
    for c, k in cols:
        q = _codify_sql(f"o_{c}", "orders", k).replace(f"select 'o_{c}' as field", f"select 'o.{c}' as field")
        parts.append(q + (" limit 1" if k not in ("string", "number") else ""))
    return "\nunion all\n".join(f"({q})" for q in parts)


_SCANNED = ["benchmark", "conversations", "customer", "embeddings", "events", "labels", "lineitem", "nation",
            "orders", "part", "region", "supplier"]

ORACLE = {
    "filter_match_drop": """select o_orderkey, o_totalprice from orders
        where o_orderpriority = '3-MEDIUM' and not coalesce(o_totalprice > 100000 and o_totalprice < 150000, false)""",
    "mutate": """select 'unknown' as fie, c_custkey as id, c_name as name,
        concat(c_mktsegment, '-', cast(c_nationkey as varchar)) as k from customer""",
    "mutate_default_remove": """select concat(s_name, '@', cast(s_nationkey as varchar)) as origin, s_suppkey, s_nationkey,
        coalesce(s_acctbal, 0.0) as s_acctbal, 'standard' as tier from supplier""",
    "adjoin": """select o.o_orderkey, c.c_name, c.c_mktsegment from orders o left join (
          select * from (select c_custkey, c_name, c_mktsegment,
                 row_number() over (partition by c_custkey order by c_name, c_mktsegment) rn
                 from customer where c_mktsegment = 'FURNITURE') where rn = 1) c
        on o.o_custkey = c.c_custkey""",
    "conjoin": """select n_name, c_custkey, c_name from nation join customer on n_nationkey = c_nationkey""",
    "foreach": """select o_orderkey, o_custkey, o_totalprice from customer join orders on o_custkey = c_custkey
        where c_mktsegment = 'FURNITURE'""",
    "aggregate": """select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as decimal(28,2)) as q,
        min(l_extendedprice) as mn, max(l_extendedprice) as mx, count(distinct l_suppkey) as ds
        from lineitem group by l_returnflag, l_linestatus""",
    "search": """select doc_id, lang from documents
        where list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['the', 'schpfö'])""",
    "search_multifield": """select conv_id, turn from conversations
        where list_has_any(regexp_split_to_array(lower(role), '[^\\p{L}\\p{N}]+'), ['assistant', 'refund'])
           or list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['assistant', 'refund'])""",
    "wildcard": """select p_partkey, p_name from part where p_name like 'small%'""",
    "topk": """select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10""",
    "sync": """select event_id, ts from events
        where ts > (select max(ts) from events where ts < timestamp '2024-01-15 00:00:00')""",
    "upsert": """select c_custkey, c_name, c_nationkey,
        case when c_mktsegment = 'FURNITURE' then 0.0 else c_acctbal end as c_acctbal, c_mktsegment from customer""",
    "compare": """select nationkey, 'expected_only' as side from (
          select c_nationkey as nationkey from customer except all select s_nationkey from supplier)
        union all
        select nationkey, 'actual_only' as side from (
          select s_nationkey as nationkey from supplier except all select c_nationkey from customer)""",
    "json_path": """select event_id, try_cast(json_extract_string(props, '$.k') as integer) as k from events""",
    "regex": """select p_partkey, regexp_replace(p_brand, 'Brand#(.*)', '0\\1') as brand from part""",
    "coerce_date": """select o_orderkey, strftime(o_orderdate, '%m/%d/%Y') as txt,
        strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S') as iso from orders""",
    "coerce_number": """select o_orderkey, o_totalprice as val, cast(floor(o_totalprice) as bigint) as whole from orders""",
    "coerce_boolean": """select doc_id, toxic = 1 as toxic_b, quality = 1 as quality_b from labels""",
    "union": """select c_custkey as key, c_name as name from customer
        union all select s_suppkey as key, s_name as name from supplier""",
    "documents": """select c_nationkey, count(*) as n_items,
        cast(length('{"name":"nation-' || cast(c_nationkey as varchar) || '","data":[')
          + sum(length(to_json({'c_custkey': c_custkey, 'c_name': c_name}))) + count(*) - 1 + length(']}') as bigint)
          as doc_chars
        from customer group by c_nationkey""",
    "dull": """select l_orderkey, l_linenumber from lineitem
        where not coalesce(l_returnflag = 'R' and l_discount >= 0.05, false)""",
    "dull_count": """select count(*) as deleted from lineitem where l_returnflag = 'R' and l_discount >= 0.05""",
    "list_membership": """select c_custkey from customer where list_contains(string_split(c_name, '#'), 'Customer')""",
    "split_counts": """select l_linestatus, count(*) as n from lineitem group by l_linestatus""",
    "order": """select s_suppkey, s_nationkey, s_acctbal from supplier where s_acctbal > 0""",
    "codify": _codify_oracle(),
    "profile": _profile_oracle(),
    "scan_many": "\nunion all\n".join(f"select '{t}' as schema, count(*) as n from {t}" for t in _SCANNED),
    "template": """select o_orderkey, 'https://orders.example/' || cast(o_custkey as varchar) || '/'
        || cast(o_orderkey as varchar) || '?p=' || o_orderpriority as url from orders""",
    "rename_flatten": """select c_custkey as id, c_name as info_name, c_mktsegment as info_segment,
        c_nationkey as info_nation from customer""",
    "codify_nested": _codify_nested_oracle(),
    "coerce_encoding": """select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_extendedprice,
        strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as l_shipdate, l_returnflag = 'R' as returned from lineitem""",
    "adjoin_ordered": """select c_custkey, c_name, o_orderkey, o_totalprice from customer left join (
          select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (
            partition by o_custkey order by o_orderdate, o_orderkey) rn from orders) where rn = 1) o
        on o.o_custkey = c_custkey""",
    "adjoin_lineitem": """select l_orderkey, l_linenumber, p_brand, p_size from lineitem
        left join part on p_partkey = l_partkey""",
    "retrieve": """select doc_id, n_chars from documents where lang = 'en'
        and list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['the'])
        order by n_chars desc, doc_id limit 20""",
    "pick": """select vec_id, cast(unnest(range(len(embedding))) as integer) as pos, cast(unnest(embedding) as double) as value
        from embeddings""",
    "union_missing": """select c_custkey as key, c_name as name, c_acctbal as bal, cast(null as integer) as region
          from customer
        union all select s_suppkey, s_name, null, null from supplier
        union all select n_nationkey, n_name, null, n_regionkey from nation""",
    "dull_search": """select doc_id, lang from documents where not coalesce(
        list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['license', 'token']), false)""",
    "mutate_nested": """select o_orderkey as o_orderkey, o_orderstatus as o_orderstatus,
        o_orderstatus || '/' || cast(o_orderkey as varchar) as o_flag from orders""",
    "compare_counts": """select coalesce(e.k, a.k) as nationkey, coalesce(e.n, 0) as n_expected, coalesce(a.n, 0) as n_actual
        from (select c_nationkey k, count(*) n from customer group by 1) e
        full outer join (select s_nationkey k, count(*) n from supplier group by 1) a on e.k = a.k
        where coalesce(e.n, 0) != coalesce(a.n, 0)""",
    "page_domains": """select regexp_replace(url, '^[a-z]+://([^/?#]+).*$', '\\1') as domain, count(*) as n
        from pages group by 1""",
    "labels_by_lang": """select lang, count(*) as n_docs, count(quality) as n_labelled,
        cast(sum(quality) as bigint) as n_quality, cast(sum(toxic) as bigint) as n_toxic
        from documents left join labels using (doc_id) group by lang""",
}
