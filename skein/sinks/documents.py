"""Template-document sink: rows injected as a JSON array into a JSON template.

A document may hold any number of rows, so it is never built in one row or one task. The
operator emits the document as ordered *parts* -- head, one part per element, tail -- and the
writer range-partitions them by (group, part, seq, sub), so the concatenation of the part files
of a group, in file-name order, is the document.

Everything is derived from row content, so a recomputed task (after a lost executor) produces
exactly the same parts: identical elements are collapsed to one row with a count (a partial
aggregate), elements are ordered by the optional ``order`` fields and then a content hash, the
first element of a document (the one without a leading comma) is the ``min`` of that order, and
duplicate copies are regenerated by a streamed replicate.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import template_expr
from ..functions.paths import col_path, quote_part

_MARK = "\u0000__rows__\u0000"


def _split_template(template, store_to: str | None, params: dict | None) -> tuple[str, str]:
    if store_to is None:  # the rows are the whole document: a top-level array
        return "[", "]"
    doc = json.loads(json.dumps(template))
    node = doc
    parts = store_to.split(".")
    for p in parts[:-1]:
        node = node.setdefault(p, {})
    node[parts[-1]] = _MARK
    text = json.dumps(doc, ensure_ascii=False, separators=(",", ":"))
    for k, v in (params or {}).items():
        text = text.replace("${" + k + "}", str(v))
    head, tail = text.split(json.dumps(_MARK))
    return head + "[", "]" + tail


def to_documents(df: DataFrame, template, store_to: str | None, by: list[str] | None = None,
                 params: dict | None = None, row_json=None, order: list[str] | None = None) -> DataFrame:
    """Document parts: columns ``by..., part (0 head / 1 element / 2 tail), seq, sub, text``.

    ``${name}`` in the template is replaced from ``params`` (constants) or, per document, from the
    ``by`` columns. ``row_json`` overrides the element text (default ``to_json(struct(*))``);
    ``order`` lists fields that order the elements (otherwise the order is by content).
    ``store_to=None`` makes the document a bare JSON array.
    """
    from ..operators.setops import replicate

    by = by or []
    qby = [quote_part(b) for b in by]
    head, tail = _split_template(template, store_to, params)
    body = row_json if row_json is not None else F.to_json(F.struct(*[F.col(quote_part(c)) for c in df.columns]))
    okey = F.struct(*[col_path(o, df).alias(f"o{i}") for i, o in enumerate(order)]) if order else F.lit(0)
    rows = df.select(*qby, okey.alias("__o"), body.alias("__j"))
    # identical elements of one document become one row with a count
    dup = rows.groupBy(*qby, "__o", "__j").agg(F.count(F.lit(1)).alias("__k"))
    dup = dup.withColumn("seq", F.struct(F.col("__o").alias("o"), F.xxhash64("__j").alias("h"), F.col("__j").alias("j")))
    if by:
        firsts = dup.groupBy(*qby).agg(F.min("seq").alias("__first"))
        dup = dup.join(firsts, by, "inner")
        g = firsts.select(*qby)  # one row per document
    else:
        dup = dup.withColumn("__first", dup.select(F.min("seq")).scalar())
        g = dup.agg(F.count(F.lit(1)).alias("__c")).select()  # exactly one row, even with no data
    is_first = F.col("seq") == F.col("__first")
    first = dup.where(is_first).select(*qby, F.lit(1).alias("part"), "seq", F.lit(0).alias("sub"),
                                       F.col("__j").alias("text"))
    rest = dup.select(*qby, F.lit(1).alias("part"), "seq", F.lit(1).alias("sub"),
                      F.concat(F.lit(","), F.col("__j")).alias("text"),
                      F.when(is_first, F.col("__k") - 1).otherwise(F.col("__k")).alias("__n"))
    elems = first.unionByName(replicate(rest, "__n"))
    no_seq = F.lit(None).cast(dup.schema["seq"].dataType)
    heads = g.select(*qby, F.lit(0).alias("part"), no_seq.alias("seq"), F.lit(0).alias("sub"),
                     template_expr(head, g).alias("text"))
    tails = g.select(*qby, F.lit(2).alias("part"), no_seq.alias("seq"), F.lit(0).alias("sub"),
                     template_expr(tail, g).alias("text"))
    return heads.unionByName(elems).unionByName(tails)


def write_documents(parts: DataFrame, path: str, by: list[str] | None = None, num_partitions: int | None = None):
    """Write parts so that each group's files, concatenated in name order, form its document."""
    by = by or []
    order = [quote_part(b) for b in by] + ["part", "seq", "sub"]
    n = num_partitions or parts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    out = parts.repartitionByRange(int(n), *order).sortWithinPartitions(*order).select(*[quote_part(b) for b in by], "text")
    w = out.write.mode("overwrite")  # parts end in newlines: JSON whitespace
    if by:
        w = w.partitionBy(*by)
    w.text(path)
