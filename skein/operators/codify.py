"""Schema inference (``codify``) and field profiling, each one Spark job over all fields.

Every value -- including fields inside structs and elements of arrays -- is unpivoted into a
``(field index, value)`` cell; one expression classifies each cell (integer, number, boolean,
date, text) and a grouped partial aggregate counts the classes per field, with the longest text
and whether any text has whitespace. The generated code stays the same size however many
fields there are, and only a few rows per task are shuffled. Types follow a lattice:
integer < number, and keyword < text for strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce
from ..functions.paths import quote_part
from ..plans.engram import normalize_fields, type_name

# The keyword/text border for inferred strings.
KEYWORD_MAX = 64

_FRACTIONAL = (T.DoubleType, T.FloatType, T.DecimalType)


def _getter(name: str):
    return lambda x: x.getField(name)


def _clean(v: Column, missing: str | None) -> Column:
    s = v.cast("string")
    if missing is not None:
        s = coerce.missing_to_null(s, missing)
    return F.when(F.trim(s) == "", F.lit(None)).otherwise(s)


def _kind(x: Column, has_digit: Column) -> Column:
    """Kind code of one cleaned text value, first match wins: ``i`` integer, ``n`` number,
    ``b`` boolean, ``d`` date, ``s`` other text. The kinds are disjoint apart from integer being
    a number, so one CASE per value replaces a separate parse per candidate type; values without
    a digit skip the number and date parsers (the boolean words have none)."""
    return (F.when(x.isNull(), F.lit(None))
            .when(has_digit & coerce.to_integer(x).isNotNull(), F.lit("i"))
            .when(has_digit & coerce.to_number(x).isNotNull(), F.lit("n"))
            .when(~has_digit & coerce.to_boolean(x, coerce.INFER_TRUE_WORDS, coerce.INFER_FALSE_WORDS).isNotNull(),
                  F.lit("b"))
            .when(has_digit & coerce.to_timestamp(x).isNotNull(), F.lit("d"))
            .otherwise(F.lit("s")))


# category codes of unpivoted cells
_TEXT, _FRACTION, _TYPED, _MAP, _LIST = 0, 1, 2, 3, 4
_CELL = T.StructType([
    T.StructField("idx", T.IntegerType()), T.StructField("cat", T.IntegerType()),
    T.StructField("t", T.StringType()), T.StructField("d", T.DoubleType()),
    T.StructField("p", T.BooleanType()), T.StructField("len", T.IntegerType()),
    T.StructField("pc", T.ArrayType(T.IntegerType())),
])


class _Entry:
    """One field position in the schema: a leaf or a container, with how to reach its values."""

    def __init__(self, path, cat, value, multi, dtype):
        self.path, self.cat, self.value, self.multi, self.dtype = path, cat, value, multi, dtype


def _entries(schema: T.StructType, skip: list[str]) -> list[_Entry]:
    out: list[_Entry] = []

    def walk(dtype, value, path, multi):
        if isinstance(dtype, T.StructType):
            out.append(_Entry(path, _MAP, value, multi, dtype))
            for f in dtype.fields:
                sub = F.transform(value, _getter(f.name)) if multi else value.getField(f.name)
                walk(f.dataType, sub, path + [f.name], multi)
        elif isinstance(dtype, T.ArrayType):
            out.append(_Entry(path, _LIST, value, multi, dtype))
            walk(dtype.elementType, F.flatten(value) if multi else value, path + ["_list"], True)
        elif isinstance(dtype, T.MapType):
            out.append(_Entry(path, _MAP, value, multi, dtype))
        elif isinstance(dtype, T.StringType):
            out.append(_Entry(path, _TEXT, value, multi, dtype))
        elif isinstance(dtype, _FRACTIONAL):
            out.append(_Entry(path, _FRACTION, value, multi, dtype))
        else:
            out.append(_Entry(path, _TYPED, value, multi, dtype))

    for f in schema.fields:
        if f.name not in skip:
            walk(f.dataType, F.col(quote_part(f.name)), [f.name], False)
    return out


def _cells(i: int, e: _Entry) -> Column:
    """The values of one entry as an array of cells (one per value; arrays give one per element)."""

    def cell(x):
        return F.struct(
            F.lit(i).alias("idx"), F.lit(e.cat).alias("cat"),
            (x.cast("string") if e.cat == _TEXT else F.lit(None).cast("string")).alias("t"),
            (x.cast("double") if e.cat == _FRACTION else F.lit(None).cast("double")).alias("d"),
            x.isNotNull().alias("p"),
            (F.length(x) if e.cat == _TEXT else F.lit(None).cast("int")).alias("len"),
            F.lit(None).cast("array<int>").alias("pc"))

    if e.multi:
        return F.coalesce(F.transform(e.value, cell), F.array().cast(T.ArrayType(_CELL)))
    return F.array(cell(e.value))


def _presence(e: _Entry) -> Column:
    """How many values of a presence-only entry this row holds (array elements count singly)."""
    if e.multi:
        return F.coalesce(F.size(F.filter(e.value, lambda x: x.isNotNull())), F.lit(0))
    return F.when(e.value.isNotNull(), F.lit(1)).otherwise(F.lit(0))


def codify_frame(df: DataFrame, missing: str | None = None, keyword_max: int = KEYWORD_MAX,
                 by: list[str] | None = None) -> DataFrame:
    """One row per field: ``field`` (dotted path, ``_list`` for array elements), ``type``,
    ``size``, ``pos`` (declaration order) and ``n`` (values present). Containers are ``map`` /
    ``list`` rows before their members.

    Every text or fractional value is first unpivoted to a ``(field index, value)`` cell, so the
    type test is ONE expression over one column whatever the number of fields (per-field
    expressions inlined side by side outgrow the JVM's 64 KB method limit and drop out of
    generated code). Fields whose type is already known (integers, dates, containers) only need
    a presence count: they ride along as one array of counts on a single extra cell per row.
    Cells are counted per field by a partial aggregate: one job, a few rows per task shuffled.
    With ``by`` the counters are kept per group (e.g. per file of a many-file scan).
    """
    by = list(by or [])
    qby = [quote_part(b) for b in by]
    entries = _entries(df.schema, by)
    if not entries:
        return df.sparkSession.createDataFrame([], "field string, type string, size bigint, pos int, n bigint")
    valued = [(i, e) for i, e in enumerate(entries) if e.cat in (_TEXT, _FRACTION)]
    counted = [(i, e) for i, e in enumerate(entries) if e.cat not in (_TEXT, _FRACTION)]
    arrays = [_cells(i, e) for i, e in valued]
    if counted:
        arrays.append(F.array(F.struct(
            F.lit(-1).alias("idx"), F.lit(-1).alias("cat"), F.lit(None).cast("string").alias("t"),
            F.lit(None).cast("double").alias("d"), F.lit(True).alias("p"), F.lit(None).cast("int").alias("len"),
            F.array(*[_presence(e) for _, e in counted]).alias("pc"))))
    cells = df.select(*qby, F.inline(F.concat(*arrays)))
    # cleaned text and its digit test are columns of their own, so each is computed once per cell
    cells = cells.withColumn("t", _clean(F.col("t"), missing))
    cells = cells.withColumn("dig", F.translate(F.col("t"), "0123456789", "") != F.col("t"))
    clean = F.col("t")
    kind = (F.when(F.col("cat") == _TEXT, _kind(clean, F.col("dig")))
            .when(F.col("cat") == _FRACTION,
                  F.when(F.col("d").isNull(), F.lit(None)).when(F.col("d") == F.floor("d"), F.lit("i"))
                  .otherwise(F.lit("n")))
            .when(F.col("p"), F.lit("x")))
    # the kind is computed once per cell in a projection; the counters only compare codes
    coded = cells.select(*qby, "idx", "cat", kind.alias("k"),
                         F.when(F.col("cat") == _TEXT, clean.rlike(r"\s")).alias("w"), "len", "pc")
    k = F.col("k")
    stats = coded.groupBy(*qby, "idx", "cat").agg(
        F.count(k).alias("n"),
        F.count(F.when(k == "i", F.lit(1))).alias("n_int"),
        F.count(F.when(k.isin("i", "n"), F.lit(1))).alias("n_num"),
        F.count(F.when(k == "b", F.lit(1))).alias("n_bool"),
        F.count(F.when(k == "d", F.lit(1))).alias("n_date"),
        F.max("len").alias("max_len"),
        F.count(F.when(F.col("w"), F.lit(1))).alias("n_ws"),
        *[F.sum(F.col("pc")[j]).alias(f"__pc{j}") for j in range(len(counted))])
    order = {tuple(p): j for j, p in enumerate(sorted([e.path for e in entries], key=lambda p: _position(df.schema, p)))}
    lookup = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("idx") + 1)
    names = lookup([".".join(e.path) for e in entries])
    typed = lookup([type_name(e.dtype) for e in entries])
    pos = lookup([order[tuple(e.path)] for e in entries])
    n, cat = F.col("n"), F.col("cat")
    text_type = (F.when(n == 0, F.lit("text"))
                 .when(F.col("n_int") == n, F.lit("integer"))
                 .when(F.col("n_num") == n, F.lit("number"))
                 .when(F.col("n_bool") == n, F.lit("boolean"))
                 .when(F.col("n_date") == n, F.lit("date"))
                 .when((F.col("n_ws") == 0) & (F.col("max_len") <= keyword_max), F.lit("keyword"))
                 .otherwise(F.lit("text")))
    ftype = (F.when(cat == _MAP, F.lit("map")).when(cat == _LIST, F.lit("list")).when(cat == _TYPED, typed)
             .when(cat == _FRACTION, F.when((n > 0) & (F.col("n_int") == n), F.lit("integer")).otherwise(F.lit("number")))
             .otherwise(text_type))
    size = F.when((cat == _TEXT) & (n > 0) & ftype.isin("keyword", "text"), F.col("max_len").cast("bigint"))
    value_row = F.struct(names.alias("field"), ftype.alias("type"), size.alias("size"), pos.cast("int").alias("pos"),
                         n.alias("n"))
    if not counted:
        return stats.select(*qby, F.inline(F.array(value_row)))
    kinds = {_MAP: "map", _LIST: "list"}
    presence_rows = [F.struct(F.lit(".".join(e.path)).alias("field"), F.lit(kinds.get(e.cat, type_name(e.dtype))).alias("type"),
                              F.lit(None).cast("bigint").alias("size"), F.lit(order[tuple(e.path)]).cast("int").alias("pos"),
                              F.col(f"__pc{j}").cast("bigint").alias("n"))
                     for j, (_, e) in enumerate(counted)]
    # both kinds of output rows come from the one aggregate (a union of filtered branches would
    # have the filters pushed below the aggregate and scan the input twice)
    rows = F.when(F.col("idx") >= 0, F.array(value_row)).otherwise(F.array(*presence_rows))
    return stats.select(*qby, F.inline(rows))


def _position(schema: T.StructType, path: list[str]) -> tuple:
    """Sort key: declaration order along the path."""
    key, dt = [], schema
    for p in path:
        if isinstance(dt, T.ArrayType):
            dt = dt.elementType
        if p == "_list":
            key.append(-1)
            continue
        if isinstance(dt, T.StructType):
            key.append(dt.fieldNames().index(p))
            dt = dt[p].dataType
    return tuple(key)


def codify(df: DataFrame, missing: str | None = None, format: str | None = None, name: str | None = None,
           prime: dict | None = None, keyword_max: int = KEYWORD_MAX, sample: int | None = None) -> dict:
    """Infer an engram. The profile is one Spark job; only its rows (one per field) reach the
    driver. ``sample`` limits the rows profiled (the source's ``count`` option); ``prime``
    merges the result into an existing encoding; ``format`` is ``"types_only"``, ``"all"`` or
    default (name, type, size only)."""
    src = df.limit(int(sample)) if sample else df
    rows = sorted(codify_frame(src, missing, keyword_max).collect(), key=lambda r: r["pos"])
    fields = _tree(rows)
    eng = {"name": name or "codify", "type": "engram", "fields": fields}
    if prime:
        eng["fields"] = merge_fields(normalize_fields(prime.get("fields", prime)), fields)
    return format_engram(eng, format)


#: datasets whose encodings codify_each makes at once
MAX_GROUPS = 10_000


def codify_each(df: DataFrame, by: str = "schema", missing: str | None = None,
                keyword_max: int = KEYWORD_MAX) -> dict:
    """One encoding per value of ``by`` (e.g. per dataset of :func:`scan_many`), from a single
    grouped aggregate; leaf fields a group has no values for are left out of its encoding.
    Groups are datasets, as of a scan: the encodings (groups x fields rows) are made on the driver, and
    more than MAX_GROUPS groups raise; for values of data use ``codify_frame(by=)``, a DataFrame."""
    found = codify_frame(df, missing, keyword_max, by=[by])
    if found.select(by).distinct().limit(MAX_GROUPS + 1).count() > MAX_GROUPS:
        raise ValueError(f"codify_each over more than {MAX_GROUPS} groups: use codify_frame(by=...)")
    rows = found.collect()
    out: dict = {}
    for key in sorted({r[by] for r in rows}, key=str):
        mine = sorted((r for r in rows if r[by] == key and (r["n"] is None or r["n"] > 0)), key=lambda r: r["pos"])
        out[key] = {"name": str(key), "type": "engram", "fields": _prune(_tree(mine))}
    return out


def _prune(fields: list[dict]) -> list[dict]:
    """Drop containers left without members."""
    out = []
    for f in fields:
        if f["type"] == "map" and "fields" in f:
            f["fields"] = _prune(f["fields"])
            if not f["fields"]:
                continue
        out.append(f)
    return out


def _tree(rows) -> list[dict]:
    root: list[dict] = []
    index: dict[str, dict] = {}
    for r in rows:
        parts = r["field"].split(".")
        f = {"name": parts[-1], "type": r["type"]}
        if r["size"] is not None:
            f["size"] = int(r["size"])
        parent = ".".join(parts[:-1])
        if parts[-1] == "_list":
            index[parent]["_list"] = f
        elif parent:
            index[parent].setdefault("fields", []).append(f)
        else:
            root.append(f)
        index[r["field"]] = f
    return root


def merge_type(a: str, b: str) -> str:
    if a == b:
        return a
    if {a, b} <= {"integer", "number"}:
        return "number"
    if {a, b} <= {"keyword", "text", "string"}:
        return "text"
    return "text"


def merge_fields(a: list[dict], b: list[dict]) -> list[dict]:
    """Lattice join of two field lists (accumulating codify over many inputs)."""
    out = [dict(f) for f in a]
    pos = {f["name"]: i for i, f in enumerate(out)}
    for f in b:
        if f["name"] not in pos:
            pos[f["name"]] = len(out)
            out.append(dict(f))
            continue
        g = out[pos[f["name"]]]
        g["type"] = merge_type(g["type"], f["type"])
        if f.get("size") or g.get("size"):
            g["size"] = max(int(f.get("size") or 0), int(g.get("size") or 0))
        if g["type"] not in ("keyword", "text", "string"):
            g.pop("size", None)
        if f.get("fields") or g.get("fields"):
            g["fields"] = merge_fields(g.get("fields", []), f.get("fields", []))
        if f.get("_list") and g.get("_list"):
            g["_list"] = merge_fields([g["_list"]], [f["_list"]])[0]
    return out


def merge_engram(a: dict, b: dict) -> dict:
    out = dict(a)
    out["fields"] = merge_fields(normalize_fields(a.get("fields", [])), normalize_fields(b.get("fields", [])))
    return out


def format_engram(eng: dict, format: str | None) -> dict:
    if format == "types_only":
        out = dict(eng)
        out["fields"] = [f["type"] for f in eng["fields"]]
        return out
    if format == "all":
        def full(f):
            g = {"name": f["name"], "type": f["type"], "size": f.get("size", 0), "default": f.get("default"),
                 "nullable": f.get("nullable", True), "key": f.get("key", 0), "label": f.get("label", f["name"])}
            if f.get("fields"):
                g["fields"] = [full(x) for x in f["fields"]]
            if f.get("_list"):
                g["_list"] = full(f["_list"])
            return g
        out = dict(eng)
        out["fields"] = [full(f) for f in eng["fields"]]
        return out
    return eng


def profile(df: DataFrame) -> DataFrame:
    """Per top-level field: rows, nulls, longest text form -- one aggregate for all fields."""
    names = df.columns
    aggs = []
    for i, c in enumerate(names):
        col = F.col(quote_part(c))
        aggs += [F.count(col).alias(f"__n{i}"), F.max(F.length(col.cast("string"))).alias(f"__l{i}")]
    prof = df.agg(F.count(F.lit(1)).alias("__rows"), *aggs)
    rows = [F.struct(F.lit(c).alias("field"), F.col("__rows").alias("n_rows"),
                     (F.col("__rows") - F.col(f"__n{i}")).alias("n_null"), F.col(f"__l{i}").cast("bigint").alias("max_len"))
            for i, c in enumerate(names)]
    return prof.select(F.inline(F.array(*rows)))
