"""Pipelines: origin -> transforms -> terminal(s), written as JSON specs.

A spec is only a convenient way to build a DataFrame plan: each transform maps to a
DataFrame -> DataFrame function and each terminal to a write. Nothing is executed until a
terminal writes, and a pipeline with several terminals reads its origin once (persisted fan-out).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..operators import aggregate as agg_ops
from ..operators import joins, mutate, pattern
from ..operators.codify import codify as codify_engram
from ..operators.codify import codify_each, format_engram, merge_engram
from ..session import scratch_path
from ..sinks import files as sinks
from ..sinks.documents import to_documents, write_documents
from ..functions.paths import quote_part
from ..sources import files as sources
from ..storage import dataset_exists, swap_folder
from . import scan as scans
from .engram import apply_engram, coerce_to, from_struct, key_fields, load_engram


@dataclass
class Address:
    """``model|locus|schema|key``: format, location, dataset name and key expression."""

    model: str
    locus: str = ""
    schema: str = ""
    key: str = "*"

    @classmethod
    def parse(cls, smt) -> "Address":
        if isinstance(smt, Address):
            return smt
        if isinstance(smt, dict):
            return cls(smt.get("model", "*"), smt.get("locus", ""), smt.get("schema", ""), smt.get("key", "*"))
        parts = (str(smt).split("|") + ["", "", "", "*"])[:4]
        return cls(*parts)

    @property
    def path(self) -> str:
        if not self.locus:
            return self.schema
        return self.locus.rstrip("/") + "/" + self.schema if self.schema else self.locus

    @property
    def key_fields(self) -> list[str]:
        """``=Foo`` or ``!Foo`` -> ["Foo"]; ``*`` -> none; composite keys joined by ``+``."""
        if not self.key or self.key == "*":
            return []
        body = self.key.lstrip("=!")
        return [t for t in body.split("+") if t and not t.startswith("'")]


_TRANSFORMS: dict = {}
_READERS: dict = {}
_WRITERS: dict = {}


def register_transform(name: str, fn):
    """Named custom transform ``fn(df, spec, ctx) -> DataFrame`` usable in specs by name."""
    _TRANSFORMS[name] = fn


def register_format(name: str, reader=None, writer=None, spark: SparkSession | None = None):
    """Custom source/sink by model name: ``reader(spark, address, options) -> DataFrame`` and
    ``writer(df, address, options)``.

    ``reader`` may also be a Python Data Source class (``pyspark.sql.datasource.DataSource``):
    it is registered with the session and read with ``spark.read.format(name)``, so its
    partitions are planned and read by Spark like any built-in format.
    """
    from pyspark.sql.datasource import DataSource

    if isinstance(reader, type) and issubclass(reader, DataSource):
        session = spark or SparkSession.getActiveSession()
        session.dataSource.register(reader)
        fmt = reader.name()
        _READERS[name] = lambda sp, addr, opts: sp.read.format(fmt).options(
            **{k: str(v) for k, v in opts.items() if not isinstance(v, (dict, list))}).load(addr.path)
    elif reader:
        _READERS[name] = reader
    if writer:
        _WRITERS[name] = writer


# --- sources -------------------------------------------------------------------------------

def _read(spark: SparkSession, addr: Address, options: dict, paths: list[str] | None = None, source: str | None = None) -> DataFrame:
    """What is stored at an address; ``paths`` are read instead of its own path if given, and ``source``
    names a column for the path of each row's file."""
    enc = options.get("encoding")
    missing = options.get("missingValue")
    m = addr.model.lower()
    path = paths if paths is not None else addr.path
    if m in _READERS:
        df = _READERS[m](spark, addr, options)
    elif m == "json":
        df = sources.scan_json(spark, path, lines=None, engram=enc, missing=missing, source=source)
        enc = None
    elif m in ("jsonl", "jsons", "jsonlines"):
        df = sources.scan_json(spark, path, lines=True, engram=enc, missing=missing, source=source)
        enc = None
    elif m in ("csv", "txt", "text"):
        sep = options.get("separator", "," if m == "csv" else "\t")
        header = options.get("hasHeader", options.get("header", m == "csv"))
        names = [f["name"] for f in load_engram(enc)["fields"]] if (enc and not header) else None
        df = sources.scan_csv(spark, path, header=header, sep=sep, names=names, source=source)
    elif m == "parquet":
        df = spark.read.option("mergeSchema", len(path) > 1).parquet(*path) if paths is not None else spark.read.parquet(addr.path)
        df = df.withColumn(source, F.col("_metadata.file_path")) if source else df
    elif m in ("geojson", "shp", "shapefile"):
        df = sources.scan_geojson(spark, addr.path)
    elif m == "memory":
        df = spark.table(addr.schema)
    elif m in ("jdbc", "mysql", "mssql", "oracledb", "postgresql"):
        from ..sources.jdbc import scan_jdbc

        df = scan_jdbc(spark, options.get("jdbc", {}), addr.schema)
    else:
        raise ValueError(f"no reader for model {addr.model!r}")
    if enc is not None:
        df = apply_engram(df, enc, missing, keep=(source,) if source else ())
    return df


def open_origin(spark: SparkSession, origin, datasets: dict | None = None, registry: DataFrame | None = None) -> DataFrame:
    """Origin spec -> DataFrame. ``origin`` may be a DataFrame, a name in ``datasets``, a registry
    urn (``realm:name``, resolved through ``registry``), or
    ``{"smt": ..., "options": {...}, "pattern": {...}}`` (the pattern is pushed into the scan)."""
    if isinstance(origin, DataFrame):
        return origin
    if isinstance(origin, str) and datasets and origin in datasets:
        return datasets[origin]
    spec = origin if isinstance(origin, dict) else {"smt": origin}
    smt = spec.get("smt")
    if registry is not None and isinstance(smt, str) and "|" not in smt and ":" in smt:
        from .registry import open_dataset

        df = open_dataset(spark, registry, smt, datasets, **(spec.get("options") or {}))
        return pattern.retrieve(df, spec["pattern"]) if spec.get("pattern") else df
    if spec.get("source_fiber"):
        # read-through: an origin without data is filled by its source pipeline, whose
        # terminal writes the cache; the source result is used directly this time
        src = spec["source_fiber"]
        def reopen():
            return open_origin(spark, {k: v for k, v in spec.items() if k != "source_fiber"}, datasets)

        cached = reopen() if _exists(spark, spec) else None
        fresh = run_transforms(open_origin(spark, src["origin"], datasets), src.get("transforms", []),
                               {"spark": spark, "datasets": datasets or {}})
        return sources.read_through(cached, fresh, lambda d: write_terminal(d, src["terminal"]), reopen)
    smt = spec.get("smt")
    if isinstance(smt, str) and datasets and smt in datasets:
        df = datasets[smt]
    else:
        df = _read(spark, Address.parse(smt), spec.get("options", {}) or {})
    if spec.get("pattern"):
        df = pattern.retrieve(df, spec["pattern"])
    if spec.get("options", {}).get("count") and not spec.get("pattern", {}).get("count"):
        df = sources.sample_head(df, spec["options"]["count"])
    return df


def _exists(spark: SparkSession, spec: dict) -> bool:
    """Whether anything is stored at the origin. Only absence counts as empty; other errors are raised."""
    addr = Address.parse(spec.get("smt"))
    m = addr.model.lower()
    if m in ("memory", "table"):
        return spark.catalog.tableExists(addr.schema)
    if m in _READERS or m in ("jdbc", "mysql", "mssql", "oracledb", "postgresql"):
        return True
    return dataset_exists(spark, addr.path)


# --- sinks ---------------------------------------------------------------------------------

def write_terminal(df: DataFrame, terminal: dict):
    """Terminal spec -> write (append/overwrite, keyed upsert, template, split, table load)."""
    addr = Address.parse(terminal.get("smt"))
    opts = terminal.get("options", {}) or {}
    if opts.get("encoding"):
        df = apply_engram(df, opts["encoding"])
    m = addr.model.lower()
    mode = "append" if opts.get("append") else "overwrite"
    if m in _WRITERS:
        return _WRITERS[m](df, addr, opts)
    if opts.get("splitOn"):
        return sinks.write_split(df, addr.path, opts["splitOn"], fmt="json" if m.startswith("json") else m)
    if addr.key_fields:
        # a keyed terminal is a keyed store: rows of the same key are replaced, others stay
        order = opts.get("order")
        if m == "parquet":
            return sinks.upsert_path(df, addr.path, addr.key_fields, order)
        if m == "table":
            return sinks.upsert_table(df, addr.schema, addr.key_fields, order)
        if m in ("json", "jsonl", "jsons", "csv", "txt"):
            return _upsert_text(df, addr, opts, order)
        if m not in ("memory", "template"):
            raise ValueError(f"a terminal of model {addr.model!r} can't store by key {addr.key!r}")
    if m in ("json", "jsonl", "jsons"):
        return sinks.write_json(df, addr.path, mode=mode)
    if m in ("csv", "txt"):
        return sinks.write_csv(df, addr.path, header=bool(opts.get("addHeader")), mode=mode,
                               sep=opts.get("separator", "," if m == "csv" else "\t"))
    if m == "parquet":
        return df.write.mode(mode).parquet(addr.path)
    if m == "template":
        tmpl = load_engram(opts["template"])
        parts = to_documents(df, tmpl, opts.get("storeTo", "data"), by=opts.get("by"), params=opts.get("params"))
        return write_documents(parts, addr.path, by=opts.get("by"))
    if m == "memory":
        return df.createOrReplaceTempView(addr.schema)
    if m == "table":
        return sinks.load_table(df, addr.schema, append=bool(opts.get("append", True)))
    if m in ("jdbc", "mysql", "mssql", "oracledb", "postgresql"):
        from ..sources.jdbc import write_jdbc

        return write_jdbc(df, opts.get("jdbc", {}), addr.schema, append=bool(opts.get("append", True)))
    raise ValueError(f"no writer for model {addr.model!r}")


def _fitting(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with equal types in the columns that they share, and no value lost.

    What is stored takes the type of the new rows if every value converts; else both become text. One
    aggregate looks at the columns whose types differ.
    """
    from .engram import normalize_fields

    shared = [f for f in new.schema.fields if f.name in old.columns and old.schema[f.name].dataType != f.dataType]
    if not shared:
        return old, new
    made = {}
    for f in shared:
        field = normalize_fields(from_struct(StructType([f]))["fields"])[0]
        made[f.name] = coerce_to(F.col(quote_part(f.name)), old.schema[f.name].dataType, field).cast(f.dataType)
    blank = {f.name: F.trim(F.col(quote_part(f.name)).cast("string")) == "" if not isinstance(old.schema[f.name].dataType, (StructType, ArrayType, MapType)) else F.lit(False) for f in shared}
    lost = old.agg(*[F.count(F.when(F.col(quote_part(n)).isNotNull() & ~blank[n] & c.isNull(), 1)).alias(f"l{i}") for i, (n, c) in enumerate(made.items())]).first()
    for i, n in enumerate(list(made)):
        if lost[i]:
            if n in keys:
                raise ValueError(f"key {n!r}: {lost[i]} stored values are no {new.schema[n].dataType.simpleString()}")
            if isinstance(new.schema[n].dataType, (StructType, ArrayType, MapType)) or isinstance(old.schema[n].dataType, (StructType, ArrayType, MapType)):
                raise ValueError(f"column {n!r} is {old.schema[n].dataType.simpleString()}, the change has {new.schema[n].dataType.simpleString()}")
            made[n] = F.col(quote_part(n)).cast("string")
            new = new.withColumn(n, coerce_to(F.col(quote_part(n)), new.schema[n].dataType, {"name": n, "type": "text"}))
    return old.withColumns(made), new


def _upsert_text(df: DataFrame, addr: Address, opts: dict, order=None):
    """Keyed store in JSON or CSV files: what is there, read as any origin is, is merged with ``df`` and
    written as a whole to a new folder that then takes the old one's place by rename.

    Rows and columns that only one side has are kept. A stored record that can't be read raises.
    """
    from ..operators.maintain import upsert

    spark, m = df.sparkSession, addr.model.lower()
    text = sinks.json_ready(df) if m.startswith("json") else df
    sep, header = opts.get("separator", "," if m == "csv" else "\t"), bool(opts.get("addHeader"))
    if dataset_exists(spark, addr.path):
        if m.startswith("json"):
            kinds = sources.json_kinds(spark, addr.path)
            parts = [spark.read.option("multiLine", k == "whole").option("mode", "FAILFAST").json(files) for k, files in sorted(kinds.items())]
            old = parts[0] if parts else text.limit(0)
            for more in parts[1:]:
                more, old = _fitting(more, old, [])
                old = old.unionByName(more, allowMissingColumns=True)
        else:
            old = sources.scan_csv(spark, addr.path, header=header, sep=sep)
            if not header and len(old.columns) != len(df.columns):
                raise ValueError(f"{addr.path} has {len(old.columns)} columns without names, the change {len(df.columns)}")
            old = old if header else old.toDF(*df.columns)
        old, text = _fitting(old, text, addr.key_fields)
        text = upsert(old, text, addr.key_fields, order)
    else:
        text = upsert(text.limit(0), text, addr.key_fields, order)

    return swap_folder(spark, addr.path, lambda path: _write_text(text, path, m, opts))


def _write_text(df: DataFrame, path: str, model: str, opts: dict):
    if model.startswith("json"):
        return sinks.write_json(df, path)
    return sinks.write_csv(df, path, header=bool(opts.get("addHeader", opts.get("hasHeader", opts.get("header")))), sep=opts.get("separator", "," if model == "csv" else "\t"))


# --- transforms ----------------------------------------------------------------------------

def _t_filter(df, spec, ctx):
    return pattern.filter_rows(df, spec.get("match"), spec.get("drop"))


def _t_mutate(df, spec, ctx):
    return mutate.mutate(df, default=spec.get("default"), map=spec.get("map"), select=spec.get("select"),
                         remove=spec.get("remove"), assign=spec.get("assign"), keep=ctx.get("carried", ()))


def _lookup_frame(spec, ctx):
    other = spec.get("dataset") or spec.get("smt")
    return open_origin(ctx["spark"], {"smt": other, "options": spec.get("options", {}),
                                      "pattern": spec.get("pattern")}, ctx.get("datasets"), ctx.get("registry"))


def _t_adjoin(df, spec, ctx):
    enc = (spec.get("options") or {}).get("encoding")
    # an encoding that declares the looked-up fields as the key says that they are unique
    unique = bool(spec.get("unique")) or enc is not None and bool(key_fields(enc)) and set(key_fields(enc)) <= set(spec["lookup"])
    return joins.adjoin(df, _lookup_frame(spec, ctx), spec["lookup"], spec.get("inject"), spec.get("order"),
                        spec.get("prefix"), unique=unique)


def _t_conjoin(df, spec, ctx):
    other = _lookup_frame(spec, ctx)
    if spec.get("options", {}).get("pick"):
        # the join fields live on the enclosing record, so they are carried through the pick
        other = sources.pick(other, spec["options"]["pick"], keep=list(spec["on"].keys()))
    return joins.conjoin(df, other, spec["on"], spec.get("fields"), spec.get("prefix"))


def _t_aggregate(df, spec, ctx):
    aggs = {k: tuple(v) if isinstance(v, (list, tuple)) else tuple(v.items())[0] for k, v in spec.get("aggs", {}).items()}
    by = spec.get("by")
    if ctx.get("carried"):  # each dataset is aggregated by itself
        by = [*([by] if isinstance(by, str) else by or []), *[c for c in ctx["carried"] if c in df.columns]]
    return agg_ops.aggregate(df, by, aggs)


def _t_select(df, spec, ctx):
    keep = ctx.get("carried", ())
    return mutate.rename(df, spec["fields"], keep) if isinstance(spec.get("fields"), dict) else \
        mutate.select_fields(df, spec["fields"], keep)


def _t_tee(df, spec, ctx):
    """Side output: the side branch (``fiber`` or inline) runs its own transforms and terminal;
    rows pass on unchanged."""
    side = spec.get("fiber", spec)

    def side_steps(x):
        return run_transforms(x, side.get("transforms", []), ctx)

    write = ctx.get("write", write_terminal)
    out = sinks.tee(df, side_steps, lambda x: write(x, side["terminal"]))
    ctx.setdefault("persisted", []).append(out)
    return out


register_transform("filter", _t_filter)
register_transform("mutate", _t_mutate)
register_transform("adjoin", _t_adjoin)
register_transform("conjoin", _t_conjoin)
register_transform("aggregate", _t_aggregate)
register_transform("select", _t_select)
register_transform("flatten", lambda df, spec, ctx: mutate.flatten(df, spec.get("separator", "_")))
register_transform("compose", lambda df, spec, ctx: mutate.compose(df, spec.get("separator", "_"), ctx.get("carried", ())))
register_transform("encoder", lambda df, spec, ctx: apply_engram(df, spec["encoding"], keep=ctx.get("carried", ())))
register_transform("tee", _t_tee)


def run_transforms(df: DataFrame, transforms, ctx: dict) -> DataFrame:
    for spec in transforms or []:
        name = spec.get("transform")
        if name not in _TRANSFORMS:
            raise ValueError(f"unknown transform {name!r}")
        df = _TRANSFORMS[name](df, spec, ctx)
        gone = [c for c in ctx.get("carried", ()) if c not in df.columns]
        if gone:
            raise ValueError(f"transform {name!r} drops the columns {gone} that tell a scan's datasets apart")
    return df


def transfer(spark: SparkSession, origin, transforms=(), terminal=None, datasets: dict | None = None,
             codify: bool = False, stats: dict | None = None, registry: DataFrame | None = None):
    """Run one pipeline. Returns the final DataFrame when there is no terminal; with an array of
    terminals the result is persisted once and written to each.

    When a ``stats`` dict is given it receives ``count``, ``elapsed`` (s) and ``rows_per_sec`` of
    the write -- counted by an observation on the written data, not by an extra pass.
    """
    import time

    ctx = {"spark": spark, "datasets": datasets or {}, "registry": registry}
    df = run_transforms(open_origin(spark, origin, datasets, registry), transforms, ctx)
    if isinstance(origin, dict) and (origin.get("options") or {}).get("codify"):
        codify = True
    if codify:
        df = apply_engram(df, codify_engram(df))
    try:
        if terminal is None:
            return df
        observed, obs = agg_ops.with_metrics(df)
        t0 = time.perf_counter()
        terms = terminal if isinstance(terminal, list) else [terminal]
        if len(terms) == 1:
            write_terminal(observed, terms[0])
        else:
            sinks.tee_write(observed, [lambda x, t=t: write_terminal(x, t) for t in terms])
        if stats is not None:
            elapsed = time.perf_counter() - t0
            n = int(obs.get.get("count") or 0)
            stats.update({"count": n, "elapsed": elapsed, "rows_per_sec": n / elapsed if elapsed > 0 else None})
        return df
    finally:
        if terminal is not None:
            for p in ctx.get("persisted", []):
                p.unpersist()


def scan_fibers(spark: SparkSession, path: str, glob: str, exclude: list[str] | None, fibers: list[dict], fmt: str = "json",
                read_options: dict | None = None, recursive: bool = False, datasets: dict | None = None,
                registry: DataFrame | None = None) -> list:
    """The ``scan`` action with sub-fibers: the result of each over all matching datasets.

    A sub-fiber has its own action (``transfer``, ``retrieve`` or ``codify``), origin with options (``encoding``,
    ``codify``, ``count``, separators and headers), transforms and terminal, all of which may name the dataset
    (``${name}``, ``${rpath}``, ``${schema}``). Without an origin it reads the scanned datasets with
    ``read_options``, has these names as fields too, and an output that keeps such a field is split by it. See :mod:`skein.plans.scan`.
    """
    found = scans.datasets_at(spark, path, glob, exclude, recursive)
    persisted: list[DataFrame] = []
    exposed = [False]

    def read(addr, options, paths):
        model = addr.model if addr.model != "*" else fmt
        return _read(spark, Address(model, addr.locus, addr.schema), options, paths, scans.SOURCE)

    def retrieve(df, spec, carried):
        fields = spec.get("fields")
        return pattern.retrieve(df, spec | {"fields": [*fields, *carried]} if fields else spec)

    def write(df, terminal, own=found):
        spec, hidden = terminal, [c for c in scans.CARRIED if c in df.columns]
        plain = df.drop(*hidden)
        if not scans._names_dataset(spec):
            return write_terminal(plain, spec)
        addr, opts = Address.parse(spec["smt"]), spec.get("options") or {}
        model = addr.model.lower()
        fields = [f for f in ("schema", "name", "rpath") if "${" + f + "}" in addr.path]
        if exposed[0] and fields[:1] and fields[0] in plain.columns:  # the result has the name as a field: split by it
            base = addr.path[:addr.path.index("${")].rsplit("/", 1)[0]
            return sinks.write_split(plain, base, fields, fmt="json" if model.startswith("json") else model)

        def place(d):
            return Address.parse(scans._filled(spec["smt"], d.values)).path

        same_options = not scans._names_dataset(opts)
        if same_options and not addr.key_fields and not opts.get("append") and not opts.get("splitOn") and (model.startswith("json") or model == "parquet"):
            if opts.get("encoding"):
                df = apply_engram(df, opts["encoding"], keep=tuple(hidden))
            folder = scratch_path(spark, f"scan-{uuid.uuid4().hex}") if not addr.locus else f"{addr.locus.split('${')[0].rstrip('/')}/__scan-{uuid.uuid4().hex[:8]}"
            sinks.write_split(df.drop(*[c for c in hidden if c != scans.DATASET]), folder, scans.DATASET, fmt="json" if model.startswith("json") else model)
            return scans.publish(spark, folder, own, place)
        cached = df.persist()
        try:
            for d in own:
                write_terminal(cached.where(F.col(scans.DATASET) == d.id).drop(*hidden), scans._filled(spec, d.values))
        finally:
            cached.unpersist()

    ctx = {"spark": spark, "datasets": datasets or {}, "registry": registry, "persisted": persisted, "write": write}

    def transform(df, steps, carried):
        return run_transforms(df, steps, ctx | {"carried": carried})

    def encode_each(df, own):
        """Datasets of equal encodings as one branch, with the encoding applied."""
        encodings = codify_each(df.drop(*[c for c in scans.CARRIED if c != scans.DATASET]), by=scans.DATASET)
        groups: dict[str, list] = {}
        for d in own:
            eng = encodings.get(d.id)
            if eng is not None:
                fields = [f for f in eng["fields"] if f["name"] not in scans.CARRIED]
                groups.setdefault(json.dumps(fields, sort_keys=True), []).append((d, fields))
        return [([d for d, _ in members], apply_engram(df.where(F.col(scans.DATASET).isin([d.id for d, _ in members])), {"fields": members[0][1]}, keep=scans.CARRIED))
                for members in groups.values()]

    def codify(df, sub, terminal):
        """One encoding of all datasets; one per dataset if the terminal names the dataset."""
        opts = (sub.get("origin") or {}).get("options") or {}
        form = opts.get("encoding_format")
        if scans._names_dataset(terminal):
            each = codify_each(df.drop(*[c for c in scans.CARRIED if c != scans.DATASET]), by=scans.DATASET, missing=sub.get("missingValue"))
            out = {d.rpath: format_engram(each[d.id] | {"name": d.schema or d.name}, form) for d in found if d.id in each}
            for d in found:
                if terminal.get("smt") and d.rpath in out:
                    _write_encoding(spark, out[d.rpath], scans._filled(terminal, d.values))
            return out
        eng = codify_engram(df.drop(*scans.CARRIED), missing=sub.get("missingValue"), name=sub.get("name"))
        if opts.get("encoding"):
            eng = merge_engram(load_engram(opts["encoding"]), eng)
        eng = format_engram(eng, form)
        if terminal.get("smt"):
            _write_encoding(spark, eng, terminal)
        return eng

    outs = []
    try:
        for fiber in fibers:
            exposed[0] = not fiber.get("origin")
            if exposed[0]:
                fiber = fiber | {"origin": {"smt": f"{fmt}|{path}|${{name}}|*", "options": read_options or {}}, "exposed": True}
            outs.append(scans.scan_fiber(spark, fiber, found, path, fmt, recursive, read, transform, write, codify, {"retrieve": retrieve, "encode_each": encode_each}))
    finally:
        for p in persisted:
            p.unpersist()
    return outs


def _write_encoding(spark: SparkSession, encoding: dict, terminal: dict) -> None:
    text = spark.createDataFrame([(json.dumps(encoding, ensure_ascii=False),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(Address.parse(terminal["smt"]).path)


def scan_transfer(spark: SparkSession, path: str, glob: str = "*", exclude: list[str] | None = None,
                  transforms=(), out_path: str | None = None, fmt: str = "json", out_fmt: str = "json",
                  read_options: dict | None = None, recursive: bool = False) -> DataFrame:
    """The ``scan`` action: the same sub-pipeline over every matching dataset at a location.

    Instead of one job per file, all matching files are read at once (``scan_many``: ``name``,
    ``rpath`` and ``schema`` say where each row came from), the transforms run once over the
    union, and the output is split per source dataset (``schema=<name>`` directories).
    """
    many = sources.scan_many(spark, path, glob, exclude, fmt=fmt, recursive=recursive,
                             merge_schema=fmt == "parquet", options=read_options)
    out = run_transforms(many.drop("name", "rpath"), transforms, {"spark": spark, "datasets": {}})
    if out_path is not None and "schema" in out.columns:
        sinks.write_split(out, out_path, "schema", fmt=out_fmt)
    return out


def _substitute(spec, params: dict):
    """``"=${name}"`` becomes the parameter itself (any type); ``${name}`` inside text is replaced."""
    import re

    if isinstance(spec, dict):
        return {k: _substitute(v, params) for k, v in spec.items()}
    if isinstance(spec, list):
        return [_substitute(v, params) for v in spec]
    if isinstance(spec, str):
        whole = re.fullmatch(r"=\$\{([^}]+)\}", spec)
        if whole:
            return params.get(whole.group(1))
        return re.sub(r"\$\{([^}]+)\}", lambda m: str(params.get(m.group(1), "")), spec)
    return spec


#: datasets that one foreach may name: each is a branch of the plan
MAX_DATASETS = 10_000


def foreach(spark: SparkSession, driver: DataFrame, fiber: dict, terminal=None, datasets: dict | None = None,
            registry: DataFrame | None = None) -> DataFrame:
    """The ``foreach`` action over a list of datasets: each driving row (e.g. a registry entry)
    parameterises the sub-pipeline ``fiber`` (``{"origin": ..., "transforms": [...]}``) through
    ``${field}`` references, and all results go to one output.

    The driving rows describe datasets (metadata, one per dataset): each becomes a branch of ONE job's
    plan, so they are read on the driver, and more than MAX_DATASETS of them raise. Rows that are data
    parameterising a lookup go through :func:`skein.operators.joins.foreach_join`, a join.
    """
    from ..operators.setops import union_all
    from .registry import ENTRY_SCHEMA, entry_dict

    is_registry = set(ENTRY_SCHEMA.fieldNames()) <= set(driver.columns)
    frames = []
    rows = driver.limit(MAX_DATASETS + 1).collect()
    if len(rows) > MAX_DATASETS:
        raise ValueError(f"foreach over more than {MAX_DATASETS} datasets: use foreach_join for rows of data")
    for row in rows:
        params = entry_dict(row) if is_registry else row.asDict(recursive=True)
        spec = _substitute(fiber, params)
        ctx = {"spark": spark, "datasets": datasets or {}, "registry": registry}
        frames.append(run_transforms(open_origin(spark, spec["origin"], datasets, registry),
                                     spec.get("transforms", []), ctx))
    if not frames:  # nothing to run: no rows, and nothing is written
        return spark.createDataFrame([], StructType([]))
    out = union_all(frames)
    if terminal is not None:
        write_terminal(out, terminal)
    return out


def _schema_action(spark: SparkSession, fiber: dict, origin, terminal, datasets, registry) -> dict:
    """``schema`` with ``method`` create, encoding or dull: the catalog operations, as a fiber."""
    from . import registry as reg

    method = fiber.get("method") or (fiber.get("schema") or {}).get("method") or "encoding"
    addr = Address.parse((origin or terminal)["smt"])
    if method in ("create", "createSchema"):
        enc = ((origin or terminal).get("options") or {}).get("encoding") or fiber.get("encoding")
        return reg.schema_create(spark, addr.schema, enc)
    if method in ("dull", "dullSchema", "drop"):
        return reg.schema_dull(spark, addr.schema)
    return reg.schema_encoding(spark, addr.schema)


def run_fiber(spark: SparkSession, fiber: dict, datasets: dict | None = None, registry: DataFrame | None = None):
    """Run one fiber spec by its ``action`` (default ``transfer``) and return its result:

    * ``transfer`` / ``retrieve`` -> the output DataFrame (written to ``terminal`` when given);
    * ``codify`` -> the inferred encoding (``origin.options.count`` samples, ``missingValue``,
      ``encoding_format``);
    * ``dull`` -> ``{"deleted": n}`` for a parquet origin (rewritten in place through staging);
    * ``list`` -> the inventory DataFrame; ``scan`` -> the combined rows of its sub-fibers, or, if one of
      them is a ``codify``, the list of their results;
    * ``foreach`` -> the union of all sub-fibers over the driving rows; ``schema`` -> a status dict;
      ``compare`` -> the differing rows of two stored datasets, at a level (``compareValues``).
    """
    from ..operators.codify import codify as codify_engram
    from ..operators.setops import union_all
    from ..sinks.files import dull_path

    action = fiber.get("action", "transfer")
    origin = fiber.get("origin")
    terminal = fiber.get("terminal")
    if isinstance(terminal, dict) and not terminal.get("smt"):
        terminal = None  # an output-only terminal names a file to compare with
    if action in ("transfer", "retrieve"):
        return transfer(spark, origin, fiber.get("transforms", []), terminal, datasets, registry=registry)
    if action == "codify":
        opts = (origin or {}).get("options", {}) or {}
        src = open_origin(spark, {k: v for k, v in origin.items() if k != "options"} | {"options": {
            k: v for k, v in opts.items() if k not in ("count", "encoding_format", "encoding")}}, datasets, registry)
        src = run_transforms(src, fiber.get("transforms", []), {"spark": spark, "datasets": datasets or {},
                                                                  "registry": registry})
        found = codify_engram(src, missing=fiber.get("missingValue"), format=None if opts.get("encoding") else opts.get("encoding_format"),
                              name=fiber.get("name"), sample=opts.get("count"))
        if opts.get("encoding"):  # primed: what the given encoding says comes first
            found = format_engram(merge_engram(load_engram(opts["encoding"]), found), opts.get("encoding_format"))
        if terminal is not None:
            _write_encoding(spark, found, terminal)
        return found
    if action == "dull":
        addr, opts = Address.parse(origin["smt"]), origin.get("options", {}) or {}
        model = addr.model.lower() if addr.model != "*" else "parquet"
        match = (origin.get("pattern") or {}).get("match", "*")
        if model in ("csv", "txt", "text") or model.startswith("json"):
            # read as any origin is, written as any terminal is: nothing but the deleted rows changes
            return {"deleted": dull_path(spark, addr.path, match, read=lambda: _read(spark, addr, opts),
                                         write=lambda df, folder: _write_text(df, folder, model, {"hasHeader": model == "csv"} | opts))}
        return {"deleted": dull_path(spark, addr.path, match, fmt=model)}
    if action == "list":
        addr = Address.parse(origin["smt"])
        opts = origin.get("options", {}) or {}
        return sources.inventory(spark, addr.locus, addr.schema or "*", bool(opts.get("recursive")))
    if action == "scan":
        addr = Address.parse(origin["smt"])
        opts = origin.get("options", {}) or {}
        if fiber.get("fibers"):
            outs = scan_fibers(spark, addr.locus, addr.schema or "*", opts.get("exclude"), fiber["fibers"], addr.model,
                               {k: v for k, v in opts.items() if k not in ("exclude", "recursive")}, bool(opts.get("recursive")), datasets, registry)
            return union_all(outs) if all(isinstance(o, DataFrame) for o in outs) and outs else outs
        return scan_transfer(spark, addr.locus, addr.schema or "*", opts.get("exclude"), fiber.get("transforms", []),
                             Address.parse(terminal["smt"]).path if terminal else None, fmt=addr.model)
    if action == "foreach":
        driver = open_origin(spark, origin, datasets, registry) if not (
            isinstance(origin, dict) and origin.get("smt") in ("$:engrams", "$:tracts") and registry is not None) \
            else pattern.retrieve(registry, origin.get("pattern") or {})
        outs = [foreach(spark, driver, sub, None, datasets, registry) for sub in fiber["fibers"]]
        out = union_all(outs)
        if terminal is not None:
            write_terminal(out, terminal)
        return out
    if action == "compare":
        from ..operators.setops import VALUES, compare_files

        fmt = fiber.get("model") or ("csv" if str(fiber["expected"]).split(".gz")[0].endswith((".csv", ".txt")) else "json")
        options = {"header": True} if fmt == "csv" else {"multiLine": True, "primitivesAsString": True}
        return compare_files(spark, fiber["expected"], fiber["output"], fmt, fiber.get("pick"), options, int(fiber.get("compareValues", VALUES)))
    if action == "schema":
        return _schema_action(spark, fiber, origin, terminal, datasets, registry)
    raise ValueError(f"unknown action {action!r}")
