"""The ``scan`` action: sub-fibers over every dataset at a location.

A sub-fiber names its dataset by ``${name}``, ``${rpath}`` or ``${schema}`` (the name without extension) in
its origin, options, transforms and terminal. It isn't run once per dataset: datasets whose origins
come to the same reader and options are read together, each row carries where it came from in hidden
columns that pass through any ``map`` or ``select``, and a terminal that names the dataset is one
partitioned write whose folders then take the names that the terminal asks for.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import quote_part
from ..operators.pattern import glob_regex

#: datasets that one scan may meet: their names and addresses are metadata on the driver
MAX_DATASETS = 10_000
NAME, RPATH, SCHEMA, DATASET = "__scan_name", "__scan_rpath", "__scan_schema", "__scan_dataset"
SOURCE = "__scan_source"  # the path of a row's file, while reading
CARRIED = (DATASET, NAME, RPATH, SCHEMA)
_VARIABLES = {"name": NAME, "rpath": RPATH, "schema": SCHEMA}


class Dataset(NamedTuple):
    path: str
    name: str
    rpath: str

    @property
    def schema(self) -> str:
        return self.name.rpartition(".")[0]

    @property
    def id(self) -> str:
        return hashlib.sha1(self.rpath.encode()).hexdigest()

    @property
    def values(self) -> dict:
        return {"name": self.name, "rpath": self.rpath, "schema": self.schema}


def datasets_at(spark: SparkSession, path: str, glob: str = "*", exclude: list[str] | None = None, recursive: bool = False) -> list[Dataset]:
    """Files (or, unless ``recursive``, dataset folders) at a location that match ``glob`` and no glob of ``exclude``."""
    fs = spark._jvm.org.apache.hadoop.fs
    base = fs.Path(path.rstrip("/") or "/")
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found, todo = [], [(base, "")]
    while todo:
        folder, before = todo.pop()
        for status in system.listStatus(folder):
            q = status.getPath()
            name = q.getName()
            if name.startswith(("_", ".")):
                continue
            if status.isDirectory() and recursive:
                todo.append((q, f"{before}{name}/"))
            elif re.match(glob_regex(glob or "*"), name) and not any(re.match(glob_regex(g), name) for g in exclude or []):
                found.append(Dataset(q.toString(), name, before + name))
    if len(found) > MAX_DATASETS:
        raise ValueError(f"a scan of more than {MAX_DATASETS} datasets: give a glob that matches fewer")
    return sorted(found, key=lambda d: d.rpath)


def _filled(spec, values: dict):
    """``${name}``, ``${rpath}`` and ``${schema}`` inside texts replaced; other references stay."""
    if isinstance(spec, dict):
        return {k: _filled(v, values) for k, v in spec.items()}
    if isinstance(spec, list):
        return [_filled(v, values) for v in spec]
    if isinstance(spec, str):
        return re.sub(r"\$\{(name|rpath|schema)\}", lambda m: values[m.group(1)], spec)
    return spec


def _of_row(spec):
    """Transforms in which the dataset's names are values of the row: templates refer to the hidden columns,
    and in an expression (``=a+'@${schema}'``) a quoted text is parted at the reference."""
    if isinstance(spec, dict):
        return {k: _of_row(v) for k, v in spec.items()}
    if isinstance(spec, list):
        return [_of_row(v) for v in spec]
    if not isinstance(spec, str):
        return spec
    if spec[:1] not in ("=", "!"):
        return _filled(spec, {k: "${" + c + "}" for k, c in _VARIABLES.items()})
    out, quote, at = [], "", 0
    for m in re.finditer(r"""\$\{(name|rpath|schema)\}|['"]""", spec):
        out.append(spec[at:m.start()])
        at = m.end()
        if m.group(1) is None:
            quote = "" if quote == m.group(0) else quote or m.group(0)
            out.append(m.group(0))
        else:
            out.append(f"{quote}+{_VARIABLES[m.group(1)]}+{quote}" if quote else _VARIABLES[m.group(1)])
    return "".join([*out, spec[at:]])


def _names_dataset(spec) -> bool:
    return spec != _filled(spec, {"name": "\u0000", "rpath": "\u0000", "schema": "\u0000"})


def tagged(df: DataFrame, base: str, recursive: bool) -> DataFrame:
    """``df``, read from files below ``base``, with the hidden columns of each row's dataset."""
    at = F.regexp_extract(F.col(SOURCE), r"^[^:/]+:(?://[^/]*)?(/.*)$", 1)
    at = F.url_decode(F.replace(at, F.lit("+"), F.lit("%2B")))  # a path has its blanks encoded
    rel = F.substring(at, len(base.rstrip("/")) + 2, 1 << 30)
    rpath = rel if recursive else F.substring_index(rel, "/", 1)
    out = df.withColumn(RPATH, rpath)
    # the schema is the name without extension; a name without one has none
    schema = F.when(F.instr(NAME, ".") > 0, F.regexp_replace(NAME, r"\.[^.]*$", "")).otherwise("")
    return out.withColumns({NAME: F.substring_index(RPATH, "/", -1), DATASET: F.sha1(RPATH)}).withColumn(SCHEMA, schema).drop(SOURCE)


def same_origin(spec: dict, datasets: list[Dataset]) -> list[tuple[dict, list[Dataset]]]:
    """The sub-fiber's origin for groups of datasets: all whose options come to the same are one group."""
    groups: dict[str, tuple[dict, list[Dataset]]] = {}
    for d in datasets:
        filled = {k: _filled(v, d.values) for k, v in spec.items() if k != "smt"}
        groups.setdefault(json.dumps(filled, sort_keys=True, default=str), (filled, []))[1].append(d)
    return list(groups.values())


def publish(spark: SparkSession, folder: str, datasets: list[Dataset], target: Callable[[Dataset], str]) -> None:
    """Move the folders of a partitioned write to the places that the terminal names."""
    fs = spark._jvm.org.apache.hadoop.fs
    base = fs.Path(folder)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for d in datasets:
        part, place = fs.Path(base, f"{DATASET}={d.id}"), fs.Path(target(d))
        if system.exists(place):
            system.delete(place, True)
        system.mkdirs(place.getParent())
        if system.exists(part):
            if not system.rename(part, place):
                raise OSError(f"cannot publish {place}")
        else:
            system.mkdirs(place)  # a dataset without rows is an empty dataset
    system.delete(base, True)


def scan_fiber(spark: SparkSession, sub: dict, datasets: list[Dataset], base: str, model: str, recursive: bool,
               read: Callable, transform: Callable, write: Callable, codify: Callable, context: dict):
    """One sub-fiber over all datasets; its result (a DataFrame, or an encoding per dataset or in all).

    ``read(address, options, paths)`` reads several files or folders of one format, ``transform(df, steps,
    carried)`` runs transforms, ``write(df, terminal)`` writes a terminal, ``codify(df)`` finds an encoding.
    """
    from .transfer import Address

    origin = sub.get("origin") or {"smt": f"{model}|{base}|${{name}}|*"}
    action = sub.get("action", "transfer")
    if action not in ("transfer", "retrieve", "codify"):
        raise ValueError(f"a scan can't run the action {action!r}")
    addr = Address.parse(origin["smt"])
    here = addr.locus.rstrip("/") in ("", base.rstrip("/")) and addr.schema in ("${name}", "${rpath}", "")
    frames: list[tuple[list[Dataset], DataFrame]] = []
    for spec, members in same_origin(origin, datasets):
        options = spec.get("options") or {}
        count = options.get("count")
        # a limit per dataset, or datasets elsewhere: a branch of the plan for each
        groups = [[d] for d in members] if count or not here else [members]
        for own in groups:
            paths = [d.path for d in own] if here else [_filled(addr.path, own[0].values)]
            df = read(addr, {k: v for k, v in options.items() if k not in ("count", "codify", "exclude", "recursive")}, paths)
            if here:
                df = tagged(df, _plain(spark, base), recursive)
            else:
                d = own[0]
                df = df.drop(SOURCE).withColumns({DATASET: F.lit(d.id), NAME: F.lit(d.name), RPATH: F.lit(d.rpath), SCHEMA: F.lit(d.schema)})
            if spec.get("pattern"):
                df = context["retrieve"](df, spec["pattern"], CARRIED)
            if count:
                df = df.limit(int(count))
            frames.append((own, df))
    if not frames:
        return None
    if sub.get("exposed"):  # without an origin of its own, the names are fields beside those of the data
        frames = [(own, df.withColumns({k: F.col(c) for k, c in _VARIABLES.items() if k not in df.columns})) for own, df in frames]
    # transforms may name the dataset: there it is a value of the row
    steps = _of_row(sub.get("transforms") or [])
    terminal = sub.get("terminal") or {}
    if action == "codify":
        whole = transform(_union([df for _, df in frames]), steps, CARRIED)
        return codify(whole, sub, terminal)
    if (origin.get("options") or {}).get("codify"):
        frames = [x for own, df in frames for x in context["encode_each"](df, own)]
    whole = transform(_union([df for _, df in frames]), steps, CARRIED) if len(frames) == 1 or not (origin.get("options") or {}).get("codify") else None
    if whole is None:  # encodings differ: branches have other types, so each is transformed and written alone
        outs = [(own, transform(df, steps, CARRIED)) for own, df in frames]
    else:
        outs = [(datasets, whole)]
    if terminal.get("smt"):
        for own, out in outs:
            write(out, terminal, own)
    shown = [visible(out) for _, out in outs]
    return _union_loose(shown)


def visible(df: DataFrame) -> DataFrame:
    """The result as a caller sees it: fields first, then name, rpath and schema unless fields have these names."""
    names = [c for c in df.columns if c not in CARRIED]
    return df.select(*[F.col(quote_part(c)) for c in names], *[F.col(c).alias(k) for k, c in _VARIABLES.items() if k not in names and c in df.columns])


def _plain(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") or "/")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().getPath()


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _union_loose(frames: list[DataFrame]) -> DataFrame:
    """Union of results whose fields may have other types: such fields as text."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for c in f.schema.fields:
            kinds.setdefault(c.name, set()).add(c.dataType.simpleString())
    mixed = {n for n, k in kinds.items() if len(k) > 1}
    same = [f.select(*[F.col(quote_part(c)).cast("string").alias(c) if c in mixed else F.col(quote_part(c)) for c in f.columns]) for f in frames]
    return _union(same)
