"""A queryable registry of definitions (encodings and pipeline specs) kept as a table, plus
catalog schema operations (create / encoding / drop).

Entries are rows keyed by ``urn = realm:name``; storing is a keyed upsert, recall and retrieve are
filters, aliases resolve by one self-join hop. The registry is an ordinary DataFrame, so it can be
queried, joined and written like any dataset.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import urn as make_urn
from ..operators import maintain, pattern
from ..storage import dataset_exists, replace
from .engram import from_struct, load_engram, to_struct

# Entry types each registry accepts.
ENGRAM_TYPES = ["engram", "alias"]
TRACT_TYPES = ["tract", "alias"]

ENTRY_SCHEMA = T.StructType([
    T.StructField("urn", T.StringType()),
    T.StructField("realm", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("roles", T.ArrayType(T.StringType())),
    T.StructField("smt", T.StringType()),
    T.StructField("options", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("footnote", T.StringType()),
])


def entry_row(e: dict) -> dict:
    """A definition dict -> registry row; ``fields`` (engram) or ``fibers`` (tract) go to ``body``."""
    body = {k: e[k] for k in ("fields", "fibers") if k in e}
    realm = e.get("realm") or ""
    return {
        "urn": f"{realm}:{e.get('name', '')}",
        "realm": realm,
        "name": e.get("name"),
        "type": e.get("type"),
        "source": e.get("source"),
        "description": e.get("description"),
        "tags": e.get("tags"),
        "roles": e.get("roles"),
        "smt": json.dumps(e["smt"]) if isinstance(e.get("smt"), dict) else e.get("smt"),
        "options": json.dumps(e.get("options")) if e.get("options") is not None else None,
        "body": json.dumps(body) if body else None,
        "notes": json.dumps(e["notes"]) if e.get("notes") is not None else None,
        "footnote": json.dumps(e["footnote"]) if e.get("footnote") is not None else None,
    }


def registry_frame(spark: SparkSession, entries: list[dict]) -> DataFrame:
    return spark.createDataFrame([entry_row(e) for e in entries], ENTRY_SCHEMA)


def registry_store(reg: DataFrame, entries: DataFrame, types=ENGRAM_TYPES) -> tuple[DataFrame, DataFrame]:
    """Upsert valid entries by urn; returns ``(registry, rejected)``. An entry needs a name and
    one of ``types``."""
    entries = entries.withColumn("urn", make_urn(F.col("realm"), F.col("name")))
    ok = F.coalesce((F.length(F.trim("name")) > 0) & F.col("type").isin(list(types)), F.lit(False))
    return maintain.upsert(reg, entries.where(ok), keys=["urn"]), entries.where(~ok)


def resolve_alias(reg: DataFrame) -> DataFrame:
    """Replace each ``alias`` entry by the entry its ``source`` names -- one hop only -- keeping
    the alias's urn. A left self-join on ``source = urn``; a source without a realm is ``:name``."""
    t = reg.select(*[F.col(c).alias(f"t_{c}") for c in reg.columns])
    source = F.when(reg["source"].contains(":"), reg["source"]).otherwise(F.concat(F.lit(":"), reg["source"]))
    j = reg.join(t, (reg["type"] == "alias") & (source == t["t_urn"]), "left")
    hit = F.col("t_urn").isNotNull()
    return j.select(reg["urn"], *[F.when(hit, F.col(f"t_{c}")).otherwise(reg[c]).alias(c)
                                  for c in reg.columns if c != "urn"])


def registry_recall(reg: DataFrame, urn: str, resolve: bool = False) -> DataFrame:
    if ":" not in urn:
        urn = ":" + urn
    src = resolve_alias(reg) if resolve else reg
    return src.where(F.col("urn") == urn)


def registry_retrieve(reg: DataFrame, pat: dict) -> DataFrame:
    return pattern.retrieve(reg, pat)


def registry_dull(reg: DataFrame, urn: str) -> DataFrame:
    if ":" not in urn:
        urn = ":" + urn
    return maintain.dull(reg, {"urn": urn})


def entry_dict(row) -> dict:
    d = row.asDict()
    out = {k: v for k, v in d.items() if v is not None and k not in ("smt", "options", "body", "notes", "footnote")}
    if d.get("smt"):
        out["smt"] = json.loads(d["smt"]) if d["smt"].lstrip().startswith("{") else d["smt"]
    for k in ("options", "notes", "footnote"):
        if d.get(k):
            out[k] = json.loads(d[k])
    if d.get("body"):
        out.update(json.loads(d["body"]))
    return out


def open_dataset(spark: SparkSession, reg: DataFrame, urn: str, datasets: dict | None = None, **options) -> DataFrame:
    """Open a dataset by urn: the entry supplies address, default options and encoding; the
    caller's options win. Only the one matching entry row reaches the driver."""
    from .transfer import open_origin

    if urn in ("$:engrams", "$:tracts"):
        return reg
    rows = registry_recall(reg, urn, resolve=True).limit(2).collect()
    if len(rows) != 1:
        raise KeyError(f"{urn}: {'not found' if not rows else 'ambiguous'}")
    e = entry_dict(rows[0])
    opts = dict(e.get("options") or {})
    if e.get("fields"):
        opts.setdefault("encoding", {"fields": e["fields"]})
    opts.update(options)
    return open_origin(spark, {"smt": e.get("smt"), "options": opts}, datasets)


def save_registry(reg: DataFrame, path: str):
    """Write beside the saved one, then take its place (a registry is usually derived from what is at ``path``)."""
    replace(reg, path)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The saved registry; an empty one only if nothing was saved at ``path`` (read errors are raised)."""
    if not dataset_exists(spark, path):
        return spark.createDataFrame([], ENTRY_SCHEMA)
    return spark.read.schema(ENTRY_SCHEMA).parquet(path)


# --- catalog schema operations ------------------------------------------------------------

def schema_create(spark: SparkSession, table: str, engram) -> dict:
    """Create an empty table from an encoding; ``409`` when it already exists."""
    if spark.catalog.tableExists(table):
        return {"status": 409, "message": "schema exists"}
    spark.createDataFrame([], to_struct(load_engram(engram))).write.saveAsTable(table)
    return {"status": 0, "message": "OK"}


def schema_encoding(spark: SparkSession, table: str) -> dict:
    if not spark.catalog.tableExists(table):
        return {"status": 404, "message": "no schema"}
    return {"status": 0, "data": from_struct(spark.table(table).schema, name=table)}


def schema_dull(spark: SparkSession, table: str) -> dict:
    if not spark.catalog.tableExists(table):
        return {"status": 404, "message": "no schema"}
    spark.sql(f"DROP TABLE {table}")
    return {"status": 0, "message": "OK"}
