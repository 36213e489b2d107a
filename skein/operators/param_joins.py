"""Joins in which a driving row's values are the parameters of a pattern over the other side.

``{"price": {"gte": "=low", "lt": "=high"}}`` asks for every other row whose price lies in the driving
row's range. Such conditions are no equalities, and Spark would compare every pair of rows in a nested
loop. Here each kind of condition yields a key that both sides compute from their own row, so the
rows meet in an equi-join and the condition itself is checked only on what meets:

* ranges with both ends and of a few size classes are covered by cells of their own size class (STEPS + 2 at most), so
  a range meets little more than what it selects; a value lies in one cell of each size class in use;
* other ranges are cut into cells: the values of the other side give bins of equal depth, bins form groups
  of FAN, groups of groups and so on, and a range is covered by the fewest cells of any level. A
  value lies in one cell of each level, and the cells of a range don't overlap, so no pair meets twice;
* an area is covered by grid cells of its own size class (SIDE + 1 each way at most); a point lies in one cell of
  each size class in use, and is compared with the area's box before its edges;
* a wildcard is looked up by the text before its first and after its last joker together;
* conditions that exclude little (``neq``, a pattern that begins and ends with a joker) are checked on
  all pairs by definition: the driving row goes to SALTS parts of the other side.

An equality, if there is one, is the key by itself. Other keys are joined by shuffle and merge, however
small the sides are: few rows may have many pairs, and hot keys are split by AQE. Values that don't depend on the driving row are ordinary predicates on the other side
and reach its scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import compile_value
from ..functions.paths import col_path, path_type, quote_part
from .geometry import contains_point, crosses, edges, is_area
from .pattern import match as match_rows

FAN = 16                  # a power of two
LEVELS = 3                # FAN ** LEVELS bins of equal depth
STEPS = 8                 # cells along a range
SIDE = 4                  # grid cells along the longer side of an area
PREFIX = 32               # characters of each of a wildcard's literals that make its key
SHAPES = 16               # more pairs of literals' lengths than this are rounded down to powers of two
SALTS = 64
_RANGE = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def depends_on_row(value) -> bool:
    return isinstance(value, Column) or isinstance(value, str) and (value[:1] in ("=", "!") or "${" in value) \
        or isinstance(value, (list, tuple)) and any(depends_on_row(v) for v in value)


def split_match(match: dict) -> tuple[dict, list[tuple[str, str, object]]]:
    """The part of a pattern that needs no driving row, and (field, operator, value) of the rest."""
    fixed, terms = {}, []
    for field, cond in match.items():
        ops = cond if isinstance(cond, dict) else {"eq": cond}
        for op, value in ops.items():
            if depends_on_row(value):
                if op not in ("eq", "neq", "wc", "contains", *_RANGE):
                    raise ValueError(f"operator {op!r} can't take a driving row's value (field {field!r})")
                terms.append((field, op, value))
            elif isinstance(cond, dict):
                fixed.setdefault(field, {})[op] = value
            else:
                fixed[field] = cond
    return fixed, terms


def in_one_type(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType) -> tuple[Column, Column]:
    """Text that meets a number is read as a number; text that is none then compares with nothing."""
    if isinstance(a_type, T.StringType) and isinstance(b_type, T.NumericType):
        return a.try_cast("double"), b
    if isinstance(b_type, T.StringType) and isinstance(a_type, T.NumericType):
        return a, b.try_cast("double")
    return a, b


def position(c: Column, dt: T.DataType) -> Column:
    """A double that never falls as the value rises: what bins are made of. Null stays null."""
    if isinstance(dt, T.StringType):  # the first six bytes
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(dt, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), c).cast("double")
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c), F.lit(float("inf"))).otherwise(c.cast("double"))  # NaN is above all numbers
    return c.cast("double")


def _bins(facts: DataFrame, at: str) -> list[float]:
    """Borders of bins of equal depth: one aggregate, FAN ** LEVELS numbers."""
    n = FAN ** LEVELS
    got = facts.select(F.percentile_approx(at, [i / n for i in range(1, n)], 4 * n).alias("q")).first()["q"]
    return sorted({float(x) for x in got or [] if abs(x) != float("inf")})


def _bin_of(df: DataFrame, c: str, out: str, borders: list[float]) -> DataFrame:
    """The bin of a position by binary search in the JVM."""
    from pyspark.ml.feature import Bucketizer

    splits = [float("-inf"), *borders, float("inf")]
    if len(splits) < 3:
        return df.withColumn(out, F.when(F.col(c).isNotNull(), F.lit(0).cast("bigint")))
    made = Bucketizer(splits=splits, inputCol=c, outputCol="__bin", handleInvalid="keep").transform(df)
    return made.withColumn(out, F.when(F.col(c).isNotNull(), F.col("__bin").cast("bigint"))).drop("__bin")


def _cells_of_range(df: DataFrame, low: str, high: str) -> DataFrame:
    """``df`` with ``__cells``: the cells (number, level) that cover the bins low..high."""
    cell, empty = "array<struct<number:bigint,level:int>>", F.array().cast("array<struct<number:bigint,level:int>>")

    def cells(level: int, a: Column, e: Column) -> Column:
        own = F.transform(F.sequence(a, e - 1), lambda x: F.struct(x.alias("number"), F.lit(level).alias("level"))).cast(cell)
        return F.when(a < e, own).otherwise(empty)

    df = df.withColumns({"__a0": F.col(low), "__e0": F.col(high) + 1})
    for level in range(LEVELS):  # what full groups are within
        a, e = F.col(f"__a{level}"), F.col(f"__e{level}")
        df = df.withColumns({f"__a{level + 1}": F.floor((a + FAN - 1) / FAN).cast("bigint"), f"__e{level + 1}": F.floor(e / FAN).cast("bigint")})
    parts, still = [], F.lit(True)
    for level in range(LEVELS + 1):
        a, e = F.col(f"__a{level}"), F.col(f"__e{level}")
        if level == LEVELS:
            parts.append(F.when(still, cells(level, a, e)).otherwise(empty))
            break
        up_a, up_e = F.col(f"__a{level + 1}"), F.col(f"__e{level + 1}")
        inner = up_a < up_e
        both = F.concat(cells(level, a, up_a * FAN), cells(level, up_e * FAN, e))
        parts.append(F.when(still & inner, both).when(still, cells(level, a, e)).otherwise(empty))
        still = still & inner
    names = [f"__{x}{level}" for level in range(LEVELS + 1) for x in "ae"]
    return df.withColumn("__cells", F.concat(*parts)).drop(*names)


def _by_size(params: DataFrame, facts: DataFrame):
    """Both sides with ``__key`` for positions ``__at`` within ``__low``..``__high``, by cells of the ranges' own size; None
    if ends are infinite or the sizes differ by more classes than bins have levels."""
    size = F.ceil(F.log2((F.col("__high") - F.col("__low")) / STEPS)).cast("int")  # null of a single value
    endless = (F.abs("__low") == float("inf")) | (F.abs("__high") == float("inf"))
    got = params.select("__low", "__high", endless.alias("endless"), F.when(~endless, size).alias("size")) \
        .agg(F.min("__low").alias("low"), F.max("__high").alias("high"), F.bool_or("endless").alias("endless"),
             F.collect_set("size").alias("sizes"), F.bool_or(F.col("size").isNull()).alias("single")).first()  # as many sizes as a double has exponents at most
    if got["low"] is None or got["endless"]:
        return None
    least = math.frexp(max(abs(got["low"]), abs(got["high"])))[1] - 50  # cells are numbered exactly
    sizes = sorted({max(x, least) for x in [*got["sizes"], *[least] * got["single"]]})
    if len(sizes) > LEVELS + 1:
        return None

    def cell(c: Column, of: Column) -> Column:
        return F.floor(c / F.pow(F.lit(2.0), of)).cast("bigint")

    params = params.withColumn("__size", F.greatest(F.lit(least), size))
    cells = F.sequence(cell(F.col("__low"), F.col("__size")), cell(F.col("__high"), F.col("__size")))
    params = params.withColumn("__key", F.explode(F.transform(cells, lambda x: F.struct(x.alias("number"), F.col("__size").alias("level")))))
    facts = facts.where(F.col("__at").between(got["low"], got["high"]))
    own = [F.struct(cell(F.col("__at"), F.lit(x)).alias("number"), F.lit(x).alias("level")) for x in sizes]
    return params.drop("__size"), facts.withColumn("__key", F.explode(F.array(*own)))


def _by_range(params: DataFrame, facts: DataFrame, f: str, lows: list, highs: list, p_types: dict, f_type: T.DataType):
    """Both sides with the column ``__key`` for conditions ``f`` > / < parameter columns."""
    number = isinstance(f_type, T.NumericType) or any(isinstance(t, T.NumericType) for t in p_types.values())

    def at(name: str, dt: T.DataType) -> Column:
        c = F.col(name)
        if number and isinstance(dt, T.StringType):
            c, dt = c.try_cast("double"), T.DoubleType()
        return position(c, dt)

    facts = facts.withColumn("__at", at(f, f_type)).where(F.col("__at").isNotNull())
    ends = {"__low": [at(p, p_types[p]) for p in lows], "__high": [at(p, p_types[p]) for p in highs]}
    whole = {"__low": float("-inf"), "__high": float("inf")}
    for name, cols in ends.items():
        best = (F.greatest if name == "__low" else F.least)(*cols) if len(cols) > 1 else cols[0] if cols else F.lit(whole[name])
        params = params.withColumn(name, best)
        for c in cols:  # comparing with null is false
            params = params.where(c.isNotNull())
    params = params.where("__low <= __high")
    if lows and highs and (made := _by_size(params, facts)):
        return made[0].drop("__low", "__high"), made[1].drop("__at")
    borders = _bins(facts, "__at")
    params = _bin_of(_bin_of(params, "__low", "__b0", borders), "__high", "__b1", borders)
    params = _cells_of_range(params, "__b0", "__b1").withColumn("__key", F.explode("__cells"))
    used = sorted(r["level"] for r in params.select("__key.level").distinct().collect())  # LEVELS + 1 at most
    facts = _bin_of(facts, "__at", "__bin_no", borders)
    own = [F.struct(F.shiftright("__bin_no", (FAN.bit_length() - 1) * level).alias("number"), F.lit(level).alias("level")) for level in used]
    facts = facts.withColumn("__key", F.explode(F.array(*own) if own else F.array().cast("array<struct<number:bigint,level:int>>")))
    return params.drop("__low", "__high", "__b0", "__b1", "__cells"), facts.drop("__at", "__bin_no")


def _by_area(params: DataFrame, facts: DataFrame, f: str, x: str, y: str):
    """Both sides with ``__key`` for areas ``f`` of the facts that contain the points of the params; the facts
    have their box (of the outer rings) and all edges as columns."""
    outer = F.flatten(F.transform(F.col(f)["coordinates"], lambda poly: F.get(poly, 0)))
    box = {"__x0": F.array_min(F.transform(outer, lambda p: p[0])), "__x1": F.array_max(F.transform(outer, lambda p: p[0])),
           "__y0": F.array_min(F.transform(outer, lambda p: p[1])), "__y1": F.array_max(F.transform(outer, lambda p: p[1]))}
    facts = facts.where(is_area(F.col(f))).withColumns(box).withColumn("__edges", edges(F.col(f)))
    wide = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0"))
    facts = facts.where(wide > 0).withColumn("__size", F.ceil(F.log2(wide / SIDE)).cast("int"))

    def cell(v: Column, size: Column) -> Column:
        return F.floor(v / F.pow(F.lit(2.0), size)).cast("bigint")

    size = F.col("__size")
    over = F.transform(F.sequence(cell(F.col("__x0"), size), cell(F.col("__x1"), size)), lambda i: F.transform(
        F.sequence(cell(F.col("__y0"), size), cell(F.col("__y1"), size)), lambda j: F.struct(i.alias("i"), j.alias("j"), size.alias("size"))))
    facts = facts.withColumn("__key", F.explode(F.flatten(over))).drop("__size")
    used = sorted(r["size"] for r in facts.select("__key.size").distinct().collect())  # powers of two: as many as a double has at most
    ok = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    own = [F.struct(cell(F.col(x), F.lit(s)).alias("i"), cell(F.col(y), F.lit(s)).alias("j"), F.lit(s).alias("size")) for s in used]
    params = params.where(ok).withColumn("__key", F.explode(F.array(*own) if own else F.array().cast("array<struct<i:bigint,j:bigint,size:int>>")))
    return params, facts


def _in_area(x: Column, y: Column) -> Column:
    """What :func:`skein.operators.geometry.contains_point` says, from the columns of :func:`_by_area`."""
    in_box = (F.col("__x0") <= x) & (x <= F.col("__x1")) & (F.col("__y0") <= y) & (y <= F.col("__y1"))
    return in_box & (F.size(F.filter("__edges", lambda e: crosses(e, x, y))) % 2 == 1)


def _literals(p: Column) -> tuple[Column, Column]:
    """The text before a pattern's first joker and after its last; without jokers the whole pattern, twice."""
    return F.regexp_extract(p, r"\A([^*?]*)", 1), F.regexp_extract(p, r"([^*?]*)\z", 1)


def _with_parts(params: DataFrame, p: str) -> DataFrame:
    """``params`` with what :func:`_fits` asks for: nothing of a pattern is then compiled per pair unless
    there is text between its jokers."""
    pattern = F.col(p).cast("string")
    front, back = _literals(pattern)
    jokers = F.regexp_replace(pattern, r"[^*?]+", "")
    n = F.length(pattern) - F.length(F.replace(pattern, F.lit("*"), F.lit("")))
    plain = F.length(front) + F.length(back) + F.length(jokers) == F.length(pattern)
    whole = jokers == ""
    return params.withColumns({f"{p}_front": front, f"{p}_back": F.when(whole, "").otherwise(back), f"{p}_like": F.when(~(plain | whole), like_pattern(pattern)),
                               f"{p}_least": F.length(pattern) - n, f"{p}_more": n > 0})


def _fits(text: Column, p: str) -> Column:
    """Whether a text fits the pattern of ``p``, by the columns of :func:`_with_parts`."""
    like, least = F.col(f"{p}_like"), F.col(f"{p}_least")
    size = F.when(F.col(f"{p}_more"), F.length(text) >= least).otherwise(F.length(text) == least)
    return text.startswith(F.col(f"{p}_front")) & text.endswith(F.col(f"{p}_back")) & size & (like.isNull() | F.like(text, like))


def _by_wildcard(params: DataFrame, facts: DataFrame, f: str, p: str):
    """Both sides with ``__key`` for texts ``f`` that fit the patterns ``p``: by both literals, cut to PREFIX each."""
    params = params.where(F.col(p).isNotNull())
    front, back = _literals(F.col(p).cast("string"))
    params = params.withColumns({"__front": front, "__back": back, "__m": F.least(F.length(front), F.lit(PREFIX)), "__n": F.least(F.length(back), F.lit(PREFIX))})

    def shapes():
        return [(r["__m"], r["__n"]) for r in params.select("__m", "__n").distinct().collect()]  # (PREFIX + 1) ** 2 at most

    used = shapes()
    if len(used) > SHAPES:
        def rounded(c: str) -> Column:
            return F.when(F.col(c) == 0, 0).otherwise(F.shiftleft(F.lit(1), F.floor(F.log2(F.col(c).cast("double")) + 1e-9).cast("int")))

        params = params.withColumns({"__m": rounded("__m"), "__n": rounded("__n")})
        used = shapes()
    kind = "array<struct<front:string,back:string,m:int,n:int,salt:int>>"

    def key(text_front: Column, text_back: Column, m: Column, n: Column, salt: Column) -> Column:
        return F.struct(F.substring(text_front, F.lit(1), m).alias("front"), F.reverse(F.substring(F.reverse(text_back), F.lit(1), n)).alias("back"),
                        m.cast("int").alias("m"), n.cast("int").alias("n"), salt.cast("int").alias("salt"))

    salts = F.when((F.col("__m") == 0) & (F.col("__n") == 0), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    params = params.withColumn("__salt", F.explode(salts))
    params = params.withColumn("__key", key(F.col("__front"), F.col("__back"), F.col("__m"), F.col("__n"), F.col("__salt")))
    salt = F.pmod(F.xxhash64(*[F.col(quote_part(c)) for c in facts.columns if not isinstance(facts.schema[c].dataType, T.MapType)]), F.lit(SALTS)).cast("int")
    text = F.col(f).cast("string")
    own = [key(text, text, F.lit(m), F.lit(n), salt if m == n == 0 else F.lit(0)) for m, n in used]
    facts = facts.where(F.col(f).isNotNull()).withColumn("__key", F.explode((F.array(*own) if own else F.array()).cast(kind)))
    return params.drop("__front", "__back", "__m", "__n", "__salt"), facts


def _salted(params: DataFrame, facts: DataFrame):
    """Every pair is asked for: each driving row goes to SALTS parts of the other side."""
    salt = F.pmod(F.xxhash64(*[F.col(quote_part(c)) for c in facts.columns if not isinstance(facts.schema[c].dataType, T.MapType)]), F.lit(SALTS)).cast("int")
    return params.withColumn("__key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), facts.withColumn("__key", salt)


def like_pattern(p: Column) -> Column:
    """A wildcard held by a column as a LIKE pattern (see :func:`skein.operators.pattern.wildcard_like`)."""
    for ch in ("\\", "%", "_"):
        p = F.replace(p, F.lit(ch), F.lit("\\" + ch))
    return F.replace(F.replace(p, F.lit("*"), F.lit("%")), F.lit("?"), F.lit("_"))


def param_join(driver: DataFrame, facts: DataFrame, match: dict, keep: list[str] | None = None, fields: list[str] | None = None,
               prefix: str | None = None) -> DataFrame:
    """Inner join of ``driver`` with the rows of ``facts`` that its values select by the pattern ``match``.

    A condition's value is an expression over the driving row (``"=low"``) or a constant; operators are
    ``eq`` (also a bare value), ``neq``, ``gt``, ``gte``, ``lt``, ``lte``, ``wc`` and ``contains`` (a
    point ``["=x", "=y"]`` in the areas of the field). ``keep`` are the driving columns of the result (all by
    default), ``fields`` the other side's (all by default), named with ``prefix``. Comparisons with null
    are false, so a driving row with a null parameter selects nothing.
    """
    fixed, terms = split_match(match)
    facts = match_rows(facts, fixed) if fixed else facts
    keep = list(driver.columns if keep is None else keep)
    fields = list(facts.columns if fields is None else fields)
    params: dict[str, Column] = {f"__d{i}": F.col(quote_part(c)) for i, c in enumerate(keep)}
    held: dict[str, Column] = {f"__v{i}": col_path(c, facts) for i, c in enumerate(fields)}
    places = {}
    f_types, made = {}, []
    for field, op, value in terms:
        if field not in places:
            places[field] = f"__f{len(places)}"
            held[places[field]] = col_path(field, facts)
            f_types[places[field]] = path_type(facts, field)
        names = []
        for v in value if op == "contains" else [value]:
            names.append(f"__p{sum(k.startswith('__p') for k in params)}")
            params[names[-1]] = compile_value(v, driver).cast("double") if op == "contains" else compile_value(v, driver)
        made.append((places[field], op, names))
    left, right = driver.select(*[c.alias(n) for n, c in params.items()]), facts.select(*[c.alias(n) for n, c in held.items()])
    p_types = {n: left.schema[n].dataType for n in params}

    equal = [(f, ps[0]) for f, op, ps in made if op == "eq"]
    ranged = [f for f, op, _ in made if op in _RANGE]
    areas, wild = [m for m in made if m[1] == "contains"], [m for m in made if m[1] == "wc"]
    cond, merged = F.lit(True), False
    for _, _, ps in wild:
        left = _with_parts(left, ps[0])
    if equal:
        for i, (f, p) in enumerate(equal):
            a, b = in_one_type(F.col(f), f_types[f], F.col(p), p_types[p])
            left, right = left.withColumn(f"__l{i}", b), right.withColumn(f"__r{i}", a)
            e = F.col(f"__l{i}") == F.col(f"__r{i}")
            cond = e if i == 0 else cond & e
    else:
        if areas:
            f, _, (x, y) = areas[0]
            left, right = _by_area(left, right, f, x, y)
        elif ranged:
            # the field with conditions on both ends first
            f = max(dict.fromkeys(ranged), key=lambda n: len({op[0] for g, op, _ in made if g == n and op in _RANGE}))
            lows = [ps[0] for g, op, ps in made if g == f and op in ("gt", "gte")]
            highs = [ps[0] for g, op, ps in made if g == f and op in ("lt", "lte")]
            left, right = _by_range(left, right, f, lows, highs, {n: p_types[n] for n in [*lows, *highs]}, f_types[f])
        elif wild:
            left, right = _by_wildcard(left, right, wild[0][0], wild[0][2][0])
        else:
            left, right = _salted(left, right)
        for i, name in enumerate(left.schema["__key"].dataType.fieldNames() if isinstance(left.schema["__key"].dataType, T.StructType) else [""]):
            a, b = (F.col("__key")[name] if name else F.col("__key") for _ in "ab")
            left, right = left.withColumn(f"__l{i}", a), right.withColumn(f"__r{i}", b)
            e = F.col(f"__l{i}") == F.col(f"__r{i}")
            cond = e if i == 0 else cond & e
        left, right = left.drop("__key"), right.drop("__key")
        merged = True
    for f, op, ps in made:
        if op == "contains" and merged and (f, op, ps) == areas[0]:
            cond = cond & _in_area(F.col(ps[0]), F.col(ps[1]))
        elif op == "contains":
            cond = cond & contains_point(F.col(f), F.col(ps[0]), F.col(ps[1]))
        elif op == "wc":
            cond = cond & _fits(F.col(f).cast("string"), ps[0])
        elif op != "eq":
            a, b = in_one_type(F.col(f), f_types[f], F.col(ps[0]), p_types[ps[0]])
            cond = cond & (a != b if op == "neq" else _RANGE[op](a, b))
    out = [F.col(f"__d{i}").alias(c) for i, c in enumerate(keep)] + [F.col(f"__v{i}").alias((prefix or "") + c) for i, c in enumerate(fields)]
    return (left.hint("merge") if merged else left).join(right, cond, "inner").select(*out)
