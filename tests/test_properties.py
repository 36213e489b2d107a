"""Property tests: Spark expressions against small independent Python models.

Each hypothesis example is a *batch* of values evaluated in one Spark job, so a handful of
examples covers thousands of generated inputs.
"""

import re

import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import coerce
from skein.operators.pattern import search_predicate, search_tokens, wildcard_like

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])

# Latin letters, digits, spaces and punctuation (casing of other scripts differs between runtimes)
latin = st.characters(max_codepoint=0x24F, blacklist_categories=("Cs", "Cc"))
texts = st.text(alphabet=latin, max_size=40)


def _tokens(s):
    return {t for t in regex.split(r"[^\p{L}\p{N}]+", s.lower()) if t}


@SETTINGS
@given(values=st.lists(texts, min_size=40, max_size=120), query=texts)
def test_search_is_any_token_equal(spark, values, query):
    toks = set(search_tokens(query))
    expected = [bool(_tokens(v) & toks) for v in values]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r.m for r in df.select("i", search_predicate(F.col("v"), query).alias("m")).orderBy("i").collect()]
    assert got == expected


def _py_integer(s):
    t = s.strip(" ").replace(",", "")
    m = re.fullmatch(r"([+-]?\d{1,19})(\.0*)?", t, flags=re.ASCII)
    if not m:
        return None
    v = int(m.group(1))
    return v if -(2 ** 63) <= v < 2 ** 63 else None


def _py_number(s):
    t = s.strip(" ").replace(",", "")
    return float(t) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t, flags=re.ASCII) else None


def _render(n, commas, plus, pad):
    body = f"{abs(n):,}" if commas else str(abs(n))
    sign = "-" if n < 0 else ("+" if plus else "")
    return " " * pad + sign + body + " " * pad


numbers = st.builds(_render, st.integers(min_value=-(10 ** 15), max_value=10 ** 15), st.booleans(), st.booleans(),
                    st.integers(min_value=0, max_value=2))
loose = st.one_of(numbers, texts, st.from_regex(r"[+-]?\d{0,6}(\.\d{0,4})?([eE]-?\d{1,2})?", fullmatch=True))


@SETTINGS
@given(values=st.lists(loose, min_size=60, max_size=150))
def test_tolerant_numbers(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", coerce.to_integer(F.col("v")).alias("n"), coerce.to_number(F.col("v")).alias("x")) \
        .orderBy("i").collect()
    assert [r.n for r in rows] == [_py_integer(v) for v in values]
    assert [r.x for r in rows] == [_py_number(v) for v in values]


@SETTINGS
@given(values=st.lists(st.text(alphabet="ab*?_%.", max_size=6), min_size=30, max_size=80),
       pattern=st.text(alphabet="ab*?_%.", min_size=1, max_size=5))
def test_wildcard_like_is_glob(spark, values, pattern):
    rx = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    expected = [re.fullmatch(rx, v, flags=re.S) is not None for v in values]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r.m for r in df.select("i", F.col("v").like(wildcard_like(pattern)).alias("m")).orderBy("i").collect()]
    assert got == expected
