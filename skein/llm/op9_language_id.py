"""Language identification by cross-parsing entropy.

One suffix automaton is built per language from a bounded sample of labelled text. A text is parsed
greedily into the longest phrases that occur in a language's sample; a language that resembles the
text yields long phrases, hence few of them. With samples of N characters, c phrases of a text of n
characters cost about c * log2(N) / n bits a character (cross-parsing estimate of the relative
entropy); the language with the least wins, ties going to the smaller name.

The automata are compiled to transitions: a missing transition ends the phrase and starts the next
one at the same character, so parsing is a walk with a counter. Every letter of the samples is a symbol
of its own. The most frequent ones have columns in a dense table; transitions by all others, which in large
scripts are most letters, are kept sparse, as sorted keys. Texts are parsed in blocks of BLOCK characters,
all blocks of a batch and all languages in lockstep; a phrase ends at a block's end, which adds less
than one phrase per block to every language alike.

Texts that are null, empty or without a letter get ``und`` and score 0. Without any training text
every text gets ``und``. Texts are read whole; repeated rows each give a row; other columns, of any
name, are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, map_texts

BLOCK = 512
SAMPLE_CHARS = 40_000  # per language: the documented bound of the training sample
PASSAGE = 1_000        # characters that one text adds to it at most
SYMBOLS = 64           # columns of the dense table. 0: not a letter; the last: letters that no sample has


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of ``symbols``."""
    nxt, link, size = [{}], [-1], [0]
    end = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        size.append(size[end] + 1)
        link.append(0)
        p = end
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        end = cur
    return nxt


def lower_table() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower case (where that is one character) and whether it is a letter."""
    low, letter = np.arange(0x110000, dtype=np.int32), np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            t = c.lower()
            if len(t) == 1:
                low[i] = ord(t)
    return low, letter


def training_sample(docs: DataFrame, lang_col: str, text_col: str, id_col: str, chars: int) -> DataFrame:
    """lang, passage and u (the sorting key) of a sample with about twice ``chars`` characters a language.

    Each sampled text gives one passage of at most PASSAGE characters, so that no text dominates.
    Which rows and passages follows from a hash of the id, so a lost task draws the same ones.
    """
    def hashed(tag):
        return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(tag))

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
                       (F.pmod(hashed("row"), F.lit(1 << 30)) / F.lit(1 << 30)).alias("u"), hashed("place").alias("place")) \
        .where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return rows.select("lang", F.col("text").alias("passage"), "u")
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, 2.0 * chars / PASSAGE / n)])
    return rows.where(F.col("u") < share[F.col("lang")]).select(
        "lang", F.expr(f"substring(text, int(pmod(place, greatest(1, length(text) - {PASSAGE} + 1))) + 1, {PASSAGE})").alias("passage"), "u")


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
        chars: int = SAMPLE_CHARS) -> dict:
    """Sampled text of each language and the common alphabet; at most ``chars`` characters a language."""
    def join_passages(key, group: pd.DataFrame) -> pd.DataFrame:
        text = " ".join(group.sort_values(["u", "passage"])["passage"]).lower()
        return pd.DataFrame({"lang": [key[0]], "sample": ["".join(c if c.isalpha() else " " for c in text)[:chars]]})

    sample = training_sample(docs, lang_col, text_col, id_col, chars)
    texts = {r["lang"]: r["sample"] for r in sample.groupBy("lang").applyInPandas(join_passages, "lang string, sample string").collect()}
    seen = Counter(c for t in texts.values() for c in t if c != " ")
    # by falling frequency: 1 .. SYMBOLS - 2 are dense, from SYMBOLS on sparse
    symbols = {c: k + 1 if k < SYMBOLS - 2 else k + 2 for k, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])))}
    return {"langs": sorted(texts), "symbols": symbols, "samples": texts}


class Parser:
    """Compiled automata: symbol tables and one transition table for all languages."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        low, self.letter = lower_table()
        sym = np.zeros(0x110000, np.int32)
        sym[self.letter] = SYMBOLS - 1  # letters that the samples don't have
        for c, k in model["symbols"].items():
            sym[ord(c)] = k
        self.sym = sym[low]
        self.codes = max([SYMBOLS, *(k + 1 for k in model["symbols"].values())])
        tables, self.roots, self.cost, base = [], [], [], 0
        keys, to_of, self.rare_roots = [], [], np.zeros((len(self.langs), self.codes - SYMBOLS), np.int32)
        for number, lang in enumerate(self.langs):
            text = model["samples"][lang]
            coded = [int(x) for x in self.sym[[ord(c) for c in text]]] if text else []
            auto = suffix_automaton(coded)
            t = np.full((len(auto), SYMBOLS), -1, np.int64)
            self.rare_roots[number] = base
            for s, edges in enumerate(auto):
                for c, to in edges.items():
                    if c < SYMBOLS:
                        t[s, c] = to + base
                    else:
                        keys.append((s + base) * self.codes + c)
                        to_of.append(to + base)
                        if s == 0:
                            self.rare_roots[number, c - SYMBOLS] = to + base
            root = np.where(t[0] < 0, base, t[0])  # a character that no sample has is a phrase by itself
            missing = t < 0
            t = np.where(missing, root[None, :], t)
            tables.append((t << 1 | missing).astype(np.int32))
            self.roots.append(base)
            self.cost.append(math.log2(max(2, len(text))))
            base += len(auto)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)  # the last is no transition
        self.to_of = np.append(np.array(to_of, np.int32)[order], 0)

    def parse(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language (index, -1: none) and score of each text."""
        n = len(offsets) - 1
        lead, cp = code_points(raw)
        bounds = np.searchsorted(lead, offsets)
        letters = np.concatenate([[0], np.cumsum(self.letter[cp])])
        has = letters[bounds[1:]] > letters[bounds[:-1]]
        size = np.diff(bounds)
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(n), blocks)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = bounds[:-1][owner] + k * BLOCK
        length = np.minimum(BLOCK, bounds[1:][owner] - start)
        order = np.argsort(-length, kind="stable")
        first, span = start[order], length[order]
        live = len(span) - np.searchsorted(span[::-1], np.arange(span[0] if len(span) else 0), side="right")
        sym = self.sym[cp]
        any_rare = bool(len(sym)) and int(sym.max()) >= SYMBOLS
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(order), 1)
        phrases = np.ones((len(self.langs), len(order)), np.int32)
        for p, m in enumerate(live.tolist()):
            c = sym[first[:m] + p]
            rare = np.flatnonzero(c >= SYMBOLS) if any_rare else ()
            if len(rare):
                key = state[:, rare].astype(np.int64) * self.codes + c[rare]
                at = np.searchsorted(self.keys, key)
                known = self.keys[at] == key
                after = np.where(known, self.to_of[at], self.rare_roots[:, c[rare] - SYMBOLS])
                c = np.minimum(c, SYMBOLS - 1)
            to = self.table[state[:, :m] * SYMBOLS + c]
            if len(rare):
                to[:, rare] = after << 1 | ~known
            phrases[:, :m] += to & 1
            state[:, :m] = to >> 1
        total = np.zeros((len(self.langs), n))
        for row, got in zip(total, phrases):
            row += np.bincount(owner[order], weights=got, minlength=n)
        best, score = np.full(n, -1, np.int64), np.zeros(n)
        if len(self.langs):
            bits = total * np.array(self.cost)[:, None] / np.maximum(size, 1)
            ranked = np.sort(bits, axis=0)
            best = np.where(has, bits.argmin(axis=0), -1)
            if len(self.langs) > 1:
                score = np.where(has, ranked[1] / np.maximum(ranked[0] + ranked[1], 1e-12), 0.0)
            else:
                score = np.where(has, 1.0, 0.0)
        return best, score


_PARSERS: dict[int, Parser] = {}


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (0.5: a tie; towards 1: the second language needs far more phrases)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(raw, offsets):
        key = hash(tuple(sorted(shared.value["samples"].items())))
        if key not in _PARSERS:  # once per Python worker
            _PARSERS.clear()
            _PARSERS[key] = Parser(shared.value)
        parser = _PARSERS[key]
        best, score = parser.parse(raw, offsets)
        names = np.array([*parser.langs, "und"], object)
        return {"lang_pred": pa.array(names[best], pa.string()), "score": score}

    return map_texts(docs, text_col, "lang_pred string, score double", fn, [id_col])
