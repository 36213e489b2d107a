"""Token counts from a tokenizer compiled to deterministic finite-state transducers.

Two transducers count the tokens of a byte-level BPE tokenizer without making the tokens:

* The *splitter* reads one symbol per character (its class) and marks where the pretokens of the
  tokenizer's split pattern begin. It has 11 states, so the effect of a chunk of text is a map
  from entry state to exit state. The maps of all fixed-size chunks are computed side by side and
  composed by a parallel prefix scan; that gives each chunk its entry state, and a second pass
  over all chunks at once emits the marks. A chunk may start anywhere, in the middle of a word.
* The *merger* (module ``bpe``) reads the bytes of a pretoken. Each of its transitions is annotated
  with the number of tokens that the byte adds to the BPE encoding of what was read. All pretoken
  runs advance in lockstep.

Results equal the tokenizers library. Nulls and empty texts have 0 tokens; texts of any length are
counted whole; repeated rows each give a row; other columns, of any name, are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, NUMBER, OTHER, RUN, SPACE, Merger, character_kinds, read_bpe
from .common import code_points, map_texts

CHUNK = 128      # characters of a splitter chunk

# symbols of the splitter
_SP, _WS, _L, _N, _O, _QUOTE, _STMD, _R, _V, _E, _LL, _CUT = range(12)
# states of the splitter
_START, _IN_L, _IN_N, _IN_O, _AFTER_QUOTE, _QUOTE_RV, _QUOTE_L, _W1S, _W1O, _WMS, _WMO = range(11)


def splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output of the splitter. Output bit 0: a pretoken begins at this symbol; bit 1: at the one before."""
    nxt, out = np.zeros((11, 12), np.uint8), np.zeros((11, 12), np.uint8)
    letters = {_L, _STMD, _R, _V, _E, _LL}

    def fresh(x):  # state after a symbol that begins a pretoken
        if x in letters:
            return _IN_L
        return {_SP: _W1S, _WS: _W1O, _N: _IN_N, _O: _IN_O, _QUOTE: _AFTER_QUOTE}[x]

    for s in range(11):
        for x in range(12):
            if x == _CUT:
                nxt[s, x], out[s, x] = _START, 1 | 2 * (s == _QUOTE_RV or s == _QUOTE_L)
                continue
            go, emit = fresh(x), 1
            if s in (_IN_L, _QUOTE_RV, _QUOTE_L) and x in letters:
                go, emit = _IN_L, 0
            elif s == _IN_N and x == _N or s == _IN_O and x in (_O, _QUOTE):
                go, emit = s, 0
            elif s == _AFTER_QUOTE:
                if x in (_O, _QUOTE):
                    go, emit = _IN_O, 0
                elif x == _STMD:
                    go, emit = _START, 0
                elif x in (_R, _V):
                    go, emit = _QUOTE_RV, 0
                elif x == _LL:
                    go, emit = _QUOTE_L, 0
            elif s in (_W1S, _W1O, _WMS, _WMO):
                many, space = s in (_WMS, _WMO), s in (_W1S, _WMS)
                if x in (_SP, _WS):
                    go, emit = (_WMS if x == _SP else _WMO), 0
                else:
                    emit = 2 * many | (not space)
                    if space:  # the blank belongs to what follows, so no contraction begins here
                        go = _IN_O if x == _QUOTE else fresh(x)
            if s in (_QUOTE_RV, _QUOTE_L):
                done = (s == _QUOTE_RV and x == _E) or (s == _QUOTE_L and x == _LL)
                if done:
                    go, emit = _START, 0
                else:
                    emit |= 2  # the letter after the quote began a pretoken after all
            nxt[s, x], out[s, x] = go, emit
    return nxt, out


def splitter_symbols(kinds: np.ndarray) -> np.ndarray:
    """Symbol of every code point."""
    table = np.zeros(len(kinds), np.uint8)
    for kind, symbol in ((LETTER, _L), (NUMBER, _N), (SPACE, _WS), (OTHER, _O)):
        table[kinds == kind] = symbol
    table[ord(" ")], table[ord("'")] = _SP, _QUOTE
    for chars, kind in (("stmd", _STMD), ("r", _R), ("v", _V), ("e", _E), ("l", _LL)):
        for c in chars:
            table[ord(c)] = kind
    return table


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Composition of all chunk maps up to and with each chunk, by doubling."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return maps


class TokenCounter:
    """The compiled tokenizer: splitter tables, character classes and merger."""

    def __init__(self, source: str, kinds: np.ndarray):
        vocab, merges, special, spec = read_bpe(source)
        pre = spec["pre_tokenizer"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("this compiler takes byte-level BPE without normalizer or added blank")
        self.special = sorted((t.encode() for t in special if t), key=len, reverse=True)
        self.classes = splitter_symbols(kinds)
        self.nxt, self.out = splitter_tables()
        self.merger = Merger(vocab, merges)

    def specials(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Leftmost, non-overlapping places of special strings that lie within one text."""
        text, found = raw.tobytes(), []
        for s in self.special:
            at = text.find(s)
            while at >= 0:
                if np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, at + len(s) - 1, side="right"):
                    found.append((at, at + len(s)))
                    at = text.find(s, at + len(s))
                else:
                    at = text.find(s, at + 1)
        kept: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if not kept or a >= kept[-1][1]:
                kept.append((a, b))
        return kept

    def begins(self, raw: np.ndarray, cuts: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Marks of the first byte of every pretoken; at ``cuts`` the splitter starts anew."""
        lead, cp = code_points(raw)
        sym = self.classes[cp]
        marks = np.zeros(len(raw) + 1, bool)
        # a cut is a symbol of its own before the character it stands at
        at = np.searchsorted(lead, cuts)
        where = np.insert(lead, at, cuts)
        sym = np.insert(sym, at, _CUT)
        n = len(sym)
        rows = -(-n // CHUNK)
        grid = np.full(rows * CHUNK, _CUT, np.uint8)
        grid[:n] = sym
        grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
        flat = self.nxt.ravel()
        maps = np.broadcast_to(np.arange(11, dtype=np.uint8), (rows, 11)).copy()
        for x in grid:
            maps = flat[maps * np.uint8(12) + x[:, None]]
        after = prefix_scan(maps)
        s = np.concatenate([np.zeros(1, np.uint8), after[:-1, _START]])
        emit = np.empty((CHUNK, rows), np.uint8)
        outs = self.out.ravel()
        for k, x in enumerate(grid):
            at = s * np.uint8(12) + x
            emit[k] = outs[at]
            s = flat[at]
        emit = emit.T.ravel()[:n]
        marks[where[(emit & 1).astype(bool)]] = True
        back = np.flatnonzero(emit & 2)
        marks[where[back - 1]] = True
        return marks[:-1]

    def count(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        n = len(offsets) - 1
        total = np.zeros(n, np.int64)
        if not len(raw):
            return total
        specials = self.specials(raw, offsets)
        edge = np.array([p for ab in specials for p in ab], np.int64)
        cuts = np.unique(np.concatenate([offsets[:-1], edge]))
        cuts = cuts[cuts < len(raw)]
        marks = self.begins(raw, cuts, edge)
        # runs: cut at texts and specials, and at the first pretoken after every RUN bytes
        places = np.flatnonzero(marks)
        grid = np.searchsorted(places, np.arange(0, len(raw), RUN))
        start = np.unique(np.concatenate([cuts, places[grid[grid < len(places)]]]))
        stop = np.append(start[1:], len(raw))
        counts = self.merger.walk(raw, start, stop, carry=1 - marks.astype(np.int64))
        counts[np.isin(start, edge[::2])] = 1  # a special string is one token
        inside = np.zeros(len(raw) + 1, np.int64)
        inside[start] = counts
        for a, b in specials:
            inside[a + 1:b] = 0
        sums = np.concatenate([[0], np.cumsum(inside[:-1])])
        return sums[offsets[1:]] - sums[offsets[:-1]]


_COMPILED: dict[int, TokenCounter] = {}


def count_tokens(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    ``tokenizer_json`` is the content of a tokenizers file (a vocabulary: its size doesn't grow with
    the data). Null text counts as empty: 0 bytes, 0 tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, character_kinds()))

    def fn(raw, offsets):
        source, kinds = shared.value
        key = hash(source)
        if key not in _COMPILED:  # once per Python worker
            _COMPILED.clear()
            _COMPILED[key] = TokenCounter(source, kinds)
        return {"n_bytes": np.diff(offsets), "n_tokens": _COMPILED[key].count(raw, offsets)}

    got = map_texts(docs, text_col, "n_bytes bigint, n_tokens bigint", fn, [id_col])
    return got.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
