"""Byte-pair merging compiled to a deterministic transducer, shared by token counting and packing.

A pretoken is read symbol by symbol (its bytes; a vocabulary with word ends marks the last one by
adding 256). A state holds the symbols that may still become part of a longer token, with the last
token of the encoding at each of those positions: everything that can matter later. The encoding of
``s + c`` ends with the one token t such that BPE keeps (last token before t, t) apart, so a new
transition needs only pairwise checks, never the whole text. Each transition is annotated with the
number of tokens that it adds to the encoding (zero or less if merges join earlier tokens). States
and transitions are compiled when first met.
"""

from __future__ import annotations

import json

import numpy as np
import tokenizers

RUN = 256            # symbols after which a run of pretokens is cut at the next pretoken
FEW = 32             # a prefix of at most so many longer tokens has its contexts merged
MANY = "many"
MAX_STATES = 64_000  # states kept; beyond that, or beyond TABLE_BYTES, compilation starts anew (results stay the same)
TABLE_BYTES = 80 << 20
MAX_ALIKE = 100_000  # contexts of tokens kept when compilation starts anew
COLUMNS = 32         # the transition table grows by so many columns: one per symbol that texts have
LETTER, NUMBER, SPACE, OTHER = range(4)


def character_kinds() -> np.ndarray:
    """Letter, number, space or other for every code point, asked of the library's own patterns so
    that its Unicode version counts."""
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = [(k, tokenizers.pre_tokenizers.Split(tokenizers.Regex(p), "removed", invert=True))
             for k, p in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+"))]
    for low in range(0, 0x110000, 0x800):
        if 0xD800 <= low < 0xE000:
            continue
        block = "".join(map(chr, range(low, low + 0x800)))
        for kind, probe in kinds:
            for _, (a, b) in probe.pre_tokenize_str(block):
                table[low + a:low + b] = kind
    return table


def read_bpe(source: str) -> tuple[dict[str, int], dict[tuple[int, int], tuple[int, int]], list[str], dict]:
    """Vocabulary by symbols, merges by ids, special strings and the whole specification of a BPE file."""
    spec = json.loads(source)
    if spec["model"]["type"] != "BPE" or spec["model"].get("dropout") or spec["model"].get("ignore_merges"):
        raise ValueError("this compiler takes plain BPE")
    # the byte-level alphabet: printable bytes stand for themselves, the others from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    suffix = spec["model"].get("end_of_word_suffix") or ""
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}

    def symbols(token: str) -> str:
        if suffix and token.endswith(suffix):
            token = token[:-len(suffix)]
            return "".join(chr(alphabet[c]) for c in token[:-1]) + chr(256 + alphabet[token[-1]])
        return "".join(chr(alphabet[c]) for c in token)

    ids = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges[ids[a], ids[b]] = (rank, ids[a + b])
    return {symbols(t): i for t, i in ids.items()}, merges, list(special), spec


class Merger:
    """Lazily compiled transducer over the symbols of a pretoken."""

    def __init__(self, vocab: dict[str, int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.vocab, self.merges = vocab, merges
        #: the table's column of each symbol, -1 for symbols that no text had yet, and the symbol of each column
        self.column = np.full(512 if any(ord(t[-1]) > 255 for t in vocab) else 256, -1, np.int32)
        self.symbols: list[int] = []
        self.width = COLUMNS
        self.spell = {i: t for t, i in vocab.items()}
        self.size = np.zeros(max(self.spell) + 1, np.int32)
        for i, t in self.spell.items():
            self.size[i] = len(t)
        #: for the proper prefixes of tokens, the tokens that begin with them
        self.longer: dict[str, list[int] | str] = {}
        for t, i in vocab.items():
            for k in range(1, len(t)):
                more = self.longer.setdefault(t[:k], [])
                if more is not MANY:
                    more.append(i)
                    if len(more) > FEW:
                        self.longer[t[:k]] = MANY
        self.alike: dict = {}
        self.first_alike: dict = {}
        self.parts = {t: (x, y, rank) for (x, y), (rank, t) in merges.items()}
        self.spines: tuple[dict, dict] = ({}, {})
        self.whole: dict[int, bool] = {}
        self.reset()

    def reset(self):
        if len(self.alike) > MAX_ALIKE:  # no state is left that was named by them
            self.alike, self.first_alike, self.spines, self.whole = {}, {}, ({}, {}), {}
        self.ids, self.info, self.last = {}, [], np.full(8192, -1, np.int32)
        #: next state << 8 | tokens added + 128; -1: not compiled yet
        self.table = np.full((8192, self.width), -1, np.int32)
        self.state("", (-1,), (0,))

    def state(self, window: str, last: tuple, rel: tuple) -> int:
        key = (window, last, rel)
        if key not in self.ids:
            n = self.ids[key] = len(self.info)
            self.info.append(key)
            if n >= len(self.table):
                more = len(self.table) // 4
                self.table = np.concatenate([self.table, np.full((more, self.width), -1, np.int32)])
                self.last = np.concatenate([self.last, np.full(more, -1, np.int32)])
            self.last[n] = last[-1]
        return self.ids[key]

    def encode(self, piece: str) -> list[int]:
        """Plain BPE of a short piece."""
        ids = [self.vocab[c] for c in piece]
        while len(ids) > 1:
            best = min((self.merges.get(p, (1 << 30, 0))[0], i) for i, p in enumerate(zip(ids, ids[1:])))
            if best[0] == 1 << 30:
                break
            i = best[1]
            ids[i:i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The symbols that stand at the left (0) or right (1) edge of a token while BPE builds it,
        each with the rank of the merge that takes it up."""
        got = self.spines[side].get(token)
        if got is None:
            got = self.spines[side][token] = [(token, float("inf"))]
            x = token
            while x in self.parts:
                *two, rank = self.parts[x]
                x = two[side]
                got.append((x, rank))
        return got

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE of a's and b's bytes is (a, b); a = -1: whether b is the BPE of its own bytes.

        A merge across the border happens if its rank comes before both of its symbols are taken up
        by merges of their own side (of equal merges the leftmost is first)."""
        if a < 0:
            if b not in self.whole:
                self.whole[b] = self.encode(self.spell[b]) == [b]
            return self.whole[b]
        merges = self.merges
        right = self.spine(b, 0)
        for x, x_taken in self.spine(a, 1):
            for y, y_taken in right:
                m = merges.get((x, y))
                if m is not None and m[0] < x_taken and m[0] <= y_taken:
                    return False
        return True

    def follow(self, last, begun: str):
        """What must be known of the last token before ``begun``: nothing if no longer token can come
        from there; else the token, or for few such longer tokens the first token that allows the same ones."""
        more = self.longer.get(begun)
        if last is None or more is None:
            return None
        if more is MANY:
            return last
        if (last, begun) not in self.alike:
            allowed = tuple(t for t in more if self.apart(-1, t) and self.apart(last, t))
            self.alike[last, begun] = self.first_alike.setdefault((begun, allowed), last) if allowed else None
        return self.alike[last, begun]

    def compile(self, s: int, symbol: int) -> None:
        window, last, rel = self.info[s]
        if window and ord(window[-1]) > 255:  # a word has ended: the next symbol begins another
            window, last, rel = self.info[0]
        text = window + chr(symbol)
        for j in range(len(text)):
            token = self.vocab.get(text[j:])
            if token is not None and last[j] is not None and self.apart(-1, token) and self.apart(last[j], token):
                break
        now = rel[j] + 1  # rel is 0 at the end of the window
        if symbol > 255:
            state = self.state(chr(symbol), (None, token), (None, 0))
        else:
            # keep the positions from which a longer token may still come
            alive = [self.follow(last[k], text[k:]) for k in range(len(text))]
            first = next((k for k, a in enumerate(alive) if a is not None), len(text))
            state = self.state(text[first:], (*alive[first:], token),
                               (*(None if alive[k] is None else rel[k] - now for k in range(first, len(text))), 0))
        self.table[s, self.column[symbol]] = state << 8 | now + 128

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        """The column of each symbol; symbols that are new get one."""
        got = self.column[symbols]
        new = np.unique(symbols[got < 0])
        if len(new):
            self.column[new] = np.arange(len(self.symbols), len(self.symbols) + len(new))
            self.symbols += new.tolist()
            if len(self.symbols) > self.width:
                self.width = -(-len(self.symbols) // COLUMNS) * COLUMNS
                wider = np.full((len(self.table), self.width), -1, np.int32)
                wider[:, :self.table.shape[1]] = self.table
                self.table = wider
            got = self.column[symbols]
        return got

    def walk(self, symbols: np.ndarray, start: np.ndarray, stop: np.ndarray, carry: np.ndarray | None = None,
             states: np.ndarray | None = None) -> np.ndarray:
        """Read all runs symbols[start:stop] in lockstep; return the tokens added in each.

        ``carry`` is 0 at symbols that begin a pretoken and 1 elsewhere (with word ends it isn't
        needed); ``states`` receives the state after each symbol. A run begins with a pretoken.
        """
        if len(self.info) > MAX_STATES or self.table.nbytes > TABLE_BYTES:
            self.reset()
        symbols = self.columns(symbols)
        order = np.argsort(start - stop, kind="stable")
        first, size = start[order], (stop - start)[order]
        total, s = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        # how many runs are longer than p, for each p
        live = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), side="right")
        flat = self.table.ravel()
        for p, n in enumerate(live.tolist()):
            at = first[:n] + p
            c = symbols[at]
            cur = s[:n]
            if carry is not None:
                cur = cur * carry[at]
            key = cur * self.width + c
            to = flat[key]
            if to.min() < 0:
                for k in np.unique(key[to < 0]).tolist():
                    self.compile(k // self.width, self.symbols[k % self.width])
                flat = self.table.ravel()
                to = flat[key]
            total[:n] += to & 255
            s[:n] = to >> 8
            if states is not None:
                states[at] = s[:n]
        out = np.empty_like(total)
        out[order] = total - 128 * size
        return out
