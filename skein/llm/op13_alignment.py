"""Alignment of two tokenizers' tokens by whitespace-token anchors.

Texts are tokenised in full by both tokenizers: a blank and the text by the byte-level one (A), the
text by the other (B), which puts the blank there itself. Neither has tokens that go from another
character on into a blank, nor does the splitter of A, so a text is parted where a blank follows a
visible character, and each distinct stretch is tokenised once per worker (a vocabulary of B that
has such tokens is noticed, and texts are then tokenised whole). Where characters and vocabulary allow it,
A's merges are made by rank, which comes to the same as the tokenizers library in a sixth of the time.

Where a token of A and a token of B end at the same byte and both next tokens begin with a marked
space, the ends are checked to be shared and the tokens are split. Between two such anchors lies a
window of token ids, mostly one word; a window is aligned once per worker and its tuple of ids is
remembered, with its groups and links. Groups are what shared ends cut the tokens into; a link is a pair
of tokens whose bytes overlap.

Per document only its distinct id pairs, with how often each is linked, are stored. Each task sums
them up before anything is shuffled: how many documents hold a pair. Counts are joined back in two ways: the
most frequent pairs, HOT_PAIRS at most, are broadcast; if there are more, the rarer pairs of
each document meet their counts in a join, which never holds a frequent pair.

Null and empty texts, and texts whose joined token bytes of either side are not blank and text
(characters that one of the tokenizers replaces), have no tokens: zeros and an empty digest. Strings
of special tokens are plain text. Texts are tokenised whole, however long. Rows that repeat an id are
documents each, rows without an id too. An empty table gives no rows. Other columns, of any name, are
not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, NUMBER, OTHER, character_kinds
from .bpe import SPACE as SPACE_KIND
from .common import code_points, drop_staged, slices, staged, text_buffers

SPACE = "▁"
#: Fixed value: how byte-level vocabularies of this kind split texts
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HOT_PAIRS = 2_000_000
MEMO_TOKENS = 3_000_000   # id pairs and windows that a worker remembers
PART_PAIRS = 1_000_000    # pairs a task holds while it sums up
SLICE = 1 << 20           # bytes of text that are tokenised at once


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable characters of
    Latin-1 stand for themselves, the other bytes, in order, for the characters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace(SPACE, " ").encode()


class Side:
    """Bytes of all tokens of a vocabulary, flat, which of them begin with a space, and their ids as text
    with the sign that follows inside of a group and at its end."""

    def __init__(self, tokens: list[bytes], end: str):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.start = np.cumsum(self.size) - self.size
        self.spaced = np.array([t[:1] == b" " for t in tokens], bool)
        self.names = [f"{i}{sign}" for i in range(len(tokens)) for sign in (",", end)]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens one after another."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def merge_ranks(source: str) -> dict[bytes, int] | None:
    """Bytes to rank of a byte-level vocabulary if merging by rank is the same as merging by its list.

    That is so if ids rise along the merges and every token's bytes come to that token: then, whenever
    the lowest rank is that of a token, its two parts are the pair of the list. Else null.
    """
    spec = json.loads(source)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False}
    if spec["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space") \
            or any(model.get(k) not in (v, "", False, None) for k, v in plain.items() if k != "type") or model["type"] != "BPE":
        return None
    byte, special = byte_alphabet(), {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    pairs, before = {}, -1
    for pair in model["merges"]:
        x, y = (bytes(byte[c] for c in t) for t in (pair if isinstance(pair, list) else pair.split(" ")))
        if ranks.get(x + y, -1) <= before:
            return None
        before = ranks[x + y]
        pairs[x, y] = before
    for t in ranks:
        parts = [t[i:i + 1] for i in range(len(t))]
        while len(parts) > 1:
            best = min((pairs.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 60:
                return None
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return ranks


def settled_characters(kinds: np.ndarray) -> np.ndarray:
    """Per code point: whether its kind (letter, number, space or other) is the same in the oldest and the newest
    character tables at hand and in the library's. For these, splitters agree, whatever their tables' version."""
    spaces = {*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    old, kind = unicodedata.ucd_3_2_0.category, {"L": LETTER, "N": NUMBER}
    out = np.zeros(len(kinds), bool)
    for cp in range(len(kinds)):
        c = chr(cp)
        then = old(c)
        if then != "Cn" and then != "Cs":
            own = SPACE_KIND if cp in spaces else kind.get(then[0], OTHER)
            out[cp] = own == kinds[cp] == (SPACE_KIND if cp in spaces else kind.get(unicodedata.category(c)[0], OTHER))
    return out


class Growing:
    """An array that grows at its end."""

    def __init__(self):
        self.held, self.n = np.zeros(1024, np.int64), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(len(self.held), len(values)), np.int64)])
        self.held[self.n:self.n + len(values)] = values
        self.n += len(values)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start .. start + size of all spans, one span after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Aligner:
    """Tokenizes, splits at anchors and aligns windows, remembering them.

    ``ranks`` and ``settled``: the vocabulary of A as merge ranks and the characters that splitters agree
    on, from the driver. Stretches of such characters are tokenised by ranks, which is faster and comes to the
    same; all others, and all if there are no ranks, by the tokenizers library.
    """

    def __init__(self, source_a: str, model_b: bytes, ranks: dict[bytes, int] | None = None, settled: np.ndarray | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_str(source_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.fast = None if ranks is None else tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.settled = settled
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        byte = byte_alphabet()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.side_a = Side([t.encode() if t in special or any(c not in byte for c in t) else bytes(byte[c] for c in t)
                            for t in (names.get(i, "") for i in range(max(names, default=-1) + 1))], "|")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.side_b = Side([piece_bytes(t, self.b.is_byte(i)) for i, t in enumerate(pieces)], ";")
        self.names = self.side_a.names + self.side_b.names
        self.width = len(pieces)
        self.parted = not any(SPACE in t.lstrip(SPACE) for t in pieces)
        self.forget()

    def forget(self) -> None:
        self.stretches: dict[str, int] = {}  # by text: its place in what follows, -1 if the bytes differ
        self.windows: dict[bytes, int] = {}  # by the ids of both sides
        self.text: list[str] = []            # groups, each closed by ;
        self.pairs, self.pair_at, self.sizes = Growing(), Growing(), (Growing(), Growing(), Growing())
        self.pair_at.add(np.zeros(1, np.int64))

    def stretch_texts(self, text: str) -> list[str]:
        """A blank and the text, parted where a blank follows a visible character."""
        if not self.parted:
            return [" " + text]
        pieces = text.split(" ")
        if "" not in pieces and all(map(str.isprintable, pieces)):
            return [" " + p for p in pieces]
        out, open_end = [], False
        for k, piece in enumerate(pieces):
            if open_end or out and not piece and k == len(pieces) - 1:  # B gives no tokens for a last blank by itself
                out[-1] += " " + piece
            else:
                out.append(" " + piece)
            last = out[-1][-1]
            open_end = last == " " or not last.isprintable()
        return out

    def tokens_a(self, texts: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches one after another, and how many each has."""
        if self.fast is None or not self.parted:
            of = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        else:
            whole = b"".join(raw)
            lead, cp = code_points(np.frombuffer(whole, np.uint8))
            ends = np.cumsum([len(r) for r in raw])
            odd = np.unique(np.searchsorted(ends, lead[~self.settled[cp]], side="right")).tolist()
            # blanks at the end of a stretch would run into those that begin the next one
            loose = [i for i, t in enumerate(texts) if t[-1] == " " or not t[-1].isprintable()]
            if not odd and not loose:  # a blank follows a visible character: no token goes over from one into another
                ids = np.array(self.fast.encode_ordinary(whole.decode("utf-8", "replace")), np.int64)
                last = np.searchsorted(np.cumsum(self.side_a.size[ids]), ends)
                return ids, np.diff(np.concatenate([[-1], last]))
            apart = np.zeros(len(texts), bool)
            apart[odd] = apart[loose] = True
            joint = np.flatnonzero(~apart).tolist()
            of: list = [None] * len(texts)
            if joint:
                ids, count = self.tokens_a([texts[i] for i in joint], [raw[i] for i in joint])
                for i, own in zip(joint, np.split(ids, np.cumsum(count)[:-1])):
                    of[i] = own.tolist()
            odd_ones = set(odd)
            for i in loose:
                if i not in odd_ones:
                    of[i] = self.fast.encode_ordinary(texts[i])
            for i, e in zip(odd, self.a.encode_batch([texts[i] for i in odd], add_special_tokens=False)):
                of[i] = e.ids
        return np.fromiter(chain.from_iterable(of), np.int64), np.array([len(x) for x in of])

    def learn(self, texts: list[str]) -> None:
        """Tokenizes stretches, splits them at their anchors and aligns the windows that are new."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        ids_a, count_a = self.tokens_a(texts, raw)
        of_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        ids_b, count_b = np.fromiter(chain.from_iterable(of_b), np.int64), np.array([len(x) for x in of_b])
        want = np.array([len(r) for r in raw])
        good = self.whole(ids_a, count_a, self.side_a, raw, want) & self.whole(ids_b, count_b, self.side_b, raw, want)
        if not good.all():
            self.stretches.update((texts[i], -1) for i in np.flatnonzero(~good).tolist())
            texts, want = [t for t, ok in zip(texts, good) if ok], want[good]
            ids_a, ids_b = ids_a[np.repeat(good, count_a)], ids_b[np.repeat(good, count_b)]
        if not texts:
            return
        ends_a, ends_b, close = np.cumsum(self.side_a.size[ids_a]), np.cumsum(self.side_b.size[ids_b]), np.cumsum(want)
        # groups: what shared ends cut; anchors: shared ends before tokens that both begin with a space
        at = np.searchsorted(ends_b, ends_a)
        last_a = np.flatnonzero(ends_b[at] == ends_a)
        last_b, shared = at[last_a], ends_a[last_a]
        anchor = np.ones(len(shared), bool)
        anchor[:-1] = self.side_a.spaced[ids_a[last_a[:-1] + 1]] & self.side_b.spaced[ids_b[last_b[:-1] + 1]]
        anchor[np.searchsorted(shared, close)] = True  # in the text a blank follows there
        stop = np.flatnonzero(anchor)
        # links: between any two neighbouring ends of either side lies what one token of each shares
        ends = np.union1d(ends_a, ends_b)
        pairs = ids_a[np.searchsorted(ends_a, ends)] * self.width + ids_b[np.searchsorted(ends_b, ends)]
        link_stop = np.searchsorted(ends, shared[stop]) + 1
        # tokens in the order of the groups' text: A's, then B's of each group
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        first = np.cumsum(size_a + size_b) - size_a - size_b
        name = np.empty(len(ids_a) + len(ids_b), np.int64)
        closing_a, closing_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        closing_a[last_a] = closing_b[last_b] = 1
        name[spans(first, size_a)] = ids_a * 2 + closing_a
        name[spans(first + size_a, size_b)] = len(self.side_a.names) + ids_b * 2 + closing_b
        parts = list(map(self.names.__getitem__, name.tolist()))
        stop_a, stop_b = last_a[stop] + 1, last_b[stop] + 1
        bytes_a, bytes_b = ids_a.astype("<u4").tobytes(), ids_b.astype("<u4").tobytes()
        numbers, new, a0, b0, n = [], [], 0, 0, len(self.text)
        windows, text = self.windows, self.text
        for k, (a1, b1) in enumerate(zip(stop_a.tolist(), stop_b.tolist())):
            key = bytes_a[4 * a0:4 * a1] + b"\xff\xff\xff\xff" + bytes_b[4 * b0:4 * b1]
            w = windows.get(key)
            if w is None:
                w = windows[key] = n
                n += 1
                new.append(k)
                text.append("".join(parts[a0 + b0:a1 + b1]))
            numbers.append(w)
            a0, b0 = a1, b1
        new = np.array(new, np.int64)
        sizes = [np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0), np.diff(stop, prepend=-1)]
        links = np.diff(link_stop, prepend=0)
        self.remember([x[new] for x in sizes], links[new], pairs[spans((link_stop - links)[new], links[new])])
        # a stretch of several windows is kept as a whole
        upto, n0 = (np.searchsorted(shared[stop], close) + 1).tolist(), 0
        for t, n1 in zip(texts, upto):
            self.stretches[t] = numbers[n0] if n1 == n0 + 1 else self.several(numbers[n0:n1])
            n0 = n1

    def remember(self, sizes: list[np.ndarray], links: np.ndarray, pairs: np.ndarray) -> None:
        for held, own in zip(self.sizes, sizes):
            held.add(own)
        self.pair_at.add(self.pair_at.held[self.pair_at.n - 1] + np.cumsum(links))
        self.pairs.add(pairs)

    def several(self, numbers: list[int]) -> int:
        at, size = self.pair_at.held[numbers], self.pair_at.held[np.array(numbers) + 1] - self.pair_at.held[numbers]
        self.text.append("".join([self.text[w] for w in numbers]))
        self.remember([x.held[numbers].sum(keepdims=True) for x in self.sizes], size.sum(keepdims=True), self.pairs.held[spans(at, size)])
        return len(self.text) - 1

    @staticmethod
    def whole(ids: np.ndarray, count: np.ndarray, side: Side, raw: list[bytes], want: np.ndarray) -> np.ndarray:
        """Which stretches are what their tokens' bytes make, joined."""
        upto = np.concatenate([[0], np.cumsum(side.size[ids])])[np.concatenate([[0], np.cumsum(count)])]
        good = (np.diff(upto) == want) & (count > 0)
        flat = side.joined(ids)[np.repeat(good, np.diff(upto))]
        wrong = np.flatnonzero(flat != np.frombuffer(b"".join(r for r, ok in zip(raw, good.tolist()) if ok), np.uint8))
        if len(wrong):
            good[np.flatnonzero(good)[np.unique(np.searchsorted(np.cumsum(want[good]), wrong, side="right"))]] = False
        return good

    def texts(self, raw: np.ndarray, offsets: np.ndarray) -> dict:
        """Columns of all texts: n_a, n_b, n_groups, n_links, digests (empty without tokens), and pairs with links, flat, and
        their number per text."""
        if self.pairs.n + len(self.text) > MEMO_TOKENS:
            self.forget()
        n = len(offsets) - 1
        whole = [raw[offsets[i]:offsets[i + 1]].tobytes() for i in range(n)]
        texts = [t.decode("utf-8", "replace") for t in whole]
        parts = [self.stretch_texts(t) if t else [] for t in texts]
        flat, known = list(chain.from_iterable(parts)), self.stretches
        seen = list(map(known.get, flat))
        if None in seen:
            self.learn(list(dict.fromkeys(p for p, w in zip(flat, seen) if w is None)))
            seen = [known[p] if w is None else w for p, w in zip(flat, seen)]
        ends = np.cumsum([len(own) for own in parts])
        seq, owner = np.array(seen, np.int64), np.repeat(np.arange(n), np.diff(ends, prepend=0))
        good = np.diff(ends, prepend=0) > 0
        good[owner[seq < 0]] = False
        good[[i for i, (t, r) in enumerate(zip(texts, whole)) if "\ufffd" in t and t.encode() != r]] = False
        digests, at = [], 0
        for i, end in enumerate(ends.tolist()):
            digests.append(hashlib.sha256("".join(map(self.text.__getitem__, seen[at:end]))[:-1].encode()).hexdigest() if good[i] else "")
            at = end
        kept = good[owner]
        seq, owner = seq[kept], owner[kept]
        out = {name: np.bincount(owner, x.held[seq], n).astype(np.int64) for name, x in zip(("n_a", "n_b", "n_groups"), self.sizes)}
        links = self.pair_at.held[seq + 1] - self.pair_at.held[seq]
        of, pairs = np.repeat(owner, links), self.pairs.held[spans(self.pair_at.held[seq], links)]
        order = np.lexsort((pairs, of))
        of, pairs = of[order], pairs[order]
        first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (pairs[1:] != pairs[:-1])])) if len(of) else np.zeros(0, np.int64)
        out |= {"n_links": np.bincount(of, minlength=n), "digest": digests, "pairs": pairs[first], "links": np.diff(np.append(first, len(of))), "distinct": np.bincount(of[first], minlength=n)}
        return out


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in 4 bytes each where they fit, else in 8; the first byte tells which."""
    small = not len(values) or int(values.max()) < 1 << 32
    return (b"\4" if small else b"\10") + values.astype("<u4" if small else "<u8").tobytes()


def unpacked(held: bytes) -> np.ndarray:
    return np.frombuffer(held, "<u4" if held[0] == 4 else "<u8", offset=1).astype(np.int64)


def aligned(docs: DataFrame, source_a: str, model_b: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs with their links, packed."""
    ranks = merge_ranks(source_a)
    shared = docs.sparkSession.sparkContext.broadcast((source_a, model_b, ranks, settled_characters(character_kinds()) if ranks else None))
    names = ["n_a", "n_b", "n_groups", "n_links"]
    part = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets, SLICE):
                got = aligner.texts(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                ends = np.cumsum(got["distinct"]).tolist()
                held = [pa.array([packed(got[c][a:b]) for a, b in zip([0, *ends], ends)], pa.binary()) for c in ("pairs", "links")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(got[c]) for c in names), pa.array(got["digest"], pa.string()), *held],
                                                 names=["id", *names, "groups_sha256", "pairs", "links"])

    kind = part.schema["id"].dataType.simpleString()
    return part.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", groups_sha256 string, pairs binary, links binary")


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """pair, n (documents that hold it) and best (whether no pair of the same A id has more)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged():
            new, place = np.unique(np.concatenate([pairs, *held]), return_inverse=True)
            count = np.bincount(place, np.concatenate([n, np.ones(size)])).astype(np.int64)
            return new, count

        for batch in batches:
            for own in batch.column(0).to_pylist():
                own = unpacked(own)
                held.append(own)
                size += len(own)
                if size > PART_PAIRS:
                    pairs, n = merged()
                    held, size = [], 0
                    if len(pairs) > PART_PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])
                        pairs, n = pairs[:0], n[:0]
        pairs, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    counts = staged(rows.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
                    .withColumn("a", F.expr(f"pair div {width}")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    out = staged(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    drop_staged(counts)
    return out


def frequent(counts: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """Pairs of at least 2 ** k documents for the smallest k with ``limit`` such pairs at most; whether these are all."""
    levels = counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("c")).orderBy(F.desc("k")).collect()  # 64 rows at most
    level, held = 64, 0
    for row in levels:
        if held + row["c"] > limit:
            break
        level, held = row["k"], held + row["c"]
    whole = held == sum(row["c"] for row in levels)
    return counts.where(F.floor(F.log2("n")) >= level), whole


def align(docs: DataFrame, source_a: str, model_b: bytes, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    spark = docs.sparkSession
    rows = staged(aligned(docs, source_a, model_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows, sentencepiece.SentencePieceProcessor(model_proto=model_b).get_piece_size())
    hot, whole = frequent(counts, hot_pairs)
    got = hot.toArrow().sort_by("pair")  # hot_pairs rows at most
    shared = spark.sparkContext.broadcast((got["pair"].to_numpy(), got["n"].to_numpy(), got["best"].to_numpy().astype(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            sums, bests, rest = [], [], []
            for own, links in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own, links = unpacked(own), unpacked(links)
                at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
                known = pair[at] == own if len(pair) else np.zeros(len(own), bool)
                at = at[known]
                sums.append(int((n[at] * links[known]).sum()))
                bests.append(int(links[known][best[at]].sum()))
                rest.append([{"pair": p, "links": k} for p, k in zip(own[~known].tolist(), links[~known].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64()), pa.array(bests, pa.int64()),
                                              pa.array(rest, pa.list_(pa.struct([("pair", pa.int64()), ("links", pa.int64())])))], names=["row", "count_sum", "n_best", "rest"])

    base = [F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links"]
    if whole:
        columns = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

        def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = next(run(iter([batch.select(["row", "pairs", "links"])])))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in columns), done.column(1), done.column(2)], names=[*columns, "count_sum", "n_best"])

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        out = rows.mapInArrow(run_whole, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", count_sum bigint, n_best bigint")
        return out.select(*base, "n_best", "count_sum", "groups_sha256")
    partial = staged(rows.select("row", "pairs", "links").mapInArrow(run, "row bigint, count_sum bigint, n_best bigint, rest array<struct<pair:bigint,links:bigint>>"), "partial")
    rare = partial.select("row", F.inline("rest")).join(counts, "pair") \
        .select("row", (F.col("n") * F.col("links")).alias("count_sum"), F.when(F.col("best"), F.col("links")).otherwise(0).alias("n_best"))
    sums = partial.select("row", "count_sum", "n_best").union(rare).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return rows.drop("pairs", "links").join(sums, "row").select(*base, "n_best", "count_sum", "groups_sha256")
