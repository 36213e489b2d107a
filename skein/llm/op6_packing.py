"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

Documents are tokenized and closed by an end id. A document gives full pieces of a sequence's size,
which are sequences by themselves, and a rest. Packing looks only at the histogram of the rests'
lengths (fewer than ``size`` entries, however large the corpus): lengths are placed longest first,
each into the packs that have the most free room; packs of the same content are one pattern with a
count. Patterns are then joined back by rank: the r-th rest of a length takes the r-th slot of it.

Ranks come from counters that each tokenizing task keeps per length, which are written with the
pieces, and from the sums of these counters over earlier tasks; so no length, however common, is
sorted or gathered in one task, and a task that is run again cannot change ranks already written.

Tokenization reads the vocabulary file compiled by module ``bpe``: a walk over all words of a batch
in lockstep gives the state after each byte, and a state knows the last token of what was read, so
tokens are found from each word's end backwards. Results equal the tokenizers library.

Null text counts as empty (its document is the end id alone). Repeated rows are packed each. Other
columns, of any name, are not read. An empty table gives no piece.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import NUMBER, OTHER, RUN, SPACE, Merger, character_kinds, read_bpe
from .common import PART_BYTES, code_points, slices, staged, text_buffers

SIZE = 2048
END_ID = 1
CONTRACTIONS = ("re", "ve", "ll", "s", "t", "m", "d")


class WordTokenizer:
    """Ids of texts by a BPE vocabulary with word ends that drops white space and folds case."""

    def __init__(self, source: str, kinds: np.ndarray):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        vocab, merges, special, spec = read_bpe(source)
        if not spec["model"].get("end_of_word_suffix"):
            raise ValueError("this tokenizer takes vocabularies with word ends")
        self.library = tokenizers.Tokenizer.from_str(source)
        self.special = [s.encode() for s in special]
        self.kinds = kinds
        self.merger = Merger(vocab, merges)
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def ids(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """uint32 ids of each text."""
        n = len(offsets) - 1
        # texts with a special string, rare, are left to the library
        whole = {}
        for s in self.special:
            text, at = raw.tobytes(), -1
            while (at := text.find(s, at + 1)) >= 0:
                whole[int(np.searchsorted(offsets, at, side="right")) - 1] = None
        raw, offsets = self.normalized(raw, offsets)
        for i in whole:
            whole[i] = i
        places, tokens = self.encode(raw, offsets)
        bounds = np.searchsorted(places, offsets)
        return [tokens[bounds[i]:bounds[i + 1]] if i not in whole else None for i in range(n)]

    def normalized(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Composed lower case. Below U+0100 that is a change of single bytes; other texts ask the library."""
        low = self.lower[raw]
        high = np.flatnonzero(raw >= 0xC4)
        second = np.flatnonzero(raw == 0xC3) + 1
        if len(second):
            up = second[(raw[second] >= 0x80) & (raw[second] <= 0x9E) & (raw[second] != 0x97)]
            low[up] += 0x20
        if not len(high):
            return low, offsets
        rows = np.unique(np.searchsorted(offsets, high, side="right") - 1)
        parts, size, done = [], np.diff(offsets).copy(), 0
        for i in rows.tolist():
            text = self.library.normalizer.normalize_str(raw[offsets[i]:offsets[i + 1]].tobytes().decode())
            new = np.frombuffer(text.encode(), np.uint8)
            parts += [low[offsets[done]:offsets[i]], new]
            size[i], done = len(new), i + 1
        parts.append(low[offsets[done]:])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(size)])

    def begins(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks of the first byte of every word, and of white space."""
        lead, cp = code_points(raw)
        kind = self.kinds[cp]
        start = np.ones(len(cp), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        at = np.searchsorted(lead, offsets[:-1])
        start[at[at < len(cp)]] = True
        end = 0
        for i in np.flatnonzero(cp == 39).tolist():
            if i < end or not (start[i] or i == end):
                continue  # inside a contraction, or within a run of signs
            follow = "".join(map(chr, cp[i + 1:i + 3].tolist()))
            for c in CONTRACTIONS:
                if follow.startswith(c) and not start[i + 2:i + 1 + len(c)].any():
                    limit = offsets[np.searchsorted(offsets, lead[i], side="right")]
                    if lead[i + len(c)] >= limit:
                        continue
                    end = i + 1 + len(c)
                    start[i] = True
                    start[i + 1:end] = False
                    if end < len(start):
                        start[end] = True
                    break
        marks, space = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        marks[lead[start]] = True
        blank = lead[kind == SPACE]
        space[blank] = True
        for k in range(1, 4):  # the further bytes of longer white space
            more = blank + k
            more = more[more < len(raw)]
            more = more[(raw[more] & 0xC0) == 0x80]
            blank = more - k
            space[more] = True
        return marks, space

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte places of the last bytes of all tokens, and their ids."""
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        marks, space = self.begins(raw, offsets)
        kept = np.flatnonzero(~space)
        if not len(kept):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        first = np.flatnonzero(marks[kept])          # in kept bytes: where each word begins
        last = np.append(first[1:], len(kept)) - 1   # and ends
        symbols = raw[kept].astype(np.int64)
        symbols[last] += 256
        cut = first[np.unique(np.searchsorted(first, np.arange(0, len(kept), RUN)).clip(max=len(first) - 1))]
        cut = np.unique(np.append(cut, 0))
        states = np.zeros(len(kept), np.int32)
        self.merger.walk(symbols, cut, np.append(cut[1:], len(kept)), states=states)
        tokens = np.full(len(kept), -1, np.int64)
        place, begin = last, first
        while len(place):
            t = self.merger.last[states[place]]
            tokens[place] = t
            place = place - self.merger.size[t]
            more = place >= begin
            place, begin = place[more], begin[more]
        have = np.flatnonzero(tokens >= 0)
        return kept[have], tokens[have].astype(np.uint32)


_TOKENIZERS: dict[int, WordTokenizer] = {}


def pieces(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
           end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, crc32 of its ids, its document's ids, and its place among
    the pieces of that length from the same task (``part``, ``local_rank``); on request the ids."""
    kinds = character_kinds()
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, kinds))
    part = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = part.schema.fields[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, local_rank bigint"
    schema += ", ids array<bigint>" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, kinds = shared.value
        key = hash(source)
        if key not in _TOKENIZERS:  # once per Python worker
            _TOKENIZERS.clear()
            _TOKENIZERS[key] = WordTokenizer(source, kinds)
        tok, task = _TOKENIZERS[key], TaskContext.get().partitionId()
        ranks = np.zeros(size + 1, np.int64)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets, PART_BYTES):
                all_ids = tok.ids(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                owner, rows, lists = [], [], []
                for k, ids in enumerate(all_ids):
                    if ids is None:
                        ids = tok.library.encode(batch.column(1)[i + k].as_py(), add_special_tokens=False).ids
                    ids = np.append(ids, end_id).astype("<u4")
                    for start in range(0, len(ids), size):
                        own = ids[start:start + size]
                        owner.append(i + k)
                        rows.append((start, len(own), zlib.crc32(own.tobytes()), len(ids), task, ranks[len(own)]))
                        ranks[len(own)] += 1
                        if keep_ids:
                            lists.append(own.astype(np.int64))
                cols = np.array(rows, np.int64).T
                arrays = [batch.column(0).take(pa.array(owner, pa.int64())), *map(pa.array, cols[:4]),
                          pa.array(cols[4].astype(np.int32)), pa.array(cols[5])]
                arrays += [pa.array(lists, pa.list_(pa.int64()))] if keep_ids else []
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "part", "local_rank",
                                                                *(["ids"] if keep_ids else [])])

    return part.mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns as (count, lengths). Lengths go longest first into the packs with the most free room."""
    rooms: dict[int, list[list]] = {}  # free room -> [count, lengths] of the patterns that have it
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(rooms, default=0)
            if room < length:
                rooms.setdefault(size - length, []).append([left, (length,)])
                left = 0
                continue
            count, lengths = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            if count > left:
                rooms.setdefault(room, []).append([count - left, lengths])
                count = left
            rooms.setdefault(room - length, []).append([count, (*lengths, length)])
            left -= count
    return [(count, lengths) for room in sorted(rooms) for count, lengths in rooms[room]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: from its first rank on, the pieces of a
    length go one by one to the sequences from the first sequence on, at the offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = taken.get(length, 0)
            rows.append((length, rank, sequence, offset))
            taken[length] = rank + count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Give every piece its sequence and offset. ``cut`` must be a written table: its ranks may not change."""
    spark = cut.sparkSession
    totals = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    base = totals.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    table = spark.sparkContext.broadcast(slots(shortest_pack_first(histogram, size)))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local_rank")).drop("part", "local_rank", "base")
    names = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset = table.value.T
        key = length << 44 | first
        for batch in batches:
            own = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            rank = np.asarray(own["rank"])
            at = np.searchsorted(key, np.asarray(own["length"]) << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(own[n] for n in names), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])],
                                             names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text",
                   size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack: one row per piece with its sequence_id and offset."""
    return pack(staged(pieces(docs, tokenizer_json, id_col, text_col, size, keep_ids=keep_ids), "pieces"), size)
