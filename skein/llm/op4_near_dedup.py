"""MinHash near-duplicates by a chosen-path set similarity join.

Documents are sets of word shingles. Those with the same set are one class first, so copies, however
many, are one vertex from then on. A class has COORDINATES minwise tokens. TREES independent trees branch
the classes: a class goes to CHILDREN children of every node that it is in, each named by freshly
drawn coordinates and the class's tokens there (the root's children by two tokens, deeper ones by
one). The draw depends on the tree and on the path so far, so no two nodes decide alike.

* A node of at most SMALL classes is compared exhaustively.
* A larger node of which all but SMALL / 2 classes are in one component already needs only these few
  compared with all of it: they go along with every part of the rest.
* Any other node is branched on, until its children are small. On the way its classes are dealt into
  parts by chance, which are compared too: this links most of a large group of near copies early,
  so that its nodes become one component and are done.
* What is still large and mixed after DEPTH levels (large families just below the threshold, which no
  branching takes apart) is compared exhaustively, part by part.

The first tree goes before the others, which then meet only nodes that it has left in several components.

Comparing is done in two steps. First the 2-bit sketches of the minwise tokens: pairs of different
components whose sketches agree well enough (ALIKE) make groups of classes within the node; the same group
in several nodes counts once. Then the full sets of a group's classes, fetched once per class, come
together, and all its pairs are confirmed exactly at once, by one product of the sets' incidence
matrix; what leaves a group is a forest of its links. So no pair is ever a row, and every pair that shares a small
node is confirmed, in one component already, or has sketches that differ too much.

Two sets at the threshold share a child of a tree's root or its descendants with a chance of 0.84 or
more at any depth, hence a small node of some tree but for 0.16 ** 8 = 4e-7; their sketches
fail the test with a chance of about 1e-5. Shingles are compared by 40 bits of their hashes.

Null, empty and word-less texts have no shingles and are linked with nothing. Rows without an id are
linked with nothing either: their component is null and they are kept. Rows of the same id are the
same document: texts that are linked with either are linked. Other columns, of any name, are not
read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART_BYTES, bit_table, drop_staged, fresh, map_texts, slices, split_by_table, staged, text_buffers
from .components import connected_components
from .words import mixed, non_blank, shingles, word_hashes

WORDS = 5
PERCENT = 80
COORDINATES = 128
TREES = 8
CHILDREN = 2
SMALL = 1024
DEPTH = 6
COLUMNS = 4096     # of an incidence matrix at once
ALIKE = 89         # agreeing 2-bit sketches of 128: of sets at the threshold fewer agree with a chance of about 1e-5
_WORD = non_blank()
_RNG = np.random.default_rng(4)
_A = _RNG.integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_ODD = np.uint64(0x5555555555555555)


def each_set(raw: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    for i, j in slices(offsets, PART_BYTES):
        h, bounds, _, _ = word_hashes(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], _WORD)
        s, ends = shingles(h, bounds, words)
        for k in range(j - i):
            yield np.unique(s[ends[k]:ends[k + 1]])


def fixed(values: np.ndarray) -> pa.Array:
    """Rows of a contiguous matrix as binary values."""
    values = np.ascontiguousarray(values)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(values.shape[1] * values.itemsize), len(values), [None, pa.py_buffer(values)]).cast(pa.binary())


def matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, two fingerprints of the set, its minwise tokens (32 bits each) and 2 more bits of each."""
    def fn(raw, offsets):
        n = len(offsets) - 1
        size, fp = np.zeros(n, np.int64), np.zeros((2, n), np.uint64)
        low = np.zeros((n, COORDINATES), np.uint64)
        with np.errstate(over="ignore"):
            for i, s in enumerate(each_set(raw, offsets, words)):
                size[i] = len(s)
                if len(s):
                    m = mixed(s)
                    fp[0, i], fp[1, i] = m.sum(), mixed(m ^ _B[0]).sum()
                    best = None
                    for at in range(0, len(s), 2048):
                        part = (s[at:at + 2048, None] * _A + _B).min(axis=0)
                        best = part if best is None else np.minimum(best, part)
                    low[i] = best
        low = mixed(low)
        bits = np.stack([low & np.uint64(1), low >> np.uint64(1) & np.uint64(1)], axis=2).reshape(n, -1).astype(np.uint8)
        return {"n_shingles": size, "fp1": fp[0].view(np.int64), "fp2": fp[1].view(np.int64),
                "low": fixed((low >> np.uint64(32)).astype("<u4")), "sketch": fixed(np.packbits(bits, axis=1, bitorder="little"))}

    return map_texts(docs.select(F.col(id_col).alias("id"), text_col), text_col, "n_shingles bigint, fp1 bigint, fp2 bigint, low binary, sketch binary", fn, ["id"])


def children(rows: DataFrame, trees: range | None = None, keep: DataFrame | None = None) -> DataFrame:
    """node, rep and sketch of all children; ``rows`` has rep, sketch, low and the parent ``node``, or the
    roots of ``trees`` are branched.

    ``keep`` (node): only children that may be among these, by a table of bits of fixed size.
    """
    shared = None if keep is None else rows.sparkSession.sparkContext.broadcast(np.packbits(bit_table(keep, "node")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if shared is None else np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            low, every = matrix(batch.column(2), "<u4", COORDINATES), np.arange(n)
            parent = np.zeros(n, np.uint64) if trees is not None else np.asarray(batch.column(3)).view(np.uint64)
            with np.errstate(over="ignore"):
                for tree in trees if trees is not None else (0,):
                    for child in range(CHILDREN):
                        node = mixed(parent + np.uint64(tree * CHILDREN + child + 1) * _A[0])
                        for _ in range(2 if trees is not None else 1):
                            drawn = (node >> np.uint64(40)) % np.uint64(COORDINATES)
                            node = mixed(node * _A[1] + low[every, drawn.astype(np.int64)])
                        at = every if table is None else np.flatnonzero(table[(node >> np.uint64(40)).astype(np.int64)])
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)[at]), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))],
                                                             names=["node", "rep", "sketch"])

    return rows.select("rep", "sketch", "low", *(["node"] if trees is None else [])).mapInArrow(run, "node bigint, rep bigint, sketch binary")


def meeting(rows: DataFrame, trees: range | None = None) -> DataFrame:
    """node, rep, sketch of the children of ``rows`` that at least two classes share, written to the shared folder."""
    shared = staged(children(rows, trees).groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "shared-nodes")
    out = staged(children(rows, trees, shared).join(shared, "node", "left_semi"), "nodes")
    drop_staged(shared)
    return out


class Forest:
    """Sets of numbers that links join."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, v: int) -> int:
        while self.up.get(v, v) != v:
            self.up[v] = self.up.get(self.up[v], self.up[v])
            v = self.up[v]
        return v

    def join(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` were apart."""
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def alike_groups(members: DataFrame) -> DataFrame:
    """g and reps: within each row of ``members`` (rep, label, sketch, role) the groups of classes that pairs
    of alike sketches and different components join.

    Role 0 meets all; roles 1 and 2 meet only each other and role 0; role 3 meets role 0 only.
    """
    def alike_pairs(size, label, role, sketch):
        """Row and both places of the pairs that count, rows of equal size at once."""
        start, out = np.cumsum(size) - size, []
        for n in np.unique(size).tolist():
            i, j = np.triu_indices(n, 1)
            same = np.flatnonzero(size == n)
            step = max(1, (1 << 18) // max(len(i), 1))
            for at in range(0, len(same), step):
                row = same[at:at + step]
                x, y = (start[row][:, None] + i).ravel(), (start[row][:, None] + j).ravel()
                p, q = role[x], role[y]
                ok = np.flatnonzero((label[x] != label[y]) & ((p == 0) | (q == 0) | (p + q == 3) & (p != q) & (p != 3) & (q != 3)))
                for part in np.array_split(ok, max(1, len(ok) >> 18)):
                    differ = sketch[x[part]] ^ sketch[y[part]]
                    k = COORDINATES - np.bitwise_count((differ | differ >> np.uint64(1)) & _ODD).sum(axis=1, dtype=np.int64)
                    near = part[k >= ALIKE]
                    out.append((np.repeat(row, len(i))[near], x[near], y[near]))
        return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(0).flatten()
            rep = np.asarray(flat.field("rep"))
            _, x, y = alike_pairs(np.asarray(batch.column(0).value_lengths()), np.asarray(flat.field("label")), np.asarray(flat.field("role")),
                                  matrix(flat.field("sketch"), "<u8", COORDINATES // 32))
            forest, found = Forest(), {}
            for p, q in zip(x.tolist(), y.tolist()):
                forest.join(p, q)
            for p in np.unique(np.concatenate([x, y])).tolist():
                found.setdefault(forest.root(p), []).append(p)
            groups = [np.unique(rep[own]) for own in found.values()]
            with np.errstate(over="ignore"):
                g = [int(mixed(mixed(own.view(np.uint64)).sum(keepdims=True) + np.uint64(len(own)))[0].view(np.int64)) for own in groups]
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(groups, pa.list_(pa.int64()))], names=["g", "reps"])

    return members.select("members").mapInArrow(run, "g bigint, reps array<bigint>")


def fetched(reps: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """rep and set (40 bits of each shingle's hash, sorted) of ``reps``; documents are picked while they
    are read, by a table of bits of fixed size, and the join drops what it lets through by chance."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bit_table(reps, "h")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            h = np.asarray(batch.column(2)).view(np.uint64)
            batch = batch.take(pa.array(np.flatnonzero(table[(h >> np.uint64(40)).astype(np.int64)])))
            raw, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets):
                own = []
                for s in each_set(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], words):
                    s = s >> np.uint64(24)
                    own.append((s >> np.uint64(32)).astype(np.uint8).tobytes() + s.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(own, pa.binary())], names=["rep", "set"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("rep"), F.col(f"`{text_col}`").cast("string").alias("t")) \
        .where(F.col("rep").isNotNull()).withColumn("h", F.xxhash64("rep"))
    return staged(rows.mapInArrow(sets, "rep bigint, set binary").join(reps.select("rep"), "rep", "left_semi"), "sets")


def picked(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``held`` whose rep may be among ``wanted`` (rep), so that a join with few reps doesn't shuffle all."""
    return split_by_table(held, F.xxhash64("rep"), wanted.select(F.xxhash64("rep").alias("h")), "h")[0]


def confirmed(groups: DataFrame, percent: int) -> DataFrame:
    """a, b: a forest of the links of each row of ``groups`` (members: rep, label, set), which joins what all
    its links join."""
    def shingles_of(held: bytes) -> np.ndarray:
        n = len(held) // 5
        return np.frombuffer(held, np.uint8, n).astype(np.uint64) << np.uint64(32) | np.frombuffer(held, "<u4", n, n)

    def links(label: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in sets])
        _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1  # shingles of one set alone are in no intersection
        shared, owner = times[place] > 1, np.repeat(np.arange(len(sets)), size)
        row, column = owner[shared], column[place[shared]]
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
            m = np.zeros((len(sets), COLUMNS), np.float32)
            m[row[part], column[part] - low] = 1
            both += m @ m.T
        both = both.astype(np.int64)
        return np.nonzero(np.triu((label[:, None] != label[None, :]) & (100 * both >= percent * (size[:, None] + size[None, :] - both)), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for members in batch.column(0):
                members = members.values
                rep, label = np.asarray(members.field("rep")), np.asarray(members.field("label"))
                forest = Forest()
                for i, j in zip(*(x.tolist() for x in links(label, [shingles_of(x) for x in members.field("set").to_pylist()]))):
                    if forest.join(int(label[i]), int(label[j])):
                        out_a.append(min(rep[i], rep[j]))
                        out_b.append(max(rep[i], rep[j]))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return staged(groups.select("members").mapInArrow(run, "a bigint, b bigint").distinct(), "links")


def large(nodes: DataFrame) -> DataFrame:
    """rep of the classes in nodes of more than SMALL, which alone may have to be branched on."""
    wide = nodes.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("node")
    return nodes.join(wide, "node", "left_semi").select("rep")


class Turns:
    """The state between turns: components so far, sets that were fetched."""

    def __init__(self, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, labels: DataFrame | None):
        self.docs, self.words, self.percent, self.id_col, self.text_col = docs, words, percent, id_col, text_col
        self.labels, self.sets = labels, None

    def labelled(self, rows: DataFrame) -> DataFrame:
        if self.labels is None:
            return rows.withColumn("label", F.col("rep"))
        return rows.join(self.labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))

    def confirm(self, groups: DataFrame) -> None:
        """Confirms all pairs of the groups (g, reps) on full sets and merges components."""
        if not groups.limit(1).count():
            return
        rows = groups.select("g", F.explode("reps").alias("rep"))
        reps = staged(rows.select("rep").distinct().withColumn("h", F.xxhash64("rep")), "reps")
        new = reps if self.sets is None else staged(reps.join(self.sets.select("rep"), "rep", "left_anti"), "new-reps")
        got = fetched(new, self.docs, self.words, self.id_col, self.text_col)
        sets = got if self.sets is None else got.unionByName(picked(self.sets, reps))
        self.sets = got if self.sets is None else self.sets.unionByName(got)
        whole = self.labelled(rows).join(sets, "rep").groupBy("g").agg(F.collect_list(F.struct("rep", "label", "set")).alias("members"))
        links = confirmed(whole, self.percent)
        if links.limit(1).count():
            self.labels = connected_components(links, self.labels)
        drop_staged(reps, new, links)


def linked_components(docs: DataFrame, classes: DataFrame, words: int, percent: int, id_col: str, text_col: str,
                      extra: DataFrame) -> DataFrame | None:
    """v and label of all classes that are linked with another; ``extra``: links known from the start."""
    state = Turns(docs, words, percent, id_col, text_col, connected_components(extra) if extra.limit(1).count() else None)
    nodes, tokens, turn = meeting(classes, range(1)), None, 0
    while True:
        parts = state.labelled(nodes).groupBy("node", "label").agg(F.count("*").alias("n"))
        sized = parts.groupBy("node").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels"))
        small, light = F.col("n") <= SMALL, F.col("n") - F.col("most.n") <= SMALL // 2
        kind = F.when(small, "small").when(light, "light").when(F.lit(turn >= DEPTH), "whole").otherwise("heavy")
        open_nodes = staged(sized.where("labels > 1").select("node", kind.alias("kind"), F.col("most.label").alias("major"),
                                                             F.ceil(F.col("n") / F.lit(SMALL // 2)).cast("int").alias("parts")), "open-nodes")
        kinds = {r["kind"] for r in open_nodes.select("kind").distinct().collect()}  # four at most
        mixed_rows = staged(state.labelled(nodes.join(open_nodes, "node")), "open-rows") if kinds else None
        drop_staged(open_nodes, nodes)
        if kinds:
            # what meets: parts of a node; the few outside of its largest component go along with every part
            part = F.pmod(F.xxhash64("rep", "node"), F.col("parts")).cast("int")
            every = F.sequence(F.lit(0), F.col("parts") - 1)
            outside = (F.col("kind") == "light") & (F.col("label") != F.col("major"))
            places = F.when(outside, F.transform(every, lambda p: F.struct(p.alias("x"), F.lit(-1).alias("y"), F.lit(0).alias("role")))) \
                .when(F.col("kind") == "whole", F.transform(every, lambda p: F.struct(F.least(p, part).alias("x"), F.greatest(p, part).alias("y"),
                                                                                      F.when(p == part, 0).when(part < p, 1).otherwise(2).alias("role")))) \
                .otherwise(F.array(F.struct(F.when(F.col("kind") == "small", 0).otherwise(part).alias("x"), F.lit(-1).alias("y"),
                                            F.when(F.col("kind") == "light", 3).otherwise(0).alias("role")))).cast("array<struct<x:int,y:int,role:int>>")
            members = mixed_rows.withColumn("place", F.explode(places)).groupBy("node", "place.x", "place.y") \
                .agg(F.collect_list(F.struct("rep", "label", "sketch", F.col("place.role").alias("role"))).alias("members")).where(F.size("members") > 1)
            groups = staged(alike_groups(members).dropDuplicates(["g"]), "groups")
            state.confirm(groups)
            drop_staged(groups)
        heavy = mixed_rows.where("kind = 'heavy'").select("node", "rep") if "heavy" in kinds else None
        after = None
        if turn == 0:  # the other trees, whose nodes are mostly of one component by now
            after = meeting(classes, range(1, TREES))
            # tokens of all that any turn may branch on: a later node's classes are in a large one of these, so all classes are read once
            wanted = large(after) if heavy is None else large(after).union(heavy.select("rep"))
            wanted = staged(wanted.distinct(), "large")
            if wanted.limit(1).count():
                tokens = staged(picked(classes.select("rep", "sketch", "low"), wanted), "tokens")
            drop_staged(wanted)
        if heavy is not None:
            heavy = staged(heavy.join(picked(tokens, heavy), "rep"), "heavy")
            deeper = meeting(heavy)
            after = deeper if after is None else after.unionByName(deeper)
            drop_staged(heavy)
        if kinds:
            drop_staged(mixed_rows)
        if after is None:
            drop_staged(*(x for x in (state.sets, tokens) if x is not None))
            return state.labels
        nodes, turn = after, turn + 1


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links lead to) and kept."""
    signed = staged(signatures(docs, words, id_col, text_col), "signatures")
    linkable = signed.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    by_set = ["n_shingles", "fp1", "fp2"]
    classes = staged(linkable.groupBy(*by_set).agg(F.min("id").cast("bigint").alias("rep"), F.first("low").alias("low"), F.first("sketch").alias("sketch")), "classes")
    placed = linkable.select("id", *by_set).join(classes.select("rep", *by_set), by_set).select(F.col("id").cast("bigint").alias("id"), "rep")
    members = staged(placed.distinct(), "members")
    # an id with several texts links their classes
    extra = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b").distinct()
    labels = linked_components(docs, classes, words, percent, id_col, text_col, extra)
    drop_staged(classes)
    if labels is not None:
        members = members.join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("id", F.coalesce("label", "rep").alias("component_id"))
    else:
        members = members.select("id", F.col("rep").alias("component_id"))
    members = members.groupBy(F.col("id").alias("mid")).agg(F.min("component_id").alias("component_id"))
    out = signed.select("id", "n_shingles").join(members, F.col("id") == F.col("mid"), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one whose id names the component. Of rows that
    repeat an id the smallest stays. Rows without an id stay."""
    found = near_duplicates(docs, words, percent, id_col, text_col).where(F.col(id_col).isNotNull())
    own, stays = fresh("touched_id", docs), fresh("touched_kept", docs)
    touched = found.groupBy(F.col(id_col).alias(own)).agg(F.bool_and("kept").alias(stays), F.count("*").alias("n")) \
        .where(~F.col(stays) | (F.col("n") > 1)).select(own, stays, F.xxhash64(own).alias("h"))
    touched = staged(touched, "touched")
    hit, clear = split_by_table(docs, F.xxhash64(F.col(f"`{id_col}`")), touched, "h")
    joined = hit.join(touched.drop("h"), F.col(id_col) == F.col(own), "left")
    names = [F.col(f"`{c}`") for c in docs.columns]
    alone = joined.where(F.col(own).isNull()).select(*names)
    repeated = joined.where(F.col(stays)).groupBy(own).agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    return clear.unionByName(alone).unionByName(repeated)
