"""Hard negatives, source mixing and tokenizer alignment, each against a plain version."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from skein.llm import op11_hard_negatives as mining
from skein.llm import op12_mixing as mixing
from skein.llm import op13_alignment as alignment
from skein.llm.queries import tokenizer_path

# --- hard negatives ---


def brute_negatives(rows, is_anchor, k=5, low=80):
    part = [(i, lab, v) for i, lab, v in rows if i is not None and lab is not None and v is not None and None not in v]
    anchors = {}
    for i, lab, v in part:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (v, lab)), (v, lab))
    out = []
    for a, (q, lab) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, l) for i, l, v in part if i != a)
        positives = [(i, -s) for s, i, l in scored if l == lab][:k]
        for p, ps in positives:
            fits = [(i, -s) for s, i, l in scored if l != lab and low * ps <= 100 * -s <= 100 * ps][:k]
            out += [(a, p, r + 1, i, ps, s) for r, (i, s) in enumerate(fits)]
    return sorted(out)


def vectors(seed, n, d, labels=3):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((6, d)) * 30
    return [(i, int(rng.integers(labels)), [int(x) for x in centre[rng.integers(6)] + rng.standard_normal(d) * 25]) for i in range(n)]


@pytest.mark.parametrize("d", [1, 5, 24])
def test_hard_negatives_equal_brute_force(spark, d):
    rows = vectors(d, 400, d)
    rows += [(500, 1, None), (501, None, rows[0][2]), (None, 1, rows[1][2]), (502, 1, [None] * d), (503, 1, [0] * d), (504, 2, [0] * d)]
    rows += [(20, rows[20][1], rows[20][2]), (33, rows[33][1], rows[33][2]), (40, 2, [x + 1 for x in rows[40][2]])]  # ids that repeat
    rows += [(600 + j, j % 3, rows[0][2]) for j in range(60)]  # a group of equal vectors: ties
    rows += [(700, 1, rows[0][2] + [1])]  # another length than most
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id bigint, label int, vector array<bigint>, score int, id string").repartition(3)
    got = mining.hard_negatives(df, lambda i: i % 20 == 0)
    want = brute_negatives([r for r in rows if r[2] is None or len(r[2]) == d], lambda i: i % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert mining.hard_negatives(df.limit(0), lambda i: i % 20 == 0).collect() == []
    assert mining.hard_negatives(df.where("label = 1"), lambda i: i % 20 == 0).collect() == []


def test_thresholds_are_lowered_in_turns(spark, monkeypatch):
    """Thresholds that begin far too high, and several blocks of rows and anchors, give the same rows."""
    rows = vectors(9, 300, 12, labels=2)
    df = spark.createDataFrame(rows, "vec_id bigint, label int, vector array<bigint>")
    for name, value in (("FIRST", 1e-3), ("BLOCK", 64), ("TILE", 7), ("ANCHORS", 16), ("SAMPLE", 20)):
        monkeypatch.setattr(mining, name, value)
    got = mining.hard_negatives(df, lambda i: i % 6 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda i: i % 6 == 0)


def test_index_finds_all_pairs_above_a_threshold():
    rng = np.random.default_rng(2)
    v = rng.integers(-40, 41, (300, 21))
    v[::7, 8:] = 0
    block = mining.Index(np.arange(300, dtype="<i8").tobytes(), np.zeros(300, "<i8").tobytes(), v.astype("<i8").tobytes())
    anchors = v[:25]
    scores = anchors @ v.T
    for quantile in (0.5, 0.9, 0.999):
        low = np.quantile(scores, quantile, axis=1).astype(np.int64)
        a, r, s = block.above(anchors, mining.tail_norms(anchors), low)
        want = {(i, j, int(scores[i, j])) for i, j in zip(*np.nonzero(scores >= low[:, None]))}
        assert set(zip(a.tolist(), r.tolist(), s.tolist())) == want and len(a) == len(want)


# --- mixing ---


def level_targets(sizes, weights, repeats=3):
    """Shares by weight, stopped at the cap, the excess shared anew."""
    out, left, free = {}, float(sum(sizes.values())), set(sizes)
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total >= repeats * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / total for s in free}
        for s in over:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100}, {"a": 1, "b": 2, "c": 1000, "d": 50}, {"a": 0, "b": 7}, {None: 5, "z": 1, "é": 90}, {"a": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    ranked = mixing.ranked_sources(df)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    assert {r.source: r["rank"] for r in ranked.collect()} == {s: i for i, s in enumerate(order)}
    got = mixing.weighted_targets(ranked.withColumn("weight", F.col("rank") % 3 + 1))
    want = level_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    assert {r.source: pytest.approx(r.target) for r in got.collect()} == want


def cheapest(supply, quota, arcs, repeats):
    """(words, cost) of the best flow, word by word along cheapest paths (Bellman-Ford)."""
    names = ["S", *[("p", p) for p in supply], *[("s", s) for s in quota], "T"]
    edges = []
    for p, n in supply.items():
        edges += [["S", ("p", p), n, r] for r in range(repeats)]
    edges += [[("p", p), ("s", s), 10**9, 0] for p, s in arcs] + [[("s", s), "T", q, 0] for s, q in quota.items()]
    flow, words, cost = [0] * len(edges), 0, 0
    while True:
        dist = {n: float("inf") for n in names} | {"S": 0}
        way = {}
        for _ in names:
            for i, (a, b, cap, c) in enumerate(edges):
                if flow[i] < cap and dist[a] + c < dist[b]:
                    dist[b], way[b] = dist[a] + c, (i, 1, a)
                if flow[i] > 0 and dist[b] - c < dist[a]:
                    dist[a], way[a] = dist[b] - c, (i, -1, b)
        if dist["T"] == float("inf"):
            return words, cost
        v = "T"
        while v != "S":
            i, sign, v = way[v]
            flow[i] += sign
        words, cost = words + 1, cost + dist["T"]


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_the_cheapest(seed):
    rng = random.Random(seed)
    sources = "abcd"[:rng.randint(2, 4)]
    members = [c for n in range(1, len(sources) + 1) for c in itertools.combinations(sources, n)]
    patterns = rng.sample(members, min(len(members), rng.randint(2, 5)))
    supply = {"".join(p): rng.randint(0, 7) for p in patterns}
    quota = {s: rng.randint(0, 15) for s in sources}
    arcs = [(p, s) for p in supply for s in p]
    frame = pd.DataFrame([(p, s, supply[p], quota[s]) for p, s in arcs], columns=["pattern", "source", "size", "quota"])
    got = mixing.routed(frame, 3)
    used = got.groupby("pattern")["words"].sum()
    cost = 0
    for p, n in used.items():
        assert n <= 3 * supply[p]
        cost += sum(r * max(0, min(n - r * supply[p], supply[p])) for r in range(3))
    for s, n in got.groupby("source")["words"].sum().items():
        assert n <= quota[s]
    assert (used.sum(), cost) == cheapest(supply, {s: q for s, q in quota.items() if any(s == t for _, t in arcs)}, arcs, 3)


def test_spread_comes_near():
    rng = random.Random(1)
    for _ in range(200):
        sizes = np.array(sorted({rng.randint(0, 60) for _ in range(rng.randint(1, 20))}, reverse=True))
        counts = np.array([rng.randint(1, 9) for _ in sizes])
        total = int((sizes * counts).sum())
        rest = rng.randint(0, total)
        take = mixing.spread(sizes, counts, rest)
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(int((sizes * take).sum()) - rest) <= sizes.max()


def mixed_docs(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 1, 3, 3, 3, 40, 200]), rng.choice([["a"], ["a"], ["a"], ["b"], ["a", "b"], ["c", None], ["c"], [None], ["b", "b"]])) for i in range(3000)]
    rows += [(None, 3, ["a"])] * 40 + [(7, 3, ["b"])] * 5 + [(9001, None, ["a"]), (9002, 5, None), (9003, 5, []), (9004, 5, ["unknown"]), (9005, 50_000, ["c"])]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, size int, sources array<string>, pattern string, row int")


def test_mix_follows_its_routes(spark):
    rows, docs = mixed_docs(spark)
    targets = spark.createDataFrame([("a", 9000.0), ("b", 60000.4), ("c", 30000.0), (None, 500.0), ("none has it", 10.0)], "source string, target double")
    out, routes = mixing.mix(docs.repartition(5), targets)
    got = out.collect()
    assert len(got) == len(rows)
    words = Counter()
    for r in routes.collect():
        words[r.pattern] += r.words
    taken, size, most = Counter(), Counter(), defaultdict(int)
    for r in got:
        key = tuple(sorted("=" + s if s is not None else "" for s in set(r.sources)))
        taken[key] += r.size * r.times
        size[key] += r.size
        most[key] = max(most[key], r.size)
        assert 0 <= r.times <= 3 and (r.sources or r.times == 0)
    by_key = {tuple(__import__("json").loads(p)): n for p, n in words.items()}
    for key in size:
        assert abs(taken[key] - by_key.get(key, 0)) <= (most[key] if key == ("=c",) else 200)  # a huge document can't be cut
    assert {r.doc_id: r.times for r in got}[9004] == 0
    # what is taken of a size are the smallest hashes
    again, _ = mixing.mix(docs.repartition(2), targets)
    own = lambda frame: Counter((r.doc_id, r.size, tuple(r.sources), r.times) for r in frame if r.doc_id is not None)
    assert own(again.collect()) == own(got)
    other, _ = mixing.mix(docs, targets, seed=99)
    assert own(other.collect()) != own(got)
    assert mixing.mix(docs.limit(0), targets)[0].collect() == []


def test_chosen_are_the_smallest_hashes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 16)
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit(4).alias("size"), F.array(F.lit("a")).alias("sources"))
    out, _ = mixing.mix(docs, spark.createDataFrame([("a", 4 * 2100.0)], "source string, target double"))
    got = {r.doc_id: r.times for r in out.collect()}
    hashes = {r.doc_id: r.h & (1 << 64) - 1 for r in docs.select("doc_id", F.xxhash64(F.lit(mixing.SEED), F.col("doc_id").cast("string")).alias("h")).collect()}
    # by the upper bits of the hash, unsigned, then by the signed hash within a range
    chosen = {i for i, n in got.items() if n == 2}
    assert set(got.values()) == {1, 2} and len(chosen) == 600
    span = -(-1500 // 16)
    ranges = {i: (h >> 33) * span >> 31 for i, h in hashes.items()}
    order = sorted(hashes, key=lambda i: (ranges[i], hashes[i] - (1 << 64) if hashes[i] >> 63 else hashes[i]))
    assert chosen == set(order[:600])


# --- alignment ---


def brute_alignment(texts):
    """Of each text: tokens, groups, links; by comparing byte ranges token by token."""
    a = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    byte = alignment.byte_alphabet()
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spans, whole = [], []
        for of in ([bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]):
            at, spans_of = 0, []
            for t in of:
                spans_of.append((at, at + len(t)))
                at += len(t)
            spans.append(spans_of)
            whole.append(b"".join(of))
        if not whole[0] == whole[1] == (" " + text).encode():
            out.append(None)
            continue
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [",".join(str(i) for i, (s, e) in zip(ids_a, spans[0]) if lo < e <= hi) + "|" + ",".join(str(i) for i, (s, e) in zip(ids_b, spans[1]) if lo < e <= hi)
                  for lo, hi in zip([0, *ends], ends)]
        links = [(x, y) for x, (s, e) in zip(ids_a, spans[0]) for y, (t, f) in zip(ids_b, spans[1]) if s < f and t < e]
        out.append((len(ids_a), len(ids_b), groups, links))
    counts = Counter(p for o in out if o for p in set(o[3]))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [(o[0], o[1], len(o[2]), len(o[3]), sum(counts[p] == most[p[0]] for p in o[3]), sum(counts[p] for p in o[3]), hashlib.sha256(";".join(o[2]).encode()).hexdigest())
            if o else (0, 0, 0, 0, 0, 0, "") for o in out]


@pytest.mark.parametrize("hot_pairs", [2_000_000, 30, 0])
def test_alignment_equals_brute_force(spark, docs, none, rows, hot_pairs, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_TOKENS", 500)
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f, open(tokenizer_path("piece_bpe_32k.model"), "rb") as g:
        source, model = f.read(), g.read()
    texts = {i: t for i, t, _ in rows if i not in (230, 231, 7, None)}
    texts |= {900: "a▁b", 901: "<s> </s> <unk> <0x41> <|endoftext|>", 902: "\x00 tab\t\r\n  two  blanks ", 903: " lead", 904: "中文字 😀👍🏽 ﬁ é é", 905: " ", 906: "x" * 3000, 907: "don't can't   \n\n\n end"}
    data = [(i, t, "x", 5, 6) for i, t in texts.items()]
    df = spark.createDataFrame(data, "doc_id bigint, text string, pairs string, n int, row int").repartition(3)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.align(df, source, model, hot_pairs=hot_pairs).collect()}
    want = dict(zip(texts, brute_alignment(list(texts.values()))))
    assert got == want
    assert got[900] == got[221] == got[220] == (0, 0, 0, 0, 0, 0, "") and got[901][0] > 0
    if hot_pairs:
        assert alignment.align(none, source, model, hot_pairs=hot_pairs).collect() == []
        repeated = alignment.align(docs.where("doc_id is null or doc_id = 7 or doc_id = 230"), source, model, hot_pairs=hot_pairs).collect()
        assert len(repeated) == 4 and all(r.n_links >= r.n_groups > 0 for r in repeated)


def test_alignment_of_blanks_at_the_ends(spark):
    """Last blanks have tokens, and those of one text don't run into the first blanks of the next."""
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f, open(tokenizer_path("piece_bpe_32k.model"), "rb") as g:
        source, model = f.read(), g.read()
    texts = ["a ", " b", "word \n", "  two", "x\n\n", "   y", "end  ", " ", "the last\t", " the  ", "a b ", "\u4e2d\u6587 ", "  the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.align(df, source, model).collect()}
    assert got == dict(enumerate(brute_alignment(texts)))
    assert all(n[0] > 0 for n in got.values())
