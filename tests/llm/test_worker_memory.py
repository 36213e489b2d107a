"""What Python workers of the pipeline's stages hold at once; results don't depend on how much of a text is worked on at a time."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import tokenizers

from skein.llm import bpe, common, op2_toxicity, op4_near_dedup, op6_packing, op7_decontamination
from skein.llm.bpe import character_kinds
from skein.llm.common import ship_package, text_buffers
from skein.llm.queries import tokenizer_path
from skein.llm.words import word_hashes


def texts_of(size, seed=1):
    """Texts of 500 words, some null, empty or blank."""
    rng = random.Random(seed)
    parts = ["the", "of", "ing", "tion", "é", "Sch", "x1", "ver", "中", "ly"]
    out = [None, "", " \n "]
    while sum(len(t or "") for t in out) < size:
        out += [" ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(500)), ""]
    return text_buffers(pa.array(out, pa.string()))


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def one_pass(lists, y, scale, rounds):
    """The regression on all entries at once."""
    size = np.array([len(v) for v in lists])
    col = np.concatenate([*lists, np.zeros(0)]).astype(np.int64)
    row, value = np.repeat(np.arange(len(lists)), size), scale[col]
    beta, bias = np.zeros(len(scale)), 0.0
    step = 1.0 / max(1e-9, 0.25 * np.bincount(row, weights=value ** 2, minlength=len(y)).max() + 0.25)
    v_beta, v_bias = np.zeros_like(beta), 0.0
    for _ in range(rounds):
        look, look_bias = beta + 0.9 * v_beta, bias + 0.9 * v_bias
        margin = look_bias + np.bincount(row, weights=value * look[col], minlength=len(y))
        err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)
        grad = np.bincount(col, weights=value * err[row], minlength=len(scale)) + 1e-4 * look
        v_beta = 0.9 * v_beta - 10 * step * grad
        v_bias = 0.9 * v_bias - 10 * step * err.sum()
        beta, bias = beta + v_beta, bias + v_bias
    return beta, bias


@pytest.mark.parametrize("block", [1, 1000, 1 << 17])
def test_regression_in_blocks_equals_one_pass(monkeypatch, block):
    monkeypatch.setattr(op2_toxicity, "BLOCK", block)
    rng = np.random.default_rng(3)
    lists = [rng.choice(400, int(rng.integers(0, 90)), replace=False) for _ in range(300)]
    lists[0] = lists[-1] = lists[7] = np.zeros(0, np.int64)
    y, scale = (rng.random(300) < 0.2).astype(float), rng.normal(size=400)
    rows = pa.array(lists, pa.list_(pa.int32()))
    blocks = [*op2_toxicity.blocks_of(rows.slice(0, 100), np.uint16), *op2_toxicity.blocks_of(rows.slice(100), np.uint16)]
    got, want = op2_toxicity.regression(blocks, y, scale, 40), one_pass(lists, y, scale, 40)
    assert got[0].tolist() == want[0].tolist() and got[1] == want[1]
    none = op2_toxicity.regression([*op2_toxicity.blocks_of(pa.array([[], []], pa.list_(pa.int32())), np.uint8)], np.array([0.0, 1.0]), np.zeros(0), 3)
    assert len(none[0]) == 0 and none[1] == one_pass([[], []], np.array([0.0, 1.0]), np.zeros(0), 3)[1]


def test_regression_holds_two_bytes_an_entry():
    rng = np.random.default_rng(4)
    rows = pa.array([rng.integers(0, 8000, 500, dtype=np.int32) for _ in range(4000)], pa.list_(pa.int32()))  # 2,000,000 entries
    y = (rng.random(4000) < 0.2).astype(float)
    assert peak_mb(lambda: op2_toxicity.regression([*op2_toxicity.blocks_of(rows, np.uint16)], y, np.ones(8000), 2)) < 16  # 96 on all at once


@pytest.mark.parametrize("each, limit", [(lambda *a: op2_toxicity.each_text(*a), 24), (lambda *a: op4_near_dedup.each_set(*a, 5), 24)])
def test_texts_are_worked_on_in_parts(monkeypatch, each, limit):
    raw, offsets = texts_of(2_000_000)
    assert peak_mb(lambda: [x.sum() for x in each(raw, offsets)]) < limit
    raw, offsets = texts_of(100_000)
    want = [x.tolist() for x in each(raw, offsets)]
    assert len(want) == len(offsets) - 1
    for part in (1, 5000):
        for module in (op2_toxicity, op4_near_dedup):
            monkeypatch.setattr(module, "PART_BYTES", part)
        assert [x.tolist() for x in each(raw, offsets)] == want


def test_corpus_counts_and_postings_by_parts(spark):
    rng = random.Random(6)
    texts = [None, "", *(" ".join(rng.choices(["a", "B", "cc", "dé", "e1"], k=rng.randint(1, 60_000))) for _ in range(20))]  # parts end within the slices
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    ship_package(spark)
    raw, offsets = text_buffers(pa.array(texts, pa.string()))
    h, bounds, _, _ = word_hashes(raw, offsets, op7_decontamination._WORD)
    words, times = np.unique(h.view(np.int64), return_counts=True)
    assert len(words) == 5 and offsets[-1] > 3 * common.PART_BYTES
    wanted = spark.createDataFrame([(w,) for w in words[:3].tolist()], "word bigint")
    got = op7_decontamination.corpus_counts(docs, "text", wanted).collect()
    assert {r.word: r.n for r in got} == dict(zip(words[:3].tolist(), times[:3].tolist()))
    indexed = {r.id: r for r in op7_decontamination.index(docs, wanted, "doc_id", "text", 10).selectExpr("id", "n_words", "postings.p as p", "postings.word as word").collect()}
    for i in range(len(texts)):
        own = h[bounds[i]:bounds[i + 1]].view(np.int64)
        at = np.flatnonzero(np.isin(own, words[:3]))
        p = [(x, w) for x, w in zip(indexed[i].p, indexed[i].word) if w in words[:3].tolist()]
        assert indexed[i].n_words == len(own) and p == list(zip(at.tolist(), own[at].tolist()))


def test_merger_drops_its_contexts(monkeypatch):
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        source = f.read()
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_ALIKE", 100)
    tok, library = op6_packing.WordTokenizer(source, character_kinds()), tokenizers.Tokenizer.from_str(source)
    rng = random.Random(2)
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("aeilrstvmno", k=rng.randint(1, 9))) for _ in range(30)) for _ in range(3)]
        raw, offsets = text_buffers(pa.array(texts))
        assert [x.tolist() for x in tok.ids(raw, offsets)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        kept = len(tok.merger.alike)
        tok.merger.reset()
        assert len(tok.merger.alike) == (0 if kept > 100 else kept)
