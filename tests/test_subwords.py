"""Subword windows and scores against the tokenizer and a plain pass."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import corpus as cp
from lexiloom.operators import evaluation as ev
from lexiloom.operators import subwords as sw

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def made():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").collect()]
    return spark.createDataFrame([*rows, (900, None, "none"), (901, "", "none"), (902, "é🙂 " * 3000, "odd"), (None, "no id", "odd")], "doc_id long, text string, source string")


def test_windows(spark):
    """The table function's windows are those of the plan over token counts."""
    for longest, stride in ((64, 32), (64, 64), (10, 7), (5, 1)):
        sizes = [0, 1, 4, 5, 9, 10, 11, 63, 64, 65, 96, 97, 200]
        plan = ev.window_plan(spark.createDataFrame([(n, n) for n in sizes], "k long, n long"), "n", ["k"], longest, stride).collect()
        assert sorted(tuple(r) for r in plan) == sorted((n, *w) for n in sizes for w in sw.windows(n, longest, stride))


def test_ids_are_the_tokenizers(docs, made):
    got = sw.subwords(docs, "doc_id", "text", VOCABULARY, 64, 64, end=2, keep=("source",)).collect()
    held = {}
    for r in sorted(got, key=lambda r: r["begin"]):
        assert len(r["ids"]) == r["end"] - r["begin"] == r["target_len"] <= 64
        held.setdefault((r["doc_id"], r["source"]), []).extend(r["ids"])
    want = {(r["doc_id"], r["source"]): [*made.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    assert held == want
    bare = sw.subwords(docs.where("doc_id > 899"), "doc_id", "text", VOCABULARY, 64, 64)
    assert {r["doc_id"] for r in bare.collect()} == {902}


def test_blocks(docs, made):
    """Packing goes by windows and not by whole documents, and gives the blocks of the whole pool."""
    pieces = sw.subwords(docs.where("doc_id is not null"), "doc_id", "text", VOCABULARY, 100, 100, end=2)
    got = [r["input_ids"] for r in cp.pack_blocks(pieces, "ids", ["doc_id", "begin"], 128).orderBy("block_id").collect()]
    pool = [i for r in docs.where("doc_id is not null").orderBy("doc_id").collect() for i in [*made.encode(r["text"] or "", add_special_tokens=False).ids, 2]]
    assert got == [pool[k : k + 128] for k in range(0, len(pool) - 127, 128)]


def test_perplexity(spark, docs, made):
    """Each window's loss and each source's perplexity by a plain pass over ids."""
    pieces = sw.subwords(docs, "doc_id", "text", VOCABULARY, 1 << 20, 1 << 20)
    single, pair = sw.bigram_counts(pieces, "ids", made.get_vocab_size())
    texts = [made.encode(r["text"] or "", add_special_tokens=False).ids for r in docs.collect()]
    assert single.sum() == sum(map(len, texts)) and pair.sum() == sum(max(0, len(t) - 1) for t in texts)
    rows = sw.subwords(docs, "doc_id", "text", VOCABULARY, 64, 32, keep=("source",))
    got = sw.scored(rows, "ids", "target_len", 64, sw.bigram_model(single, pair)).collect()
    share = (single + 0.5) / (single.sum() + 0.5 * len(single))
    sums = {}
    for r in got:
        each = []
        for k in range(len(r["ids"]) - r["target_len"], len(r["ids"])):
            p = share[r["ids"][k]]
            if k:
                b = r["ids"][k - 1]
                n = min(pair[int(sw._bucket(np.array([b]), np.array([r["ids"][k]]))[0])], single[b])
                p = (n + 32.0 * p) / (single[b] + 32.0)
            each.append(-math.log(p))
        assert r["error"] is None and r["loss"] == pytest.approx(sum(each) / len(each), rel=1e-9)
        total, n = sums.get(r["source"], (0.0, 0))
        sums[r["source"]] = total + sum(each), n + len(each)
    table = spark.createDataFrame([(r["source"], r["loss"], r["target_len"]) for r in got], "source string, loss double, target_len long")
    assert {r["source"]: r["perplexity"] for r in ev.perplexity(table, ["source"]).collect()} == pytest.approx({s: math.exp(t / n) for s, (t, n) in sums.items()})


def test_failing_model(spark):
    """Windows that the model cannot score are rows with an error; the others of their batch are scored; it is loaded once a worker."""

    def load():
        def model(ids, length, target):
            if (ids == 13).any():
                raise ValueError("thirteen")
            return ids.sum(axis=1) / length

        return model

    rows = spark.createDataFrame([(k, [k] * (1 + k % 5)) for k in range(100)], "k int, ids array<int>").withColumn("t", F.lit(1))
    got = sw.scored(rows, "ids", "t", 8, load, batch=7).collect()
    assert {r["k"]: (r["loss"], r["error"]) for r in got} == {k: (None, "thirteen") if k == 13 else (float(k), None) for k in range(100)}


def test_a_batch_is_tokenised_in_runs(spark, made):
    """What a worker holds of the tokenizer's answers does not grow with the rows of a batch; rows are the same, in order, beyond a run."""
    pick = np.random.default_rng(3).integers(0, 3 * sw.AT_ONCE // 50, 200).tolist()
    cut = list(sw.runs(pick, sw.AT_ONCE))
    assert [k for a, b in cut for k in range(a, b)] == list(range(200))
    assert all(b - a == 1 or sum(pick[a:b]) <= sw.AT_ONCE for a, b in cut) and len(cut) > 2 and list(sw.runs([], 5)) == [] and list(sw.runs([9, 1, 1], 2)) == [(0, 1), (1, 3)]
    rows = [(k, None if k % 50 == 0 else f"word{k} é " * (1 + 40 * k)) for k in range(100)]
    assert sum(len((t or "").encode()) for _, t in rows) > 3 * sw.AT_ONCE
    got = sw.subwords(spark.createDataFrame(rows, "k long, t string").coalesce(1), "k", "t", VOCABULARY, 512, 512, end=2).collect()
    held = {}
    for r in got:
        assert r["begin"] == len(held.setdefault(r["k"], []))
        held[r["k"]] += r["ids"]
    assert held == {k: [*made.encode(t or "", add_special_tokens=False).ids, 2] for k, t in rows}


def test_counts_over_more_rows_than_are_held_at_once(spark):
    """Windows are counted some at a time; none is lost or joined to another where a batch is cut."""
    import pyarrow as pa

    pieces = list(sw.cuts(pa.array([[k] for k in range(700)]), sw.ROWS_AT_ONCE))
    assert all(len(p) <= sw.ROWS_AT_ONCE for p in pieces) and pa.concat_arrays(pieces).to_pylist() == [[k] for k in range(700)]
    rows = [(k, [] if k % 97 == 0 else [k % 7, k % 11, 5][: 1 + k % 3]) for k in range(3 * sw.ROWS_AT_ONCE + 5)]
    single, pair = sw.bigram_counts(spark.createDataFrame(rows, "k int, ids array<int>").coalesce(1), "ids", 16)
    want, pairs = np.zeros(16, int), 0
    for _, ids in rows:
        want += np.bincount(np.array(ids, int), minlength=16).astype(int)
        pairs += max(0, len(ids) - 1)
    assert single.tolist() == want.tolist() and pair.sum() == pairs
