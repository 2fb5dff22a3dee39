"""The quality model: its measures and trees by brute force, held-out accuracy, awkward rows."""

import collections
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import additive_quality as aq
from lexiloom.llm.queries import QUERIES
from lexiloom.llm.words import Words

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"


def plainly(text):
    """The measures by their words."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(aq.MEASURES)
    kind = lambda f: sum(map(f, raw))
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    lower = [w.lower() for w in words]
    n, size, length = len(words), len(raw), [len(w) for w in words]
    share = lambda x, of: x / of if of else 0.0
    small, capitals = kind(lambda b: 97 <= b <= 122), kind(lambda b: 65 <= b <= 90)
    digits, beyond = kind(lambda b: 48 <= b <= 57), kind(lambda b: b > 127)
    stops, loud, quotes = (kind(lambda b, s=s: b in s) for s in (b".,;:", b"!?", b"\"'()-"))
    ends, blanks = kind(lambda b: b in b"\n\r"), kind(lambda b: b in b" \t\x0b\x0c")
    controls = kind(lambda b: b < 32 or b == 127) - ends - kind(lambda b: b in b"\t\x0b\x0c")
    symbols = size - small - capitals - digits - stops - loud - quotes - beyond - controls - blanks - ends
    is_symbol = lambda b: 32 < b < 127 and not chr(b).isalnum() and b not in b".,;:!?\"'()-"
    triples = [tuple(lower[i : i + 3]) for i in range(n - 2)]
    top = lambda x: max(collections.Counter(x).values(), default=0)
    mean = share(sum(length), n)
    sentences = sum(w[-1] in b".!?" for w in words)
    return [
        math.log1p(size), math.log1p(n), math.log1p(ends + 1), symbols / size, small / size, share(capitals, small + capitals), digits / size,
        stops / size, loud / size, quotes / size, beyond / size, controls / size, blanks / size,
        -sum(c / size * math.log2(c / size) for c in collections.Counter(raw).values()), mean,
        math.sqrt(max(share(sum(x * x for x in length), n) - mean**2, 0)), math.log1p(max(length, default=0)), share(sum(x <= 3 for x in length), n),
        share(sentences, n), share(sum(65 <= w[0] <= 90 for w in words), n), share(sum(is_symbol(w[-1]) for w in words), n),
        share(sum(len(w) == 1 and is_symbol(w[0]) for w in words), n), share(len(set(lower)), n),
        share(sum(a == b for a, b in itertools.pairwise(lower)), n), share(top(lower), n), share(len(set(triples)), n - 2 if n > 2 else 0),
        share(top(triples), n - 2 if n > 2 else 0), math.log1p(share(n, ends + 1)), math.log1p(share(n, sentences)),
    ]


def test_measures():
    texts = [
        None, "", " \n\t ", "a", "A b.\nA b. A b!", "x" * 70_000, "the the the end", "| # | a1 b2 $$$ | é ü\x01", "Ende.\r\n\r\nWas?  'So' (nun) – ja", "a b c a b c a b c",
    ]
    got = aq.text_measures(Words(), pa.array([*texts, "last one"]).slice(0, len(texts)))
    for text, row in zip(texts, got, strict=True):
        assert row == pytest.approx(plainly(text), rel=1e-5, abs=1e-4), (text or "")[:40]
    assert aq.text_measures(Words(), pa.array([], pa.string())).shape == (0, len(aq.MEASURES))
    assert not aq.text_measures(Words(), pa.array([None, ""], pa.string())).any()


def test_three_leaves():
    """The best partition of all into at most three runs of bins."""
    pick = np.random.default_rng(5)
    for _ in range(20):
        g, h = pick.normal(size=aq.BINS), pick.uniform(0, 2, aq.BINS)
        gains = {}
        for i in range(1, aq.BINS):
            for j in range(i, aq.BINS):
                runs = [slice(0, i), slice(i, j), slice(j, aq.BINS)]
                runs = [r for r in runs if r.start < r.stop]
                if all(h[r].sum() >= aq.LEAST for r in runs):
                    gains[i, j] = sum(g[r].sum() ** 2 / (h[r].sum() + aq.PENALTY) for r in runs)
        i, j = max(gains, key=gains.get)
        want = np.concatenate([np.full(r.stop - r.start, g[r].sum() / (h[r].sum() + aq.PENALTY)) for r in (slice(0, i), slice(i, j), slice(j, aq.BINS)) if r.start < r.stop])
        assert aq.three_leaves(g, h) == pytest.approx(want)
    assert not aq.three_leaves(np.zeros(aq.BINS), np.zeros(aq.BINS)).any()


def test_four_leaves():
    pick = np.random.default_rng(6)
    n = aq.COARSE
    for _ in range(10):
        g, h = pick.normal(size=(n, n)), pick.uniform(0, 1, (n, n))
        best = (-np.inf, None)
        for i in range(1, n):
            for j in range(1, n):
                parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, n)), (slice(i, n), slice(0, j)), (slice(i, n), slice(j, n))]
                gain = sum(g[p].sum() ** 2 / (h[p].sum() + aq.PENALTY) for p in parts) - g.sum() ** 2 / (h.sum() + aq.PENALTY)
                if gain > best[0]:
                    want = np.zeros((n, n))
                    for p in parts:
                        want[p] = g[p].sum() / (h[p].sum() + aq.PENALTY)
                    best = gain, want
        got, gain = aq.four_leaves(g, h)
        assert gain == pytest.approx(best[0]) and got == pytest.approx(best[1])


def test_interactions_are_learned():
    """Labels that hang on a pair of measures alone: main effects cannot tell, the chosen pair can."""
    pick = np.random.default_rng(7)
    b = pick.integers(0, aq.BINS, (4000, 4)).astype(np.uint8)
    y = ((b[:, 1] < 16) ^ (b[:, 3] < 16)).astype(float)
    w = np.ones(len(y))
    model = aq.Additive([np.arange(1, aq.BINS, dtype=np.float32)] * 4, 0.0, aq.learn_mains(b, y, w, 0.0, 20), [], np.zeros((0, aq.COARSE**2)))
    assert np.array_equal(model.bins(b.astype(np.float32)), b)
    gains = aq.pair_gains(b, y, w, model.logit(b))
    assert divmod(int(gains.argmax()), 4) == (1, 3)
    both = model._replace(pairs=[(1, 3)], tables=aq.learn_pairs(b, y, w, model.logit(b), [(1, 3)], 30))
    right = lambda m: ((m.logit(b) > 0) == (y > 0.5)).mean()
    assert right(model) < 0.65 and right(both) > 0.99


def test_held_out(spark):
    """Learned from three quarters of the labels, right on the rest: clean texts stay, poor ones do not."""
    d = "/root/testdata/sf0.01"
    got = QUERIES["op11_additive_quality"](spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    good, poor = ([r for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(rows) > 80 and sum(r["predicted"] for r in good) >= 0.99 * len(good)
    assert sum(r["predicted"] for r in poor) <= 0.1 * len(poor)
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()


def test_blocks_and_held_labels(spark):
    """Many blocks score about as one does, and labels of held-out rows change nothing."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    run = lambda rows, **k: dict(aq.additive_quality(docs, rows, ~held, rounds=30, **k).select("doc_id", "predicted").collect())
    one, many = run(labels), run(labels, block=100)
    assert sum(one[k] == many[k] for k in one) >= 0.97 * len(one)
    assert run(labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))) == one


def test_awkward(spark):
    """Null and empty texts and ids, repeated rows, clashing names, no labels, one label alone."""
    rows = [(1, "Some words.", "en", "s"), (1, "Some words.", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "no id", "en", "s"), (4, "w " * 90_000, "en", "s")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "x", "y", "block", "score", "b", "w", "train")})
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (9, 0), (4, None)], "doc_id long, quality int")
    got = aq.additive_quality(docs, labels, F.lit(True), rounds=3).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1
    only = aq.additive_quality(docs, labels.where("doc_id = 1"), F.lit(True)).collect()
    assert {round(r["score"], 6) for r in only} == {0.999}
    assert {r["score"] for r in aq.additive_quality(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert aq.additive_quality(docs.limit(0), labels, F.lit(True)).count() == 0
