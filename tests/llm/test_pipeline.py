"""The pipeline's stages, each against what it was given."""

import collections
import math
import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexiloom.llm.pu_toxicity import features, fit
from lexiloom.llm.soft_mixing import soft_mix
from lexiloom.llm.words import Words

D, D01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r["doc_id"] for r in docs.select("doc_id").collect()]
        stage(spark, docs, D).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(after) <= set(before)
        if k < 3:
            assert docs.columns == names
        if name == "near_duplicates":
            texts = docs.select("text").collect()
            assert len(texts) == len({r["text"] for r in texts}) == len(after)
        if name in ("mixing", "packing"):
            assert set(after) == set(before)
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_odd_rows(spark):
    rows = spark.createDataFrame(
        [
            (1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, None, None, None, None),
            (None, "a b c d e f", "en", "s", 1), (3, "a b c d e f", "en", "s", 1),
        ],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, rows, D).collect()]
    assert sorted(kept, key=str) == [1, 2, None]
    assert corpus_pipeline.toxicity(spark, rows, D).count() == 5 and corpus_pipeline.mixing(spark, rows.where("false"), D).count() == 0


def test_repeated_ids_are_judged_by_row(spark):
    texts = [
        (1, "a b c d e f g"), (2, "a b c d e f g"), (2, "quite another text of its own here"), (3, "one text under this id of three"),
        (3, "and a second one that nobody copied"), (3, "and a second one that nobody copied"), (None, "a b c d e f g"),
    ]
    rows = spark.createDataFrame(
        [(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long"
    )
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, rows, D).collect()]
    assert sorted(kept, key=str) == sorted({t for t in texts if t != (2, "a b c d e f g")}, key=str)


DDL = "doc_id long, text string, lang string, source string, n_chars long"


def test_toxicity_by_hand(spark):
    docs, labels = spark.read.parquet(f"{D01}/documents.parquet"), spark.read.parquet(f"{D01}/labels.parquet")
    used, w, b = fit(docs, labels, F.lit(True))
    weight = dict(zip(used.tolist(), w.tolist(), strict=True))
    known, hasher = {}, Words()

    def logit(text):
        said = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        windows, seen = max(1, round(len(said) / 128)), set()
        for i, x in enumerate(said):
            if x not in known:
                known[x] = [f for f in features(hasher, pa.array([x]))[0].tolist() if f in weight]
            seen |= {(f, i * windows // len(said), x) for f in known[x]}
        return b + sum(weight[f] * min(255, math.ceil(n / windows * 16)) / 16 for f, n in collections.Counter(f for f, _, _ in seen).items())

    expect = {r["doc_id"] for r in docs.collect() if 1 / (1 + math.exp(-logit(r["text"]))) < corpus_pipeline.TOXIC}
    kept = [r["doc_id"] for r in corpus_pipeline.toxicity(spark, docs, D01).collect()]
    assert len(kept) == len(expect) and set(kept) == expect
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    assert len(toxic - expect) >= 0.5 * len(toxic) and len(clean & expect) >= 0.98 * len(clean)


def test_near_duplicates_by_hand(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in docs.collect():
        x = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(up))
        sets[r["doc_id"]] = {tuple(x[i : i + 5]) for i in range(len(x) - 4)} or ({tuple(x)} if x else set())
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, D).collect()]
    assert sorted(kept) == [i for i in ids if find(i) == i] and len(kept) < len(ids)


def test_mixing_by_hand(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    quality = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    rated = {r["doc_id"]: r for r in soft_mix(docs, labels, quality, corpus_pipeline.WEIGHTS, least=1.0, shrink=False).collect()}
    count = collections.Counter(r["doc_id"] for r in corpus_pipeline.mixing(spark, docs, D).collect())
    assert set(count) == set(rated) and min(count.values()) == 1
    assert all(abs(n - rated[i]["rate"]) < 1 for i, n in count.items())
    tokens = {k: sum(n * rated[i]["n_tokens"] * rated[i][f"p_{k}"] for i, n in count.items()) for k in corpus_pipeline.WEIGHTS}
    assert all(abs(tokens[k] / sum(tokens.values()) - x) < 0.05 for k, x in corpus_pipeline.WEIGHTS.items())


def test_packing_by_hand(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(80)
    docs = docs.unionByName(docs.limit(5))
    got = corpus_pipeline.packing(spark, docs, D).toPandas()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    count = collections.Counter(r["doc_id"] for r in docs.collect())
    total = 0
    for i, g in got.groupby("doc_id"):
        ids = [*made.encode(text[i] or "", add_special_tokens=False).ids, 2]
        total += count[i] * len(ids)
        pieces = collections.Counter((r.start, r.length, r.ids_crc32) for r in g.itertuples())
        assert set(pieces.values()) == {count[i]} and sum(length for _, length, _ in pieces) == len(ids)
        assert all(zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) == crc for a, n, crc in pieces)
    fills = got.groupby("sequence_id")["length"].sum()
    assert fills.max() <= 1024 and len(fills) <= math.ceil(total / 1024) * 1.02 + 1


def test_stages_on_awkward_tables(spark):
    """No rows; nulls, empty and very long texts; extra columns of every name that a stage uses."""
    long = " ".join(f"word{i}" for i in range(200_000))
    rows = [
        (1, long, "en", "s", 9), (2, long + " more", "en", "s", 9), (3, "", None, None, None), (4, None, "en", "s", 0),
        (None, "x y", "en", "s", 3), (5, "a b c", "en", "s", 5),
    ]
    names = ("toxicity", "copies", "copy", "row", "score", "id", "rep", "component_id", "n", "features", "piece", "length")
    for few in (rows, []):
        docs = spark.createDataFrame(few, DDL).withColumns({c: F.lit(7) for c in names})
        toxic = corpus_pipeline.toxicity(spark, docs, D)
        assert toxic.columns == docs.columns and toxic.count() == len(few)
        kept = corpus_pipeline.near_duplicates(spark, docs, D)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in few if r[0] != 2), key=str)
        mixed = corpus_pipeline.mixing(spark, docs, D)
        assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.select("doc_id").collect()} == {r[0] for r in few}
        assert {r["doc_id"] for r in corpus_pipeline.packing(spark, docs, D).collect()} == {r[0] for r in few}


def test_packing_of_long_blanks(spark):
    """A million line breaks, spaces or no-break spaces in a row are packed whole."""
    rows = [(i, f"x{c * 1_000_000}y", "en", "s", 1) for i, c in enumerate("\n \u00a0")]
    got = corpus_pipeline.packing(spark, spark.createDataFrame(rows, DDL), D).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {0: 500_004, 1: 1_000_002, 2: 62_506}
