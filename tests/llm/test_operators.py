"""The operators against brute force, and on awkward rows."""

import collections
import functools
import json
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lexiloom.llm.embedding_dedup import depth_for, embedding_dedup, tables_for
from lexiloom.llm.html_extract import extract_main_text, main_text, merge, parse, wrapper
from lexiloom.llm.jaccard_join import choose_boundary, jaccard_join, need, subset_sizes
from lexiloom.llm.kd_shards import BITS, STEP, kd_shards, kd_tree
from lexiloom.llm.lm_score import edges, lm_score
from lexiloom.llm.packing import best_fit, improve, pack, places
from lexiloom.llm.permutation_index import Files, lift, orders, permutation_search
from lexiloom.llm.pu_toxicity import chosen, features, fit, learn, pu_toxicity, valued, weighed
from lexiloom.llm.quotation_links import quotation_links
from lexiloom.llm.soft_mixing import posteriors, soft_mix
from lexiloom.llm.words import Words

D = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, "the same text of some words here again", "en", "s"), (2, "the same text of some words here again", "en", "s"),
    (2, "the same text of some words here again", "en", "s"), (3, None, None, None), (4, "", "en", "s"), (5, " \t\n ", "fr", None),
    (None, "no id", "en", "s"), (6, "word " * 60_000, "en", "s"), (7, "x" * 200_000, "de", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def odd(spark):
    extra = {c: F.lit(1) for c in ("id", "n", "hi", "lo", "row", "score", "size", "shard", "rank", "p", "train", "w", "length")}
    return spark.createDataFrame(ODD, SCHEMA).withColumns(extra)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


def domain():
    return F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


def documents(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def test_words():
    texts = ["Hello hELLO  wörld\t\n x", None, "", "É é", "a" * 3_000_000 + " b", "a b c d e"]
    h, at = Words().tokens(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        got = words(t)
        assert len(got) == at[i + 1] - at[i]
        assert all(seen.setdefault(w, k) == k for w, k in zip(got, h[at[i] : at[i + 1]]))
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard_join(spark, k, percent):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()] + [
        (1000 + i, " ".join(f"w{j}" for j in range(20) if j != i % 17)) for i in range(60)
    ] + [(2000 + i, "") for i in range(3)]
    got = {
        r["doc_id"]: r for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), width=k, percent=percent).collect()
    }
    sets, up = {i: shingles(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and (n := len(a & b)) and 100 * n >= percent * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    assert all(got[i]["n_shingles"] == len(s) and got[i]["component_id"] == top(i) for i, s in sets.items())


def test_jaccard_long_lists(spark, monkeypatch):
    """Lists dealt over several tasks give the components of lists that are not."""
    rows = [(i, " ".join(f"w{j}" for j in range(30) if j != i % 27)) for i in range(90)] + [
        (200 + i, " ".join(f"v{j}" for j in range(12) if j != i % 5) + f" e{i}") for i in range(50)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, jaccard_join(docs, width=1, percent=80).collect()))
    monkeypatch.setattr("lexiloom.llm.jaccard_join.LIST_ROWS", 2)
    assert sorted(map(tuple, jaccard_join(docs, width=1, percent=80).collect())) == whole and len({r[2] for r in whole}) < 60


def test_jaccard_boundary():
    assert choose_boundary({6: 100, 12: 50}, 85, 3.0) >= 6 and subset_sizes(5, 85, 12) == [] and need(12, 14, 85) == 12
    # the least at which two different small sets can link
    assert choose_boundary({200: 10}, 85, 3.0) == 7 and choose_boundary({200: 10}, 80, 3.0) == 5 and choose_boundary(
        {200: 10}, 100, 3.0
    ) == 0
    assert subset_sizes(7, 85, 7) == [6] and subset_sizes(6, 85, 7) == [6] and subset_sizes(6, 85, 6) == []


def test_jaccard_repeated_ids(spark):
    """An id with two texts, each of which others copy, joins the components of both, and each row comes back once."""
    one, two, three = ("a b c d e f g h", "k l m n o p q r", "s t u v w x y z")
    rows = [(5, one), (5, two), (6, one), (7, two), (8, two), (9, three), (9, three)]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 5), (9, 9), (9, 9)]


def test_jaccard_odd(spark):
    got = jaccard_join(odd(spark)).collect()
    assert len(got) == len(ODD) and {r["doc_id"]: r["component_id"] for r in got}[2] == 1
    assert jaccard_join(empty(spark)).count() == 0


def test_html(spark):
    page = '<html><body><header>Site</header><nav>menu</nav><main><h1>T &amp; x</h1><p>One  two&nbsp;three<p>Four <i>fi</i>ve.<br>six<div class="share">s</div><form>f</form></main><div id="comments"><p>nice</p></div><footer>f</footer>'
    assert main_text(page) == "T & x\n\nOne two three\n\nFour five. six"
    assert main_text(None) == main_text("") == "" and main_text("just text") == "just text"
    rows = [
        (
            i, f"http://h.example/{i}",
            f"<body><div class=top>Menu here</div><div class=wrap><div class=x><h2>Title {i}</h2><p>{
                'body ' * (i + 20)
            }{i}</p></div></div><div class=low>Same for all, every page</div></body>",
        ) for i in range(5)
    ] + [(9, None, None), (None, "x", "<p>"), (9, "http://h.example/9", "")]
    got = {
        r["page_id"]: r["text"] for r in extract_main_text(
            spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
        ).collect()
    }
    assert got[3] == f"Title 3\n\n{'body ' * 23}3" and got[9] == ""
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shards(spark):
    docs = documents(spark)
    got = kd_shards(docs, 7).toPandas()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(
        zlib.crc32(text[r.doc_id].encode()) == r.text_crc32 and len(text[r.doc_id].encode()) + 16 == r["size"] for _, r in got.iterrows()
    )
    weights = got.groupby("shard")["size"].sum()
    assert sorted(weights.index) == list(range(7)) and weights.max() - weights.min() <= 3 * got["size"].max()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    copies = spark.createDataFrame(
        [(i, "same text") for i in range(400)] + [(1000 + i, f"text {i}") for i in range(200)], "doc_id long, text string"
    ).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s")})
    spread = kd_shards(copies, 4).groupBy("shard").agg(F.sum("size").alias("w")).collect()
    assert max(r["w"] for r in spread) - min(r["w"] for r in spread) <= 200
    assert kd_shards(odd(spark), 3).count() == len(ODD) and kd_shards(empty(spark), 3).count() == 0


def train():
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 1


@pytest.mark.parametrize("small", [{}, {"piece_bytes": 1 << 14, "segment_bytes": 1 << 12}])
def test_lm(spark, small):
    docs = documents(spark)
    got = {r["doc_id"]: r for r in lm_score(docs, train(), **small).collect()}
    seq = {r["doc_id"]: [*words(r["text"]), "\n"] for r in docs.collect()}
    taught = [s for i, s in seq.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    one = collections.Counter(w for s in taught for w in s)
    n, v, lower, m2, m3 = sum(one.values()), len(one), edges(1.5), 20_000.0, 200.0
    two = collections.Counter(p for s in taught for p in zip([None, *s], s))
    three = collections.Counter((a, b, c) for s in taught for a, b, c in zip([None, *s], s, s[1:]))
    low = lambda c: int(lower[np.searchsorted(lower, c, side="right") - 1])
    high = lambda c: int(lower[np.searchsorted(lower, c, side="right")]) - 1 if c else 0
    p1 = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    better = 0
    for i, s in seq.items():
        assert got[i]["n_tokens"] == len(s) and got[i]["train_tokens"] == n and got[i]["n_known"] == sum(one[w] > 0 for w in s)
        assert math.isclose(got[i]["base_score"], sum(math.log10(p1(w)) for w in s), rel_tol=1e-9)
        score = 0.0
        for k, w in enumerate(s):
            b = s[k - 1] if k else None
            h = one[b] if k else len(taught)
            p = (min(low(two[b, w]), h) + m2 * p1(w)) / (h + m2)
            if k and (h2 := high(two[s[k - 2] if k > 1 else None, b])):
                p = (min(low(three[s[k - 2] if k > 1 else None, b, w]), h2) + m3 * p) / (h2 + m3)
            score += math.log10(p)
        assert abs(got[i]["score"] - score) <= 0.02 * abs(score)
        better += got[i]["score"] > got[i]["base_score"]
    assert better > 0.6 * len(seq)
    assert lm_score(odd(spark), F.lit(True)).count() == len(ODD) and lm_score(empty(spark), F.lit(True)).count() == 0
    assert lm_score(odd(spark), F.lit(False)).where("n_known > 0").count() == 0


def test_mixing(spark):
    docs, marks = documents(spark), spark.read.parquet(f"{D}/labels.parquet")
    got = soft_mix(docs, marks, domain(), {"high": 3, "low": 1}).toPandas()
    total = (got["rate"] * got["n_tokens"]).sum()
    assert abs((got["rate"] * got["n_tokens"] * got["p_high"]).sum() / total - 0.75) < 1e-3 and got["rate"].min() >= 0
    # the same descent in numpy
    t, p, r = got["n_tokens"].to_numpy(float), got[["p_high", "p_low"]].to_numpy(), np.ones(len(got))
    start = t @ p
    for _ in range(200):
        r = np.maximum(0, r + p @ ((np.array([0.75, 0.25]) * t.sum() - (r * t) @ p) / start))
    assert np.abs(r - got["rate"]).max() < 1e-2
    grown = soft_mix(docs, marks, domain(), {"high": 0.9, "low": 0.1}, least=1.0, shrink=False)
    assert grown.where("rate < 1 or copies < 1").count() == 0
    assert soft_mix(odd(spark), labels(spark), domain(), {"high": 1, "low": 1}).count() == len(ODD)
    assert soft_mix(empty(spark), labels(spark), domain(), {"high": 1, "low": 1}).count() == 0


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    blank = [(90_003 + i, f"x{c * 1_000_000}y") for i, c in enumerate("\n \u00a0")]
    docs = documents(spark).limit(60).unionByName(
        spark.createDataFrame([(90_001, "a <|endoftext|> b"), (90_002, None), *blank], "doc_id long, text string"), allowMissingColumns=True
    )
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = pack(docs).toPandas()
    for i, g in got.groupby("doc_id"):
        ids = [*made.encode(text[i] or "", add_special_tokens=False).ids, 2]
        g = g.sort_values("piece")
        assert g["length"].sum() == len(ids) and list(g["piece"]) == list(range(len(g))) and (g["length"].iloc[1:] == 1024).all()
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in g.itertuples())
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g["offset"]) == list(g["length"].cumsum() - g["length"]) and g["length"].sum() <= 1024
    assert pack(odd(spark)).select("doc_id").distinct().count() == 8 and pack(empty(spark)).count() == 0


def test_local_search():
    start = collections.Counter({(6, 2): 1, (5, 3): 1, (4,): 1})
    found = improve(start.copy(), 10)
    assert sum(found.values()) == 2 and sum(sum(p) * n for p, n in found.items()) == 20
    bins = improve(best_fit({3: 7, 5: 4, 9: 2, 10: 1}, 10), 10)
    held = collections.Counter(x for p, n in bins.items() for x in p for _ in range(n))
    assert held == {3: 7, 5: 4, 9: 2, 10: 1} and all(sum(p) <= 10 for p in bins) and len({x[:2] for x in places(bins)}) == len(places(bins))


def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 16))
    rows = [
        *base, *(base[0] + 0.12 * rng.standard_normal((60, 16))), *(base[1] + 0.5 * rng.standard_normal((40, 16))), *(2 * base[:5]),
        *base[:5],
    ]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0]]
    table = spark.createDataFrame(
        [(i, [float(v) for v in x]) for i, x in enumerate(rows)] + [(1000 + i, x) for i, x in enumerate(bad)],
        "vec_id long, embedding array<double>",
    )
    return table.withColumns({c: F.lit(1) for c in ("id", "label", "unit", "ball", "rank", "dim")}), np.array(rows)


def test_embedding_dedup(spark):
    table, x = vectors(spark)
    got = {r["vec_id"]: r for r in embedding_dedup(table).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    count, exact = np.array([got[i]["n_links"] for i in range(len(x))]), link.sum(1)
    assert (count <= exact).all() and count.sum() >= 0.97 * exact.sum() and (count[300:360] == exact[300:360]).all()
    assert all(got[i]["component_id"] == 0 for i in (0, 300, 359, 400, 405)) and not got[300]["kept"] and got[0]["kept"]
    assert all(got[1000 + i]["n_links"] == 0 and got[1000 + i]["kept"] for i in range(7))
    assert embedding_dedup(table.where("vec_id < 0")).count() == 0


def test_permutation_search(spark):
    table, x = vectors(spark)
    got = permutation_search(table, F.col("vec_id") % 20 == 0, k=10).toPandas()
    hit = total = 0
    for q, g in got.groupby("query_id"):
        if q >= 1000:
            continue
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:10]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and np.allclose(g["score"], s[g["vec_id"]], atol=1e-9)
        hit, total = hit + len(set(best) & set(g["vec_id"])), total + 10
    assert hit >= 0.9 * total and set(got["vec_id"]) <= set(range(len(x))) | {1006}
    assert permutation_search(table.where("vec_id < 0"), F.lit(True)).count() == 0
    assert permutation_search(table.where("vec_id < 4"), F.lit(True), k=10).count() == 12


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = pu_toxicity(docs, marks, F.crc32(F.col("doc_id").cast("string")) % 3 != 1).join(marks, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    true = sum(r["toxic"] and r["predicted"] for r in held)
    assert true >= 0.6 * sum(r["toxic"] for r in held) and sum(r["predicted"] and not r["toxic"] for r in held) <= 2
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert pu_toxicity(odd(spark), labels(spark), F.lit(True)).count() == len(ODD) and pu_toxicity(
        empty(spark), labels(spark), F.lit(True)
    ).count() == 0


def test_quotation_links(spark):
    rows = [
        (1, 0, "u", "Hello there.\nSecond line"), (1, 1, "a", "> hello   there.\nHi!"),
        (1, 2, "u", ">> Hello there.\n> Hi!\nthanks\n\n> unknown\nmore"), (1, 3, "u", "new topic"),
        (1, 4, "a", "> Hello there.\n> second LINE\nboth"), (1, 5, "x", None), (None, 0, "u", "a"), (None, 1, "u", "> a\nb"),
        (2, None, "u", ">a"), (1, 0, "d", "Hello there."),
    ]
    got = quotation_links(
        spark.createDataFrame(
            rows, "conv_id long, turn long, role string, text string"
        ).withColumns({c: F.lit(1) for c in ("c", "t", "id", "path", "h")})
    ).collect()
    found = {(r["conv_id"], r["turn"], r["role"]): r for r in got}
    reply = lambda *k: (found[k]["parent_turn"], found[k]["depth"], found[k]["content"])
    assert reply(1, 1, "a") == (0, 1, "Hi!") and reply(1, 2, "u") == (
        1, 2, "thanks\n\nmore"
    ) and reply(1, 4, "a") == (0, 1, "both") and reply(None, 1, "u") == (0, 1, "b")
    assert [
        r["turn"] for r in sorted((r for r in got if r["conv_id"] == 1 and r["role"] != "d"), key=lambda r: r["position"])
    ][-2:] == [3, 5]
    assert sorted(r["position"] for r in got if r["conv_id"] == 1) == list(range(7))
    chain = spark.createDataFrame(
        [(1, i, "u", (f"> m{i - 1}\n" if i else "") + f"m{i}") for i in range(20)], "conv_id long, turn long, role string, text string"
    )
    assert [(r["depth"], r["position"]) for r in quotation_links(chain).orderBy("turn").collect()] == [(i, i) for i in range(20)]
    assert quotation_links(chain.where("turn < 0")).count() == 0


def test_quotation_of_some_lines(spark):
    text = "one\ntwo\nthree\n\nA paragraph cut\nover two lines.\n\nlast"
    rows = [
        (c, *r) for c in (1, None) for r in [
            (0, "two"), (1, text), (2, "> one\n> two\nfirst lines"), (3, "> a PARAGRAPH\n> cut over two lines.\nwrapped anew"),
            (4, "> three\n>\n> last\nleft out"), (5, "> one\n> not there\nnone"), (6, "> later\n> still\nnone"),
            (7, "later\n> one\nstill"), (8, "> later\n> still\njoined ends"), (9, "> two\n> two\ntwice"),
        ]
    ]
    got = quotation_links(
        spark.createDataFrame([(c, t, "u", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    ).collect()
    for c in (1, None):
        assert {r["turn"]: (r["parent_turn"], r["n_linked"]) for r in got if r["conv_id"] == c} == {
            0: (None, 0), 1: (None, 0), 2: (1, 1), 3: (1, 1), 4: (1, 1), 5: (None, 0), 6: (None, 0), 7: (1, 1), 8: (7, 1), 9: (0, 1)
        }


def test_embedding_recall_at_any_size():
    for n in (10, 2000, 50_000, 1_000_000, 3_000_000, 1_000_000_000):
        depth = depth_for(n, 2.0)
        tables = max(64, tables_for(depth, 0.9, 2.0, 0.99))
        # a pair at cosine 0.9 is at distance sqrt(0.2)
        r = 2.0 / math.sqrt(0.2)
        p = math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-(r**2) / 2))
        assert 1 - (1 - p**depth) ** tables >= 0.99


def test_embedding_links_at_the_depth_of_millions(spark, monkeypatch):
    monkeypatch.setattr("lexiloom.llm.embedding_dedup.depth_for", lambda n, width: depth_for(3_000_000, width))
    rng = np.random.default_rng(8)
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in rng.standard_normal((2, 300, 64)))
    b -= (a * b).sum(1)[:, None] * a
    near = 0.901 * a + math.sqrt(1 - 0.901**2) * b / np.linalg.norm(b, axis=1)[:, None]
    table = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate([*a, *near])], "vec_id long, embedding array<double>")
    assert embedding_dedup(table).where("n_links = 1").count() >= 0.97 * 600


def test_lm_counts_what_occurs_once(spark, tmp_path):
    from lexiloom.llm.queries import op3_lm_score

    ids = [next(i for i in range(100) if (zlib.crc32(str(i).encode()) % 5 == 1) == held) for held in (False, True)]
    others = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 != 1][:40]
    once = "some words that follow one another only here"
    rows = [(ids[0], once), (ids[1], once), *((i, f"filler {i} text {i * 7} of its own") for i in others)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op3_lm_score(spark, str(tmp_path)).collect()}
    assert got[ids[1]]["held_out"] and not got[ids[0]]["held_out"]
    taught = [[*words(t), "\n"] for i, t in rows if i != ids[1]]
    one = collections.Counter(w for s in taught for w in s)
    two = collections.Counter(p for s in taught for p in zip([None, *s], s))
    three = collections.Counter((a, b, c) for s in taught for a, b, c in zip([None, *s], s, s[1:]))
    lower, n, v, score = edges(1.5), sum(one.values()), len(one), 0.0
    low = lambda c: int(lower[np.searchsorted(lower, c, side="right") - 1])
    high = lambda c: int(lower[np.searchsorted(lower, c, side="right")]) - 1 if c else 0
    s = [*words(once), "\n"]
    for k, w in enumerate(s):
        b = s[k - 1] if k else None
        h = one[b] if k else len(taught)
        p = (min(low(two[b, w]), h) + 20_000.0 * (one[w] + 0.5) / (n + 0.5 * (v + 1))) / (h + 20_000.0)
        if k and (h2 := high(two[s[k - 2] if k > 1 else None, b])):
            p = (min(low(three[s[k - 2] if k > 1 else None, b, w]), h2) + 200.0 * p) / (h2 + 200.0)
        score += math.log10(p)
    assert math.isclose(got[ids[1]]["score"], score, rel_tol=1e-9)


def test_html_attributes_and_depth(spark):
    assert main_text("<article><p title=it's>one</p><p>two</p><p>three's</p><p>four</article>") == "one\n\ntwo\n\nthree's\n\nfour"
    assert main_text('<p data-x=5">kept?</p><p>b</p>') == "kept?\n\nb"
    assert main_text('<p title="a > b" class = \'x>y\'>in</p><p title="open>rest') == "in\n\nrest"
    assert main_text(
        "<div>" * 100_000 + "deep <p>one<p>two<nav>menu</nav>" + "</div>" * 100_000 + "<p>after"
    ) == "deep\n\none\n\ntwo\n\nafter"
    assert len(main_text("<article>" + "<p>word word</p><h2>head</h2>" * 200_000 + "</article>")) == 200_000 * 17 - 2
    unlike = "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}>t{i}</div>" for i in range(9000))
    assert main_text(f"<body>{unlike}</body>").count("\n\n") == 8999
    rows = [(i, "http://deep.example/", "<div>" * (3000 + i) + f"<p>text {i}") for i in range(6)]
    got = extract_main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"wrapper": F.lit(1), "text": F.lit(2)})
    ).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"text {i}" for i in range(6)}


def test_html_wrapper_decides(spark):
    """No article, main or telling class: the block of the host's slots is the article, whatever a page's own weights are."""
    page = (
        "<body><div class=a1><p>Welcome to this site of ours, with a long line that stands on every page of it</p><ul><li>One<li>Two</ul></div>"
        "<div class=b2><div class=k><h1>Title {i}</h1><div>{body}</div><div class=c>Read on below</div><p>end {i}</p></div></div><div class=z9><p>{small}</p><p>All rights are reserved by us, in every country</p></div></body>"
    )
    rows = [
        (i, "http://plain.example/x", page.format(i=i, body=f"body {i} " * (40 if i else 1), small=f"seen {i} times")) for i in range(20)
    ]
    got = {
        r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    }
    for i in range(20):
        assert got[i] == f"Title {i}\n\n{(f'body {i} ' * (40 if i else 1)).strip()}\n\nend {i}"
    assert main_text(rows[0][2]) != got[0]


def test_html_names(spark):
    """A word inside a name takes nothing from one page's article; a block that the host repeats goes."""
    page = '<body><article><h1>T{i}</h1>{own}<p>text {i} of some length</p><div class="cookie-bar">We use cookies {i}</div><div class="ad">buy {i}</div></article></body>'
    own = '<div class="notice-board">board</div><section id="comment-policy">policy</section>'
    rows = [
        (i, "http://names.example/", page.format(i=i, own=own if i == 3 else "")) for i in range(12)
    ] + [(20, "http://lone.example/", page.format(i=20, own=own))]
    got = {
        r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    }
    assert got[3] == "T3\n\nboard\n\npolicy\n\ntext 3 of some length" and got[4] == "T4\n\ntext 4 of some length"
    assert got[20] == "T20\n\nboard\n\npolicy\n\ntext 20 of some length\n\nWe use cookies 20"


def test_html_wrapper_size():
    """A wrapper follows the template, not the number of pages or their ids and names."""
    def page(i):
        body = "".join(
            f'<h2 id="head-{i}-{j}">h {i} {j}</h2><p class="own{chr(97 + i % 26)}x{chr(97 + i // 26)} c{i}">p {i} {j}</p>' for j in range(6)
        )
        return wrapper(parse(f"<body><div><a href=x>m</a></div><article>{body}</article></body>"))
    sizes, held = {}, page(0)
    for i in range(1, 401):
        held = merge(held, page(i))
        sizes[i] = len(json.dumps(held))
    assert sizes[400] < 1.5 * sizes[200] and sizes[400] < 100_000


def test_html_template_inside_article(spark):
    page = "<body><article><h1>Title {i}</h1><p>{body}</p><p>More of {i}</p><p>Read our app daily!</p><div>Made by us</div></article></body>"
    rows = [(i, f"http://many.example/{i}", page.format(i=i, body=f"body {i} " * 20)) for i in range(12)]
    rows += [(20 + i, f"http://few.example/{i}", page.format(i=i, body=f"body {i} " * 20)) for i in range(4)]
    rows += [(30 + i, f"http://copies.example/{i}", page.format(i=0, body="body 0 " * 20)) for i in range(9)]
    got = {
        r["page_id"]: r["text"] for r in extract_main_text(
            spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
        ).collect()
    }
    own = lambda i: f"Title {i}\n\n{(f'body {i} ' * 20).strip()}\n\nMore of {i}"
    template = "\n\nRead our app daily!\n\nMade by us"
    assert all(got[i] == own(i) for i in range(12))
    assert all(got[20 + i] == own(i) + template for i in range(4)) and all(got[30 + i] == own(0) + template for i in range(9))


def test_local_search_tries_every_donor():
    # 450 emptier bins have nothing to give; the exchange of a fuller one is still found
    bins = improve(collections.Counter({(5100 + i,): 1 for i in range(450)} | {(5600, 2200): 1, (7800,): 1}), 10_000)
    assert bins[(7800, 2200)] == 1 and sum(bins.values()) == 452


def test_toxicity_where_most_texts_are_toxic():
    rng = np.random.default_rng(3)
    common = lambda: rng.choice(200, 20, replace=False)
    toxic = lambda: np.unique(np.concatenate([common(), 1000 + rng.choice(10, 4, replace=False)])).astype(np.int32)
    clean = lambda: np.unique(common()).astype(np.int32)
    many, others = [toxic() for _ in range(1500)], [toxic() if i % 10 < 6 else clean() for i in range(3000)]
    known, count = np.unique(np.concatenate(many), return_counts=True)
    rate = np.array([sum(f in x for x in others) for f in known]) / len(others)
    used = known[chosen((count, len(many)), rate, 0.6)]

    def sample(sets):
        row, place = np.nonzero(np.array([np.isin(used, x) for x in sets]))
        return row, place, np.ones(len(row)), np.ones(len(sets))

    w, b = learn(sample(many), sample(others), 0.6, len(used))
    score = lambda x: 1 / (1 + np.exp(-(b + w[np.isin(used, x)].sum())))
    assert set(range(1000, 1010)) <= set(used.tolist())
    assert np.mean([score(toxic()) >= 0.7 for _ in range(200)]) > 0.95 and np.mean([score(clean()) < 0.7 for _ in range(200)]) > 0.95


@functools.cache
def features_of(word, hasher=Words()):
    return features(hasher, pa.array([word]))[0].tolist()


def values(text):
    """Each feature's value in a text, by the words of the module."""
    w = words(text)
    windows = max(1, round(len(w) / 128))
    seen = {(f, i * windows // len(w), x) for i, x in enumerate(w) for f in features_of(x)}
    return {f: min(255, math.ceil(n / windows * 16)) / 16 for f, n in collections.Counter(f for f, _, _ in seen).items()}


def test_feature_values():
    text = " ".join(f"w{i % 50}x" for i in range(700)) + " slur slurry slur SLUR" + " end" * 130
    want = values(text)
    used = np.array(sorted(want), np.int32)[::3]
    row, place, steps = valued(Words(), pa.array(["", text, None, "slur"]), used)
    assert {int(used[p]): s / 16 for r, p, s in zip(row, place, steps) if r == 1} == {f: want[f] for f in used.tolist()}
    assert {int(used[p]) for r, p in zip(row, place) if r == 3} == set(values("slur")) & set(used.tolist()) and not (row == 0).any()


def test_text_weights_do_not_hang_on_the_size(spark):
    """A corpus and its double, of texts on one, two and four rows, around and above the share at which texts are weighed down."""
    rows = spark.range(25_000).select("id", F.concat(F.lit("t"), F.when(F.col("id") < 16_000, F.col("id")).when(F.col("id") < 21_000, 100_000 + F.floor(F.col("id") / 2)).otherwise(200_000 + F.floor(F.col("id") / 4)).cast("string")).alias("text"))
    for copies in (10_000, 100_000, 10):
        each = []
        for source in (rows, rows.unionAll(rows)):
            n, got = weighed(source, copies)
            total = got.groupBy("text").agg(F.sum("weight").alias("w")).withColumn("kind", F.substring("text", 2, 1)).groupBy(F.length("text"), "kind").agg(F.min("w") / n, F.max("w") / n)
            each.append(sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in total.collect()))
        assert each[0] == each[1]


def test_toxicity_of_many_texts(spark):
    """The held-out labels of ten thousand texts in four languages: at most one clean text in a hundred is flagged, and nine toxic ones in ten are."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    got = pu_toxicity(docs, marks, ~held).where(held).join(marks, "doc_id").select("toxic", "predicted").collect()
    toxic, clean = ([r["predicted"] for r in got if r["toxic"] == y] for y in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean) and len(clean) > 1000


def test_toxicity_brute_force(spark):
    rng = np.random.default_rng(4)
    plain, bad = [f"word{i}" for i in range(300)], [f"slur{i}x" for i in range(6)]
    rows, marks = [], []
    for i in range(900):
        toxic = i % 5 == 0
        rows.append((i, " ".join([*rng.choice(plain, 25), *(rng.choice(bad, 3) if toxic else [])])))
        if i % 3 == 0:
            marks.append((i, int(toxic)))
    rows += [(900 + i, "the same text of many rows") for i in range(50)]
    docs, labelled = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    used, w, b = fit(docs, labelled, F.lit(True), copies=40)
    held = [values(t) for _, t in rows]
    positive = [held[i] for i, y in marks if y]
    weight = np.array([950 / 40 / 50 if i >= 900 else 1.0 for i, _ in rows])
    prior = sum(y for _, y in marks) / len(marks)
    count = collections.Counter(f for x in positive for f in x)
    rate = {f: sum(g for x, g in zip(held, weight) if f in x) / weight.sum() for f in count}
    expect = []
    for f, n in sorted(count.items()):
        p, u = n / len(positive), rate[f]
        pooled = (p + 3 * u) / 4
        if n >= 3 and p >= 2.5 * u and (p - u) >= 4 * math.sqrt(max(pooled * (1 - pooled), 1e-12) * 4 / 3 / len(positive)):
            expect.append(f)
    assert used.tolist() == expect and len(expect) >= 6
    dense = lambda sets: np.array([[x.get(f, 0.0) for f in expect] for x in sets], float)
    x, y, v, c = dense(positive), dense(held), np.zeros(len(expect)), math.log(prior / (1 - prior))
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    m, s = np.zeros(len(expect) + 1), np.zeros(len(expect) + 1)
    for t in range(1, 401):
        zx, zy = x @ v + c, y @ v + c
        clean = np.average(np.log1p(np.exp(zy)), weights=weight) - prior * np.log1p(np.exp(zx)).mean()
        dx, dy = (-prior, 1.0) if clean >= 0 else (prior * sigmoid(zx), -1.0)
        dx, dy = np.broadcast_to(dx, len(x)) / len(x), dy * sigmoid(zy) * weight / weight.sum()
        g = np.append(x.T @ dx + y.T @ dy + 5e-5 * v, dx.sum() + dy.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        v, c = v - step[:-1], c - step[-1]
    assert np.allclose(w, v, atol=1e-6) and abs(b - c) < 1e-6
    got = {r["doc_id"]: r["score"] for r in pu_toxicity(docs, labelled, F.lit(True), copies=40).collect()}
    assert all(abs(got[i] - sigmoid(y[k] @ v + c)) < 1e-6 for k, (i, _) in enumerate(rows))
    # several blocks give the mean of their classifiers: the same decisions
    several = fit(docs, labelled, F.lit(True), block=300, copies=40)
    assert several[0].tolist() == expect and np.mean((y @ several[1] + several[2] > 0) == (y @ v + c > 0)) > 0.99


def test_permutation_search_of_thousands(spark):
    """Nine in ten neighbours are found of vectors that lie in no groups, and files rank by footrule."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 32)) * rng.uniform(0.8, 1.2, (6000, 1))
    x[3000:3400] = x[0]
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    ask = F.col("vec_id") % 50 == 0
    found = {share: permutation_search(table, ask, share=share).toPandas() for share in (1 / 12, 1.0)}
    hit, total, looked = 0, 0, []
    for q, g in found[1 / 12].groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:20]
        assert list(g.sort_values("rank")["rank"]) == list(range(1, 21)) and np.allclose(g["score"], s[g["vec_id"]], atol=1e-9)
        hit, total = hit + len(set(best) & set(g["vec_id"])), total + 20
    assert hit >= 0.9 * total
    pivots = lift(x[rng.permutation(6000)[:1500]], np.linalg.norm(x, axis=1).max())
    order = orders(lift(x, np.linalg.norm(x, axis=1).max()), pivots, 64)
    files = Files(order, len(pivots))
    for i in range(0, 3000, 100):
        footrule = np.full(len(x), 0)
        for place, p in enumerate(order[i]):
            at = np.where((order == p).any(axis=1), (order == p).argmax(axis=1), 4 * 64)
            footrule += np.abs(at - place)
        got = files.ranked(order[i], 500)
        met = footrule < sum(4 * 64 - j for j in range(64))
        assert set(got) == set(np.flatnonzero(met & (footrule <= np.sort(footrule[met])[min(499, met.sum() - 1)])))
        looked.append(len(got))
    assert np.mean(looked) < 0.1 * len(x) + 400


def linked_by_hand(rows):
    """(parent, depth, position, n_linked) of each row (turn, text) of a conversation, in turn order, by the rules of the docstring."""
    normal = lambda x: " ".join(x.split()).lower()
    parents, own_of, all_lines, linked = [], [], [], []
    for i, (_, text) in enumerate(rows):
        runs = []
        for line in text.split("\n"):
            m = re.match(r"^[ \t]*((?:>[ \t]*)+)", line)
            depth, body = (m[1].count(">"), line[m.end() :]) if m else (0, line)
            if runs and runs[-1][0] == depth:
                runs[-1][1].append(body)
            else:
                runs.append((depth, [body]))
        own, lines, found = set(), set(), []
        for place, (depth, body) in enumerate(runs):
            whole = "\n".join(body)
            if depth == 0:
                lines |= {normal(x) for x in body}
                own |= {normal(whole)} | {normal(x) for x in re.split(r"\n\s*\n", whole)} | {normal(x) for x in body}
            elif normal(whole):
                need = {normal(x) for x in body} - {""}
                at = next((j for j in range(i) if normal(whole) in own_of[j]), None)
                at = next((j for j in range(i) if need <= all_lines[j]), None) if at is None else at
                if at is not None:
                    found.append((depth, place, at))
        own_of.append(own)
        all_lines.append(lines)
        linked.append(len(found))
        parents.append(min(found)[2] if found else None)
    order, depth = [], [0 if p is None else None for p in parents]
    for i, p in enumerate(parents):
        depth[i] = 0 if p is None else depth[p] + 1
    stack = [i for i in reversed(range(len(rows))) if parents[i] is None]
    while stack:
        at = stack.pop()
        order.append(at)
        stack += [i for i in reversed(range(len(rows))) if parents[i] == at]
    place = {at: k for k, at in enumerate(order)}
    return {rows[i][0]: (None if p is None else rows[p][0], depth[i], place[i], linked[i]) for i, p in enumerate(parents)}


def test_quotation_links_brute_force(spark):
    rng = np.random.default_rng(12)
    said = ["Yes.", "no way", "I think so", "look at  this", "ok", "a line\nand another", "one\n\ntwo\nthree", "later then"]
    talks = {}
    for c in range(12):
        rows = []
        for i in range(25):
            parts = []
            for _ in range(int(rng.integers(0, 3))):
                if rows and rng.random() < 0.8:
                    lines = rows[int(rng.integers(len(rows)))][1].split("\n")
                    low = int(rng.integers(len(lines)))
                    parts += ["> " + x if rng.random() < 0.8 else ">>" + x.upper() for x in lines[low : low + int(rng.integers(1, 4))]]
                else:
                    parts.append("> nobody said this")
                parts.append(str(rng.choice(["", "and", "well"])))
            rows.append((i, "\n".join([*parts, *rng.choice(said, int(rng.integers(1, 3)))])))
        talks[c] = rows
    table = spark.createDataFrame(
        [(c if c else None, t, "u", x) for c, rows in talks.items() for t, x in rows], "conv_id long, turn long, role string, text string"
    )
    got = quotation_links(table.repartition(5)).collect()
    assert len(got) == 300 and sum(r["parent_turn"] is not None for r in got) > 50 and max(r["depth"] for r in got) > 2
    for c, rows in talks.items():
        expect = linked_by_hand(rows)
        assert {
            r["turn"]: (r["parent_turn"], r["depth"], r["position"], r["n_linked"]) for r in got if r["conv_id"] == (c if c else None)
        } == expect


def test_quotation_links_of_a_deep_chain(spark):
    """Ten thousand replies, each to the one before, and a message of very many lines."""
    rows = [
        (1, i, "u", (f"> m{i - 1}\n" if i else "") + f"m{i}") for i in range(10_000)
    ] + [(2, 0, "u", "\n".join(f"> q{i}\nr{i}" for i in range(5000)))]
    got = quotation_links(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("conv_id = 1")
    assert got.where("depth <> turn or position <> turn").count() == 0 and got.count() == 10_000


def test_kd_tree_brute_force(spark):
    """Every node is cut along its widest dimension, as near to its shards' share of the weight as rows allow."""
    rng = np.random.default_rng(9)
    places = np.column_stack(
        [rng.integers(0, 1 << 62, 700), rng.integers(0, 1 << 60, 700), (rng.integers(0, 5, 700) << 58) + rng.integers(0, 1 << 40, 700)]
    )
    size = rng.integers(16, 2000, 700)
    table = spark.createDataFrame([(int(s), *map(int, p)) for s, p in zip(size, places)], "size long, k0 long, k1 long, k2 long")
    tree = kd_tree(table, 3, 11, tolerance=0.0, whole=0.0)
    top = places >> (BITS - STEP)
    spread = np.maximum(1, top.max(0) - top.min(0))

    def check(node, rows):
        if node.shards == 1:
            return [(node.first, size[rows].sum())]
        wide = (top[rows].max(0) - top[rows].min(0)) / spread
        assert node.dim == max(range(3), key=lambda d: (wide[d], -d))
        left = rows & (places[:, node.dim] < node.cut)
        goal = size[rows].sum() * (node.shards // 2) / node.shards
        sums = np.concatenate([[0], np.cumsum(size[rows][np.argsort(places[rows, node.dim])])])
        assert abs(size[left].sum() - goal) == np.abs(sums - goal).min()
        return check(node.sides[0], left) + check(node.sides[1], rows & ~left)

    leaves = check(tree, np.ones(700, bool))
    assert [i for i, _ in leaves] == list(range(11)) and sum(w for _, w in leaves) == size.sum()


def test_posteriors_brute_force(spark):
    docs = [(1, "Alpha beta beta"), (2, "gamma delta"), (3, "alpha\tgamma gamma omega"), (4, ""), (5, None), (6, "beta " * 500)]
    marks = [(1, 1), (2, 0), (6, 1), (6, 0), (9, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labelled = spark.createDataFrame(marks, "doc_id long, quality int")
    got = {r["id"]: r for r in posteriors(table, labelled, domain(), ["high", "low"]).collect()}
    # a document of clashing labels counts for the first of its domains in the order of their names
    known = {1: "high", 2: "low", 6: "high", 9: "high"}
    split = lambda t: (t or "").lower().split()
    bucket = lambda w: ((xxhash.xxh64_intdigest(w.encode(), seed=42) + (1 << 63)) % (1 << 64) - (1 << 63)) % (1 << 14)
    seen = {d: collections.Counter(bucket(w) for i, t in docs if known.get(i) == d for w in split(t)) for d in ("high", "low")}
    prior = {"high": 4 / 6, "low": 2 / 6}
    for i, t in docs:
        logs = {}
        for d in seen:
            evidence = sum(math.log((seen[d][bucket(w)] + 1) / (sum(seen[d].values()) + (1 << 14))) for w in split(t))
            logs[d] = math.log(prior[d]) + evidence * min(1, 200 / max(1, len(split(t))))
        share = math.exp(logs["high"]) / sum(math.exp(x) for x in logs.values()) if max(logs.values()) > -700 else 1 / (
            1 + math.exp(logs["low"] - logs["high"])
        )
        assert math.isclose(got[i]["p"][0], share, rel_tol=1e-6) and got[i]["n_tokens"] == len(split(t))


def test_packing_near_the_bound():
    """The search against the least number of bins: by exhaustion where lengths are few, by the sum and the halves where they are many."""
    rng = np.random.default_rng(1)

    def least(items, capacity):
        best = [len(items)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                    place(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
            place(i + 1, [*bins, items[i]])

        place(0, [])
        return best[0]

    worse = 0
    for _ in range(60):
        items = sorted((int(x) for x in rng.integers(1, 20, 9)), reverse=True)
        made = sum(improve(best_fit(dict(collections.Counter(items)), 20), 20).values())
        worse += made - least(items, 20)
    assert 0 <= worse <= 3
    many = collections.Counter(int(x) for x in np.minimum(1024, rng.lognormal(5, 1, 20_000).astype(int) + 1))
    bins = improve(best_fit(dict(many), 1024), 1024)
    bound = max(-(-sum(k * n for k, n in many.items()) // 1024), sum(n for k, n in many.items() if k > 512))
    assert bound <= sum(bins.values()) <= 1.002 * bound
