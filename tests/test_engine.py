import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import augment as au
from lexiloom.operators import controls as ct
from lexiloom.operators import conversation as cv
from lexiloom.operators import corpus as cp
from lexiloom.operators import dialogue as dg
from lexiloom.operators import evaluation as ev
from lexiloom.operators import labeling as lb
from lexiloom.operators import stats
from lexiloom.plans.components import components
from lexiloom.plans.numbering import number_all, number_within
from lexiloom.sources import io


def lines(spark, text):
    return spark.createDataFrame([("s", i, x) for i, x in enumerate(text)], "source string, pos int, line string")


def test_sections(spark):
    rows = ["TOC", "I. A ONE", "II. B TWO", "", "I. A ONE", "body a1", "I.", "body a2", "II. B TWO", "body b"]
    got = {r["title"]: (r["first_pos"], r["body"]) for r in cp.sections(lines(spark, rows), "source", "pos", "line").collect()}
    assert got == {"A ONE": (1, "body a1\nI.\nbody a2"), "B TWO": (2, "body b")}
    whole = cp.sections_or_whole(lines(spark, ["a", "I. B"]), "source", "pos", "line").collect()
    assert [(r["title"], r["body"]) for r in whole] == [(None, "a\nI. B")]


def test_chunks(spark):
    ten = " ".join("w" * 10)
    df = spark.createDataFrame([(1, f"\n\nshort one\n\n{ten}"), (2, ten.rsplit(" ", 1)[0])], "d int, t string")
    got = cp.number_chunks(cp.chunk(df, "t", ["d"]), ["d", "paragraph_index"]).collect()
    assert [(r["d"], r["paragraph_index"], r["chunk_id"], r["word_count"]) for r in got] == [(1, 2, 0, 10)]


def test_framings(spark):
    df = spark.createDataFrame([("central", 150), ("central", 50), ("minor", 12)], "l string, n int")
    got = [r[0] for r in df.select(cp.framings_for(F.col("l"), F.col("n"))).collect()]
    assert got == [["VERBATIM", "WATSON", "QA", "CHAIN", "REVERSE"], ["VERBATIM", "WATSON", "QA", "CHAIN"], ["VERBATIM"]]


def test_budget(spark):
    got = [
        r[0] for r in spark.createDataFrame(
            [(239_999,), (240_000,), (400_000,), (400_001,)], "n long"
        ).select(cp.budget_verdict(F.col("n"))).collect()
    ]
    assert got == ["WARNING", "OK", "OK", "NOTE"]


def test_packing(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5]), (2, [6, 7, 8, 10])], "d int, ids array<int>")
    got = sorted((r["block_id"], r["input_ids"]) for r in cp.pack_blocks(df, "ids", ["d"], 5, F.lit(9)).collect())
    assert got == [(0, [1, 2, 3, 9, 4]), (1, [5, 9, 6, 7, 8])]
    assert tuple(cp.pack_stats(df, "ids", 5).first()) == (3, 2, 2)


def test_windows(spark):
    df = spark.createDataFrame([(n,) for n in (300, 1024, 1536, 2000)], "n long")
    got = {}
    for r in ev.window_plan(df, "n", ["n"]).collect():
        got.setdefault(r["n"], []).append((r["begin"], r["end"], r["target_len"]))
    assert {k: sorted(v) for k, v in got.items()} == {
        300: [(0, 300, 300)], 1024: [(0, 1024, 1024)], 1536: [(0, 1024, 1024), (512, 1536, 512)],
        2000: [(0, 1024, 1024), (512, 1536, 512), (1024, 2000, 464)],
    }
    assert all(sum(x[2] for x in v) == k for k, v in got.items())


def test_gates(spark):
    df = spark.createDataFrame([(10.0, 9.49, 0.60, 0.571), (10.0, 9.51, 0.60, 0.569)], "a double, b double, c double, d double")
    got = df.select(
        ev.perplexity_gate(F.col("a"), F.col("b"), F.col("a"), F.col("a"))["h1"], ev.accuracy_gate(F.col("c"), F.col("d")),
        ev.probe_gate(F.col("a"), F.col("a")),
    ).collect()
    assert [tuple(r) for r in got] == [(True, True, False), (False, False, False)]


TALKS = {
    "c1": [("A", 0.8, 0), ("B", 0.1, 0), ("A", 0.6, 0), ("B", 0.2, 0), ("A", 0.7, 0), ("B", 0.3, 0), ("A", 0.9, 1)],
    "c2": [("A", 0.2, 0), ("B", 0.7, 0), ("A", 0.3, 0), ("B", 0.75, 1)],
    "c3": [("A", 0.9, 0), ("B", 0.9, 0), ("A", 0.69, 0), ("B", 0.9, 0)],
    "c4": [("A", 0.5, 1)],
    "c5": [("A", 0.7, 1)],
}


def talks(spark):
    return spark.createDataFrame(
        [(c, i, s, x, bool(a)) for c, t in TALKS.items() for i, (s, x, a) in enumerate(t)],
        "conv string, turn int, speaker string, score double, accused boolean",
    )


def test_commitments(spark):
    got = {
        (r["conv"], r["speaker"]): tuple(r)[2:] for r in cv.commitments(
            talks(spark), "conv", "speaker", "turn", F.col("score"), F.col("accused")
        ).collect()
    }
    assert got[("c1", "A")] == (4, 6, 2) and got[("c1", "B")] == (None, None, None)
    assert got[("c2", "A")] == (None, None, None) and got[("c2", "B")] == (1, 3, 2)
    assert got[("c3", "A")] == (None, None, None) and got[("c3", "B")] == (1, None, None)
    assert got[("c4", "A")] == (None, 0, None) and got[("c5", "A")] == (0, 0, 0)


def test_rollup(spark):
    t = talks(spark)
    ends = cv.outcome(t, "conv", "turn", "speaker", F.col("accused"))
    m = cv.commitments(t, "conv", "speaker", "turn", F.col("score"), F.col("accused"))
    got = {
        r["conv"]: (
            r["winner"], r["termination_reason"], r["n_turns"], r["commitment_gap"]
        ) for r in cv.rollup_conversations(ends, m, "conv", "speaker", F.lit("A")).collect()
    }
    assert got == {
        "c1": ("A", "accusation", 7, 2), "c2": ("B", "accusation", 4, 2), "c3": (None, "max_turns", 4, None),
        "c4": ("A", "accusation", 1, None), "c5": ("A", "accusation", 1, 0),
    }


def test_cache_asks_once(spark, tmp_path):
    log = tmp_path / "asked"

    def provider(prompts):
        with open(log, "a") as f:
            f.writelines(f"{p}\n" for p in prompts)
        return [None if p == "bad" else f"LABEL: minor {p}" for p in prompts]

    rows = spark.createDataFrame([("a",), ("a",), ("bad",), ("held",)], "content string")
    first, fresh = lb.classify(rows, spark.createDataFrame([], "key string, answer string"), provider, "m", "v1")
    assert sorted((r["content"], r["label"], r["cached"]) for r in first.collect()) == [
        ("a", "minor", False), ("a", "minor", False), ("bad", "error", False), ("held", "minor", False)
    ]
    assert fresh.count() == 3 and sorted(log.read_text().split()) == ["a", "bad", "held"]
    again, fresh = lb.classify(rows, fresh, provider, "m", "v1")
    assert all(r["cached"] for r in again.collect()) and fresh.count() == 0


def test_distribution_of_nothing(spark):
    got = lb.distribution(spark.createDataFrame([], "label string")).collect()
    assert len(got) == 5 and all(r["n"] == 0 and r["pct"] == 0.0 and r["bar"] == "" for r in got)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 105), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[105] == got[100] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbers(spark):
    df = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(200)], "k long, v long")
    got = number_within(df, ["k"], ["v"], "n").collect()
    for k in (None, 0, 1, 2):
        held = sorted(r["n"] for r in got if r["k"] == k)
        assert held == list(range(len(held)))
    assert [r["n"] for r in number_all(df, ["v"], "n").orderBy("v").collect()] == list(range(200))


def test_dialogue(spark):
    agent = "struct<model_id: string, adapter_id: string, role: string, ground_truth_is_llm: boolean>"
    row = lambda c, s: (c, ("one", None, None, True), ("two", "a", None, False), s)
    configs = spark.createDataFrame(
        [row("x", 0), row("y", None), row(None, 1)], f"conv_id string, agent_A_cfg {agent}, agent_B_cfg {agent}, seed int"
    )

    def provider(model, shown, seed):
        if seed == 2:
            raise TimeoutError
        return (
            f'{{"reply": "{len(shown)} {shown[-1]["content"]}", "suspicion_score": 7, "public_accusation": {
                "true" if seed == 43 else "false"
            }}}',
            5, 6,
        )

    got = dg.failed(dg.converse(configs, provider, {"initiator": "I", "responder": "R"}, 2)).collect()
    x, y = (sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["turn_idx"]) for c in "xy")
    assert [(r["turn_idx"], r["speaker_id"], r["speaker_role"]) for r in x] == [
        (0, "A", "initiator"), (1, "B", "responder"), (2, "A", "initiator"), (3, "B", "responder")
    ]
    assert x[0]["reply"] == "1 I" and x[1]["reply"].startswith("2 1 I") and x[1]["adapter_id"] == "a" and not x[1]["ground_truth_is_llm"]
    assert x[2]["is_failed"] and x[2]["reply"] == "" and x[2][
        "suspicion_score"
    ] == 0.5 and x[0]["suspicion_score"] == 1.0 and x[2]["latency_ms"] >= 0
    assert [r["turn_idx"] for r in y] == [0, 1] and y[1]["public_accusation"] and len(got) == 6
    assert dg.converse(configs.where("seed = 9"), provider, {"initiator": "I", "responder": "R"}).count() == 0


def test_controls(spark):
    docs = spark.createDataFrame([(i, "One. Two! Three? Four", i % 4) for i in range(40)] + [(99, None, None)], "d int, t string, n int")
    mixed = {r["s"] for r in docs.select(ct.shuffle_sentences(F.col("t"), F.col("d")).alias("s")).collect()}
    assert None in mixed and len(mixed) > 5 and all(sorted(s.split()) == ["Four", "One.", "Three?", "Two!"] for s in mixed - {None})
    kept = ct.match_tokens(docs, "d", "n", 30).collect()
    assert 27 < max(r["tokens_so_far"] for r in kept) <= 30 and max(r["tokens_so_far"] for r in kept) == sum(r["n"] or 0 for r in kept)
    rows, seen = ct.progress(docs.withColumn("l", F.when(F.col("d") < 3, "a").otherwise("b")), "l", ["a", "b", "c"])
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"total": 41, "a": 3, "b": 38, "c": 0}
    got = {
        r["dimension"]: (r["n"], r["mean"], r["spread"]) for r in ct.judged(
            spark.createDataFrame([("v", 1.0, None), ("v", 3.0, 5.0)], "k string, a double, b double"), ["k"], ["a", "b"]
        ).collect()
    }
    assert got == {"a": (2, 2.0, 1.0), "b": (1, 5.0, 0.0)}


def test_augment_does_not_keep_failures(spark):
    rows = spark.createDataFrame(
        [(1, "central", "{content} x", 2), (2, "minor", "y", 1), (3, "none", "z", 1)],
        "chunk_id int, label string, content string, word_count int",
    )
    empty = spark.createDataFrame([], "key string, answer string")
    good, bad, fresh = au.augment(rows, empty, lambda p: [None if x.endswith("1.") else "said" for x in p], "m", "v1", 3)
    assert sorted((r["chunk_id"], r["framing"]) for r in good.collect()) == [(1, "QA")] * 3 + [(1, "VERBATIM")] * 3 + [(2, "VERBATIM")]
    assert [(r["framing"], r["copy"]) for r in bad.orderBy("copy").collect()] == [("CHAIN", 1), ("CHAIN", 2), ("CHAIN", 3)]
    assert fresh.count() == 1 and "PASSAGE:\n{content} x\n" in good.where("framing = 'QA'").first()["text"]
    again, _, fresh = au.augment(rows, fresh, lambda p: ["1"] * len(p), "m", "v1", 1)
    assert fresh.count() == 1 and again.where("framing = 'QA'").first()["cached"]


def test_pack_within(spark):
    docs = spark.createDataFrame([(1, [1, 2, 3]), (2, [4]), (3, [])], "d int, ids array<int>")
    got = [(r["d"], r["block"], r["input_ids"]) for r in cp.pack_within(docs, "ids", ["d"], 2, F.lit(9)).collect()]
    assert sorted(got) == [(1, 0, [1, 2]), (1, 1, [3, 9]), (2, 0, [4, 9])]


def test_failed_calls_are_rows(spark):
    def provider(prompts):
        if "b" in prompts:
            raise TimeoutError("late")
        return [f"LABEL: minor\nJUSTIFICATION: {p}" for p in prompts]

    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "content string").coalesce(1)
    got, fresh = lb.classify(rows, spark.createDataFrame([], "key string, answer string"), provider, "m", "v1")
    assert sorted(
        (r["content"], r["label"], r["justification"]) for r in got.collect()
    ) == [("a", "minor", "a"), ("b", "error", "late"), ("c", "minor", "c")]
    again, more = lb.classify(rows, fresh, provider, "m", "v1")
    assert sorted(r["justification"] for r in again.collect()) == ["a", "c", "late"] and more.count() == 0
    chunk = spark.createDataFrame([(1, "minor", "b " * 40, 40)], "chunk_id int, label string, content string, word_count int")

    def broken(prompts):
        raise TimeoutError("late")

    good, bad, fresh = au.augment(chunk, spark.createDataFrame([], "key string, answer string"), broken, "m", "v1", 1)
    assert [
        r["framing"] for r in good.collect()
    ] == ["VERBATIM"] and [r["framing"] for r in bad.collect()] == ["WATSON"] and fresh.count() == 0
    assert cp.manifest(good, bad).first()["error_count"] == 1 and cp.manifest(good).first()["error_count"] == 0


def test_cache_files(spark, tmp_path):
    place = str(tmp_path / "cache")
    assert lb.read_cache(spark, place).count() == 0
    lb.write_cache(spark.createDataFrame([("k", "x", None), ("l", None, "late")], "key string, answer string, error string"), place)
    with open(f"{place}/broken.json", "w") as f:
        f.write('{"key": "m", "ans\n\n{"key": "n", "answer": "y"}\n')
    assert sorted(map(tuple, lb.read_cache(spark, place).collect())) == [("k", "x", None), ("l", None, "late"), ("n", "y", None)]


def test_speakers_gaps_and_steps(spark):
    t = talks(spark)
    ends = cv.outcome(t, "conv", "turn", "speaker", F.col("accused"))
    m = cv.commitments(t, "conv", "speaker", "turn", F.col("score"), F.col("accused"))
    every = {(r["conv"], r["speaker"]): r["t_public"] for r in cv.for_all_speakers(ends, m, "conv", "speaker", ["A", "B"]).collect()}
    assert len(every) == 10 and every[("c4", "B")] is None and every[("c4", "A")] == 0
    one = cv.batch_summary(cv.rollup_conversations(ends, m, "conv", "speaker", F.lit("A"))).first()
    assert [tuple(g) for g in one["gaps"]] == [(0, 1), (2, 2)] and one["n_gaps"] == 3
    b = spark.range(1).select(cp.batch_plan(F.lit(33), 2, 8, 1, 3).alias("b")).first()["b"]
    assert tuple(b) == (16, 3, 9)
    with pytest.raises(ValueError):
        cp.required_blocks(spark.createDataFrame([], "block_id long"))
    got = spark.createDataFrame([(1,), (250_000,)], "n long").select(cp.budget_shortfall(F.col("n"))).collect()
    assert [r[0] for r in got] == [239_999, 0]


def test_decision_ladder(spark):
    import itertools

    rows = spark.createDataFrame(list(itertools.product([True, False], repeat=4)), "a boolean, b boolean, c boolean, d boolean")
    for r in rows.withColumn("v", ev.decide(*map(F.col, "abcd"))).collect():
        first = "stop: perplexity" if not (
            r["a"] and r["b"]
        ) else "stop: capability" if not r["c"] else "stop: probes" if not r["d"] else "proceed"
        assert r["v"] == first


def test_cox_is_the_maximum(spark):
    """The coefficients of a plain Newton search over the partial likelihood, row by row."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (120, 2)).astype(float)
    time, event = rng.integers(1, 12, 120), rng.random(120) < 0.7
    rows = spark.createDataFrame(
        [(int(a), bool(e), float(p), float(q)) for a, e, (p, q) in zip(time, event, x)], "time int, event boolean, p double, q double"
    )
    got = stats.cox(rows, "time", "event", ["p", "q"])
    beta = np.zeros(2)
    for _ in range(30):
        g, h = np.zeros(2), np.zeros((2, 2))
        for i in np.flatnonzero(event):
            at = x[time >= time[i]]
            w = np.exp(at @ beta)
            mean = w @ at / w.sum()
            g += x[i] - mean
            h += (at * w[:, None]).T @ at / w.sum() - np.outer(mean, mean)
        beta = beta + np.linalg.solve(h, g)
    assert np.allclose([got["p"], got["q"]], beta, atol=1e-6)


def test_sources(spark, tmp_path):
    from dataclasses import dataclass

    @dataclass
    class Config:
        model: str
        steps: int

    assert io.read_config("model: m\nsteps: 3\nextra: 1", Config) == Config("m", 3)
    with pytest.raises(SystemExit, match="model, steps"):
        io.read_config("model:", Config)
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.txt").write_text(f"text {name}\n")
    books = io.read_books(spark, f"{tmp_path}/*.txt").orderBy("name").collect()
    assert [(r["name"], r["text"]) for r in books] == [(f"{n}.txt", f"text {n}\n") for n in "abc"]
    io.write_document(spark.createDataFrame([(1, None)], "n int, m string"), str(tmp_path / "doc"))
    assert spark.read.text(str(tmp_path / "doc")).first()[0] == '{"n":1,"m":null}'
    good, bad = io.quarantine(spark.createDataFrame([(1,), (2,)], "n int"), F.when(F.col("n") > 1, "large"))
    assert [r["n"] for r in good.collect()] == [1] and [tuple(r) for r in bad.collect()] == [(2, "large")]


def test_temporary_folder_only_on_one_machine(spark):
    from lexiloom.plans import lineage

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "yarn", "_jsc": spark.sparkContext._jsc})  # noqa: N815

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError):
            lineage.shared_dir(Far())
