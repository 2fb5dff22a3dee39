import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import text as tx


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], names).select(column(*map(F.col, names)).alias("r")).first()["r"]


def test_book_markers(spark):
    inside = lambda book: one(spark, lambda c: tx.between_markers(F.split(c, "\n")), book)
    start, end = "***  start of this project gutenberg ebook OF TIDES ***", "*** END OF THE PROJECT GUTENBERG EBOOK OF TIDES ***"
    assert inside("\n".join(["printed by hand", start, "low water", "", "high water", end, "errata"])) == "low water\n\nhigh water"
    assert inside("\n".join([start, end])) == ""
    assert inside("no marks at all") is None and inside(f"{start}\nno end") is None
    assert inside(f"{end}\n{start}\na") is None
    assert inside(f"{end}\n{start}\na\n{end}\nb\n{end}") == "a"


def normalised(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    once = rows.withColumn("r", tx.normalize_whitespace(F.col("t")))
    return once.select(
        "i", "t", "r", tx.normalize_whitespace(F.col("r")).alias("again"), tx.word_count(F.col("t")).alias("w"),
        tx.strip(F.col("t")).alias("s"),
    ).collect()


def test_white_space(spark):
    assert [r["r"] for r in normalised(spark, ["", "x", "\r\na \t\r\rb\x0b", "k\n\n\n\n\n\nl"])] == ["\n", "x\n", "a\n\nb\n", "k\n\n\nl\n"]


def test_white_space_rules(spark):
    """Words and their lines stay in order; lines end without space, at most two empty ones follow each other, and doing it again changes nothing."""
    import random

    pick = random.Random(1)
    for r in normalised(
        spark, ["".join(pick.choice("ab \t\n\n\r\x0b\x85 \xa0\x1c\u2003") for _ in range(pick.randint(0, 30))) for _ in range(1500)]
    ):
        out = r["r"]
        assert r["again"] == out and out.endswith("\n") and "\n\n\n\n" not in out, repr(r["t"])
        lines = out[:-1].split("\n")
        assert all(x == x.rstrip() for x in lines) and (out == "\n" or lines[0] and lines[-1])
        assert [x for x in lines if x] == [x.rstrip() for x in r["t"].splitlines() if x.strip()]
        assert r["w"] == len(r["t"].split()) and r["s"] == r["t"].strip()


def test_label_parse(spark):
    both = lambda answer: (one(spark, tx.parse_label, answer), one(spark, tx.parse_reason, answer))
    assert both("Label:NONE\njustification :\t it only rains. \nmore") == ("none", "it only rains.")
    assert both("I would say LABEL : Central, surely") == ("central", "I would say LABEL : Central, surely")
    assert both("LABEL: vivid") == ("parse_error", "LABEL: vivid")
    assert both("") == ("parse_error", "")


def test_cache_keys(spark):
    key = lambda *p: one(spark, lambda *c: tx.cache_key(*c), *p)
    assert key("m", "v1", "x") == key("m", "v1", "x") != key("m", "v2", "x")


def test_markers(spark):
    text = "Therefore it is clear he must be left. Perhaps."
    assert one(spark, lambda c: tx.marker_count(c, tx.DEDUCTION), text) == 3
    assert one(spark, lambda c: tx.marker_count(c, tx.HEDGING), text) == 1
    assert one(
        spark, lambda c: tx.marker_density(tx.marker_count(c, tx.DEDUCTION), tx.marker_count(c, tx.HEDGING), tx.word_count(c)), text
    ) == 222.2222
    assert one(spark, lambda c: tx.marker_count(c, tx.HEDGING), "I’m not sure") == 0
    assert one(spark, lambda c: tx.marker_count(c, tx.HEDGING), "I'm not sure") == 1
    assert one(
        spark, lambda c: tx.marker_density(tx.marker_count(c, tx.DEDUCTION), tx.marker_count(c, tx.HEDGING), tx.word_count(c)), ""
    ) == 0.0


def test_turns(spark):
    turn = lambda raw: one(spark, tx.parse_turn, raw)
    r = turn('```json\n{"reply":"hi","suspicion_score":1.7}\n```')
    assert (r.reply, r.suspicion_score, r.cues, r.trap, r.public_accusation, r.parsed) == ("hi", 1.0, [], "none", False, True)
    r = turn('noise {"reply":"x"} tail')
    assert (r.reply, r.suspicion_score, r.parsed) == ("x", 0.5, True)
    r = turn('{"reply": "x", "suspicion_score": 0.4, ')
    assert (r.reply, r.suspicion_score, r.cues, r.parsed) == ("x", 0.4, [], False)
    r = turn("plain text")
    assert (r.reply, r.suspicion_score, r.trap, r.parsed) == ("plain text", 0.5, "none", False)


def test_empty_reply_is_found(spark):
    turn = lambda raw: one(spark, tx.parse_turn, raw)
    assert turn('{"reply": "", "suspicion_score": 0.4, ').reply == "" and not turn('{"reply": "", "x').parsed
    assert turn('  {"answer": 1, ').reply == '{"answer": 1,'
    assert turn('{"reply": null}').reply == "" and turn('{"reply": null}').parsed
    assert turn(
        'a {"reply": "in", "cues": ["c"], "trap_strategy": {"plan": "p", "type": "numeric"}, "public_accusation": true} b'
    ).trap == "numeric"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["a", "", "b c", "\n"]), max_size=6))
def test_paragraphs_split_at_empty_lines(spark, pieces):
    text = "\n\n".join(pieces)
    got = one(spark, tx.paragraphs, text)
    assert got == re.split(r"\n{2,}", text) and not any("\n\n" in x for x in got)


def test_markers_in_one_pass(spark):
    """Ten thousand random texts of markers, parts of them and what stands between: as many as one pattern for each marker finds."""
    import random

    from pyspark.sql import functions as F

    pick, own = random.Random(9), [r"\bclear\b", r"\bit\b", r"\bbe sure to be\b", r"\b\d+\b", r"\bso (on|far)\b", r"\bnot\b", r"\bnot\b"]
    edged = [rf"(?<![\p{{L}}\p{{N}}_]){w}(?![\p{{L}}\p{{N}}_])" for w in ("it", "so", "thus", "must be", "it is")]
    lists = [tx.DEDUCTION, tx.HEDGING, own, tx.DEDUCTION + tx.HEDGING + own, edged, edged + own]
    assert len(tx.marker_passes(tuple(edged))) == 2  # `it is` can match where `it` does
    assert [len(tx.marker_passes(tuple(x))) for x in lists[:2]] == [1, 1]
    parts = [x for p in lists[3] for x in tx._literals(p)]
    parts += [w for x in parts for w in x.split()] + ["Clearly", "unclear", "I", "it is", "42", "_thus", "thus_", "ébe", "İ", "can’t", "so", "to be sure to be"]
    rows = [("".join(pick.choice(parts).upper() if pick.random() < 0.1 else pick.choice(parts) + pick.choice(["", " ", " ", " ", "  ", "\n", "-", ".", "'", "é"]) for _ in range(pick.randint(0, 14))),) for _ in range(10_000)]
    low = F.lower("t")
    each = [(tx.marker_count(F.col("t"), x), sum((F.regexp_count(low, F.lit(f"(?i){p}")) for p in x), F.lit(0))) for x in lists]
    got = spark.createDataFrame(rows, "t string").select(*[c.alias(f"{k}{i}") for i, pair in enumerate(each) for k, c in zip("ab", pair)])
    sums = got.agg(*[F.sum(f"b{i}").alias(f"s{i}") for i in range(6)], *[F.count_if(F.col(f"a{i}") != F.col(f"b{i}")).alias(f"d{i}") for i in range(6)]).first()
    assert all(sums[f"d{i}"] == 0 and sums[f"s{i}"] > 1000 for i in range(6))
