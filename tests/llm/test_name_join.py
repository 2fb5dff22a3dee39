"""The automaton, the rule and the join against brute force."""

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexiloom.llm.levenshtein import Search, Trie, automaton, damerau
from lexiloom.llm.name_join import misspelt, name_join


def edited(s, letters, longest):
    """Every string that one edit makes of s."""
    out = {s[:i] + s[i + 1 :] for i in range(len(s))} | {s[:i] + c + s[i + 1 :] for i in range(len(s)) for c in letters}
    out |= {s[:i] + s[i + 1] + s[i] + s[i + 2 :] for i in range(len(s) - 1)}
    return out | {s[:i] + c + s[i:] for i in range(len(s) + 1) for c in letters if len(s) < longest}


def full(a, b, most):
    """The rule by its words: the fewest edits, each of the string that the one before has made."""
    seen, edge = {a}, {a}
    for steps in range(most + 1):
        if b in seen:
            return steps
        edge = set().union(*(edited(s, set(a + b), len(a) + most) for s in edge)) - seen
        seen |= edge
    return most + 1


def test_rule():
    assert damerau("ca", "abc", 3) == 2  # an exchange, and an insertion between
    words = ["".join(p) for k in range(4) for p in itertools.product("abc", repeat=k)]
    pick = random.Random(3)
    longer = ["".join(pick.choices("abcd", k=pick.randint(3, 6))) for _ in range(60)]
    for a, b in [*itertools.product(words[:30], words), *(pick.sample(longer, 2) for _ in range(150))]:
        for most in (0, 1, 2, 3):
            assert damerau(a, b, most) == full(a, b, most), (a, b, most)
    assert damerau("x" * 100_000 + "ab", "x" * 100_000 + "ba", 1) == 1


def test_automaton_over_a_trie():
    """Each pair of all words over three letters, however short, with its distance."""
    assert automaton()[0].max() < len(automaton()[0])
    words = ["".join(p) for k in range(6) for p in itertools.product("abc", repeat=k)]
    search = Search(Trie(words))
    found = {(words[i], search.trie.names[j]): int(d) for i, j, d in zip(*search.near(words, block=50), strict=True)}
    want = {}
    for a in words:
        want |= {(a, b): 1 for b in edited(a, "abc", 5)} | {(a, a): 0}
    assert found == want
    assert not len(Search(Trie([])).near(["a"])[0]) and not len(search.near([])[0])


def wrong(name, key):
    h = zlib.crc32(str(key).encode())
    if h % 2 or len(name) < 2:
        return name
    p = h % (len(name) - 1)
    return name[:p] + name[p + 1] + name[p] + name[p + 2 :]


def brute(clients, vendors, spell):
    out = {}
    for vid, name in set(vendors):
        if name:
            for cid, other in clients:
                if other and (d := damerau(spell(name, vid), other, 1)) <= 1:
                    n, first, crc = out.get((vid, d), (0, None, 0))
                    out[vid, d] = n + 1, min(x for x in (first, cid) if x is not None), crc + zlib.crc32(str(cid).encode())
    return {(*k, *v) for k, v in out.items()}


@pytest.mark.parametrize("most", [2, 1000])
def test_join(spark, most):
    """Many near names of one half, a third of the rows with one name, accents and code points of four bytes; heavy subtrees are cut when most is small."""
    pick = random.Random(most)
    base = ["Anna Bergström", "Jo", "x", "Å🙂é", "same half of a name", "same half of a game"]
    made = [*base, *(pick.choice(list(edited(b, "ab é🙂", 40)) or [b]) for b in base * 25), *("".join(pick.choices("ab", k=k % 6)) for k in range(60))]
    clients = [(i, n) for i, n in enumerate(made)] + [(1000 + i, "Anna Bergström") for i in range(100)] + [(2000, None), (2001, ""), (5, "Jo"), (5, "Jo")]
    vendors = [(i, pick.choice(made) or None) for i in range(80)] + [(7, "Jo"), (7, "Jo"), (90, None), (91, "")] + [(100 + i, "Jo") for i in range(30)]
    more = {c: F.lit(1) for c in ("n", "first", "crc", "wanted", "shard", "m", "forward", "id")}
    c = spark.createDataFrame(clients, "client_id long, name string").withColumns(more)
    v = spark.createDataFrame(vendors, "vendor_id long, name string").withColumns(more)
    got = name_join(c, v, seed=F.crc32(F.col("vendor_id").cast("string")), most=most)
    assert {tuple(r) for r in got.collect()} == brute(clients, vendors, wrong)


def test_misspelt(spark):
    rows = [(k, n) for k in range(30) for n in ("Ab", "x", "", "Åb🙂d e", None)]
    df = spark.createDataFrame(rows, "k long, n string").select("k", "n", misspelt(F.col("n"), F.crc32(F.col("k").cast("string"))).alias("w"))
    assert all(r["w"] == (None if r["n"] is None else wrong(r["n"], r["k"])) for r in df.collect())


def test_awkward(spark):
    """Very long names, empty tables and null ids."""
    long = "ab" * 20_000
    c = spark.createDataFrame([(1, long), (None, long), (None, "b")], "client_id long, name string")
    v = spark.createDataFrame([(1, long[:-1]), (None, "ab")], "vendor_id long, name string")
    crc = zlib.crc32(b"1")
    assert {tuple(r) for r in name_join(c, v).collect()} == {(1, 1, 2, 1, crc), (None, 1, 1, None, None)}
    assert name_join(c.limit(0), v).count() == name_join(c, v.limit(0)).count() == 0
