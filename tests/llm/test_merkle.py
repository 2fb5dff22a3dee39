"""The Merkle manifest against a tree built in memory, and on awkward rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lexiloom.llm.merkle import FIELDS, LOWER, UPPER, merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans(UPPER, LOWER)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, low=False):
    values = [row[f].translate(LOW) if low and f == "text" and row[f] is not None else row[f] for f in FIELDS]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + fan]) for k in range(0, len(levels[-1]), fan)])
    return levels


def expected(rows, tampered, fan):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    trees = {g: tree([leaf_of(r) for r in groups[g]], fan) for g in names}
    top = tree([trees[g][-1][0] for g in names], fan)
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            at, beside = leaf_of(r, tampered(r)), []
            for levels, j in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    low, p = j // fan * fan, j % fan
                    run = level[low : low + fan]
                    beside += run[:p] + run[p + 1 :]
                    at = digest(*run[:p], at, *run[p + 1 :])
                    j //= fan
            out.append((r["doc_id"], leaf_of(r), trees[g][-1][0], top[-1][0], digest(*beside), at, at == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def third(r):
    return r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0


@pytest.mark.parametrize("fan", [2, 8])
def test_equals_a_tree_in_memory(spark, fan):
    """A hot group, one of a single row, a null one, more groups than the fan-out, nulls, ties and repeated rows."""
    rows = [(i, f"Text {i} É", "hot", f"s{i % 3}", i) for i in range(75)]
    rows += [(100 + i, "Own" * i, f"g{i:02d}", None, None) for i in range(11) for _ in range(1 + i % 3)]
    rows += [(None, "No id", "hot", "s", 1), (7, "Again", "hot", "s", 1), (7, "Again", "hot", "s", 1), (8, None, None, "s", None)]
    rows += [(9, "", "é", "", 0), (10, "A" * 300_000, "", "s", 300_000), (12, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("g", "i", "n", "h", "run", "up", "root", "leaf", "at", "path")})
    got = merkle_manifest(df, tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0, fan=fan)
    assert found(got) == expected([r.asDict() for r in spark.createDataFrame(rows, SCHEMA).collect()], third, fan)


def test_one_row_is_its_own_root(spark):
    row = merkle_manifest(spark.createDataFrame([(1, "x", None, "s", 1)], SCHEMA)).collect()[0]
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["path"] == [] and row["verified"]
    assert row["proof_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    assert merkle_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_changed_row_is_found(spark):
    """Only rows whose text changes when lowered fail, and a manifest of a table with one more row has another root."""
    rows = [(i, "Upper" if i % 2 else "lower", "en", "s", 5) for i in range(40)]
    got = merkle_manifest(spark.createDataFrame(rows, SCHEMA), tampered=F.lit(True)).collect()
    assert {r["doc_id"] for r in got if not r["verified"]} == {i for i in range(40) if i % 2}
    more = merkle_manifest(spark.createDataFrame([*rows, (40, "lower", "de", "s", 5)], SCHEMA)).collect()
    assert {r["root"] for r in more}.isdisjoint({r["root"] for r in got}) and len({r["root"] for r in more}) == 1
