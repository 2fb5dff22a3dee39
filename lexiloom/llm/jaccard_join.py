"""N-gram Jaccard join: a size-aware join of shingle sets, subsets for small sets and inverted lists for large ones.

Two sets of sizes a and b link when they share at least need(a, b) = ceil(t (a + b) / (100 + t))
shingles, t the threshold in percent. Equal sets are one set from the start.

* Small sets (at most `boundary` shingles) enumerate their subsets of the fixed size need(a, b) for
  each size b that a small partner can have. Sets that meet in a subset of c shingles share c; the
  smallest set of such a group links to every member that any other member could link to, so a star
  replaces the pairs and nothing needs checking.
* Large sets, and small ones that a large one could match, post a prefix of their shingles, rarest
  first, to inverted lists. Two sets that link meet in a list at positions which leave room for
  need(a, b) shared shingles; other meetings are dropped unchecked.
* The boundary minimises the estimated cost: subsets to emit below it, postings times the mean list
  length above it, from the counted sizes of all sets. It is chosen among those from which on two different
  small sets can link at all (seven at 85 percent, five at 80).

Within a list the set whose match comes first leads: first only pairs with leaders are checked, and
what links becomes one component. Then every pair of a list that is still in different components is
checked unless the positions rule it out. So no list is expanded into pairs, and no link between
components can be missed. The rarity order comes from a counting sketch over all texts; it is any
fixed order as far as results go, so its collisions cost time only.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.bitsets import build, segment_bits_for
from lexiloom.llm.words import Words, batches, mix, release
from lexiloom.plans.components import components
from lexiloom.plans.lineage import materialise, tidy
from lexiloom.plans.skew import join_heavy

SKETCH = 1 << 22
PIECES = 64
LARGEST_BOUNDARY = 24
#: Rows of a list that one task takes before the list is dealt over several.
LIST_ROWS = 1024
FILTER_BITS = 1 << 29


def need(a: int, b: int, percent: int) -> int:
    return -(-percent * (a + b) // (100 + percent))


def partners(n: int, percent: int) -> range:
    """Sizes that a set of n shingles can link with."""
    return range(max(1, -(-percent * n // 100)), 100 * n // percent + 1)


def prefix_length(n: int, percent: int) -> int:
    return n - need(n, partners(n, percent)[0], percent) + 1


def subset_sizes(n: int, percent: int, boundary: int) -> list[int]:
    return sorted({need(n, b, percent) for b in partners(n, percent) if b <= boundary and not (b == n and need(n, b, percent) == n)})


def posts(n: int, percent: int, boundary: int) -> bool:
    """Whether a set of n shingles can link with a large one."""
    return n > boundary or partners(n, percent)[-1] > boundary


def choose_boundary(sizes: dict[int, int], percent: int, list_length: float) -> int:
    """The boundary of least estimated cost at which small sets have subsets to enumerate; sizes: how many sets have each size."""

    def cost(boundary: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            if n <= boundary:
                total += count * sum(comb(n, c) for c in subset_sizes(n, percent, boundary))
            if posts(n, percent, boundary):
                total += count * prefix_length(n, percent) * (1 + list_length)
        return total

    able = [b for b in range(LARGEST_BOUNDARY + 1) if any(subset_sizes(n, percent, b) for n in range(1, b + 1))]
    return min(able or [0], key=lambda b: (cost(b), b))


def distinct_rows(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes sorted and without repeats."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[fresh], r[fresh]
    return h, np.searchsorted(r, np.arange(len(at)))


def _sketch(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, dict[int, int], float]:
    """Levels of rarity by hash, the number of texts of each small size, and the mean list length."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, sizes = Words(), np.zeros(SKETCH, np.uint32), np.zeros(LARGEST_BOUNDARY + 2, np.int64)
        for whole in parts:
            for part in batches(whole, 1 << 22):
                h, at = distinct_rows(*words.shingles(part.column(0), width))
                seen += np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
                sizes += np.bincount(np.minimum(np.diff(at), LARGEST_BOUNDARY + 1), minlength=LARGEST_BOUNDARY + 2)
        if sizes.sum():
            step = SKETCH // PIECES
            rows = [(k, x.tobytes()) for k in range(PIECES) if (x := seen[k * step : (k + 1) * step]).any()] + [(-1, sizes.tobytes())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["piece", "counts"]
            )

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        piece = int(frame["piece"].iloc[0])
        total = sum(np.frombuffer(x, np.int64 if piece < 0 else np.uint32).astype(np.int64) for x in frame["counts"])
        if piece < 0:
            return pd.DataFrame({"piece": [piece], "levels": [total.tobytes()], "used": [0], "total": [0]})
        level = np.where(total > 0, np.frexp(np.maximum(total, 1).astype(float))[1], 0).astype(np.uint8)
        return pd.DataFrame({"piece": [piece], "levels": [level.tobytes()], "used": [int((total > 0).sum())], "total": [int(total.sum())]})

    # Counters meet in two steps, so no task takes one from every reading task.
    tree = docs.select(
        F.col(text).cast("string").alias("t")
    ).mapInArrow(count, "piece int, counts binary").withColumn("half", F.spark_partition_id() % 16)
    half = tree.groupBy("piece", "half").applyInPandas(_add_half, "piece int, counts binary")
    got = half.groupBy("piece").applyInPandas(add, "piece int, levels binary, used long, total long").collect()
    levels, sizes, step = np.zeros(SKETCH, np.uint8), {}, SKETCH // PIECES
    for r in got:
        if r["piece"] < 0:
            sizes = {n: int(c) for n, c in enumerate(np.frombuffer(r["levels"], np.int64)) if n and c}
        else:
            levels[r["piece"] * step : (r["piece"] + 1) * step] = np.frombuffer(r["levels"], np.uint8)
    return levels, sizes, sum(r["total"] for r in got) / max(1, sum(r["used"] for r in got))


def _add_half(frame: pd.DataFrame) -> pd.DataFrame:
    kind = np.int64 if frame["piece"].iloc[0] < 0 else np.uint32
    total = sum(np.frombuffer(x, kind).astype(np.int64) for x in frame["counts"]).astype(kind)
    return pd.DataFrame({"piece": [frame["piece"].iloc[0]], "counts": [total.tobytes()]})


def _keys(docs: DataFrame, id_: str, text: str, width: int, percent: int, boundary: int, levels) -> DataFrame:
    """A row for each text: its set's size and 128-bit name, the prefix it posts, the subsets it enumerates with their sizes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, level = Words(), levels.value
        for whole in parts:
            for part in batches(whole, 1 << 22):
                h, at = distinct_rows(*words.shingles(part.column(1), width))
                rank = level[(h & np.uint64(SKETCH - 1)).astype(np.int64)]
                out: dict[str, list] = {k: [] for k in ("n", "hi", "lo", "prefix", "subset", "subset_size")}
                for low, high in itertools.pairwise(at.tolist()):
                    s, n = h[low:high], high - low
                    name = xxhash.xxh128_intdigest(s.tobytes())
                    prefix, subset, of = np.zeros(0, np.uint64), [], []
                    if n and posts(n, percent, boundary):
                        prefix = s[np.lexsort((s, rank[low:high]))[: prefix_length(n, percent)]]
                    if 0 < n <= boundary:
                        subset, of = subsets(s, subset_sizes(n, percent, boundary))
                    for k, v in (
                        ("n", n), ("hi", (name >> 64) - (1 << 63)), ("lo", (name & (1 << 64) - 1) - (1 << 63)),
                        ("prefix", prefix.view(np.int64)), ("subset", subset), ("subset_size", of),
                    ):
                        out[k].append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True))], names=["id", *out]
                )

    picked = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, n long, hi long, lo long, prefix array<long>, subset array<long>, subset_size array<int>")


def subsets(s: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, list[int]]:
    """Names of all subsets of the sizes given."""
    keys, of = [], []
    with np.errstate(over="ignore"):
        each = mix(s)
        total = each.sum(dtype=np.uint64)
        for c in sizes:
            gone = list(itertools.combinations(range(len(s)), len(s) - c))
            gone = np.array(gone, np.int64).reshape(len(gone), len(s) - c)
            keys.append(mix((total - each[gone].sum(axis=1, dtype=np.uint64)) ^ (np.uint64(c) << np.uint64(56))))
            of += [c] * len(gone)
    return (np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)), of


def _needed(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent)).cast("long")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and places in a list leave room for a link; a and b: prefixes of the columns n and pos."""
    n, m, i, j = F.col(f"{a}n"), F.col(f"{b}n"), F.col(f"{a}pos"), F.col(f"{b}pos")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (1 + F.least(n - 1 - i, m - 1 - j) >= _needed(n, m, percent))


def _dealt(rows: DataFrame, heads: DataFrame, keys: list[str], more: DataFrame | None = None) -> DataFrame:
    """rows (keys, id) joined with heads, one row (keys, m) for each list; salts says over how many tasks a list is dealt.

    A long list's head is repeated for each of its salts. The lists that are dealt are told to the reading tasks: their
    length is above total / (16 * partitions), so there are at most 16 for each partition. more: what is joined instead
    of the heads, maybe several rows for each.
    """
    total = heads.agg(F.sum("m")).first()[0] or 0
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(LIST_ROWS, -(-total // (16 * parts)))
    salts = F.ceil(F.col("m") / most).cast("int")
    long = F.broadcast(heads.where(F.col("m") > most).select(*keys, salts.alias("salts")))
    told = rows.join(long, keys, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    told = told.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    many = (heads if more is None else more).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return told.join(many, [*keys, "salt"]).drop("salt", "m")


def _verified(pairs: DataFrame, docs: DataFrame, id_: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs (x, y) of texts whose whole sets link. Only texts in pairs are read into sets."""
    spark = docs.sparkSession
    ids = materialise(pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct())
    count = ids.count()
    if not count:
        return pairs.select("x", "y")
    hashed = ids.select(F.xxhash64("id").alias("h"))
    wanted = spark.sparkContext.broadcast(build(hashed, "h", segment_bits_for(count, 4, FILTER_BITS), 4))

    def pick(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = Words(), wanted.value
        for whole in parts:
            part = whole.take(pa.array(held.has(whole.column(2).to_numpy().view(np.uint64))))
            for piece in batches(part):
                h, at = distinct_rows(*words.shingles(piece.column(1), width))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([h[a:b].tobytes() for a, b in itertools.pairwise(at.tolist())], pa.binary())],
                    names=["id", "shingles"],
                )

    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            for a, b in zip(part.column(2), part.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                if len(p) > len(q):
                    p, q = q, p
                shared = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(p) else 0
                keep.append(shared > 0 and 100 * shared >= percent * (len(p) + len(q) - shared))
            yield part.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    source = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    sets = source.withColumn("h", F.xxhash64("id")).mapInArrow(pick, "id long, shingles binary")
    sets = materialise(sets.join(ids, "id", "left_semi").dropDuplicates(["id", "shingles"]))
    # a leader of many pairs meets them where they are; leaders grow with the documents, so they are not broadcast
    heads = materialise(pairs.groupBy("x").agg(F.count("*").alias("m")))
    own = pairs.join(sets.select(F.col("id").alias("y"), F.col("shingles").alias("q")), "y").select("x", F.col("y").alias("id"), "q")
    leaders = heads.hint("merge").join(sets.select(F.col("id").alias("x"), F.col("shingles").alias("p")), "x")
    both = _dealt(own, heads, ["x"], leaders).select("x", F.col("id").alias("y"), "p", "q")
    out = materialise(both.select("x", "y", "p", "q").mapInArrow(check, "x long, y long").distinct())
    wanted.unpersist()
    release()
    return out


def jaccard_join(docs: DataFrame, id_: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """A row for each input row: id_, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their sets of shingles of
    `width` words; component_id is the smallest id that links reach, the row's own included. Fewer
    words than `width` are one shingle. Null, empty and white texts have no shingles and link with
    nothing. Rows that repeat an id are one document that has the links of each of its texts. A null
    id keeps its row, links with nothing and has a null component_id. Other columns are left out.
    """
    spark = docs.sparkSession
    levels, sizes, list_length = _sketch(docs, text, width)
    boundary = choose_boundary(sizes, percent, list_length)
    held = spark.sparkContext.broadcast(levels)
    rows = materialise(_keys(docs, id_, text, width, percent, boundary, held))
    held.unpersist()
    release()
    slim = rows.select("id", "n", "hi", "lo")
    full = slim.where("id is not null and n > 0")
    copies = materialise(full.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"))
    gone = materialise(join_heavy(full, copies, ["hi", "lo"], "copies", "inner").where("id <> rep").select("id", "hi", "lo"))
    # what goes grows with the documents, so at no size is it broadcast
    sets = rows.where(
        "id is not null and n > 0 and (size(prefix) > 0 or size(subset) > 0)"
    ).join(gone.hint("merge"), ["id", "hi", "lo"], "left_anti").select("id", "n", "prefix", "subset", "subset_size")

    group = sets.where("size(subset) > 0").select("id", "n", F.explode(F.arrays_zip("subset", "subset_size")).alias("s")).select(
        "id", "n", F.col("s.subset").alias("k"), F.col("s.subset_size").alias("c")
    )
    star = materialise(group.groupBy("k", "c").agg(F.min(F.struct("n", "id")).alias("head"), F.count("*").alias("m")).where("m > 1"))
    small = _dealt(group, star, ["k", "c"]).where(
        (F.col("id") != F.col("head.id")) & (F.col("c") >= _needed(F.col("n"), F.col("head.n"), percent))
    ).select(F.col("head.id").alias("x"), F.col("id").alias("y")).distinct()

    lists = sets.where("size(prefix) > 0").select("id", "n", F.posexplode("prefix").alias("pos", "k"))
    heads = materialise(lists.groupBy("k").agg(F.min(F.struct("pos", "n", "id")).alias("head"), F.count("*").alias("m")).where("m > 1"))
    posted = materialise(
        _dealt(lists, heads, ["k"]).select(
            "k", "salts", "id", "n", "pos", F.col("head.id").alias("lead"), F.col("head.n").alias("lead_n"),
            F.col("head.pos").alias("lead_pos"),
        )
    )
    led = posted.where(
        (F.col("id") != F.col("lead")) & _may_link("", "lead_", percent)
    ).select(F.col("lead").alias("x"), F.col("id").alias("y")).distinct()
    first = _verified(materialise(led), docs, id_, text, width, percent).unionByName(small)
    first = materialise(first)
    tidy(spark)

    known = components(first, "x", "y")
    named = posted.join(known.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left").join(
        known.select(F.col("node").alias("lead"), F.col("component").alias("lead_c")), "lead", "left"
    )
    named = materialise(
        named.withColumns(
            {"c": F.coalesce("c", "id"), "lead_c": F.coalesce("lead_c", "lead")}
        ).select("k", "salts", "id", "n", "pos", "c", "lead", "lead_c")
    )
    # an astray set meets its list where the list's rows are: over all salts of a long one
    astray = named.where("c <> lead_c").select(
        "k", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *[F.col(x).alias(f"a_{x}") for x in ("id", "n", "pos", "c")]
    )
    other = named.select(
        "k", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"),
        *[F.col(x).alias(f"b_{x}") for x in ("id", "n", "pos", "c", "lead", "lead_c")],
    )
    left = astray.join(other, ["k", "salt"]).where(
        (F.col("a_c") != F.col("b_c")) & (F.col("b_id") != F.col("b_lead")) & (
            (F.col("b_c") == F.col("b_lead_c")) | (F.col("a_id") < F.col("b_id"))
        ) & _may_link("a_", "b_", percent)
    )
    left = materialise(left.select(F.least("a_id", "b_id").alias("x"), F.greatest("a_id", "b_id").alias("y")).distinct())
    tidy(spark)
    second = _verified(left, docs, id_, text, width, percent)

    found = components(first.unionByName(second), "x", "y").select(F.col("node").alias("rep"), "component")
    # rows without shingles have nothing to look for
    some, none = slim.where("id is not null and n > 0"), slim.where("id is null or n = 0")
    named = join_heavy(some, copies, ["hi", "lo"], "copies").withColumn("rep", F.coalesce("rep", "id"))
    # an id with several texts may stand for several sets
    times = copies.groupBy("rep").agg(F.sum("copies").alias("copies"))
    heavy = found.join(times, "rep", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    out = join_heavy(
        materialise(named.select("id", "n", "rep")), materialise(heavy), ["rep"], "copies"
    ).select("id", "n", "rep", "component")
    out = out.unionByName(none.select("id", "n", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("component")))
    return out.select(F.col("id").alias(id_), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))
