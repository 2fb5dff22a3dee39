"""Near-duplicate embeddings by Euclidean p-stable hashing.

Normalised vectors are hashed in `tables` tables by floor((a x + b) / width) for `depth` random
projections each; depth grows with the logarithm of the number of vectors so that unlike vectors
rarely meet, and tables grow with depth, so that at any number of vectors a pair at the linking cosine
meets with a chance of at least `recall` (0.99). Vectors that meet are compared by exact cosine.

Groups of copies are not expanded into pairs. Equal vectors become one, with a count. In each bucket
only the smallest id is compared with the rest; a vector within half the linking angle of such a
leader joins its ball. Any two of a ball are then within the linking angle of each other, so the ball
counts its members' links by its size. Balls that meet in a bucket are compared by their centres: the
angle between these plus or less both radii tells whether all, or none, of the members link, and only
where it tells neither are members compared.

A 256-bit sign sketch travels with each posting and drops pairs whose sketches differ by six standard
deviations more than linked ones would; the chance to lose a linked pair so is below 1e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, cos, exp, log, log1p, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.vectors import rows_by_dimension, unit
from lexiloom.llm.words import combine, mix
from lexiloom.plans.components import components
from lexiloom.plans.lineage import materialise
from lexiloom.plans.skew import join_heavy

SIGNS = 256
SLACK = 1e-9


def _units(table: DataFrame, id_: str, vector: str) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, x in rows_by_dimension(part.column(1)):
                u = unit(x)
                name = [xxhash.xxh128_intdigest(v.tobytes()) for v in u]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row)), pa.array([v.tobytes() for v in u], pa.binary()),
                        pa.array([(n >> 64) - (1 << 63) for n in name]), pa.array([(n & (1 << 64) - 1) - (1 << 63) for n in name]),
                    ],
                    names=["id", "unit", "hi", "lo"],
                )

    picked = table.where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return picked.mapInArrow(run, "id long, unit binary, hi long, lo long")


def _hashed(units: DataFrame, tables: int, depth: int, width: float, seed: int) -> DataFrame:
    """units with the bucket of each table and the sign sketch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for part in parts:
            data = [np.frombuffer(x.as_buffer(), np.float64) for x in part.column(1)]
            sizes = np.array([len(x) for x in data])
            for d in np.unique(sizes):
                rng = np.random.default_rng([seed, int(d)])
                a, b, s = made.setdefault(
                    int(d),
                    (
                        rng.standard_normal((int(d), tables * depth)), rng.uniform(0, width, tables * depth),
                        rng.standard_normal((int(d), SIGNS)),
                    ),
                )
                step = max(1, (1 << 20) // (tables * depth))
                for low in range(0, int((sizes == d).sum()), step):
                    row = np.flatnonzero(sizes == d)[low : low + step]
                    x = np.stack([data[i] for i in row])
                    cell = np.floor((x @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(row), tables, depth)
                    key = mix(
                        np.broadcast_to(np.arange(tables, dtype=np.uint64) + np.uint64(d) * np.uint64(1 << 20), (len(row), tables)).copy()
                    )
                    for k in range(depth):
                        key = combine(key, cell[:, :, k])
                    sign = np.packbits(x @ s > 0, axis=1).view(np.int64)
                    columns = [
                        part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                        pa.array(list(key.view(np.int64)), pa.list_(pa.int64())),
                        *(pa.array(np.ascontiguousarray(sign[:, k])) for k in range(4)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "unit", "keys", "s0", "s1", "s2", "s3"])

    return units.select("id", "unit").mapInArrow(run, "id long, unit binary, keys array<long>, s0 long, s1 long, s2 long, s3 long")


def _differ(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}s{k}").bitwiseXOR(F.col(f"{b}s{k}"))) for k in range(4)), F.lit(0))


def _most(angle: Column) -> Column:
    """Sketch bits in which vectors at most at this angle differ, six deviations included."""
    p = F.least(angle / pi, F.lit(0.5))
    return SIGNS * p + 6 * F.sqrt(SIGNS * F.greatest(p * (1 - p), F.lit(0.02)))


def _cosines(pairs: DataFrame, vectors: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with the column cosine of the vectors whose ids are in columns a and b."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            p, q = ([np.frombuffer(x.as_buffer(), np.float64) for x in part.column(part.schema.get_field_index(c))] for c in ("__p", "__q"))
            cosine = [float(x @ y) if len(x) == len(y) else -2.0 for x, y in zip(p, q, strict=True)]
            yield part.select(
                [n for n in part.schema.names if n not in ("__p", "__q")]
            ).append_column("cosine", pa.array(cosine, pa.float64()))

    both = pairs.join(
        vectors.select(F.col("id").alias(b), F.col("unit").alias("__q")), b
    ).join(vectors.select(F.col("id").alias(a), F.col("unit").alias("__p")), a)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema if f.name not in ("__p", "__q"))
    return both.mapInArrow(run, f"{schema}, cosine double")


def embedding_dedup(
    table: DataFrame, id_: str = "vec_id", vector: str = "embedding", least: float = 0.9, tables: int = 64, width: float = 2.0,
    seed: int = 11, recall: float = 0.99,
) -> DataFrame:
    """A row for each input row: id_, n_links, component_id, kept.

    Vectors link when their cosine, in double precision, is at least `least`. n_links: other rows
    linked directly; component_id: the smallest id that links reach, the row's own included; kept:
    the row's id is its component's. Null, empty and zero vectors, and those with null or non-finite
    components, link with nothing; vectors of different dimensions do not link. A null id keeps its
    row, links with nothing, and is not kept. Rows that repeat an id are other rows of one vector:
    each counts as a link. Other columns are left out. There are at least `tables` hash tables.
    """
    rows = table.select(F.col(id_).alias("id"))
    units = materialise(_units(table, id_, vector))
    copies = units.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    copies = materialise(copies)
    reps = join_heavy(
        units, copies, ["hi", "lo"], "copies", "inner"
    ).where("id = rep").dropDuplicates(["id", "hi", "lo"]).select("id", "unit", "copies")
    n = copies.count()
    depth = depth_for(n, width)
    tables = max(tables, tables_for(depth, least, width, recall))
    vectors = materialise(_hashed(reps, tables, depth, width, seed).join(reps.select("id", "copies"), "id"))
    theta = acos(least)
    sketch = [f"s{k}" for k in range(4)]

    posts = vectors.select("id", F.explode("keys").alias("key"), *sketch)
    heads = posts.groupBy("key").agg(F.min(F.struct("id", *sketch)).alias("head"), F.count("*").alias("m")).where("m > 1")
    led = join_heavy(posts, materialise(heads), ["key"], "m", "inner").select(
        "id", *sketch, F.col("head.id").alias("lead"), *[F.col(f"head.{s}").alias(f"lead_{s}") for s in sketch]
    )
    led = led.where((F.col("id") != F.col("lead")) & (_differ("", "lead_") <= _most(F.lit(theta / 2)))).select("lead", "id").distinct()
    inside = _cosines(led, vectors, "lead", "id").where(F.col("cosine") >= cos(theta / 2) + SLACK)
    joined = inside.groupBy("id").agg(F.min(F.struct("lead", "cosine")).alias("ball")).select(
        "id", F.col("ball.lead").alias("ball"), F.acos(F.least("ball.cosine", F.lit(1.0))).alias("angle")
    )
    members = materialise(
        vectors.join(joined, "id", "left").withColumns({"ball": F.coalesce("ball", "id"), "angle": F.coalesce("angle", F.lit(0.0))})
    )
    balls = members.groupBy("ball").agg(F.sum("copies").alias("size"), F.count("*").alias("n"), F.max("angle").alias("radius"))
    balls = materialise(balls.join(vectors.select(F.col("id").alias("ball"), *sketch), "ball"))

    cells = members.select("ball", F.explode("keys").alias("key")).distinct().join(balls.drop("size", "n"), "ball")
    cells = materialise(cells)
    shared = cells.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    cells = materialise(cells.join(shared, "key", "left_semi"))
    one, two = (cells.select("key", *[F.col(c).alias(f"{p}{c}") for c in ("ball", "radius", *sketch)]) for p in ("a_", "b_"))
    met = one.join(two, "key").where(
        (F.col("a_ball") < F.col("b_ball")) & (_differ("a_", "b_") <= _most(theta + F.col("a_radius") + F.col("b_radius")))
    ).select("a_ball", "b_ball", "a_radius", "b_radius").distinct()
    known = balls.select("ball", "size", "n")
    pairs = _cosines(met, vectors, "a_ball", "b_ball")
    gap, both = F.acos(F.greatest(F.least("cosine", F.lit(1.0)), F.lit(-1.0))), F.col("a_radius") + F.col("b_radius")
    state = F.when(
        (both == 0), F.when(F.col("cosine") >= least, "all").otherwise("none")
    ).when(gap + both <= theta - SLACK, "all").when(gap - both > theta + SLACK, "none").otherwise("some")
    pairs = materialise(pairs.withColumn("state", state).where("state <> 'none'"))
    whole = pairs.where("state = 'all'").select("a_ball", "b_ball")
    some = pairs.where("state = 'some'").select("a_ball", "b_ball")
    each = some.join(
        members.select(F.col("ball").alias("a_ball"), F.col("id").alias("a"), F.col("copies").alias("a_copies")), "a_ball"
    ).join(members.select(F.col("ball").alias("b_ball"), F.col("id").alias("b"), F.col("copies").alias("b_copies")), "b_ball")
    each = materialise(_cosines(each.select("a", "b", "a_copies", "b_copies"), vectors, "a", "b").where(F.col("cosine") >= least))

    across = whole.join(known.select(F.col("ball").alias("b_ball"), "size"), "b_ball").select(F.col("a_ball").alias("ball"), "size").unionByName(
        whole.join(known.select(F.col("ball").alias("a_ball"), "size"), "a_ball").select(F.col("b_ball").alias("ball"), "size")
    )
    across = across.groupBy("ball").agg(F.sum("size").alias("across"))
    single = each.select(F.col("a").alias("id"), F.col("b_copies").alias("k")).unionByName(
        each.select(F.col("b").alias("id"), F.col("a_copies").alias("k"))
    ).groupBy("id").agg(F.sum("k").alias("single"))
    zero = F.lit(0)
    counted = members.select("id", "ball").join(known, "ball").join(across, "ball", "left").join(single, "id", "left")
    counted = counted.select(
        F.col("id").alias("rep"), (F.col("size") - 1 + F.coalesce("across", zero) + F.coalesce("single", zero)).alias("n_links")
    )
    edges = members.where("id <> ball").select(
        F.col("id").alias("a"), F.col("ball").alias("b")
    ).unionByName(whole.toDF("a", "b")).unionByName(each.select("a", "b"))
    found = components(edges).select(F.col("node").alias("rep"), "component")

    named = join_heavy(units.select("id", "hi", "lo"), copies, ["hi", "lo"], "copies", "inner").select("id", "rep")
    named = named.join(counted, "rep", "left").join(found, "rep", "left").groupBy("id").agg(
        F.max("n_links").alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component")
    )
    out = rows.join(named, "id", "left")
    component = F.coalesce("component", F.col("id").cast("long"))
    return out.select(
        F.col("id").alias(id_), F.coalesce("n_links", zero).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _meet(cosine: float, width: float) -> float:
    """The chance that one projection puts two unit vectors of this cosine into one cell."""
    r = width / max(sqrt(2 - 2 * cosine), 1e-9)
    return 1 - 2 * _upper(-r) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-(r**2) / 2))


def depth_for(n: int, width: float) -> int:
    """Projections of a table, with which a vector meets about half an unlike one of n."""
    return max(8, ceil(log(max(n, 2) * 2) / -log(_meet(0, width))))


def tables_for(depth: int, least: float, width: float, recall: float) -> int:
    """Tables in at least one of which a pair at cosine `least` meets with a chance of `recall`."""
    return ceil(log(1 - recall) / log1p(-min(_meet(least, width) ** depth, 1 - 1e-12)))


def _upper(x: float) -> float:
    from math import erf

    return 0.5 * (1 + erf(x / sqrt(2)))
