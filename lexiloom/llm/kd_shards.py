"""K-d tree sharding: split at weighted medians along the widest metadata dimension.

A node that stands for k shards is cut so that its sides weigh as their shares of the shards, k // 2
and the rest, along the dimension in which its rows spread widest (as a part of that dimension's
spread over the table); leaves so reach total bytes / shards. A dimension's place is 16 bits of the
value, then 24 of the text's hash, then 23 of the row's, so ties are cut too. Equal texts take the
least of their group's categories and so lie together; a cut goes through such a group only if it weighs
more than `whole` of a shard and than any one row, and else beside it.

The medians are distributed: a pass counts bytes by the next twelve bits of the place within the
node's open interval, and passes go on until the bin that holds the median is light. The driver sees at
most 4096 bins a node and dimension. The tree is a CASE expression, so shards need no join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.plans.lineage import materialise
from lexiloom.plans.numbering import number_within
from lexiloom.plans.skew import join_heavy

BITS, TEXT, STEP = 63, 23, 12


@dataclass
class Node:
    """A box of the tree: which shards it stands for and, once it is cut, where."""

    first: int
    shards: int
    name: int
    low: int = 0
    shift: int = BITS
    before: int = 0
    total: int = 0
    dim: int = -1
    cut: int | None = None
    sides: list[Node] = field(default_factory=list)


def _walk(node: Node, value) -> Column:
    if node.cut is None:
        return value(node)
    return F.when(F.col(f"k{node.dim}") < F.lit(node.cut), _walk(node.sides[0], value)).otherwise(_walk(node.sides[1], value))


def _places(values: list[Column], text: Column, row: Column) -> list[Column]:
    tie = F.shiftleft(F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(1 << 24)), 23) + F.pmod(row, F.lit(1 << 23))
    return [(F.shiftleft(v.cast("long"), 47) + tie).alias(f"k{i}") for i, v in enumerate(values)]


def kd_tree(rows: DataFrame, dims: int, shards: int, tolerance: float = 0.001, whole: float = 0.01) -> Node:
    """The tree over rows (size, k0, k1, ...)."""
    total, most = (x or 0 for x in rows.agg(F.sum("size"), F.max("size")).first())
    root, names = Node(0, shards, 0), 1
    level = [root] if shards > 1 and total else []
    spread: list[int] = []
    while level:
        node_of = _walk(root, lambda n: F.lit(n.name if n.shards > 1 else -1))
        split = F.posexplode(F.array(*[F.shiftright(F.col(f"k{d}"), BITS - STEP) for d in range(dims)]))
        seen = rows.select(
            node_of.alias("node"), "size", split.alias("dim", "bin")
        ).where("node >= 0").groupBy("node", "dim", "bin").agg(F.sum("size").alias("w")).collect()
        bins: dict[tuple[int, int], dict[int, int]] = {}
        for r in seen:
            bins.setdefault((r["node"], r["dim"]), {})[r["bin"]] = r["w"]
        widths = {key: max(b) - min(b) for key, b in bins.items()}
        spread = spread or [max(1, widths.get((0, d), 1)) for d in range(dims)]
        open_ = []
        for n in level:
            held = [(n.name, d) for d in range(dims) if (n.name, d) in bins]
            if held:
                n.dim = max(range(dims), key=lambda d: (widths[n.name, d] / spread[d], -d))
                _narrow(n, bins[n.name, n.dim], tolerance, whole, most, open_)
            else:
                n.dim, n.cut = 0, 0
        while open_:
            # next bits of the rows that are in the interval still open
            bin_of = F.lit(None).cast("long")
            for n in open_:
                inside = (node_of == n.name) & (F.shiftright(F.col(f"k{n.dim}"), n.shift) == F.lit(n.low >> n.shift))
                low = F.shiftright(F.col(f"k{n.dim}"), _next(n.shift)).bitwiseAND(F.lit((1 << (n.shift - _next(n.shift))) - 1))
                bin_of = F.when(inside, low).otherwise(bin_of)
            got: dict[int, dict[int, int]] = {}
            for r in rows.select(
                node_of.alias("node"), bin_of.alias("bin"), "size"
            ).where("bin is not null").groupBy("node", "bin").agg(F.sum("size").alias("w")).collect():
                got.setdefault(r["node"], {})[r["bin"]] = r["w"]
            still: list[Node] = []
            for n in open_:
                _narrow(n, got[n.name], tolerance, whole, most, still)
            open_ = still
        after = []
        for n in level:
            left = n.shards // 2
            n.sides = [Node(n.first, left, names), Node(n.first + left, n.shards - left, names + 1)]
            names += 2
            after += [s for s in n.sides if s.shards > 1]
        level = after
    return root


def _next(shift: int) -> int:
    """How many bits stay open after a pass; passes end where the text's hash does."""
    return max(TEXT if shift > TEXT else 0, shift - STEP)


def _narrow(n: Node, bins: dict[int, int], tolerance: float, whole: float, most: int, open_: list[Node]) -> None:
    """One pass's counts: cut the node, or go down into the bin that holds its median."""
    n.total = n.total or sum(bins.values())
    goal = n.total * (n.shards // 2) / n.shards
    shift, done = _next(n.shift), n.before
    for b in sorted(bins):
        if done + bins[b] >= goal:
            n.low, n.before = n.low + (b << shift), done
            leaf = n.total / n.shards
            if shift == 0 or bins[b] <= (max(whole * leaf, most) if shift == TEXT else tolerance * leaf if shift > TEXT else 0):
                after = done + bins[b] - goal < goal - done
                n.cut = n.low + ((1 << shift) if after else 0)
            else:
                n.shift = shift
                open_.append(n)
            return
        done += bins[b]


def kd_shards(
    docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_: str = "doc_id", text: str = "text",
    categories: tuple[str, ...] = ("lang", "source"), keep: tuple[str, ...] = (),
) -> DataFrame:
    """A row for each row: id_, size, text_crc32, law, shard, slot, grown_shard, and the columns of keep.

    size: UTF-8 bytes of the text (null: none) plus 16. Shards weigh the same to within a hundredth of
    a shard and a document or two (law `bytes`); lighter groups of equal texts stay in one shard. The dimensions are the size, on a log scale, and
    the categories, by hash; nulls are a value. slot: gapless from 0 in a shard. grown_shard is null under this law.
    shards, or as many as target_bytes needs. Fewer rows than shards leave shards empty; an empty table gives no rows.
    """
    body = F.col(text).cast("string")
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 16
    numbered = docs.select(
        F.col(id_).alias("id"), size.alias("size"), F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(body, F.lit(""))).alias("text_hash"),
        *[F.xxhash64(F.col(c).cast("string")).alias(f"c{i}") for i, c in enumerate(categories)], *keep,
    )
    numbered = materialise(numbered.withColumn("row", F.monotonically_increasing_id()))
    named = [f"c{i}" for i in range(len(categories))]
    copies = materialise(
        numbered.groupBy("text_hash").agg(F.count("*").alias("copies"), *[F.min(c).alias(f"least_{c}") for c in named]).where("copies > 1")
    )
    numbered = join_heavy(numbered, copies, ["text_hash"], "copies").withColumns({c: F.coalesce(f"least_{c}", c) for c in named})
    values = [
        F.least(F.floor(F.log2(F.col("size")) * 1024), F.lit(65535)),
        *[F.pmod(F.col(f"c{i}"), F.lit(1 << 16)) for i in range(len(categories))],
    ]
    row_hash = F.xxhash64("id", "row")
    rows = materialise(
        numbered.select("id", "row", "size", "text_crc32", *_places(values, F.col("text_hash").cast("string"), row_hash), *keep)
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, -(-total // (target_bytes or 1 << 28)))
    tree = kd_tree(rows, len(values), shards)
    placed = rows.withColumn("shard", _walk(tree, lambda n: F.lit(n.first)).cast("int"))
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = number_within(placed, ["shard"], ["row"], "slot", spread)
    return out.select(
        F.col("id").alias(id_), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), *keep,
    )
