"""A Merkle manifest of a table: a tree of sha256 digests for each group of rows, and one over the groups.

A level's nodes are windowed by group and parent number; the whole frame's digests in order are the parent's preimage and,
without the node's own, its siblings. One row of each window becomes the parent, and the levels above shrink by the fan-out,
so a level is one shuffle of numbered digests and the texts are read once. On the way down a parent hands its children its own
siblings with the places they stand at: a row of its level for each node, and never a list that grows with the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.plans.broadcasts import small
from lexiloom.plans.lineage import materialise
from lexiloom.plans.numbering import number_all

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """`-` for null, else its UTF-8 byte count, `:` and itself, so that no two rows share a preimage."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path (siblings before and after, level by level) lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["before"], h, s["after"]))


def _runs(nodes: DataFrame, fan: int) -> DataFrame:
    """nodes (g, i, n, h, ...) with up, the parent's number, and run, the digests of the parent's children in order."""
    whole = Window.partitionBy("g", "up").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("up", F.floor(F.col("i") / fan)).withColumn("run", F.collect_list("h").over(whole))


def _step(fan: int) -> Column:
    """A node's siblings and their places."""
    at = (F.col("i") % fan).cast("int")
    return F.struct(
        F.array_join(F.slice("run", 1, at), "").alias("before"), F.array_join(F.slice("run", at + 2, F.lit(fan)), "").alias("after")
    )


def _levels(nodes: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels from nodes (g, i, n, h) up, each without the groups that were done before it, and (g, h) of the last ones."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, done = [nodes], nodes.where("n = 1").select("g", "h")
    while most > 1:
        up = _runs(levels[-1].where("n > 1"), fan).where(F.col("i") % fan == 0)
        more = (F.col("n") + fan - 1 - (F.col("n") + fan - 1) % fan) / fan
        levels.append(
            materialise(up.select("g", F.col("up").alias("i"), more.cast("long").alias("n"), digest(F.array_join("run", "")).alias("h")))
        )
        done = done.unionByName(levels[-1].where("n = 1").select("g", "h"))
        most = -(-most // fan)
    return levels, materialise(done)


def _down(levels: list[DataFrame], ends: DataFrame, fan: int) -> DataFrame:
    """The lowest level's rows with what ends (g, path, ...) says of their group, their own path put before."""
    more = [c for c in ends.columns if c not in ("g", "path")]
    found = None
    for k in range(len(levels) - 1, -1, -1):
        here = levels[k]
        own = [c for c in here.columns if c not in ("g", "i", "n", "h")]
        single = here.where("n = 1").join(ends, "g").select("g", "i", "h", *own, "path", *more)
        if found is None:
            found = single
        else:
            above = found.select("g", F.col("i").alias("up"), F.col("path").alias("rest"), *more)
            under = _runs(here.where("n > 1"), fan).join(above, ["g", "up"])
            found = under.select("g", "i", "h", *own, F.concat(F.array(_step(fan)), "rest").alias("path"), *more).unionByName(single)
        if k:
            found = materialise(found)
    return found


def merkle_manifest(
    docs: DataFrame, group: str = "lang", order: str = "doc_id", text: str = "text", fields: tuple[str, ...] = FIELDS,
    tampered: Column | None = None, fan: int = 8,
) -> DataFrame:
    """A row for each row of docs: order, leaf, subroot, root, path, proof_sha256, folded_root, verified.

    A leaf is the digest of the row's fields; a group's leaves ascend by order (null first; rows that share it, by digest), and
    while several nodes of a group are left, every `fan` in a row become one, the last run as short as it is. A group's last node
    is its subroot; the subroots by group (null first, in bytes) are hashed likewise to the root. path: the siblings before and after,
    level by level; proof_sha256: the digest of them all. folded_root is recomputed from the path and the leaf of the row with its text's
    A-Z lowered where `tampered` (null: not) holds, else from the leaf itself; verified: whether it equals the root.

    Null fields and empty and very long texts are hashed like others; repeated rows are leaves of their own with equal digests. An
    empty table gives no rows. Other columns are left out, so their names may be any.
    """
    cast = {f: F.col(f) for f in fields}
    low = digest(*[field(F.translate(c, UPPER, LOWER) if f == text else c) for f, c in cast.items()])
    changed = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    leaves = docs.select(
        F.col(group).alias("name"), F.col(order).alias("id"), digest(*map(field, cast.values())).alias("h"),
        F.when(changed, low).alias("other"),
    )
    numbered = materialise(number_all(leaves, ["name", "id", "h"], "at"))
    # a group's rows are in a row, so the number of its first one names it, in the order of groups and never null
    groups = materialise(numbered.groupBy("name").agg(F.min("at").alias("g"), F.count("*").alias("n")))
    same = F.col("name").eqNullSafe(F.col("__name"))
    nodes = materialise(
        numbered.join(small(groups.withColumnRenamed("name", "__name")), same).select(
            "g", (F.col("at") - F.col("g")).alias("i"), "n", "h", "id", "other"
        )
    )
    levels, subroots = _levels(nodes, fan)

    tops = subroots.withColumnsRenamed({"g": "of", "h": "subroot"})
    top = materialise(
        number_all(tops, ["of"], "i").select(
            F.lit(0).cast("long").alias("g"), "i", F.lit(subroots.count()).cast("long").alias("n"), F.col("subroot").alias("h"), "of"
        )
    )
    upper, roots = _levels(top, fan)
    ends = _down(upper, roots.select("g", F.col("h").alias("root"), F.array().cast(PATH).alias("path")), fan)
    ends = materialise(ends.select(F.col("of").alias("g"), F.col("h").alias("subroot"), "root", "path"))

    folded = fold(F.coalesce("other", "h"), F.col("path"))
    beside = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    rows = _down(levels, small(ends), fan).select(
        F.col("id").alias(order), F.col("h").alias("leaf"), "subroot", "root", "path", F.sha2(beside, 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
