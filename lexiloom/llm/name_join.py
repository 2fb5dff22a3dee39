"""Names that are at most one edit apart, by a Levenshtein automaton over a sharded trie.

The trie of distinct names is cut into subtrees, once as it is and once of the names read backwards. A name of length m stands in
the subtree of its first m // 2 code points, and backwards in that of its last (m - 1) // 2. One edit leaves one of these two whole,
so a wanted name of length L visits six subtrees: those for m of L - 1, L and L + 1, both ways. Subtrees are dealt by hash to shards
of about `most` names; a shard's task builds the trie of its names, runs the automaton over it for each name that visits, and
verifies what it accepts. A subtree that alone has more than `most` names or visitors is cut into a grid of parts, each pair of
which meets in one shard. So no task, broadcast or driver holds more than a shard, and counts of heavy subtrees.

Names are searched once however many rows bear them; rows come back by name at the end.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.levenshtein import EDITS, Search, Trie, damerau
from lexiloom.plans.broadcasts import small
from lexiloom.plans.lineage import materialise
from lexiloom.plans.skew import join_heavy

FOUND = "wanted string, name string, distance int, n long, first long, crc long"


def misspelt(name: Column, seed: Column) -> Column:
    """name with the code points at seed mod (length - 1) and the next exchanged, if seed is even and it has two or more."""
    size = F.length(name)
    at = (seed % F.greatest(size - 1, F.lit(1))).cast("int")
    turned = F.concat(
        F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.lit(1)), F.substring(name, at + 1, F.lit(1)),
        F.substring(name, at + 3, size),
    )
    return F.when((seed % 2 == 0) & (size >= 2), turned).otherwise(name)


def _subtrees(name: Column, m: Column) -> Column:
    """The two subtrees that hold names of length m which begin, or end, like name."""
    ways = (
        (True, F.substring(name, F.lit(1), F.floor(m / 2).cast("int"))),
        (False, F.reverse(F.substring(F.reverse(name), F.lit(1), F.floor((m - 1) / 2).cast("int")))),
    )
    return F.array(*[F.struct(F.lit(f).alias("forward"), m.alias("m"), F.xxhash64(F.lit(f), m, part).alias("subtree")) for f, part in ways])


def _search(shard: pa.Table, visits: pa.Table) -> pa.Table:
    """A shard's names (name, n, first, crc, forward, m) and the names that visit them, to pairs in the form of FOUND."""
    out: dict[str, list] = {c: [] for c in ("wanted", "name", "distance", "n", "first", "crc")}
    for forward in (True, False):
        held, asked = (x.filter(pc.equal(x["forward"], forward)) for x in (shard, visits))
        if not len(held) or not len(asked):
            continue
        turn = (lambda x: x) if forward else (lambda x: x[::-1])
        rows = {turn(r["name"]): r for r in held.to_pylist()}
        wanted = sorted({turn(x) for x in asked["name"].to_pylist()})
        trie = Trie(list(rows))
        for w, t, _ in zip(*(x.tolist() for x in Search(trie).near(wanted)), strict=True):
            a, b = turn(wanted[w]), turn(trie.names[t])
            half = len(b) // 2
            # names that begin alike meet forwards, and others backwards
            if (a[:half] == b[:half]) != forward:
                continue
            distance = damerau(a, b, EDITS)
            if distance <= EDITS:
                row = rows[trie.names[t]]
                for c, v in zip(out, (a, b, distance, row["n"], row["first"], row["crc"]), strict=True):
                    out[c].append(v)
    types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), types, strict=True)})


def near_names(names: DataFrame, wanted: DataFrame, most: int = 1000) -> DataFrame:
    """(wanted, distance, n, first, crc): for each wanted name (column name, distinct) and each distance of 0 and 1 at which there are
    names (name, distinct, n, first, crc), the sums of n and crc and the least first.

    Both should be written tables, as they are read twice. Names must be neither null nor empty.
    """
    size = F.length("name")
    held = names.select("*", F.explode(_subtrees(F.col("name"), size)).alias("s")).select("name", "n", "first", "crc", "s.*")
    lengths = F.explode(F.filter(F.array(size - 1, size, size + 1), lambda m: m >= 1))
    asked = wanted.select("name", lengths.alias("m")).select("name", F.explode(_subtrees(F.col("name"), F.col("m"))).alias("s")).select("name", "s.*")

    counts = lambda rows, c: rows.groupBy("subtree").agg(F.count("*").alias(c))
    both = counts(held, "names").join(counts(asked, "visits"), "subtree").where(f"names > {most} or visits > {most}")
    parts = lambda c: F.ceil(F.col(c) / most).cast("int").alias(f"{c}_parts")
    heavy = small(materialise(both.select("subtree", parts("names"), parts("visits"))))
    whole = max(names.count() * 2, wanted.count() * 6)
    shards = max(1, -(-whole // most))

    def dealt(rows: DataFrame, own: str, others: str) -> DataFrame:
        """Rows by shard; those of heavy subtrees in a part of their own, once for each part of the others."""
        cut = rows.join(heavy, "subtree", "left")
        mine = F.pmod(F.xxhash64("name"), F.coalesce(F.col(f"{own}_parts"), F.lit(1))).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"{others}_parts"), F.lit(1)) - 1))
        at = cut.withColumn("mine", mine).withColumn("theirs", theirs)
        pair = ["mine", "theirs"] if own == "names" else ["theirs", "mine"]
        return at.withColumn("shard", F.pmod(F.xxhash64("subtree", *pair), F.lit(shards))).select("shard", *rows.drop("subtree").columns)

    found = dealt(held, "names", "visits").groupBy("shard").cogroup(dealt(asked, "visits", "names").groupBy("shard")).applyInArrow(_search, FOUND)
    # parts of a heavy subtree can meet by chance in a shard that is not theirs, so a pair may be found again
    once = found.repartition("wanted").dropDuplicates(["wanted", "name"])
    return once.groupBy("wanted", "distance").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("crc").alias("crc"))


def name_join(
    clients: DataFrame, vendors: DataFrame, client_id: str = "client_id", vendor_id: str = "vendor_id", name: str = "name",
    seed: Column | None = None, most: int = 1000,
) -> DataFrame:
    """(vendor_id, distance, n_clients, first_client_id, clients_crc) for each vendor and distance of 0 or 1 at which clients' names are.

    Names are taken as stored; null and empty ones take no part. seed: a column of vendors by which their names are misspelt first, or
    None for not at all. Distances are unrestricted Damerau-Levenshtein in code points. Client rows count each, repeated rows and rows
    of one name included; a null client id counts as a row, and adds nothing to the sum of crc32. Vendor rows equal in id and name are
    one; a vendor of several names has the sums over them. Empty tables give no rows; other columns are left out, so their names may be any.
    """
    wrong = F.col(name).cast("string") if seed is None else misspelt(F.col(name).cast("string"), seed)
    own = clients.select(F.col(client_id).alias("id"), F.col(name).cast("string").alias("name")).where("name <> ''")
    names = materialise(
        own.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.sum(F.crc32(F.col("id").cast("string"))).alias("crc"))
    )
    bearers = materialise(vendors.select(F.col(vendor_id).alias("id"), wrong.alias("wanted")).where("wanted <> ''").distinct())
    wanted = materialise(bearers.groupBy("wanted").agg(F.count("*").alias("bearers")))
    found = near_names(names, wanted.select(F.col("wanted").alias("name")), most)
    lists = found.groupBy("wanted").agg(F.collect_list(F.struct("distance", "n", "first", "crc")).alias("at"))  # two at most
    table = materialise(wanted.join(lists, "wanted"))
    rows = join_heavy(bearers, table, ["wanted"], "bearers", "inner").select("id", F.explode("at").alias("x"))
    return rows.groupBy(F.col("id").alias(vendor_id), F.col("x.distance").alias("distance")).agg(
        F.sum("x.n").alias("n_clients"), F.min("x.first").alias("first_client_id"), F.sum("x.crc").alias("clients_crc")
    )
