"""Chat formatting by quotation linking, in DataFrame functions alone.

A line that begins with '>' marks (spaces between them allowed) is quoted at the depth of their
number. A run of lines of one depth is a passage. Passages are hashed after normalisation (marks off,
white space runs one space, trimmed, lower case); a message's own words are the passages of depth 0
and each of their paragraphs and lines, hashed alike, in 64 bits that are compared within a conversation only. A quoted
passage links its message to the earliest message of the conversation
that comes before it and holds the passage as its own; where none does, to the earliest that comes before it and
has all the passage's lines that are not blank among its own. Of a message's links the shallowest quote counts,
then the first. Roots and replies are put in reply order, each reply under the message it quotes,
without the quoted lines.

Only conversations that quote anything are looked into. Originals are one row for each conversation and hash before the join,
so the join makes at most a row for each quoted passage, whatever is repeated. Passages looked for by their lines are one row
for each conversation and set of lines, and only messages that hold the set's rarest line are compared with it.

Depths come by pointer doubling. Reply order is the order in which a walk over the threads enters messages: each message
is entered and left, each of these events knows the next one, and pointer doubling counts what comes after it. Rounds grow
with the logarithm of the longest chain and conversation, and a row stays a few numbers however deep its chain is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.plans.broadcasts import small
from lexiloom.plans.lineage import materialise
from lexiloom.plans.numbering import number_all, number_within

MARKS = r"^[ \t]*((?:>[ \t]*)+)"
FIRST = -(1 << 62)


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def hashes(bodies: Column) -> Column:
    """The different hashes of texts that are not blank."""
    return F.array_distinct(F.transform(F.filter(F.transform(bodies, _normal), lambda x: x != ""), lambda x: F.xxhash64(x)))


def lines_of(text: Column) -> Column:
    """A message's lines as (depth, body): the number of marks, and the line without them."""

    def line(raw: Column) -> Column:
        marks = F.regexp_extract(raw, MARKS, 1)
        depth = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        return F.struct(depth.alias("depth"), F.when(marks == "", raw).otherwise(F.regexp_replace(raw, MARKS, "")).alias("body"))

    return F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), line)


def passages_of(lines: Column) -> Column:
    """Runs of lines of one depth as (depth, body), lines joined by a line break."""
    depth = lambda i: F.element_at(lines, i)["depth"]
    starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i == 1) | (depth(i) != depth(F.greatest(i - 1, F.lit(1)))))

    def run(held: Column) -> Column:
        def one(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(held, k + 1), F.size(lines) + 1)
            return F.struct(
                depth(start).alias("depth"),
                F.array_join(F.transform(F.slice(lines, start, end - start), lambda x: x["body"]), "\n").alias("body"),
            )

        return F.transform(held, one)

    return F.transform(F.array(starts), run)[0]


def passages(text: Column) -> Column:
    """passages_of() a message; one without marks is one passage, and is not cut into lines."""
    plain = F.array(F.struct(F.lit(0).alias("depth"), F.regexp_replace(text, r"\r\n?", "\n").alias("body")))
    return F.when(F.contains(text, F.lit(">")), F.transform(F.array(lines_of(text)), passages_of)[0]).otherwise(plain)


def quotation_links(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """A row for each message: conversation, turn, role, parent_turn, depth, position, content, n_quoted, n_linked.

    parent_turn: the turn quoted (null: a root); depth: replies above it; position: gapless from 0 in
    reply order within the conversation (a message, then its replies by turn); content: the text
    without quoted lines, trimmed. n_quoted: quoted passages; n_linked: those that were found in an earlier
    message. A blank passage links nothing. Messages that repeat a conversation and turn stay rows of their own; the first of them
    in text order is the one that replies point to. Null text is empty, a null turn comes before turn
    0, and a null conversation is a conversation. Other columns are left out unless kept.
    """
    base = messages.select(
        F.col(conversation).alias("c"), F.col(turn).cast("long").alias("t"), F.col(role).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *[
            F.col(k).alias(f"keep_{k}") for k in keep
        ]
    )
    named = F.coalesce(F.concat(F.lit("="), F.col("c").cast("string")), F.lit(""))
    base = base.withColumns(
        {"id": F.monotonically_increasing_id(), "k": named, "at": F.coalesce("t", F.lit(FIRST)), "passages": passages(F.col("text"))}
    )
    own = F.filter("passages", lambda p: p["depth"] == 0)
    content = F.regexp_replace(F.array_join(F.transform(own, lambda p: p["body"]), "\n"), r"^\s+|\s+$", "")
    base = materialise(base.withColumns({"content": content, "n_quoted": F.size("passages") - F.size(own)}))
    # the order of messages in a conversation: by turn, then by text, then as read
    again = materialise(base.groupBy("k", "at").agg(F.count("*").alias("n")).where("n > 1").select("k", "at"))
    tied = number_all(base.join(again, ["k", "at"], "left_semi").select("k", "at", "text", "id"), ["k", "at", "text", "id"], "tie")
    slim = base.select("k", "id", "at", "passages", "n_quoted").join(tied.select("id", "tie"), "id", "left")
    slim = materialise(
        slim.select("k", "id", F.struct("at", F.coalesce("tie", F.lit(0)).alias("tie"), "id").alias("order"), "passages", "n_quoted")
    )

    bodies = F.transform(F.filter("passages", lambda p: p["depth"] == 0), lambda p: p["body"])
    cut = lambda by: F.flatten(F.transform(bodies, lambda b: F.split(b, by)))
    quoted = slim.where("n_quoted > 0").select("k", "id", "order", F.posexplode("passages").alias("place", "p")).where(F.col("p.depth") > 0)
    quoted = quoted.select(
        "k", "id", "order", "place", F.col("p.depth").alias("depth"), F.get(hashes(F.array("p.body")), F.lit(0)).alias("h"),
        F.array_sort(hashes(F.split("p.body", "\n"))).alias("lines"),
    )
    quoted = materialise(quoted.where("h is not null"))
    asking = small(quoted.select("k").distinct())
    wanted = small(quoted.select("k", "h").distinct())
    whole = hashes(F.flatten(F.array(bodies, cut(r"\n\s*\n"), cut("\n"))))
    originals = slim.join(asking, "k", "left_semi").select("k", "order", F.explode(whole).alias("h")).join(wanted, ["k", "h"], "left_semi")
    originals = originals.groupBy("k", "h").agg(F.min("order").alias("source"))
    found = quoted.join(originals, ["k", "h"], "left").withColumn("source", F.when(F.col("source") < F.col("order"), F.col("source")))
    found = materialise(found)
    linked = found.where("source is not null").select("k", "id", "place", "depth", "source")
    loose = found.where("source is null and (size(lines) > 1 or lines[0] <> h)").drop("source")
    loose = loose.withColumn("set", F.xxhash64("k", "lines"))
    if loose.limit(1).count():
        lines = slim.join(small(loose.select("k").distinct()), "k", "left_semi").select("k", "order", hashes(cut("\n")).alias("lines"))
        able = loose.join(_holders(loose, lines), ["k", "set"]).where(F.col("source") < F.col("order"))
        linked = linked.unionByName(able.select("k", "id", "place", "depth", "source"))
    best = linked.groupBy("k", "id").agg(F.min(F.struct("depth", "place", "source")).alias("best"), F.count("*").alias("n_linked"))
    parent = materialise(
        best.select("k", "id", F.col("best.source.id").alias("parent"), F.col("best.source.at").alias("parent_at"), "n_linked")
    )

    threads = small(parent.select("k").distinct())
    plain = slim.join(threads, "k", "left_anti").select("id", "k", "order.at", "order.tie")
    # buckets by turn keep a conversation's messages apart without one task for a whole conversation
    by_turn = F.floor(F.col("at") / 64)
    position = number_within(plain, ["k"], ["at", "tie", "id"], "position", bucket=by_turn).select("id", "position")
    if parent.limit(1).count():
        rows = slim.join(threads, "k", "left_semi").select("id", "k", "order.at", "order.tie").join(
            parent.select("id", "parent"), "id", "left"
        )
        position = position.unionByName(_reply_order(materialise(rows)))
    out = base.join(_depths(parent), "id", "left").join(parent.select("id", "parent_at", "n_linked"), "id", "left").join(position, "id")
    parent_turn = F.when(F.col("parent_at") > FIRST, F.col("parent_at"))
    return out.select(
        F.col("c").alias(conversation), F.col("t").alias(turn), F.col("role").alias(role), parent_turn.alias("parent_turn"), F.coalesce(
            "depth", F.lit(0)
        ).alias("depth"), "position", "content",
        F.col("n_quoted").cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), *[
            F.col(f"keep_{k}").alias(k) for k in keep
        ],
    )


def _holders(loose: DataFrame, own: DataFrame) -> DataFrame:
    """(k, set, source): the earliest message of the conversation that has all lines of the set among its own."""
    needs = loose.select("k", "set", "lines").dropDuplicates(["k", "set"]).select(
        "k", "set", F.size("lines").alias("size"), F.explode("lines").alias("line")
    )
    needs = materialise(needs)
    lines = own.select("k", "order", F.explode("lines").alias("line"))
    lines = materialise(lines.join(small(needs.select("k", "line").distinct()), ["k", "line"], "left_semi"))
    counted = needs.join(lines.groupBy("k", "line").agg(F.count("*").alias("n")), ["k", "line"])
    rarest = counted.groupBy("k", "set").agg(
        F.min(F.struct("n", "line"))["line"].alias("line"), F.count("*").alias("known"), F.max("size").alias("size")
    )
    able = rarest.where("known = size").join(lines, ["k", "line"]).select("k", "set", F.col("order").alias("source"))
    held = able.join(needs, ["k", "set"]).join(
        lines.select("k", "line", F.col("order").alias("by")), ["k", "line"]
    ).where("source.id = by.id")
    return held.groupBy("k", "set", "source").agg(
        F.count("*").alias("n"), F.max("size").alias("size")
    ).where("n = size").groupBy("k", "set").agg(F.min("source").alias("source"))


def _depths(parent: DataFrame) -> DataFrame:
    """(id, depth) of messages that have a parent; a round doubles the part of the way up that is known."""
    chain = parent.select("id", F.col("parent").alias("up"), F.lit(1).alias("depth"))
    while chain.where("up is not null").limit(1).count():
        above = chain.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        chain = materialise(
            chain.join(above, "up", "left").select(
                "id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
            )
        )
    return chain.select("id", "depth")


def _reply_order(rows: DataFrame) -> DataFrame:
    """(id, position) from rows (id, k, at, tie, parent): a message, then its replies in order. Event 2 id enters a message, event 2 id + 1 leaves it."""
    rows = rows.withColumn("above", F.coalesce("parent", F.lit(-1)))
    placed = number_within(
        rows, ["k", "above"], ["at", "tie", "id"], "rank", bucket=F.floor(F.col("at") / 64)
    ).select("id", "k", "above", "rank")
    placed = materialise(placed)
    after = placed.select("k", "above", (F.col("rank") - 1).alias("rank"), F.col("id").alias("next"))
    child = placed.where("above >= 0 and rank = 0").select(F.col("above").alias("id"), F.col("id").alias("child"))
    known = placed.join(after, ["k", "above", "rank"], "left").join(child, "id", "left")
    enter = F.struct((F.col("id") * 2).alias("event"), F.coalesce(F.col("child") * 2, F.col("id") * 2 + 1).alias("to"), F.lit(1).alias("n"))
    up = F.when(F.col("above") >= 0, F.col("above") * 2 + 1)
    leave = F.struct((F.col("id") * 2 + 1).alias("event"), F.coalesce(F.col("next") * 2, up).alias("to"), F.lit(0).alias("n"))
    walk = materialise(
        known.select("k", F.explode(F.array(enter, leave)).alias("e")).select("k", "e.event", "e.to", F.col("e.n").cast("long").alias("n"))
    )
    while walk.where("to is not null").limit(1).count():
        further = walk.select(F.col("event").alias("to"), F.col("to").alias("far"), F.col("n").alias("more"))
        going = walk.where("to is not null").join(further, "to").select(
            "k", "event", F.col("far").alias("to"), (F.col("n") + F.col("more")).alias("n")
        )
        walk = materialise(going.unionByName(walk.where("to is null")))
    total = rows.groupBy("k").agg(F.count("*").alias("total"))
    return walk.where("event % 2 = 0").join(total, "k").select(
        (F.col("event") / 2).cast("long").alias("id"), (F.col("total") - F.col("n")).alias("position")
    )
