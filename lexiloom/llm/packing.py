"""Best-fit packing by swap-based local search, over bins counted by what they hold.

Lengths are whole numbers up to the capacity, so a corpus is a histogram of lengths, and bins that
hold the same lengths are one pattern with a count. A start by best fit decreasing fills bins; then
local search moves or exchanges documents between the emptiest bins and fuller ones (one for none,
one for one, two for one), each step for as many bins of the two patterns as exist at once. A step is
taken only if the sum of squared fills rises, so fills drift apart until bins are empty. The driver
sees the histogram and the patterns, whose number the capacity bounds, whatever the corpus; the
documents meet their places by length and rank, and never leave the cluster.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.words import batches
from lexiloom.plans.lineage import materialise
from lexiloom.plans.numbering import number_within

Pattern = tuple[int, ...]
BLANK = 100_000


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Patterns with counts: lengths in falling order, each into the fullest bins that it fits."""
    bins: dict[int, Counter] = defaultdict(Counter)  # by room left
    rooms: list[int] = []
    for length, count in sorted(histogram.items(), reverse=True):
        left = count
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                held = capacity // length
                whole, rest = divmod(left, held)
                for times, n in ((held, whole), (rest, 1)):
                    if times and n:
                        _put(bins, rooms, (length,) * times, n, capacity)
                break
            room = rooms[at]
            pattern, n = next(iter(bins[room].items()))
            now = min(n, left)
            _take(bins, rooms, room, pattern, now)
            _put(bins, rooms, (*pattern, length), now, capacity)
            left -= now
    return Counter({p: n for group in bins.values() for p, n in group.items()})


def _put(bins, rooms, pattern: Pattern, n: int, capacity: int) -> None:
    room = capacity - sum(pattern)
    if not bins[room]:
        bisect.insort(rooms, room)
    bins[room][pattern] += n


def _take(bins, rooms, room: int, pattern: Pattern, n: int) -> None:
    bins[room][pattern] -= n
    if not bins[room][pattern]:
        del bins[room][pattern]
        if not bins[room]:
            rooms.remove(room)


def exchange(full: Pattern, low: Pattern, capacity: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """The exchange that fills `full` most from `low`: tokens gained, what comes, what goes. 0: none raises the squared fills."""
    room, best = capacity - sum(full), (0, (), ())
    gives, takes = sorted(set(low), reverse=True), [0, *sorted(set(full))]
    counted = Counter(low)
    pairs = {a: (a,) for a in gives}
    for i, a in enumerate(gives):
        for b in gives[i:]:
            if a != b or counted[a] > 1:
                pairs.setdefault(a + b, (a, b))
    sums = sorted(pairs)
    for out in takes:
        at = bisect.bisect_right(sums, out + room) - 1
        if at >= 0 and sums[at] - out > best[0]:
            best = (sums[at] - out, pairs[sums[at]], (out,) if out else ())
            if best[0] == room:
                break
    return best


def improve(bins: Counter, capacity: int) -> Counter:
    """Local search from a packing. Donors are the emptiest bins; a donor that no bin can draw on stays as it is.

    Ends at the least number of bins that the total allows, or when no open donor has anything left to give.
    """
    total = sum(sum(p) * n for p, n in bins.items())
    count, least, tried, moved = sum(bins.values()), -(-total // capacity), set(), False
    while count > least:
        open_ = [p for p in bins if sum(p) < capacity]
        donors = [p for p in open_ if p not in tried]
        if not donors and moved:  # what could not give before may now
            tried, moved = set(), False
            continue
        if not donors:
            break
        donor = min(donors, key=lambda p: (sum(p), p))
        fill = sum(donor)
        targets = sorted((p for p in open_ if sum(p) >= fill and (p != donor or bins[p] > 1)), key=lambda p: (-sum(p), p))
        for target in targets:
            gain, come, go = exchange(target, donor, capacity)
            if gain <= 0:
                continue
            n = bins[donor] // 2 if target == donor else min(bins[donor], bins[target])
            for p, k in ((donor, n), (target, n)):
                bins[p] -= k
                if not bins[p]:
                    del bins[p]
            fuller, emptier = Counter(target), Counter(donor)
            fuller.update(come)
            fuller.subtract(go)
            emptier.update(go)
            emptier.subtract(come)
            for c in (fuller, emptier):
                made = tuple(sorted(c.elements(), reverse=True))
                if made:
                    bins[made] += n
                else:
                    count -= n
            tried, moved = tried - {target}, True
            break
        else:
            tried.add(donor)
    return bins


def places(bins: Counter) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first bin, offset): documents of a length, numbered from 0, go to bins in runs."""
    used: Counter = Counter()
    out, first = [], 0
    for pattern, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length in pattern:
            out.append((length, used[length], first, offset))
            used[length] += n
            offset += length
        first += n
    return sorted(out)


def _long_blank(text: str) -> bool:
    return len(text) >= BLANK and any(m.end() - m.start() >= BLANK for m in re.finditer(r"\s+", text))


def tokenised(docs: DataFrame, id_: str, text: str, tokenizer: str, end: int, capacity: int, ids: bool) -> DataFrame:
    """(id, row, piece, start, length, ids_crc32[, ids]) of all pieces."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        # tiktoken has the same vocabulary in another format and gives the same ids in a fifth of the time; a text that spells
        # a special token goes to the tokenizers library, which reads it as one, and so does one with a long run of white space,
        # on which tiktoken's pattern overflows its stack
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{tokenizer}.tiktoken"), "rb"))}
        fast, slow = tiktoken.Encoding(tokenizer, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), None
        for whole in parts:
            for part in batches(whole, 1 << 22):
                out: list[list] = [[] for _ in range(6)]
                for i, t in enumerate(part.column(1).to_pylist()):
                    if t and ("<|" in t or _long_blank(t)):
                        slow = slow or Tokenizer.from_file(public_tokenizers.path(f"{tokenizer}.json"))
                        got = slow.encode(t, add_special_tokens=False).ids
                    else:
                        got = fast.encode_ordinary(t or "")
                    got.append(end)
                    a = np.array(got, "<u4")
                    first = len(a) % capacity or min(len(a), capacity)
                    cuts = [0, *range(first, len(a) + 1, capacity)]
                    for k in range(len(cuts) - 1):
                        data = a[cuts[k] : cuts[k + 1]]
                        for to, v in zip(
                            out, (i, k, cuts[k], len(data), zlib.crc32(data.tobytes()), data.astype(np.int64) if ids else None), strict=True
                        ):
                            to.append(v)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [
                    part.column(0).take(pa.array(out[0], pa.int32())), *(pa.array(v, kind) for v, kind in zip(out[1:5], kinds, strict=True))
                ]
                yield pa.RecordBatch.from_arrays(
                    columns + ([pa.array(out[5], pa.list_(pa.int64()))] if ids else []),
                    names=["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids],
                )

    source = docs.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    found = source.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if ids else ""))
    return materialise(found.withColumn("row", F.monotonically_increasing_id()))


def pack(
    docs: DataFrame, id_: str = "doc_id", text: str = "text", capacity: int = 1024, end: int = 2, tokenizer: str = "byte_bpe_50k",
    ids: bool = False,
) -> DataFrame:
    """A row for each piece: id_, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).

    A document is its token ids and one end token. Only documents above the capacity are cut, into
    pieces of the capacity, the first one shorter if need be. Null and empty texts are the end token
    alone. Rows with a null id and repeated rows are packed like others. Other columns are left out.
    An empty table gives no rows.
    """
    pieces = tokenised(docs, id_, text, tokenizer, end, capacity, ids)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    full = histogram.pop(capacity, 0)
    bins = improve(best_fit(histogram, capacity), capacity)
    rows = [*places(bins), (capacity, 0, sum(bins.values()), 0)] if full else places(bins)
    table = docs.sparkSession.sparkContext.broadcast(np.array(rows or [(0, 0, 0, 0)], np.int64))

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = table.value
        key = (held[:, 0] << 48) | held[:, 1]
        for part in parts:
            length, rank = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 48) | rank, side="right") - 1
            gone = part.schema.get_field_index("rank")
            out = part.remove_column(gone)
            yield out.append_column(
                "sequence_id", pa.array(held[at, 2] + rank - held[at, 1])
            ).append_column("offset", pa.array(held[at, 3]))

    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = number_within(pieces, ["length"], ["row"], "rank", spread).drop("row")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long").withColumnRenamed("id", id_)
