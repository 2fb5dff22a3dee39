"""Late and unordered turns through the stateful stream."""

import datetime as dt
import random

from lexiloom.streaming.closing import NONE, closed_conversations, dropped, fold, run_to_end

SCHEMA = "conv string, speaker string, turn long, ts timestamp, score double, accused boolean"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def batch(turns, threshold):
    """(n_turns, t_private, t_public, gap) by the words of the metric."""
    turns = sorted(turns)
    private = next((t for i, (t, _, _) in enumerate(turns) if all((s or 0) >= threshold for _, s, _ in turns[i:])), None)
    public = next((t for t, _, a in turns if a), None)
    return len(turns), private, public, None if None in (private, public) else public - private


def test_fold():
    pick = random.Random(1)
    for _ in range(300):
        turns = [(k, pick.random(), pick.random() < 0.2) for k in range(pick.randint(1, 8))]
        cut = pick.randint(0, len(turns))
        rows = [(t, t, s >= 0.5, a) for t, s, a in turns]
        count, _, first, public = fold(fold((0, NONE, NONE, NONE), rows[:cut]), rows[cut:])
        assert (count, *(None if v == NONE else v for v in (first, public))) == batch(turns, 0.5)[:3]


def test_dealt_over_ten_batches(spark, tmp_path):
    """Turns up to an hour late, in ten files: the rows of a batch computation, each once; what is later is counted; a second run adds nothing."""
    pick, want, rows = random.Random(2), {}, []
    for c in range(12):
        start = pick.randint(0, 900)
        for s in ("x", "y"):
            turns = [(k, pick.choice([None, 0.2, 0.8, 0.9]), pick.random() < 0.1) for k in range(pick.randint(1, 20))]
            want[f"c{c}", s] = batch(turns, 0.7)
            rows += [(start + 2 * t + pick.randint(0, 59), (f"c{c}", s, t, at(start + 2 * t), v, a or None)) for t, v, a in turns]
    rows.sort(key=lambda r: (r[0], r[1][:3]))
    size = -(-len(rows) // 10)
    files = [[r for _, r in rows[k * size : (k + 1) * size]] for k in range(10)]
    for part in files:
        pick.shuffle(part)
    files += [[("end", "end", 0, at(100_000), 0.0, False)], [("c0", "x", 0, at(1), 0.9, True), ("end", "end", 1, at(100_001), 0.0, False)]]
    files += [[(None, "x", 1, at(100_002), 0.9, True), ("end", None, 1, at(100_002), 0.9, True), ("end", "end", 2, at(100_003), 0.0, False), ("c1", "y", 3, at(2), 0.9, True)]]
    place = str(tmp_path)

    def run(some):
        for part in some:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
        out, query = run_to_end(closed_conversations(stream, 0.7, "61 minutes", dt.timedelta(minutes=90)), place)
        return sorted(((r["conv"], r["speaker"]), tuple(r)[2:]) for r in out.collect()), dropped(query)

    first, lost = run(files[:6])
    assert lost == 0 and all(want[k] == v for k, v in first) and len(first) < len(want)
    second, lost = run(files[6:])  # goes on with the state that the first run left
    assert second == sorted(want.items()) and lost == 2


def test_no_key_costs_a_call_of_python(spark, tmp_path):
    """State is kept by Spark's own aggregates: a worker that is asked key by key took 6 ms for each key of a batch."""
    spark.createDataFrame([("c", "x", 0, at(0), 0.9, True)], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    plan = closed_conversations(stream, 0.7, "61 minutes", dt.timedelta(minutes=90))._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "session" in plan
