"""Dialogue rounds: what is shuffled."""

from pyspark.sql import functions as F

from lexiloom.operators import dialogue as dg


def test_histories_stay_where_they_are(spark, monkeypatch):
    """Each round's plan has one exchange, of its new turns, and their number alone grows with the rounds."""
    agent = F.struct(F.lit("m").alias("model_id"), F.lit(None).cast("string").alias("adapter_id"), F.lit(None).cast("string").alias("role"), F.lit(False).alias("ground_truth_is_llm"))
    configs = spark.range(20).select(F.col("id").cast("string").alias("conv_id"), agent.alias("agent_A_cfg"), agent.alias("agent_B_cfg"), F.col("id").cast("int").alias("seed"))
    plans, keep = [], dg.append

    def watched(rows, table, key, buckets):
        plans.append(rows.repartition(buckets, key)._jdf.queryExecution().executedPlan().toString())
        keep(rows, table, key, buckets)

    monkeypatch.setattr(dg, "append", watched)
    said = lambda model, shown, seed: (f'{{"reply": "{len(shown)}", "suspicion_score": 0.1, "public_accusation": {str(seed == 3).lower()}}}', 1, 1)
    turns = dg.converse(configs, said, {"initiator": "s", "responder": "s"}, 3)
    got = {}
    for r in turns.collect():
        got.setdefault(r["conv_id"], []).append((r["turn_idx"], r["reply"], r["public_accusation"]))
    for c in range(20):
        last = 3 - c if 0 <= 3 - c < 6 else 5
        assert sorted(got[str(c)]) == [(t, str(t + 1), c + t == 3) for t in range(last + 1)]
    assert len(plans) == 7 and all(p.count("Exchange ") == 1 and "BroadcastExchange" not in p for p in plans[1:])
