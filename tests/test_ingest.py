"""Ingest that is killed at any of its steps takes each line once."""

import json

import pytest

from lexiloom.sources.ingest import ingest, landed, quarantined, skipped

SCHEMA = "id bigint, v string"


def write(path, *lines):
    path.parent.mkdir(exist_ok=True)
    path.write_text("".join(f"{x}\n" for x in lines))


def line(i, v="x"):
    return json.dumps({"id": i, "v": v})


def test_killed_between_its_writes(spark, tmp_path):
    """The first and second run die in batch 1; nothing of it is seen until a run ends it, and then all of it, once."""
    source, place = tmp_path / "in", str(tmp_path / "out")
    for k in range(3):
        write(source / f"f{k}.jsonl", line(10 * k), line(10 * k + 1), '{"id": 1', "", '{"v": "no id"}', line(10 * k), line(10 * k + 1, "y"))

    def dies(number):
        if number == 1:
            raise RuntimeError("killed")

    run = lambda **k: ingest(spark, f"file://{source}", place, SCHEMA, "id", files=1, **k)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            run(between=dies)
        assert landed(spark, place, SCHEMA).count() == 2 and quarantined(spark, place).count() == 2
    run()
    got = sorted((r["id"], r["v"]) for r in landed(spark, place, SCHEMA).collect())
    assert got == [(i, "x") for k in range(3) for i in (10 * k, 10 * k + 1)]
    assert sorted(r["value"] for r in quarantined(spark, place).collect()) == ['{"id": 1'] * 3 + ['{"v": "no id"}'] * 3
    assert skipped(spark, place).count() == 6
    # what comes again under another name lands nothing, and a run without files does nothing
    write(source / "again.jsonl", line(0), line(77), line(21, "other"))
    run()
    run()
    assert {r["id"] for r in landed(spark, place, SCHEMA).collect()} == {0, 1, 10, 11, 20, 21, 77}
    assert landed(spark, place, SCHEMA).count() == 7 and skipped(spark, place).count() == 8


def test_nothing_yet(spark, tmp_path):
    assert landed(spark, str(tmp_path), SCHEMA).count() == quarantined(spark, str(tmp_path)).count() == skipped(spark, str(tmp_path)).count() == 0
