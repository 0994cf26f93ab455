"""The first-seen ledger: its rules read by read, and a stream against the batch form."""

import copy
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import ledger
from gristmill.streaming.ledger import observe_stream, slot_counts

HOUR = 3600
READS = "source long, at long, outcome string, rows array<struct<key: string, ident: string>>"


def listed(keys):
    return [(k, k[0]) for k in keys]


def fold(reads):
    state = ledger.State()
    return state, [ledger.step(state, at, None if keys is None else listed(keys), outcome) for at, keys, outcome in reads]


def plain(state):
    """The state as the rules state it, without queues."""
    return [(k, s.ident, s.lo, s.hi, s.started, s.pred, s.absent_since, s.gone) for k, s in sorted(state.keys.items())]


def test_flaps_partial_and_late_reads():
    state, became = fold([(0, ["a1", "b1"], "ok"), (HOUR, ["a1", "b1", "c1"], "ok"), (2 * HOUR, ["a1"], "ok"), (3 * HOUR, ["a1"], "ok"), (4 * HOUR, ["a1", "b1", "c1"], "ok"), (1, ["z1"], "ok")])
    assert became == ["good", "good", "partial", "good", "good", "late"]
    assert (state.keys["c1"].lo, state.keys["c1"].hi, state.keys["a1"].started) == (0, HOUR, "cold")
    assert state.keys["b1"].absent_since is None  # one hour away: a flap


def test_gone_needs_a_new_key_and_three_hours():
    state, _ = fold([(0, ["a1", "b1", "c1"], "ok"), (HOUR, ["a1", "b1"], "ok"), (5 * HOUR, ["a1", "b1"], "ok")])
    assert not state.keys["c1"].gone
    ledger.step(state, 6 * HOUR, listed(["a1", "b1", "d1"]))
    assert state.keys["c1"].gone
    ledger.step(state, 7 * HOUR, listed(["a1", "b1", "d1", "c1"]))
    assert (state.keys["c1"].lo, state.keys["c1"].hi, state.keys["c1"].started) == (6 * HOUR, 7 * HOUR, "warm")


def test_back_on_a_later_day_is_cold():
    state, _ = fold([(20 * HOUR, ["a1", "b1", "c1"], "ok"), (21 * HOUR, ["a1", "b1"], "ok"), (30 * HOUR, ["a1", "b1", "c1"], "ok")])
    assert (state.keys["c1"].lo, state.keys["c1"].hi, state.keys["c1"].started) == (None, 30 * HOUR, "cold")


def test_successors_and_ties():
    state, _ = fold([(0, ["a1", "b1", "b2", "c1", "c2", "c3"], "ok"), (HOUR, ["a2", "b3", "c1", "c2", "c3"], "ok")])
    assert (state.keys["a2"].pred, state.keys["a2"].started) == ("a1", "warm")
    assert (state.keys["b3"].pred, state.keys["b3"].lo, state.keys["b3"].started) == (None, None, "cold")  # two went at once


def test_churn_of_keys_and_of_idents():
    state, _ = fold([(0, ["a1", "b1", "c1", "d1", "e1"], "ok"), (HOUR, ["a1", "v1", "w1", "x1", "y1"], "ok")])
    assert {state.keys[k].started for k in ("v1", "w1", "x1", "y1")} == {"churn"}


def test_not_modified_and_failed_reads():
    state, became = fold([(0, None, "not_modified"), (1, ["a1", "b1"], "ok"), (HOUR, None, "not_modified"), (2 * HOUR, None, "error"), (3 * HOUR, ["a1"], "ok"), (4 * HOUR, None, "not_modified")])
    assert became == ["failed", "good", "confirmed", "failed", "partial", "partial"]
    assert state.last_good == HOUR


def test_keys_unseen_for_two_weeks_are_forgotten():
    state, _ = fold([(0, ["a1", "b1", "c1"], "ok"), (HOUR, ["a1", "b1"], "ok"), (15 * 86400, ["a1", "b1"], "ok")])
    assert {k: s.started for k, s in state.keys.items()} == {"a1": "cold", "b1": "cold"} and state.keys["a1"].hi == 15 * 86400  # begun anew
    state, _ = fold([(0, ["a1", "b1", "c1"], "ok"), *((k * 86400, ["a1", "b1"], "ok") for k in range(1, 16))])
    assert sorted(state.keys) == ["a1", "b1"] and not state.absent and state.keys["a1"].hi == 0


def random_reads(seed, reads=60):
    rng = random.Random(seed)
    at, out, keys = 0, [], ["a1", "b1", "c1"]
    for _ in range(reads):
        at += rng.choice([HOUR // 2, HOUR, 4 * HOUR, 26 * HOUR, 40 * HOUR, 15 * 86400] if rng.random() < 0.3 else [HOUR // 4])
        for _ in range(rng.randint(0, 3)):
            if keys and rng.random() < 0.5:
                keys.remove(rng.choice(keys))
            else:
                keys.append(f"{rng.choice('abcdef')}{rng.randint(1, 4)}")
        shown = [] if rng.random() < 0.03 else keys[: len(keys) // 2] if rng.random() < 0.1 else keys
        outcome = rng.choice(["ok"] * 8 + ["not_modified", "error"])
        out.append((at, None if outcome != "ok" else sorted(set(shown)), outcome))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_packed_states_go_on_as_the_state_itself(seed):
    reads = random_reads(seed)
    state, other = ledger.State(), ledger.State()
    for at, keys, outcome in reads:
        rows = None if keys is None else listed(keys)
        one, two = ledger.step(state, at, rows, outcome), ledger.step(other, at, rows, outcome)
        assert one == two
        other = ledger.unpack(ledger.pack(other))
        assert plain(state) == plain(other) and ledger.pack(state) == ledger.pack(other)
        assert state.present == {k for k, s in state.keys.items() if s.absent_since is None}
        assert {k for ks in state.absent.values() for k in ks} == {k for k, s in state.keys.items() if s.absent_since is not None and not s.gone}


def test_derived_values_are_kept_until_the_version_changes():
    state, _ = fold([(0, ["a1", "b1"], "ok")])
    assert ledger.derive(state, "1", str.upper) == 2 and ledger.derive(state, "1", str.upper) == 0
    ledger.step(state, HOUR, listed(["a1", "b1", "c1"]))
    assert ledger.derive(state, "1", str.upper) == 1 and state.derived["c1"] == "C1"
    assert ledger.derive(state, "2", str.title) == 3 and state.derived["c1"] == "C1"


def as_rows(reads):
    return [(source, at, outcome, None if keys is None else [{"key": k, "ident": k[0]} for k in keys]) for source, at, keys, outcome in reads]


def test_stream_equals_batch_with_late_reads_and_a_restart(spark, tmp_path):
    """Reads come in five files; late ones and a repeated file change nothing; the stream stops and goes on from its checkpoint."""
    reads = [(source, *r) for source in (1, 2, 3) for r in random_reads(100 + source, 40)]
    reads.sort(key=lambda r: (r[1], r[0]))
    parts = [reads[k * len(reads) // 5 : (k + 1) * len(reads) // 5] for k in range(5)]
    late = copy.deepcopy(parts[0])
    folder, seen = tmp_path / "reads", {}
    folder.mkdir()

    def put(number, part):
        rows = [json.dumps({"source": s, "at": a, "outcome": o, "rows": r}) for s, a, o, r in as_rows(part)]
        (folder / f"{number}.json").write_text("\n".join(rows))
        os.utime(folder / f"{number}.json", (10**9 + number, 10**9 + number))  # read in this order

    def run():
        stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).json(str(folder))
        def whole(batch, number):
            rows = batch.collect()
            for source in {r.source for r in rows}:
                for k in [k for k in seen if k[0] == source]:
                    del seen[k]
            seen.update({(r.source, r.key): tuple(r) for r in rows})

        query = observe_stream(stream, version="1", of=str.upper).writeStream.outputMode("update").foreachBatch(whole).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        assert query.awaitTermination(240)

    for number, part in enumerate(parts[:3]):
        put(number, part)
    run()
    put(3, late)
    put(4, parts[3])
    put(5, parts[4])
    run()
    batch = ledger.observe(spark.createDataFrame(as_rows(reads), READS), "1", str.upper).collect()
    assert seen == {(r.source, r.key): tuple(r) for r in batch} and any(r.gone for r in batch)


def test_batch_form_equals_the_fold(spark):
    reads = [(source, *r) for source in range(6) for r in random_reads(source)]
    got = {(r.source, r.key): (r.lo, r.hi, r.started, r.pred, r.absent_since, r.gone) for r in ledger.observe(spark.createDataFrame(as_rows(reads), READS)).collect()}
    want = {}
    for source in range(6):
        state, _ = fold([r[1:] for r in reads if r[0] == source])
        want |= {(source, k): (s.lo, s.hi, s.started, s.pred, s.absent_since, s.gone) for k, s in state.keys.items()}
    assert got == want


def test_slots_close_once_their_time_has_passed(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    for k, moments in enumerate((["00:01", "00:20", "00:40"], ["01:30", "00:50"], ["00:02", "03:00"])):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T{m}:00Z", "event_type": "x"}) for m in moments))
        os.utime(folder / f"{k}.json", (10**9 + k, 10**9 + k))
    stream = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).json(str(folder))
    query = slot_counts(stream).writeStream.format("memory").queryName("slots").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    got = {(r.slot.strftime("%H:%M"), r.n) for r in spark.table("slots").select(F.col("slot"), "n").collect()}
    assert got >= {("00:00", 2), ("01:30", 1)} and ("00:00", 3) not in got
