import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quaverlake.functions import hashing
from quaverlake.operators import sequences as S
from tests.support import rows


def log_of(spark, events):
    """(user, minute, source_row, item)"""
    df = spark.createDataFrame([(u, t, r, i) for u, t, r, i in events], "user string, m long, source_row long, item string")
    return df.select("user", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("m").cast("int"))).alias("ts"), "source_row", "item")


def expected_windows(events, gap, window):
    out = []
    by_user = {}
    for e in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        by_user.setdefault(e[0], []).append(e)
    for user, es in by_user.items():
        run, runs, skipped, seen = [], -1, 0, False
        for _, _, _, item in es:
            if item is None:
                skipped += 1
                continue
            if not seen or (gap is not None and skipped > gap):
                run, runs = [], runs + 1
            seen, skipped = True, 0
            run.append(item)
            if len(run) >= window:
                out.append((user, runs, len(run) - window, tuple(run[-window:])))
    return sorted(out)


@pytest.mark.parametrize("gap", [0, 1, 3, None])
@pytest.mark.parametrize("block", [5, 7, 4096])
def test_windows_equal_a_state_machine_in_any_blocks(spark, gap, block):
    rng = random.Random(3)
    events = [(f"u{rng.choice([0, 0, 0, 1, 2])}", rng.randrange(4000), r, None if rng.random() < 0.35 else str(rng.randrange(9))) for r in range(400)]
    mapped = S.positions(log_of(spark, events))
    got = S.windows(mapped, gap, 5, block).select("user", "run_index", "start_index", "items")
    assert sorted((r[0], r[1], r[2], tuple(r[3])) for r in got.collect()) == expected_windows(events, gap, 5)


def test_runs_break_and_repeats_stay(spark):
    broken = [("broken", i, i, str(i)) for i in range(10)] + [("broken", 10, 10, None)] + [("broken", 11 + i, 11 + i, str(i)) for i in range(11)]
    fine = [("eligible", i, 100 + i, "1" if i in (0, 20) else str(i + 1)) for i in range(21)]
    wins = S.windows(S.positions(log_of(spark, broken + fine)), 0)
    assert wins.select("user").distinct().collect()[0][0] == "eligible" and wins.count() == 2
    judged = S.with_verdict(wins, 15, 1, 1)
    assert {r.verdict for r in judged.collect()} == {"kept"}
    chosen = S.sampled(judged, 42, 0.0, 1)
    assert chosen.count() == 1


def test_gap_thresholds(spark):
    events = [("u", i, i, str(i)) for i in range(10)] + [("u", 10, 10, None)] + [("u", 11 + i, 11 + i, str(10 + i)) for i in range(10)]
    audit = {r.threshold: r for r in S.gap_audit(S.positions(log_of(spark, events)), [0, 1, None]).collect()}
    assert 0 not in audit and audit[1].windows == 1 and audit[-1].windows == 1 and audit[1].unique_window_share == 1.0


def test_references_are_rejected_before_targets(spark):
    same = [("u", i, i, "x") for i in range(20)]
    few_targets = [("v", i, i, str(i)) for i in range(15)] + [("v", 15 + i, 15 + i, "t") for i in range(5)]
    judged = S.with_verdict(S.windows(S.positions(log_of(spark, same + few_targets)), 0))
    assert {(r.user, r.verdict) for r in judged.collect()} == {("u", "references"), ("v", "targets")}


def test_cleaning_defines_nulls_and_repeats(spark):
    ts = F.lit("2024-01-01").cast("timestamp_ntz")
    raw = spark.createDataFrame([(1, "u", " a "), (1, "u", " a "), (2, None, "b"), (None, "u", "c"), (3, "u", " ")], "source_row long, user_id string, item_id string").withColumn("played_at", ts).withColumn("user", F.lit("clash"))
    assert rows(S.clean_log(raw).select("user", "source_row", "item")) == sorted([("u", 1, "a"), ("u", 3, None)], key=repr)
    assert S.clean_log(raw.limit(0)).count() == 0
    assert S.windows(S.positions(S.clean_log(raw.limit(0))), 0).count() == 0


def test_hashes_equal_hashlib(spark):
    users = ["u1", "ünïcode", ""]
    df = spark.createDataFrame([(u,) for u in users], "u string")
    got = df.select("u", hashing.unit_interval(42, "split", F.col("u")).alias("x"), hashing.pseudonym(F.col("u"), 42).alias("p"), hashing.keyed_hash(F.col("u"), b"key").alias("k")).collect()
    import hmac

    for r in got:
        digest = hashlib.sha256(f"split\0" f"42\0{r.u}".encode()).hexdigest()
        assert r.x == int(digest[:16], 16) / 2**64
        assert r.p == hashlib.sha256(f"pseudonym\0" f"42\0{r.u}".encode()).hexdigest()[:16]
        assert r.k == hmac.new(b"key", r.u.encode(), hashlib.sha256).hexdigest()


def test_file_order_over_blocks(spark):
    rng = random.Random(5)
    events = []
    user = "a"
    for r in range(300):
        user = rng.choice("ab") if rng.random() < 0.1 else user
        events.append((user, rng.randrange(500), r, None if rng.random() < 0.2 else "i"))
    streak = contiguous = up = down = 0
    last = None
    for u, t, _, i in events:
        if last and last[0] == u:
            up, down = up + (t > last[1]), down + (t < last[1])
        streak = (streak + 1 if last and last[0] == u else 1) if i else 0
        contiguous += streak >= 3
        last = (u, t)
    for block in (1, 7, 64, 1 << 16):
        got = S.file_order_streaks(log_of(spark, events), 3, block).first()
        assert (got.contiguous_windows, got.increases, got.decreases) == (contiguous, up, down)


def test_lists(spark):
    df = spark.createDataFrame([("a", [str(i) for i in range(25)]), ("b", [str(i) for i in range(19)])], "k string, items array<string>")
    got = S.rolling(df, "k", "items", 20).orderBy("start_index").collect()
    assert [r.start_index for r in got] == list(range(6)) and got[5]["items"] == [str(i) for i in range(5, 25)]
    first = S.first_window(df, "k", "items").collect()
    assert [r.k for r in first] == ["a"] and first[0].targets == ["15", "16", "17", "18", "19"]
    steps = S.suffix_transitions(S.first_window(df, "k", "items"), "k").orderBy("step").collect()
    assert [len(r.history) for r in steps] == [15, 16, 17, 18, 19] and [r.target for r in steps] == ["15", "16", "17", "18", "19"]
