import random

import pytest
from pyspark.sql import functions as F

from quaverlake.operators import metrics, retrieval, sequences, tokens
from quaverlake.plans.protocol import Protocol, cue_counts, expected_counts, identity, thresholds
from quaverlake.streaming.runs import advance, stream_windows
from tests.support import rows


@pytest.fixture(scope="module")
def catalogue(spark):
    data = [("10", [1.0, 0.0]), ("30", [0.9, 0.1]), ("50", [0.0, 1.0]), ("90", [-1.0, 0.0])]
    return spark.createDataFrame(data, "item_id string, emb array<double>")


def test_expand(spark, catalogue):
    lists = spark.createDataFrame([("p", ["10", "10", "bad"]), ("none", ["bad"]), ("full", ["90", "50", "30", "10"])], "k string, items array<string>")
    got = {}
    for r in retrieval.expand(lists, "k", "items", catalogue, "item_id", "emb", 3, 2).orderBy("k", "place").collect():
        got.setdefault(r.k, []).append((r["item"], r.source))
    assert got == {"p": [("10", "given"), ("30", "padded"), ("50", "padded")], "full": [("90", "given"), ("50", "given"), ("30", "given")]}


def test_select_and_hybrid(spark, catalogue):
    lists = spark.createDataFrame([("a", ["10", "30", "50", "90"], [0.0, 1.0]), ("b", ["30"], None), ("c", [], [1.0, 0.0])], "k string, items array<string>, text array<double>")
    chosen = {}
    for r in retrieval.select_items(lists, "k", "items", catalogue, "item_id", "emb", 2, dims=2).orderBy("k", "place").collect():
        chosen.setdefault(r.k, []).append(r["item"])
    assert chosen == {"a": ["10", "90"], "b": ["30"]}
    mixed = {}
    for r in retrieval.hybrid(lists, "k", "items", "text", catalogue, "item_id", "emb", 2, 2).orderBy("k", "place").collect():
        mixed.setdefault(r.k, []).append((r["item"], r.source))
    assert mixed == {"a": [("10", "seed"), ("30", "seed")], "b": [("30", "seed"), ("10", "padded")], "c": [("10", "text"), ("30", "text")]}


def test_lookup_by_code(spark, catalogue):
    coded = catalogue.withColumn("codes", F.array(F.col("item_id").cast("int")))
    asked = spark.createDataFrame([("x", [50], [1.0, 0.0]), ("y", [77], [-1.0, 0.1])], "k string, codes array<int>, v array<double>")
    assert rows(retrieval.by_code(asked, "k", "codes", "v", coded, "item_id", "codes", "emb", 2), "k", "item", "how") == [("x", "50", "direct"), ("y", "90", "nearest")]


def test_samples_don_t_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    assert len({tuple(rows(retrieval.sample(df.repartition(n), "k", 20))) for n in (1, 3, 9)}) == 1
    assert retrieval.sample(df.limit(0), "k", 20).count() == 0


def test_draws_and_padding(spark):
    df = spark.createDataFrame([("a", 0.2), ("a", 0.6), ("b", 0.5)], "k string, x double")
    got = {r.k: r for r in metrics.draws(df, "k", "x").collect()}
    assert (got["a"].best, got["a"].worst, round(got["a"].mean, 6), round(got["a"].variance, 6)) == (0.6, 0.2, 0.4, 0.08) and got["b"].variance is None
    seq = spark.createDataFrame([("g", "a", [1, 2, 3]), ("g", "b", [4]), ("h", "c", [])], "g string, k string, t array<int>")
    assert rows(tokens.padded(seq, "g", "t").select("k", "t", "mask")) == [("a", (1, 2, 3), (True, True, True)), ("b", (4, 0, 0), (True, False, False)), ("c", (), ())]


def test_protocol():
    assert Protocol().validate({"window": 20, "other": 1}) == Protocol()
    with pytest.raises(ValueError, match="frozen"):
        Protocol().validate({"references": 10})
    assert Protocol().validate({"references": 10, "targets": 10}, True).targets == 10
    with pytest.raises(ValueError):
        Protocol().validate({"references": 10}, True)
    assert cue_counts(["a=0", "b=8"]) == {"a": 0, "b": 8} and thresholds("all,5,0") == (0, 5, None)
    for bad in (["a"], ["a=-1"], ["a=1", "a=2"]):
        with pytest.raises(ValueError):
            cue_counts(bad)
    assert expected_counts({"splits": {"val": 3}}, {"train": 1, "val": 2}) == {"train": 1, "val": 3}
    assert identity({"b": 1, "a": 2, "created": 5}) == identity({"a": 2, "b": 1}) != identity({"a": 2, "b": 3})


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(11)
    events = [(f"u{rng.choice([0, 0, 1])}", i * 60, i, None if rng.random() < 0.3 else str(rng.randrange(9))) for i in range(200)]
    source, sink = tmp_path / "in", tmp_path / "out"
    schema = "user string, ts timestamp_ntz, source_row long, item string"
    as_frame = lambda part: spark.createDataFrame(part, "user string, s long, source_row long, item string").select("user", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("s").cast("decimal(18,6)"))).alias("ts"), "source_row", "item")
    as_frame(events).coalesce(1).write.parquet(str(source))
    query = stream_windows(spark.readStream.schema(schema).parquet(str(source)), 1, 4).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(sink))
    query.awaitTermination(120)
    whole = spark.read.parquet(str(sink))
    assert whole.where("kind <> 'window'").isEmpty()
    got = whole.where("kind = 'window'").select("user", "run_index", "start_index", "items")
    want = sequences.windows(sequences.positions(as_frame(events)), 1, 4).select("user", "run_index", "start_index", "items")
    assert rows(got) == rows(want) and got.count() > 20
    state, out = ([], -1, 0, 0, -(1 << 62), -1), []
    for e in [x for x in events if x[0] == "u0"]:
        state, done = advance(state, [(e[1], e[2], e[3])], 1, 4)
        out += done
    again, late = advance(state, [(0, 0, "early")], 1, 4)
    assert len(out) == got.where("user = 'u0'").count() and late == [("late", state[1], state[2], 0, ["early"])] and again == state
