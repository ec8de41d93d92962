import bz2
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaverlake.operators import checks
from quaverlake.sources import readers, writers
from tests.support import rows


def test_delimited(spark, tmp_path):
    path = tmp_path / "e.tsv.bz2"
    path.write_bytes(bz2.compress(b"user_id\ttrack_id\ttimestamp\nu\tt\t2024\n"))
    assert rows(readers.delimited(spark, str(path), ["user_id", "track_id"], "\t")) == [("u", "t", "2024")]
    with pytest.raises(ValueError, match="lacks"):
        readers.delimited(spark, str(path), ["missing"], "\t")
    (tmp_path / "s.tsv").write_text("u\t2024\t7\t\nu\t2025\t8\ti\n")
    assert rows(readers.sorted_events(spark, str(tmp_path / "s.tsv"))) == [("u", "2024", 7, None), ("u", "2025", 8, "i")]


def test_playlists(spark, tmp_path):
    good, bad = tmp_path / "good.txt", tmp_path / "bad.txt"
    good.write_text("p1, a, b\n\np2,c,007\n")
    bad.write_text("p1,a,,b\n")
    assert rows(readers.playlists(spark, str(good))) == [("p1", ("a", "b")), ("p2", ("c", "007"))]
    assert rows(readers.playlists(spark, str(bad), strict=False)) == [("p1", ("a", "b"))]
    with pytest.raises(Exception, match="malformed"):
        readers.playlists(spark, str(bad)).collect()
    assert [r["item"] for r in readers.id_list(spark, str(good)).orderBy("pos").collect()] == ["a", "b", "c", "007"]
    (tmp_path / "ids.txt").write_text("x\ny\nx\n")
    assert [r["item"] for r in readers.id_list(spark, str(tmp_path / "ids.txt")).orderBy("pos").collect()] == ["x", "y"]
    parts = [readers.playlists(spark, str(good)), readers.playlists(spark, str(bad), strict=False)]
    with pytest.raises(Exception, match="repeated key"):
        readers.ordered_union(parts, "playlist_id").collect()


def test_catalogue_forms(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text(json.dumps([{"item_id": "1", "title": "T", "extra": 1, "tags": ["x"]}]))
    b.write_text(json.dumps({"2": "'So'ng' by An Artist in album'Al'", "3": {"title": "U", "tempo": 90.5}, "4": "plain"}))
    got = {r.item_id: r for r in readers.catalogue(spark, str(a)).unionByName(readers.catalogue(spark, str(b))).collect()}
    assert got["1"].title == "T" and got["1"].tags == ["x"] and got["3"].tempo == 90.5
    assert (got["2"].title, got["2"].artist, got["2"].album) == ("So'ng", "An Artist", "Al") and (got["4"].title, got["4"].artist) == ("plain", None)
    (tmp_path / "r.json").write_text('{"song-b": 1, "song-a": 0}')
    assert [r.item_id for r in readers.row_order(spark, str(tmp_path / "r.json")).orderBy("row").collect()] == ["song-a", "song-b"]


def test_side_files_and_matrices(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a1.txt").write_text("one\ntwo")
    assert rows(readers.side_files(spark, str(tmp_path / "t"))) == [("a1", "one\ntwo")]
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert rows(readers.matrix(spark, str(tmp_path / "m.npy"))) == [(0, (0.0, 1.0)), (1, (2.0, 3.0)), (2, (4.0, 5.0))]
    with pytest.raises(ValueError, match="expected"):
        readers.expecting(spark.range(3), 4)


def test_sinks(spark, tmp_path):
    writers.write_document(str(tmp_path / "d" / "x.json"), {"b": 1, "a": "ü"})
    assert json.loads((tmp_path / "d" / "x.json").read_text()) == {"a": "ü", "b": 1} and len(list((tmp_path / "d").iterdir())) == 1
    df = spark.createDataFrame([("train", "l1"), ("test", "l2")], "split_name string, line string")
    writers.write_lines(df, "line", str(tmp_path / "lines"), "split_name")
    assert rows(spark.read.text(str(tmp_path / "lines"))) == [("l1", "train"), ("l2", "test")]
    cues = spark.createDataFrame([("i", [5, 0, 9], [0.5, None, 0.25])], "item_id string, ids array<int>, s array<double>")
    names = spark.createDataFrame([(0, "<unk>"), (5, "a\tb")], "cue_id int, cue string")
    assert rows(writers.score_rows(cues, "item_id", "ids", "s", names)) == [("i", 1, 5, "a b", "0.50000000", False), ("i", 2, 0, "<unk>", "", True), ("i", 3, 9, "<missing:9>", "0.25000000", False)]
    assert writers.markdown(spark.range(1)) == "| id |\n| --- |\n| 0 |\n"
    old = spark.createDataFrame([("a",)], "k string")
    assert rows(writers.new_rows(spark.createDataFrame([("a",), ("b",)], "k string"), "k", old)) == [("b",)]


def test_publish_and_inventory(spark, tmp_path):
    (tmp_path / "f.txt").write_text("x")
    manifest = writers.publish([str(tmp_path / "f.txt")], str(tmp_path / "out"))
    inventory = checks.file_inventory(spark, str(tmp_path / "out"))
    assert inventory.first().sha256 == manifest["f.txt"]["sha256"]
    changed = inventory.withColumn("sha256", F.lit("0"))
    assert checks.changed_files(inventory, changed).first().problem == "hash" and checks.changed_files(inventory, inventory).isEmpty()
    with pytest.raises(FileExistsError):
        writers.publish([str(tmp_path / "f.txt")], str(tmp_path / "out"))
    with pytest.raises(ValueError):
        writers.publish([str(tmp_path / "f.txt")], str(tmp_path / "other"), {"f.txt": "0"})
    assert not (tmp_path / "other").exists()
