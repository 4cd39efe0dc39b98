"""Readers, writers and streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from stowage.operators import selection
from stowage.sources import files, sinks
from stowage.streaming import stateful


def test_scan_walk_and_members(spark, tmp_path):
    for p, b in {"z.txt": b"z", "a/b.TXT": b"bb", "a/c/d.bin": b"d"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    with zipfile.ZipFile(tmp_path / "a/x_001.zip", "w") as z:
        z.writestr("m/one.txt", "hello")
        z.writestr("two.txt", "there")
    (tmp_path / "a/bad.zip").write_bytes(b"not a zip")
    t = files.scan(spark, str(tmp_path))
    assert [r.relpath for r in files.walk(t).select("relpath").collect()] == ["z.txt", "a/b.TXT", "a/bad.zip", "a/x_001.zip", "a/c/d.bin"]
    assert files.scan(spark, str(tmp_path), ["txt"]).count() == 2
    assert {r.category for r in files.categories(t).collect()} == {"a"}
    assert [r.relpath for r in files.archive_list(t, "a").collect()] == ["a/bad.zip", "a/x_001.zip"]
    m = files.zip_members(files.archive_list(t, "a")).orderBy("path", "pos").collect()
    assert [(r.name, r.size) for r in m] == [(None, None), ("m/one.txt", 5), ("two.txt", 5)] and m[0].error


def test_manifests_tolerate_bad_documents(spark):
    good = json.dumps({"manifest_version": 2, "item_count": 0, "files": []})
    t = spark.createDataFrame([("a", good.encode()), ("b", b"{"), ("c", None)], "path string, content binary")
    assert {r.path: r.manifest is not None for r in files.manifests(t).collect()} == {"a": True, "b": False, "c": False}


def test_logs_and_reports(spark, tmp_path):
    p = str(tmp_path / "log")
    sinks.append_log(spark.createDataFrame([(1, "a")], "seq long, outcome string"), p)
    sinks.append_log(spark.createDataFrame([(2, "b")], "seq long, outcome string"), p)
    log = files.json_lines(spark, p, "seq long, outcome string")
    assert files.last_entry(log, "seq").first().outcome == "b"
    assert files.last_entry(log.filter("seq > 9"), "seq").count() == 0
    assert "| 1 | a |" in sinks.markdown(log, ["seq"], "Log")
    sinks.csv_report(log, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    sinks.json_report(log, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    p = str(tmp_path / "t")
    sinks.replace_table(spark.createDataFrame([(1, "a"), (2, "b")], "x long, k string"), p, ["k"])
    sinks.replace_table(spark.createDataFrame([(3, "b")], "x long, k string"), p, ["k"])
    assert {(r.x, r.k) for r in spark.read.parquet(p).collect()} == {(1, "a"), (3, "b")}


def test_append_that_dies_leaves_no_trace(spark, tmp_path):
    p = str(tmp_path / "t")
    one, two = (spark.createDataFrame([(i, k) for i in range(20)], "x long, k string").repartition(4) for k in "ab")
    assert sinks.guarded_append(one, p) >= 1 and sinks.recover(spark, p) == []
    for moves in (0, 2):
        try:
            sinks.guarded_append(two, p, stop_after=moves)
            raise AssertionError("it should stop")
        except sinks.Interrupted:
            pass
        assert len(sinks.recover(spark, p)) == moves and sinks.recover(spark, p) == []
        assert {r.k for r in spark.read.parquet(p).collect()} == {"a"} and not [f.name for f in (tmp_path / "t").iterdir() if f.name.startswith("_append")]
    try:
        sinks.guarded_append(two, p, stop_after=1)
    except sinks.Interrupted:
        sinks.guarded_append(two, p)  # rolls back first
    assert spark.read.parquet(p).groupBy("k").count().orderBy("k").collect() == [("a", 20), ("b", 20)]


def test_report_in_three_forms(spark, tmp_path):
    p = str(tmp_path / "r")
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    for _ in range(2):
        text = sinks.report(t, ["k"], "Run", p)
    assert text == (tmp_path / "r/report.md").read_text() and "| b | 2 |" in text
    assert spark.read.json(f"{p}/json").count() == spark.read.option("header", True).csv(f"{p}/csv").count() == 2
    with pytest.raises(ValueError):
        sinks.markdown(t, ["k"], "Run", most=1)


def test_text_verdict(spark):
    t = spark.createDataFrame([(None,), (b"",), (b"x" * 200,), (b"\xff\na",), (b"one",), (b"a\nb",)], "c binary")
    assert [r[0] for r in t.select(files.text_verdict(F.col("c"), 100)).collect()] == ["MISSING", "EMPTY", "TOO_LARGE", "NOT_UTF8", "TOO_FEW_ROWS", "OK"]


def test_latch_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, i, [0.5, 0.85, 0.7, 0.7, 0.6, 0.9][i * 7 % 6]) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], "key long, seq long, share double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("key long, seq long, share double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.latch_stream(s).writeStream.format("memory").queryName("latched").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.key, r.seq): r.latched for r in spark.table("latched").collect()}
    want = {(r.key, r.seq): r.latched for r in selection.latch(spark.createDataFrame(rows, "key long, seq long, share double"), "key", ["seq"], "share").collect()}
    assert got == want


def test_first_seen_and_windows(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "h1", "click", 1), ("2024-01-01 00:10:00", "h1", "click", 2), ("2024-01-01 00:20:00", "h2", "view", 3)]
    spark.createDataFrame(rows, "ts string, sha256 string, operation string, ms long").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, sha256 string, operation string, ms long").parquet(str(tmp_path / "in"))
    for name, df, mode, n in (("seen", stateful.first_seen(s), "append", 2), ("win", stateful.windowed(s), "complete", 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == n
