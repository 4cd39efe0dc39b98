"""Queries over files, logs, reports and streams. What they read is written into
a scratch folder first, from whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stowage.functions import columns as C
from stowage.sources import files as S
from stowage.sources import scratch, sinks
from stowage.streaming import stateful, tables

from . import fixtures as V
from .registry import query


def _document_tree(spark, d) -> str:
    """A folder a source, with the texts as lines."""
    path = scratch.folder(spark, "tree")
    V.table(spark, d, "documents").select(F.regexp_replace("text", r"[\r\n]", " ").alias("value"), F.coalesce("source", F.lit("none")).alias("source")).write.partitionBy("source").text(path)
    return path


@query("select 'source=' || coalesce(source, 'none') as category, cast(sum(strlen(text) + 1) as bigint) as bytes, true as all_files from documents group by 1")
def q_scan_categories(spark, d):
    """A tree written, walked and summed by its first folder."""
    t = S.categories(S.scan(spark, _document_tree(spark, d), ["txt"]))
    return t.groupBy("category").agg(F.sum("size").alias("bytes"), F.every(F.octet_length("content") == F.col("size")).alias("all_files"))


_KEY = "array_to_string(list_transform(string_split(relpath, '/'), lambda x, i: case when i = len(string_split(relpath, '/')) then '0' || x else '1' || x end), chr(1))"


@query(f"select relpath, row_number() over (partition by split_part(relpath, '/', 1) order by {_KEY}) as place from v_file")
def q_walk_order(spark, d):
    """Places of an ordered walk, a first folder at a time."""
    w = Window.partitionBy(F.split("relpath", "/")[0]).orderBy(C.walk_key(F.col("relpath")))
    return V.file(spark, d).select("relpath", F.row_number().over(w).cast("bigint").alias("place"))


@query("select relpath, size from v_file where ext in ('txt', 'csv')")
def q_scan_extensions(spark, d):
    return V.file(spark, d).filter(C.extension(F.col("relpath")).isin("txt", "csv")).select("relpath", "size")


@query("select 'cat' || category_id || '/' || file_name as relpath from v_archive where category_id = 7 order by 1")
def q_archive_list(spark, d):
    a = V.archive(spark, d).select(F.concat(F.lit("cat"), F.col("category_id").cast("string"), F.lit("/"), F.col("file_name")).alias("relpath"))
    return S.archive_list(a, "cat7")


@query("select event_id, event_type as operation, value from events order by event_id desc limit 1")
def q_log_last(spark, d):
    """An append log in two parts, and its last entry."""
    path = scratch.folder(spark, "log")
    t = V.table(spark, d, "events").select("event_id", F.col("event_type").alias("operation"), "value")
    for part in (0, 1):
        sinks.append_log(t.filter(F.pmod("event_id", F.lit(2)) == part), path)
    return S.last_entry(S.json_lines(spark, path, "event_id long, operation string, value double"), "event_id")


@query("select o_orderkey as id, o_orderstatus as status, case o_orderstatus when 'F' then 'second' else 'first' end as version from orders")
def q_replace_partitions(spark, d):
    """A partitioned table of which one partition is replaced."""
    path = scratch.folder(spark, "replaced")
    t = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    sinks.replace_table(t.withColumn("version", F.lit("first")), path, ["status"])
    sinks.replace_table(t.filter("status = 'F'").withColumn("version", F.lit("second")), path, ["status"])
    return spark.read.parquet(path).select("id", "status", "version")


@query("select event_id, user_id as actor, 1 as appended, true as rolled_back from events")
def q_append_recovery(spark, d):
    """One append that ends, one that dies half-way, and the table after recovery."""
    path = scratch.folder(spark, "appended")
    t = V.op(spark, d).select("event_id", "actor", F.lit(1).alias("appended"))
    sinks.guarded_append(t, path)
    try:
        sinks.guarded_append(t.withColumn("appended", F.lit(2)).repartition(4), path, stop_after=2)
    except sinks.Interrupted:
        undone = sinks.recover(spark, path)
    return spark.read.parquet(path).select("event_id", "actor", "appended", F.lit(len(undone) == 2).alias("rolled_back"))


@query("select event_type as operation, count(*) as n, cast(sum(cast(floor(value * 100) as bigint)) as bigint) as ms, 'csv' as kind from events group by 1 union all select event_type, count(*), cast(sum(cast(floor(value * 100) as bigint)) as bigint), 'json' from events group by 1")
def q_run_report(spark, d):
    """A run's report as CSV, JSON and Markdown, read back."""
    path = scratch.folder(spark, "report")
    t = V.op(spark, d).groupBy("operation").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"))
    sinks.report(t, ["operation"], "Operations", path)
    schema = "operation string, n long, ms long"
    one = spark.read.schema(schema).option("header", True).csv(f"{path}/csv").withColumn("kind", F.lit("csv"))
    return one.unionByName(spark.read.schema(schema).json(f"{path}/json").withColumn("kind", F.lit("json")))


@query("select event_id, event_type as operation, cast(floor(value * 100) as bigint) as ms from events")
def q_stream_resume(spark, d):
    """Results of a stream that stops and goes on twice, with nothing new the
    second time: each row once."""
    root = scratch.folder(spark, "resume")
    t = V.op(spark, d).select("event_id", "operation", "ms")
    for part in (0, 1, 2):
        if part < 2:
            t.filter(F.pmod("event_id", F.lit(2)) == part).write.mode("append").parquet(f"{root}/in")
        tables.resume(tables.follow(spark, f"{root}/in", "event_id long, operation string, ms long"), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@query("select event_id, event_type as operation from events")
def q_stream_log_tail(spark, d):
    """A log that grows while its tail is read."""
    root = scratch.folder(spark, "tail")
    t = V.op(spark, d).select("event_id", "operation")
    for part in (0, 1):
        sinks.append_log(t.filter(F.pmod("event_id", F.lit(2)) == part), f"{root}/log")
        tables.resume(tables.log_tail(spark, f"{root}/log", "event_id long, operation string"), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@query("select time_bucket(interval '1 hour', ts) as start, event_type as operation, count(*) as n, cast(sum(cast(floor(value * 100) as bigint)) as bigint) as ms from events group by 1, 2")
def q_stream_windows(spark, d):
    """Event-time windows of a stream, equal to those of the table."""
    root = scratch.folder(spark, "windows")
    V.op(spark, d).select("ts", "operation", "ms").write.parquet(f"{root}/in")
    tables.replace_each(stateful.windowed(tables.follow(spark, f"{root}/in", "ts timestamp, operation string, ms long")), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@query("""select min(ts) as start, max(ts) + interval '30 minutes' as stop, actor, count(*) as n from (
 select actor, ts, sum(fresh) over (partition by actor order by ts, event_id) as s from (select actor, ts, event_id, case when ts - lag(ts) over (partition by actor order by ts, event_id) < interval '30 minutes' then 0 else 1 end as fresh from v_op)) group by actor, s""")
def q_stream_sessions(spark, d):
    root = scratch.folder(spark, "sessions")
    V.op(spark, d).select("ts", "actor").write.parquet(f"{root}/in")
    tables.replace_each(tables.sessions(tables.follow(spark, f"{root}/in", "ts timestamp, actor long", per_trigger=1000)), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


@query("""select event_id, actor, coalesce(last_value(case when ms >= 8000 then true when ms <= 6500 then false end ignore nulls) over (partition by actor order by event_id rows between unbounded preceding and current row), false) as latched from v_op""")
def q_stream_latch(spark, d):
    """The latch with state kept over micro-batches, events by their number."""
    root = scratch.folder(spark, "latch")
    t = V.op(spark, d).select(F.col("actor").alias("key"), F.col("event_id").alias("seq"), (F.col("ms") / 10000.0).alias("share"))
    middle = t.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    for part in (F.col("seq") <= middle, F.col("seq") > middle):
        t.filter(part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        tables.resume(stateful.latch_stream(tables.follow(spark, f"{root}/in", "key long, seq long, share double")), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").select(F.col("seq").alias("event_id"), F.col("key").alias("actor"), "latched")


@query("select a.conv_id as clip, a.turn as position, a.text as left_text, b.text as right_text from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = b.turn + 1")
def q_stream_frames(spark, d):
    """Each turn beside the one before it: two streams joined by position."""
    root = scratch.folder(spark, "frames")
    t = V.table(spark, d, "conversations").select(F.col("conv_id").alias("clip"), F.col("turn").cast("long").alias("position"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), "text")
    t.withColumnRenamed("text", "left_text").write.parquet(f"{root}/left")
    t.withColumn("position", F.col("position") + 1).withColumnRenamed("text", "right_text").write.parquet(f"{root}/right")
    of = lambda side: tables.follow(spark, f"{root}/{side}", f"clip long, position long, ts timestamp, {side}_text string", per_trigger=1000)
    tables.resume(tables.frame_pairs(of("left"), of("right")), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").select("clip", F.col("position"), "left_text", "right_text")
