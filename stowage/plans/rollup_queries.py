"""Rollup and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.functions import columns as C
from stowage.operators import rollup as R
from stowage.operators import selection as S

from . import fixtures as V
from .registry import query

_TYPE = "case {0} % 4 when 0 then 'JPEG' when 1 then 'TEXT' when 2 then 'PNG' else 'ZIP' end"


def _type(c: str):
    m = F.col(c) % 4
    return F.when(m == 0, "JPEG").when(m == 1, "TEXT").when(m == 2, "PNG").otherwise("ZIP")


@query(f"""select f.*, c.candidates, c.accepted, c.avg_seconds, c.median_seconds, round(100.0 * (baseline_bytes - selected_bytes)::double / nullif(baseline_bytes, 0)::double, 6) as weighted_percent from (
 select {_TYPE.format('file')} as file_type, count(*) as files, cast(coalesce(sum(nullif(baseline, 0)), 0) as bigint) as baseline_bytes, cast(coalesce(sum(nullif(selected_bytes, 0)), 0) as bigint) as selected_bytes, cast(count_if(used_fallback) as bigint) as fallbacks from v_best group by 1) f
 left join (select {_TYPE.format('file')} as file_type, count(*) as candidates, cast(count_if(reason = 'ACCEPTED') as bigint) as accepted, round(avg(coalesce(s, 0)), 6) as avg_seconds, median(coalesce(s, 0))::double as median_seconds from (select *, case when pos = 7 then null else seconds end as s from v_decided) group by 1) c on f.file_type = c.file_type""")
def q_per_type_stats(spark, d):
    t = V.decided(spark, d)
    c = t.select(_type("file").alias("file_type"), F.when(F.col("pos") != 7, F.col("seconds")).alias("seconds"), (F.col("reason") == "ACCEPTED").alias("accepted"))
    return R.per_type_stats(S.select_best(t).withColumn("file_type", _type("file")), c)


@query(f"select {_TYPE.format('file')} as file_type, selected, count(*) as n from v_best group by 1, 2")
def q_win_distribution(spark, d):
    return S.select_best(V.decided(spark, d)).groupBy(_type("file").alias("file_type"), "selected").agg(F.count("*").alias("n"))


@query(f"select {_TYPE.format('file')} as file_type, cast(count_if(selected = 'generic_zstd') as bigint) as generic_zstd, cast(count_if(selected = 'generic_lzma') as bigint) as generic_lzma, cast(count_if(selected = 'generic_brotli') as bigint) as generic_brotli, cast(count_if(selected = 'generic_zlib') as bigint) as generic_zlib, cast(count_if(selected = 'baseline_zip') as bigint) as baseline_zip from v_best group by 1")
def q_win_pivot(spark, d):
    names = ["generic_zstd", "generic_lzma", "generic_brotli", "generic_zlib", "baseline_zip"]
    p = S.select_best(V.decided(spark, d)).groupBy(_type("file").alias("file_type")).pivot("selected", names).agg(F.count(F.lit(1)))
    return p.select("file_type", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


@query("""select file, pos, bucket from (select *, row_number() over (partition by bucket order by file, pos) as r from (
 select file, pos, 'low_benefit' as bucket from v_decided where baseline > 1000000 and (baseline - candidate) > 0 and (baseline - candidate) * 100 < 3 * baseline and baseline - candidate > 100000
 union all select file, pos, 'high_benefit' from v_decided where baseline > 1000000 and (baseline - candidate) * 10 >= baseline union all select file, pos, 'cost' from v_decided where reason = 'COST_NOT_JUSTIFIED_BY_BENEFIT')) where r <= 15""")
def q_report_buckets_top15(spark, d):
    saved = "(baseline - candidate)"
    buckets = {"low_benefit": f"baseline > 1000000 and {saved} > 0 and {saved} * 100 < 3 * baseline and {saved} > 100000", "high_benefit": f"baseline > 1000000 and {saved} * 10 >= baseline", "cost": "reason = 'COST_NOT_JUSTIFIED_BY_BENEFIT'"}
    return R.top_per_bucket(V.decided(spark, d).select("file", "pos", "baseline", "candidate", "reason"), buckets, ["file", "pos"]).select("file", "pos", "bucket")


@query("select count(*) as files, cast(sum(baseline) as bigint) as baseline_bytes, cast(sum(selected_bytes) as bigint) as selected_bytes, round(100.0 * sum(baseline - selected_bytes)::double / sum(baseline)::double, 6) as improvement_percent, cast(count_if(used_fallback) as bigint) as fallbacks, (select cast(count_if(reason = 'EXCEEDS_ABSOLUTE_TIMEOUT') as bigint) from v_decided) as timeouts, (select cast(count_if(reason = 'SHA256_MISMATCH') as bigint) from v_decided) as mismatches from v_best")
def q_overview(spark, d):
    t = V.decided(spark, d)
    b = S.select_best(t).agg(F.count("*").alias("files"), F.sum("baseline").alias("baseline_bytes"), F.sum("selected_bytes").alias("selected_bytes"), F.round(100.0 * F.sum("saved_bytes") / F.sum("baseline"), 6).alias("improvement_percent"), F.count_if("used_fallback").alias("fallbacks"))
    return b.crossJoin(t.agg(F.count_if(F.col("reason") == "EXCEEDS_ABSOLUTE_TIMEOUT").alias("timeouts"), F.count_if(F.col("reason") == "SHA256_MISMATCH").alias("mismatches")))  # one row each


@query("""select b.file, c.strategy, c.bytes, case when c.strategy = b.selected then 'YES' else '' end as winner from v_best b join (
 select file, strategy, candidate as bytes from v_decided where file % 10 <> 0 and pos > 1 union all select file, null, null from v_best where file % 10 = 0
 union all select file, 'baseline_zip', baseline from v_best where file % 10 <> 0 and file not in (select file from v_decided where pos > 1)) c on b.file = c.file""")
def q_explode_candidates(spark, d):
    t = V.decided(spark, d)
    lists = t.filter("pos > 1").groupBy("file").agg(F.collect_list(F.struct("strategy", F.col("candidate").alias("bytes"))).alias("candidates"))
    best = S.select_best(t).select("file", "selected", "baseline", (F.col("file") % 10 == 0).alias("skipped"))
    return R.explode_candidates(best.join(lists, "file", "left"))


@query(f"""select {_TYPE.format('archive_id')} as file_type, coalesce(strategy, 'baseline_zip') as strategy, count(*) as file_count, cast(sum(original_size) as bigint) as original_bytes, cast(sum(compressed_size) as bigint) as stored_bytes, cast(greatest(sum(original_size) - sum(compressed_size), 0) as bigint) as saved_bytes,
 round(avg(100.0 * (original_size - compressed_size)::double / nullif(original_size, 0)::double), 6) as avg_saving_percent, round(min(100.0 * (original_size - compressed_size)::double / nullif(original_size, 0)::double), 6) as min_saving_percent, round(max(100.0 * (original_size - compressed_size)::double / nullif(original_size, 0)::double), 6) as max_saving_percent,
 round(avg(original_size % 500), 6) as avg_ms, min(original_size % 500) as min_ms, max(original_size % 500) as max_ms from v_item group by 1, 2""")
def q_metrics_rollup(spark, d):
    return R.metrics_rollup(V.item(spark, d).select(_type("archive_id").alias("file_type"), "strategy", F.col("original_size").alias("original"), F.col("compressed_size").alias("stored"), (F.col("original_size") % 500).alias("ms")))


@query("select event_id, case operation when 'click' then 'checkout' when 'view' then 'verify' else 'archive' end || case when k % 9 = 0 then '_failed' else '_completed' end as event, ms as duration_ms, case when k % 9 = 0 then 'UNEXPECTED_ERROR' else 'OK' end as reason, ms - k * 100 as saved from v_op")
def q_operation_events(spark, d):
    op = F.when(F.col("operation") == "click", "checkout").when(F.col("operation") == "view", "verify").otherwise("archive")
    bad = F.col("k") % 9 == 0
    return V.op(spark, d).select("event_id", F.concat(op, F.when(bad, "_failed").otherwise("_completed")).alias("event"), F.col("ms").alias("duration_ms"), F.when(bad, "UNEXPECTED_ERROR").otherwise("OK").alias("reason"), (F.col("ms") - F.col("k") * 100).alias("saved"))


@query(f"select {_TYPE.format('file')} as file_type, strategy, cast(sum(seconds) as bigint) as total from v_decided group by 1, 2 order by 3 desc, 1, 2 limit 1")
def q_worst_strategy(spark, d):
    return R.worst(V.decided(spark, d).withColumn("file_type", _type("file")), ["file_type", "strategy"], "seconds")


@query("select coalesce(strategy, 'baseline_zip') as strategy, count(*) as n, round(coalesce(100.0 * sum(original_size - compressed_size)::double / nullif(sum(original_size), 0)::double, 0), 3) as saved_percent from v_item group by 1")
def q_strategy_counts(spark, d):
    t = V.item(spark, d).groupBy(F.coalesce("strategy", F.lit("baseline_zip")).alias("strategy"))
    return t.agg(F.count("*").alias("n"), F.round(F.coalesce(100.0 * F.sum(F.col("original_size") - F.col("compressed_size")) / F.nullif(F.sum("original_size"), F.lit(0)), F.lit(0.0)), 3).alias("saved_percent"))


@query("""select count(*) as files, count(b.file) as seen_before, cast(coalesce(sum(b.sb), 0) as bigint) as bytes_before, cast(sum(a.selected_bytes) as bigint) as bytes_after, cast(coalesce(sum(b.n), 0) as bigint) as accepted_before, cast(sum(n2) as bigint) as accepted_after, cast(count_if(a.selected_bytes < b.sb) as bigint) as improved from (select v_best.*, n2 from v_best join (select file, count_if(reason = 'ACCEPTED') as n2 from v_decided group by 1) using (file)) a
 left join (select file, min(baseline) as sb, count_if(reason = 'ACCEPTED' and pos <= 2) as n from v_decided where file % 3 <> 0 group by 1) b on a.file = b.file""")
def q_before_after(spark, d):
    """Both results of a file come from one aggregate over its candidates."""
    ok, seen = F.col("reason") == "ACCEPTED", F.col("file") % 3 != 0
    t = S.select_best(V.decided(spark, d), F.count_if(ok).alias("accepted"), F.min("baseline").alias("b"), F.count_if(ok & (F.col("pos") <= 2)).alias("bn"))
    return R.compared_totals(t.select("file", "selected_bytes", "accepted", *[F.when(seen, F.col(c)).alias(c) for c in ("b", "bn")]))


@query("select strategy, cast(count_if(sha_ok) as bigint) as passed, count(*) as n, round(avg(case when sha_ok then seconds end), 6) as avg_seconds, round(avg(case when sha_ok then candidate end) / 1e6, 6) as avg_mb from v_decided group by 1")
def q_strategy_averages(spark, d):
    ok = lambda c: F.avg(F.when(F.col("sha_ok"), F.col(c)))
    return V.decided(spark, d).groupBy("strategy").agg(F.count_if("sha_ok").alias("passed"), F.count("*").alias("n"), F.round(ok("seconds"), 6).alias("avg_seconds"), F.round(ok("candidate") / 1e6, 6).alias("avg_mb"))


@query("select count(*) as files, round(avg(p), 6) as avg_percent, round(median(p), 6) as median_percent, arg_max(file, (round(p, 9), -file)) as best_file, arg_min(file, (round(p, 9), file)) as worst_file, cast(count_if(selected_bytes < baseline) as bigint) as wins, round(100.0 * sum(baseline - selected_bytes)::double / sum(baseline)::double, 6) as overall_percent from (select *, 100.0 * (baseline - selected_bytes)::double / nullif(baseline, 0)::double as p from v_best)")
def q_corpus_summary(spark, d):
    p = 100.0 * (F.col("baseline") - F.col("selected_bytes")) / F.nullif(F.col("baseline"), F.lit(0))
    t = S.select_best(V.decided(spark, d)).withColumn("p", p).withColumn("q", F.round("p", 9))
    return t.agg(F.count("*").alias("files"), F.round(F.avg("p"), 6).alias("avg_percent"), F.round(F.median("p"), 6).alias("median_percent"), F.max_by("file", F.struct("q", -F.col("file"))).alias("best_file"), F.min_by("file", F.struct("q", "file")).alias("worst_file"), F.count_if(F.col("selected_bytes") < F.col("baseline")).alias("wins"), F.round(100.0 * F.sum("saved_bytes") / F.sum("baseline"), 6).alias("overall_percent"))


@query("select file, min(candidate) as best_bytes, arg_min(strategy, (candidate, pos)) as best, min(case when strategy not in ('generic_brotli', 'generic_zlib') then candidate end) as best_generic from v_decided group by 1")
def q_rowwise_best(spark, d):
    off = F.col("strategy").isin("generic_brotli", "generic_zlib")
    return V.decided(spark, d).groupBy("file").agg(F.min("candidate").alias("best_bytes"), F.min_by("strategy", F.struct("candidate", "pos")).alias("best"), F.min(F.when(~off, F.col("candidate"))).alias("best_generic"))


@query("select strategy, bool_or(not sha_ok) as any_mismatch from v_decided group by 1")
def q_any_mismatch(spark, d):
    return V.decided(spark, d).groupBy("strategy").agg(F.bool_or(~F.col("sha_ok")).alias("any_mismatch"))


@query("select archive_id, case when count_if(s is null) = 0 then cast(sum(s) as bigint) end as total from (select archive_id, case when original_size % 37 = 0 then null else original_size end as s from v_item) group by 1")
def q_sum_null_poison(spark, d):
    t = V.item(spark, d).select("archive_id", F.when(F.col("original_size") % 37 != 0, F.col("original_size")).alias("s"))
    return R.null_if_any_null(t, "archive_id", "s")


@query("select b.file, b.selected, c.strategy, c.bytes, cast(b.baseline - b.selected_bytes as bigint) as saved_bytes, b.selected = 'baseline_zip' as is_baseline from v_best b left join (select file, arg_max(strategy, pos) as strategy, arg_max(candidate, pos) as bytes from v_decided where sha_ok group by 1) c on b.file = c.file")
def q_strategy_log(spark, d):
    t = V.decided(spark, d)
    best = S.select_best(t)
    log = R.latest_before(t.filter("sha_ok").select("file", F.col("pos").alias("seq"), "strategy", F.col("candidate").alias("bytes")), best.select("file", F.col("selected")))
    return log.join(best.select("file", "saved_bytes", (F.col("selected") == "baseline_zip").alias("is_baseline")), "file")


@query("select item_key, round(100.0 * (r - compressed_size)::double / nullif(r, 0)::double, 2) as pct from (select *, case line when 1 then 0 when 2 then null else original_size end as r from v_item)")
def q_pct_null_safe(spark, d):
    r = F.when(F.col("line") == 1, 0).when(F.col("line") > 2, F.col("original_size"))
    return V.item(spark, d).select("item_key", C.percent_saved(r, F.col("compressed_size")).alias("pct"))


@query("""select id, case when x < 1024 then printf('%.2f B', x) when x < 1048576 then cast(cast(round(x / 1024, 2) as decimal(20, 2)) as varchar) || ' KB' when x < 1073741824 then cast(cast(round(x / 1048576, 2) as decimal(20, 2)) as varchar) || ' MB' when x < 1099511627776 then cast(cast(round(x / 1073741824, 2) as decimal(20, 2)) as varchar) || ' GB' else cast(cast(round(x / 1099511627776, 2) as decimal(20, 2)) as varchar) || ' TB' end as shown
 from (select id, (current_size * case id % 5 when 0 then 1 when 1 then 1000 when 2 then 1000000 when 3 then 100000000 else 0 end)::double as x from v_archive)""")
def q_format_bytes(spark, d):
    m = F.col("id") % 5
    n = F.col("current_size") * F.when(m == 0, 1).when(m == 1, 1000).when(m == 2, 1000000).when(m == 3, 100000000).otherwise(0)
    return V.archive(spark, d).select("id", C.format_bytes(n).alias("shown"))


@query("""select f.id, s.strategy, round(100.0 * (f.base - b)::double / nullif(f.base, 0)::double, 2) as vs_baseline, round(100.0 * (f.size - b)::double / nullif(f.size, 0)::double, 2) as vs_original from (select id, current_size as size, current_size * 9 // 10 as base from v_archive) f, (values ('baseline_zip', 0, 0), ('generic_zstd', 100, 1), ('generic_lzma', 200000, 2)) s(strategy, least, cut), lateral (select f.base * (10 - s.cut) // 10 as b) where f.size >= s.least""")
def q_benchmark_matrix(spark, d):
    strategies = F.broadcast(spark.createDataFrame([("baseline_zip", 0, 0), ("generic_zstd", 100, 1), ("generic_lzma", 200_000, 2)], "strategy string, least long, cut long"))  # a row per strategy
    f = V.archive(spark, d).select("id", F.col("current_size").alias("size"), F.expr("current_size * 9 div 10").alias("base"))
    t = f.join(strategies, f["size"] >= strategies["least"]).withColumn("b", F.expr("base * (10 - cut) div 10"))
    return t.select("id", "strategy", C.percent_saved(F.col("base"), F.col("b")).alias("vs_baseline"), C.percent_saved(F.col("size"), F.col("b")).alias("vs_original"))


# beyond the archive domain's own reports


@query("select r_name as grp, n_name as name, count(*) as archives, cast(sum(o_totalprice * 100) as bigint) as cents, cast(grouping_id(r_name, n_name) as bigint) as level from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)".replace("cast(sum(o_totalprice * 100) as bigint)", "cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint)"))
def x_rollup_regions(spark, d):
    c = V.category(spark, d).select(F.col("id").alias("c_nationkey"), "name", "grp")
    o, cu = V.table(spark, d, "orders"), V.table(spark, d, "customer")
    t = o.join(cu, o.o_custkey == cu.c_custkey).join(c, "c_nationkey")
    return t.rollup("grp", "name").agg(F.count("*").alias("archives"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"), F.grouping_id().alias("level"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type as operation, count(*) as n, cast(sum(cast(floor(value * 100) as bigint)) as bigint) as ms from events group by 1, 2")
def x_hourly_operations(spark, d):
    t = V.op(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "operation").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"))
    return t.select(F.col("w.start").alias("start"), "operation", "n", "ms")
