"""Selection: routes, policy, arg-min, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import columns as C
from stowage.functions import constants as K
from stowage.operators import selection as S

from . import fixtures as V
from .registry import query

#: Types and extensions for routing, dealt out by part key.
_KINDS = [("JPEG", "jpg"), ("PNG", "png"), ("BMP", "bmp"), ("WEBP", "webp"), ("OOXML_ZIP", "xlsx"), ("BINARY_UNKNOWN", "jpeg"), ("BINARY_UNKNOWN", "mp4"), ("TEXT", "txt"), ("ELF_OR_PE", "exe"), ("SQL", "sql"), ("JSON", "json")]
_SQL_FILES = "(select p_partkey as id, " + "case p_partkey % 11 " + " ".join(f"when {i} then '{k}'" for i, (k, _) in enumerate(_KINDS)) + " end as kind, case p_partkey % 11 " + " ".join(f"when {i} then '{e}'" for i, (_, e) in enumerate(_KINDS)) + " end as ext, cast(floor(p_retailprice * p_size * 500) as bigint) as size from part) f"
_SQL_ROUTE = """case when ext in ('mp4','mkv','mov','avi','webm','m4v','mpg','mpeg') then 'video' when kind = 'JPEG' or (kind = 'BINARY_UNKNOWN' and ext in ('jpg','jpeg')) then case when size >= 15728640 then 'jpeg_large' else 'jpeg' end
 when kind in ('WEBP','AVIF','HEIC') then 'cheap' when kind = 'BMP' then case when size >= 15728640 then 'bmp_large' when size >= 32768 then 'bmp' else 'cheap' end
 when kind in ('PNG','TIFF','GIF') then case when size >= 32768 then 'full' else 'cheap' end when kind = 'OOXML_ZIP' and ext = 'xlsx' then 'xlsx' else 'cheap' end"""
_SQL_LIST = """case route when 'video' then ['video_optimizer'] when 'cheap' then ['generic_zstd'] when 'full' then ['generic_zstd','generic_brotli','generic_lzma','generic_zlib'] when 'jpeg' then ['generic_zstd','generic_brotli','generic_lzma','generic_zlib','jpeg_xl_lossless_jpeg']
 when 'jpeg_large' then ['generic_zstd','generic_zlib','jpeg_xl_lossless_jpeg'] when 'bmp' then ['generic_zstd','generic_brotli','generic_lzma','generic_zlib','bmp_jxl_lossless'] when 'bmp_large' then ['generic_zstd','generic_zlib','bmp_jxl_lossless'] else ['generic_zstd','preflate_ooxml'] end"""
_SQL_ROUTED = f"(select id, kind, ext, size, route, unnest(range(len(l))) as pos, unnest(l) as strategy from (select *, {_SQL_LIST} as l from (select *, {_SQL_ROUTE} as route from {_SQL_FILES})))"


def _files(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_partkey") % len(_KINDS)
    kind = ext = None
    for i, (k, e) in enumerate(_KINDS):
        kind = F.when(m == i, k) if kind is None else kind.when(m == i, k)
        ext = F.when(m == i, e) if ext is None else ext.when(m == i, e)
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), ext.alias("ext"), V.floor_long(F.col("p_retailprice") * F.col("p_size") * 500).alias("size"))


@query("""select file, baseline, selected, selected_bytes, used_fallback, baseline - selected_bytes as saved_bytes, round(case when baseline = 0 then 0.0 else 100.0 * (baseline - selected_bytes)::double / baseline::double end, 3) as saved_percent from v_best""")
def q_select_best(spark, d):
    return S.select_best(V.decided(spark, d)).select("file", "baseline", "selected", "selected_bytes", "used_fallback", "saved_bytes", "saved_percent")


@query("select seq, relpath, size from v_file where size >= 4096")
def q_tiny_prefilter(spark, d):
    return S.attempted(V.file(spark, d)).select("seq", "relpath", "size")


@query(f"select id, route, cast(pos as bigint) as pos, strategy from {_SQL_ROUTED}")
def q_route_candidates(spark, d):
    return S.routed(_files(spark, d)).select("id", "route", F.col("pos").cast("bigint").alias("pos"), "strategy")


_RULES = [("BMP", 0, K.TIER, "cheap"), ("BMP", K.TIER, K.LARGE, "bmp"), ("BMP", K.LARGE, 1 << 62, "bmp_large"), ("PNG", 0, K.TIER, "cheap"), ("PNG", K.TIER, 1 << 62, "full"), ("JPEG", 0, K.LARGE, "jpeg"), ("JPEG", K.LARGE, 1 << 62, "jpeg_large"), ("WEBP", 0, 1 << 62, "cheap")]


@query(f"select id, kind, size, route from {_SQL_FILES} join (values {', '.join(map(str, _RULES))}) r(k, lo, hi, route) on f.kind = r.k and f.size >= r.lo and f.size < r.hi")
def q_route_range_join(spark, d):
    rules = F.broadcast(spark.createDataFrame(_RULES, "k string, lo long, hi long, route string"))  # one row per rule
    f = _files(spark, d)
    return f.join(rules, (f.kind == rules.k) & (f["size"] >= rules.lo) & (f["size"] < rules.hi)).select("id", "kind", "size", "route")


@query(f"""select id, ext, size, strategy from (select id, ext, size, unnest(l) as strategy from (select *, case when size >= 12000000 and ext in ('txt','jpg','sql','exe','dll','bin','json','py','js') then list_filter(o, lambda x: x not in ('generic_lzma', 'lzma_x86')) else o end as l from (
 select *, case ext when 'txt' then ['zstd_long_range_v2','brotli_q9','generic_zstd','generic_lzma'] when 'jpg' then ['jpeg_xl_lossless_jpeg','generic_zstd'] when 'sql' then ['generic_lzma'] when 'exe' then ['lzma_x86'] when 'json' then ['generic_zstd','generic_lzma']
 when 'png' then [] when 'xlsx' then [] else {_SQL_LIST} end as o from (select *, {_SQL_ROUTE} as route from {_SQL_FILES}))))""")
def q_route_overlay(spark, d):
    return S.routed(_files(spark, d), overlay=True).select("id", "ext", "size", "strategy")


@query(f"select id, strategy from {_SQL_ROUTED} where strategy not in ('generic_brotli', 'generic_zlib')")
def q_route_disabled_except(spark, d):
    off = F.broadcast(spark.createDataFrame([(K.BROTLI,), (K.ZLIB,)], "strategy string"))
    return S.routed(_files(spark, d)).join(off, "strategy", "left_anti").select("id", "strategy")


@query(f"select id, strategy from {_SQL_ROUTED} where strategy in ('generic_zstd', 'generic_lzma', 'generic_zlib')")
def q_route_available_semi(spark, d):
    there = F.broadcast(spark.createDataFrame([(K.ZSTD,), (K.LZMA,), (K.ZLIB,)], "strategy string"))
    return S.routed(_files(spark, d)).join(there, "strategy", "left_semi").select("id", "strategy")


@query("select strategy, case when strategy in ('generic_brotli', 'generic_lzma') then 30.0 else 90.0 end::double as timeout_s, cast(count_if(seconds > case when strategy in ('generic_brotli', 'generic_lzma') then 30.0 else 90.0 end) as bigint) as timed_out, count(*) as n from v_decided group by 1, 2")
def q_timeout_class(spark, d):
    t = V.decided(spark, d).withColumn("timeout_s", C.probe_timeout(F.col("strategy")))
    return t.groupBy("strategy", "timeout_s").agg(F.count_if(F.col("seconds") > F.col("timeout_s")).alias("timed_out"), F.count("*").alias("n"))


@query("select file, pos, baseline, candidate, seconds, sha_ok, reason from v_decided")
def q_policy_decision(spark, d):
    return V.decided(spark, d).select("file", "pos", "baseline", "candidate", "seconds", "sha_ok", "reason")


@query("""select case status when 'FAIL_HASH_MISMATCH' then 'SHA256_MISMATCH' when 'ERROR' then 'EXCEPTION' when 'TIMEOUT' then 'TIMEOUT' when 'SKIPPED_UNAVAILABLE' then 'UNAVAILABLE' else reason end as final_reason, count(*) as n
 from (select reason, case when not sha_ok then 'FAIL_HASH_MISMATCH' when seconds > 200 then 'ERROR' when seconds > 90 then 'TIMEOUT' when pos = 7 then 'SKIPPED_UNAVAILABLE' else 'PASS' end as status from v_decided) group by 1""")
def q_rejection_reasons(spark, d):
    status = F.when(~F.col("sha_ok"), "FAIL_HASH_MISMATCH").when(F.col("seconds") > 200, "ERROR").when(F.col("seconds") > 90, "TIMEOUT").when(F.col("pos") == 7, "SKIPPED_UNAVAILABLE").otherwise("PASS")
    names = F.create_map(*[F.lit(x) for kv in K.REJECTIONS.items() for x in kv])
    return V.decided(spark, d).groupBy(F.coalesce(F.element_at(names, status), F.col("reason")).alias("final_reason")).agg(F.count("*").alias("n"))


_SCENARIOS = [("mismatch", 1_000_000, 900_000, 500_000, 0.15, False), ("not_smaller", 1_000_000, 900_000, 950_000, 0.02, True), ("small", 8000, 8000, 7960, 0.002, True), ("large", 2147483648, 2147483648, 2126512128, 7.5, True), ("worth_it", 20_000_000, 20_000_000, 7_800_000, 16.0, True), ("slow", 50_000_000, 50_000_000, 47_500_000, 60.0, True), ("timeout", 50_000_000, 50_000_000, 10_000_000, 90.5, True), ("empty", 0, 0, 0, 0.0, True)]


@query("select * from (values ('mismatch', 'SHA256_MISMATCH'), ('not_smaller', 'NOT_SMALLER_THAN_BASELINE'), ('small', 'BENEFIT_TOO_SMALL'), ('large', 'ACCEPTED'), ('worth_it', 'ACCEPTED'), ('slow', 'COST_NOT_JUSTIFIED_BY_BENEFIT'), ('timeout', 'EXCEEDS_ABSOLUTE_TIMEOUT'), ('empty', 'NOT_SMALLER_THAN_BASELINE')) v(scenario, reason)")
def q_policy_scenarios(spark, d):
    t = spark.createDataFrame(_SCENARIOS, "scenario string, original long, baseline long, candidate long, seconds double, sha_ok boolean")
    return t.select("scenario", C.policy_reason(*[F.col(c) for c in ("original", "baseline", "candidate", "seconds", "sha_ok")]).alias("reason"))


@query(f"""select strategy, case when strategy in ('jpeg_xl_lossless_jpeg','bmp_jxl_lossless','generic_brotli','generic_lzma') then 'HEAVY' when strategy in ('generic_zstd','generic_zlib','preflate_ooxml','video_optimizer') then 'LIGHT' when size < 4194304 then 'LIGHT' else 'MEDIUM' end as weight, count(*) as n,
 cast(sum(case strategy when 'jpeg_xl_lossless_jpeg' then greatest(150000000, cast(floor(size * (1137000000.0::double / 39274002.0::double)) as bigint) + 60000000) when 'bmp_jxl_lossless' then greatest(150000000, cast(floor(size * (598600000.0::double / 147000054.0::double) * 1.3::double) as bigint))
 when 'generic_brotli' then greatest(100000000, 3 * size) when 'generic_lzma' then greatest(100000000, 3 * size) when 'preflate_ooxml' then greatest(40000000, 4 * size) when 'video_optimizer' then 80000000 else least(size, 32000000) + 20000000 end) as bigint) as ram from {_SQL_ROUTED} group by 1, 2""")
def q_weight_class(spark, d):
    t = S.routed(_files(spark, d))
    return t.groupBy("strategy", C.weight_class(F.col("strategy"), F.col("size")).alias("weight")).agg(F.count("*").alias("n"), F.sum(C.ram_estimate(F.col("strategy"), F.col("size"))).alias("ram"))


@query("""select event_id, case when actor % 5 = 0 then 'LIGHT_ALWAYS_ADMITTED' when 8 - actor % 9 < 2 then 'INSUFFICIENT_FREE_CORES' when ms >= 8500 then 'PROJECTED_RAM_OVER_WATERMARK' when k * 40 > 3000 then 'PROCESS_MEMORY_OVER_THRESHOLD' when event_id % 100 > 90 then 'DISK_PRESSURE_OVER_THRESHOLD' else 'ADMITTED_FREE_CORES_AVAILABLE' end as reason from v_op""")
def q_admission_gate(spark, d):
    weight = F.when(F.col("actor") % 5 == 0, "LIGHT").otherwise("HEAVY")
    return V.op(spark, d).select("event_id", C.admission(weight, 8 - F.col("actor") % 9, F.col("ms") / 10000.0, (F.col("k") * 40).cast("double"), (F.col("event_id") % 100).cast("double")).alias("reason"))


@query("""select event_id, actor, coalesce(last_value(case when ms >= 8000 then true when ms <= 6500 then false end ignore nulls) over (partition by actor order by ts, event_id rows between unbounded preceding and current row), false) as latched from v_op""")
def q_hysteresis_latch(spark, d):
    return S.latch(V.op(spark, d).withColumn("share", F.col("ms") / 10000.0), "actor", ["ts", "event_id"], "share").select("event_id", "actor", "latched")


@query(f"select id, strategy, round(case when strategy in ('jpeg_xl_lossless_jpeg', 'bmp_jxl_lossless') and size > 0 then greatest(30.0, size / 1048576.0 * (90.0 / (147000054 / 1048576.0::double))) else 30.0 end::double, 6) as timeout_s from {_SQL_ROUTED}")
def q_restore_timeout(spark, d):
    return S.routed(_files(spark, d)).select("id", "strategy", F.round(C.restore_timeout(F.col("strategy"), F.col("size")), 6).alias("timeout_s"))


@query(f"select id, case when size < 4194304 then 19 else 12 end::int as level, case when size >= 20971520 then 2 else 1 end::int as threads from {_SQL_FILES}")
def q_level_tier(spark, d):
    return _files(spark, d).select("id", C.zstd_level(F.col("size")).alias("level"), C.zstd_threads(F.col("size")).alias("threads"))


@query("""select r.seq, case when k.size is null then 'miss' when k.strategy is null then 'negative_hit' else 'hit' end as outcome, k.strategy from v_file r left join (
 select size, sha256, max(case when seq % 3 = 0 then null else 'generic_zstd' end) as strategy from v_file where seq % 2 = 0 group by 1, 2) k on r.size = k.size and r.sha256 = k.sha256""")
def q_decision_cache(spark, d):
    f = V.file(spark, d)
    earlier = f.filter("seq % 2 = 0").select("size", "sha256", F.when(F.col("seq") % 3 != 0, K.ZSTD).alias("strategy"))
    return S.cached_decisions(f.select("seq", "size", "sha256"), earlier).select("seq", "outcome", "strategy")
