"""Array kernels, codecs and file-shaped queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.functions import codecs, containers
from stowage.functions import kernels as N
from stowage.sources import files as S
from stowage.sources import sinks

from . import fixtures as V
from .registry import query

_INTS = "list_transform(embedding, lambda x: cast(floor(x * {0}) as bigint))"


def _ints(spark, d, scale: int):
    return V.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("a"))


@query("select vec_id, list_transform(list_zip(a, list_reverse(a)), lambda p: ((p[1] - p[2]) % 256 + 256) % 256) as residual from (select vec_id, list_transform(embedding, lambda x: cast(floor(x::double * 100) as bigint)) as a from embeddings)")
def q_residual_mod256(spark, d):
    t = _ints(spark, d, 100)
    return t.select("vec_id", N.residual(F.col("a"), F.reverse("a")).alias("residual"))


_SQL_COST = """select vec_id, case when c0 = m then 0 when c1 = m then 1 when c2 = m then 2 when c3 = m then 3 else 4 end::int as category, cast(m as bigint) as cost from (select *, least(coalesce(c0, 999), c1, coalesce(c2, 999), coalesce(c3, 999), 385) as m from (
 select vec_id, case when nz = 0 then 1 end as c0, 3 + 3 * nz as c1, case when lo >= -7 and hi <= 7 then 193 end as c2, case when lo >= -31 and hi <= 31 then 289 end as c3 from (
 select vec_id, len(list_filter(a, lambda x: x <> 0)) as nz, list_min(a) as lo, list_max(a) as hi from (select vec_id, list_transform(embedding, lambda x: case when abs(x) < (vec_id % 10) * 0.05::double then 0 else cast(floor(x::double * (5 + vec_id % 7 * 20)) as bigint) end) as a from embeddings))))"""


def _blocks(spark, d):
    i = F.col("vec_id")
    a = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < (i % 10) * F.lit(0.05), F.lit(0).cast("bigint")).otherwise(F.floor(x.cast("double") * (5 + i % 7 * 20)).cast("bigint")))
    return V.table(spark, d, "embeddings").select("vec_id", a.alias("a"))


@query(_SQL_COST)
def q_block_category(spark, d):
    t = _blocks(spark, d)
    return t.select("vec_id", N.block_category(F.col("a")).alias("category"), F.array_min(N.block_costs(F.col("a"))).cast("bigint").alias("cost"))


@query(f"select category, n, round(100.0 * n::double / (sum(n) over ())::double, 2) as pct from (select category, count(*) as n from ({_SQL_COST}) group by 1)")
def q_block_distribution(spark, d):
    from stowage.operators import rollup as R

    return R.share_of_total(_blocks(spark, d).groupBy(N.block_category(F.col("a")).alias("category")).agg(F.count("*").alias("n")))


@query("select vec_id, true as same4, true as same6, cast(ceil(len(embedding) / 2.0) as int) as bytes4, cast(ceil(len(embedding) / 4.0) as int) as words6, len(embedding)::int as restored from embeddings")
def q_block_pack(spark, d):
    t = _ints(spark, d, 7)
    small = t.select("vec_id", F.transform("a", lambda x: F.greatest(F.least(x, F.lit(7)), F.lit(-8))).alias("a"))
    n = F.size("a")
    four, six = N.pack4(F.col("a")), N.pack6(F.col("a"))
    return small.select("vec_id", (N.unpack4(four, n) == F.col("a")).alias("same4"), (N.unpack6(six, n) == F.col("a")).alias("same6"), F.size(four).alias("bytes4"), F.size(six).alias("words6"), F.size(F.flatten(N.blocks(F.col("a"), 8))).alias("restored"))


@query("select conv_id, turn, cast(row_number() over (partition by conv_id order by text, turn) as bigint) as sorted_pos, text as restored from conversations")
def q_sort_permutation(spark, d):
    """Each conversation's turns sorted by text, with the permutation; then put
    back by it alone: the row at each place of the first order, looked up through
    the permutation, has the text that stood there."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    t = V.table(spark, d, "conversations").select("conv_id", "turn", "text")
    forward = t.withColumn("place", F.row_number().over(w.orderBy("turn"))).withColumn("sorted_pos", F.row_number().over(w.orderBy("text", "turn")).cast("bigint"))
    ordered = forward.select("conv_id", "sorted_pos", "text")
    permutation = forward.select("conv_id", "place", "sorted_pos")
    back = permutation.join(ordered.withColumnRenamed("text", "restored"), ["conv_id", "sorted_pos"])
    turns = t.select("conv_id", "turn").withColumn("place", F.row_number().over(w.orderBy("turn")))
    return back.join(turns, ["conv_id", "place"]).select("conv_id", "turn", "sorted_pos", "restored")


@query("select doc_id, s.strategy, true as exact_match, sha256(text) as restored_sha256, 'PASS' as status from documents, (values ('baseline_zip'), ('generic_zlib'), ('generic_lzma'), ('lzma_x86'), ('generic_zstd'), ('zstd_long_range_v2'), ('csv_prefilter')) s(strategy) union all select doc_id, 'generic_brotli', false, null, 'SKIPPED_UNAVAILABLE' from documents")
def q_codec_measure(spark, d):
    names = ["baseline_zip", "generic_zlib", "generic_lzma", "lzma_x86", "generic_zstd", "zstd_long_range_v2", "csv_prefilter", "generic_brotli"]
    t = V.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("text").cast("binary").alias("content"))
    return codecs.measure_unique(t, names).select("doc_id", "strategy", "exact_match", "restored_sha256", "status")


@query("select page_id, sha256(html) as original_sha256, 'OK' as outcome from pages")
def q_restore_check(spark, d):
    t = V.table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.col("html").cast("binary").alias("content"), F.lit("generic_zstd").alias("strategy"))
    m = codecs.measure(t)
    return m.select("page_id", F.col("sha256").alias("original_sha256"), F.when(F.col("restored_sha256") == F.col("sha256"), "OK").otherwise("SMART_RESTORE_ERROR").alias("outcome"))


@query()
def q_compressibility_sample(spark, d):
    t = V.table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return codecs.compressible(t)


@query("select doc_id, case when strlen(text) > 20000 then 'TOO_LARGE' when len(string_split(rtrim(text), chr(10))) < 2 then 'TOO_FEW_ROWS' else 'OK' end as verdict from documents")
def q_text_preflight(spark, d):
    return V.table(spark, d, "documents").select("doc_id", S.text_verdict(F.col("text").cast("binary"), 20_000).alias("verdict"))


@query("select archive_id as id, count(*) as files, cast(sum(original_size) as bigint) as original_bytes, max(path_in_archive) as last_path from v_item group by 1")
def q_manifest_round_trip_all(spark, d):
    """Manifests written as JSON documents and read back."""
    i = V.item(spark, d)
    members = i.select(F.col("archive_id").alias("id"), F.col("line").alias("pos"), "path_in_archive", "original_size", "compressed_size", F.col("original_hash").alias("sha256"), F.crc32(F.col("original_hash").cast("binary")).alias("crc32"), "strategy", F.col("original_hash").alias("original_sha256"))
    a = i.select(F.col("archive_id").alias("id")).distinct().select("id", F.lit("a").alias("archive_name"), F.lit("c").alias("category"), F.lit(0).alias("archive_size"), F.lit(None).cast("string").alias("archive_sha256"))
    docs = sinks.manifest_documents(a, members).select(F.col("id").cast("string").alias("path"), F.col("document").cast("binary").alias("content"))
    back = S.manifests(docs).select(F.col("path").cast("bigint").alias("id"), F.explode("manifest.files").alias("f"))
    return back.groupBy("id").agg(F.count("*").alias("files"), F.sum("f.original_size").alias("original_bytes"), F.max("f.path_in_archive").alias("last_path"))


@query("""select doc_id, sha256(text) as restored_sha256, 4 as codecs, true as smaller_than_stored, true as none_is_smaller from documents""")
def q_best_codec(spark, d):
    """The smallest of four codecs for each content by one aggregate; the content
    is then stored with the chosen one and restored, and the size it takes is
    compared with every codec's."""
    names = ["generic_zlib", "generic_lzma", "generic_zstd", "zstd_long_range_v2"]
    t = V.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"), F.col("text").cast("binary").alias("content"))
    m = codecs.measure_unique(t.select("key", "content"), names, "key").dropDuplicates(["key", "strategy"])
    best = m.groupBy("key").agg(F.min(F.struct("stored_bytes", "strategy")).alias("best"), F.collect_list("stored_bytes").alias("sizes"), F.count("*").cast("int").alias("codecs"))
    stored = codecs.store(t.join(best, "key").select("doc_id", "sizes", "codecs", F.col("best.strategy").alias("strategy"), "content"))
    back = codecs.restore(stored.withColumn("took", F.octet_length("stored")))
    return back.select("doc_id", F.sha2("content", 256).alias("restored_sha256"), "codecs", (F.col("took") <= F.octet_length("content") + 64).alias("smaller_than_stored"), F.forall("sizes", lambda x: x >= F.col("took")).alias("none_is_smaller"))


@query("select page_id, case page_id % 4 when 0 then 'generic_zstd' when 1 then 'generic_lzma' when 2 then 'lzma_x86' else 'stored' end as strategy, sha256(html) as restored_sha256, cast(strlen(html) as bigint) as bytes from pages")
def q_restore_members(spark, d):
    """Pages stored with several strategies, one of them none, and restored; a
    wrong hash fails the query."""
    m = F.col("page_id") % 4
    strategy = F.when(m == 0, "generic_zstd").when(m == 1, "generic_lzma").when(m == 2, "lzma_x86")
    back = codecs.restore(codecs.store(V.table(spark, d, "pages").select("page_id", strategy.alias("strategy"), F.col("html").cast("binary").alias("content"))))
    return back.select("page_id", F.coalesce("strategy", F.lit("stored")).alias("strategy"), F.sha2("content", 256).alias("restored_sha256"), F.octet_length("content").cast("bigint").alias("bytes"))


@query("select doc_id, 'member' as name, cast(strlen(text) as bigint) as size, cast(null as varchar) as error from documents")
def q_zip_members(spark, d):
    """Each content in a ZIP container of its own, and the containers' directories."""
    t = V.table(spark, d, "documents").select("doc_id", F.lit("baseline_zip").alias("strategy"), F.col("text").cast("binary").alias("content"))
    zips = codecs.store(t).select(F.col("doc_id").cast("string").alias("path"), F.col("stored").alias("content"))
    return S.zip_members(zips).select(F.col("path").cast("bigint").alias("doc_id"), "name", "size", "error")


@query("""select p_partkey as id, '<part a="' || p_partkey || '" z="' || p_size || '"><name>' || p_name || '</name><none></none></part>' as canonical from part union all select -1, null""")
def q_canonical_xml(spark, d):
    """Attributes in order, empty elements as two tags, comments and white space
    between tags gone; a broken document is null."""
    canonical = F.pandas_udf(lambda s: s.map(codecs.canonical_xml), "string")
    text = F.concat(F.lit("<part  z='"), F.col("p_size").cast("string"), F.lit("' a='"), F.col("p_partkey").cast("string"), F.lit("'>\n  <name>"), F.col("p_name"), F.lit("</name><!-- x --><none/>\n</part>"))
    t = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("t"))
    return t.unionByName(spark.range(1).select(F.lit(-1).cast(t.schema["id"].dataType).alias("id"), F.lit("<part><name></part>").alias("t"))).select("id", canonical("t").alias("canonical"))


@query("""select event_id, '{"a":[1,2],"k":' || json_extract_string(props, '$.k') || '}' as canonical from events""")
def q_canonical_json(spark, d):
    """Keys sorted, white space gone."""
    canonical = F.pandas_udf(lambda s: s.map(codecs.canonical_json), "string")
    text = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(' , "a" : [1, 2] }'))
    return V.table(spark, d, "events").select("event_id", canonical(text).alias("canonical"))


@query("select p_partkey as id, case p_partkey % 5 when 0 then 'OK' when 1 then 'NOT_A_BMP' when 2 then 'VARIANT' when 3 then 'ROW_PADDING' else 'SIZE' end as problem from part")
def q_bmp_header(spark, d):
    """Headers of 4 x 2 pixels, most of them wrong in some way."""
    m = F.col("p_partkey") % 5
    def head(width: str, bits: str) -> str:
        return "424D" + "00" * 8 + "36000000" + "28000000" + width + "02000000" + "0100" + bits + "00" * 24
    good = head("04000000", "1800")
    text = F.when(m == 0, good + "07" * 24).when(m == 1, "4D42" + good[4:]).when(m == 2, head("04000000", "2000") + "07" * 24).when(m == 3, head("03000000", "1800") + "07" * 24).otherwise(good + "07" * 23)
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), containers.bmp_problem(F.unhex(text)).alias("problem"))


@query("select doc_id, doc_id % 3 = 0 as fast from documents")
def q_mp4_boxes(spark, d):
    """moov and mdat in either order, or a broken box ahead of them."""
    box = lambda kind: F.concat(F.unhex(F.lit("00000010")), F.lit(kind).cast("binary"), F.unhex(F.lit("00" * 8)))
    m = F.col("doc_id") % 3
    content = F.when(m == 0, F.concat(box("ftyp"), box("moov"), box("mdat"))).when(m == 1, F.concat(box("ftyp"), box("mdat"), box("moov"))).otherwise(F.concat(F.unhex(F.lit("00000004")), F.lit("free").cast("binary"), box("moov")))
    return V.table(spark, d, "documents").select("doc_id", containers.moov_first(content).alias("fast"))
