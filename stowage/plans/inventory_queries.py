"""Inventory and integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.functions import columns as C
from stowage.operators import integrity as G
from stowage.operators import inventory as I

from . import fixtures as V
from .registry import query

#: Synthetic headers before a document's text, by its number.
_HEADS = ["FFD8FFE0", "89504E470D0A1A0A", "474946383961", "424D", "49492A00", "524946460000000057454250", "000000006674797061766966", "000000006674797068656963", "255044462D", "53514C69746520666F726D6174203300", "1F8B", "504B0304", "4D5A", "7F454C46", "", "", "00FF"]
_TYPES = ["JPEG", "PNG", "GIF", "BMP", "TIFF", "WEBP", "AVIF", "HEIC", "PDF", "SQLITE", "GZIP", "ZIP", "ELF_OR_PE", "ELF_OR_PE"]
_EXTS = ["jpg", "png", "jpeg", "bmp", "tif", "webp", "jpg", "heic", "pdf", "db", "gz", "docx", "exe", "so", "txt", "pch", "dat"]
_N = len(_HEADS)
_SQL_BIN = f"(select doc_id, case doc_id % {_N} " + " ".join(f"when {i} then '{h}'" for i, h in enumerate(_HEADS)) + f" end || hex(encode(text)) as hx, case doc_id % {_N} " + " ".join(f"when {i} then '{e}'" for i, e in enumerate(_EXTS)) + " end as ext from documents)"
_SQL_SIG = "case when starts_with(h, 'FFD8FF') then 'JPEG' when starts_with(h, '89504E470D0A1A0A') then 'PNG' when starts_with(h, '474946383761') or starts_with(h, '474946383961') then 'GIF' when starts_with(h, '424D') then 'BMP' when starts_with(h, '49492A00') or starts_with(h, '4D4D002A') then 'TIFF' when starts_with(h, '52494646') and substr(h, 17, 8) = '57454250' then 'WEBP' when substr(h, 9, 8) = '66747970' and substr(h, 17, 8) in ('61766966', '61766973') then 'AVIF' when substr(h, 9, 8) = '66747970' and substr(h, 17, 8) in ('68656963', '68656978', '68657663', '6865696D', '68656973', '6865766D', '68657673', '6D696631') then 'HEIC' when starts_with(h, '255044462D') then 'PDF' when starts_with(h, '53514C69746520666F726D6174203300') then 'SQLITE' when starts_with(h, '1F8B') then 'GZIP' when left(h, 8) in ('504B0304', '504B0506', '504B0708') then 'ZIP' when starts_with(h, '4D5A') or starts_with(h, '7F454C46') then 'ELF_OR_PE' end"
_UTF8 = "^(([0-7][0-9A-F])|((C[2-9A-F]|D[0-9A-F])[89AB][0-9A-F])|(E0[AB][0-9A-F][89AB][0-9A-F])|((E[1-9A-CEF])[89AB][0-9A-F][89AB][0-9A-F])|(ED[89][0-9A-F][89AB][0-9A-F])|(F0[9AB][0-9A-F]([89AB][0-9A-F]){2})|(F[1-3]([89AB][0-9A-F]){3})|(F48[0-9A-F]([89AB][0-9A-F]){2}))*$"
_SQL_TEXT = f"(h <> '' and regexp_full_match(h, '{_UTF8}') and len(list_filter(regexp_extract_all(h, '..'), lambda p: (p >= '09' and p <= '0D') or (p >= '20' and p <= '7E'))) / (length(h) / 2) > 0.85)"
_SQL_FORMAT = f"case when ext = 'pch' then 'BUILD_ARTIFACT' when sig = 'ZIP' and ext in ('docx', 'xlsx', 'pptx') then 'OOXML_ZIP' when sig is not null then sig when txt then case ext when 'txt' then 'TEXT' else 'TEXT_UNKNOWN' end else 'BINARY_UNKNOWN' end"
_SQL_FMT = f"(select *, {_SQL_FORMAT} as kind from (select *, {_SQL_SIG} as sig, {_SQL_TEXT} as txt from (select *, left(hx, 128) as h from {_SQL_BIN})))"


def _binary(spark, d):
    m = F.col("doc_id") % _N
    head = ext = None
    for i, (h, e) in enumerate(zip(_HEADS, _EXTS)):
        head = F.when(m == i, h) if head is None else head.when(m == i, h)
        ext = F.when(m == i, e) if ext is None else ext.when(m == i, e)
    content = F.concat(F.unhex(head), F.col("text").cast("binary"))
    return V.table(spark, d, "documents").select("doc_id", content.alias("content"), ext.alias("ext"))


@query(f"select doc_id, {_SQL_SIG} as detected from (select *, left(hx, 128) as h from {_SQL_BIN})")
def q_detect_signature(spark, d):
    return _binary(spark, d).select("doc_id", C.signature(F.col("content")).alias("detected"))


@query(f"select doc_id, ext, kind as detected_type from {_SQL_FMT}")
def q_detect_format(spark, d):
    return _binary(spark, d).select("doc_id", "ext", C.detect_format(F.col("content"), F.col("ext")).alias("detected_type"))


@query(f"select doc_id, kind in ('JPEG','PNG','GIF','BMP','TIFF','WEBP','AVIF','HEIC','PDF','SQLITE','GZIP') and lower(kind) <> ext and lower(kind) <> case ext when 'jpg' then 'jpeg' when 'tif' then 'tiff' else ext end as mismatch from {_SQL_FMT}")
def q_extension_mismatch(spark, d):
    b = _binary(spark, d)
    return b.select("doc_id", C.extension_mismatch(C.detect_format(F.col("content"), F.col("ext")), F.col("ext")).alias("mismatch"))


@query(f"select doc_id, txt as is_text from {_SQL_FMT}")
def q_text_sniff(spark, d):
    return _binary(spark, d).select("doc_id", C.looks_like_text(F.col("content")).alias("is_text"))


@query(f"select coalesce(reason, 'OK') as invalid_reason, count(*) as n, cast(coalesce(sum(size), 0) as bigint) as bytes from (select case when seq % 17 = 0 then 'UNREADABLE' when seq % 13 = 0 then 'EMPTY' end as reason, case when seq % 17 = 0 then null when seq % 13 = 0 then 0 else size end as size from v_file) group by 1")
def q_inventory_validity(spark, d):
    content = F.when(F.col("seq") % 17 == 0, None).when(F.col("seq") % 13 == 0, F.lit("").cast("binary")).otherwise(F.col("content").cast("binary"))
    t = I.analyze(V.file(spark, d).select("seq", "relpath", content.alias("content")))
    return t.groupBy(F.coalesce("invalid_reason", F.lit("OK")).alias("invalid_reason")).agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


@query("select seq, relpath, case when row_number() over (partition by sha256 order by seq) > 1 then first(relpath) over (partition by sha256 order by seq) end as is_duplicate_of from v_file")
def q_dedup_keep_first(spark, d):
    return I.keep_first(V.file(spark, d)).select("seq", "relpath", "is_duplicate_of")


@query("select cast(sum(n) as bigint) as valid_files, count(*) as unique_files, cast(sum(one) as bigint) as unique_bytes, cast(sum(b - one) as bigint) as duplicate_bytes, (select cast(count_if(size < 50) as bigint) from v_file) as invalid_files from (select sha256, count(*) as n, sum(size) as b, max(size) as one from v_file where size >= 50 group by 1)")
def q_inventory_summary(spark, d):
    return I.summary(V.file(spark, d).withColumn("valid", F.col("size") >= 50))


@query("select case when e = '' then 'unknown' else e end as extension, count(*) as n from (select lower(regexp_extract(f, '[^.]+\\.([^.]*)$', 1)) as e from (select case line when 6 then '.bashrc' when 7 then 'README' else file_name end as f from v_item)) group by 1")
def q_extension_counts(spark, d):
    name = F.when(F.col("line") == 6, ".bashrc").when(F.col("line") == 7, "README").otherwise(F.col("file_name"))
    ext = F.coalesce(F.nullif(C.extension(name), F.lit("")), F.lit("unknown"))
    return V.item(spark, d).groupBy(ext.alias("extension")).agg(F.count("*").alias("n"))


_PATHS = [("C:\\data\\report.txt", "OK"), ("", "EMPTY"), (None, "EMPTY"), ("docs/a.txt", "RELATIVE"), ("C:/x/" + "a" * 270, "TOO_LONG"), ("C:/gone/a.txt", "MISSING"), ("C:/data/con.txt", "RESERVED_NAME"), ("C:/data/dir /a", "TRAILING_SPACE_OR_DOT"), ("C:/data/a<b", "BAD_CHARACTER"), ("/var/log/x.", "TRAILING_SPACE_OR_DOT"), ("/var/log/lpt3", "RESERVED_NAME"), ("/ok/é.txt", "OK")]


@query("select r_regionkey as i, reason from region join (values (0, 'OK'), (1, 'EMPTY'), (2, 'EMPTY'), (3, 'RELATIVE'), (4, 'TOO_LONG')) v(k, reason) on k = r_regionkey union all select * from (values (5, 'MISSING'), (6, 'RESERVED_NAME'), (7, 'TRAILING_SPACE_OR_DOT'), (8, 'BAD_CHARACTER'), (9, 'TRAILING_SPACE_OR_DOT'), (10, 'RESERVED_NAME'), (11, 'OK')) v(i, reason)")
def q_path_validity(spark, d):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(_PATHS)], "i int, path string")
    return rows.select("i", C.path_validity(F.col("path"), ~F.coalesce(F.col("path").contains("gone"), F.lit(False))).alias("reason"))


_ROOTS = ["C:\\Windows", "c:/windows/System32/x.dll", "C:\\WindowsOld\\x", "D:\\Windows", "C:\\PROGRAM FILES\\app", "C:\\ProgramData\\", "C:\\Users\\a"]


@query("select p_partkey as id, p_partkey % 7 in (0, 1, 4, 5) as protected from part")
def q_protected_path(spark, d):
    m = F.col("p_partkey") % len(_ROOTS)
    path = None
    for i, p in enumerate(_ROOTS):
        path = F.when(m == i, p) if path is None else path.when(m == i, p)
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.is_protected(path).alias("protected"))


@query("select p_partkey as id, coalesce(nullif(trim(translate(coalesce(n, ''), '<>:\"/\\|?*', '_________')), ''), 'category') as clean from (select p_partkey, case p_partkey % 5 when 0 then null when 1 then '   ' when 2 then ' ' || p_name || ' ' when 3 then p_type || '<a>:b|c?' else 'x/y\\z*' || p_brand end as n from part)")
def q_sanitize_names(spark, d):
    m = F.col("p_partkey") % 5
    n = F.when(m == 1, "   ").when(m == 2, F.concat(F.lit(" "), "p_name", F.lit(" "))).when(m == 3, F.concat("p_type", F.lit("<a>:b|c?"))).when(m == 4, F.concat(F.lit("x/y\\z*"), "p_brand"))
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.sanitize_name(n).alias("clean"))


@query("select seq, relpath, size from v_file where relpath not in (select relpath from v_file where seq % 3 = 0) order by size, relpath")
def q_resume_remaining_anti(spark, d):
    f = V.file(spark, d).select("seq", "relpath", "size")
    return I.remaining(f, f.filter("seq % 3 = 0"), "relpath")


# integrity

_WALK = "case doc_id % 3 when 0 then 'a' || cast(doc_id as varchar) when 1 then 'sub/' || cast(doc_id as varchar) else 'sub/deep/' || cast(doc_id as varchar) end"


@query(f"""select source as folder, count(*) as files, case when count_if(h is null) = 0 then sha256(string_agg(p || h, '' order by array_to_string(list_transform(string_split(p, '/'), lambda x, i: case when i = len(string_split(p, '/')) then '0' || x else '1' || x end), chr(1)))) end as folder_hash
 from (select source, {_WALK} as p, case when doc_id % 499 = 7 then null else sha256(text) end as h from documents) group by 1""")
def q_folder_hash(spark, d):
    m, i = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    path = F.when(m == 0, F.concat(F.lit("a"), i)).when(m == 1, F.concat(F.lit("sub/"), i)).otherwise(F.concat(F.lit("sub/deep/"), i))
    t = V.table(spark, d, "documents").select(F.col("source").alias("folder"), path.alias("relpath"), F.when(F.col("doc_id") % 499 != 7, F.sha2("text", 256)).alias("sha256"))
    return G.folder_hash(t)


@query("select page_id, sha256(html) as sha256, cast(strlen(html) as bigint) as bytes, sha256(html) = sha256(url) as same_as_url from pages")
def q_content_hash(spark, d):
    h = F.sha2("html", 256)
    return V.table(spark, d, "pages").select("page_id", h.alias("sha256"), F.octet_length("html").cast("bigint").alias("bytes"), (h == F.sha2("url", 256)).alias("same_as_url"))


_MAN = "(select relpath as path, cast(size * 31 + seq % 5 as bigint) as crc, sha256 from v_file)"


@query(f"select n.path, n.crc, case when o.sha256 is not null and o.crc = n.crc then o.sha256 else sha256(n.sha256) end as sha256, coalesce(o.sha256 is not null and o.crc = n.crc, false) as reused from {_MAN} n left join (select path, case when crc % 7 = 0 then crc + 1 else crc end as crc, case when crc % 11 = 0 then null else sha256 end as sha256 from {_MAN} where crc % 4 <> 0) o on n.path = o.path")
def q_manifest_incremental(spark, d):
    n = V.file(spark, d).select(F.col("relpath").alias("path"), (F.col("size") * 31 + F.col("seq") % 5).alias("crc"), "sha256")
    c = F.col("crc")
    old = n.filter("crc % 4 <> 0").select("path", F.when(c % 7 == 0, c + 1).otherwise(c).alias("crc"), F.when(c % 11 != 0, F.col("sha256")).alias("sha256"))
    return G.incremental_manifest(n.select("path", "crc", F.sha2("sha256", 256).alias("fresh_sha")), old)


@query("select coalesce(m.path, a.path) as path, case when m.path is null then 'ADDED' when a.path is null then 'REMOVED' when m.sha256 <> a.sha256 then 'CHANGED' else 'SAME' end as change from (select relpath as path, sha256 from v_file where seq % 5 <> 0) m full outer join (select relpath as path, case when seq % 7 = 0 then sha256(sha256) else sha256 end as sha256 from v_file where seq % 3 <> 0) a on m.path = a.path")
def q_manifest_diff(spark, d):
    f = V.file(spark, d).select("seq", F.col("relpath").alias("path"), "sha256")
    return G.manifest_diff(f.filter("seq % 5 <> 0"), f.filter("seq % 3 <> 0").withColumn("sha256", F.when(F.col("seq") % 7 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256"))))


@query("""select a.id, case when id % 29 = 0 then 'MISSING' when id % 23 = 0 then 'CORRUPTED' when id % 19 = 0 then 'CHANGED' when m.names is null then 'CHANGED' when id % 17 = 0 then 'CHANGED' when id % 2 = 0 and id % 13 = 0 then 'CHANGED'
 when len(list_distinct(coalesce(x.names, []))) <> len(coalesce(x.names, [])) then 'CHANGED' when m.names <> coalesce(x.names, []) then 'CHANGED' when m.hashes <> coalesce(x.hashes, []) then 'CHANGED' else 'VERIFIED' end as status from v_archive a
 left join (select archive_id, list(name order by pos, name, h) as names, list(h order by pos, name, h) as hashes from (select archive_id, line as pos, path_in_archive as name, original_hash as h from v_item) group by 1) m on m.archive_id = a.id
 left join (select archive_id, list(name order by pos, name, h) as names, list(h order by pos, name, h) as hashes from (select archive_id, case when archive_id % 11 = 0 then 8 - line else line end as pos, path_in_archive as name, case when archive_id % 7 = 0 then sha256(original_hash) else original_hash end as h from v_item) group by 1) x on x.archive_id = a.id""")
def q_verify_status(spark, d):
    i = F.col("id")
    same = F.lit("h")
    a = V.archive(spark, d).select("id", (i % 29 != 0).alias("exists"), (i % 23 != 0).alias("readable"), F.when(i % 3 != 0, same).when(i % 19 == 0, same).alias("expected_hash"), F.when(i % 19 == 0, "other").otherwise(same).alias("current_hash"), F.when(i % 17 == 0, "older").when(i % 2 == 1, F.when(i % 19 == 0, "other").otherwise(same)).alias("manifest_hash"), F.when(i % 13 == 0, 1).otherwise(2).alias("manifest_size"), F.lit(2).alias("size"))
    t = V.item(spark, d).select(F.col("archive_id").alias("id"), F.col("line").alias("pos"), F.col("path_in_archive").alias("name"), F.col("original_hash").alias("sha256"))
    moved = t.select("id", F.when(i % 11 == 0, 8 - F.col("pos")).otherwise(F.col("pos")).alias("pos"), "name", F.when(i % 7 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    return G.verify(a, t, moved)


@query("select cast(count_if(selected_bytes > baseline) as bigint) as larger_than_baseline, cast(count_if(used_fallback and selected_bytes <> baseline) as bigint) as odd_fallbacks, (select cast(count_if(reason = 'ACCEPTED' and not sha_ok) as bigint) from v_decided) as accepted_mismatches from v_best")
def q_invariants(spark, d):
    from stowage.operators import selection as S

    t = V.decided(spark, d)
    best = S.select_best(t).agg(F.count_if(F.col("selected_bytes") > F.col("baseline")).alias("larger_than_baseline"), F.count_if(F.col("used_fallback") & (F.col("selected_bytes") != F.col("baseline"))).alias("odd_fallbacks"))
    return best.crossJoin(t.agg(F.count_if((F.col("reason") == "ACCEPTED") & ~F.col("sha_ok")).alias("accepted_mismatches")))  # one row each
