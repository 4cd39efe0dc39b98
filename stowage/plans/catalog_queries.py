"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage.functions import columns as C
from stowage.functions import constants as K
from stowage.operators import catalog as T

from . import fixtures as V
from .registry import query

_PLACED = "v_item i join v_archive a on i.archive_id = a.id join v_category c on a.category_id = c.id"


def _digests(spark, d):
    """Items by the 32 bytes of their hash; shuffles carry half of its text."""
    return V.item(spark, d).select("archive_id", F.unhex("original_hash").alias("digest"))


def _placed(spark, d):
    return T.items_in_place(V.item(spark, d), V.archive(spark, d), V.category(spark, d))


@query("select id, category_id, file_name, current_size, item_count, integrity_status, created_at from v_archive where id = 1000")
def q_point_lookup(spark, d):
    return V.archive(spark, d).filter(F.col("id") == 1000)


@query("select id, name, grp, row_number() over (order by name) as place from v_category")
def q_list_ordered(spark, d):
    from pyspark.sql import Window

    return V.category(spark, d).orderBy("name").withColumn("place", F.row_number().over(Window.orderBy("name")).cast("bigint"))  # a row per category


@query("select a.id, a.file_name, a.current_size, a.integrity_status, c.name as category from v_archive a join v_category c on a.category_id = c.id order by c.name, a.file_name")
def q_join_archives_categories(spark, d):
    c = V.category(spark, d).select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return V.archive(spark, d).join(c, "category_id").select("id", "file_name", "current_size", "integrity_status", "category").orderBy("category", "file_name")


@query("select id, file_name, current_size from v_archive where category_id = 7 order by file_name")
def q_filter_fk_ordered(spark, d):
    return V.archive(spark, d).filter(F.col("category_id") == 7).select("id", "file_name", "current_size").orderBy("file_name")


@query("select a.id, a.current_size from v_archive a where a.category_id = (select min(category_id) from v_archive where id = 1000) and a.file_name = 'arc_000001000.zip'")
def q_composite_key_lookup(spark, d):
    a = V.archive(spark, d)
    of = a.filter(F.col("id") == 1000).agg(F.min("category_id").alias("category_id"))
    return a.filter(F.col("file_name") == "arc_000001000.zip").join(F.broadcast(of), "category_id", "left_semi").select("id", "current_size")


@query(f"select original_hash, min(archive_id) as archive_id, arg_min(c.name, a.id) as category, count(*) as copies from {_PLACED} group by 1")
def q_find_by_hash_first(spark, d):
    """Digests of 32 bytes are shuffled, and the category of one archive a hash
    is looked up, not that of every item."""
    i, known = _digests(spark, d), V.category(spark, d).select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    a = V.archive(spark, d).select(F.col("id").alias("archive_id"), "category_id").join(known.select("category_id"), "category_id", "left_semi")
    first = i.join(a, "archive_id").groupBy("digest").agg(F.min(F.struct("archive_id", "category_id")).alias("f"), F.count("*").alias("copies"))
    first = first.select(F.lower(F.hex("digest")).alias("original_hash"), F.col("f.archive_id").alias("archive_id"), F.col("f.category_id").alias("category_id"), "copies")
    return first.join(known, "category_id").select("original_hash", "archive_id", "category", "copies")


@query("select item_key, a.file_name as archive_name from v_item i join v_archive a on i.archive_id = a.id")
def q_item_archive_path(spark, d):
    a = V.archive(spark, d).select(F.col("id").alias("archive_id"), F.col("file_name").alias("archive_name"))
    return V.item(spark, d).join(a, "archive_id").select("item_key", "archive_name")


_FOLD = "translate(i.file_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"select item_key, i.file_name, c.name as category from {_PLACED} where {_FOLD} like '%t_1_7%'")
def q_search_contains(spark, d):
    return T.search(_placed(spark, d), "T_1_7").select("item_key", "file_name", "category")


@query(f"select item_key, i.file_name, c.name as category from {_PLACED} where {_FOLD} like '%part%' and c.name = 'CANADA'")
def q_search_category(spark, d):
    return T.search(_placed(spark, d), "part", category="CANADA").select("item_key", "file_name", "category")


@query(f"select item_key, i.file_name, c.name as category from {_PLACED} where {_FOLD} like '%9%' and {_FOLD} like '%.jpg'")
def q_search_suffix(spark, d):
    return T.search(_placed(spark, d), "9", suffix=".jpg").select("item_key", "file_name", "category")


@query("select item_key, archive_id, original_size from v_item where status = 'CHECKED_OUT'")
def q_checked_out_items(spark, d):
    return V.item(spark, d).filter(F.col("status") == "CHECKED_OUT").select("item_key", "archive_id", "original_size")


@query("select (select count(*) from v_category) as categories, (select count(*) from v_archive) as archives, count(*) as items, cast(coalesce(sum(original_size), 0) as bigint) as original_bytes, cast(coalesce(sum(compressed_size), 0) as bigint) as stored_bytes, cast(coalesce(sum(original_size), 0) - coalesce(sum(compressed_size), 0) as bigint) as saved_bytes, cast(count_if(status = 'CHECKED_OUT') as bigint) as checked_out from v_item")
def q_dashboard_totals(spark, d):
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    i = V.item(spark, d).agg(F.count("*").alias("items"), total("original_size").alias("original_bytes"), total("compressed_size").alias("stored_bytes"), (total("original_size") - total("compressed_size")).alias("saved_bytes"), F.count_if(F.col("status") == "CHECKED_OUT").alias("checked_out"))
    one = lambda t, n: t.agg(F.count("*").alias(n))
    return one(V.category(spark, d), "categories").crossJoin(one(V.archive(spark, d), "archives")).crossJoin(i)  # one row each


@query("select cast(coalesce(sum(original_size), 0) as bigint) as original_bytes, count(*) as items from v_item where original_size < 0")
def q_empty_sum_coalesce(spark, d):
    return V.item(spark, d).filter("original_size < 0").agg(F.coalesce(F.sum("original_size"), F.lit(0)).alias("original_bytes"), F.count("*").alias("items"))


@query("select s as integrity_status, coalesce(n, 0) as n from (values ('VERIFIED'), ('CHANGED'), ('CORRUPTED'), ('MISSING')) e(s) left join (select integrity_status, count(*) as n from v_archive group by 1) a on a.integrity_status = e.s")
def q_integrity_counts_zero_filled(spark, d):
    return T.enum_counts(V.archive(spark, d), "integrity_status", K.ARCHIVE_STATUSES)


@query("select cast(count_if(integrity_status in ('CHANGED', 'CORRUPTED', 'MISSING')) as bigint) as attention from v_archive")
def q_attention_count(spark, d):
    return V.archive(spark, d).agg(F.count_if(F.col("integrity_status").isin("CHANGED", "CORRUPTED", "MISSING")).alias("attention"))


@query("select c.name, cast(coalesce(sum(a.item_count), 0) as bigint) as items from v_category c left join v_archive a on a.category_id = c.id and a.current_size > 400000 group by 1")
def q_category_item_counts(spark, d):
    sums = V.archive(spark, d).filter("current_size > 400000").groupBy(F.col("category_id").alias("id")).agg(F.sum("item_count").alias("items"))
    return V.category(spark, d).join(sums, "id", "left").select("name", F.coalesce("items", F.lit(0)).alias("items"))


@query("select id, case when folder is null or folder = '' then 'folder_' || cast(id as varchar) else folder end as folder_name from (select id, case id % 3 when 0 then null when 1 then '' else lower(name) end as folder from v_category)")
def q_backfill_null_or_empty(spark, d):
    m = F.col("id") % 3
    old = V.category(spark, d).select("id", F.when(m == 1, "").when(m == 2, F.lower("name")).alias("folder"))
    return old.select("id", F.when(F.col("folder").isNull() | (F.col("folder") == ""), F.concat(F.lit("folder_"), F.col("id").cast("string"))).otherwise(F.col("folder")).alias("folder_name"))


@query("select distinct path_in_archive from v_item where line = 1 and path_in_archive not in (select path_in_archive from v_item where line = 2)")
def q_insert_or_ignore(spark, d):
    i = V.item(spark, d)
    return T.insert_or_ignore(i.filter("line = 2"), i.filter("line = 1").select("path_in_archive"), ["path_in_archive"])


@query("""select problem, count(*) as n from (select case when archive_id <= 0 then 'ARCHIVE_ID' when file_type not in ('file', 'folder') then 'FILE_TYPE' when length(trim(file_name)) = 0 then 'FILE_NAME' when original_size - 2000 < 0 then 'ORIGINAL_SIZE' when compressed_size - 2100 < 0 then 'COMPRESSED_SIZE' when h is null or not regexp_matches(h, '^[0-9a-f]{64}$') then 'HASH' when s not in ('ARCHIVED', 'CHECKED_OUT', 'ARCHIVING', 'CHECKING_IN', 'ERROR', 'MISSING') then 'STATUS' else 'VALID' end as problem
 from (select archive_id % 50 as archive_id, case when line = 7 then 'link' else 'file' end as file_type, case when line = 6 then '  ' else file_name end as file_name, original_size, compressed_size, case when line = 5 then upper(original_hash) when line = 4 and original_size % 2 = 0 then null else original_hash end as h, case when original_size % 11 = 0 then 'LOST' else status end as s from v_item)) group by 1""")
def q_validate_items(spark, d):
    line, size = F.col("line"), F.col("original_size")
    r = {"archive_id": F.col("archive_id") % 50, "file_type": F.when(line == 7, "link").otherwise("file"), "file_name": F.when(line == 6, "  ").otherwise(F.col("file_name")), "path_in_archive": F.col("path_in_archive"), "original_size": size - 2000, "compressed_size": F.col("compressed_size") - 2100}
    r["original_hash"] = F.when(line == 5, F.upper("original_hash")).when((line == 4) & (size % 2 == 0), None).otherwise(F.col("original_hash"))
    r["status"] = F.when(size % 11 == 0, "LOST").otherwise(F.col("status"))
    return V.item(spark, d).groupBy(T.item_problem(r).alias("problem")).agg(F.count("*").alias("n"))


@query("""select q.id, q.new_name, case when c.id is null then 'NOT_FOUND' when exists (select 1 from v_category o where o.name = q.new_name and o.id <> q.id) then 'NAME_TAKEN' else 'RENAMED' end as outcome
 from (select id + 3 as id, case id % 3 when 0 then name when 1 then name || '_NEW' else lower(name) end as new_name from v_category) q left join v_category c on c.id = q.id""")
def q_rename_collision(spark, d):
    c = V.category(spark, d)
    m = F.col("id") % 3
    changes = c.select((F.col("id") + 3).alias("id"), F.when(m == 0, F.col("name")).when(m == 1, F.concat("name", F.lit("_NEW"))).otherwise(F.lower("name")).alias("new_name"))
    return T.renamed(c, changes)


@query("select q.id, case when c.id is null then 'NOT_FOUND' when exists (select 1 from v_archive a where a.category_id = q.id and a.current_size > 498000) then 'NOT_EMPTY' else 'DELETED' end as outcome from (select id + 2 as id from v_category) q left join v_category c on c.id = q.id")
def q_delete_outcome(spark, d):
    c = V.category(spark, d)
    return T.deletion(c.select((F.col("id") + 2).alias("id")), c, V.archive(spark, d).filter("current_size > 498000"), "category_id")


@query("select id, name from v_category where id not in (select category_id from v_archive where current_size > 498000)")
def q_empty_categories_anti(spark, d):
    return V.category(spark, d).join(V.archive(spark, d).filter("current_size > 498000").select(F.col("category_id").alias("id")), "id", "left_anti").select("id", "name")


@query("select id, case when id % 10 = 3 then current_size + 100 else current_size end as current_size, case when id % 10 = 3 then 'VERIFIED' when id % 10 = 4 then integrity_status else integrity_status end as integrity_status, id % 10 = 3 as changed from v_archive")
def q_update_archive_details(spark, d):
    hit = F.col("id") % 10 == 3
    valid = lambda s: F.when(F.lit(s in K.ARCHIVE_STATUSES), s).otherwise(F.col("integrity_status"))
    status = F.when(hit, valid("VERIFIED")).when(F.col("id") % 10 == 4, valid("LOST")).otherwise(F.col("integrity_status"))
    return V.archive(spark, d).select("id", F.when(hit, F.col("current_size") + 100).otherwise(F.col("current_size")).alias("current_size"), status.alias("integrity_status"), hit.alias("changed"))


@query("select item_key, s as status, case when s = 'CHECKED_OUT' then timestamp '2024-01-01' end as checked_out_at, case when s = 'ARCHIVED' then timestamp '2024-01-01' end as checked_in_at, case when s = 'CHECKED_OUT' then 'ws/' || file_name end as workspace_path from (select *, case when line = 1 then 'CHECKED_OUT' when line = 2 then 'ARCHIVED' else 'ERROR' end as s from v_item)")
def q_item_status_transition(spark, d):
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    s = F.when(F.col("line") == 1, "CHECKED_OUT").when(F.col("line") == 2, "ARCHIVED").otherwise("ERROR")
    out = V.item(spark, d).withColumn("status", s)
    return out.select("item_key", "status", F.when(s == "CHECKED_OUT", now).alias("checked_out_at"), F.when(s == "ARCHIVED", now).alias("checked_in_at"), F.when(s == "CHECKED_OUT", F.concat(F.lit("ws/"), F.col("file_name"))).alias("workspace_path"))


@query("select item_key, sha256(original_hash) as original_hash, coalesce(case when line % 2 = 0 then 'stored' end, sha256(original_hash)) as archive_hash from v_item where status = 'CHECKED_OUT'")
def q_update_after_edit(spark, d):
    new = F.sha2("original_hash", 256)
    return V.item(spark, d).filter("status = 'CHECKED_OUT'").select("item_key", new.alias("original_hash"), F.coalesce(F.when(F.col("line") % 2 == 0, "stored"), new).alias("archive_hash"))


@query("""select p.id, case when k.t is null then 'PROCEED' when k.t then 'DUPLICATE' else 'DUPLICATE_UNTRUSTED' end as verdict, k.archive_id from (select p_partkey as id, sha256(cast(p_partkey as varchar) || ':' || cast(p_partkey % 100 + 1 as varchar)) as h from part) p
 left join (select original_hash, bool_or(a.integrity_status = 'VERIFIED') as t, min(a.id) as archive_id from v_item i join v_archive a on i.archive_id = a.id group by 1) k on p.h = k.original_hash""")
def q_duplicate_verdict(spark, d):
    key = F.col("p_partkey")
    new = V.table(spark, d, "part").select(key.alias("id"), F.sha2(F.concat(key.cast("string"), F.lit(":"), (key % 100 + 1).cast("string")), 256).alias("original_hash"))
    placed = _digests(spark, d).join(V.archive(spark, d).select(F.col("id").alias("archive_id"), "integrity_status"), "archive_id")
    return T.duplicate_verdict(new.select("id", F.unhex("original_hash").alias("digest")), placed, "digest")


@query("""select reason, count(*) as n from (select case when file_name is null then 'INVALID_PATH' when archive_id % 97 = 0 then 'INVALID_CATEGORY' when line = 7 and archive_id % 3 = 0 then 'PROTECTED_PATH' when original_size % 101 = 0 then 'SOURCE_MISSING' when original_size % 89 = 0 then 'HASH_FAILED' when compressed_size > original_size then 'WRITE_FAILED' when original_size > 50000 then 'INSUFFICIENT_SPACE' when archive_id % 61 = 0 then 'VERIFICATION_FAILED' else 'OK' end as reason from v_item) group by 1""")
def q_reason_cascade(spark, d):
    a, s = F.col("archive_id"), F.col("original_size")
    rules = [(F.col("file_name").isNull(), "INVALID_PATH"), (a % 97 == 0, "INVALID_CATEGORY"), ((F.col("line") == 7) & (a % 3 == 0), "PROTECTED_PATH"), (s % 101 == 0, "SOURCE_MISSING"), (s % 89 == 0, "HASH_FAILED"), (F.col("compressed_size") > s, "WRITE_FAILED"), (s > 50000, "INSUFFICIENT_SPACE"), (a % 61 == 0, "VERIFICATION_FAILED")]
    out = None
    for cond, name in rules:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return V.item(spark, d).groupBy(out.otherwise("OK").alias("reason")).agg(F.count("*").alias("n"))


@query("select item_key, case when status = 'CHECKED_OUT' then 'ALREADY_CHECKED_OUT' when a.id is null then 'ARCHIVE_NOT_FOUND' when original_size > 90000 then 'INSUFFICIENT_SPACE' when a.integrity_status = 'CORRUPTED' then 'EXTRACTION_FAILED' else 'OK' end as outcome from v_item i left join (select * from v_archive where id % 13 <> 0) a on i.archive_id = a.id")
def q_checkout_outcome(spark, d):
    a = V.archive(spark, d).filter("id % 13 <> 0").select(F.col("id").alias("archive_id"), "integrity_status", F.lit(True).alias("there"))
    out = F.when(F.col("status") == "CHECKED_OUT", "ALREADY_CHECKED_OUT").when(F.col("there").isNull(), "ARCHIVE_NOT_FOUND").when(F.col("original_size") > 90000, "INSUFFICIENT_SPACE").when(F.col("integrity_status") == "CORRUPTED", "EXTRACTION_FAILED").otherwise("OK")
    return V.item(spark, d).join(a, "archive_id", "left").select("item_key", out.alias("outcome"))


@query("select item_key, case when status <> 'CHECKED_OUT' then 'NOT_CHECKED_OUT' when original_size % 7 = 0 then 'WORKSPACE_COPY_MISSING' when original_size % 11 = 0 then 'HASH_FAILED' when line % 2 = 0 then 'UNCHANGED' when compressed_size = original_size then 'ERROR' else 'REWRITTEN' end as outcome from v_item")
def q_checkin_outcome(spark, d):
    s = F.col("original_size")
    out = F.when(F.col("status") != "CHECKED_OUT", "NOT_CHECKED_OUT").when(s % 7 == 0, "WORKSPACE_COPY_MISSING").when(s % 11 == 0, "HASH_FAILED").when(F.col("line") % 2 == 0, "UNCHANGED").when(F.col("compressed_size") == s, "ERROR").otherwise("REWRITTEN")
    return V.item(spark, d).select("item_key", out.alias("outcome"))


@query("select c.name as category, a.integrity_status, count(*) as archives, cast(sum(a.current_size) as bigint) as bytes from v_archive a join v_category c on a.category_id = c.id group by 1, 2")
def q_verify_all(spark, d):
    c = V.category(spark, d).select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    by = V.archive(spark, d).groupBy("category_id", "integrity_status").agg(F.count("*").alias("archives"), F.sum("current_size").alias("bytes"))  # summed before it is joined
    return by.join(c, "category_id").select("category", "integrity_status", "archives", "bytes")


@query("select item_key, status = 'ARCHIVED' as can_check_out, status = 'CHECKED_OUT' as can_check_in, status in ('ARCHIVED', 'CHECKED_OUT') as can_open from v_item")
def q_action_flags(spark, d):
    s = F.col("status")
    return V.item(spark, d).select("item_key", (s == "ARCHIVED").alias("can_check_out"), (s == "CHECKED_OUT").alias("can_check_in"), s.isin("ARCHIVED", "CHECKED_OUT").alias("can_open"))


@query("select category_id, max(file_name) as last_name, cast(regexp_extract(max(file_name), '_([0-9]+)\\.zip$', 1) as bigint) + 1 as next_number from v_archive group by 1")
def q_next_sequence(spark, d):
    return T.next_sequence(V.archive(spark, d))


@query("select seq, left(sha256, 8) || '_' || split_part(relpath, '/', 2) as member_name from v_file")
def q_member_names(spark, d):
    f = V.file(spark, d)
    return f.select("seq", F.concat(F.coalesce(F.left("sha256", F.lit(8)), F.lit("00000000")), F.lit("_"), C.base_name(F.col("relpath"))).alias("member_name"))


@query("select p.prefix, count(i.item_key) as members, cast(coalesce(sum(i.compressed_size), 0) as bigint) as bytes from (values ('d1'), ('d2'), ('d7/part_7'), ('none')) p(prefix) left join v_item i on i.path_in_archive = p.prefix or starts_with(i.path_in_archive, p.prefix || '/') group by 1")
def q_prefix_sum(spark, d):
    asked = ["d1", "d2", "d7/part_7", "none"]
    hit = lambda p: (F.col("path_in_archive") == p) | F.col("path_in_archive").startswith(p + "/")
    sums = V.item(spark, d).agg(*[x for i, p in enumerate(asked) for x in (F.count_if(hit(p)).alias(f"n{i}"), F.coalesce(F.sum(F.when(hit(p), F.col("compressed_size"))), F.lit(0)).alias(f"b{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(f"n{i}").alias("members"), F.col(f"b{i}").alias("bytes")) for i, p in enumerate(asked)]))
    return sums.select(rows.alias("r")).select("r.*")  # one scan for any few prefixes, instead of a join on a prefix


@query("""select category_id, id as seq, current_size as size, cast(bin as bigint) as bin from (
 with recursive o as (select *, row_number() over (partition by category_id order by id) as r from v_archive),
 s as (select category_id, id, current_size, r, [current_size] as bins, 1 as bin1 from o where r = 1
  union all select o.category_id, o.id, o.current_size, o.r, case when f.at is null then list_append(s.bins, o.current_size) else list_transform(s.bins, lambda b, i: case when i = f.at then b + o.current_size else b end) end, coalesce(f.at, len(s.bins) + 1)
  from s join o on o.category_id = s.category_id and o.r = s.r + 1, lateral (select list_position(list_transform(s.bins, lambda b: b + o.current_size <= 1500000), true) as at) f)
 select category_id, id, current_size, bin1 - 1 as bin from s)""")
def q_first_fit_bins_all(spark, d):
    a = V.archive(spark, d)
    none = spark.createDataFrame([], "category_id long, name string, size long")
    return T.first_fit(a.select("category_id", F.col("id").alias("seq"), F.col("current_size").alias("size")), none, 1_500_000)


@query("select archive_id, line, path_in_archive, bool_and(compressed_size >= 1000) over (partition by archive_id) as committed from v_item")
def q_batch_all_or_nothing(spark, d):
    return T.all_or_nothing(V.item(spark, d).withColumn("ok", F.col("compressed_size") >= 1000), "archive_id", "ok").select("archive_id", "line", "path_in_archive", "committed")


@query("select archive_id, path_in_archive, original_size, 'old' as origin from v_item i where not exists (select 1 from v_item n where n.line = 3 and n.archive_id = i.archive_id and n.path_in_archive = i.path_in_archive) union all select archive_id, path_in_archive, original_size + 1, 'new' from v_item where line = 3")
def q_replace_members(spark, d):
    i = V.item(spark, d)
    new = i.filter("line = 3").select("archive_id", "path_in_archive", (F.col("original_size") + 1).alias("original_size"), F.lit("new").alias("origin"))
    return T.replace_members(i.select("archive_id", "path_in_archive", "original_size", F.lit("old").alias("origin")), new, ["archive_id", "path_in_archive"])


@query("""select item_key, case when ok then split_part(c, ':', 2) end as strategy, case when ok then split_part(c, ':', 3) end as sha256, case when ok then try_cast(split_part(c, ':', 4) as bigint) end as size from (select *, regexp_matches(c, '^smart:[^:]*:[^:]*:-?[0-9]{1,18}$') as ok from (
 select item_key, case line when 5 then 'smart:' || original_hash when 6 then 'other:x:y:1' when 7 then 'smart:generic_zstd:' || original_hash || ':12x' else 'smart:' || coalesce(strategy, 'baseline_zip') || ':' || original_hash || ':' || cast(original_size as varchar) end as c from v_item))""")
def q_parse_tag(spark, d):
    line, h = F.col("line"), F.col("original_hash")
    tag = F.when(line == 5, F.concat(F.lit("smart:"), h)).when(line == 6, "other:x:y:1").when(line == 7, F.concat(F.lit("smart:generic_zstd:"), h, F.lit(":12x"))).otherwise(F.concat(F.lit("smart:"), F.coalesce("strategy", F.lit("baseline_zip")), F.lit(":"), h, F.lit(":"), F.col("original_size").cast("string")))
    return V.item(spark, d).select("item_key", C.parse_tag(tag).alias("t")).select("item_key", "t.strategy", "t.sha256", "t.size")
