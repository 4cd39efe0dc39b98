"""Registration of queries: a function of (spark, sf_dir), and the SQL that
gives the same rows on the same tables."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: The fixture views in SQL, as stowage.plans.fixtures has them in DataFrames.
VIEWS = {
    "v_category": "select cast(n_nationkey as bigint) as id, n_name as name, r_name as grp from nation join region on n_regionkey = r_regionkey",
    "v_archive": """select o_orderkey as id, cast(c_nationkey as bigint) as category_id, 'arc_' || lpad(cast(o_orderkey as varchar), 9, '0') || '.zip' as file_name,
        cast(floor(o_totalprice) as bigint) as current_size, o_orderkey % 5 as item_count,
        case o_orderstatus when 'F' then 'VERIFIED' when 'O' then 'CHANGED' else 'CORRUPTED' end as integrity_status, o_orderdate as created_at
        from orders join customer on o_custkey = c_custkey""",
    "v_item": """select *, sha256(concat_ws('|', cast(archive_id as varchar), cast(line as varchar), path_in_archive, cast(original_size as varchar), cast(compressed_size as varchar), status)) as item_key from (
        select l_orderkey as archive_id, cast(l_linenumber as bigint) as line, 'part_' || cast(l_partkey as varchar) || '.' || case l_partkey % 6 when 0 then 'txt' when 1 then 'csv' when 2 then 'json' when 3 then 'JPG' when 4 then 'zip' else 'py' end as file_name,
        'd' || cast(l_suppkey % 10 as varchar) || '/part_' || cast(l_partkey as varchar) as path_in_archive,
        cast(floor(l_extendedprice) as bigint) as original_size, cast(floor(l_extendedprice * (1 - l_discount)) as bigint) as compressed_size,
        case l_returnflag when 'R' then 'CHECKED_OUT' else 'ARCHIVED' end as status, sha256(cast(l_partkey as varchar) || ':' || cast(l_suppkey as varchar)) as original_hash,
        case l_linenumber % 4 when 1 then 'generic_zstd' when 2 then 'generic_lzma' when 3 then 'generic_zlib' end as strategy from lineitem)""",
    "v_file": """select doc_id as seq, source || '/' || cast(doc_id as varchar) || '.' || ext as relpath, ext, text as content, cast(strlen(text) as bigint) as size, sha256(text) as sha256
        from (select *, case lang when 'en' then 'txt' when 'de' then 'md' when 'fr' then 'csv' when 'es' then 'json' else 'bin' end as ext from documents)""",
    "v_candidate": """select l_orderkey as file, cast(l_linenumber as bigint) as pos, cast(sum(cast(floor(l_extendedprice * 8192) as bigint)) as bigint) as baseline,
        cast(sum(cast(floor(l_extendedprice * (1 - l_discount) * 8192) as bigint)) as bigint) as candidate, cast(12 * sum(cast(round(l_tax * 100) as bigint)) as bigint) as seconds,
        bool_and(not (l_returnflag = 'N' and l_quantity < 5)) as sha_ok from lineitem group by 1, 2""",
    "v_decided": """select *, case l_mod when 0 then 'generic_lzma' when 1 then 'generic_zstd' when 2 then 'generic_brotli' else 'generic_zlib' end as strategy from (
        select *, pos % 4 as l_mod, case when not sha_ok then 'SHA256_MISMATCH' when candidate >= baseline then 'NOT_SMALLER_THAN_BASELINE' when seconds > 90 then 'EXCEEDS_ABSOLUTE_TIMEOUT'
        when baseline - candidate < 1048576 and (baseline - candidate) * 100 < 3 * baseline then 'BENEFIT_TOO_SMALL'
        when not (baseline - candidate >= 52428800 or (baseline - candidate) * 5 >= baseline or seconds <= 0 or baseline >= 2097152 * seconds or seconds <= 1) then 'COST_NOT_JUSTIFIED_BY_BENEFIT' else 'ACCEPTED' end as reason from v_candidate)""",
    "v_best": """select f.file, f.baseline, coalesce(w.strategy, 'baseline_zip') as selected, coalesce(w.candidate, f.baseline) as selected_bytes, w.file is null as used_fallback
        from (select file, max(baseline) as baseline from v_candidate group by 1) f left join (select * from (select *, row_number() over (partition by file order by candidate, pos) as r from v_decided where reason = 'ACCEPTED') where r = 1) w on f.file = w.file""",
    "v_op": "select event_id, user_id as actor, event_type as operation, cast(floor(value * 100) as bigint) as ms, cast(json_extract_string(props, '$.k') as bigint) as k, ts from events",
}
NEEDS = {"v_decided": ["v_candidate"], "v_best": ["v_candidate", "v_decided"]}


def query(sql: str | None = None):
    """Registers the function by its name. The SQL may use the fixture views,
    which are put before it."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            used: list[str] = []
            for v in VIEWS:
                if v in sql:
                    used += [x for x in [*NEEDS.get(v, []), v] if x not in used]
            order = [v for v in VIEWS if v in used]
            ORACLES[f.__name__] = ("with " + ", ".join(f"{v} as ({VIEWS[v]})" for v in order) + "\n" if order else "") + sql
        return f

    return put
