"""SQL of the operators that SQL can express, for DuckDB."""

OP1 = r"""with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
win as (select r, unnest(range(length(h) // 2 - 399)) as i, h from d where length(h) >= 800),
hashed as (select r, i, md5_number(substr(h, 2 * i + 1, 800)) as m from win),
hit as (select r, i from (select r, i, count(*) over (partition by m) as c from hashed) where c > 1),
edge as (select r, i, case when i - lag(i) over (partition by r order by i) <= 400 then 0 else 1 end as e from hit),
isl as (select r, min(i) as a, max(i) + 400 as b from (select r, i, sum(e) over (partition by r order by i) as k from edge) group by r, k),
short_win as (select r, unnest(range(length(h) // 2 - 223)) as i, h from d where length(h) >= 448),
short_hit as (select r, i from (select r, i, count(*) over (partition by m) as c from (select r, i, md5_number(substr(h, 2 * i + 1, 448)) as m from short_win)) where c > 1),
short_edge as (select r, i, case when i - lag(i) over (partition by r order by i) <= 224 then 0 else 1 end as e from short_hit),
short_isl as (select r, min(i) as a, max(i) + 224 as b from (select r, i, sum(e) over (partition by r order by i) as k from short_edge) group by r, k),
kept as (select r, string_agg(part, '' order by a) as k from (
 select isl.r, a, substr(h, 2 * coalesce(lag(b) over (partition by isl.r order by a), 0) + 1, 2 * (a - coalesce(lag(b) over (partition by isl.r order by a), 0))) as part from isl join d on d.r = isl.r
 union all select isl.r, max(b) + 1, substr(any_value(h), 2 * max(b) + 1) from isl join d on d.r = isl.r group by 1) group by 1)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(s.removed, 0)::bigint as n_removed, coalesce(s.spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256, coalesce(n.n, 0)::bigint as n_repeated, coalesce(n.longest, 0)::bigint as longest_repeat from d left join (select r, sum(b - a) as n, max(b - a) as longest from short_isl group by 1) n on n.r = d.r left join (select r, sum(b - a) as removed, count(*) as spans from isl group by 1) s on s.r = d.r left join kept on kept.r = d.r"""

OP3 = r"""with recursive w as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct r, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from w),
n as (select r, count(*) as n from s group by 1),
meet as (select a.r as x, b.r as y, count(*) as k from s a join s b on a.g = b.g and a.r <> b.r group by 1, 2),
links as (select x, y from meet join n p on p.r = x join n q on q.r = y where 100 * k >= 90 * (p.n + q.n - k)),
reach as (select r as x, r as y from n union select reach.x, links.y from reach join links on reach.y = links.x)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.c, w.doc_id) as component_id from w left join n on n.r = w.r left join (select x, min(w.doc_id) as c from reach join w on w.r = reach.y group by 1) c on c.x = w.r"""

OP6 = r"""with d as (select row_number() over () as r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
 ('0x' || left(md5(coalesce(doc_id::varchar, '') || '|' || coalesce(source, '') || '|' || sha256(coalesce(text, ''))), 15))::bigint as h from documents),
src as (select source, n, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from (select source, sum(size)::bigint as n from d group by 1)),
live as (select *, 2.0::double * n / w as ratio from src where n > 0),
ranked as (select *, row_number() over (order by ratio, source nulls last) as p from live),
levels as (select p, ((select 1.5::double * sum(n) from live) - coalesce(sum(2 * n) over (order by p rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by p rows between current row and unbounded following) as level, ratio from ranked),
cut as (select p, level from levels where level <= ratio order by p limit 1),
target as (select s.source, s.n, case when s.n = 0 then 0.0::double when r.p >= (select p from cut) then r.w * (select level from cut) else 2.0::double * s.n end as target from src s left join ranked r on r.source is not distinct from s.source),
run as (select d.*, t.n, t.target, case when t.n > 0 then floor(t.target / t.n)::bigint else 0 end as rounds, sum(size) over (partition by d.source order by h rows unbounded preceding)::bigint as upto from d join target t on t.source is not distinct from d.source),
more as (select *, target - rounds * n as goal from run)
select doc_id, size, n as source_size, round(target, 6) as target, (size * copies)::bigint as taken, copies::bigint as copies from (
 select *, least(2, rounds + case when goal < 1e-9 then 0 when upto <= goal or (upto - size <= goal and 2 * (goal - (upto - size)) >= size) then 1 else 0 end) as copies from more)"""
