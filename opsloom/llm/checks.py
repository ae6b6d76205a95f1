"""DuckDB SQL of the corpus queries, written from their definitions and not from the code."""

EXACT_DEDUP = r"""
with t as (
    select doc_id, length(coalesce(text, '')) as points,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body
    from documents
), g as (
    select body, count(*) as group_size, max(points) as most from t group by body
), k as (
    select t.body, min(t.doc_id) as keep_id
    from t join g on t.body = g.body and t.points = g.most group by t.body
)
select t.doc_id, k.keep_id, g.group_size,
    t.doc_id is not distinct from k.keep_id and t.points = g.most as kept,
    sha256(t.body) as text_sha256
from t join g using (body) join k using (body)
"""

MIXING = r"""
with d as (
    select doc_id, source,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
        md5('mix-1|' || coalesce(doc_id::varchar, '')) as drawn
    from documents
), s as (
    select source, sum(size)::bigint as source_size from d group by source
), w as (
    select source, source_size, 2 * source_size as cap, sum(source_size) over ()::double as total,
        case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight
    from s
), l as (
    select *, (total * 1.5e0 - coalesce(sum(cap) over (order by cap::double / weight, source nulls last
            rows between unbounded preceding and 1 preceding), 0)::double)
        / (sum(weight) over (order by cap::double / weight, source nulls last
            rows between current row and unbounded following))::double as level
    from w
), t as (
    select source, source_size, total, least(weight * max(case when cap::double / weight >= level then level end) over (),
        cap::double) as target
    from l
), b as (
    select *, sum(target) over () as mix,
        greatest(1, least(ceil(total * 1.5e0 / 65536),
            greatest(floor(smallest / 64), least(2, floor(smallest)))))::bigint as block
    from (select *, min(case when target > 0 then target end) over () as smallest from t)
), q as (
    select source, source_size, target, block, k,
        row_number() over (order by target / (k - 0.5e0) desc, source nulls last, k)
            <= floor(mix / block + 0.5e0) as won
    from b, unnest(range(1, (target / block)::bigint + 50)) as u(k)
), a as (
    select b.source, b.source_size, b.target,
        least(b.block * coalesce(n, 0), 2 * b.source_size)::bigint as quota
    from b left join (select source, count(*) filter (where won) as n from q group by source) x
        on b.source is not distinct from x.source
), p as (
    select *, case when source_size > 0 then quota // source_size else 0 end as passes,
        case when source_size > 0 then quota % source_size else 0 end as rest
    from a
), c as (
    select *, sum(size) over (partition by source order by drawn, doc_id, size
        rows between unbounded preceding and current row) - size as ahead
    from d
)
select c.doc_id, c.size, p.source_size, p.target,
    (p.passes * c.size + greatest(0, least(c.size, p.rest - c.ahead)))::bigint as taken
from c join p on c.source is not distinct from p.source
"""

DIVERGENCE = r"""
with t as (
    select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc,
        regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents
), w as (
    select lang, source, doc, unnest(terms) as term from t
), k as (
    select lang, term from w group by lang, term having count(distinct doc) >= 30
), v as (
    select lang, count(*) as size from k group by lang
), g as (
    select distinct lang, source from t
), c as (
    select w.lang, w.source, w.term, count(*) as n from w join k using (lang, term) group by all
), full_counts as (
    select g.lang, g.source, k.term, coalesce(c.n, 0) as n
    from g join k on g.lang = k.lang
    left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), of_groups as (
    select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5))
        // (sum(n) over (partition by lang, source) + 5 * size) as p
    from full_counts join v using (lang)
), of_langs as (
    select lang, term, 1 + (1000000000::hugeint * (sum(n) + 5))
        // (sum(sum(n)) over (partition by lang) + 5 * any_value(size)) as q
    from full_counts join v using (lang) group by lang, term
), pairs as (
    select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
    from of_groups a join of_groups b on a.lang = b.lang and a.term = b.term and a.source <> b.source
    group by all
    union all
    select a.lang, a.source, b.source, 0
    from g a join g b on a.lang = b.lang and a.source <> b.source
    where a.lang not in (select lang from v)
), over_terms as (
    select lang, source, term as item, p - q as value
    from of_groups join of_langs using (lang, term) where n > 0 and p > q
), parts as (
    select *, 'pair' as part from pairs union all select lang, source, item, value, 'term' from over_terms
), r as (
    select lang, source, part, item, value::bigint as value,
        row_number() over (partition by lang, source, part order by value desc, item)::int as rank
    from parts
)
select * from r where part = 'pair' or rank <= 50
"""
