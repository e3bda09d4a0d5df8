"""DuckDB SQL for the queries that SQL can express."""

ORACLES = {
    "op5_exact_dedup": r"""
with plain as (
    select doc_id, coalesce(text, '') as text,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
    from documents
), ranked as (
    select doc_id, sha256(norm) as text_sha256,
           first_value(doc_id) over w as keep_id,
           count(*) over (partition by norm) as group_size,
           row_number() over w = 1 as kept
    from plain
    window w as (partition by norm order by length(text) desc, doc_id nulls last)
)
select doc_id, keep_id, group_size, kept, text_sha256 from ranked
""",
    "op1_warc": r"""
with payloads as (
    select page_id, encode(coalesce(html, '')) as payload from pages
), typed as (
    select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest,
           case when octet_length(payload) >= 100
                then min(page_id) over (partition by payload) end as keeper
    from payloads
)
select page_id, payload_bytes, payload_digest,
       case when page_id <> keeper then 'revisit' else 'response' end as record_type,
       case when page_id <> keeper then keeper end as refers_to
from typed
""",
    "op12_phrase_collocations": r"""
with recursive pieces as (
    select coalesce(lang, 'und') as lang,
           unnest(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), worded as (
    select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces
), occurrences as (
    select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
    from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i
          from worded, (select unnest(range(1, 6)) as k) where len(w) >= k)
), counts as (
    select lang, k, phrase, count(*) as f from occurrences group by all
), totals as (
    select lang, sum(f)::bigint as n from counts where k = 1 group by lang
), candidates as (
    select lang, k, phrase, f as a, string_split(phrase, ' ') as w from counts where k > 1 and f >= 100
), splits as (
    select lang, k, phrase, a, j,
           array_to_string(w[1:j], ' ') as first_part, array_to_string(w[j + 1:k], ' ') as rest
    from (select *, unnest(range(1, k)) as j from candidates)
), scored as (
    select s.lang, s.k, s.phrase, s.a, s.j, x.f as l, y.f as r, t.n,
           ((1000::hugeint * s.a * t.n) // (x.f::hugeint * y.f))::bigint as score
    from splits s join counts x on x.lang = s.lang and x.phrase = s.first_part
    join counts y on y.lang = s.lang and y.phrase = s.rest
    join totals t on t.lang = s.lang
), lowest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1
), parts as (
    select distinct lang, a, array_to_string(w[i:i + m - 1], ' ') as phrase
    from (select *, unnest(range(1, k - m + 2)) as i
          from (select *, unnest(range(2, k)) as m from candidates where k > 2))
), free as (
    select * from lowest c where not exists (
        select 1 from parts p where p.lang = c.lang and p.phrase = c.phrase and p.a >= c.a)
), ranked as (
    select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank,
           phrase, a, l, r, n, score
    from free qualify rank <= 2000
), edges as (
    select lang, phrase, a, array_to_string(w[1:4], ' ') as source, array_to_string(w[2:5], ' ') as target
    from candidates where k = 5
), joints as (
    select x.lang, x.phrase as before, y.phrase as after
    from counts c join edges x on x.lang = c.lang and x.target = c.phrase and x.a = c.f
    join edges y on y.lang = c.lang and y.source = c.phrase and y.a = c.f
    where c.k = 4 and x.phrase <> y.phrase
), walks as (
    select e.lang, e.phrase as start, e.phrase as edge, 0 as steps from edges e
    where not exists (select 1 from joints j where j.lang = e.lang and j.after = e.phrase)
    union all
    select w.lang, w.start, j.after, w.steps + 1 from walks w
    join joints j on j.lang = w.lang and j.before = w.edge
), paths as (
    select lang, edge, (max(steps) over (partition by lang, start) + 5)::bigint as passage_words from walks
)
select r.*, p.passage_words from ranked r left join paths p on p.lang = r.lang and p.edge = r.phrase
""",
    "op13_embedding_near_dedup": r"""
with recursive vectors as (
    select row_number() over () as no, vec_id, label, embedding::double[] as v,
           label is not null and coalesce(len(embedding) > 0 and len(list_filter(
               embedding, lambda x: x is null or not isfinite(x))) = 0
               and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as usable
    from embeddings
), links as (
    select a.no as a, b.no as b from vectors a join vectors b
    on a.label = b.label and len(a.v) = len(b.v) and a.no <> b.no
    where a.usable and b.usable and list_cosine_similarity(a.v, b.v) >= 0.93
), reach as (
    select no as a, no as b from vectors
    union
    select r.a, l.b from reach r join links l on l.a = r.b
), least as (
    select r.a, min(v.vec_id) as component_id from reach r join vectors v on v.no = r.b group by r.a
)
select v.vec_id, (select count(*) from links l where l.a = v.no) as n_links, least.component_id,
       coalesce(v.vec_id = least.component_id, false) as kept
from vectors v join least on least.a = v.no
""",
    "op6_url_filter": r"""
with recursive split as (
    select page_id,
           case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
    from pages
), parsed as (
    select page_id,
           translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
    from split
), rules(verdict, domain, start) as (
    values ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
           ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits as (
    select page_id, domain || start as rule, verdict from parsed join rules
    on (host = domain or ends_with(host, '.' || domain)) and starts_with(path, start)
    qualify row_number() over (partition by page_id order by length(domain || start) desc) = 1
), segmented as (
    select p.*, f.rule, f.verdict as by_rule, list_transform(
        list_filter(string_split(path, '/'), lambda s: s <> ''),
        lambda s: case
            when regexp_matches(s, '^[0-9]+$') then '*'
            when regexp_matches(s, '^[0-9]+[.][a-zA-Z]+$') then '*' || regexp_extract(s, '[.][a-zA-Z]+$', 0)
            when regexp_matches(s, '^[0-9a-fA-F-]{8,}$') and regexp_matches(s, '[0-9]') then '*'
            else s end) as segments
    from parsed p left join fits f on f.page_id = p.page_id
), spread as (
    select host, i from (
        select host, i, segments[i] as segment, count(*) as n
        from (select *, unnest(range(1, len(segments) + 1)) as i from segmented) group by all)
    group by host, i having count(*) > 20 and sum(n) < 5 * count(*)
), varying as (
    select host, list(i) as places from spread group by host
), templated as (
    select s.*, list_transform(segments, lambda x, i: case
        when list_contains(coalesce(v.places, []), i) and not starts_with(x, '*') then '*' else x end) as t
    from segmented s left join varying v on v.host = s.host
), leaves as (
    select host, t, count(by_rule) as labelled, count(*) filter (by_rule = 'block') as blocked
    from templated group by host, t
), nodes as (
    select host, depth, t[1:depth] as node, case when depth > 0 then t[1:depth - 1] end as parent, sum(labelled) as labelled, sum(blocked) as blocked
    from (select *, unnest(range(0, len(t) + 1)) as depth from leaves) group by all
), family as (
    select *, sum(labelled) over w as all_labelled, sum(blocked) over w as all_blocked from nodes
    window w as (partition by host, depth, parent)
), compared as (
    select *, case when depth = 0 then false when labelled = 0 or labelled = all_labelled then true
        else abs(blocked / labelled - (all_blocked - blocked) / (all_labelled - labelled))
             <= 2.0 * sqrt((all_blocked / all_labelled) * (1 - all_blocked / all_labelled)
                           * (1 / labelled + 1 / (all_labelled - labelled))) end as alike
    from family
), merged as (
    select host, depth, node,
           case when alike then sum(labelled) filter (alike) over w else labelled end as labelled,
           case when alike then sum(blocked) filter (alike) over w else blocked end as blocked
    from compared window w as (partition by host, depth, parent)
), total as (
    select sum(blocked) / greatest(sum(labelled), 1) as share from leaves
), walk as (
    select l.host, l.t, 0 as depth, (m.blocked + 2.0 * share) / (m.labelled + 2.0) as purity
    from leaves l join merged m on m.host = l.host and m.depth = 0, total
    union all
    select w.host, w.t, w.depth + 1, (m.blocked + 2.0 * w.purity) / (m.labelled + 2.0)
    from walk w join merged m on m.host = w.host and m.depth = w.depth + 1 and m.node = w.t[1:w.depth + 1]
    where w.depth < len(w.t)
)
select p.page_id, p.host, p.path, p.rule,
       coalesce(p.by_rule, case when w.purity >= 0.85 then 'block' else 'allow' end) as verdict,
       array_to_string(p.t, '/') as template
from templated p join walk w on w.host = p.host and w.t = p.t and w.depth = len(p.t)
""",
    "op3_decontamination": r"""
with texts as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
), items as (
    select item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
), windows as (
    select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as words
    from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i
          from items where len(w) > 0)
), sizes as (
    select distinct n from windows
), places as (
    select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as words
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from texts, sizes where len(w) >= n)
), found as (
    select p.doc_id, p.i, p.n, x.item_id from places p join windows x on x.n = p.n and x.words = p.words
), hits as (
    select doc_id, count(distinct place) as n_hit
    from (select doc_id, unnest(range(i, i + n)) as place from (select distinct doc_id, i, n from found))
    group by doc_id
), listed as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by encode(item)) as items
    from (select distinct doc_id, item_id::varchar as item from found) group by doc_id
)
select t.doc_id, len(t.w) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(l.n_items, 0) as n_items,
       sha256(coalesce(l.items, '')) as items_sha256,
       coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(t.w) as contaminated
from texts t left join hits h on h.doc_id = t.doc_id left join listed l on l.doc_id = t.doc_id
""",
}
