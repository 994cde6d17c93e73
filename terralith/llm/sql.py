"""DuckDB SQL for the queries of this subpackage that SQL can express, over the same tables."""

from __future__ import annotations

#: Windows of 20 words, and words that a window covers whose sequence also starts earlier.
OP2 = r"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
win as (select doc_id, k, array_to_string(words[k:k + 19], ' ') as seq from w, unnest(range(1, greatest(1, len(words) - 18))) as t(k)),
gone as (select doc_id, k from (select doc_id, k, min(doc_id) over (partition by seq) as least, min(k) over (partition by seq, doc_id) as first from win) where doc_id > least or k > first),
cut as (select distinct g.doc_id, k + o as at from gone g, unnest(range(0, 20)) as t(o)),
parts as (select w.doc_id, k, words[k] as word, c.at is not null as cut from w, unnest(range(1, len(words) + 1)) as t(k) left join cut c on c.doc_id = w.doc_id and c.at = k),
kept as (select doc_id, count(*) filter (cut) as removed, string_agg(word, ' ' order by k) filter (not cut) as kept from parts group by doc_id)
select w.doc_id::bigint as doc_id, len(words)::bigint as n_words, coalesce(p.removed, 0)::bigint as n_removed, sha256(coalesce(p.kept, '')) as kept_sha256
from w left join kept p on p.doc_id = w.doc_id"""

#: Strings of 400 bytes as stretches of hexadecimal digits, by a 64-bit hash, from pieces of 400 of them; spans are islands
#: of their starts.
OP3 = r"""with d as (select doc_id, hex(coalesce(text, '')) as h from documents),
piece as (select doc_id, p * 400 as base, greatest(0, least(400, len(h) // 2 - 399 - p * 400)) as n, substr(h, 800 * p + 1, 1598) as x from (select doc_id, h, unnest(range(0, greatest(0, (len(h) // 2 - 400) // 400 + 1))) as p from d)),
win as (select doc_id, base + unnest(range(0, n)) as k, unnest(list_transform(range(0, n), lambda k: hash(substr(x, 2 * k + 1, 800)))) as a from piece),
rep as (select doc_id, k, lag(k) over (partition by doc_id order by k) as before from win where a in (select a from win group by a having count(*) > 1)),
marked as (select doc_id, k, sum(case when before is null or k > before + 400 then 1 else 0 end) over (partition by doc_id order by k) as span from rep),
spans as (select doc_id, min(k) as a, max(k) + 400 as z from marked group by doc_id, span),
ends as (select doc_id, a, z, lag(z, 1, 0) over (partition by doc_id order by a) as since from spans),
kept as (select doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' order by a) as keep, max(z) as last, sum(z - a) as removed, count(*) as n from ends join d using (doc_id) group by doc_id)
select d.doc_id::bigint as doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans, sha256(unhex(coalesce(keep, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join kept using (doc_id)"""

#: Shared shingles by a join, and the components that links reach by recursion.
OP5 = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
shingle as (select distinct doc_id, array_to_string(words[k:k + 4], ' ') as s from w, unnest(range(1, greatest(case when len(words) > 0 then 2 else 1 end, len(words) - 3))) as t(k)),
sizes as (select doc_id, count(*) as n from shingle group by doc_id),
shared as (select a.doc_id as u, b.doc_id as v, count(*) as m from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select u, v from shared join sizes x on x.doc_id = u join sizes y on y.doc_id = v where 100 * m >= 75 * (x.n + y.n - m)),
edge as materialized (select u, v from link union all select v, u from link),
reach as (select u as doc_id, u as r from edge union select reach.doc_id, edge.v from reach join edge on edge.u = reach.r),
least as (select doc_id, min(r) as least from reach group by doc_id)
select d.doc_id::bigint as doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.least, d.doc_id)::bigint as component_id
from documents d left join sizes n on n.doc_id = d.doc_id left join least c on c.doc_id = d.doc_id"""

ORACLES = {"op2_seed_extend_dedup": OP2, "op3_suffix_array_dedup": OP3, "op5_ngram_jaccard_join": OP5}
