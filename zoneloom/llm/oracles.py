"""The registered queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

# CRC-32 (reflected polynomial edb88320) byte by byte; the table comes from eight shifts of every byte value.
CRC = """
crc_steps(i, k, c) as (
 select i, 0, i::ubigint from range(256) r(i) union all
 select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end from crc_steps where k < 8),
crc_table as (select list(c order by i) as t from crc_steps where k = 8)"""


def crc_of(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes; needs ``crc_table`` in scope."""
    codes = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::ubigint)"
    step = "lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::bigint])"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {codes}), {step}), 4294967295::ubigint)::bigint"


ORACLES = {
    "op6_sharding": f"""
with recursive {CRC},
sized as (select doc_id, coalesce(doc_id::varchar, '') as k, (coalesce(octet_length(encode(text)), 0) + 16)::bigint as size,
  {crc_of("coalesce(text, '')")} as text_crc32 from documents, crc_table),
costs as (select doc_id, k, size, text_crc32, list_transform(range(41), lambda s: struct_pack(
   cost := -ln((('0x' || substr(md5(k || ':' || s::varchar), 1, 13))::bigint::double + 0.5) / 4503599627370496.0), shard := s::int)) as c from sized),
placed as (select doc_id, k, size, text_crc32, list_min(c[1:40]).shard as shard, list_min(c).shard as grown_shard,
  ('0x' || substr(md5('slot:' || k), 1, 8))::bigint % (select greatest(16, ceil(count(*) / 800000.0)) from documents)::bigint as b from costs)
select doc_id, size, text_crc32, 'key' as law, shard,
 row_number() over (partition by shard order by b, doc_id nulls first, text_crc32, size) - 1 as slot, grown_shard from placed""",
    "op11_filter_audit": r"""
with texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
least as (select t, min(doc_id) as m from texts group by t),
marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
flags as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
  [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t),
   regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > m, false)] as f
  from texts join least using (t) left join marks using (doc_id)),
letters as (select unnest(range(5)) as i),
orders as (select [a.i, b.i, c.i, d.i, e.i] as o from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps as (select o, list_reduce(list_transform(o, lambda i: chr(65 + i::int)), lambda x, y: x || y) as filter_order, unnest(range(5)) + 1 as step from orders),
sets as (select part, f, count(*) as n, sum(good) as good, sum(toxic) as toxic from flags group by all),
outcome as (select part, filter_order, step, o[step] as own, n, good, toxic, f[o[step] + 1] as fails,
  not coalesce(list_bool_or(list_transform(o[1:step - 1], lambda i: f[i + 1])), false) as reached, len(list_filter(f, lambda x: x)) as many from sets, steps),
counts as (select part, filter_order, step::int as step, any_value(own) as own,
  coalesce(sum(n) filter (reached and not fails), 0)::bigint as kept, coalesce(sum(n) filter (reached and fails), 0)::bigint as removed,
  coalesce(sum(n) filter (fails and not reached), 0)::bigint as redundant, coalesce(sum(n) filter (fails and many = 1), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (reached and fails), 0)::bigint as good_lost, coalesce(sum(toxic) filter (reached and fails), 0)::bigint as toxic_lost
  from outcome group by part, filter_order, step)
select * exclude (own), (sum(removed) over (partition by part, own))::bigint as shapley from counts""",
    "op13_resampling": rf"""
with recursive {CRC},
words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w, true as corpus from documents union all
 select null, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), false from benchmark),
grams as (select doc_id, corpus, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as g from words),
buckets as (select g, {crc_of("g")} % 10000 as b from (select distinct g from grams), crc_table),
counted as (select doc_id, corpus, b, count(*) as n from grams join buckets using (g) group by all),
sums as (select b, coalesce(sum(n) filter (corpus), 0) as s, coalesce(sum(n) filter (not corpus), 0) as t from counted group by b),
gains as (select b, floor(1000 * ln((t + 1) * (sum(s) over () + 10000)::double / ((s + 1) * (sum(t) over () + 10000))))::bigint as gain from sums),
weights as (select doc_id, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n))::bigint as weight from counted join gains using (b) where corpus group by doc_id),
scored as (select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id::varchar), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from words left join weights using (doc_id) where corpus),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when rank <= 25 * (select count(*) from ranked) // 100 then rank end as rank from scored left join ranked using (doc_id)""",
}
