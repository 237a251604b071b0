"""One query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from provisor.llm.binary import new_folder, read_ids, write_ids
from provisor.llm.fingerprints import edited_fingerprints
from provisor.llm.forest import nearest
from provisor.llm.jaccard import similar_sets
from provisor.llm.lexical import best_documents
from provisor.llm.licenses import scan
from provisor.llm.lines import remove_repeated_lines
from provisor.llm.merkle import verified_manifest
from provisor.llm.mixing import mix
from provisor.llm.packing import pack_documents
from provisor.llm.quality import score
from provisor.llm.registry import query, table
from provisor.llm.subspace import near_vectors
from provisor.llm.substrings import remove_repeats

OP10_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') s from d, unnest(range(1, len(w) - 11)) t(i)),
low as (select s, min(doc_id) m from win group by s),
bad as (select win.doc_id, win.i from win join low using (s) where m < win.doc_id),
gone as (select doc_id, list(distinct i + j) g from bad, unnest(range(0, 13)) r(j) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(len(g), 0)::bigint n_removed,
  sha256(case when g is null then array_to_string(w, ' ')
    else array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda x: not list_contains(g, x)), lambda x: w[x]), ' ') end) kept_sha256
from d left join gone using (doc_id)
"""


@query("op10_substring_dedup", OP10_SQL)
def op10(spark, folder):
    return remove_repeats(table(spark, folder, "documents"), 13, text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op8_token_files")
def op8(spark, folder):
    target = new_folder(spark)
    write_ids(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, target)
    return read_ids(spark, target, digest=True)


@query("op1_best_fit_packing")
def op1(spark, folder):
    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 0, 2048)


OP2_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size from documents),
s as (select source, sum(size)::bigint ss, count(*) n, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3)::int + 1] w
  from d group by source),
r as (select *, 3.0::double * ss / w ratio, (sum(ss) over ())::bigint total,
  coalesce(sum(3 * ss) over (order by 3.0::double * ss / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint c,
  (sum(w) over (order by 3.0::double * ss / w, source nulls last rows between current row and unbounded following))::bigint wk from s),
lam as (select coalesce((select (total - c)::double / wk from r where (total - c)::double / wk <= ratio order by ratio, source nulls last limit 1), 0.0) l),
g as (select source, ss, least((3 * ss)::double, w * l) target from s, lam),
x as (select d.doc_id, size, ss, target, case when ss > 0 then floor(target)::bigint // ss else 0 end e, floor(target)::bigint b,
  coalesce(sum(size) over (partition by d.source order by ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint, doc_id, size
    rows between unbounded preceding and 1 preceding), 0)::bigint before
  from d join g on d.source is not distinct from g.source)
select doc_id, size, ss source_size, target, (e * size + greatest(0, least(size, b - e * ss - before)))::bigint taken from x
"""


@query("op2_mix_sources", OP2_SQL)
def op2(spark, folder):
    return mix(table(spark, folder, "documents"))


@query("op3_document_fingerprints")
def op3(spark, folder):
    return edited_fingerprints(table(spark, folder, "documents"))


OP7_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
g as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) s from w),
n as (select w.doc_id, count(s)::bigint n from w left join g using (doc_id) group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) i from g a join g b using (s) where a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
r as (with recursive t(a, b) as (select doc_id, doc_id from n union select t.a, e.b from t join e on t.b = e.a) select a, min(b) c from t group by a)
select n.doc_id, n n_shingles, c component_id from n join r on r.a = n.doc_id
"""


@query("op7_ngram_jaccard", OP7_SQL)
def op7(spark, folder):
    return similar_sets(table(spark, folder, "documents"), 4, 85, lower=True)


@query("op5_line_dedup")
def op5(spark, folder):
    """doc_id, characters and SHA-256 of the text that is left."""
    kept = remove_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


@query("op4_prefix_forest")
def op4(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


@query("op6_quality_cotraining")
def op6(spark, folder):
    return score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_license_scan")
def op9(spark, folder):
    return scan(table(spark, folder, "documents"))


OP12_SQL = r"""
with recursive f(doc_id, source, head, text, odd) as (select doc_id, source,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-'), text,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 2 = 0
  from documents),
l as (select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) leaf, case when odd then
    sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) end bad from f),
p as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by source) n from l),
t(source, lvl, i, h, n) as (select source, 0, i, leaf, n from p
  union all select source, lvl + 1, i // 3, sha256(string_agg(h, '' order by i)), any_value(n + 2) // 3 from t where n > 1 group by source, lvl, i // 3),
s as (select source, lvl height, h subroot, row_number() over (order by encode(source) nulls first) - 1 k, count(*) over () m from t where n = 1),
u(lvl, i, h, n) as (select 0, k, subroot, m from s
  union all select lvl + 1, i // 3, sha256(string_agg(h, '' order by i)), any_value(n + 2) // 3 from u where n > 1 group by lvl, i // 3),
a as (select b.source, b.lvl, b.i, coalesce(string_agg(c.h, '' order by c.i) filter (c.i < b.i), '') x, coalesce(string_agg(c.h, '' order by c.i) filter (c.i > b.i), '') y
  from t b join t c on b.source is not distinct from c.source and b.lvl = c.lvl and b.i // 3 = c.i // 3 where b.n > 1 group by all),
b as (select b.lvl, b.i, coalesce(string_agg(c.h, '' order by c.i) filter (c.i < b.i), '') x, coalesce(string_agg(c.h, '' order by c.i) filter (c.i > b.i), '') y
  from u b join u c on b.lvl = c.lvl and b.i // 3 = c.i // 3 where b.n > 1 group by all),
w as (select p.source, p.i, list(x || '|' || y order by a.lvl) w from p join a on p.source is not distinct from a.source and a.i = p.i // (3 ** a.lvl)::bigint group by all),
v as (select k, list(x || '|' || y order by b.lvl) v from s join b on b.i = k // (3 ** b.lvl)::bigint group by all),
z as (select p.*, subroot, (select h from u where n = 1) root, list_concat(coalesce(w, []), coalesce(v, [])) steps
  from p join s on p.source is not distinct from s.source left join w on p.source is not distinct from w.source and p.i = w.i left join v on s.k = v.k)
select doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) proof_sha256,
  list_reduce(list_prepend(coalesce(bad, leaf), steps), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) folded_root, folded_root = root verified from z
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12(spark, folder):
    return verified_manifest(table(spark, folder, "documents"))


OP13_SQL = r"""
with recursive v as (select row_number() over () k, vec_id, list_transform(embedding, lambda x: x::double) e from embeddings),
g as (select k, vec_id, e from v where vec_id is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select a.k a, b.k b from g a join g b on a.k <> b.k and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95),
r(a, b) as (select k, k from v union select r.a, p.b from r join p on r.b = p.a),
n as (select a, count(*) n from p group by a),
c as (select r.a, min(v.vec_id) c from r join v on r.b = v.k group by r.a)
select vec_id, coalesce(n, 0)::bigint n_links, c component_id, vec_id is not distinct from c kept from v join c on v.k = c.a left join n on v.k = n.a
"""


@query("op13_subspace_join", OP13_SQL)
def op13(spark, folder):
    return near_vectors(table(spark, folder, "embeddings"))


OP11_SQL = r"""
with t as (select row_number() over () k, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) t from documents),
d as (select k, doc_id, t, len(t)::bigint n from t where len(t) > 0),
s as (select count(*)::bigint nn, sum(n)::bigint ll from d),
f as (select k, unnest(t) t from d),
g as (select k, t, count(*)::bigint tf from f group by all),
h as (select t, count(*) df from g group by t),
i as (select distinct item_id, text from benchmark),
q as (select item_id, text, t, count(*)::bigint r from (select item_id, text, unnest(list_transform(regexp_extract_all(coalesce(text, ''),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) t from i) group by all),
w as (select q.*, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint w from q join h using (t), s),
c as (select item_id, text, doc_id, d.k, sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll))))::bigint score
  from w join g using (t) join d on d.k = g.k, s group by all having score > 0),
o as (select *, row_number() over (partition by item_id, text order by score desc, doc_id nulls last)::int rank from c)
select item_id, rank, doc_id, score from o where rank <= 20
"""


@query("op11_dual_tree_search", OP11_SQL)
def op11(spark, folder):
    return best_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 20)
