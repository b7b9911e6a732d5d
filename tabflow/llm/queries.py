"""The registered queries of the training-data operators: each applies its
operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.llm import (arc_warc, byte_bpe, decontaminate, inner_product_search, itq, lexical_search, ngram_join, packing,
                         pii, secret_scan, source_divergence, token_counts, toxicity)
from tabflow.llm.common import read
from tabflow.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_arc_to_warc(spark, sf_dir):
    return (arc_warc.archive_round_trip(read(spark, sf_dir, "pages"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


ORACLE_SQL["op1_arc_to_warc"] = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest
           from pages),
     m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as top from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id < top then top end as refers_to
from m
"""


@query
def op2_toxicity(spark, sf_dir):
    return toxicity.predict(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.join(read(spark, sf_dir, "documents"))


@query
def op4_itq_near_duplicates(spark, sf_dir):
    return itq.near_duplicates(read(spark, sf_dir, "embeddings"))


@query
def op5_token_counts(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


@query
def op6_secret_scan(spark, sf_dir):
    return secret_scan.scan(read(spark, sf_dir, "documents"))


@query
def op7_token_packing(spark, sf_dir):
    packed = packing.write_packed(read(spark, sf_dir, "documents"), scratch_path(spark, "packed"))
    return packing.describe(packed)


@query
def op8_personal_data(spark, sf_dir):
    return pii.scan(read(spark, sf_dir, "documents"))


@query
def op9_byte_bpe(spark, sf_dir):
    return byte_bpe.encode_texts(read(spark, sf_dir, "documents"))


@query
def op10_decontamination(spark, sf_dir):
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE_SQL["op10_decontamination"] = r"""
with dw as (select doc_id, row_number() over () as r,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
     iw as (select cast(item_id as varchar) as item_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
     ig as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as gram
            from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from iw where len(w) > 0)),
     sizes as (select distinct n from ig),
     dg as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') as gram
            from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n)),
     hit as (select dg.r, dg.i, dg.n, ig.item_id from dg join ig on dg.gram = ig.gram and dg.n = ig.n),
     covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hit) group by r),
     items as (select r, count(distinct item_id) as n_items,
                      sha256(array_to_string(list_sort(list(distinct item_id)), ',')) as items_sha256 from hit group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join covered using (r) left join items using (r)
"""


@query
def op11_source_divergence(spark, sf_dir):
    return source_divergence.audit(read(spark, sf_dir, "documents"))


ORACLE_SQL["op11_source_divergence"] = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
     o as (select r, lang, source, unnest(w) as term from d),
     kept as (select lang, term, count(*) as n from o group by lang, term having count(distinct r) >= 10),
     v as (select lang, count(*) as v, sum(n) as n from kept group by lang),
     c as (select lang, source, term, count(*) as n from o join kept using (lang, term) group by lang, source, term),
     s as (select lang, source, sum(n) as n from c group by lang, source),
     g as (select lang, source, coalesce(s.n, 0) as n from (select distinct lang, source from d) left join s using (lang, source)),
     p as (select g.lang, g.source, kept.term, coalesce(c.n, 0) as n,
                  1 + (cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 2)) // (g.n + 2 * v.v) as p,
                  1 + (cast(1000000000 as hugeint) * (kept.n + 2)) // (v.n + 2 * v.v) as q
           from g join v using (lang) join kept using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
     f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
           from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
     u as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value
           from g a join g b on a.lang = b.lang and a.source <> b.source
                left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
           union all
           select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) from p where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from u)
where part = 'pair' or rank <= 10
"""


@query
def op12_lexical_search(spark, sf_dir):
    return (lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
            .select("item_id", "rank", "doc_id", "score"))


ORACLE_SQL["op12_lexical_search"] = r"""
with d as (select row_number() over () as r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
     q as (select item, item_id, unnest(list_distinct(w)) as term from (
             select row_number() over () as item, item_id,
                    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from benchmark)),
     s as (select cast(count(*) as bigint) as n_docs, cast(sum(len(w)) as bigint) as total from d where len(w) > 0),
     t as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) semi join q using (term) group by r, term),
     wt as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as weight
            from t, s group by term, n_docs),
     m as (select r, doc_id, 100 - 90 + ((90 * cast(len(w) as bigint) * n_docs) // total) as m from d, s where len(w) > 0),
     x as (select q.item, q.item_id, m.r, m.doc_id,
                  sum(weight * ((1000000000 * cast(tf as bigint)) // (1000 * tf + 8 * m))) as score
           from q join t using (term) join wt using (term) join m using (r) group by all)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score
from (select *, row_number() over (partition by item order by score desc, doc_id nulls last) as rank from x where score > 0)
where rank <= 10
"""


@query
def op13_inner_product_search(spark, sf_dir):
    return inner_product_search.search(read(spark, sf_dir, "embeddings"))


ORACLE_SQL["op13_inner_product_search"] = r"""
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x
           from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (select q.r, q.vec_id as query_id, c.vec_id,
                  cast(case when len(q.x) = 0 then 0 else list_inner_product(q.x, c.x) end as bigint) as score
           from v q join v c on q.vec_id % 50 = 0 and q.r <> c.r and len(q.x) = len(c.x))
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id nulls last) as rank from s)
where rank <= 5
"""
