"""Queries of this subpackage, one per operator: thin contracts over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, crf_quality, decontam, html_extract, ngram_join, pii, ranked_search, records, rules_forest, suffix_dedup, url_filter,
               warc, whitening)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


OP1_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + 9], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
lens as (select distinct n from win),
gram as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
occ as (select g.doc_id, g.i, g.n, win.item_id from gram g join win on g.n = win.n and g.s = win.s),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from occ) group by 1),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed
  from (select distinct doc_id, cast(item_id as varchar) as item from occ) group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(listed, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""


@query("op1_decontamination", OP1_SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", "n_items",
                        listed.alias("items_sha256"), "contaminated")


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.documents_with_spans(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind))
    counts = [of(kind).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts,
                        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules_forest.judge(docs, rules_forest.fit(docs, table(spark, sf_dir, "labels")))


OP9_SQL = """
with p as (
  select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h,
    max(page_id) over (partition by coalesce(html, '')) as kept from pages),
g as (
  select *, list_transform(range(8), lambda i: cast('0x' || substr(h, 5 * i + 1, 5) as integer)) as bits,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' as letters from p)
select page_id, cast(strlen(body) as bigint) as payload_bytes,
  array_to_string(list_transform(bits, lambda v: letters[(v >> 15) + 1] || letters[((v >> 10) & 31) + 1]
    || letters[((v >> 5) & 31) + 1] || letters[(v & 31) + 1]), '') as payload_digest,
  case when page_id = kept then 'response' else 'revisit' end as record_type,
  case when page_id = kept then null else kept end as refers_to
from g
"""


@query("op9_warc", OP9_SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(spark, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_records")
def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.read_records(spark, records.write_records(table(spark, sf_dir, "documents"), vocabulary()))


@query("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = crf_quality.score(docs, crf_quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", crf_quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


OP4_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as gram
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
link as (
  select a.doc_id as a, b.doc_id as b from s a join s b on a.gram = b.gram and a.doc_id < b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
edge as (select a, b from link union all select b, a from link),
reach(v, u) as (select doc_id, doc_id from d union select reach.v, edge.b from reach join edge on reach.u = edge.a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id
from d left join n using (doc_id) join (select v as doc_id, min(u) as component_id from reach group by v) c using (doc_id)
"""


@query("op4_ngram_join", OP4_SQL)
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP3_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as materialized (
  select doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) as s
  from (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) as i from d where len(h) >= 100)),
least_id as (select s, min(doc_id) as first from w group by s),
hit as (select doc_id, i from w join least_id using (s) where first < doc_id),
step as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from hit),
span_start as (
  select doc_id, i, sum(case when before is null or i > before + 50 then 1 else 0 end)
    over (partition by doc_id order by i) as k from step),
span as (select doc_id, k, min(i) as x, max(i) + 50 as y from span_start group by doc_id, k),
cut as (
  select doc_id, cast(sum(y - x) as bigint) as n_removed, count(*) as n_spans,
    list(x order by x) || [null] as xs, [0] || list(y order by x) as ys from span group by doc_id)
select d.doc_id, cast(len(h) // 2 as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when n_spans is null then h else array_to_string(list_transform(range(1, len(xs) + 1),
    lambda k: substr(h, 2 * ys[k] + 1, 2 * (coalesce(xs[k], len(h) // 2) - ys[k]))), '') end)) as kept_sha256
from d left join cut using (doc_id)
"""


@query("op3_suffix_dedup", OP3_SQL)
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.cut_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
with d as (
  select doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as terms from documents),
total as (
  select cast(count(*) as bigint) as docs, cast(sum(len(terms)) as bigint) as words from d where len(terms) > 0),
tf as (
  select doc_id, n, term, cast(count(*) as bigint) as tf
  from (select doc_id, cast(len(terms) as bigint) as n, unnest(terms) as term from d) group by all),
item as (
  select distinct item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) as term from benchmark),
weight as (
  select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w
  from tf, total group by term, docs),
scored as (
  select item_id, doc_id,
    cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words)))) as bigint) as score
  from item join weight using (term) join tf using (term), total group by item_id, doc_id),
placed as (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as place from scored where score > 0)
select item_id, cast(place as integer) as rank, doc_id, score from placed where place <= 10
"""


@query("op11_ranked_search", OP11_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


OP12_SQL = r"""
with p as (
  select page_id, coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as low,
    case when contains(url, '://') then split_part(split_part(substr(url, instr(url, '://') + 3), '?', 1), '#', 1)
      else '' end as rest from pages),
u as (
  select page_id, low, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    substr(rest, len(split_part(rest, '/', 1)) + 1) as path from p),
rules(verdict, rhost, rpath) as (values %s),
fits as (
  select distinct low, host, path, rhost || rpath as rule, verdict,
    row_number() over (partition by low, host, path order by len(rhost) desc, len(rpath) desc) as place
  from (select distinct low, host, path from u) join rules
    on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)),
vocabulary(term, weight) as (values %s),
hits as (
  select low, sum(weight) as weight from (select distinct low from u) join vocabulary
    on regexp_matches(low, '(^|[\x00-\x2F\x3A-\x60\x7B-\x7F])' || term || '([\x00-\x2F\x3A-\x60\x7B-\x7F]|$)')
  group by low)
select page_id, host, path, rule, coalesce(verdict, case when coalesce(weight, 0) >= %d then 'block' else 'allow' end) as verdict
from u left join (select * from fits where place = 1) using (low, host, path) left join hits using (low)
""" % (", ".join(map(str, url_filter.RULES)),
       ", ".join(map(str, [*url_filter.SOFT.items(), *((t, url_filter.LIMIT) for t in url_filter.STRICT)])), url_filter.LIMIT)


@query("op12_url_filter", OP12_SQL)
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
