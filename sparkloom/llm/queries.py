"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, html, jaccard, langid, media, mixing, repeats, secrets, tokens, toxicity, urls, veccodes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(_table(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_report(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_report(_table(spark, sf_dir, "pages"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.code_report(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_media_columns, op3_token_output, op4_language_id, op5_url_filter, op6_html_extraction, op7_source_mixing, op8_decontamination, op9_jaccard_join, op10_secret_scan, op11_suffix_dedup, op12_source_divergence, op13_vector_codes, pipeline)}

#: Window containment over word positions: every window of an item against every run of as many words of a document.
DECONTAMINATION = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
windows as (select distinct item, k, array_to_string(w[i:i + k - 1], ' ') as t from (select *, unnest(range(1, len(w) - k + 2)) as i from (select *, least(10, len(w)) as k from b where len(w) > 0))),
ks as (select distinct k from windows),
spots as (select r, s, k, array_to_string(w[s:s + k - 1], ' ') as t from (select r, w, k, unnest(range(1, len(w) - k + 2)) as s from d, ks where len(w) >= k)),
found as (select r, s, k, item from spots join windows using (k, t)),
hit as (select r, count(distinct p) as n from (select r, unnest(range(s, s + k)) as p from (select distinct r, s, k from found)) group by r),
items as (select r, count(distinct item) as n, string_agg(distinct item, ',' order by item) as ids from found group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(hit.n, 0) as bigint) as n_hit, cast(coalesce(items.n, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit using (r) left join items using (r)
"""

#: All pairs of documents that share a shingle, links among them, and what is reachable.
JACCARD = r"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct r, g from (select r, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from d)),
n as (select r, count(*) as n from s group by r),
shared as (select a.r as x, b.r as y, count(*) as c from s a join s b on a.g = b.g and a.r < b.r group by 1, 2),
links as (select x, y from shared join n a on a.r = x join n b on b.r = y where 100 * c >= 85 * (a.n + b.n - c)),
sides as (select x, y from links union all select y, x from links),
reach as (select r, r as c from d union select reach.r, sides.y from reach join sides on sides.x = reach.c)
select d.doc_id, coalesce(max(n.n), 0) as n_shingles, min(e.doc_id) as component_id from d left join n using (r) join reach using (r) join d e on e.r = reach.c group by d.r, d.doc_id
"""

ORACLES = {"op5_url_filter": urls.ORACLE, "op7_source_mixing": mixing.ORACLE, "op8_decontamination": DECONTAMINATION, "op9_jaccard_join": JACCARD, "op11_suffix_dedup": repeats.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_vector_codes": veccodes.ORACLE}
