"""Queries opN_<name>: each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontam, langid, linededup, maxent, neardup, quality, suffixdedup, tokencount, urlfilter
from lodestone.llm.base import table

#: Vocabulary for op8 and the pipeline; any file of ranks will do.
VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    model, counts = maxent.fit(docs.where(~F.col("held_out")))
    return maxent.score(docs, model, counts, ["held_out"])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_after_edits(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The contract's rules.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digests(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, ["held_out"])


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY, PATTERN)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold="0.85")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_ALL = (
    op1_decontamination, op2_lm_scoring, op3_token_counts, op4_line_dedup, op5_url_filters,
    op6_repeated_bytes, op7_language_id, op8_byte_bpe, op9_near_duplicates, op10_quality_rules,
)
QUERIES = {f.__name__: f for f in _ALL}

_WS = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
ORACLE = {
    "op4_line_dedup": rf"""
with lines as (
  select doc_id, pos, line, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as pos from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents))),
keys as (select k, max(doc_id) as m from lines where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
judged as (select lines.*, keys.k is not null and doc_id <> m as gone from lines left join keys using (k))
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id""",
    # canonical links and redirects with whole urls in double quotes, as web pages write them; a
    # block reaches every url that links lead to, in either direction
    "op5_url_filters": r"""
with recursive rules(verdict, rule, host, start) as (values ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
links as (select url, unnest(regexp_extract_all(html, '<link rel="canonical" href="([^"]+)"', 1) || regexp_extract_all(html, '<meta http-equiv="refresh" content="[0-9]+; *url=([^"]+)"', 1)) as target from pages where url is not null),
urls as (select url from pages union select target from links),
parts as (select url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '') as path, coalesce(regexp_extract(url, '^.*?://[^?#]*[?]([^#]*)', 1), '') as query from urls),
nodes as (select *, case when host <> '' then regexp_replace(host, ':(80|443)$', '') || case when path = '' then '/' else path end || coalesce('?' || nullif(array_to_string(list_filter(string_split(query, '&'), lambda p: p <> '' and not regexp_matches(lower(p), '^(utm_[a-z]+|gclid|fbclid|dclid|msclkid|mc_cid|mc_eid|igshid|yclid|_ga)(=|$)')), '&'), ''), '') end as node from parts),
judged as (select n.*, (select arg_max(r.rule, length(r.rule)) from rules r where (n.host = r.host or n.host like '%.' || r.host) and starts_with(n.path, r.start)) as rule from nodes n),
edges as (select a.node as x, b.node as y from links l join nodes a on a.url = l.url join nodes b on b.url = l.target where a.node <> b.node),
either as (select x, y from edges union select y, x from edges),
bad(node) as (select distinct node from judged j join rules r on r.rule = j.rule where r.verdict = 'block' and node in (select x from either) union select y from bad join either on x = bad.node)
select page_id, host, path, j.rule, coalesce((select verdict from rules r where r.rule = j.rule), case when node in (select node from bad) then 'block' else 'allow' end) as verdict from pages p join judged j on j.url is not distinct from p.url""",
}
