"""The registered queries of this subpackage, with SQL where it can say the same."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostelry.llm import (
    bpe, chat, conversations, decontamination, mixing, near_duplicates, pii, quality, search, secrets, spans, substrings, toxicity, urls,
)

RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return spans.digests(pii.scan(table(spark, folder, "documents")), pii.KINDS)


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.digests(bpe.round_trip(table(spark, folder, "documents"), path, pattern))


def op3_substrings(spark: SparkSession, folder: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    planted = spark.sql("""
        SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text
        UNION ALL SELECT -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'""")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.examples(turns.unionByName(planted)))


OP4 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed as (
  select *, row_number() over w as i, count(*) over (partition by conv_id) as n,
    sum(10 + length(role) + length(regexp_replace(role, '[^~<\[|]', '', 'g'))
      + length(text) + length(regexp_replace(text, '[^~<\[]', '', 'g'))) over (w rows unbounded preceding) as chars
  from turns window w as (partition by conv_id order by turn, role, text))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  sum(3 + chars) filter (role = 'assistant' or i = n)::bigint as formatted_chars
from placed group by conv_id"""


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op6_urls(spark: SparkSession, folder: str) -> DataFrame:
    """The tables label documents, not pages; the label of the document with the page's id stands for the page's outcome."""
    labels = table(spark, folder, "labels")
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return urls.judge(table(spark, folder, "pages"), outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


def _level(name: str, source: str, keys: str, prior: str) -> str:
    return f"""
{name}_n as (select {keys}, sum(n) as n, sum(k) as k, any_value({prior}) as prior from {source} group by {keys}),
{name}_rho as (select case when c > 0 then greatest(0.001, least(0.5, (a - b) / c)) else 0.1 end as rho from (
  select sum(n * pow(k / n - prior, 2)) as a, sum(prior * (1 - prior)) as b, sum((n - 1) * prior * (1 - prior)) as c
  from {name}_n where n > 0)),
{name} as (select *, (1 - rho) / rho as s, (k + (1 - rho) / rho * prior) / (n + (1 - rho) / rho) as {name}_mean
  from {name}_n, {name}_rho)"""


OP6 = rf"""
with split as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '\A([^/?#]*)', 1), '{urls._UPPER}', '{urls._LOWER}') as host,
    regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) as path from split),
bad as (select doc_id, max(case when quality is null and toxic is null then null when quality = 0 or toxic = 1 then 1 else 0 end) as bad
  from labels where doc_id is not null group by doc_id),
hosts as (
  select host, count(bad)::double as n, coalesce(sum(bad), 0)::double as k, regexp_extract(host, '([^.]*\.)?[^.]*$', 0) as domain,
    regexp_extract(host, '[^.]*$', 0) as suffix from parts left join bad on bad.doc_id = page_id group by host),
start as (select *, (sum(k) over () + 0.5) / (sum(n) over () + 1) as whole from hosts),
{_level("suffixes", "start", "suffix", "whole")},
{_level("domains", "(select * from start join (select suffix, suffixes_mean from suffixes) using (suffix))", "domain, suffix", "suffixes_mean")},
{_level("single", "(select * from start join (select domain, domains_mean from domains) using (domain))", "host", "domains_mean")},
known as (select host, single_mean - 1.645 * sqrt(single_mean * (1 - single_mean) / (n + s + 1)) as bound from single),
ruled as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from parts)
select page_id, ruled.host, path, rule, case when rule in ('example.net/en/', 'org/fr/') then 'allow'
  when rule is not null then 'block' when bound > 0.5 then 'block' else 'allow' end as verdict
from ruled join known on known.host = ruled.host"""


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.classes(table(spark, folder, "documents"), n=3, similarity=0.85)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", (toxicity.remainder("doc_id") % 3 == 1).alias("held_out"), "score", F.col("predicted"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, folder, "labels")))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return spans.digests(secrets.scan(table(spark, folder, "documents")), secrets.KINDS)


def op11_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, folder, "documents")))


OP11 = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(concat_ws('|', '0', coalesce(doc_id::varchar, ''), coalesce(text, ''))) as digest from documents),
s as (
  select source, sum(size)::bigint as source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as w from d group by source),
shared as (
  select *, sum(source_size) over () - coalesce(sum(3 * source_size) over before, 0) as open, sum(w) over () - coalesce(sum(w) over before, 0) as open_w,
    row_number() over (order by 3 * source_size / w, w, source) as i
  from s window before as (order by 3 * source_size / w, w, source rows between unbounded preceding and 1 preceding)),
level as (select open, open_w from shared where open * w <= 3 * source_size * open_w order by i limit 1),
targets as (
  select source, source_size, least((level.open * w)::double / level.open_w::double, 3.0::double * source_size) as target from s, level),
queued as (
  select d.*, coalesce(sum(size) over (partition by source order by digest, doc_id, size rows between unbounded preceding and 1 preceding), 0) as ahead from d)
select doc_id, size, source_size, target, queued.source, (
    greatest(0, least(size, floor(target) - ahead)) + greatest(0, least(size, floor(target) - ahead - source_size))
    + greatest(0, least(size, floor(target) - ahead - 2 * source_size)))::bigint as taken
from queued join targets on queued.source is not distinct from targets.source"""


def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.top(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP12 = rf"""
with tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest({TERMS}) as term from documents) group by all),
n as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
whole as (select count(*)::bigint as docs, sum(n)::bigint as terms from n),
df as (select term, count(*) as df from tf group by term),
asked as (select item_id, term, count(*) as times from (select item_id, unnest({TERMS}) as term from benchmark) group by all),
scored as (
  select item_id, doc_id, sum(times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint
    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint as score
  from asked join df using (term) join tf using (term) join n using (doc_id), whole group by item_id, doc_id)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 20"""


def _damaged(conversations: DataFrame) -> DataFrame:
    def known(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), (
        F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20).alias("harm"))
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.where("harm <> 0").select("conv_id", "turn", copies, F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), (
        F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))).alias("text")).drop("copy")


def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    whole = table(spark, folder, "conversations")
    return conversations.report(*conversations.repair(_damaged(whole)), whole)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


QUERIES = {
    "op1_pii": op1_pii,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_substrings": op3_substrings,
    "op4_chat": op4_chat,
    "op5_decontamination": op5_decontamination,
    "op6_urls": op6_urls,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
    "op11_mixing": op11_mixing,
    "op12_search": op12_search,
    "op13_conversations": op13_conversations,
    "pipeline": pipeline,
}
SQL = {"op4_chat": OP4, "op6_urls": OP6, "op11_mixing": OP11, "op12_search": OP12}
