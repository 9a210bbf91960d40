"""The ten operators over their tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm import ann, chat, minhash, packing, quality, secrets, sentencepiece_fst, toxicity, url_filter, warc

#: A public vocabulary; any other file of the kind will do.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_fst.round_trip(docs, PIECE_MODEL).select("doc_id", "n_tokens", "ids", "same")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return ann.search(ann.build(vectors), queries)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, [("user", said), ("assistant", said)])], "conv_id long, messages array<struct<role:string,content:string>>")
    turns = chat.canonical(table(spark, sf_dir, "conversations")).unionByName(chat.canonical(extra))
    return chat.read_chat(chat.format_chat(turns))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), path="doc_id"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    # a null id is nobody's fold
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_url_filters": op3_url_filters,
    "op4_warc": op4_warc,
    "op5_minhash": op5_minhash,
    "op6_ann": op6_ann,
    "op7_chat": op7_chat,
    "op8_secrets": op8_secrets,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
}


def _quality_sql() -> str:
    space, stop = r"\x20\x09-\x0D", ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    bad = []
    for r in quality.RULES:
        bad += [f"{r.measure} < {r.low}::double"] if r.low is not None else []
        bad += [f"{r.measure} > {r.high}::double"] if r.high is not None else []
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^{space}]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) as ln from d),
g as (select r, generate_subscripts(w, 1) as i, w from w where len(w) > 8),
h as (select r, i, array_to_string(w[i:i + 7], ' ') as s from g where i <= len(w) - 7),
k as (select r, s from h group by r, s having count(*) > 1),
c as (select r, count(distinct i + o) as n from h join k using (r, s), generate_series(0, 7) x(o) group by r),
m as (select doc_id, len(w) as n_words, len(array_to_string(w, '')) as word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  len(ln) - len(list_distinct(ln)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, len(list_filter(w, lambda x: lower(x) in ({stop}))) as n_stop,
  len(regexp_extract_all(t, '!![{space}]')) as n_shout, len(ln) as n_lines from w left join c using (r)),
q as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, word_chars / greatest(n_words, 1)::double as mean_word_chars, n_symbols / greatest(n_words, 1)::double as symbol_ratio,
  n_shout / greatest(n_words, 1)::double as shout_ratio, n_stop / greatest(n_words, 1)::double as stop_ratio, n_dup_lines / greatest(n_lines, 1)::double as dup_line_ratio from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  base_failed, not base_failed and not ({" or ".join(bad)}) as kept from q"""


def _url_sql() -> str:
    """Every rule against every url: what the index must agree with."""
    hosts = ", ".join(f"('{r.action}', '{r.host}', '{r.path}')" for r in url_filter.HOST_RULES)
    fits = " when ".join(f"regexp_matches(u, '{r.regex}') then '{r.action}'" for r in sorted(url_filter.PATTERN_RULES, key=lambda r: (r.action, r.pattern)))
    return f"""
with p as (select row_number() over () as r, page_id, coalesce(url, '') as url, lower(coalesce(url, '')) as u from pages),
a as (select *, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from p),
b as (select *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
h as (select * from (values {hosts}) v(action, rule_host, start)),
m as (select r, arg_min(rule_host || start, -len(rule_host || start)) as rule, arg_min(action, -len(rule_host || start)) as action from b, h where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, start) group by r)
select page_id, host, path, rule, coalesce(action, case when {fits} else 'allow' end) as verdict from b left join m using (r)"""


def _chat_sql() -> str:
    broken = "replace({}, '␛', '␛␛')"
    for c in chat.CONTROLS:
        broken = f"replace({broken}, '{c}', '{c[0]}␛.{c[1:]}')"
    said = "'</s>[INST] ok [/INST]'"
    return f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all values (-1, 0, 'user', {said}), (-1, 1, 'assistant', {said})),
c as (select conv_id, turn, case role {" ".join(f"when '{k}' then '{v}'" for k, v in chat.ROLES.items())} else role end as role, text from t),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
  coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '') as loss, sum(len({broken.format("role")}) + len({broken.format("text")}) + 10) as n from c group by conv_id)
select conv_id, cast(n_turns as bigint) as n_turns, sha256(said) as turns_sha256, cast(len(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, cast(n as bigint) as formatted_chars from g"""


ORACLE_SQL: dict[str, str] = {
    "op1_quality": _quality_sql(),
    "op3_url_filters": _url_sql(),
    "op4_warc": """
with p as (select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as d, strlen(coalesce(html, '')) as n from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select page_id, cast(n as bigint) as payload_bytes, p.d as payload_digest, case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to from p left join f using (d)""",
    "op7_chat": _chat_sql(),
}
