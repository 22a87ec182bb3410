"""The registered queries of the text operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descry.llm import byte_bpe, decontaminate, exact_search, language_id, language_model, licenses, line_dedup, quality_rules, secrets, simhash, spelling, token_counts, whitening


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(documents(spark, sf_dir))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir), min_docs=10, min_chars=1, keep_first=False)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.search(embeddings(spark, sf_dir), k=20, every=20, factor=64)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir), least=5, factor=5, every=199)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir), components=4, factor=256)


QUERIES = {f.__name__: f for f in (op1_secrets, op2_licenses, op3_byte_bpe, op4_token_counts, op5_language_id, op6_decontaminate, op7_language_model, op8_quality_rules, op9_simhash, op10_line_dedup, op11_exact_search, op12_spelling, op13_whitening)}

#: White space at both ends off, A-Z in lower case.
_KEY = """translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
_LINE_DEDUP = f"""with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
 x as (select r, doc_id, p, ls[p] as l from d, unnest(range(1, len(ls) + 1)) t(p)),
 k as (select *, {_KEY} as k from x),
 f as (select k from k where k <> '' group by k having count(distinct r) >= 10),
 m as (select r, doc_id, p, l, k in (select k from f) as gone from k)
 select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(l, chr(10) order by p) filter (not gone), '')) as kept_sha256 from m group by r, doc_id"""


def _quality_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
    rules = " and ".join(f"coalesce(({a} / nullif({b}, 0)) {how} {bound}, true)" for _, v, how, bound in quality_rules.RULES for a, b in [v.split(" / ")])
    return rf"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
 w as (select r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
 g as (select r, i, array_to_string(ws[i:i + 7], ' ') as g from w, unnest(range(1, len(ws) - 6)) t(i)),
 b as (select r, i from (select r, i, count(*) over (partition by r, g) as n from g) where n > 1),
 n as (select r, count(distinct i + j) as n from b, range(8) q(j) group by r),
 m as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  len(ls) as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n.n, 0)::bigint as n_repeat_words, len(list_filter(ws, lambda x: lower(x) in ({stops}))) as n_stop_words from w left join n using (r)),
 f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {rules} as kept from f"""


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
#: Windows are compared as text: words hold no space.
_DECONTAMINATE = f"""with d as (select row_number() over () as r, doc_id, {_WORDS} as ws from documents),
 b as (select item_id, ws, least(len(ws), 13) as k from (select item_id, {_WORDS} as ws from benchmark) where len(ws) > 0),
 bw as (select distinct item_id, k, array_to_string(ws[i:i + k - 1], ' ') as g from b, unnest(range(1, len(ws) - k + 2)) t(i)),
 dw as (select r, i, k, array_to_string(ws[i:i + k - 1], ' ') as g from d, (select distinct k from bw), unnest(range(1, len(ws) - k + 2)) t(i)),
 m as (select distinct r, i, k, item_id from dw join bw using (k, g)),
 h as (select r, count(distinct p) as n_hit from (select distinct r, i, k from m), unnest(range(i, i + k)) t(p) group by r),
 n as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from m group by r)
 select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated from d left join h using (r) left join n using (r)"""

#: The window keeps of each query the twenty highest scores; floor, products and sums are exact in both.
_EXACT_SEARCH = """with v as (select vec_id, list_transform(embedding, lambda c: floor(64 * c::double)) as x from embeddings
 where embedding is not null and not list_bool_or(list_transform(embedding, lambda c: c is null or not isfinite(c)))),
 s as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.x, v.x)::bigint as score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0)
 select query_id, (row_number() over w)::int as rank, vec_id, score from s window w as (partition by query_id order by score desc, vec_id) qualify row_number() over w <= 20"""

#: The others need byte-pair merges, trained models, 64-bit hashes with a seed, or closures.
ORACLE_SQL: dict[str, str] = {"op10_line_dedup": _LINE_DEDUP, "op6_decontaminate": _DECONTAMINATE, "op8_quality_rules": _quality_sql(), "op11_exact_search": _EXACT_SEARCH}
