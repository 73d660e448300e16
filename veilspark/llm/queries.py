"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.decontamination import contaminated
from veilspark.llm.fuzzy_lines import dedup_lines
from veilspark.llm.jaccard_join import similar_classes
from veilspark.llm.line_cleaning import BOILERPLATE, FAULTS, NAVIGATION, LineRules, line_first_cleaning
from veilspark.llm.mixing import mix_sources
from veilspark.llm.quality_rules import fit_quality, score_quality
from veilspark.llm.repeated_spans import remove_repeats
from veilspark.llm.runtime import bounded_batches, written
from veilspark.llm.secret_frequency import scan_secrets
from veilspark.llm.sharding import balanced_shards, equal_text_rows
from veilspark.llm.token_counts import attribute_tokens
from veilspark.sources.files import spread

#: Where the public vocabulary files are; a parameter of this module, never copied.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
HELD_OUT = "pmod(crc32(cast({} AS string)), 5) = 0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def learn_condition() -> Column:
    """Labels of the held-out fifth are never learned from."""
    return F.expr(f"NOT ({HELD_OUT.format('id')})")


def shard_rows(docs: DataFrame) -> DataFrame:
    """The digest of operator 2 for 16 shards."""
    placed = balanced_shards(written(equal_text_rows(docs), "rows"), shards=16)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), learn=learn_condition())
    return score_quality(docs, model).select("doc_id", F.coalesce(F.expr(HELD_OUT.format("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op2_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = scan_secrets(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live")


def op4_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_merge_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op7_count_tree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents")).drop("label", "digest")


def op8_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_first_cleaning(table(spark, sf_dir, "documents"), with_text=False)


def op9_minhash_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).withColumn("removed", F.array_join(F.transform("removed", lambda i: i.cast("string")), ","))


def op10_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mix_sources(table(spark, sf_dir, "documents"))
    by_shard = F.array_join(F.transform("by_shard", lambda d: F.concat_ws(":", d["shard"].cast("string"), d["words"].cast("string"))), ",")
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", by_shard.alias("by_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_label_propagation_shards": op2_label_propagation_shards,
        "op3_secret_ownership": op3_secret_ownership,
        "op4_token_attribution": op4_token_attribution,
        "op5_bm25_decontamination": op5_bm25_decontamination,
        "op6_suffix_merge_repeats": op6_suffix_merge_repeats,
        "op7_count_tree_jaccard": op7_count_tree_jaccard,
        "op8_line_first_cleaning": op8_line_first_cleaning,
        "op9_minhash_line_dedup": op9_minhash_line_dedup,
        "op10_sainte_lague_mix": op10_sainte_lague_mix,
    }


OP7_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS shingle FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)
), both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT b.y, r.root FROM r JOIN both_ways b ON b.x = r.doc_id)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP8_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), c AS (
  SELECT doc_id, t, w, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS v FROM d
), windows AS (
  SELECT doc_id, u.pos AS pos, u.v AS v FROM (SELECT doc_id, unnest(list_transform(range(1, len(v) + 1), lambda i: {'pos': i, 'v': v[i]})) AS u FROM c)
), twice AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, v) AS n FROM windows) WHERE n > 1
), cover AS (
  SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS spot FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, u.no AS no, u.line AS line FROM (SELECT doc_id, unnest(list_transform(range(1, len(string_split(t, chr(10))) + 1), lambda i: {'no': i, 'line': string_split(t, chr(10))[i]})) AS u FROM d)
), worded AS (
  SELECT doc_id, no, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w, row_number() OVER (PARTITION BY doc_id, line ORDER BY no) AS again FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), judged AS (
  SELECT doc_id, again, length(array_to_string(w, '')) AS chars, len(w) AS n,
    len(list_filter(w, lambda x: contains(x, '|'))) AS bars, len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) AS marked,
    len(w) <= 6 AND regexp_full_match(array_to_string(w, ' '), '(?i)@navigation') AS navigation, regexp_matches(line, '(?i)@boilerplate') AS boilerplate,
    len(w) < @short AND NOT regexp_matches(line, '(?:[.!?:;]|…|[.!?]"|\\.''|\\.\\)|。)[\\x20\\x09-\\x0D]*$') AND NOT regexp_matches(line, '[.!?]["'')]?(?:[\\x20\\x09-\\x0D]|$)|。') AS punctuation,
    len(regexp_extract_all(line, '[A-Z]')) AS upper, len(regexp_extract_all(line, '[A-Za-z]')) AS letters
  FROM worded
), faults AS (
  SELECT doc_id, chars, CASE WHEN again > 1 THEN 'repeated' WHEN 100 * bars > @bar * n THEN 'navigation' WHEN 100 * marked > @mark * n THEN 'symbols' WHEN navigation THEN 'navigation' WHEN boilerplate THEN 'boilerplate'
    WHEN punctuation THEN 'punctuation' WHEN letters >= @letters AND 100 * upper > @shout * letters THEN 'shouting' END AS fault FROM judged
), per_doc AS (
  SELECT doc_id, @counts coalesce(sum(chars) FILTER (WHERE fault IS NOT NULL), 0) AS lost, count(*) FILTER (WHERE fault = 'repeated') AS dup FROM faults GROUP BY doc_id
), base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(p.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines, @names
    100.0::DOUBLE * coalesce(p.lost, 0) / greatest(length(array_to_string(w, '')), 1) AS lost_percent
  FROM d LEFT JOIN per_doc p ON p.doc_id = d.doc_id LEFT JOIN cover ON cover.doc_id = d.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_percent <= @loss AS kept FROM base
"""


def op8_sql() -> str:
    """The line rules as SQL; patterns and limits are the operator's own."""
    rules, literal = LineRules(), lambda pattern: pattern.decode().replace("\xc2\xa9", "©").replace("'", "''")
    values = {
        "@navigation": literal(NAVIGATION.pattern), "@boilerplate": literal(BOILERPLATE.pattern.replace(rb"\xc2\xa9", "©".encode())), "@short": str(rules.short_words), "@bar": str(rules.bar_percent), "@mark": str(rules.symbol_percent),
        "@letters": str(rules.shout_letters), "@shout": str(rules.shout_percent), "@loss": str(rules.max_loss),
        "@counts": "".join(f"count(*) FILTER (WHERE fault = '{f}') AS n_{f}, " for f in FAULTS), "@names": "".join(f"CAST(coalesce(p.n_{f}, 0) AS BIGINT) AS lines_{f}, " for f in FAULTS),
    }
    out = OP8_SQL
    for name, value in values.items():
        out = out.replace(name, value)
    return out


def oracle_sql() -> dict[str, str]:
    """Operators 1 to 6, 9 and 10 have no SQL: fits, propagation, offsets, tokenizers, byte strings and hashes of
    another engine; they are tested against brute force."""
    return {"op7_count_tree_jaccard": OP7_SQL, "op8_line_first_cleaning": op8_sql()}
