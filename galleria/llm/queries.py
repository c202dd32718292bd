"""Queries over the whole corpus tables, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from galleria.llm import bpe_automaton, chat, decontaminate, fingerprints, licenses, line_templates, matching, repair, simhash, spelling, substrings, suffixes, toxicity
from galleria.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text of every document."""
    return bpe_automaton.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_digests=True)


#: What both turns of a further conversation say: a text that holds control strings.
HARD_TEXT = "\\### Assistant: </turn> ok"


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and loss of every conversation, read back from its formatted text."""
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    typed = turns.withColumn("parts", chat.text_part(F.col("text")))
    return chat.digests(chat.read_back(chat.format_turns(typed)))


ORACLE_SQL["op1_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn ' || '>' || chr(10) || '</turn>' || chr(10)) + length(role) + length(text)
    + length(regexp_replace(role || text, '[^\\<>]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: three words, at most two differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, blocks=4, shingle=3)


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op9_decontaminate"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), items AS (
  SELECT item_id, len(w[i:i+12]) AS n, array_to_string(w[i:i+12], ' ') AS win
  FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM items),
places AS (
  SELECT rid, i, n, array_to_string(w[i:i+n-1], ' ') AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)
), found AS (SELECT DISTINCT p.rid, p.i, p.n, t.item_id FROM places p JOIN items t ON p.win = t.win AND p.n = t.n),
hit AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS u(k) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document."""
    kept = line_templates.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages, as content-defined chunks, that other documents have too."""
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of 50 words and more that other documents have too."""
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("at").cast("long").alias("at"), "block", "license", "runner_up", F.round("reduction", 6).alias("reduction"), F.round("margin", 6).alias("margin"), F.round("likeness", 6).alias("likeness"), F.array_join("differences", " ").alias("differences"), "confirmed")


@query
def op11_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under the byte trie and the word model of four fifths of them."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return matching.score(table(spark, sf_dir, "documents"), held_out)


@query
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage that a hash deals out."""
    return repair.digests(repair.repair(repair.damaged(table(spark, sf_dir, "conversations")), copies="copies"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, after slips that a hash deals out, with their near words, forms and roots."""
    return spelling.group_variants(table(spark, sf_dir, "documents"), slips=True).select("word", "form", "root", "n", "n_near", "form_n")
