"""Line dedup with a log-template tree.

A line's path in the tree is its number of tokens and its leading tokens, variable fields (tokens with a digit) written
as a wildcard. In a leaf, a token that few of the leaf's lines have at its position is a variable field too; a line with
enough other tokens is an instance of the template that is left, so a leaf has as many templates as its lines need. A
template that stands in several documents that are not copies of each other recurs, and its lines are dropped but for the
first one. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from galleria.llm.common import cut_lineage, narrowed, quoted, small

#: Leading tokens of a path; documents from which on a template recurs.
DEPTH, LEAST_DOCS = 3, 5
#: A line of at least so many tokens that stands verbatim in so many documents recurs too. Shorter lines keep the higher
#: count: headings and short sentences meet by chance (lines in 2 to 4 texts of sf0.1: 0.2 % of the characters are in
#: shorter ones, 1.4 % in these).
LONG_TOKENS, LONG_DOCS = 10, 2
#: A token is constant at its position if this share of the leaf has it there (and at least as many documents as a
#: template needs); so a position has ten constants at most. A line is an instance of a template if this share of its
#: tokens is constant, and a template by itself if not.
CONSTANT, SIMILAR = 0.1, 0.7
WILDCARD = "<*>"


def masked(line: Column) -> Column:
    """The line's tokens, variable fields as wildcards, joined by single spaces; empty for a blank line."""
    odd = reduce(lambda a, b: a | b, [F.contains(line, F.lit(x)) for x in ("  ", "\t", "\r", "\f", "\v")])
    plain = F.trim(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"[^ ]*[0-9][^ ]*", WILDCARD)).otherwise(plain)


def lines(docs: DataFrame) -> DataFrame:
    """Lines that aren't blank: doc_id, h (of the text), at (from 0), chars, shape (masked form), s (its hash), leaf (hash
    of its path), v (hash of a long line as it stands, null for others)."""
    each = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode_outer(F.split("text", "\n", -1)).alias("at", "line"))
    shaped = each.where(F.col("line").rlike(r"\S")).select("doc_id", "h", "at", "line", F.length("line").alias("chars"), masked(F.col("line")).alias("shape"))
    n_tokens = F.length("shape") - F.length(F.replace("shape", F.lit(" "), F.lit("")))
    verbatim = F.when(n_tokens + 1 >= LONG_TOKENS, F.xxhash64(F.trim("line")))
    return shaped.withColumns({"s": F.xxhash64("shape"), "leaf": F.xxhash64(n_tokens, F.substring_index("shape", " ", DEPTH)), "v": verbatim}).drop("line")


def recurring(docs: DataFrame, numbers: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """leaf, s, template (its hash) of the shapes whose template recurs; documents of equal text count once.

    numbers: leaf, s, h of the lines of docs, checkpointed.
    """
    # Most lines are alone in their leaf and end here, as one number each.
    crowded = cut_lineage(numbers.groupBy("leaf").count().where(F.col("count") >= least_docs).select("leaf"))
    texts = cut_lineage(narrowed(numbers.select("leaf", "s", "h"), crowded, "leaf").distinct())
    counts = cut_lineage(texts.groupBy("leaf", "s").agg(F.count("*").alias("n")))
    totals = cut_lineage(counts.groupBy("leaf").agg(F.sum("n").alias("total")).where(F.col("total") >= least_docs))
    told = narrowed(lines(docs).select("leaf", "s", "shape"), totals.select("leaf"), "leaf").groupBy("leaf", "s").agg(F.first("shape").alias("shape"))
    shapes = cut_lineage(counts.join(small(totals), "leaf").join(told, ["leaf", "s"]))
    parts = F.split("shape", " ")
    votes = shapes.select("leaf", "total", "n", F.posexplode(parts).alias("p", "word")).groupBy("leaf", "total", "p", "word").agg(F.sum("n").alias("n"))
    constant = votes.where(F.col("n") >= F.greatest(F.lit(least_docs), CONSTANT * F.col("total"))).groupBy("leaf", "p").agg(F.collect_set("word").alias("words"))
    by_place = F.map_from_entries(F.collect_list(F.struct("p", "words")))
    none = F.array().cast("array<string>")
    constants = constant.groupBy("leaf").agg(by_place.alias("m"), F.max("p").alias("last")).select("leaf", F.transform(F.sequence(F.lit(0), "last"), lambda p: F.coalesce(F.try_element_at("m", p), none)).alias("constants"))
    placed = shapes.join(small(cut_lineage(constants)), "leaf", "left")
    is_constant = lambda w, i: F.coalesce(F.array_contains(F.get("constants", i), w), F.lit(False))
    general = F.size(F.filter(parts, is_constant)) >= SIMILAR * F.size(parts)
    form = F.array_join(F.transform(parts, lambda w, i: F.when(is_constant(w, i), w).otherwise(WILDCARD)), " ")
    named = cut_lineage(placed.select("leaf", "s", F.when(general, F.xxhash64("leaf", form)).otherwise(F.xxhash64("leaf", "s")).alias("template")))
    of_text = texts.join(small(named), ["leaf", "s"]).select("template", "h").distinct()
    enough = cut_lineage(of_text.groupBy("template").count().where(F.col("count") >= least_docs).select("template"))
    return named.join(small(enough), "template", "left_semi").select("leaf", "s", "template")


def dedup(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Documents without the lines of recurring templates.

    docs: doc_id, text and any further columns. Returns them with the new text and n_lines, n_dropped. The first line of
    a template, by doc_id, hash of the text and place, stays; documents of the same text keep it too, so that they stay
    copies. Long lines recur from LONG_DOCS documents on. The rule is the same for every document, whatever its share of
    recurring lines: one that holds nothing else is left with an empty text.

    A null text stays null and has no lines; blank lines are never dropped. Rows with the same doc_id and text are told
    apart by nothing: they get the same new text. Null doc_ids come first in the order. Texts may have any length. Columns
    n_lines and n_dropped of docs are replaced, all others stay. No rows give no rows.
    """
    numbers = cut_lineage(lines(docs).drop("shape"))
    known = cut_lineage(recurring(docs, numbers, least_docs))
    long = numbers.where(F.col("v").isNotNull()).select("v", "h").distinct().groupBy("v").count().where(F.col("count") >= LONG_DOCS)
    long = cut_lineage(long.select("v", F.xxhash64(F.lit("verbatim"), "v").alias("same")))
    named = numbers.join(small(known), ["leaf", "s"], "left").join(small(long), "v", "left")
    marked = cut_lineage(named.select("doc_id", "h", "at", F.coalesce("template", "same").alias("template")).where(F.col("template").isNotNull()))
    first = cut_lineage(marked.groupBy("template").agg(F.min(F.struct("doc_id", "h", "at")).alias("f")).select("template", F.col("f.h").alias("first_h"), F.col("f.at").alias("first_at")))
    going = marked.join(small(first), "template").where((F.col("h") != F.col("first_h")) | (F.col("at") != F.col("first_at")))
    keyed = cut_lineage(going.groupBy(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).agg(F.collect_set("at").alias("__drop")))
    joined = docs.join(small(keyed), docs["doc_id"].eqNullSafe(keyed["__d"]) & (F.xxhash64(docs["text"]) == keyed["__h"]), "left")
    parts, drops = F.split(docs["text"], "\n", -1), keyed["__drop"]
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(drops, i)), "\n")
    others = [docs[quoted(c)] for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    n_lines = F.when(docs["text"].isNull(), 0).otherwise(F.size(parts)).cast("long")
    n_dropped = F.when(drops.isNull(), 0).otherwise(F.size(drops)).cast("long")
    return joined.select(*others, F.when(drops.isNull(), docs["text"]).otherwise(kept).alias("text"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
