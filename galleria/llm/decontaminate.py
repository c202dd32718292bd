"""Benchmark decontamination with a distributed positional inverted index.

Training tokens are kept as postings (term, document, position) of the terms that are asked for. A phrase is found from
its rarest terms: the postings of the rarest one, moved by its offset, are joined with those of the second rarest one;
what is left is confirmed word by word from the words that stand around the posting. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from galleria.llm.common import cut_lineage, is_small, small

#: Words of a window. A shorter item is one window of all its words.
WINDOW = 13
#: Separators between words: ASCII characters but digits and letters. Letters are in lower case by then.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; the first and the last may be empty strings."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.split(plain, SEPARATORS)


def size_of(parts: Column) -> Column:
    """Number of words of what `words` gives: it can have an empty string at either end only."""
    n = F.size(parts)
    ends = (F.element_at(parts, 1) == "").cast("int") + ((n > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (n - ends).cast("long")


def windows(items: DataFrame) -> DataFrame:
    """Distinct windows of the items: wid, len, window (array of words) and items (sorted item_ids as strings)."""
    parts = items.select("item_id", F.filter(words(F.col("text")), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (WINDOW - 1)))
    each = parts.select(F.col("item_id").cast("string").alias("item_id"), F.explode(F.transform(starts, lambda i: F.slice("words", i, WINDOW))).alias("window"))
    return each.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items")).select(F.xxhash64("window").alias("wid"), F.size("window").alias("len"), "window", "items")


def tokens(docs: DataFrame) -> DataFrame:
    """Rows of a document's words: doc_id, h (of the text), words, pos, term (the word's hash). Every document has a row
    of pos 0."""
    parts = docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("words"))
    # The outer form keeps Spark from computing the words a second time, to filter out empty arrays.
    return parts.select("doc_id", "h", "words", F.posexplode_outer("words").alias("pos", "word")).withColumn("term", F.xxhash64("word"))


def anchors(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Adds to each window its two rarest terms by their counts in all documents: term1, at1, term2, at2 (null if alone)."""
    terms = asked.select("wid", F.posexplode("window").alias("at", "word")).select("wid", "at", F.xxhash64("word").alias("term"))
    distinct = cut_lineage(terms.select("term").distinct())
    counts = cut_lineage(tokens(docs).select("term").join(small(distinct), "term").groupBy("term").agg(F.count("*").alias("n")))
    ranked = terms.join(small(counts), "term", "left").groupBy("wid").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term"))).alias("r"))
    first, second = F.element_at("r", 1), F.try_element_at("r", F.lit(2))
    return asked.join(ranked, "wid").select("wid", "len", "window", "items", first["term"].alias("term1"), first["at"].alias("at1"), second["term"].alias("term2"), second["at"].alias("at2"))


def index(docs: DataFrame, items: DataFrame, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """The windows of the items with their anchors, and the postings of the terms that they are looked up by.

    Postings: term, doc_id, h, pos, for first terms the words around them (from place begin on), and n_words in one row of
    each document (pos 0, whatever its term), so that the texts are cut into words once here and once to count terms.
    """
    asked = cut_lineage(anchors(docs, cut_lineage(windows(items))))
    around = WINDOW - 1 + slop
    wanted = cut_lineage(asked.select(F.col("term1").alias("term"), F.lit(True).alias("context")).unionByName(asked.where("term2 IS NOT NULL").select(F.col("term2").alias("term"), F.lit(False).alias("context"))).groupBy("term").agg(F.max("context").alias("context")))
    begin = F.greatest(F.col("pos") - around, F.lit(0))
    context = F.when(F.col("context"), F.slice("words", begin + 1, F.col("pos") - begin + around + 1))
    n_words = F.when(F.col("pos") == 0, size_of(F.col("words")))
    if is_small(wanted):
        rows = tokens(docs).join(F.broadcast(wanted), "term", "left").where(F.col("context").isNotNull() | (F.col("pos") == 0))
    else:
        rows = looked_up(docs, wanted)
    return asked, cut_lineage(rows.select("term", "doc_id", "h", "pos", F.col("context").isNotNull().alias("wanted"), begin.alias("begin"), context.alias("around"), n_words.alias("n_words")))


def looked_up(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `tokens` whose term is wanted, with its context, and those of pos 0, where the wanted terms are too many
    to be sent to the texts.

    Terms and their places are shuffled, words aren't; what is found is brought back to its text, which moves once.
    """
    places = tokens(docs).select("doc_id", "h", "pos", "term").join(wanted, "term")
    # Repeated rows have the same places; each row gets them back.
    of_text = places.groupBy("doc_id", "h").agg(F.collect_set(F.struct("pos", "term", "context")).alias("found")).withColumnsRenamed({"doc_id": "d", "h": "g"})
    parts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    both = parts.join(of_text, parts["doc_id"].eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    found = F.coalesce("found", F.array().cast("array<struct<pos:int,term:bigint,context:boolean>>"))
    first = F.struct(F.lit(0).alias("pos"), F.lit(None).cast("long").alias("term"), F.lit(None).cast("boolean").alias("context"))
    rows = F.when(F.exists(found, lambda x: x["pos"] == 0), found).otherwise(F.array_append(found, first))
    return both.select("doc_id", "h", words(F.col("text")).alias("words"), F.explode(rows).alias("r")).select("doc_id", "h", "words", "r.pos", "r.term", "r.context")


def matches(docs: DataFrame, items: DataFrame, slop: int = 0, share: float = 0.8) -> DataFrame:
    """Where windows of the items occur in the documents.

    Returns doc_id, h, wid, len, start (position of the window's first word, from 0, an empty string at the text's start
    counted), items, kind. kind is exact for the whole window word by word. With slop, kind is proximity where the two
    rarest terms stand within slop words of their places and at least the given share of the window's distinct words lies
    around them.

    Null and empty texts and items have no matches; repeated rows have the same ones, once for each; null doc_ids and
    item_ids are kept as such; texts may have any length; columns besides doc_id, text, item_id aren't looked at; without
    documents or items there are no rows.
    """
    return found_in(*index(docs, items, slop), slop, share)


def found_in(asked: DataFrame, rows: DataFrame, slop: int = 0, share: float = 0.8) -> DataFrame:
    """`matches`, from the windows and postings of `index`."""
    postings = rows.where("wanted")
    found = postings.where("around IS NOT NULL").join(small(asked), F.col("term") == F.col("term1")).select("doc_id", "h", "begin", "around", (F.col("pos") - F.col("at1")).alias("start"), "wid", "len", "window", "items", "term2", "at2")
    found = found.where(F.lit(slop > 0) | (F.col("start") >= 0))
    second = postings.select(F.col("term").alias("term2"), F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("pos").alias("pos2"))
    same = (found["term2"] == second["term2"]) & found["doc_id"].eqNullSafe(second["d"]) & found["h"].eqNullSafe(second["g"])
    at2 = F.col("start") + F.col("at2")
    placed = same & (at2 == F.col("pos2")) if not slop else same & F.col("pos2").between(at2 - slop, at2 + slop)
    keep = [c for c in found.columns if c not in ("term2", "at2")]
    met = found.where("term2 IS NOT NULL").join(second.distinct(), placed, "left_semi").select(*keep).unionByName(found.where("term2 IS NULL").select(*keep))
    exact = (F.col("start") >= F.col("begin")) & (F.slice("around", F.greatest(F.col("start") - F.col("begin"), F.lit(0)) + 1, F.col("len")) == F.col("window"))
    named = met.withColumn("exact", exact)
    if slop:
        near = F.size(F.array_intersect("window", "around")) >= F.size(F.array_distinct("window")) * F.lit(share)
        named = named.where(F.col("exact") | near)
    else:
        named = named.where("exact")
    return named.select("doc_id", "h", "wid", "len", "start", "items", F.when(F.col("exact"), "exact").otherwise("proximity").alias("kind"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """How much of each document is made of windows of the benchmark items.

    docs: doc_id, text, further columns are left out. items: item_id, text. Returns doc_id, n_words, n_hit (words inside
    any occurrence of a window), n_items, items_sha256 (of the sorted item_ids, comma-joined) and contaminated (n_hit > 0
    and at least a twentieth of the words).

    A null text has no words. Documents are told apart by doc_id and text: repeated rows get the same counts, equal
    doc_ids with other texts their own. Null item_ids take part in hits but are no items. Items without words are left
    out; without items nothing is hit; without documents there are no rows.
    """
    return measured(docs, items).drop("h")


def measured(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`contamination`, with h, the hash of the text."""
    asked, rows = index(docs, items)
    hits = found_in(asked, rows).groupBy("doc_id", "h").agg(
        F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("n")),
        lambda a: a["n"],
    )
    counted = hits.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), covered.alias("hit"), "items")
    every = rows.where("pos = 0").select("doc_id", "h", "n_words")
    joined = every.join(counted, every["doc_id"].eqNullSafe(counted["d"]) & every["h"].eqNullSafe(counted["g"]), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        every["h"],
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    Rules as in `contamination`: null and empty texts have no words and stay; repeated rows go or stay together; columns
    that docs has besides stay as they are; without items all documents stay; no rows give no rows.
    """
    bad = cut_lineage(measured(docs, items).where("contaminated").select(F.col("doc_id").alias("__doc"), F.col("h").alias("__h")).distinct())
    return docs.join(small(bad), docs["doc_id"].eqNullSafe(bad["__doc"]) & (F.xxhash64(docs["text"]) == bad["__h"]), "left_anti")
