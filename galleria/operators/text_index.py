"""Case-insensitive pattern search in short texts by an inverted index of trigrams.

Each text stands under each of its trigrams (lower case), sorted by trigram, so a search reads the row groups of the two
rarest trigrams of its pattern, keeps the ids that both have, and checks these texts with the pattern itself. All texts also
stand under the empty gram, for patterns that have no three characters in a row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GRAM = 3
#: Trigrams of a pattern whose postings are read.
READ = 2


def grams(text: Column) -> Column:
    """Distinct trigrams of a text in lower case, and the empty gram."""
    low = F.lower(text)
    each = F.transform(F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.substring(low, i, F.lit(GRAM)))
    return F.array_append(F.when(F.length(low) >= GRAM, F.array_distinct(each)).otherwise(F.array().cast("array<string>")), F.lit(""))


def pattern_grams(pattern: str) -> list[str]:
    """Trigrams that each text has which the pattern (in lower case) matches; % and _ are wildcards, \\ escapes them."""
    pieces, piece = [], ""
    for escaped, c in re.findall(r"\\(.)|(.)", pattern, re.S):
        if c and c in "%_":
            pieces, piece = [*pieces, piece], ""
        else:
            piece += escaped or c
    return sorted({p[i : i + GRAM] for p in [*pieces, piece] for i in range(len(p) - GRAM + 1)})


def build(texts: DataFrame, path: str) -> None:
    """Store the postings of texts (id, text; null texts are left out) and how many each gram has, in a new folder.

    Postings are dealt to tasks by ranges of gram and id, so a frequent gram is spread over several.
    """
    rows = texts.where(F.col("text").isNotNull()).select("id", "text", F.explode(grams(F.col("text"))).alias("gram"))
    rows.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{path}/postings")
    stored = texts.sparkSession.read.parquet(f"{path}/postings")
    stored.groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams")


def search(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """id and text of all stored texts that are like the pattern, whatever their case: the rows of text ILIKE pattern."""
    low = spark.range(1).select(F.lower(F.lit(pattern))).first()[0]
    wanted = pattern_grams(low)
    counts = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(wanted)).collect()} if wanted else {}
    postings = spark.read.parquet(f"{path}/postings")
    if len(counts) < len(wanted):  # no text has one of the pattern's trigrams
        return postings.where(F.lit(False)).select("id", "text")
    rarest = sorted(wanted, key=lambda g: (counts[g], g))[:READ] or [""]
    found = postings.where(F.col("gram") == rarest[0]).select("id", "text").where(F.col("text").ilike(pattern))
    for g in rarest[1:]:
        found = found.join(postings.where(F.col("gram") == g).select("id", "text"), ["id", "text"], "left_semi")
    return found
