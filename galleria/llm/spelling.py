"""Spelling variant grouping: words one edit apart are found by PartEnum signatures of their letters.

A word's letters are a binary vector: one dimension for the first a, one for the second a, and so on. Words one edit apart
differ in two dimensions at most. The dimensions are dealt into PARTS parts by a hash; for each choice of PARTS - 2 of them,
what the word has in these parts is a signature, and two vectors that differ in at most two dimensions agree in one of them.
A signature also carries the half of the word that the edit leaves as it is, and the length of the shorter word, which
keeps words of the same letters in another order apart. Words that share a signature are joined and verified.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from galleria.llm.common import cut_lineage, new_folder, removed

#: A maximal run of letters: fixed ranges.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are of at least so many letters and places.
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A word's form has at least so many times its places.
MORE = 2
#: Parts of the dimensions, and how many of them two near words can differ in.
PARTS, APART = 4, 2


def runs(text: Column) -> Column:
    """The maximal runs of letters, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(LETTERS), F.lit(0))


def with_slips(run: Column, doc_id: Column) -> Column:
    """A run, less one letter where a hash of it and its document says so (one run of 97)."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    k = (h % F.length(run)).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substring(run, F.lit(1), k), F.substring(run, k + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, slips: bool = False) -> DataFrame:
    """Words of the texts and how often they occur: word, n."""
    found = docs.select("doc_id", F.explode(runs(F.col("text"))).alias("run"))
    word = with_slips(F.col("run"), F.col("doc_id")) if slips else F.col("run")
    counted = found.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def dimensions(word: Column) -> Column:
    """Hashes of the dimensions that a word has: each letter with the numbers from 1 to how often it occurs."""
    letters = F.array_distinct(F.split(word, ""))
    times = lambda c: F.length(word) - F.length(F.replace(word, c, F.lit("")))
    return F.flatten(F.transform(letters, lambda c: F.transform(F.sequence(F.lit(1), times(c)), lambda i: F.xxhash64(c, i))))


def parts(word: Column) -> Column:
    """What a word has in each part: the exclusive or of its dimensions there, which are distinct."""
    own = lambda p: F.filter("dims", lambda d: F.pmod(d, F.lit(PARTS)) == p)
    return F.array(*[F.aggregate(own(p), F.lit(0).cast("long"), lambda s, d: s.bitwiseXOR(d)) for p in range(PARTS)])


def signatures(counted: DataFrame) -> DataFrame:
    """All signatures of each word: word, n, sig.

    The shorter of two near words has a length of m; the words themselves are the shorter and the longer one in turn. One
    edit changes the first m // 2 letters of the shorter word or the others, never both.
    """
    held = counted.withColumn("dims", dimensions(F.col("word"))).withColumn("parts", parts(F.col("word")))
    size, word = F.length("word"), F.col("word")
    keys = []
    for m in (size, size - 1):
        halves = [F.substring(word, F.lit(1), F.floor(m / 2).cast("int")), F.substring(word, size - (m - F.floor(m / 2)).cast("int") + 1, size)]
        for side, half in enumerate(halves):
            for chosen in combinations(range(PARTS), PARTS - APART):
                keys.append(F.xxhash64(m, F.lit(side), half, F.lit(str(chosen)), *[F.col("parts")[p] for p in chosen]))
    return held.select("word", "n", F.explode(F.array_distinct(F.array(*keys))).alias("sig"))


def near_pairs(counted: DataFrame) -> DataFrame:
    """All pairs of words one edit apart, each once: a, a_n, b, b_n with a before b.

    counted: word, n (written before).
    """
    sigs = signatures(counted)
    left = sigs.select("sig", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = sigs.select("sig", F.col("word").alias("b"), F.col("n").alias("b_n"))
    near = (F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right, "sig").where(near).select("a", "a_n", "b", "b_n").distinct()


def forms(counted: DataFrame) -> DataFrame:
    """Near words of each word, and the form it is a variant of: word, n, n_near, form, form_n.

    The form is the near word with the most places, the first of ties in code-point order, if it has MORE times the word's.
    """
    pairs = near_pairs(counted)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    out = counted.join(best, "word", "left")
    is_form = F.coalesce(-F.col("best.less") >= MORE * F.col("n"), F.lit(False))
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))


def with_roots(formed: DataFrame) -> DataFrame:
    """Where the forms of each word lead: formed (written before) and root, the word itself if it has no form.

    Each round doubles how many forms are followed. A form has at least MORE times the places, so few rounds are needed.
    """
    reach = formed.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        ahead = reach.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut_lineage(reach.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reach = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return formed.join(reach, "word")


def group_variants(docs: DataFrame, slips: bool = False) -> DataFrame:
    """Words of all texts with the spelling that each is a variant of: word, n, n_near, form, form_n, root.

    docs: doc_id, text; further columns are left out. Words are runs of letters, A-Z in lower case, of LEAST_LETTERS and
    more that occur LEAST_COUNT times and more; null and empty texts have none, every place in repeated rows counts. Two
    words are near if one inserted, deleted or replaced letter makes one the other. slips: letters are left out first as
    with_slips does; a null doc_id is an empty text there. No rows give no rows.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "spelling")
    words(docs, slips).write.parquet(f"{folder}/words")
    forms(spark.read.parquet(f"{folder}/words")).write.parquet(f"{folder}/forms")
    path = new_folder(spark, "spelling-roots")
    with_roots(spark.read.parquet(f"{folder}/forms")).select("word", "n", "n_near", "form", "form_n", "root").write.parquet(path)
    removed(spark, folder)
    return spark.read.parquet(path)

