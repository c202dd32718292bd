"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's probability is a logistic function of the words in it; a document's is the noisy-or of its sentences. The
weights are learned from document labels only, and the sentence scores then say where the offence is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from galleria.llm.common import cut_lineage, map_batches, texts_of

#: A row's documents are labelled rows of at most this number, the first by a hash of doc_id: what is fitted in one task.
SAMPLE_ROWS = 8_000
#: A word is a feature if it stands in at least so many sampled documents.
LEAST_DOCS = 6
#: ... and in so many standard deviations more toxic ones than chance explains.
LEAST_EXCESS = 4.0
#: Features at most: those whose document counts differ most between the two labels.
MOST_FEATURES = 4096
SENTENCE_ENDS = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"\w+")
#: Lengths of the word beginnings that are features too (marked by a star), so that inflected words are known.
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3
#: Steps, rate and penalty of the fit.
STEPS, RATE, PENALTY = 400, 0.1, 2e-5
MODEL = "word string, weight double"


def sentences(text: str) -> list[str]:
    """Sentences of a text, without those that have no word."""
    return [s for s in SENTENCE_ENDS.split(text) if s.strip()]


def features(text: str) -> set[str]:
    """Distinct words of a lower-case text, and the beginnings of the longer ones."""
    words = set(WORD.findall(text))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in BEGINNINGS))


@dataclass(frozen=True)
class Model:
    """Logit of a sentence: bias and the weights of its distinct words. Sentences without a known word say nothing; rest
    is the log of the chance that a document of such sentences alone is clean."""

    weights: dict[str, float]
    bias: float
    rest: float

    def logits(self, text: str) -> list[tuple[int, float]]:
        """Place and logit of the sentences that hold a known word."""
        known, low = self.weights, text.lower()
        if known.keys().isdisjoint(features(low)):
            return []
        found = []
        for i, s in enumerate(sentences(low)):
            if words := known.keys() & features(s):
                found.append((i, self.bias + sum(known[w] for w in sorted(words))))
        return found

    def score(self, logits: list[tuple[int, float]]) -> float:
        """Noisy-or of the sentences and of what is there without any."""
        return float(-np.expm1(self.rest - sum(np.logaddexp(0.0, z) for _, z in logits)))

    @staticmethod
    def offending(logits: list[tuple[int, float]], least: float) -> list[tuple[int, float]]:
        """Place and probability of the sentences that reach a probability."""
        return [(i, p) for i, z in logits if (p := float(1 / (1 + np.exp(-z)))) >= least]


@dataclass(frozen=True)
class Bags:
    """Sentences as feature numbers: those of sentence i are cols[sents == i], and it belongs to document docs[i]."""

    docs: np.ndarray
    sents: np.ndarray
    cols: np.ndarray
    labels: np.ndarray


def objective(theta: np.ndarray, bags: Bags) -> tuple[float, np.ndarray]:
    """Loss (negative mean log-likelihood of the document labels under noisy-or, and penalty) and its gradient.

    theta: the features' weights, the bias of a sentence with known words, and the logit of toxic without any.
    """
    k, n, y, docs, sents, cols = len(theta) - 2, max(1, len(bags.labels)), bags.labels > 0, bags.docs, bags.sents, bags.cols
    z = theta[k] + np.bincount(sents, theta[cols], len(docs)) if len(docs) else np.zeros(0)
    log_clean = -np.bincount(docs, np.logaddexp(0.0, z), len(y)) - np.logaddexp(0.0, theta[k + 1])
    log_clean = np.minimum(log_clean, -1e-9)
    clean = np.exp(log_clean)
    loss = -np.where(y, np.log(-np.expm1(log_clean)), log_clean).sum() / n + 0.5 * PENALTY * (theta[:k] @ theta[:k])
    # What a sentence's logit adds to the log-likelihood is this times its probability.
    slope = np.where(y, clean / -np.expm1(log_clean), -1.0)
    per_sentence = slope[docs] / (1 + np.exp(-z))
    of_words = np.bincount(cols, per_sentence[sents], k) if len(cols) else np.zeros(k)
    grad = -np.concatenate([of_words, [per_sentence.sum()], [(slope / (1 + np.exp(-theta[k + 1]))).sum()]]) / n
    grad[:k] += PENALTY * theta[:k]
    return float(loss), grad


def fit(words: list[str], bags: Bags) -> Model:
    """Weights by full-batch Adam."""
    k = len(words)
    theta = np.concatenate([np.zeros(k), [-1.0], [-3.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        grad = objective(theta, bags)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(dict(zip(words, theta[:k].tolist(), strict=True)), float(theta[k]), float(-np.logaddexp(0.0, theta[k + 1])))


def is_held_out(doc_id):
    """Rows whose crc32 of the doc_id as text leaves 2 when divided by 4; they are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def telling_words(texts: DataFrame) -> list[str]:
    """Words that stand in more toxic documents than chance explains, the most telling first. texts: toxic, text."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, marks = [], []
        for text, y in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
            found = features(text.lower())
            words += found
            marks += [y] * len(found)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(marks, pa.int64())], ["word", "toxic"])

    n, positive = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = positive / max(1, n)
    counts = map_batches(texts.select("text", "toxic"), rows, "word string, toxic long").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    excess = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1e-9)
    kept = counts.where(F.col("n") >= LEAST_DOCS).withColumn("excess", excess).where(F.col("excess") >= LEAST_EXCESS)
    return [r.word for r in kept.orderBy(F.desc("excess"), "word").limit(MOST_FEATURES).select("word").collect()]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit the model on a sample of labelled documents of at most `rows` rows.

    docs: doc_id, text. labels: doc_id, toxic; a doc_id with several labels is toxic if one says so, rows with a null in
    either column are left out; of a doc_id with several texts the smallest counts; null texts are empty. The sample is the
    first by a hash of doc_id, so it is the same for any order of the rows. Words are counted by Spark; the one task that
    fits gets for each document the numbers of the chosen words in its sentences, no text: at most `rows` rows and
    MOST_FEATURES different numbers. No labelled documents give a model that finds nothing toxic.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"), F.min("text").alias("text"))
    texts = cut_lineage(texts)
    words = telling_words(texts)
    sent = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def bags(batch: pa.RecordBatch) -> pa.RecordBatch:
        place = sent.value
        found = [[sorted(place[w] for w in hits) for s in sentences(t.lower()) if (hits := place.keys() & features(s))] for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.list_(pa.int32())))], ["doc_id", "toxic", "bag"])

    def run(batches):
        marks, doc_of, sizes, cols = [], [], [], []
        for batch in batches:
            for y, bag in zip(batch.column("toxic").to_pylist(), batch.column("bag").to_pylist(), strict=True):
                doc_of += [len(marks)] * len(bag)
                sizes += map(len, bag)
                cols += [c for s in bag for c in s]
                marks.append(y)
        if not marks:
            return
        model = fit(words, Bags(np.array(doc_of, np.int64), np.repeat(np.arange(len(sizes)), np.array(sizes, np.int64)), np.array(cols, np.int64), np.array(marks, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array([*model.weights, None, None], pa.string()), pa.array([*model.weights.values(), model.bias, model.rest], pa.float64())], ["word", "weight"])

    numbered = map_batches(texts, bags, "doc_id long, toxic long, bag array<array<int>>")
    fitted = [tuple(r) for r in numbered.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, MODEL).collect()]
    if not fitted:  # no labelled documents: nothing offends
        return Model({}, 0.0, 0.0)
    (_, bias), (_, rest) = [x for x in fitted if x[0] is None]
    return Model({w: x for w, x in fitted if w is not None}, bias, rest)


OFFENDING = "array<struct<place: bigint, probability: double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Toxicity of every whole text. Returns doc_id, held_out, score (0 to 1), predicted (1 if score is at least THRESHOLD)
    and offending: place (from 0, of the sentences that aren't blank) and probability of the sentences that reach THRESHOLD.

    docs: doc_id, text, further columns are left out. Only the text is looked at. Null and empty texts get the score of a
    text that says nothing; repeated rows get the same score; a null doc_id counts as not held out; no rows give no rows;
    texts may have any length.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        logits = [sent.value.logits(t) for t in texts_of(batch)]
        scores = pa.array([sent.value.score(x) for x in logits], pa.float64())
        places = pa.array([[{"place": i, "probability": p} for i, p in Model.offending(x, THRESHOLD)] for x in logits], pa.list_(pa.struct([("place", pa.int64()), ("probability", pa.float64())])))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), scores, places], ["doc_id", "score", "offending"])

    scored = map_batches(docs.select("doc_id", "text"), rows, f"doc_id long, score double, offending {OFFENDING}")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is below THRESHOLD, all columns as they are.

    Null and empty texts say nothing and stay, unless the model finds most documents toxic; repeated rows and null doc_ids
    go or stay by their text; texts may have any length; other columns aren't looked at; no rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([sent.value.score(sent.value.logits(t)) < THRESHOLD for t in texts_of(batch)], pa.bool_()))

    return map_batches(docs, rows, docs.schema)


def offending_sentences(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """doc_id, place (from 0), sentence and probability of the sentences that reach a probability.

    Null, empty and blank texts have none; repeated rows have the same ones each; null doc_ids are kept as such; texts may
    have any length; no rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for d, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            told = Model.offending(sent.value.logits(t), least)
            own = sentences(t) if told else []
            found += [(d, i, own[i], p) for i, p in told]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        types = [pa.int64(), pa.int64(), pa.string(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "place", "sentence", "probability"])

    return map_batches(docs.select("doc_id", "text"), rows, "doc_id long, place long, sentence string, probability double")
