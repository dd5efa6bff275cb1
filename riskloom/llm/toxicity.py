"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's score is logistic in the words it has; a document is toxic with the noisy-or of its sentences, one minus
the product of their complements. The weights are trained from document labels through the noisy-or, so the sentences
that explain the labels get the weight, and those sentences are what ``sentences`` locates in a document.

A word has as features itself and its first three to eight letters, which inflected forms share. ``FEATURES`` features
at most are kept: those that toxic training documents have more often, by the log-likelihood ratio. The classifier is
fitted on ``TRAIN_DOCS`` labelled documents per label at most, in expectation, chosen by a hash of the id, in ``SHARDS``
tasks that descend from shared weights and are averaged after each round; all of this is bounded by these parameters.
Scoring runs over all rows and whole texts in one pass without a shuffle.

Nulls: a null text is empty and scores 0, like a text without a word; labels that are null, or for no document, are not
learned from; a null id is never held out. A document with several labels is learned with each. Without training rows
of both labels every score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.frames import held_out, lean, table, written

TRAIN_DOCS = 3_000
FEATURES = 2_000
SHARDS = 8
ROUNDS = 3
STEPS = 100
RATE = 0.5
DECAY = 3e-5
MIN_DOCS, MIN_GAIN = 4, 6.0  # toxic training documents with a feature, and its log-likelihood ratio, at least
THRESHOLD = 0.7
CACHE = 500_000
SENTENCE = re.compile(r"[^.!?\n]+")
WORDS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """A word and, marked, its beginnings."""
    return [word, *(f"^{word[:k]}" for k in range(3, 9) if len(word) >= k)]


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(feature, bad, good)``: training documents of each label with the feature, per task."""
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def emit() -> pa.RecordBatch:
        keys = sorted(held[0].keys() | held[1].keys())
        batch = pa.RecordBatch.from_pydict({"feature": keys, "bad": [held[1][k] for k in keys],
                                            "good": [held[0][k] for k in keys]})
        for counter in held:
            counter.clear()
        return batch

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            held[toxic].update({f for w in set(WORDS.findall(text.lower())) for f in word_features(w)})
            if len(held[0]) + len(held[1]) > 2 * CACHE:
                yield emit()
    yield emit()


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def descend(bags: list, labels: np.ndarray, weights: np.ndarray, steps: int) -> np.ndarray:
    """Full-batch Adagrad on the noisy-or log-loss; a bag is a list of sentences, a sentence a list of features.

    The last weight is the bias. Sentences without a kept feature differ by nothing, so each bag counts them.
    """
    bag_of, sentence_of, feature_of, plain, at = [], [], [], np.zeros(len(bags)), 0
    for k, bag in enumerate(bags):
        for sentence in bag:
            if sentence:
                bag_of.append(k)
                sentence_of += [at] * len(sentence)
                feature_of += sentence
                at += 1
            else:
                plain[k] += 1
    bag_of, sentence_of, feature_of = (np.array(x, dtype=np.int64) for x in (bag_of, sentence_of, feature_of))
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    weights, seen = weights.copy(), np.full(len(weights), 1e-8)
    for _ in range(steps):
        bias = weights[-1]
        z = bias + np.bincount(sentence_of, weights[feature_of], at)
        mass = np.bincount(bag_of, _softplus(z), len(bags)) + plain * _softplus(bias)
        # d loss / d mass: one for clean documents, minus the odds of the complement for toxic ones.
        pull = share * np.where(labels == 1, -1.0 / np.expm1(np.clip(mass, 1e-12, 500.0)), 1.0)
        sigma = 1.0 / (1.0 + np.exp(-np.clip(z, -500.0, 500.0)))
        slope = np.zeros(len(weights))
        own = pull[bag_of] * sigma if at else np.zeros(0)
        slope[:-1] = np.bincount(feature_of, own[sentence_of], len(weights) - 1) if at else 0.0
        slope[-1] = own.sum() + (pull * plain).sum() / (1.0 + np.exp(-bias))
        slope[:-1] += DECAY * weights[:-1]
        seen += slope**2
        weights -= RATE * slope / np.sqrt(seen)
    return weights


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple:
    """``(features, weights, bias)`` from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    lean(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).select(
        F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return [], np.zeros(0), None
    rate = F.when(F.col("toxic") == 1, train_docs / totals[1]).otherwise(train_docs / totals[0])
    drawn = F.pmod(F.xxhash64(F.col("label_id"), F.lit("toxicity")), F.lit(1_000_000)) < rate * 1_000_000
    chosen = written(known.where(drawn), "toxic-labels")
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    sample = sample.join(chosen, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic")
    sample = written(sample, "toxic-sample")
    counts = sample.select("text", "toxic").mapInArrow(_feature_counts, "feature string, bad long, good long")
    counts = counts.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return [], np.zeros(0), None
    share = size[1] / (size[0] + size[1])
    seen = F.col("bad") + F.col("good")

    def part(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(F.lit(0.0))

    gain = part(F.col("bad"), seen * share) + part(F.col("good"), seen * (1 - share))
    telling = (F.col("bad") > seen * share) & (F.col("bad") >= MIN_DOCS) & (gain > MIN_GAIN)
    best = counts.where(telling).orderBy(F.desc(gain), "feature")
    features = [r["feature"] for r in best.limit(FEATURES).select("feature").collect()]
    place = {f: k for k, f in enumerate(features)}

    def trained(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "text", "toxic")
        rows = sorted((row for b in batches for row in zip(*(b.column(c).to_pylist() for c in names))),
                      key=lambda r: (str(r[0]), r[2], r[1]))
        bags = [[[place[f] for w in WORDS.findall(s) for f in word_features(w) if f in place]
                 for s in SENTENCE.findall(text.lower())] for _, text, _ in rows]
        kept = [k for k, bag in enumerate(bags) if bag]
        found = np.array([rows[k][2] for k in kept])
        if len(set(found.tolist())) == 2:
            out = descend([bags[k] for k in kept], found, weights, STEPS)
            yield pa.RecordBatch.from_pydict({"weights": [out.tolist()], "n": [len(kept)]})

    weights = np.zeros(len(features) + 1)
    weights[-1] = -5.0
    shards = max(1, min(SHARDS, (size[0] + size[1]) // 1_000))
    dealt = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).repartition(shards, "shard")
    dealt = written(dealt.select("doc_id", "text", "toxic", "shard"), "toxic-shards")

    def step(weights: np.ndarray):
        def shard(rows: pa.Table) -> pa.Table:
            out = list(trained(iter(rows.to_batches()), weights))
            return pa.Table.from_batches(out, pa.schema([("weights", pa.list_(pa.float64())), ("n", pa.int64())]))

        return shard

    for _ in range(ROUNDS):
        rows = dealt.groupBy("shard").applyInArrow(step(weights), "weights array<double>, n long").collect()
        if rows:
            total = sum(r["n"] for r in rows)
            weights = sum(np.array(r["weights"]) * (r["n"] / total) for r in sorted(rows, key=lambda r: r["weights"]))
    return features, weights[:-1], float(weights[-1])


class Scorer:
    """Scores texts with learned weights; remembers the weight of the words it has seen."""

    def __init__(self, learned: tuple):
        self.weights = {f: float(w) for f, w in zip(learned[0], learned[1]) if w}
        self.bias = learned[2]
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        worth = self.known.get(word)
        if worth is None:
            if len(self.known) > CACHE:
                self.known.clear()
            worth = self.known[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return worth

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """``(first, last, score)`` of every sentence with a weighted word."""
        out = []
        for found in SENTENCE.finditer(text or ""):
            worth = sum(self.word(w) for w in WORDS.findall(found[0].lower()))
            if worth:
                out.append((found.start(), found.end(), float(1.0 / (1.0 + np.exp(-np.clip(self.bias + worth, -500.0, 500.0))))))
        return out

    def score(self, text: str | None) -> float:
        """The noisy-or of a text's sentences."""
        if not text or self.bias is None:
            return 0.0
        plain = sum(1 for _ in SENTENCE.finditer(text))
        mass = 0.0
        if any(self.word(w) for w in set(WORDS.findall(text.lower()))):
            for _, _, chance in self.sentences(text):
                mass -= float(np.log1p(-min(chance, 1.0 - 1e-15)))
                plain -= 1
        return float(-np.expm1(-(mass + plain * float(_softplus(np.float64(self.bias))))))


def score_documents(docs: DataFrame, learned: tuple, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, offending)``: ``offending`` are the sentences that reach half of the best one's score, as
    places in the text, of documents that reach the threshold."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(learned)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = [scorer.score(t) for t in texts]
            spans = []
            for text, score in zip(texts, scores):
                found = scorer.sentences(text) if score >= threshold else []
                best = max((s for _, _, s in found), default=0.0)
                spans.append([{"first": a, "last": b, "score": s} for a, b, s in found if s >= best / 2])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                names=["doc_id", "score", "offending"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scored, f"doc_id {kind}, score double, offending array<struct<first:int,last:int,score:double>>")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: ``doc_id, held_out, score, predicted``, and how many sentences offend."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_documents(docs, learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return found.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"),
    )
