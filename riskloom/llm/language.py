"""Language identification by unigram models over pieces, summed over all segmentations of a word.

The pieces come from a public tokenizer's vocabulary, which is given by path and never trained. Per language every piece
has a probability; a word's probability is the sum, over all ways to cut it into pieces, of the products of the piece
probabilities, by the forward algorithm. The probabilities are learned by expectation-maximisation from the words of
labelled documents: each round counts expected pieces with the forward and backward sums in Spark tasks and adds them up
per language and piece. A text's score is the posterior of its best language under equal priors.

Words are runs of letters in lower case; a word of more than ``CUT`` characters is scored in stretches of that length.
A character that is no piece has a fixed small probability in every language.

The model is a bounded table (vocabulary times languages). It is fitted on the word counts of labelled documents that are
not held out: of all of them in the pipeline, and in the operator's own query of ``TRAIN_DOCS`` per language at most, in
expectation, chosen by a hash of the id. Prediction runs over all rows and whole texts, in one pass without a shuffle. Tasks keep the words
already scored, up to ``CACHE`` of them, and count up to ``COUNTED`` before they send them on.

The posterior compares the learned languages with each other only, so the pipeline also asks how well a text fits its best
language: the mean log probability of its words must not be below that of nearly all training documents of the language
(``FIT_QUANTILE``, exact and over all of them), less ``FIT_SPREAD`` standard errors of a mean over so many words.

Nulls: a null text, or one without a letter, is ``und`` with score 0; a null id is never held out. Rows without a
language are not learned from. An empty table gives an empty result; without any labelled row every text is ``und``.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.frames import held_out, lean, table, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TRAIN_DOCS = 1_500
ROUNDS = 3
LONGEST = 8  # characters of the longest piece used
CUT = 40
CACHE = 500_000
COUNTED = 200_000
FLOOR = 1e-7  # probability of a character that is no piece, and of a piece that a language never used
UNKNOWN = "und"
MIN_SCORE = 0.4  # below it no language is likely enough, and the pipeline rejects a document
FIT_QUANTILE = 0.005
FIT_STEPS = 1_000  # steps to one of the logarithm, in which fits are counted
FIT_SPREAD = 3.0
WORDS = re.compile(r"[^\W\d_]+")
STEP = np.uint64(0x9E3779B97F4A7C15)
START = "▁"


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The pieces of a sentencepiece model that consist of letters, in lower case, with the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=os.path.realpath(path))
    found = {model.id_to_piece(k).lower() for k in range(model.get_piece_size())}
    return sorted(p for p in found if len(p) <= LONGEST and p.removeprefix(START).isalpha())


class Pieces:
    """Finds the pieces in words, many words at a time, and sums over segmentations."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.tables = {}
        hashes = [self._roll(p) for p in pieces]
        for length in range(1, LONGEST + 1):
            own = sorted((h, k) for k, (h, p) in enumerate(zip(hashes, pieces)) if len(p) == length)
            self.tables[length] = (
                np.array([h for h, _ in own], dtype=np.uint64), np.array([k for _, k in own], dtype=np.int64)
            )

    @staticmethod
    def _roll(piece: str) -> int:
        value = 0
        for c in piece:
            value = ((value + ord(c) + 1) * int(STEP)) & 0xFFFFFFFFFFFFFFFF
        return value

    def edges(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Lengths of the marked words, and per piece length the piece (or -1) that begins at each position."""
        marked = [START + w for w in words]
        lengths = np.array([len(w) for w in marked])
        width = int(lengths.max())
        codes = np.zeros((len(marked), width), dtype=np.uint64)
        codes[np.arange(width) < lengths[:, None]] = np.frombuffer(
            "".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes += np.uint64(1)
        found, rolled = [], np.zeros_like(codes)
        for length in range(1, min(LONGEST, width) + 1):
            rolled = (rolled[:, : width - length + 1] + codes[:, length - 1:]) * STEP
            keys, ids = self.tables[length]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, rolled), len(keys) - 1)
                found.append(np.where(keys[at] == rolled, ids[at], -1))
            else:
                found.append(np.full(rolled.shape, -1))
        return lengths, found

    def weights(self, chances: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of each edge in one language; a character that is no piece has the floor."""
        out = []
        for k, ids in enumerate(edges):
            worth = np.append(chances, FLOOR if k == 0 else 0.0)
            out.append(worth[ids])
        return out

    def forward(self, weights: list[np.ndarray]) -> np.ndarray:
        """Summed probability of all segmentations of every prefix."""
        n, width = weights[0].shape
        total = np.zeros((width + 1, n))
        total[0] = 1.0
        columns = [np.ascontiguousarray(w.T) for w in weights]
        for end in range(1, width + 1):
            for k in range(min(len(weights), end)):
                total[end] += total[end - k - 1] * columns[k][end - k - 1]
        return total

    def log_chances(self, model: np.ndarray, words: list[str]) -> np.ndarray:
        """``(words, languages)`` log probability of each word."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out = np.zeros((len(words), len(model)))
        for at in range(0, len(order), 20_000):
            block = order[at: at + 20_000]
            lengths, edges = self.edges([words[i] for i in block])
            rows = np.arange(len(block))
            for k, chances in enumerate(model):
                total = self.forward(self.weights(chances, edges))
                out[block, k] = np.log(total[lengths, rows])
        return out

    def expected(self, chances: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of every piece in words that occur ``counts`` times."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out = np.zeros(self.size + 1)
        for at in range(0, len(order), 20_000):
            block = order[at: at + 20_000]
            lengths, edges = self.edges([words[i] for i in block])
            weights = self.weights(chances, edges)
            ahead = self.forward(weights)
            n, width = weights[0].shape
            rows = np.arange(n)
            behind = np.zeros((width + 1, n))
            behind[lengths, rows] = 1.0
            for begin in range(width - 1, -1, -1):
                for k in range(min(len(weights), width - begin)):
                    behind[begin] += weights[k][:, begin] * behind[begin + k + 1]
            share = np.asarray(counts)[block] / ahead[lengths, rows]
            for k, ids in enumerate(edges):
                span = ids.shape[1]
                uses = ahead[:span].T * weights[k] * behind[k + 1: k + 1 + span].T * share[:, None]
                out += np.bincount(np.where(ids < 0, self.size, ids).ravel(), uses.ravel(), self.size + 1)
        return out[:-1]


def text_words(text: str | None) -> list[str]:
    """The words of a text, long ones in stretches."""
    found = WORDS.findall(text.lower()) if text else []
    if any(len(w) > CUT for w in found):
        found = [w[k: k + CUT] for w in found for k in range(0, len(w), CUT)]
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, word, n)`` of the rows of a task, emitted whenever many are held."""
    held: Counter = Counter()

    def emit() -> pa.RecordBatch:
        keys = list(held)
        batch = pa.RecordBatch.from_pydict({"lang": [k[0] for k in keys], "word": [k[1] for k in keys],
                                            "n": [held[k] for k in keys]})
        held.clear()
        return batch

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for word, n in Counter(w for w in text_words(text) if any(map(str.isalpha, w))).items():
                held[lang, word] += n
            if len(held) > COUNTED:
                yield emit()
    if held:
        yield emit()


def is_training(doc_id: str, lang: str, text: str) -> Column:
    """Whether a row is learned from: it has a language and a text and is not held out."""
    return ~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull()


def training_rows(docs: DataFrame, train_docs: int | None = None) -> DataFrame:
    """The rows of ``docs(doc_id, lang, text)`` that are learned from: all, or so many per language in expectation."""
    labelled = docs.where(is_training("doc_id", "lang", "text"))
    if train_docs is None:
        return labelled.select("doc_id", "lang", "text")
    rates = written(labelled.groupBy("lang").agg((F.lit(float(train_docs)) / F.count(F.lit(1))).alias("rate")),
                    "language-rates")
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1_000_000)) < F.col("rate") * 1_000_000
    return labelled.select("doc_id", "lang", "text").join(rates, "lang").where(drawn)


def learn(docs: DataFrame, path: str = VOCABULARY, rounds: int = ROUNDS,
          train_docs: int | None = TRAIN_DOCS) -> tuple:
    """``(languages, pieces, model)`` from ``docs(doc_id, lang, text)``; the model has a row per language."""
    lean(docs.sparkSession)
    pieces = vocabulary(path)
    words = training_rows(docs, train_docs).select("lang", "text").mapInArrow(_counted, "lang string, word string, n long")
    words = written(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    languages = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]
    model = np.full((len(languages), len(pieces)), 1.0 / max(1, len(pieces)))
    place = {name: k for k, name in enumerate(languages)}
    for _ in range(rounds if languages else 0):
        def uses(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            finder, total = Pieces(pieces), np.zeros(model.shape)
            for batch in batches:
                rows: dict = {}
                for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                    rows.setdefault(place[lang], []).append((word, n))
                for k, own in sorted(rows.items()):
                    total[k] += finder.expected(model[k], [w for w, _ in own], np.array([n for _, n in own], float))
            kind, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[kind, piece])],
                names=["kind", "piece", "uses"])

        # At most one row per language and piece comes back: the vocabulary bounds it.
        rows = words.mapInArrow(uses, "kind int, piece int, uses double").groupBy("kind", "piece").agg(
            F.sum("uses").alias("uses")).toPandas()
        total = np.zeros(model.shape)
        total[rows["kind"], rows["piece"]] = rows["uses"]
        model = np.maximum(total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300), FLOOR)
    return languages, pieces, model


def predict(docs: DataFrame, learned: tuple, fits: bool = False) -> DataFrame:
    """``docs`` (which has ``text``, and no such columns) with ``lang_pred`` and ``score``.

    With ``fits`` also ``fit``, the mean log probability of the words in that language, and ``n_fit``, their number.
    """
    languages, pieces, model = learned
    rest = [c for c in docs.columns if c != "text"]
    found = [*rest, "lang_pred", "score"] + ["fit", "n_fit"] * fits

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, known, values = Pieces(pieces), {}, np.zeros((0, len(languages)))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [text_words(t) for t in part.column("text").to_pylist()]
                new = {w for words in texts for w in words}.difference(known)
                if new and languages:
                    if len(known) > CACHE:
                        known, values, new = {}, values[:0], {w for words in texts for w in words}
                    new = sorted(new)
                    letters = np.array([any(map(str.isalpha, w)) for w in new])
                    fresh = np.where(letters[:, None], finder.log_chances(model, new), np.nan)
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    values = np.concatenate([values, fresh])
                names, scores, means, sizes = [], [], [], []
                for words in texts:
                    total = np.nansum(values[[known[w] for w in words]], axis=0) if words and languages else None
                    if total is None or not total.any():
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        means.append(None)
                        sizes.append(0)
                    else:
                        best = int(total.argmax())
                        names.append(languages[best])
                        scores.append(float(1.0 / np.exp(total - total[best]).sum()))
                        sizes.append(int((~np.isnan(values[[known[w] for w in words], best])).sum()) if fits else 0)
                        means.append(float(total[best]) / sizes[-1] if fits else None)
                columns = [*(part.column(c) for c in rest), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                if fits:
                    columns += [pa.array(means, pa.float64()), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=found)

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in rest] + ["lang_pred string", "score double"] + [
        "fit double", "n_fit long"] * fits)
    return docs.mapInArrow(scored, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: ``doc_id, held_out, lang_pred, score``."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), learn(docs.select("doc_id", "lang", "text")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def low_fits(seen: DataFrame, quantile: float = FIT_QUANTILE) -> DataFrame:
    """``(lang_pred, low)``: the exact quantile of ``seen(lang_pred, fit)`` per language, between two ranks by proportion.

    Fits are counted in steps, which are few; the two fits wanted are then looked up among those of their own steps.
    """
    step = F.floor(F.col("fit") * FIT_STEPS).alias("step")
    counts = seen.groupBy("lang_pred", step).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("lang_pred")
    at = (F.col("total") - 1) * F.lit(quantile)
    placed = counts.select("lang_pred", "step", (F.sum("n").over(own.orderBy("step")) - F.col("n")).alias("before"), "n",
                           F.sum("n").over(own).alias("total")).withColumn("at", at)
    hit = (F.col("before") <= F.ceil("at")) & (F.col("before") + F.col("n") > F.floor("at"))
    steps = written(placed.where(hit).select("lang_pred", "step", "before", "at"), "language-steps")
    values = seen.select("lang_pred", "fit", step).join(F.broadcast(steps), ["lang_pred", "step"])
    values = values.groupBy("lang_pred", "step", "before", "at", "fit").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang_pred", "step").orderBy("fit")) + F.col("before")
    ranked = values.withColumn("upto", upto).withColumn("first", F.col("upto") - F.col("n"))

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank < F.col("upto")), F.col("fit")))

    share = F.max("at") - F.floor(F.max("at"))
    low, high = at_rank(F.floor("at")), at_rank(F.ceil("at"))
    return ranked.groupBy("lang_pred").agg((low * (1 - share) + high * share).alias("low"))


def fit_limits(seen: DataFrame) -> DataFrame:
    """``(lang_pred, low, spread)``: a low quantile of the fit of each language's training documents, and the standard
    deviation of a word's log probability.

    ``seen(lang_pred, fit, n_fit)`` has the training documents whose language was predicted right.
    """
    middle = seen.groupBy("lang_pred").agg((F.sum(F.col("fit") * F.col("n_fit")) / F.sum("n_fit")).alias("middle"))
    apart = F.col("n_fit") * (F.col("fit") - F.col("middle")) ** 2
    spread = seen.join(F.broadcast(middle), "lang_pred").groupBy("lang_pred").agg(F.sqrt(F.avg(apart)).alias("spread"))
    return written(low_fits(seen).join(spread, "lang_pred"), "language-limits")  # one row per language


def language_stage(docs: DataFrame) -> DataFrame:
    """The documents with a language that the model is sure of and that they fit, in the columns of ``docs``.

    All are predicted once; the limits come from the predictions of all training documents.
    """
    carried = docs.select(F.struct("*").alias("row"), "text")
    learned = learn(docs.select("doc_id", "lang", "text"), train_docs=None)
    seen = written(predict(carried, learned, fits=True), "language-predicted")
    right = seen.where(is_training("row.doc_id", "row.lang", "row.text") & (F.col("lang_pred") == F.col("row.lang")))
    limits = fit_limits(right.select("lang_pred", "fit", "n_fit"))
    kept = seen.join(F.broadcast(limits), "lang_pred")
    fits = F.col("fit") >= F.col("low") - FIT_SPREAD * F.col("spread") / F.sqrt("n_fit")
    kept = kept.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE) & fits)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
