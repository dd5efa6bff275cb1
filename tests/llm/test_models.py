"""Operators that SQL cannot express, against brute force and held-out labels."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL

from riskloom.llm import fingerprint, frames, language, lines, mixing, near, quality, substring, toxicity
from riskloom.llm import text as words_of
from riskloom.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.01"


def test_words_of_batches():
    texts = ["", None, " a", "a b", "b\x0b ", "\n", "é à\xa0b", "x" * 70_000 + " y", "a\x00b"]
    hashes, first = words_of.hashed(pa.array(texts))
    expected = [t.encode().split() if t else [] for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in expected]
    names = {}
    for word, value in zip([w for ws in expected for w in ws], hashes):
        assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert [t for b in words_of.blocks(iter([batch])) for t in b.column("text").to_pylist()] == texts


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁", "a", "b", "ab", "ba", "▁ab"]
    chances = np.array([0.2, 0.1, 0.15, 0.05, 0.25, 0.1, 0.15])
    finder, known = language.Pieces(pieces), dict(zip(pieces, chances))

    def cuts(word):
        for marks in itertools.product([0, 1], repeat=len(word) - 1):
            parts, begin = [], 0
            for k, mark in enumerate(marks, 1):
                if mark:
                    parts.append(word[begin:k])
                    begin = k
            yield [*parts, word[begin:]]

    words = ["ab", "a", "bab", "abzba", "b"]
    found = finder.log_chances(np.array([chances]), words)[:, 0]
    uses = np.zeros(len(pieces))
    for word, value in zip(words, found):
        paths = [(p, math.prod(known.get(x, language.FLOOR if len(x) == 1 else 0.0) for x in p)) for p in cuts("▁" + word)]
        total = sum(c for _, c in paths)
        assert value == pytest.approx(math.log(total), rel=1e-9)
        for parts, chance in paths:
            for part in parts:
                if part in known:
                    uses[pieces.index(part)] += chance / total
    assert finder.expected(chances, words, np.ones(len(words))) == pytest.approx(uses, rel=1e-9)


def test_language_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = QUERIES["op2_language_id"](spark, LARGER).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame(
        [(k, lang, text) for k, (lang, text) in enumerate([("en", "the of and"), ("fr", "le des une"), ("en", "the and")] * 9)]
        + [(100, None, None), (101, "en", ""), (102, None, "12 ½ !"), (103, None, "z" * 100_000), (104, "en", "é")],
        "doc_id long, lang string, text string")
    learned = language.learn(docs)
    rows = {r.doc_id: r for r in language.predict(docs.select("doc_id", "text"), learned).collect()}
    assert [rows[k].lang_pred for k in (0, 1, 100, 101, 102)] == ["en", "fr", "und", "und", "und"]
    assert rows[103].lang_pred in ("en", "fr") and 0 <= rows[103].score <= 1
    none = language.learn(docs.where("false"))
    assert {r.lang_pred for r in language.predict(docs.select("doc_id", "text"), none).collect()} == {"und"}


def test_language_stage_rejects_texts_of_no_learned_language(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang", "text")
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    polish = ("wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem "
              "i sumieniem i powinni postępować wobec innych w duchu braterstwa ") * 3
    noise = " ".join("".join(rng.choice(letters, rng.integers(3, 10))) for _ in range(200))
    short = [" ".join(r.text.split()[:k]) for k, r in zip((3, 5, 8, 12, 20, 30), docs.where(
        "lang = 'en' and length(text) > 300").orderBy("doc_id").limit(6).collect())]
    added = spark.createDataFrame([(f"x{k}", None, t) for k, t in enumerate([polish, noise, *short])],
                                  "doc_id string, lang string, text string")
    all_ = docs.withColumn("doc_id", docs["doc_id"].cast("string")).unionByName(added)
    kept = {r.doc_id for r in language.language_stage(all_).collect()}
    assert not {"x0", "x1"} & kept and {f"x{k}" for k in range(2, 8)} <= kept
    assert len(kept) >= 0.97 * docs.count()


def test_language_learns_from_every_training_document(spark, tmp_path):
    """No labelled document that is not held out is left out of the counts, however many there are."""
    texts = spark.range(6_000).selectExpr("id AS doc_id", "'en' AS lang", "concat('the ', repeat('q', 1 + CAST(id AS INT))) AS text")
    seen = []
    plain = language.written
    try:
        language.written = lambda df, label: (seen.append(plain(df, label)) or seen[-1])
        language.learn(texts, rounds=0, train_docs=None)
    finally:
        language.written = plain
    expected = sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(6_000))
    assert seen[0].where("word = 'the'").collect() == [("en", "the", expected)]


def test_low_fits_are_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    own = {"a": rng.normal(-9, 2, 2_001).tolist(), "b": [-3.25], "c": [-7.5] * 300 + [-7.5004] * 2, "d": [-1.0, -2.0]}
    seen = spark.createDataFrame([(k, float(x)) for k, xs in own.items() for x in xs], "lang_pred string, fit double")
    for quantile in (0.0, 0.005, 0.37, 1.0):
        found = {r.lang_pred: r.low for r in language.low_fits(seen, quantile).collect()}
        assert found == {k: pytest.approx(np.quantile(xs, quantile), rel=1e-12) for k, xs in own.items()}


def test_toxicity_on_held_out_documents(spark):
    rows = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    found = Counter((r.toxic, rows[r.doc_id].predicted) for r in labels if rows[r.doc_id].held_out)
    assert found[1, 1] >= 0.8 * (found[1, 1] + found[1, 0])
    assert found[0, 1] <= 0.01 * (found[0, 1] + found[0, 0])
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())


def test_toxic_sentences_are_located():
    learned = (["idiot"], np.array([12.0]), -6.0)
    scorer = toxicity.Scorer(learned)
    text = "All is well. You idiot! Go on."
    assert [text[a:b] for a, b, _ in scorer.sentences(text)] == [" You idiot"]
    chances = [1 / (1 + math.exp(6)), 1 / (1 + math.exp(-6)), 1 / (1 + math.exp(6))]
    assert scorer.score(text) == pytest.approx(1 - math.prod(1 - c for c in chances))
    assert scorer.score("") == scorer.score(None) == 0.0


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    rows = toxicity.score_documents(docs, toxicity.learn(docs, labels)).collect()
    assert {r.score for r in rows} == {0.0}


def _kneser_ney(texts):
    """A dictionary version of the model: probability of a class after a context."""
    order, bits = quality.ORDER, quality.BITS
    top = Counter()
    for text in texts:
        value = [0] * (order - 1) + [int(quality.CLASS[b]) for b in text.encode()]
        top.update(tuple(value[k:k + order]) for k in range(len(value) - order + 1))
    levels = {order: top}
    for width in range(order - 1, 0, -1):
        levels[width] = Counter(g[1:] for g in levels[width + 1])
    discounts, totals, kinds = {}, {}, {}
    for width, counts in levels.items():
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        discounts[width] = [max(min(k - (k + 1) * y * n[k + 1] / n[k], k), 0.1) if n[k] else 0.5 for k in (1, 2, 3)]
        totals[width], kinds[width] = Counter(), defaultdict(float)
        for gram, count in counts.items():
            totals[width][gram[:-1]] += count
            kinds[width][gram[:-1]] += discounts[width][min(count, 3) - 1]

    def chance(gram):
        if not gram:
            return 1.0 / (1 << bits)
        width, context = len(gram), gram[:-1]
        lower = chance(gram[1:])
        if not totals[width][context]:
            return lower
        count = levels[width][gram]
        own = count - discounts[width][min(count, 3) - 1] if count else 0.0
        return (own + kinds[width][context] * lower) / totals[width][context]

    return chance


def test_quality_model_is_kneser_ney(spark):
    texts = ["the cat sat on the mat.\n", "The dog, the cat and 3 mats", "é là", "aaaa bbbb aaaa", "on on on"] * 2
    trusted = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    models = quality.dense(quality.smoothed(quality.gram_counts(trusted)))
    assert set(models) == {"en", quality.EVERY} and np.allclose(models["en"], models[quality.EVERY])
    chance = _kneser_ney(texts)
    table = np.exp(models["en"].astype(float))
    assert np.allclose(table.reshape(-1, 1 << quality.BITS).sum(axis=1), 1.0, atol=1e-4)
    rng = np.random.default_rng(1)
    seen = sorted({int(g) for t in texts for g in quality.grams(pa.array([t]))[0]})
    for gram in [*seen, *rng.integers(0, quality.SIZE, 300).tolist()]:
        parts = tuple((gram >> (quality.BITS * k)) & 31 for k in range(quality.ORDER - 1, -1, -1))
        assert table[gram] == pytest.approx(chance(parts), rel=1e-4)


def _halves(spark, texts, lang="en", trusted=None):
    docs = [(k, lang, t) for k, t in enumerate(texts)]
    labels = [(k, 1) for k in range(len(texts) if trusted is None else trusted)]
    return (spark.createDataFrame(docs, "doc_id long, lang string, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int"))


def test_quality_is_kneser_ney_of_word_pairs(spark):
    texts = ["the cat sat on the mat", "the dog sat on the cat", "a dog, the cat", "the the the", "on 3 mats",
             "the cat sat on a dog", "é là the cat", "zebra"] * 2
    docs, labels = _halves(spark, texts, trusted=12)
    found = {r.doc_id: r.perplexity for r in quality.scored(docs, labels).collect()}
    spell = quality.spelling(docs, labels)["en"].astype(float)
    half = [zlib.crc32(str(k).encode()) % 2 for k in range(len(texts))]
    assert set(half) == set(half[:12]) == {0, 1}

    def spelled(word):
        value, total = [0] * (quality.ORDER - 1), 0.0
        for byte in [*word.encode(), 32]:
            value.append(int(quality.CLASS[byte]))
            gram = sum(v << (quality.BITS * k) for k, v in enumerate(reversed(value[-quality.ORDER:])))
            total += spell[gram] - (math.log((quality.CLASS == quality.CLASS[byte]).sum()) if byte != 32 else 0.0)
        return math.exp(total)

    def discounts(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        return [max(min(k - (k + 1) * y * n[k + 1] / n[k], k), 0.1) if n[k] else 0.5 for k in (1, 2, 3)]

    marked = [["<s>", *t.split(), ""] for t in texts]
    for side in (0, 1):
        pairs = Counter(p for k in range(12) if half[k] != side for p in itertools.pairwise(marked[k]))
        kinds = Counter(w for _, w in pairs)
        two, one = discounts(pairs), discounts(kinds)

        def low(w):
            lost = sum(one[min(n, 3) - 1] for n in kinds.values())
            own = kinds[w] - one[min(kinds[w], 3) - 1] if kinds[w] else 0.0
            return (own + lost * spelled(w)) / sum(kinds.values())

        def chance(v, w):
            own = {x: n for (u, x), n in pairs.items() if u == v}
            if not own:
                return low(w)
            lost = sum(two[min(n, 3) - 1] for n in own.values())
            return (own.get(w, 0) - (two[min(own[w], 3) - 1] if w in own else 0.0) + lost * low(w)) / sum(own.values())

        for k, words in enumerate(marked):
            if half[k] == side:
                total = sum(math.log(chance(v, w)) for v, w in itertools.pairwise(words))
                assert found[k] == pytest.approx(math.exp(-total / len(texts[k].encode())), rel=1e-4)


def test_quality_drops_what_is_weighed(spark, monkeypatch):
    """Pairs are counted in slices of their second word, and no table of them or of trusted texts outlasts its use."""
    made, plain, sliced = [], quality.written, []

    def recorded(df, label):
        table = plain(df, label)
        made.append((label, table.inputFiles()[0].removeprefix("file:").replace("///", "/")))
        if label == "quality-pairs":
            sliced.append({r.w % quality.SLICES for r in table.collect()})
        return table

    monkeypatch.setattr(quality, "written", recorded)
    monkeypatch.setattr(quality, "SMALL_TEXT", 0)
    monkeypatch.setattr(quality, "PASSES", 2)
    texts = [f"some good words {k} of trusted text" for k in range(12)]
    assert len(quality.scored(*_halves(spark, texts)).collect()) == 12
    assert len(sliced) == quality.SLICES and all(x <= {k} for k, x in enumerate(sliced)) and any(sliced)
    at = {label: [p for x, p in made if x == label] for label, _ in made}
    for label in ("quality-trusted", "quality-pairs", "quality-word-kinds", "quality-word-contexts", "quality-words",
                  "quality-weights"):
        assert at[label] and not any(os.path.exists(p) for p in at[label])
    assert len(at["quality-sums"]) == quality.PASSES and all(os.path.exists(p) for p in at["quality-sums"])


def test_quality_sees_words_and_their_order_in_any_script(spark):
    rng = np.random.default_rng(3)
    letters = list("абвгдежзиклмнопрст")
    names = ["".join(rng.choice(letters, 5)) for _ in range(60)]
    good = [" ".join(names[(b + k) % 60] for k in range(30)) for b in rng.integers(0, 60, 60)]
    shuffled = [" ".join(rng.permutation(t.split())) for t in good[:20]]
    unknown = [" ".join("".join(rng.choice(letters, 5)) for _ in range(30)) for _ in range(20)]
    rows = quality.judge(*_halves(spark, good + shuffled + unknown, "ru", 60)).collect()
    keep = {r.doc_id: r.keep for r in rows}
    assert sum(keep[k] for k in range(60)) >= 58 and not any(keep[k] for k in range(60, 100))


def test_quality_takes_all_models_for_other_languages(spark):
    texts = ["the cat sat on the mat", "the dog sat on the cat"] * 4
    rows = [(k, "en", t) for k, t in enumerate(texts)] + [(20, None, texts[0]), (21, "xx", texts[0]), (20, "en", ""),
                                                          (None, "en", None), (None, "en", " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(8)], "doc_id long, quality int")
    found = quality.judge(docs, labels).collect()
    assert len(found) == len(rows)
    assert all(r.perplexity and r.threshold for r in found if r.lang != "en")
    assert sum(r.perplexity is None for r in found) == 2


def test_quality_tells_junk(spark):
    rows = {r.doc_id: r for r in QUERIES["op3_quality"](spark, LARGER).collect()}
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").where("quality is not null").collect()
    found = Counter((r.quality, rows[r.doc_id].keep) for r in labels)
    assert found[0, False] >= 0.75 * (found[0, False] + found[0, True])
    assert found[1, False] <= 0.05 * (found[1, False] + found[1, True])


def test_quality_thresholds_are_quantiles(spark):
    scores = spark.createDataFrame([("en", float(k)) for k in range(1, 101)] + [("fr", 7.0), (None, 3.0), ("en", None)],
                                   "lang string, perplexity double")
    limits = {r.lang: r.threshold for r in quality.thresholds(scores, 0.9).collect()}
    assert limits["en"] == pytest.approx(90, rel=2e-3) and limits["fr"] == pytest.approx(7, rel=2e-3)
    assert set(limits) == {"en", "fr", quality.EVERY}


def test_fingerprints_match_brute_force(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()),
                  reverse=True)
    rows = {r.doc_id: r for r in QUERIES["op8_lz_fingerprint"](spark, SMALL).collect()}
    assert len(rows) == len(docs)

    def parsed(text):
        phrases, begin, end = set(), 0, 1
        while end <= len(text):
            if text[begin:end] not in phrases:
                phrases.add(text[begin:end])
                begin = end
            end += 1
        return phrases

    def signed(text):
        phrases = sorted(parsed(text))
        joined = "".join(phrases)
        ends = np.cumsum([len(p) for p in phrases]) if phrases else np.zeros(0, dtype=np.int64)
        return fingerprint.signature(fingerprint.Hasher()(joined, ends))

    for (doc_id, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        row, own, other = rows[doc_id], signed(text), signed(edited)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == fingerprint.spelled(own) and row.edited_fingerprint == fingerprint.spelled(other)
        assert row.near_edited == fingerprint.likeness(own, other)
        assert row.near_next == fingerprint.likeness(own, signed(after))
    assert (fingerprint.read(fingerprint.spelled(own)) == own).all()


def test_fingerprint_neighbours_cross_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 3)
    docs = [(k * 7 % 50, f"text {k} " * (k % 5)) for k in range(50)] + [(None, "none"), (5, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = fingerprint.neighbours(frame).collect()
    assert len(rows) == len(docs)
    ordered = sorted(((k, t or "") for k, t in docs if k is not None and (k, t) != (5, None) and k != 5), reverse=True)
    found = {r.doc_id: r for r in rows}
    for (a, text), (b, after) in zip(ordered, ordered[1:]):
        if a > 6 or b < 4 and a < 5:
            edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
            assert found[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    one = fingerprint.neighbours(frame.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_substring_repeats_are_maximal(spark):
    shared = [f"s{k}" for k in range(20)]
    docs = spark.createDataFrame([
        (3, " ".join(["x", *shared, "y"])), (1, " ".join(["p", *shared[:15], "q"])), (2, " ".join(["r", *shared[5:], "t"])),
    ], "doc_id long, text string")
    rows = {r.doc_id: r for r in substring.without_repeats(docs).collect()}
    assert rows[1].repeats == [] and rows[2].repeats == []
    assert [(s.first, s.last) for s in rows[3].repeats] == [(1, 21)] and rows[3].kept == "x y"


def test_likelihood_finds_the_similarity():
    rng = np.random.default_rng(7)
    for common, only in ((400, 50), (300, 150), (100, 350)):
        pool = rng.integers(0, 2**63, common + 2 * only).astype(np.uint64)
        one, two = pool[: common + only], np.concatenate([pool[:common], pool[common + only:]])
        x, y = (np.array([near.registers(np.array([(s * f).min()]))[0] for f in near.FACTORS]) for s in (one, two))
        n = np.array([float(common + only)])
        estimate, _ = near.likelihoods(*(np.array([v]) for v in ((x > y).sum(), (x < y).sum(), (x == y).sum())), n, n)
        assert abs(estimate[0] - common / (common + 2 * only)) < 0.15
        union = np.array([near.registers(np.array([(np.concatenate([one, two]) * f).min()]))[0] for f in near.FACTORS])
        assert (union == np.maximum(x, y)).all()


def test_components_follow_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 102)], "a long, b long")
    found = {r.cid: r.comp for r in near.components(edges).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def test_few_labels_need_no_shuffle(spark, monkeypatch):
    """However many shuffle partitions there are, the rounds over few links and labels are not dealt out."""
    plans, plain = [], frames.written

    def recorded(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return plain(df, label)

    monkeypatch.setattr(frames, "written", recorded)
    monkeypatch.setattr(near, "written", recorded)
    words = [f"t{k}" for k in range(60)]
    texts = [" ".join([*words[:k], f"c{k}", *words[k + 1:]]) for k in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in near.near_groups(docs).collect()} == {0}
    rounds = [plan for label, plan in plans if label == "near-labels"]
    assert len(rounds) > 1 and not any("hashpartitioning" in plan for plan in rounds)
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r.comp for r in near.components(edges, 40).collect()} == {0}
    monkeypatch.setattr(near, "PART_ROWS", 10)
    assert {r.comp for r in near.components(edges, 40).collect()} == {0}
    assert any("hashpartitioning" in plan for label, plan in plans if label == "near-labels")


def test_near_links_need_no_star(spark):
    """A bucket whose smallest member is linked with nothing still links the others."""
    base = [f"t{k}" for k in range(60)]

    def text(changed):
        return " ".join(f"c{k}" if k in changed else w for k, w in enumerate(base))

    docs = spark.createDataFrame(
        [(1, text(range(0, 60, 7))), (2, text([])), (3, text([5])), (4, text([5, 6])), (5, text([50])), (6, "t1 t2")],
        "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near.near_groups(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 6}


def test_copies_of_one_text_are_compared_by_what_they_change(spark, monkeypatch):
    """Many copies of one text, some linked and some too far off: right groups from few compared pairs."""
    size, some = 5, random.Random(5)
    base = [f"t{k}" for k in range(90)]

    def copy(edits):
        words = list(base)
        for _ in range(edits):
            words[some.randrange(len(words))] = some.choice(["to", "of", "the", f"own{some.randrange(10**6)}"])
        return " ".join(words)

    texts = [copy(some.choice((0, 1, 1, 2, 3, 4, 5))) for _ in range(400)]
    sets = [{tuple(w[i:i + size]) for i in range(len(w) - size + 1)} for w in (t.split() for t in texts)]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    compared, plain = [], near._linked
    monkeypatch.setattr(near, "_linked", lambda pairs, *more: compared.append(pairs.count()) or plain(pairs, *more))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in near.near_groups(docs, size).collect()}
    assert found == {k: root(k) for k in range(len(texts))}
    assert len(set(found.values())) > 20 and max(Counter(found.values()).values()) > 100
    assert sum(compared[1:]) < 1_200  # 2,278 by rare shingles of the whole texts


def test_mix_clamps_and_reshares(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    rows = {r.source: r.target for r in mixing.source_targets(sources).collect()}
    assert rows["a"] == 20 and rows[None] == 0 and sum(rows.values()) == pytest.approx(1.5 * 2010)
    assert rows["b"] == pytest.approx((3015 - 20) / 3) and rows["c"] == pytest.approx(2 * (3015 - 20) / 3)


def test_pages_of_boilerplate_only_are_kept(spark):
    rows = [(k, "h", f"menu\nown {k}\nfoot") for k in range(20)] + [(100 + k, "h", "menu\nfoot") for k in range(3)]
    pages = spark.createDataFrame(rows, "doc_id long, host string, text string")
    found = {r.row.doc_id: r.text for r in lines.drop_boilerplate(pages, "doc_id", "host", "text").collect()}
    assert found[3] == "own 3" and found[101] == "menu\nfoot"
