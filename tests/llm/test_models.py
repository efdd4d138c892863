"""Classifiers and language model scores: held-out accuracy, and plain versions where there is one."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taktspur.llm import lattice, quality, toxicity
from taktspur.llm.common import crc_bucket

WORDS = [a + b for a in ("the", "and", "tion", "ble", "er") for b in ("", "ing", "st", "on", "ea", "nd")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        bad, junk = i % 4 == 0, i % 5 == 0
        text = prose(rng, rng.randint(60, 120)).split()
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["scumlike", "idiotic", "morons"])
        if junk:
            text = [w + "%%%" for w in text]
        docs.append((i, " ".join(text)))
        labels.append((i, int(not junk), int(bad)))
    labels += [(None, 1, 1), (0, None, None), (5_000, 1, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def held_in(column):
    return crc_bucket(column, 5) != 0


def test_toxicity_on_held_out_rows(labelled, edge_docs, empty_docs):
    docs, labels = labelled
    model = toxicity.fit_toxicity(docs, labels, usable=held_in)
    rows = toxicity.score_toxicity(docs, model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 80
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    # The labels of held-out rows change nothing.
    turned = labels.withColumn("toxic", F.when(crc_bucket("doc_id", 5) == 0, 1 - F.col("toxic"))
                               .otherwise(F.col("toxic")))
    again = toxicity.fit_toxicity(docs, turned, usable=held_in)
    assert np.array_equal(model.weights, again.weights) and model.intercept == again.intercept
    assert toxicity.score_toxicity(edge_docs, model).count() == edge_docs.count()
    assert toxicity.score_toxicity(empty_docs, model).count() == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and 400 < kept.count() < 500


def test_labels_of_one_class_or_none(labelled):
    docs, labels = labelled
    for part, want in ((labels.where("toxic = 0"), 0), (labels.limit(0), 0), (labels.where("toxic = 1"), 1)):
        model = toxicity.fit_toxicity(docs, part)
        assert {r.predicted for r in toxicity.score_toxicity(docs.limit(5), model).collect()} == {want}


def test_2000_rows_of_a_class_are_learned_from(spark):
    ranks = [r.id for r in spark.range(2_400).where("id % 2 = 1").orderBy(F.xxhash64("id"), "id").collect()]
    late, rng = set(ranks[1_000:]), random.Random(3)
    docs = [(i, prose(rng, 8) + (" zyzzyva" if i in late else " idiotic" if i % 2 else "")) for i in range(2_400)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.range(2_400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"),
                                       (F.col("id") % 2).alias("quality"))
    for model, features in ((toxicity.fit_toxicity(docs, labels), toxicity.features_of(["zyzzyva"])),
                            (quality.fit_quality(docs, labels), quality.features_of(pa.array(["zyzzyva"])))):
        assert model.probabilities(features)[0] > 0.9
        assert len(model.features) < 5_000  # what fewer than five rows have is never collected


def test_quality_verdicts(labelled):
    docs, labels = labelled
    rows = quality.rate_quality(docs, quality.fit_quality(docs, labels)).collect()
    right = [r.kept == (r.doc_id % 5 != 0 and not r.base_failed) for r in rows]
    assert np.mean(right) > 0.98, [(r.doc_id, r.score, r.base_failed) for r, ok in zip(rows, right) if not ok][:5]


def plain_marginal(scores, text):
    """Sum over all segmentations, one by one."""
    if not text:
        return 1.0
    total = sum(math.exp(scores.score[text[:k]]) * plain_marginal(scores, text[k:])
                for k in range(1, len(text) + 1) if text[:k] in scores.score)
    if text[0] not in scores.score:
        spelled = sum(scores.byte[b] for b in text[0].encode())
        total += math.exp(spelled) * plain_marginal(scores, text[1:])
    return total


def test_lattice_sums_all_segmentations():
    path = lattice.public_tokenizers.path("piece_bpe_32k.model")
    counts = np.arange(32_000) % 97
    scores = lattice.PieceScores(path, counts, 7)
    for word in ("a", "thing", "tionable", "é中😀x", "\x01", "=="):
        assert scores.word(word) == pytest.approx(math.log(plain_marginal(scores, lattice.MARK + word)), abs=1e-9)
    total = sum(map(math.exp, scores.score.values())) + np.exp(scores.byte).sum() + math.exp(scores.end)
    assert total == pytest.approx(1.0)


def plain_log_marginal(score, byte, text):
    """From the end: ways[i] is the log probability of all ways to write text[i:]."""
    ways = [-math.inf] * len(text) + [0.0]
    for i in reversed(range(len(text))):
        terms = [score[text[i:j]] + ways[j] for j in range(i + 1, min(len(text), i + 40) + 1) if text[i:j] in score]
        if text[i] not in score:
            terms.append(sum(byte[b] for b in text[i].encode("utf-8", "surrogatepass")) + ways[i + 1])
        ways[i] = float(np.logaddexp.reduce(terms))
    return ways[0]


def plain_piece_scores(texts, ends):
    model = lattice.sentencepiece.SentencePieceProcessor(model_file=lattice.public_tokenizers.path("piece_bpe_32k.model"))
    counts = np.zeros(model.get_piece_size())
    for words in texts:
        for ids in model.encode(words):
            for i in ids:
                counts[i] += 1
    usable = [i for i in range(len(counts)) if not (model.is_control(i) or model.is_unknown(i))]
    total = sum(counts[i] + 0.5 for i in usable) + ends + 0.5
    logs = {i: math.log((counts[i] + 0.5) / total) for i in usable}
    byte = {int(model.id_to_piece(i)[3:5], 16): v for i, v in logs.items() if model.is_byte(i)}
    return {model.id_to_piece(i): v for i, v in logs.items() if not model.is_byte(i)}, byte, math.log((ends + 0.5) / total)


@pytest.mark.parametrize("most, kept", [(0, 0), (1, 1), (3, 1), (40, 6), (200, 106)])
def test_head_is_cut_between_frequencies(spark, most, kept):
    counts = [1_000] + [90] * 5 + [7] * 100 + [1] * 500
    df = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "h long, n long")
    got = [r.n for r in lattice.head_of(df, most).collect()]
    assert sorted(got, reverse=True) == counts[:kept]


@pytest.mark.parametrize("head", [1, 50, 1 << 18])
def test_scores_against_plain_counts(small_docs, edge_docs, head):
    docs = small_docs.select("doc_id", "text").where("doc_id < 60").unionByName(
        edge_docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))
    rows = docs.collect()

    def tokens(text):
        return [w.decode() for w in (text or "").encode().lower().split()]

    def bucket(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 7
    counts, ends = {}, 0
    for r in rows:
        if bucket(r.doc_id) != 2:
            ends += 1
            for w in tokens(r.text):
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    score, byte, end = plain_piece_scores([tokens(r.text) for r in rows if bucket(r.doc_id) != 2], ends)
    got = lattice.lattice_scores(docs, crc_bucket("doc_id", 7) != 2, head_words=head).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    assert len(got) == len(rows)
    for r, g in zip(sorted(rows, key=key), sorted(got, key=key)):
        words = tokens(r.text)
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + distinct + 1)) for w in words)
        base += math.log10((ends + 1) / (total + distinct + 1))
        assert (g.n_tokens, g.train_tokens) == (len(words) + 1, total)
        assert g.n_known == sum(w in counts for w in words) + 1
        assert g.base_score == pytest.approx(base, rel=1e-9)
        marginal = end + sum(plain_log_marginal(score, byte, lattice.MARK + w) for w in words)
        assert g.score == pytest.approx(marginal / math.log(10), rel=1e-9)


def test_scores_of_an_empty_table(empty_docs):
    assert lattice.lattice_scores(empty_docs, F.lit(True)).count() == 0


def plain_grams(text):
    low = (text or "").lower()
    return {low[i:i + n] for n in (4, 5, 6) for i in range(len(low) - n + 1)}


def plain_toxicity(learn, texts, every_label):
    """The whole classifier on sets of n-grams: log-count ratios, then many small plain gradient steps."""
    sets, y = [plain_grams(t) for t, _ in learn], np.array([float(v) for _, v in learn])
    count = {0: Counter(), 1: Counter()}
    for grams, label in zip(sets, y):
        count[int(label)].update(grams)
    n1, n0 = y.sum(), len(y) - y.sum()
    ratio = {g: math.log((count[1][g] + 2) / (n1 + 4) * (n0 + 4) / (count[0][g] + 2)) for g in count[0] | count[1]
             if count[0][g] + count[1][g] >= 5}
    names = sorted(g for g, r in ratio.items() if abs(r) >= 2.0)
    at = {g: k for k, g in enumerate(names)}

    def row(grams):
        own = [at[g] for g in grams if g in at]
        x = np.zeros(len(names))
        x[own] = [ratio[names[k]] for k in own]
        return x / max(len(own), 1) ** 0.25

    x = np.array([row(g) for g in sets])
    w, b = np.zeros(len(names)), 0.0
    rate = 3.9 / ((x * x).sum(axis=1).max() + 1)
    for _ in range(60_000):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ error / len(y) + 1e-7 * w)
        b -= rate * error.mean()
    b += math.log(sum(every_label) / (len(every_label) - sum(every_label))) - math.log(n1 / n0)
    return [1 / (1 + math.exp(-(row(plain_grams(t)) @ w + b))) for t in texts]


def test_toxicity_equals_the_plain_classifier(spark):
    rng = random.Random(21)
    fair, foul = ["garden", "weather", "lovely day", "reading", "the river"], ["grubwort", "nasty snarl", "vile toad", "scum"]
    rows = []
    for i in range(90):
        label = int(i % 3 == 0)
        words = [rng.choice(foul if label and rng.random() < 0.6 or rng.random() < 0.1 else fair) for _ in range(rng.randrange(3, 9))]
        rows.append((i, " ".join(words), label))
    asked = [t for _, t, _ in rows[:40]] + ["", None, "Grubwort in the garden", "zzz"]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, steps=20_000)
    query = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = [r.score for r in toxicity.score_toxicity(query, model).orderBy("doc_id").collect()]
    want = plain_toxicity([(t, y) for _, t, y in rows], asked, [y for _, _, y in rows])
    # Both go down the same convex curve, which is nearly flat at its end.
    assert np.abs(np.array(got) - np.array(want)).max() < 0.02
    assert np.corrcoef(got, want)[0, 1] > 0.999
