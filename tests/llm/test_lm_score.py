"""Language-model scores against models of plain dictionaries."""

import math
import random
import re
from collections import Counter

import pytest

from fundlattice.llm import lm_score

PAIR, WORD = 0.7, 0.9


def split(text):
    return re.findall(r"[^ ]+", (text or "").lower())


class Plain:
    """Counts of words and pairs in dictionaries."""

    def __init__(self, texts, vocabulary):
        self.words, self.pairs, self.vocabulary = Counter(), Counter(), vocabulary
        for t in texts:
            w = split(t)
            self.words.update(w)
            self.pairs.update(zip(w, w[1:]))

    def loss(self, text, learned):
        """Mean loss of a word, without the text's own counts if it was learned from."""
        w = split(text)
        own = Plain([text] if learned else [], 0)
        size = sum(self.words.values()) - sum(own.words.values())
        total = 0.0
        for k, x in enumerate(w):
            share = (self.words[x] - own.words[x]) / size if size else 0
            alone = WORD * share + (1 - WORD if size else 1) / (self.vocabulary + 1)
            seen = self.words[w[k - 1]] - own.words[w[k - 1]] if k else 0
            both = self.pairs[w[k - 1], x] - own.pairs[w[k - 1], x]
            total -= math.log(PAIR * both / seen + (1 - PAIR) * alone if seen else alone)
        return total / max(1, len(w))


def test_scores_by_brute_force(spark):
    texts = ["a b a b c", "A b x", None, "", "q", "a b " * 3000, "z y z y", "a b a b c", "a b a b c"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    target = spark.createDataFrame([(0,), (0,), (1,), (None,), (99,)], "doc_id long")
    out = {r["doc_id"]: r for r in lm_score.score(df, lm_score.train(df, target), learned=True).collect()}
    vocabulary = len({w for t in texts for w in split(t)})
    good, every = Plain(texts[:2], vocabulary), Plain(texts, vocabulary)
    for i, t in enumerate(texts):
        assert out[i]["target_loss"] == pytest.approx(good.loss(t, i < 2)) and out[i]["background_loss"] == pytest.approx(every.loss(t, True))
        assert out[i]["score"] == pytest.approx(good.loss(t, i < 2) - every.loss(t, True)) and out[i]["n_tokens"] == len(split(t))
    assert lm_score.score(df.limit(0), lm_score.train(df.limit(0), target), learned=True).count() == 0


def test_repeated_rows_and_null_ids(spark):
    """Each of three equal rows is scored without itself; rows with a null id are learned from and scored, but are no target."""
    rows = [(1, "a b c"), (1, "a b c"), (1, "a b c"), (None, "b c d"), (2, "d a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = lm_score.score(df, lm_score.train(df, spark.createDataFrame([(1,), (None,)], "doc_id long")), learned=True).collect()
    every, good = Plain([t for _, t in rows], 4), Plain(["a b c"] * 3, 4)
    assert sorted(r["doc_id"] or 0 for r in out) == [0, 1, 1, 1, 2]
    for r in out:
        text = {1: "a b c", None: "b c d", 2: "d a"}[r["doc_id"]]
        assert r["background_loss"] == pytest.approx(every.loss(text, True)) and r["target_loss"] == pytest.approx(good.loss(text, r["doc_id"] == 1))


def test_each_distinct_word_and_pair_has_its_own_count(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PORTION", 200_000)
    rng = random.Random(5)
    names = [f"w{k}" for k in range(300_000)]
    texts = [" ".join(rng.sample(names, 3_000)) for _ in range(240)] + [" ".join(names)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    good = range(0, 200, 2)
    out = {r["doc_id"]: r for r in lm_score.score(df, lm_score.train(df, spark.createDataFrame([(i,) for i in good], "doc_id long")), learned=True).collect()}
    assert len(out) == len(texts)
    every, target = Plain(texts, len(names)), Plain([texts[i] for i in good], len(names))
    assert len(every.pairs) > 900_000
    for i in (0, 1, 7, 150, 239, 240):
        assert out[i]["background_loss"] == pytest.approx(every.loss(texts[i], True)) and out[i]["target_loss"] == pytest.approx(target.loss(texts[i], i in good))


def test_probabilities_sum_to_one(spark):
    """Over the vocabulary and one unknown word: at a text's begin, and after a word that never ends a text."""
    df = spark.createDataFrame([(0, "a b a c d"), (1, "c a d b c"), (2, "d d b")], "doc_id long, text string")
    model = lm_score.train(df, spark.createDataFrame([(0,)], "doc_id long"))
    words = ["a", "b", "c", "d", "unknown"]
    asked = [(w, w) for w in words] + [(f"a {w}", f"a {w}") for w in words]
    out = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(asked, "doc_id string, text string"), model).collect()}
    for side in ("target_loss", "background_loss"):
        assert sum(math.exp(-out[w][side]) for w in words) == pytest.approx(1)
        assert sum(math.exp(-2 * out[f"a {w}"][side] + out["a"][side]) for w in words) == pytest.approx(1)


def test_other_documents_than_those_learned_from(spark):
    df = spark.createDataFrame([(0, "a b a c"), (1, "c a d")], "doc_id long, text string")
    model = lm_score.train(df, spark.createDataFrame([(0,)], "doc_id long"))
    out = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame([("x", "a b z"), (None, "a d"), ("y", "")], "doc_id string, text string"), model).collect()}
    every, good = Plain(["a b a c", "c a d"], 4), Plain(["a b a c"], 4)
    assert len(out) == 3 and out["y"]["n_tokens"] == 0
    assert out["x"]["background_loss"] == pytest.approx(every.loss("a b z", False)) and out[None]["target_loss"] == pytest.approx(good.loss("a d", False))


def test_a_table_that_is_read_twice_gives_the_same_scores(spark):
    """Whether own counts are left out is said, and doesn't hang on which DataFrame stands for the rows."""
    make = lambda: spark.createDataFrame([(1, "a b a c"), (2, "a b d"), (3, "x y")], "doc_id long, text string")
    model = lm_score.train(make(), spark.createDataFrame([(1,)], "doc_id long"))
    scores = lambda learned: sorted(tuple(r) for r in lm_score.score(make(), model, learned=learned).collect())
    assert scores(True) == sorted(tuple(r) for r in lm_score.score(model.docs, model, learned=True).collect())
    assert scores(True)[0][2] > scores(False)[0][2]  # the target's own text is no news to its model
