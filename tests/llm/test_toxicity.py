"""The subsequence kernel against its definition, and insults with gaps and inserted characters."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.llm import toxicity
from roadlens.llm.queries import with_shared_folder

FOLDER = "/root/testdata/sf0.1"
INSULTS = ["trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"]


def kernel(s, t):
    """All pairs of three-character subsequences written out."""
    def subsequences(u):
        codes = toxicity.char_class(np.array([ord(c) for c in u]))
        for i, j, k in itertools.combinations(range(len(u)), 3):
            if k - i < toxicity.SPAN:
                yield (int(codes[i]), int(codes[j]), int(codes[k])), toxicity.DECAY ** (k - i - 2)
    return sum(v * w for a, v in subsequences(s) for b, w in subsequences(t) if a == b)


def test_kernel_equals_its_definition():
    strings = ["^scum", "^s.c.u.m", "^aaaa", "^idxiot", "^idiot", "abc", "^réê", "^x y z", "banana", "^漢字漢字", "1234567890"]
    made = toxicity.Features(strings).kernels(strings)
    for i, s in enumerate(strings):
        for j, t in enumerate(strings):
            assert made[i, j] == pytest.approx(kernel(s, t) / np.sqrt(kernel(s, s) * kernel(t, t)), abs=1e-12)


def test_spellings_are_units():
    for word in ["^scum", "^disgusting"]:
        spelt = toxicity.variants(word)
        assert word not in spelt and len(spelt) > 30
        cut = {u for v in spelt if v.startswith("^") and len(v) < toxicity.LONGEST for u in toxicity.units_of(v[1:])}
        assert cut <= set(spelt) | {word}                   # a text's units of a spelling are the spelling's
        assert not any(v.startswith("^.") or "^" in v[1:] for v in spelt)
    assert "^s.c.u.m" in toxicity.variants("^scum") and "^sc um" in toxicity.variants("^scum")


@pytest.fixture(scope="module")
def model(spark):
    with_shared_folder(spark)
    return toxicity.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))


def spelt(word):
    inner = range(1, len(word))
    return {"plain": [word, word.upper() + "!"], "gap": [word[:i] + " " + word[i:] for i in inner],
            "mark": [word[:i] + c + word[i:] for i in inner for c in (".", "-", "*", "_", "--")],
            "letter": [word[:i] + c + word[i:] for i in inner for c in "qaiz5"], "marks": [c.join(word) for c in (".", "-", "*", " ")]}


@pytest.mark.parametrize("kind", ["plain", "gap", "mark", "letter", "marks"])
def test_insults_are_found_however_they_are_spelt(model, kind):
    texts = [f"and then the others said {v} to all of them" for w in INSULTS for v in spelt(w)[kind]]
    margins = toxicity.Scorer(model).margins(texts)
    scores = 1 / (1 + np.exp(-(margins * model.slope + model.intercept)))
    assert np.mean(scores >= 0.7) >= 0.9, [t for t, s in zip(texts, scores) if s < 0.7]


def test_clean_documents_not_learned_from_are_left_alone(spark, model):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    held = docs.join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    rows = held.select("toxic", toxicity.margins(model)(F.col("text")).alias("m")).toPandas()
    flagged = 1 / (1 + np.exp(-(rows.m * model.slope + model.intercept))) >= 0.7
    print("held out", len(rows), "recall", flagged[rows.toxic == 1].mean(), "clean flagged", flagged[rows.toxic == 0].mean())
    assert flagged[rows.toxic == 0].mean() <= 0.01 and flagged[rows.toxic == 1].mean() > 0.6


@pytest.mark.parametrize("toxic", [[1, 1, 1], [0, 0, 0], [None, None, None]])
def test_one_label_only(spark, toxic):
    docs = with_shared_folder(spark).createDataFrame([(i, "some text of words") for i in range(3)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.toxic(docs, labels).collect()} == {(0.0, 0)}


def test_texts_without_a_unit_get_the_lowest_score(model):
    assert np.isneginf(toxicity.Scorer(model).margins(["", " \n", "... !!! --"])).all()
