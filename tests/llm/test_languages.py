"""The language kernel written out, many scripts, many languages, and bounds of the fit."""

import unicodedata
import zlib

import numpy as np
import pytest

from roadlens.llm import langid
from roadlens.llm.queries import with_shared_folder

# First letter and number of letters of each invented language's alphabet.
SCRIPTS = {"en": (0x61, 26), "el": (0x3B1, 24), "ru": (0x430, 32), "hy": (0x561, 38), "he": (0x5D0, 27), "ar": (0x628, 19), "hi": (0x915, 37),
           "th": (0xE01, 46), "ka": (0x10D0, 33), "ko": (0xAC00, 3000), "ja": (0x3042, 80), "zh": (0x4E00, 4000)}


def invented(rng, lang, n_words):
    first, size = SCRIPTS[lang]
    # Letters by a falling frequency, so languages of thousands of letters show new ones in every text.
    draw = lambda: chr(first + min(size - 1, int(rng.pareto(1.2 if size > 100 else 0.8) * size / 12)))
    return " ".join("".join(draw() for _ in range(rng.integers(1, 7))) for _ in range(n_words))


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_scripts_are_told_apart(spark):
    rng = np.random.default_rng(6)
    rows = [(i, invented(rng, lang, int(rng.integers(5, 60))), lang) for i, lang in enumerate(sorted(SCRIPTS) * 60)]
    docs = with_shared_folder(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    made = {r.doc_id: r for r in langid.languages(docs).collect()}
    right = {}
    for doc, _, lang in rows:
        if held(doc):
            right.setdefault(lang, []).append(made[doc].lang_pred == lang)
    assert set(right) == set(SCRIPTS) and all(np.mean(r) >= 0.95 for r in right.values()), {k: np.mean(r) for k, r in right.items()}


def test_more_languages_than_landmarks(spark):
    """Every language keeps rows and landmarks of its own, however many there are."""
    rng = np.random.default_rng(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(90):
        own = rng.permutation(list(letters))[:9]
        rows += [(k * 12 + i, " ".join("".join(rng.choice(own, 4)) for _ in range(40)), f"l{k:02d}") for i in range(12)]
    docs = with_shared_folder(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    made = {r.doc_id: r.lang_pred for r in langid.languages(docs, langid.Settings(landmarks=64, rows=900)).collect()}
    out = [made[d] == lang for d, _, lang in rows if held(d)]
    assert np.mean(out) > 0.9


def spectrum(text):
    """n-grams as strings, borders as a blank, blocks as numbers: the kernel's feature set without any coding."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    if not any(unicodedata.category(c)[0] == "L" for c in kept):
        return set()
    padded = " " + " ".join(kept.split()) + " "
    return {padded[i:i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)} | {ord(c) >> 7 for c in kept if unicodedata.category(c)[0] == "L"}


TEXTS = ["", "1 2 3!", "Ab  ab, b-a", "naïve Ünïcode ß", "한국어 텍스트", "漢字かな交じり", "हिन्दी में", "🙂a🙂", "x" * 5000, "A" + "́" * 4, "İstanbul ǅ"]


def test_grams_equal_the_spectrum_written_out():
    for text in TEXTS:
        assert len(langid.grams_of(text)) == len(spectrum(text)), text
    for a in TEXTS:
        for b in TEXTS:
            common = len(np.intersect1d(langid.grams_of(a), langid.grams_of(b)))
            assert common == len(spectrum(a) & spectrum(b)), (a, b)


def test_scores_equal_kernel_ridge_regression_written_out(spark):
    """With every sampled row a landmark the shares follow from the full kernel matrix, without Nyström."""
    rng = np.random.default_rng(9)
    rows = [(i, invented(rng, lang, 12), lang) for i, lang in enumerate(["en", "el", "ru"] * 14)]
    docs = with_shared_folder(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    settings = langid.Settings(landmarks=300, rows_per_lang=100)
    model = langid.fit(docs, settings)
    train = [(t, lang) for d, t, lang in rows if not held(d)]
    sets = [spectrum(t) for t, _ in train]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    gram = np.array([[kernel(a, b) for b in sets] for a in sets])
    target = np.array([[1.0 if lang == l else -1.0 for l in sorted(SCRIPTS) if l in ("en", "el", "ru")] for _, lang in train])
    n = len(train)
    centre = np.eye(n) - 1 / n
    alpha = np.linalg.solve(centre @ gram @ centre + settings.ridge * n * np.eye(n), centre @ target)
    for text in ["the quick brown", "αβγ δε", "привет мир", "mixed абв abc", invented(rng, "ru", 9)]:
        own = np.array([kernel(spectrum(text), s) for s in sets])
        margins = (own - gram.mean(0)) @ centre @ alpha + target.mean(0)
        expected = langid._softmax((margins * model.sharpness)[None])[0]
        assert langid.shares(model, [langid.grams_of(text)])[0] == pytest.approx(expected, abs=2e-4)


def test_fit_stays_within_its_bounds(spark):
    rows = [(i, f"wort{i} text", ["de", "en"][i % 2]) for i in range(400)]
    docs = with_shared_folder(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid._sample(docs, langid.Settings(rows=60, rows_per_lang=50)).collect()
    assert len(sample) == 60 and {r.lang for r in sample} == {"de", "en"}
    assert sorted(map(tuple, sample)) == sorted(map(tuple, langid._sample(docs.repartition(5), langid.Settings(rows=60, rows_per_lang=50)).collect()))


def test_no_letters_and_ties(spark):
    rows = [(1, "same text", "b"), (3, "same text", "a"), (5, None, "a"), (7, "12 34", "b"), (9, "", None)]
    docs = with_shared_folder(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    made = {r.doc_id: (r.lang_pred, r.score) for r in langid.languages(docs).collect()}
    assert made[5] == made[7] == made[9] == ("und", 0.0)
    assert made[1] == made[3] and made[1][0] in ("a", "b")
