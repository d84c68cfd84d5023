"""Language identification by a string kernel.

The kernel of two texts counts the character n-grams of length 1 to 3 that both hold (a blended spectrum, presence
only), divided by the root of the product of their own counts. Characters are lower-cased letters and the marks
that follow them, every one of Unicode by its own code point; anything else is a word border. A letter also counts as a
letter of its block of 128 code points, so scripts of thousands of letters are told apart by letters that the sample never
showed. A bounded sample of labelled rows gives landmarks; Nyström features of the sample train one kernel ridge
regression per language. Kernel, whitening and regression are linear in the presence vector, so a batch of
documents is scored by one matrix product: presence (sparse) times a matrix with a row per landmark n-gram and a
column per language.

Whole texts are read. An n-gram is one 64-bit number, three code points of 21 bits, so nothing is hashed or shared.

Parameters that bound the fit: at most `rows` labelled rows, `rows_per_lang` of a language and at least one of each; at most `most_langs`
languages (the most frequent; beyond, a language would have no landmark of its own); `landmarks` texts, or two of each
language if that is more, of at most `landmark_grams` n-grams each. Landmarks' n-grams and, of every sampled row,
one number per landmark come to the driver. Rows are drawn by a hash of their id, so a fit repeats.

Defined cases: NULL text, and text without a letter, is `und` with score 0. With no labelled row every
text is `und`. Equal margins go to the language first in the alphabet. Repeated rows count as often as
they occur. NULL ids are used like any other and never held out. Extra columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm.landmarks import ridge, whitening
from roadlens.llm.store import written

BITS = 21                        # of a code point, plus one
BLOCK_BITS = 7
BLOCK = np.int64(1) << 62        # marks the number of a block of letters
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    rows: int = 32_000
    rows_per_lang: int = 500
    most_langs: int = 1024
    landmarks: int = 256
    landmark_grams: int = 65_536
    ridge: float = 1e-4
    batch: int = 128


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    grams: np.ndarray            # the landmarks' n-grams, ascending
    weights: np.ndarray          # n-grams by languages
    bias: np.ndarray
    sharpness: float


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each code point: 1 for a letter, 2 for a mark, else 0."""
    first = np.fromiter((ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)), "uint8", 0x110000)
    return (first == ord("L")) * np.uint8(1) + (first == ord("M")) * np.uint8(2)


def grams_of(text: str) -> np.ndarray:
    """The distinct n-grams of the text, ascending; none when it has no letter.

    Codes are code points plus one, a border is 1, and shorter n-grams have zeros in front: no two share a number.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype("int64")
    kinds = _kinds()[points]
    letters = kinds == 1
    if not letters.any():
        return np.zeros(0, "int64")
    codes = np.ones(len(points) + 2, "int64")
    codes[1:-1] = np.where(kinds > 0, points + 1, 1)
    codes = codes[np.concatenate([[True], (codes[1:] != 1) | (codes[:-1] != 1)])]
    pairs = codes[:-1] << BITS | codes[1:]
    blocks = np.unique(points[letters] >> BLOCK_BITS) | BLOCK
    return np.unique(np.concatenate([codes, pairs, pairs[:-1] << BITS | codes[2:], blocks]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, settings: Settings) -> DataFrame:
    """lang, place (1, 2, ... within the language) and text of the drawn rows, written down."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(settings.most_langs).collect()
    each = max(1, min(settings.rows_per_lang, settings.rows // max(len(counts), 1)))
    # Drawn with some to spare, then cut to `each` in the order of the draw: a bounded window per language.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (2.0 * each + 20) / r["count"]))]) \
        if counts else F.create_map(F.lit(""), F.lit(0.0))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = labelled.select("text", "lang", draw.alias("draw")) \
        .filter(F.col("draw") < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"), "text"))
    return written(drawn.select("lang", place.alias("place"), "text").filter(F.col("place") <= each), "language-sample")


class Presence:
    """Rows of presence over a fixed set of n-grams, each divided by the root of the text's own count."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams

    def rows(self, found: np.ndarray) -> np.ndarray:
        """The places of the found n-grams that the set holds."""
        at = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
        return at[self.grams[at] == found]

    def times(self, lists: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
        """Presence rows of several texts times a matrix with a row per n-gram."""
        out = np.zeros((len(lists), matrix.shape[1]), matrix.dtype)
        places = [self.rows(found) for found in lists]
        filled = [i for i, p in enumerate(places) if len(p)]
        if filled:
            sizes = np.array([len(places[i]) for i in filled])
            sums = np.add.reduceat(matrix[np.concatenate([places[i] for i in filled])], np.cumsum(sizes) - sizes, axis=0)
            out[filled] = sums / np.sqrt([len(lists[i]) for i in filled])[:, None]
        return out


def fit(docs: DataFrame, settings: Settings = Settings()) -> LanguageModel | None:
    """Fit on a bounded sample of the labelled rows that are not held out; None without any."""
    sample = _sample(docs, settings)
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not langs:
        return None
    each = max(2, settings.landmarks // len(langs))

    def landmark_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = rows["text"].map(grams_of)
            fits = found.map(len).between(1, settings.landmark_grams)
            yield pd.DataFrame({"lang": rows["lang"][fits], "place": rows["place"][fits], "grams": found[fits]})
    chosen = sample.filter(F.col("place") <= 2 * each).mapInPandas(landmark_grams, "lang string, place int, grams array<long>") \
        .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).filter(F.col("n") <= each) \
        .orderBy("lang", "place").select("grams").toPandas()["grams"].map(lambda g: np.asarray(g, "int64")).to_list()
    if not chosen:
        return None
    grams = np.unique(np.concatenate(chosen))
    presence = Presence(grams)

    def landmark_matrix() -> np.ndarray:
        """A column per landmark: its presence over the root of its count."""
        out = np.zeros((len(grams), len(chosen)), "float32")
        for i, found in enumerate(chosen):
            out[np.searchsorted(grams, found), i] = 1 / np.sqrt(len(found))
        return out

    def kernels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = landmark_matrix()
        for rows in batches:
            for at in range(0, len(rows), settings.batch):
                part = rows.iloc[at:at + settings.batch]
                found = [grams_of(t) for t in part["text"]]
                values = presence.times(found, columns)
                some = np.array([len(f) > 0 for f in found])
                yield pd.DataFrame({"lang": part["lang"][some], "place": part["place"][some], "kernels": list(values[some])})
    rows = sample.mapInPandas(kernels, "lang string, place int, kernels array<float>").orderBy("lang", "place").toPandas()
    columns = landmark_matrix()
    white = whitening((columns.T @ columns).astype("float64"))
    features = np.stack(rows["kernels"].to_list()).astype("float64") @ white
    targets = np.where(rows["lang"].to_numpy()[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    weights, bias = ridge(features, targets, settings.ridge)
    margins = features @ weights + bias
    grid = 2.0 ** np.arange(-2, 6)
    loss = [np.mean(np.log(_softmax(margins * s)[targets > 0] + 1e-12)) for s in grid]
    return LanguageModel(langs, grams, (columns @ (white @ weights)).astype("float32"), bias, float(grid[int(np.argmax(loss))]))


def _softmax(margins: np.ndarray) -> np.ndarray:
    raised = np.exp(margins - margins.max(1, keepdims=True))
    return raised / raised.sum(1, keepdims=True)


def shares(model: LanguageModel, found: list[np.ndarray]) -> np.ndarray:
    """The languages' shares of each text, given by its n-grams."""
    return _softmax((Presence(model.grams).times(found, model.weights) + model.bias) * model.sharpness)


def predictor(model: LanguageModel | None, settings: Settings = Settings()):
    """A Pandas UDF from text to struct<lang_pred, score>."""
    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for at in range(0, len(texts) if model else 0, settings.batch):
                found = [grams_of(t) if t else np.zeros(0, "int64") for t in texts[at:at + settings.batch]]
                share = shares(model, found)
                best = share.argmax(1)
                known = np.array([len(g) > 0 for g in found])
                names[at:at + len(found)] = np.where(known, np.array(model.langs, object)[best], UNKNOWN)
                scores[at:at + len(found)] = np.where(known, share[np.arange(len(found)), best], 0.0)
            yield pd.DataFrame({"lang_pred": names, "score": scores})
    return of


def languages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    of = predictor(fit(docs, settings), settings)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), of(F.col("text")).alias("p")) \
        .select("doc_id", "held_out", "p.lang_pred", "p.score")


def known_language(docs: DataFrame, least_score: float = 0.4, settings: Settings = Settings()) -> DataFrame:
    """The documents, with all their columns, whose language is recognised with at least that score."""
    of = predictor(fit(docs, settings), settings)
    judged = docs.select(F.struct("*").alias("row")).select("row", of(F.col("row.text")).alias("p"))
    return judged.filter((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= least_score)).select("row.*")
