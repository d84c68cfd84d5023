"""Toxicity by a subsequence string kernel, a support vector machine and Nyström landmarks.

Strings are compared by the gap-weighted subsequence kernel of length 3: every three characters in order, at most
`SPAN` apart, count, weighted by `DECAY` per character skipped; the kernel is divided by the norms of both
strings. An insult with a gap or an inserted character keeps most of its subsequences.

The compared strings are the short units of a sentence: its words without surrounding punctuation and with a mark at their start, cut
into overlapping windows where longer than 10 characters; two neighbouring words of at most 10 characters together with the blank
between them, because an insult may be torn in two; and runs of single characters read as one word. A sentence is as toxic as its most toxic unit, a document as its most toxic sentence, so one
sentence decides in a text of any length.

Training reads a bounded sample of labelled rows (`sample_rows`). Every sentence carries its document's
label, which is wrong for most sentences of a toxic document. So units of toxic documents are called as
witnesses (multiple-instance learning): those with a run of 4 or 5 characters that far more toxic than clean
documents hold, unless clean documents hold the unit itself. Near copies among the toxic documents count once there, by a MinHash of
their units, or they would call all their words. Witnesses are positive, and so are their spellings with a gap, an inserted or
doubled character or marks between all letters, cut into units like any text; units of clean documents are negative.
Landmarks are drawn from all three. A squared-hinge support vector machine is trained on the Nyström features; then the clean
units that it takes for insults join the negatives, or weigh more, and it is trained again, `mining_rounds` times. A logistic
curve on the sample's document margins turns margins into scores.

The decision is linear in the subsequences, so a new unit is scored by adding one number per
subsequence, and a worker remembers units it has scored.

Defined cases: NULL, blank text and text of punctuation only have no unit and get the lowest score, 0. Without a toxic or without a
clean label every score is 0. Repeated rows and
labels count as often as they occur; NULL labels and ids are not used in training. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.llm.landmarks import logistic_line, squared_hinge_svm, whitening
from roadlens.llm.memory import Known

SPAN = 5
DECAY = 0.7
LONGEST, STRIDE = 10, 5
TORN = 10                    # letters of two neighbouring words that may be one
RUNS = (4, 5)                # lengths of the character runs that find witnesses
CLASSES = 64
MOST_WORDS, MOST_PAIRS = 250_000, 150_000      # that a worker remembers; pairs of words are mostly new
START = "^"                  # marks the beginning of a word: many insults are a stem and any ending
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SHAPES = [(a, b, DECAY ** (b - 2)) for b in range(2, SPAN) for a in range(1, b)]


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 2500
    negatives: int = 6000
    witnesses: int = 400
    spellings: int = 96          # training strings of each of the `spelt_in_full` witnesses of most documents, an eighth of it of the others
    spelt_in_full: int = 40
    landmarks: int = 512
    cost: float = 10.0           # mean cost of a positive string
    mining_rounds: int = 4
    mined: int = 2000            # clean units that join the negatives in each round
    mined_from: float = -0.5     # their least margin
    mined_weight: float = 3.0    # by which one weighs more in each round that it sounds like an insult
    variant_cost: float = 6.0    # of all spellings of a witness together, over the cost of the witness
    negative_cost: float = 5.0   # total cost of the negatives over that of the positives
    least_favour: float = 5.0    # toxic documents per clean one (by rate, plus one) that make a run a witness's
    threshold: float = 0.7


@dataclass(frozen=True)
class ToxicModel:
    gram_weights: np.ndarray     # one number per three character classes
    bias: float
    slope: float
    intercept: float


def char_class(points: np.ndarray) -> np.ndarray:
    """Letters a to z and digits have classes of their own; others share by remainder. 0 is no character."""
    points = points.astype("int64")
    letter, digit = (points >= 97) & (points <= 122), (points >= 48) & (points <= 57)
    other = np.where(points < 128, 37 + points % 7, 44 + points % 20)
    return np.where(letter, points - 96, np.where(digit, points - 21, other))


def units_of(word: str) -> list[str]:
    """The compared strings of one lower-cased word."""
    core = _EDGE.sub("", word)
    core = START + core if core else core
    if len(core) <= LONGEST:
        return [core]
    return [core[i:i + LONGEST] for i in range(0, len(core) - STRIDE, STRIDE)]


def pairs_of(words: list[str]) -> list[str]:
    """Neighbouring words that are short enough to be halves of one, with the blank between them."""
    return [f"{a} {b}" for a, b in zip(words, words[1:]) if len(a) + len(b) <= TORN and a.isalpha() and b[0].isalpha()]


def words_of(text: str) -> list[str]:
    """Lower-cased words; runs of three and more single characters are one."""
    words = text.lower().split()
    if sum(map(len, words)) < 2 * len(words) or re.search(r"(?:^|\s)\S\s\S\s\S(?:\s|$)", text):
        joined = []
        for single, run in groupby(words, lambda w: len(w) == 1):
            run = list(run)
            joined += ["".join(run)] if single and len(run) > 2 else run
        return joined
    return words


def subsequences(strings: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions in `strings`, grams, weights) for each length of string; grams is one row per string."""
    lengths = np.fromiter(map(len, strings), "int64", len(strings))
    out = []
    for n in np.unique(lengths[lengths >= 3]):
        which = np.flatnonzero(lengths == n)
        codes = char_class(np.frombuffer("".join([strings[i] for i in which]).encode("utf-32-le", "surrogatepass"), "<u4")).reshape(-1, n)
        shapes = [(a, b, w) for a, b, w in _SHAPES if b < n]
        grams = np.concatenate([(codes[:, :n - b] * CLASSES + codes[:, a:n - b + a]) * CLASSES + codes[:, b:]
                                for a, b, _ in shapes], axis=1)
        out.append((which, grams, np.concatenate([np.full(n - b, w) for _, b, w in shapes])))
    return out


def norms(grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Root of each string's kernel with itself; equal subsequences add up before squaring."""
    order = np.argsort(grams, axis=1, kind="stable")
    ranked, w = np.take_along_axis(grams, order, 1), weights[order]
    change = np.concatenate([np.ones((len(ranked), 1), bool), ranked[:, 1:] != ranked[:, :-1]], axis=1)
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(change.ravel()))
    rows = np.nonzero(change)[0]
    return np.sqrt(np.bincount(rows, weights=sums ** 2, minlength=len(ranked)))


def embed(strings: list[str], columns: np.ndarray, width: int) -> np.ndarray:
    """Normalised subsequence vectors over the grams that have a column."""
    out = np.zeros((len(strings), width))
    for which, grams, weights in subsequences(strings):
        at = columns[grams]
        rows = np.repeat(which, grams.shape[1]).reshape(grams.shape)
        kept = at >= 0
        np.add.at(out, (rows[kept], at[kept]), np.broadcast_to(weights, grams.shape)[kept])
        out[which] /= norms(grams, weights)[:, None]
    return out


def variants(word: str) -> list[str]:
    """Units of a word's spellings with a gap, one inserted or doubled character, or marks between all letters.

    `word` is a unit, so what follows its start mark is spelt anew and then cut as any word is. An inserted letter is one of a
    few that stand for all: the kernel sees the others as just as far away.
    """
    core = word[1:] if word.startswith(START) else word
    spelt = [mark.join(core) for mark in (".", "-", "*", "_")]
    for i in range(1, len(core)):
        spelt += [core[:i] + mark + core[i:] for mark in (" ", ".", "-", "--", "*", "x", "e", "o", "7", "n", core[i])]
    return sorted({u for v in spelt for u in units_of(v) if len(u) > 4} - {word})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _units_udf():
    """The distinct units of each text, and its distinct runs, each with the first unit that holds it."""
    @F.pandas_udf("units array<string>, runs array<struct<run: string, unit: string>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text or "")
                units = sorted({u for w in {*words, *pairs_of(words)} for u in units_of(w) if len(u) >= 3})
                runs: dict[str, str] = {}
                for u in units:
                    if " " in u:
                        continue                             # the halves call for themselves
                    for n in RUNS:
                        for i in range(len(u) - n + 1):
                            runs.setdefault(u[i:i + n], u)
                rows.append((units, [{"run": r, "unit": u} for r, u in runs.items()]))
            yield pd.DataFrame(rows, columns=["units", "runs"])
    return of


def _sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, text and toxic of about `sample_rows` labelled rows, half of each label where there are enough."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("toxic") == 1, F.lit(settings.sample_rows / 2 / max(counts.get(1, 1), 1))) \
        .otherwise(F.lit(settings.sample_rows / 2 / max(counts.get(0, 1), 1)))
    drawn = known.filter(draw < share).limit(2 * settings.sample_rows).collect()
    picked = docs.sparkSession.createDataFrame(drawn, known.schema)
    # The hint is safe: `picked` has at most twice `sample_rows` rows of an id and a label.
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter(F.col("text").isNotNull())


class Features:
    """Kernels of strings with a fixed set of strings, a bounded number of strings at a time."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        self.grams = np.unique(np.concatenate([g.ravel() for _, g, _ in subsequences(strings)]))
        self.columns = np.full(CLASSES ** 3, -1, "int64")
        self.columns[self.grams] = np.arange(len(self.grams))
        self.base = embed(strings, self.columns, len(self.grams))

    def kernels(self, strings: list[str], at_once: int = 512) -> np.ndarray:
        """One row per string, one column per string of the set."""
        parts = [embed(strings[i:i + at_once], self.columns, len(self.grams)) @ self.base.T for i in range(0, len(strings), at_once)]
        return np.vstack(parts) if parts else np.zeros((0, len(self.strings)))


def _spread(strings: list[str], n: int) -> list[str]:
    """`n` of the strings, evenly over their order, or all of them."""
    n = min(n, len(strings))
    return [strings[i * len(strings) // n] for i in range(n)]


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> ToxicModel | None:
    from roadlens.llm.store import written
    signature = F.array_min(F.transform("found.units", lambda u: F.xxhash64(u)))
    sample = written(_sample(docs, labels, settings).select("toxic", "text", _units_udf()(F.col("text")).alias("found"))
                     .select("toxic", "text", "found.*", signature.alias("signature")).withColumn("doc", F.monotonically_increasing_id()),
                     "toxicity-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    runs = sample.select("doc", "toxic", "signature", F.inline("runs"))
    expected = F.col("neg") * (sizes[1] / sizes[0])
    called = runs.groupBy("run").agg(F.countDistinct(F.when(F.col("toxic") == 1, F.col("signature"))).alias("pos"),
                                     F.sum(1 - F.col("toxic")).alias("neg")) \
        .filter((F.col("pos") >= settings.least_favour * (1 + expected))
                & (F.col("pos") - expected >= settings.least_favour * F.sqrt(1 + expected)))
    clean = written(sample.filter("toxic = 0").select(F.explode("units").alias("unit")).groupBy("unit")
                    .agg(F.count("*").alias("neg")), "toxicity-clean-units")
    # A unit that clean documents hold too is none, whatever runs it shares with one; a few wrong labels do no harm.
    witnesses = runs.filter("toxic = 1").join(called, "run").groupBy("unit").agg(F.countDistinct("doc").alias("docs")) \
        .join(clean, "unit", "left").filter(F.col("docs") >= settings.least_favour * F.coalesce("neg", F.lit(0))) \
        .orderBy(F.col("docs").desc(), "unit").limit(settings.witnesses).collect()
    positives = {r["unit"]: r["docs"] for r in witnesses}
    half = settings.negatives // 2
    negatives = {r["unit"]: r["neg"] for part in (
        clean.orderBy(F.col("neg").desc(), "unit").limit(half),
        clean.orderBy(F.xxhash64("unit"), "unit").limit(half)) for r in part.collect() if r["unit"] not in positives}
    if not positives or not negatives:
        return None

    by_docs = sorted(positives, key=lambda w: (-positives[w], w))
    spellings = {w: _spread(variants(w), settings.spellings if i < settings.spelt_in_full else settings.spellings // 8)
                 for i, w in enumerate(by_docs)}
    # Landmarks: a quarter witnesses, half spellings of them, shared out by their documents, and the rest negatives, the most
    # frequent ones and those most like a witness.
    quarter = settings.landmarks // 4
    leading = by_docs[:quarter]
    heard = sum(positives[w] for w in leading)
    spelt = [v for w in leading for v in _spread(spellings[w], round(2 * quarter * positives[w] / heard))]
    like = dict(zip(negatives, Features(leading).kernels(list(negatives)).max(1).tolist()))
    often = sorted(negatives, key=lambda w: (-negatives[w], w))[:quarter // 2]
    close = sorted(set(negatives) - set(often), key=lambda w: (-like[w], w))[:settings.landmarks - len(leading) - len(spelt) - len(often)]
    known = Features([*dict.fromkeys([*leading, *spelt, *often, *close])])
    white = whitening(known.kernels(known.strings))

    heard_as = [(u, positives[w] if u == w else settings.variant_cost * positives[w] / len(spellings[w]))
                for w in by_docs for u in (w, *spellings[w])]
    total = settings.cost * len(heard_as)
    costs = np.array([c for _, c in heard_as])
    costs *= total / costs.sum()
    positive_rows = known.kernels([u for u, _ in heard_as]) @ white
    negative_rows, weighed = known.kernels(list(negatives)) @ white, np.sqrt(list(negatives.values()))
    for turn in range(settings.mining_rounds + 1):
        weights, bias = squared_hinge_svm(
            np.vstack([positive_rows, negative_rows]), np.repeat([1.0, -1.0], [len(positive_rows), len(negative_rows)]),
            np.concatenate([costs, settings.negative_cost * total * weighed / weighed.sum()]))
        by_gram = np.zeros(CLASSES ** 3)
        by_gram[known.grams] = known.base.T @ (white @ weights)
        if turn == settings.mining_rounds:
            break
        # Clean units that still sound like an insult join the negatives; those that are negatives already weigh more.
        margin = unit_margins(ToxicModel(by_gram, bias, 1.0, 0.0))
        wrong = clean.select("unit", "neg", margin(F.col("unit")).alias("m")).filter(F.col("m") > settings.mined_from) \
            .orderBy(F.desc("m"), "unit").limit(settings.mined).collect()
        if not wrong:
            break
        place = {u: i for i, u in enumerate(negatives)}
        for r in wrong:
            if r["unit"] in place:
                weighed[place[r["unit"]]] *= settings.mined_weight
        fresh = {r["unit"]: r["neg"] for r in wrong if r["unit"] not in negatives and r["unit"] not in positives}
        negatives |= fresh
        if fresh:
            negative_rows = np.vstack([negative_rows, known.kernels(list(fresh)) @ white])
            weighed = np.concatenate([weighed, settings.mined_weight * np.sqrt(list(fresh.values()))])
    model = ToxicModel(by_gram, bias, 1.0, 0.0)
    seen = sample.select("toxic", margins(model)(F.col("text")).alias("m")).toPandas()
    seen = seen[np.isfinite(seen["m"])]
    slope, intercept = logistic_line(seen["m"].to_numpy(), seen["toxic"].to_numpy())
    return ToxicModel(by_gram, bias, slope, intercept)


class Heard:
    """Margins of strings by their number, for as long as there are not too many; then all are forgotten."""

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.strings: list[str] = []
        self.known, self.margin = Known(self.strings, ""), np.zeros(0)

    def numbers(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, strings), "int64", len(strings))

    def learn(self, score) -> None:
        """The margin of each new string is that of its highest unit."""
        units = [units_of(w) for w in self.strings[len(self.margin):]]
        if units:
            sizes = np.fromiter(map(len, units), "int64", len(units))
            flat = score([u for part in units for u in part])
            self.margin = np.concatenate([self.margin, np.maximum.reduceat(flat, np.cumsum(sizes) - sizes)])


class Scorer:
    """Margins of documents; remembers the margins of words and pairs of words.

    The margin of a unit is the bias plus its kernel sum, where that is positive: what speaks against an insult in one unit
    is silence, as a document is judged by its highest unit. So norms are needed for units with a positive sum only.
    """

    def __init__(self, model: ToxicModel):
        self.model = model
        self.words, self.pairs = Heard(MOST_WORDS), Heard(MOST_PAIRS)

    def unit_margins(self, units: list[str]) -> np.ndarray:
        out = np.where(np.fromiter(map(len, units), "int64", len(units)) > 0, self.model.bias, -np.inf)
        for which, grams, weights in subsequences(units):
            sums = self.model.gram_weights[grams] @ weights
            some = np.flatnonzero(sums > 0)
            if len(some):
                out[which[some]] += sums[some] / norms(grams[some], weights)
        return out

    def margins(self, texts: list[str]) -> np.ndarray:
        """The largest margin of each text's units, minus infinity without any."""
        numbers = []
        for heard in (self.words, self.pairs):
            if len(heard.strings) > heard.most:
                heard.forget()
        for text in texts:
            words = words_of(text)
            numbers.append((self.words.numbers(words), self.pairs.numbers(pairs_of(words))))
        for heard in (self.words, self.pairs):
            heard.learn(self.unit_margins)
        highest = lambda margin, found: margin[found].max() if len(found) else -np.inf
        return np.array([max(highest(self.words.margin, w), highest(self.pairs.margin, p)) for w, p in numbers])


def unit_margins(model: ToxicModel):
    """A Pandas UDF from unit to its margin."""
    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for units in batches:
            yield pd.Series(scorer.unit_margins(units.to_list()))
    return of


def margins(model: ToxicModel):
    """A Pandas UDF from text to the document's margin."""
    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            parts = [scorer.margins([t or "" for t in texts[at:at + 128]]) for at in range(0, len(texts), 128)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))
    return of


def toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels, settings)
    ids = [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")]
    if model is None:
        scored = docs.select(*ids, F.lit(0.0).alias("score"))
    else:
        scored = docs.select(*ids, margins(model)(F.col("text")).alias("m")).select(
            "doc_id", "held_out", F.when(F.col("m").isNull() | (F.col("m") == float("-inf")), F.lit(0.0)).otherwise(
                1 / (1 + F.exp(-(F.col("m") * model.slope + model.intercept)))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= settings.threshold).cast("int"))
