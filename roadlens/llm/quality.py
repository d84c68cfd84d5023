"""Quality rules whose limits follow each language and source.

Every document gets counts that plain rules use. Documents that pass two fixed base rules feed one KLL
quantile sketch per feature, language and source. Sketches merge: map tasks build partial ones, and a
source with few documents borrows the merged sketch of its language, a rare language that of the whole
corpus. A document is rejected when a feature lies far outside the quartiles of its own group. The
documents meet their group's limits in a join; the hot groups are salted.

Defined cases: a NULL text has no words and fails the base rules, as does an empty one. NULL language
or source is a group like any other. Repeated rows are judged alike and each counts in the sketches. An
empty table gives an empty result. Other columns of the input are carried in one struct, so their
names cannot clash. Two windows of eight words count as equal when their 64-bit hashes agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.llm.expr import BLANKS, let, words
from roadlens.llm.store import written

WINDOW = 8


@dataclass(frozen=True)
class Fence:
    """A feature's limits: quartiles moved outwards by `reach` spreads of at least `least_spread`."""
    feature: str
    least_spread: float
    reach: float = 3.0
    lower: bool = False


@dataclass(frozen=True)
class Rules:
    least_words: int = 20
    most_repeated_pct: int = 30
    sketch_k: int = 4096          # rank error below 0.1 %; exact up to about as many rows
    least_group: int = 50         # smaller groups use their language's sketch, then the corpus's
    salts: int = 64
    fences: tuple[Fence, ...] = (
        Fence("symbol_share", 0.01), Fence("dup_line_share", 0.1), Fence("repeat_share", 0.1),
        Fence("word_length", 0.5, lower=True))


def _windows(hashes: str, size: str) -> Column:
    """One hash per run of eight words: pairs, pairs of pairs, and pairs of those are hashed together."""
    pair = lambda h, apart: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + apart)))
    eights = let(pair(F.col(hashes), 1), lambda twos: let(pair(twos, 2), lambda fours: pair(fours, 4)))
    return F.when(F.col(size) <= WINDOW, F.array().cast("array<bigint>")) \
        .otherwise(F.slice(eights, F.lit(1), F.col(size) - (WINDOW - 1)))


def _covered(windows: Column) -> Column:
    """Words inside a window that occurs twice or more; `windows` has one hash per start."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        twin = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))),
                                        lambda x: x["i"]))
    total = lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(WINDOW), F.get(p, i + 1) - x), F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda n, x: n + x)
    return let(let(pairs, positions), total)


def measured(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """`row` (the input row) and `counts` of each document, with the verdict of the base rules.

    The arrays are columns of their own: each is computed once, and what can be compiled is.
    """
    body = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    split = docs.select(F.struct("*").alias("row")).select(
        "row", words(body).alias("w"),
        F.filter(F.split(body, "\n", -1), lambda line: line.rlike(f"[^{BLANKS}]")).alias("lines"),
        F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    hashed = split.select(
        "row", "n_symbols", F.size("w").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("hashes"))
    windowed = hashed.withColumn("windows", _windows("hashes", "n_words")).drop("hashes")
    counts = windowed.withColumn("n_repeat_words", F.when(
        F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long"))
        .otherwise(_covered(F.col("windows")))).drop("windows")
    failed = (F.col("n_words") < rules.least_words) | \
        (100 * F.col("n_repeat_words") > rules.most_repeated_pct * F.col("n_words"))
    return counts.select("row", F.struct(
        F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        "n_repeat_words", failed.alias("base_failed")).alias("counts"))


def _features() -> dict[str, Column]:
    share = lambda part, whole: F.col(f"counts.{part}").cast("double") / F.nullif(F.col(f"counts.{whole}"), F.lit(0))
    return {"symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "word_length": share("word_chars", "n_words")}


def limits(judged: DataFrame, lang: str = "lang", source: str = "source",
           rules: Rules = Rules()) -> DataFrame:
    """One row per language and source with `low_` and `high_` of each fenced feature, written down."""
    features, names = _features(), [f.feature for f in rules.fences]
    passed = judged.filter(~F.col("counts.base_failed")).select(
        F.col(f"row.{lang}").alias("lang"), F.col(f"row.{source}").alias("source"),
        *[features[n].alias(n) for n in names])
    groups = written(passed.groupBy("lang", "source").agg(F.count("*").alias("rows"), *[
        F.kll_sketch_agg_double(n, F.lit(rules.sketch_k)).alias(n) for n in names]), "quality-sketches")
    merged = lambda prefix: [F.sum("rows").alias(f"{prefix}_rows")] + [
        F.kll_merge_agg_double(n, F.lit(rules.sketch_k)).alias(f"{prefix}_{n}") for n in names]
    langs = groups.groupBy(F.col("lang").alias("lang_key")).agg(*merged("lang"))
    corpus = groups.agg(*merged("all")).select(F.struct("*")).scalar()
    wide = groups.join(langs, F.col("lang").eqNullSafe(F.col("lang_key"))).withColumn("corpus", corpus)
    sketch = lambda n: F.when(F.col("rows") >= rules.least_group, F.col(n)).when(
        F.col("lang_rows") >= rules.least_group, F.col(f"lang_{n}")).otherwise(F.col(f"corpus.all_{n}"))
    quartiles = wide.select("lang", "source", *[
        F.kll_sketch_get_quantile_double(sketch(n), F.lit(q)).alias(f"{name}_{n}")
        for n in names for name, q in (("q1", 0.25), ("q3", 0.75))])
    ends = []
    for fence in rules.fences:
        low, high = F.col(f"q1_{fence.feature}"), F.col(f"q3_{fence.feature}")
        spread = F.greatest(high - low, F.lit(fence.least_spread)) * F.lit(fence.reach)
        ends += [(low - spread if fence.lower else F.lit(None).cast("double")).alias(f"low_{fence.feature}"),
                 (high + spread).alias(f"high_{fence.feature}")]
    return written(quartiles.select("lang", "source", *ends), "quality-limits")


def judge(judged: DataFrame, fences: DataFrame, lang: str = "lang", source: str = "source",
          rules: Rules = Rules()) -> DataFrame:
    """`row`, `counts` and `kept`: the base rules and every fence of the document's group hold."""
    features = _features()
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(rules.salts)).cast("int")
    spread = fences.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(rules.salts - 1)))).alias("f")
    left = judged.withColumn("salt", salt).alias("d")
    same = (F.col("d.salt") == F.col("f.salt")) & F.col(f"d.row.{lang}").eqNullSafe(F.col("f.lang")) & \
        F.col(f"d.row.{source}").eqNullSafe(F.col("f.source"))
    inside = F.lit(True)
    for fence in rules.fences:
        value = features[fence.feature]
        inside = inside & F.coalesce(value <= F.col(f"f.high_{fence.feature}"), F.lit(True)) & \
            F.coalesce(value >= F.col(f"f.low_{fence.feature}"), F.lit(True))
    return left.join(spread, same, "left").select(
        "row", "counts", (~F.col("counts.base_failed") & inside).alias("kept"))


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Every document's counts and verdict, one row each; counts are written once and read twice."""
    narrow = measured(docs, rules=rules).select(
        F.struct("row.doc_id", "row.lang", "row.source").alias("row"), "counts")
    kept = written(narrow, "quality-counts")
    return judge(kept, limits(kept, rules=rules), rules=rules)


def good_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, with all their columns. Counts are written beside the rows and read twice."""
    judged = written(measured(docs, rules=rules), "quality-measured")
    return judge(judged, limits(judged, rules=rules), rules=rules).filter("kept").select("row.*")
