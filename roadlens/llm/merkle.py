"""Document fingerprints: a Merkle tree over sections, paragraphs and blocks.

A paragraph is a line. Its leaves are its blocks of up to 32 code points, counted from its own start,
so an edit moves no leaf outside its paragraph. A paragraph whose digest starts with 0 to 3 closes a
section: sections end where the content says so, and an inserted paragraph changes one of them. Every
node is the MD5 of its children's digests; the root covers the whole text, so equal texts have equal
roots and different texts different ones.

The fingerprint is one string: root, a colon, and the short leaf digests (6 hex digits), paragraphs ended by a
comma, or by a semicolon where a section closes. Two fingerprints can be compared without the texts:
`likeness` is the Dice share of common leaf digests, `differing` lists the sections of one that the
other does not hold, `edited_range` says how many these are and between which sections they lie.

Defined cases: NULL is the empty text, which has one empty paragraph and no leaf; equal fingerprints
have likeness 1, and of two unequal ones without common leaves it is 0. Repeated rows are fingerprinted
alike. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm.expr import let

BLOCK = 32
SHORT = 6


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def tree(text: Column, block: int = BLOCK) -> Column:
    """array<struct<leaves, digest, closes>>: the paragraphs with their leaf digests."""
    leaves = lambda paragraph: F.transform(
        F.regexp_extract_all(paragraph, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), lambda b: F.md5(b))
    node = lambda found: let(F.md5(_joined(found)), lambda digest: F.struct(
        found.alias("leaves"), digest.alias("digest"), (F.substr(digest, F.lit(1), F.lit(1)) < "4").alias("closes")))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: let(leaves(p), node))


def fingerprint(text: Column, block: int = BLOCK) -> Column:
    ended = lambda p, body: F.concat(body, F.when(p["closes"], F.lit(";")).otherwise(F.lit(",")))

    def written(paragraphs: Column) -> Column:
        sections = F.split(_joined(F.transform(paragraphs, lambda p: ended(p, p["digest"]))), ";", -1)
        root = F.md5(_joined(F.transform(sections, lambda s: F.md5(s))))
        short = _joined(F.transform(paragraphs, lambda p: ended(p, _joined(
            F.transform(p["leaves"], lambda d: F.substr(d, F.lit(1), F.lit(SHORT)))))))
        return F.concat(root, F.lit(":"), short)
    return let(tree(text, block), written)


def leaf_set(fp: Column) -> Column:
    """The distinct short leaf digests of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(F.substring_index(fp, ":", -1), F.lit(f"[0-9a-f]{{{SHORT}}}"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """Twice the common leaves over the leaves of both fingerprints; 1 for equal fingerprints."""
    def dice(x: Column, y: Column) -> Column:
        total = F.size(x) + F.size(y)
        return F.when(total == 0, F.lit(0.0)).otherwise(
            F.lit(2.0) * F.size(F.array_intersect(x, y)) / F.greatest(total, F.lit(1)))
    return F.when(a == b, F.lit(1.0)).otherwise(
        let(leaf_set(a), lambda x: let(leaf_set(b), lambda y: dice(x, y))))


def sections(fp: Column) -> Column:
    """The sections of a fingerprint, each by the short digests of its leaves."""
    return F.split(F.substring_index(fp, ":", -1), ";", -1)


def differing(a: Column, b: Column) -> Column:
    """1-based numbers of the sections of `a` that `b` does not hold: where the edits are."""
    return let(sections(a), lambda own: let(F.array_except(own, sections(b)), lambda missing: F.filter(
        F.transform(own, lambda s, i: F.when(F.array_contains(missing, s), i + 1).otherwise(0)), lambda i: i > 0)))


def edited_range(a: Column, b: Column) -> Column:
    """struct<edited_sections, first_edited, last_edited>: how many different sections of `a` are not in `b`, and between which.

    Found by set difference and search, in steps that follow the length of the text even when every section differs.
    """
    return let(sections(a), lambda own: let(F.array_except(own, sections(b)), lambda missing: F.struct(
        F.size(missing).cast("long").alias("edited_sections"),
        F.array_position(own, F.get(missing, F.lit(0))).alias("first_edited"),
        F.array_position(own, F.get(missing, F.size(missing) - 1)).alias("last_edited"))))


def _bucket(bounds: list) -> Column:
    """How many of the ascending `bounds` the id exceeds; a NULL id is below all of them."""
    if not bounds:
        return F.lit(0)
    step = 64                                   # two short scans instead of one long one
    blocks = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    whole = F.size(F.filter(F.array(*[F.lit(b[-1]) for b in blocks]), lambda b: b < F.col("doc_id")))
    rest = F.get(F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks]), whole)
    inside = F.coalesce(F.size(F.filter(rest, lambda b: b < F.col("doc_id"))), F.lit(0))
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(
        F.least(whole * step, F.lit(len(bounds))) + F.when(whole < len(blocks), inside).otherwise(F.lit(0)))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text, fingerprint and those of the next document by descending id; the last one's next is the first.

    The order is id (NULL last), then text. Ranges of ids, cut at approximate quantiles, are the unit of
    work: the texts are shuffled once, to their range. The first document of each range is copied to the range before,
    where it is the next one of the last document. Bounds are as many numbers as there are shuffle
    partitions. Rows that share one id stay in one range and are sorted with spilling.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cut = ids.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]
    bounds = sorted(set(cut or []))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = texts.select("doc_id", "text", _bucket(bounds).alias("bucket"), F.lit(0).alias("visitor"))

    # One row per range that has rows: its first document goes to the range before, the first range's to the last.
    heads = ids.select("doc_id", _bucket(bounds).alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("head"))
    found = sorted(heads.collect(), key=lambda r: -r["bucket"])
    targets = spark.createDataFrame([(r["head"], found[i - 1]["bucket"]) for i, r in enumerate(found)], "head long, to int")
    # The hint is safe: there is at most one target row per range, and as many ranges as `buckets`.
    visitors = texts.join(F.broadcast(targets), F.col("doc_id").eqNullSafe(F.col("head"))) \
        .select("doc_id", "text", F.col("to").alias("bucket"), F.lit(1).alias("visitor"))

    there = own.unionByName(visitors).repartition("bucket").select("*", fingerprint(F.col("text")).alias("fingerprint"))
    inside = Window.partitionBy("bucket").orderBy("visitor", F.col("doc_id").desc_nulls_last(), "text")
    return there.select("doc_id", "text", "fingerprint", "visitor",
                        F.lead(F.struct("text", "fingerprint")).over(inside).alias("next")) \
        .filter("visitor = 0").drop("visitor")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as many code points of `following`, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited form, their likenesses, and the sections that the edit changed."""
    paired = with_next(docs).select("doc_id", "text", "fingerprint", F.col("next.fingerprint").alias("next_fp"),
                                    edited(F.col("text"), F.col("next.text")).alias("edited"))
    printed = paired.select("*", fingerprint(F.col("edited")).alias("edited_fingerprint"))
    located = printed.withColumn("at", edited_range(F.col("fingerprint"), F.col("edited_fingerprint")))
    return located.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"), "at.*")
