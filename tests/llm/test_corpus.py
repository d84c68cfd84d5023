"""The corpus operators against the libraries they must equal, DuckDB, brute force and held-out labels."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from roadlens.llm import chat, langid, licenses, merkle, packing, quality, sentencepiece_bpe, simhash, toxicity, training_order
from roadlens.llm.queries import QUERIES, with_shared_folder
from roadlens.llm.sql import SQL
from workload.check import differences, oracle_rows

SF, BIGGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "▁a  b\n\tc", "naïve ﬁ Ⅷ 한국어 漢字 🙂🙂", "a" * 3000, "<s> </s> <unk>", "\u0000x�", "the " * 500]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, counts string, kept string"


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns whose names the operators use too."""
    rows = [(i, t, "en", "web", len(t), "x", "y") for i, t in enumerate(ODD)]
    rows += [(50, None, None, None, None, None, None), (None, "some words here", "en", None, 1, "x", "y")]
    return spark.createDataFrame(rows + rows[:2], SCHEMA)


def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    frame = QUERIES[name](spark, SF)
    rows = [tuple(row) for row in frame.collect()]
    names, _, expected = oracle_rows(SF, SQL[name])
    assert differences(frame.columns, rows, names, expected) is None


def test_pieces_equal_the_library(spark):
    import sentencepiece
    known = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    given = list(texts(spark, SF).items()) + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, None)]
    made = {r.doc_id: r for r in sentencepiece_bpe.encoded(spark.createDataFrame(given, "doc_id long, text string"), PIECES).collect()}
    assert len(made) == len(given)
    for doc, text in given:
        ids = known.encode(text or "", add_bos=True, add_eos=True)
        assert made[doc].n_tokens == len(ids), doc
        assert made[doc].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), doc
        assert made[doc].decoded_sha256 == hashlib.sha256(known.decode(ids).encode()).hexdigest(), doc


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation_is_one_to_one(n):
    slots = training_order.permute(np.arange(n), n, key=5)
    assert sorted(slots.tolist()) == list(range(n))
    assert (training_order.permute(slots, n, key=5, inverse=True) == np.arange(n)).all()


def fingerprint(text, shingle=3):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
    if not words:
        return 0
    parts = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, distance=2):
    docs, root = sorted(prints), {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for i, a in enumerate(docs):
        for b in docs[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: find(d) for d in docs}


def test_simhash_components_by_brute_force(spark):
    given = {d: t or "" for d, t in texts(spark, BIGGER).items()}
    given = dict(sorted(given.items())[:600])
    docs = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    with_shared_folder(spark)
    prints = {d: fingerprint(t) for d, t in given.items()}
    groups = linked(prints)
    made = simhash.near_duplicates(docs, shingle=3, distance=2).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in made} == {d: (f"{prints[d]:016x}", groups[d]) for d in given}


def test_similar_pairs_lose_none(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-2**62, 2**62, 40)
    values = {int(v) for v in base}
    for v in base.tolist():
        for bits in (1, 2, 3):
            for bit in rng.choice(63, bits, replace=False).tolist():
                v ^= 1 << bit
            values.add(v)
    made = simhash.similar_pairs(spark.createDataFrame([(v,) for v in values], "fp long"), distance=2).collect()
    ordered, mask = sorted(values), (1 << 64) - 1
    near = {(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1:] if ((a ^ b) & mask).bit_count() <= 2}
    assert sorted((r.a, r.b) for r in made) == sorted(near)


def check_packing(rows, given, pad=1024):
    """`rows` cover every id of every text once, gapless in their sequences of at most `pad` ids."""
    import tokenizers
    known = tokenizers.Tokenizer.from_file(BYTES)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(given)
    for doc, pieces in by_doc.items():
        ids, at = known.encode(given[doc] or "", add_special_tokens=False).ids + [0], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:at], "<u4").tobytes())
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= pad
    return len(by_sequence)


def test_packing_covers_every_id(spark):
    rows = QUERIES["op7_vector_packing"](spark, SF).collect()
    n = check_packing(rows, texts(spark, SF))
    assert sum(r.length for r in rows) > 0.9 * 1024 * (n - 8)


def accuracy_of_rank(scores, truth):
    order = np.argsort(np.argsort(scores)) + 1
    ones = truth == 1
    return (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_toxicity_on_rows_not_learned_from(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{BIGGER}/labels.parquet").collect()}
    rows = QUERIES["op1_toxicity"](spark, BIGGER).collect()
    assert len(rows) == spark.read.parquet(f"{BIGGER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    rank = accuracy_of_rank(np.array([r.score for r in held]), np.array([labels[r.doc_id] for r in held]))
    print("held out", len(held), "area under the curve", rank)
    assert rank > 0.8


def test_language_on_rows_not_learned_from(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{BIGGER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op6_language_id"](spark, BIGGER).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und"]
    right = np.mean([r.lang_pred == lang[r.doc_id] for r in held])
    print("held out", len(held), "right", right)
    assert right > 0.85


def runs(docs, labels):
    return {
        "toxicity": lambda: toxicity.toxic(docs, labels), "order": lambda: training_order.materialise(docs, BYTES),
        "pieces": lambda: sentencepiece_bpe.encoded(docs, PIECES), "quality": lambda: quality.quality(docs),
        "kept": lambda: quality.good_documents(docs), "simhash": lambda: simhash.near_duplicates(docs),
        "stay": lambda: simhash.one_of_each(docs), "language": lambda: langid.languages(docs),
        "packing": lambda: packing.packed(docs, BYTES), "licenses": lambda: licenses.scan(docs),
        "merkle": lambda: merkle.edit_report(docs)}


NAMES = sorted(runs(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_odd_documents(spark, name):
    docs = odd_documents(with_shared_folder(spark))
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    rows = runs(docs, labels)[name]().collect()
    if name in ("toxicity", "pieces", "quality", "simhash", "language", "merkle"):
        assert len(rows) == docs.count()


@pytest.mark.parametrize("name", NAMES)
def test_no_documents(spark, name):
    docs = odd_documents(with_shared_folder(spark)).filter(F.lit(False))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert runs(docs, labels)[name]().collect() == []


def test_chat_keeps_odd_turns(spark):
    rows = [(1, 0, "user", "<|im_end|>"), (1, 1, "assistant", None), (2, 0, None, "x"), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = {r.conv_id: r for r in chat.read_back(chat.formatted(frame)).collect()}
    assert made[1].turns_sha256 == hashlib.sha256(b"user\n<|im_end|>\nassistant\n\n").hexdigest()
    assert made[1].n_turns == 2 and made[1].loss_chars == 0
    assert chat.read_back(chat.formatted(frame.filter("false"))).collect() == []


def test_equal_texts_have_equal_roots(spark):
    docs = spark.createDataFrame([(1, "a\n\nb"), (2, "a\n\nb"), (3, "a\n\nc"), (4, None), (5, "")], "doc_id long, text string")
    made = {r.doc_id: r for r in merkle.edit_report(docs).collect()}
    assert made[1].fingerprint == made[2].fingerprint != made[3].fingerprint
    assert made[4].fingerprint == made[5].fingerprint and made[4].n_chars == 0
    assert made[2].near_next == 1.0 or made[1].near_next < 1.0


def test_pipeline_stages(spark):
    with_shared_folder(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    verdict = {r.doc_id for r in QUERIES["op4_quality_rules"](spark, SF).filter("kept").collect()}
    kept = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    assert {r.doc_id for r in kept.collect()} == verdict and kept.columns == docs.columns
    spoken = corpus_pipeline.language(spark, kept, SF)
    assert spoken.columns == docs.columns and spoken.count() > 0.9 * kept.count()
    one = corpus_pipeline.near_duplicates(spark, kept, SF)
    groups = linked({r.doc_id: fingerprint(r.text or "") for r in kept.collect()})
    assert {r.doc_id for r in one.collect()} == set(groups.values()) and one.columns == docs.columns
    packed = corpus_pipeline.pack(spark, one, SF).collect()
    check_packing(packed, {r.doc_id: r.text for r in one.collect()})
