"""Training order read back slot by slot, and merge rounds over long words."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from roadlens.llm import sentencepiece_bpe, training_order
from roadlens.llm.queries import with_shared_folder
from tests.llm.test_corpus import BYTES, PIECES, SF, odd_documents

SMALL = training_order.Order(key=99, length=64, per_shard=32)


@pytest.mark.parametrize("scheme", ["file:", "", "file://"])
def test_slots_read_back(spark, tmp_path, scheme):
    import tokenizers
    spark = with_shared_folder(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).coalesce(1)
    texts = [r.text or "" for r in docs.collect()]
    folder = f"{scheme}{tmp_path}/order"
    index = {r.slot: r for r in training_order.materialise(docs, BYTES, folder, SMALL).collect()}
    n = len(index)
    assert sorted(index) == list(range(n)) and len({r.shard for r in index.values()}) == -(-n // 32) > 3
    read = training_order.read_slots(spark, folder, 0, n + 10)
    assert read.shape == (n, 64) and read.dtype == np.dtype("<u2")
    known = tokenizers.Tokenizer.from_file(BYTES)
    stream = np.concatenate([known.encode(t, add_special_tokens=False).ids + [0] for t in texts])
    back = np.zeros(n * 64, "int64")
    for slot in range(n):
        r = index[slot]
        assert r.sequence == training_order.sequence_of(spark, folder, slot) if slot < 3 else True
        assert training_order.permute(np.array([r.sequence]), n, 99)[0] == slot
        assert r.shard == slot // 32 and r.byte_offset == slot % 32 * 128 and r.ids_crc32 == zlib.crc32(read[slot].tobytes())
        assert r.n_tokens == min(64, len(stream) - 64 * r.sequence)
        back[64 * r.sequence:64 * r.sequence + 64] = read[slot]
    assert (back[:len(stream)] == stream).all() and not back[len(stream):].any()
    # Resuming in the middle of a shard reads what a full read gives there.
    assert (training_order.read_slots(spark, folder, 45, 40) == read[45:85]).all()
    assert len(training_order.read_slots(spark, folder, n, 5)) == 0


def test_a_rerun_over_the_same_rows_writes_the_same_shards(spark, tmp_path):
    docs = odd_documents(with_shared_folder(spark)).coalesce(2)
    for name in "ab":
        training_order.materialise(docs, BYTES, f"{tmp_path}/{name}", SMALL).count()
    files = sorted(p.name for p in (tmp_path / "a").glob("shard-*.bin"))
    assert files and all((tmp_path / "a" / f).read_bytes() == (tmp_path / "b" / f).read_bytes() for f in files)


def test_no_documents_give_a_manifest_of_none(spark, tmp_path):
    docs = odd_documents(with_shared_folder(spark)).filter("false")
    assert training_order.materialise(docs, BYTES, f"{tmp_path}/none", SMALL).collect() == []
    assert training_order.read_slots(spark, f"{tmp_path}/none", 0, 5).shape == (0, 64)


def test_a_folder_without_manifest_is_not_read(spark, tmp_path):
    with pytest.raises(Exception):
        training_order.read_slots(spark, f"{tmp_path}/nothing", 0, 5)


def test_width_follows_the_vocabulary(monkeypatch):
    assert training_order.Order().for_tokenizer(BYTES).kind == "<u2"
    monkeypatch.setattr(training_order, "vocabulary_size", lambda path: 70_000)
    assert training_order.Order().for_tokenizer(BYTES).kind == "<u4"
    with pytest.raises(ValueError, match="do not fit"):
        training_order.Order(kind="<u2").for_tokenizer(BYTES)


def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_a_batch_of_long_words_stays_in_the_rounds(monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 501)) for _ in range(40)] + ["ab" * 250 + "z" * i for i in range(40)]
    model = sentencepiece_bpe.Model(PIECES)

    def refuse(symbols):
        raise AssertionError("left the rounds")
    monkeypatch.setattr(model, "_queued", refuse)
    known = library()
    assert [ids.tolist() for ids in model.encode(texts)] == [known.encode(t, add_bos=True, add_eos=True) for t in texts]


def test_one_very_long_word_among_others(monkeypatch):
    rng = np.random.default_rng(3)
    letters = "etaoinshrdlu"
    long = "".join(letters[c] for c in rng.integers(0, 12, 30_000))
    texts = [long, "short words here", " " * 9000 + "x", "".join(letters[c] for c in rng.integers(0, 12, 3000))]
    model, known, queued = sentencepiece_bpe.Model(PIECES), library(), []
    once = model._queued
    monkeypatch.setattr(model, "_queued", lambda symbols: (queued.append(len(symbols)), once(symbols))[1])
    made = model.encode(texts)
    for ids, text in zip(made, texts):
        assert ids.tolist() == known.encode(text, add_bos=True, add_eos=True)
        assert model.decode(ids) == known.decode(ids.tolist())
    assert len(queued) <= 3 and all(n > sentencepiece_bpe.LONG for n in queued)


def test_invalid_bytes_decode_as_the_library_does():
    model, known = sentencepiece_bpe.Model(PIECES), library()
    rng = np.random.default_rng(4)
    for _ in range(50):
        ids = rng.integers(3, 500, 60)
        assert model.decode(ids) == known.decode(ids.tolist())
