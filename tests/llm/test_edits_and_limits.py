"""Edits located by fingerprints, and packing under limits that bind."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.llm import merkle, packing
from roadlens.llm.queries import with_shared_folder

# Edits located ---------------------------------------------------------------


def sections(fp):
    return fp.split(":")[1].split(";")


def test_edited_sections_by_brute_force(spark):
    rng = np.random.default_rng(5)
    line = lambda: " ".join(f"w{rng.integers(0, 50)}" for _ in range(rng.integers(0, 12)))
    texts = []
    for _ in range(60):
        lines = [line() for _ in range(rng.integers(0, 60))]
        other = list(lines)
        for _ in range(rng.integers(0, 4)):
            at = int(rng.integers(0, len(other) + 1))
            kind = rng.integers(0, 3)
            other[at:at + (kind != 0)] = [] if kind == 1 else [line()]
        texts.append(("\n".join(lines), "\n".join(other)))
    texts += [("", ""), ("a", ""), (None, "b"), ("same\n" * 40, "same\n" * 39)]
    df = spark.createDataFrame(texts, "a string, b string").select("a", "b", merkle.fingerprint(F.col("a")).alias("fa"), merkle.fingerprint(F.col("b")).alias("fb"))
    rows = df.select("*", merkle.differing(F.col("fa"), F.col("fb")).alias("d"), merkle.edited_range(F.col("fa"), F.col("fb")).alias("r")).collect()
    for r in rows:
        own, other = sections(r.fa), set(sections(r.fb))
        wrong = [i + 1 for i, s in enumerate(own) if s not in other]
        assert r.d == wrong
        first = [own.index(s) + 1 for s in dict.fromkeys(own[i - 1] for i in wrong)]
        assert (r.r.edited_sections, r.r.first_edited, r.r.last_edited) == (len(first), min(first, default=None), max(first, default=None))
        assert (r.fa == r.fb) == ((r.a or "") == (r.b or ""))


def test_an_edit_changes_the_section_it_lies_in_and_no_other(spark):
    lines = [f"paragraph number {i} says something of its own" for i in range(200)]
    changed = list(lines)
    changed[120] += " edited"
    frame = spark.createDataFrame([("\n".join(lines), "\n".join(changed))], "a string, b string")
    row = frame.select(merkle.fingerprint(F.col("a")).alias("fa"), merkle.fingerprint(F.col("b")).alias("fb")).select(
        "fa", merkle.differing(F.col("fa"), F.col("fb")).alias("d")).first()
    ends = np.cumsum([s.count(",") + 1 for s in sections(row.fa)])                 # paragraphs up to each section's end
    inside = int(np.searchsorted(ends, 120, "right")) + 1
    assert len(sections(row.fa)) > 20 and set(row.d) <= {inside - 1, inside, inside + 1} and row.d


# Limits of packing -------------------------------------------------------------


def packed(limits, examples):
    packer, out = packing.Packer(limits), []
    for key, length, loss in examples:
        out += list(packer.add(key, 0, length, loss))
    return out + list(packer.finish())


def demands(sequence, examples):
    """Tokens, segments and loss-bearing tokens of a closed sequence; a piece's loss is what of its first tokens bears it."""
    loss_of = {key: loss for key, _, loss in examples}
    return (sum(p[2] for p in sequence), len(sequence), sum(max(0, min(loss_of[p[0]], p[1] + p[2]) - p[1]) for p in sequence))


@pytest.mark.parametrize("cut", [True, False])
@pytest.mark.parametrize("segments, loss_tokens", [(3, 1024), (64, 200), (4, 150)])
def test_no_limit_is_broken_and_every_token_is_placed_once(cut, segments, loss_tokens):
    rng = np.random.default_rng(8)
    limits = packing.Limits(tokens=512, segments=segments, loss_tokens=loss_tokens, pool=32, cut=cut)
    examples = []
    for i in range(400):
        length = int(rng.integers(1, 300))
        examples.append((i, length, int(rng.integers(0, min(length, 120 if not cut else length) + 1))))
    closed = packed(limits, examples)
    covered = {}
    for sequence in closed:
        tokens, pieces, loss = demands(sequence, examples)
        assert tokens <= 512 and pieces <= segments and loss <= loss_tokens
        for piece in sequence:
            covered.setdefault(piece[0], []).append((piece[1], piece[2]))
    for key, length, _ in examples:
        at = 0
        for start, size in sorted(covered[key]):
            assert start == at and size > 0
            at += size
        assert at == length and (cut or len(covered[key]) == 1)


def test_the_dot_product_takes_what_uses_the_free_dimension():
    """With tokens nearly spent on loss-free text, the piece that bears loss is taken before a longer one that does not."""
    limits = packing.Limits(tokens=100, segments=10, loss_tokens=100, pool=10, cut=False)
    packer = packing.Packer(limits)
    for key, length, loss in (("long", 60, 0), ("bearing", 40, 40), ("plain", 40, 0)):
        list(packer.add(key, 0, length, loss))
    first = next(iter(packer.finish()))
    # bearing: 0.4 tokens + 0.4 loss + a segment beats 0.6 tokens + a segment; then what fits and scores most fills up.
    assert [p[0] for p in first] == ["bearing", "long"]


def test_an_example_larger_than_a_sequence_may_not_be_packed_whole():
    with pytest.raises(ValueError, match="larger"):
        packed(packing.Limits(tokens=10, cut=False), [("a", 11, 0)])


def test_conversations_pack_under_all_three_limits(spark):
    """Conversation-shaped rows: short segments of which only some bear loss, so segments and loss close sequences."""
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    examples = [((r.conv_id, r.turn), max(1, len((r.text or "").split())), len((r.text or "").split()) if r.role == "assistant" else 0) for r in rows]
    limits = packing.Limits(tokens=256, segments=6, loss_tokens=96, pool=64)
    closed = packed(limits, examples)
    used = np.array([demands(s, examples) for s in closed])
    assert (used <= [256, 6, 96]).all()
    full = (used[:-1] == [256, 6, 96]).any(axis=0)
    assert full[1] and full[2] or full[0]
