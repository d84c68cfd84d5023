"""Vector codes, whitening and archives against brute force, numpy and a second reading of the files."""

import glob
import gzip
import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from roadlens.llm import spectrum, vector_codes, vectors, warc, whitened
from roadlens.llm.files import committed, located
from roadlens.llm.queries import with_shared_folder

VECTORS = "vec_id long, embedding array<double>, label int, code string, error string, x string, n string, _label string"
NAN, INF = float("nan"), float("inf")


def vector_table(spark, rows, extra=("a", "b", "c", "d", "e")):
    return with_shared_folder(spark).createDataFrame([(*r, *extra) for r in rows], VECTORS)


def odd_vectors(seed=5, n=60, size=10):
    """Dropped rows, short and long vectors, equal ids, equal vectors, null ids and labels."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(size=size).round(3).tolist(), int(i % 3)) for i in rng.permutation(n)]
    rows += [(7, rows[0][1], None), (8, rows[1][1], None), (3, [0.25] * size, 1), (3, [-0.25] * size, 1), (None, [1.0] * size, 2)]
    rows += [(-5, None, 1), (-4, [None] + [1.0] * (size - 1), 1), (-3, [NAN] * size, 1), (-2, [1.0, INF], 1), (900, [], 0), (901, [0.5, -0.5], 0)]
    return rows + rows[:4]


def is_whole(vector):
    return vector is not None and all(c is not None and math.isfinite(c) for c in vector)


# Vector codes ---------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 4, 8, 16, 32])
def test_coefficients_come_by_sign_changes(size):
    hadamard = np.array([[1]])
    while len(hadamard) < size:
        hadamard = np.block([[hadamard, hadamard], [hadamard, -hadamard]])
    rows = hadamard[vector_codes.sequency(size)]
    assert (np.diff(rows, axis=1) != 0).sum(1).tolist() == list(range(size))
    points = np.random.default_rng(0).integers(-9, 9, (20, size))
    assert (vector_codes.transformed(points) == points @ rows.T).all()
    assert ((vector_codes.transformed(points) ** 2).sum(1) == size * (points ** 2).sum(1)).all()


@pytest.mark.parametrize("kind", ["int64", object])
@pytest.mark.parametrize("size", [1, 3, 8])
def test_nearest_by_brute_force_with_ties(kind, size):
    rng = np.random.default_rng(1)
    points, entries = rng.integers(-3, 4, (400, size)).astype(kind), rng.integers(-3, 4, (16, size)).astype(kind)
    entries[9] = entries[4]
    found, distance = vector_codes.nearest(vector_codes.transformed(points), vector_codes.transformed(entries))
    full = ((points[:, None] - entries[None]) ** 2).sum(2).astype("int64")
    scale = vector_codes.transformed(points).shape[1]
    assert (found == full.argmin(1)).all() and (distance.astype("int64") == scale * full.min(1)).all()


def codes_by_hand(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [r for r in rows if is_whole(r[1])]
    size = max(1, -(-max(len(r[1]) for r in kept) // parts))
    whole = [[math.floor(Fraction(c) * scale) for c in r[1]] + [0] * (size * parts - len(r[1])) for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    cut = lambda x, p: x[p * size:(p + 1) * size]
    books = [[cut(whole[i], p) for i in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign(p):
        return [min((far(cut(x, p), e), k) for k, e in enumerate(books[p])) for x in whole]
    for _ in range(rounds):
        for p in range(parts):
            near = assign(p)
            for k in range(len(books[p])):
                own = [cut(whole[i], p) for i, (_, e) in enumerate(near) if e == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    near = [assign(p) for p in range(parts)]
    error = [sum(near[p][i][0] for p in range(parts)) for i in range(len(kept))]
    label = {}
    for r, e in zip(kept, error):
        label[r[2]] = label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{near[p][i][1]:02x}" for p in range(parts)), error[i], label[r[2]], digest) for i, r in enumerate(kept))


def made_codes(frame):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in frame.collect())


def test_codes_of_odd_vectors_by_brute_force(spark):
    rows = odd_vectors()
    assert made_codes(vector_codes.encoded(vector_table(spark, rows))) == codes_by_hand(rows)


@pytest.mark.parametrize("n", [1, 5])
def test_codes_of_fewer_rows_than_entries(spark, n):
    rows = odd_vectors()[:n]
    assert made_codes(vector_codes.encoded(vector_table(spark, rows))) == codes_by_hand(rows)


def test_codes_beyond_safe_longs_are_exact(spark):
    rows = [(i, [float(2 ** 20 + 300 * i), -3e5 - i, 7.77, 0.001 * i] * 2, 0) for i in range(40)]
    assert made_codes(vector_codes.encoded(vector_table(spark, rows))) == codes_by_hand(rows)
    huge = vector_codes.encoded(vector_table(spark, [*rows, (99, [1e300] * 8, 1)])).collect()
    assert len(huge) == 41 and all(r.error is not None for r in huge if r.vec_id == 99)     # it is an entry's only part
    lone = vector_codes.encoded(vector_table(spark, [(i, [0.0] * 8, 0) for i in range(16)] + [(99, [1e300] * 8, 1), (98, [-1e300] * 8, 1)])).collect()
    assert {r.vec_id: r.error for r in lone}[98] is None and {r.vec_id: r.label_error for r in lone}[98] is None
    assert {r.label_error for r in lone if r.vec_id < 16} == {0}


def test_digits_of_large_sums():
    for value in (0, 1, -1, 2 ** 31, -2 ** 31, 2 ** 63, -2 ** 63 - 5, 10 ** 40, -10 ** 40):
        digits = list(vectors.limbs(value))
        assert sum(d << vectors.LIMB * k for k, d in digits) == value and all(-2 ** 31 <= d < 2 ** 32 for _, d in digits)


@pytest.mark.parametrize("rows", [[], [(1, None, 0), (2, [NAN], 1)]])
def test_no_whole_vectors(spark, rows):
    assert vector_codes.encoded(vector_table(spark, rows)).collect() == []
    assert whitened.whitened(vector_table(spark, rows)).collect() == []


# Whitening ---------------------------------------------------------------


def known_spectra():
    rng = np.random.default_rng(3)
    turn, _ = np.linalg.qr(rng.standard_normal((48, 48)))
    at = lambda values: (turn * np.array(values)) @ turn.T
    data = rng.standard_normal((200, 48))
    return {"data": data.T @ data / 200, "one": np.array([[2.5]]), "rank 5": at([9, 8, 7, 6, 5] + [0] * 43), "identity": 3 * np.eye(48),
            "equal ones": at([10] * 4 + [5] * 6 + [5 - 1e-9] * 2 + list(np.linspace(1, 2, 36))),
            "close ones": at([10, 10 - 1e-6, 10 - 2e-6] + list(np.linspace(1, 2, 45))), "falling": at(2.0 ** -np.arange(48)),
            "diagonal": np.diag([0.0] * 44 + [1, 2, 3, 4]), "zero": np.zeros((4, 4))}


@pytest.mark.parametrize("name", sorted(known_spectra()))
def test_leading_eigenpairs(name):
    matrix = known_spectra()[name]
    values, own = spectrum.leading(matrix, 16)
    expected = np.linalg.eigvalsh(matrix)[::-1][:16]
    scale = max(expected[0], 1e-300)
    assert len(values) == len(expected) and np.abs(values - expected).max() <= 1e-13 * scale
    assert np.abs(matrix @ own - own * values).max() <= 1e-13 * scale and np.abs(own.T @ own - np.eye(len(values))).max() < 1e-12


def test_counts_of_indefinite_matrices():
    rng = np.random.default_rng(4)
    for _ in range(40):
        matrix = rng.standard_normal((17, 17))
        matrix = matrix + matrix.T
        shift = rng.standard_normal() * 3
        assert spectrum.Slices(matrix).above(shift) == (np.linalg.eigvalsh(matrix) > shift).sum()
        right = rng.standard_normal(17)
        assert np.allclose(matrix @ spectrum.factor(matrix).solve(right, 1e-300), right)


def check_whitening(rows, made, components=16):
    kept = [r for r in rows if is_whole(r[1])]
    size = max(len(r[1]) for r in kept)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in r[1]] + [1_000_000] * (size - len(r[1])) for r in kept], object)
    fit = {tuple(v) for v in x.tolist()}
    n, sums = len(fit), np.array([sum(c) for c in zip(*fit)], object)
    centred = np.array([[float(Fraction(int(v * n - s), n)) for v, s in zip(row, sums)] for row in sorted(fit)])
    spread = centred.T @ centred / n
    values = np.linalg.eigvalsh(spread)[::-1][:components]
    values = values[values > 1e-12 * values[0]]
    by_row = {}
    for r in made:
        by_row.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert len(made) == len(kept) * len(values) and {r.n for r in made} == {n}
    own = np.zeros((len(kept), len(values)))
    for i, (r, v) in enumerate(zip(kept, x.tolist())):
        deviation = sum(int(a * n - s) ** 2 for a, s in zip(v, sums))
        found = by_row[r[0], deviation]
        assert sorted(found) == list(range(1, len(values) + 1))
        own[i] = [found[k][0].whitened for k in sorted(found)]
    for r in made:
        assert abs(r.explained - values[r.component - 1] / np.trace(spread)) <= 1e-10 * r.explained and r.identity_error < 1e-9
    # Projections on unit eigenvectors over the roots: equal products between rows, whatever the signs.
    whole = np.array([[float(Fraction(int(a * n - s), n)) for a, s in zip(v, sums)] for v in x.tolist()])
    vectors_ = np.linalg.eigh(spread)[1][:, ::-1][:, :len(values)]
    expected = whole @ vectors_ / np.sqrt(values)
    expected *= np.sign((expected * own).sum(0))
    assert np.abs(expected - own).max() < 1e-8


def test_whitening_of_odd_vectors(spark):
    rows = [r for r in odd_vectors(n=90, size=20) if r[1] is None or len(r[1]) != 0]
    check_whitening(rows, whitened.whitened(vector_table(spark, rows)).collect())


def test_whitening_with_fewer_dimensions_and_no_variance(spark):
    rows = [(i, [0.1 * i, (i * i) % 7 / 3, 5.0], 0) for i in range(30)]        # the third never varies
    check_whitening(rows, whitened.whitened(vector_table(spark, rows)).collect())
    assert whitened.whitened(vector_table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect() == []


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(i, [float(i % 3) * 1e10, float(i)], 0) for i in range(6)] + [(77, [1e290, 0.0], 0)]
    made = whitened.whitened(vector_table(spark, rows)).collect()
    assert {r.vec_id for r in made} == set(range(6)) and all(r.deviation is None or r.deviation < 2 ** 63 for r in made)
    assert any(r.deviation is None for r in made)


# Archives ---------------------------------------------------------------


LONG = "<p>" + "ä text 🙂 " * 30_000
PAGES = [(5, "http://a/5", "x" * 200), (3, None, "x" * 200), (3, "http://a/3\nX: y é", "x" * 200), (None, "http://a/n", "x" * 200),
         (9, "u", None), (8, "u", ""), (2, "u", "y" * 99), (1, "u", "y" * 99), (7, "u", "é" * 50), (6, "u", "é" * 50), (11, "u", LONG), (10, "v", LONG),
         (12, "u", "a\r\n\r\nb" * 40), (13, "", "\u0000<x>"), (None, None, None), (-4, "w", "WARC/1.1\r\n\r\n" * 30)]


def pages_frame(spark, rows):
    schema = "page_id long, url string, html string, digest string, kind string, shard string, first string"
    return with_shared_folder(spark).createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema)


def records_by_hand(rows):
    out, groups = [], {}
    for page, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        data = (html or "").encode()
        digest, kind, refers = hashlib.sha256(data).hexdigest(), "response", None
        if len(data) >= 100 and page is not None:
            if digest in groups:
                kind, refers = "revisit", groups[digest]
            groups.setdefault(digest, page)
        out.append((str(page), len(data), digest, kind, str(refers), (html or "") if kind == "response" else None))
    return sorted(out, key=str)


def read_records(frame):
    return sorted([(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), r.payload) for r in frame.collect()], key=str)


SMALL = warc.Settings(smallest_shard=1024, most_shards=1000, roll_bytes=700)


def test_archives_give_back_the_pages(spark):
    rows = PAGES + PAGES[:2] + [(100 + i, f"http://copy/{i}", "copied " * 40) for i in range(300)]
    folder = warc.write(pages_frame(spark, rows), settings=SMALL)
    assert read_records(warc.read(spark, folder, with_payload=True)) == records_by_hand(rows)
    manifest = spark.read.parquet(f"{folder}/manifest").collect()
    assert len({r.shard for r in manifest}) > 10 and len(manifest) > len({r.shard for r in manifest})
    assert sum(r.records for r in manifest) == len(rows)


def test_the_same_pages_give_the_same_files(spark):
    rows = PAGES + [(100 + i, f"http://copy/{i}", f"copied {i % 7} " * 40) for i in range(60)]
    frame = pages_frame(spark, rows)
    seen = []
    for order in (frame.coalesce(1), frame.repartition(7), frame.orderBy("url")):
        folder = warc.write(order, settings=SMALL)
        seen.append(sorted((r.file, r.shard, r.records, r.bytes, r.sha256) for r in spark.read.parquet(f"{folder}/manifest").collect()))
    assert seen[0] == seen[1] == seen[2]


def test_files_are_plain_gzip_with_ascending_pages(spark):
    folder = warc.write(pages_frame(spark, PAGES), settings=SMALL)
    found = []
    for r in sorted(spark.read.parquet(f"{folder}/manifest").collect(), key=lambda r: r.file):
        data = gzip.open(f"{folder.removeprefix('file://')}/{r.file}").read()
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        found += [int(line[11:]) for line in data.split(b"\r\n") if line.startswith(b"X-Page-Id: ")]
        # A target with a line break in it adds no header.
        assert b"\r\nX: y" not in data
    assert found == sorted(found)


def test_only_whole_and_listed_files_are_read(spark):
    folder = warc.write(pages_frame(spark, PAGES), settings=SMALL)
    path = folder.removeprefix("file://")
    expected = read_records(warc.read(spark, folder, True))
    with pytest.raises(RuntimeError, match="lost"), committed(folder, "shard-00000000-0000.warc.gz") as stream:
        stream.write(b"half")
        raise RuntimeError("lost")
    with open(f"{path}/shard-99999999-0000.warc.gz", "wb") as other:
        other.write(b"of an attempt that no manifest lists")
    assert read_records(warc.read(spark, folder, True)) == expected
    name = sorted(glob.glob(f"{path}/shard-0*"))[0]
    data = bytearray(open(name, "rb").read())
    data[len(data) // 2] ^= 1
    open(name, "wb").write(bytes(data))
    with pytest.raises(Exception):
        warc.read(spark, folder).collect()


def test_no_pages(spark):
    folder = warc.write(pages_frame(spark, []))
    assert warc.read(spark, folder).collect() == []


def test_folders_without_a_scheme_are_located(spark, tmp_path):
    assert located(spark, str(tmp_path)) == f"file://{tmp_path}" == located(spark, f"file:{tmp_path}")
    folder = warc.write(pages_frame(spark, PAGES), str(tmp_path / "out"))
    assert folder == f"file://{tmp_path}/out" and warc.read(spark, str(tmp_path / "out")).count() == len(PAGES)
