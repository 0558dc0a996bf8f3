"""Filter audit, whitening and harmonic packing against brute force, exact sums and round trips."""

import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest

from keyloom.llm import bidiagonal, filter_audit, harmonic, whitening

from .conftest import invented

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_audit(rows, labels):
    """rows of (doc_id, text, lang), labels of (doc_id, quality, toxic)."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    infinite = float("inf")
    fails, parts = [], {}
    for at, (doc, text, lang) in enumerate(rows):
        text = text or ""
        words = WORD.findall(text)
        same = [d for d, t, _ in rows if (t or "") == text and d is not None]
        fails.append({f for f, failing in {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": bool(same) and min(same) < (infinite if doc is None else doc),
        }.items() if failing})
        parts.setdefault(lang or "", []).append(at)
    out = {}
    for part, members in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = set(members)
            for step, f in enumerate(order, 1):
                here = {i for i in alive if f in fails[i]}
                failing = {i for i in members if f in fails[i]}
                out[part, "".join(order), step] = [
                    len(alive) - len(here), len(here), len(failing - alive), sum(fails[i] == {f} for i in members),
                    sum(rows[i][0] in good for i in here), sum(rows[i][0] in toxic for i in here),
                ]
                removed_by[f] += len(here)
                alive -= here
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed_by[order[step - 1]])
    return out


@pytest.fixture
def make_rows(spark):
    def build(rows):
        return spark.createDataFrame([(*r, *["x"] * 4) for r in rows], "doc_id long, text string, lang string, part string, row string, h1 string, mask string")

    return build


def test_audit_equals_brute_force(spark, make_rows, monkeypatch):
    rng = random.Random(3)
    texts = [invented(i, 60 + 20 * (i % 5)) for i in range(12)] + [invented(i, 150).upper() for i in (20, 21)] + ["same words again " * 50, "# " + invented(30, 130), None, "", " \n", "naïve Ünï " * 40, "A" * 300_000]
    rows = [(rng.choice([*range(1, 40), None]), rng.choice(texts), rng.choice(["en", "de", "", None])) for _ in range(90)]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in [*range(1, 45), 3, 4, None]]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for share in (filter_audit.HOT_SHARE, 20):  # also with copies that are looked up as hot texts
        monkeypatch.setattr(filter_audit, "HOT_SHARE", share)
        found = {(r[0], r[1], r[2]): list(r[3:]) for r in filter_audit.audit(make_rows(rows), table).collect()}
        assert found == brute_audit(rows, labels)


def test_audit_of_an_empty_table(spark, make_rows):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(make_rows([]), labels).count() == 0
    alone = filter_audit.audit(make_rows([(None, None, None)]), labels.limit(0)).collect()
    assert len(alone) == 600 and {r.part for r in alone} == {""} and sum(r.removed for r in alone) == 120


@pytest.mark.parametrize("ratio", [1, 40, 5_000])
def test_galloping(ratio):
    rng = np.random.default_rng(ratio)
    long = np.unique(rng.integers(0, 1 << 20, 60_000))
    short = np.unique(np.concatenate([rng.integers(0, 1 << 20, len(long) // ratio), long[:3], long[-2:], [0, 1 << 20]]))
    assert np.array_equal(filter_audit.gallop(short, long), np.searchsorted(long, short))
    assert np.array_equal(filter_audit.united(short, long), np.union1d(short, long))
    assert filter_audit.meeting(short, long).sum() == len(np.intersect1d(short, long))


def exact_whitening(vectors):
    x = [[math.floor(256 * float(c)) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n = len(fit)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    # the scatter of the centred integers, exact until the last division
    d = len(sums)
    scatter = np.array([[sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in fit) / n ** 3 for j in range(d)] for i in range(d)], float)
    return x, n, sums, deviations, scatter


def test_whitening(spark):
    rng = np.random.default_rng(11)
    vectors = (rng.normal(size=(120, 6)) * [9, 5, 5, 2, 1, 0.2]).astype(np.float32).tolist()
    vectors += [vectors[0]] * 30
    bad = [None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [0.0] * 5, [float("inf")] + [0.0] * 5, [1.0], []]
    table = spark.createDataFrame([(i, v, 7, "a") for i, v in enumerate([*vectors, *bad])] + [(None, vectors[1], 7, "a")], "vec_id long, embedding array<float>, n long, x string")
    rows = whitening.whiten(table).collect()
    stored = [np.float32(v).tolist() for v in vectors]
    x, n, sums, deviations, scatter = exact_whitening(stored)
    assert len(rows) == 4 * (len(vectors) + 1) and {r.n for r in rows} == {n}
    values, directions = np.linalg.eigh(scatter)
    values, directions = values[::-1][:4], directions[:, ::-1][:, :4]
    expected = (np.array(x, float) - np.array(sums) / n) @ directions / np.sqrt(values)
    got = np.zeros((len(vectors), 4))
    for r in rows:
        if r.vec_id is not None:
            assert r.deviation == deviations[r.vec_id]
            assert r.explained == pytest.approx(values[r.component - 1] / np.trace(scatter), rel=1e-9)
            assert abs(r.identity_error) < 1e-9
            got[r.vec_id, r.component - 1] = r.whitened
    signs = np.sign((got * expected).sum(0))
    assert np.allclose(got, expected * signs, atol=1e-8)


def test_whitening_edges(spark):
    def table(vectors):
        return spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")

    assert whitening.whiten(table([])).count() == 0
    assert whitening.whiten(table([None, [None]])).count() == 0
    assert whitening.whiten(table([[1.0, 2.0]] * 5)).count() == 0
    line = whitening.whiten(table([[0.0, 1.0], [1.0, 1.0], [-0.001, 1.0]])).collect()  # one direction of variance
    assert {(r.vec_id, r.component) for r in line} == {(0, 1), (1, 1), (2, 1)}
    assert [r.explained for r in line] == pytest.approx([1.0] * 3)
    square = whitening.whiten(table([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]])).collect()  # equal eigenvalues
    assert len(square) == 8 and all(r.identity_error < 1e-12 and r.explained == pytest.approx(0.5) for r in square)
    huge = whitening.whiten(table([[2.0 ** 50, 0.0], [0.0, 1.0], [1.0, 0.0], [2.0 ** 60, 1.0]])).collect()
    assert {r.vec_id for r in huge} == {0, 1, 2} and {r.deviation for r in huge} == {None}
    exact = whitening._deviations(np.array([[1 << 30, 5], [7, 9]]), 2, [3, 4])
    assert exact == [(2 * (1 << 30) - 3) ** 2 + 36, 11 ** 2 + 14 ** 2]


@pytest.mark.parametrize("fold", [2, 32])
def test_blockwise_triangle(spark, fold):
    rng = np.random.default_rng(2)
    x = rng.integers(-500, 500, (300, 5))
    packed = spark.createDataFrame([(bytearray(whitening._packed(v)),) for v in x], "x binary").repartition(9)
    r = whitening.triangle(packed, 5, x.mean(0), fold)
    centred = x - x.mean(0)
    assert np.allclose(r.T @ r, centred.T @ centred) and np.allclose(r, np.triu(r))


@pytest.mark.parametrize("kind", ["random", "graded", "equal", "clusters", "rank", "diagonal", "one"])
def test_bidiagonal_solver(kind):
    rng = np.random.default_rng(4)
    n = 1 if kind == "one" else 40
    u, _ = np.linalg.qr(rng.normal(size=(n, n)))
    v, _ = np.linalg.qr(rng.normal(size=(n, n)))
    sigma = {
        "one": np.array([3.0]),
    }[kind] if n == 1 else {
        "random": np.sort(rng.random(n))[::-1], "graded": 10.0 ** -np.linspace(0, 12, n), "equal": np.ones(n),
        "clusters": np.repeat([5.0, 5.0 - 1e-13, 2.0, 1.0], n // 4), "rank": np.r_[np.linspace(3, 1, 5), np.zeros(n - 5)], "diagonal": np.linspace(9, 1, n),
    }[kind]
    r = np.diag(sigma) if kind == "diagonal" else np.linalg.qr(u @ np.diag(sigma) @ v.T, mode="r")
    d, e, w = bidiagonal.bidiagonal(r)
    b = np.diag(d) + (np.diag(e, 1) if n > 1 else 0)
    assert np.allclose(w @ (b.T @ b) @ w.T, r.T @ r, atol=1e-12 * sigma[0] ** 2) and np.allclose(w.T @ w, np.eye(n))
    values, directions = bidiagonal.right_vectors(r, 6)
    assert np.allclose(np.sqrt(values), np.linalg.svd(r, compute_uv=False), atol=1e-12 * sigma[0], rtol=0)
    k = directions.shape[1]
    assert k == min(6, n if kind != "rank" else 5)
    assert np.allclose(directions.T @ directions, np.eye(k), atol=1e-12)
    assert np.allclose(directions.T @ (r.T @ r) @ directions, np.diag(values[:k]), atol=1e-11 * values[0])


def test_dqds_is_accurate_for_small_values():
    """Entries give every singular value of a bidiagonal matrix to full relative accuracy."""
    d, e = 10.0 ** -np.arange(0, 16, 2.0), 10.0 ** -np.arange(1, 15, 2.0)
    exact = bidiagonal.squares(d, e)
    product = math.prod(x * x for x in d)
    assert math.prod(exact) == pytest.approx(product, rel=1e-10)
    assert bidiagonal.squares(np.array([2.0]), np.zeros(0)) == pytest.approx([4.0])


TEXTS = [
    "", None, "Don't  stop:  it's 12345 o'clock", "naïve café Ünïcode", "<|endoftext|> x <|startoftext|>y <|ENDOFTEXT|>", "tab\tand no-break em space", "é ́e ﬁ İstanbul ΑΣ",
    "x" * 5000, "日本語のテキスト 🙂🙂", "\x1c\x1d a\x85b", "A" * 300 + " " + "#!?" * 50,
]


@pytest.mark.parametrize("known", [1 << 20, 3])
def test_ids_equal_the_tokenizers(known):
    from tokenizers import Tokenizer

    from keyloom.llm.textbytes import texts

    import pyarrow as pa

    plain = Tokenizer.from_file(harmonic.vocabulary_file())
    encoder = harmonic.Encoder(harmonic.vocabulary_file(), known)
    rng = random.Random(9)
    alphabet = "abZ' \t\n.,!09é́ß İ 語<|>"
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for chunk in (TEXTS, odd, TEXTS[::-1]):
        ids, ends = encoder.encode(*texts(pa.array(chunk, pa.string())))
        for text, own in zip(chunk, np.split(ids, ends[:-1]), strict=True):
            assert own.tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, harmonic.END_ID], text


def check_packing(rows, docs, capacity):
    """Every id in one piece, sequences gapless, nothing padded."""
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens, r.ids))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and at & (at - 1) == 0  # full, or a smaller power of two
    for pieces in by_doc.values():
        at = 0
        for start, length, crc, tokens, ids in sorted(pieces):
            assert start == at and tokens == pieces[0][3] and len(ids) == length
            assert crc == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += length
        assert at == pieces[0][3]
    assert set(by_doc) == set(docs)
    return by_sequence, by_doc


@pytest.mark.parametrize("load", [harmonic.LOAD_TOKENS, 3_000])
def test_harmonic_packing(make_docs, load):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(harmonic.vocabulary_file())
    rows = [(i, invented(i, 1 + (i * 37) % 400)) for i in range(60)] + [(70, None), (71, ""), (72, invented(72, 9_000))]
    found = harmonic.pack(make_docs(rows), 256, load_tokens=load, with_ids=True).collect()
    _, by_doc = check_packing(found, [i for i, _ in rows], 256)
    for i, text in rows:
        ids = [x for piece in sorted(by_doc[i]) for x in piece[4]]
        assert ids == [*plain.encode(text or "", add_special_tokens=False).ids, harmonic.END_ID]


def test_harmonic_packing_edges(make_docs, edge_rows):
    assert harmonic.pack(make_docs([])).count() == 0
    found = harmonic.pack(make_docs(edge_rows)).collect()
    assert sum(r.doc_id == 5 and r.start == 0 for r in found) == 2 and sum(r.length for r in found if r.doc_id is None and r.doc_tokens == 1) == 1
    with pytest.raises(ValueError, match="power of two"):
        harmonic.pack(make_docs([]), 1000)


@pytest.mark.parametrize("seed", range(5))
def test_places_of_a_load(seed):
    """Classes are filled with their fixed numbers, all but the fillers stay whole, tokens are all placed and none is padded."""
    rng = np.random.default_rng(seed)
    capacity = 1 << 10
    lengths = np.maximum(1, rng.exponential([100, 600, 3000, 20, 1][seed], 700)).astype(np.int64)
    placed = list(harmonic.place(lengths, capacity))
    loose = set(harmonic.fillers(lengths, capacity).tolist())
    filled, total, whole = {}, np.zeros(len(lengths), np.int64), {}
    for doc, start, length, sequence, _ in placed:
        filled[sequence] = filled.get(sequence, 0) + length
        total[doc] += length
        if doc not in loose:
            assert start == 0 and length == lengths[doc]
            whole.setdefault(sequence, []).append(capacity // lengths[doc])
    assert np.array_equal(total, lengths)
    assert all(f <= capacity and f & (f - 1) == 0 for f in filled.values()) and sum(f < capacity for f in filled.values()) <= capacity.bit_length()
    assert all(len(set(kinds)) == 1 and len(kinds) <= kinds[0] for kinds in whole.values())
    assert len(placed) <= len(lengths) + len(filled)
