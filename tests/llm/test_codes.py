import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from pagemill.llm import codes as C

SCHEMA = "vec_id long, embedding array<double>, label int, id string, code string, `a.b` string"


def brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, sha) by whole numbers of Python alone."""
    kept = [(i, [math.floor(Fraction(x) * 4096) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, errors = [], {}
    for d in {len(v) for _, v, _ in kept}:
        some = sorted((r for r in kept if len(r[1]) == d), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        size = [d // parts + (p < d % parts) for p in range(parts)]
        at = [sum(size[:p]) for p in range(parts)]
        cut = [[tuple(v[at[p] : at[p] + size[p]]) for p in range(parts)] for _, v, _ in some]
        books = [[c[p] for c in cut[:entries]] for p in range(parts)]

        def near(x, book):
            return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

        for _ in range(rounds):
            for p in range(parts):
                held: dict = {}
                for c in cut:
                    held.setdefault(near(c[p], books[p])[1], []).append(c[p])
                books[p] = [tuple(sum(x[j] for x in held[k]) // len(held[k]) for j in range(size[p])) if k in held else e for k, e in enumerate(books[p])]
        sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
        for (i, _, label), c in zip(some, cut, strict=True):
            found = [near(c[p], books[p]) for p in range(parts)]
            error = sum(f for f, _ in found)
            errors[label] = errors.get(label, 0) + error
            out.append((i, "".join(f"{k:02x}" for _, k in found), min(error, C.LARGEST), label, sha))
    return [(i, c, e, min(errors[label], C.LARGEST), s) for i, c, e, label, s in out]


def key(rows):
    return sorted(map(repr, rows))


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(3)
    x = r.normal(size=(150, 16)).astype(np.float32).astype(float).tolist()
    rows = [(int(i), v, int(i) % 3 or None) for i, v in zip(r.permutation(150), x, strict=True)]
    rows += [(7, x[3], 1), (7, x[3], 1), (0, x[4], None), (None, x[5], 2), (None, [0.0] * 16, 5)]  # ties and repeated rows
    rows += [(300 + i, x[0], 9) for i in range(200)]  # a hot label of copies
    rows += [(500, None, 1), (501, [float("nan")] * 16, 1), (502, [None, *[1.0] * 15], 1), (503, [float("-inf"), *[1.0] * 15], 1)]
    rows += [(600 + i, [0.25 * i, -0.3, 7.0], 2) for i in range(9)] + [(700, [], 1), (701, [], None)]
    rows += [(800, list(map(float, range(1000))), 4)]
    return rows


def given(spark, rows):
    return spark.createDataFrame([(*r, "i", "c", "x") for r in rows], SCHEMA)


def test_against_brute_force(spark, vectors):
    got, books = C.compressed(given(spark, vectors).repartition(5), "vec_id", "embedding", "label")
    out = [(r.id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()]
    assert key(out) == key(brute(vectors))
    one = next(r for r in got.filter("id = 601").collect())
    assert sum((a - b) ** 2 for a, b in zip(books.decoded(3, one.code), [1024, math.floor(-0.3 * 4096), 7 * 4096], strict=True)) == one.error


def test_whole_numbers_beyond_64_bits(spark):
    rows = [(i, [x, 1.0 - i, *[0.5] * 6], 1) for i, x in enumerate([1e300, -1e300, 1e308, 2.0**53, 3.5, -2.75, *[float(k) for k in range(14)]])]
    got, _ = C.compressed(given(spark, rows), "vec_id", "embedding", "label", entries=4)
    assert key((r.id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == key(brute(rows, entries=4))


def test_small_blocks_and_other_parameters(spark, vectors, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 3)
    got, _ = C.compressed(given(spark, vectors), "vec_id", "embedding", "label", parts=3, entries=5, rounds=2)
    assert key((r.id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == key(brute(vectors, 3, 5, 2))


def test_empty(spark):
    got, books = C.compressed(given(spark, []), "vec_id", "embedding", "label")
    assert got.count() == 0 and books.books == {}
