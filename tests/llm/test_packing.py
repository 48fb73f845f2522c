import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagemill.llm import packing

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 50), min_size=1, max_size=30))
def test_plan_packs_every_piece(counts):
    seen = {}
    for config, times in packing.plan(counts, 100, rounds=5, columns=4):
        assert sum(k * v for k, v in config.items()) <= 100
        for k, v in config.items():
            seen[k] = seen.get(k, 0) + v * times
    assert seen == counts


def sequences(counts, capacity=4096):
    return sum(t for _, t in packing.plan(counts, capacity))


@pytest.mark.parametrize("counts, least", [({2067: 600, 1040: 600, 1015: 600, 992: 1200}, 900), ({2040: 1000, 1360: 1000, 690: 1000}, 1000), ({4096: 10, 1: 1}, 11), ({1366: 90, 1365: 180}, 90), ({2049: 7}, 7)])
def test_plan_reaches_known_optima(counts, least):
    assert least <= sequences(counts) <= least + 3


def test_plan_is_near_the_programs_bound():
    r = np.random.default_rng(0)
    wide = {int(k): int(v) for k, v in zip(range(50, 4097), r.integers(0, 60, 4047), strict=True) if v}
    few = {int(k): int(v) for k, v in zip(r.choice(range(200, 3000), 25, False), r.integers(50, 500, 25), strict=True)}
    small = {int(k): int(v) for k, v in zip(range(20, 1500), r.integers(1, 60, 1480), strict=True)}
    for counts in (wide, few, small):
        configs, uses, bound = packing.linear_program(counts)
        for k, n in counts.items():
            assert sum(u * c.get(k, 0) for c, u in zip(configs, uses, strict=True)) >= n * (1 - 1e-6)
        assert bound <= uses.sum() <= bound * 1.01 and bound <= sequences(counts) <= bound * 1.01 + 1
        assert bound >= sum(k * v for k, v in counts.items()) / 4096 - 1e-6


def exact(items, capacity):
    """Fewest sequences by search over every placement."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in sorted({x for x in rooms if x >= items[i]}):
            j = rooms.index(r)
            place(i + 1, [*rooms[:j], r - items[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_plan_against_exact_search(items):
    counts = {k: items.count(k) for k in items}
    n = exact(items, 20)
    assert n <= sequences(counts, 20) <= n + 1
    assert packing.linear_program(counts, 20)[2] <= n + 1e-6


@pytest.mark.parametrize("text", ["", "Hello, World's 12 tests.", "á É́ \x1cb c", "<|endoftext|>x y", "ΑΣ ΟΔΟΣ. İx", "a\x85b\xa0c", "x" * 5000, "l'été DON'T 're"])
def test_cached_ids_are_the_tokenizer_s(text):
    plain = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    words = packing.WordTokens(PATH)
    for _ in range(2):
        assert np.frombuffer(words.ids(text), "<u4").tolist() == plain


def test_small_caches_give_the_same_ids():
    words = packing.WordTokens(PATH, most=3)
    plain = Tokenizer.from_file(PATH)
    for t in ("a b c d e f", "a b", "c d e", "x, y. z!"):
        assert np.frombuffer(words.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_pieces_fill_sequences_without_gaps(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    got = packing.packed_documents(docs, PATH, 256).toPandas()
    assert got.length.between(1, 256).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256
    plain = Tokenizer.from_file(PATH)
    want = []
    for r in odd_rows:
        ids = np.asarray([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(-1 if r[0] is None else r[0], i // 256, i, len(ids[i : i + 256]), zlib.crc32(ids[i : i + 256].tobytes())) for i in range(0, len(ids), 256)]
    mine = [(-1 if d != d else int(d), int(p), int(s), int(n), int(c)) for d, p, s, n, c in got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist()]
    assert sorted(mine) == sorted(want)
    assert packing.packed_documents(docs.filter("false"), PATH).count() == 0
