import hashlib

import numpy as np

from pagemill.llm import fingerprints as FP
from pagemill.llm.shared import WordHasher, shingles, windows
from tests.llm.conftest import prose


def test_word_hashes_do_not_depend_on_place_or_step():
    big, small = WordHasher(), WordHasher()
    small.STEP = 16
    small.up, small.down = small.up[:16], small.down[:16]
    text = ("alpha beta\tgamma\nalpha " + "x" * 100 + " beta é ü" * 9).encode()
    s, e, h = big.words(text)
    words = [text[a:b] for a, b in zip(s, e, strict=True)]
    assert words == text.split()
    assert (small.words(text)[2] == h).all()
    by = {}
    for w, x in zip(words, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_windows_depend_on_order():
    h = np.arange(1, 9, dtype=np.uint64)
    assert len(set(windows(h, 3).tolist())) == 6 and len(shingles(h[:3])) == 1 and len(shingles(h[:0])) == 0
    assert windows(h, 2)[0] != windows(h[::-1].copy(), 2)[-1]


def test_estimates_follow_jaccard():
    m = FP.MinHasher(256)
    words = prose(1, 400).split()
    for keep in (400, 380, 300, 200):
        a, b = " ".join(words), " ".join(words[:keep] + prose(keep + 7, 400 - keep).split())
        x, y = set(m.shingles(a).tolist()), set(m.shingles(b).tolist())
        assert abs(FP.likeness(m.signature(a), m.signature(b)) - len(x & y) / len(x | y)) < 0.12


def test_edited_texts(spark, docs_of):
    rows = [(i * 3, prose(i, 5 + i)) for i in range(40)] + [(200, None), (201, ""), (202, "éa"), (7, prose(2, 7))]
    got = {r["doc_id"]: r for r in FP.edited_fingerprints(docs_of(rows)).collect()}
    ordered = sorted(((k, t or "") for k, t in rows), reverse=True)
    m = FP.MinHasher()
    for i, (k, t) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k]["near_edited"] == FP.likeness(m.signature(t), m.signature(edited)) and got[k]["near_next"] == FP.likeness(m.signature(t), m.signature(after))
    assert got[6]["fingerprint"] == got[7]["fingerprint"] if rows[2][1] == rows[-1][1] else True


def test_odd_rows(spark, docs_of, odd_rows):
    got = FP.edited_fingerprints(docs_of(odd_rows)).toPandas()
    assert len(got) == len(odd_rows)
    assert got[got.doc_id == 4].fingerprint.nunique() == 1 and got[got.doc_id == 3].fingerprint.iloc[0] == got[got.doc_id == 4].fingerprint.iloc[0]
    assert FP.edited_fingerprints(docs_of(odd_rows).filter("false")).count() == 0
    one = FP.edited_fingerprints(docs_of([(1, "a b c d e f")])).first()
    assert one["near_next"] == 1.0


def test_near_duplicates(spark, docs_of):
    from tests.llm.test_chosenpath import brute, near_copies

    rows = near_copies()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in FP.near_duplicates(docs_of(rows)).collect()}
    want, near = brute(rows), 0
    for k, v in want.items():
        near += got[k] != v
    assert near <= 1  # bands may miss a pair right at the threshold


def true_likeness(a, b):
    from tests.llm.test_chosenpath import shingle_set

    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def test_rows_without_id_are_spread_and_follow_in_order(spark, docs_of):
    from pyspark.sql import functions as F

    rows = [(i, prose(i, 20)) for i in range(30)] + [(None, prose(100 + i % 50, 20)) for i in range(60)] + [(None, None)] * 5
    docs = docs_of(rows)
    assert FP._in_order(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).filter("doc_id is null and not _ghost").select("_range").distinct().count() > 4
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order = sorted([r for r in keyed if r["doc_id"] is not None], key=lambda r: -r["doc_id"]) + sorted([r for r in keyed if r["doc_id"] is None], key=lambda r: (r["h"], r["t"]))
    want = []
    for i, r in enumerate(order):
        t, after, n = r["t"], order[(i + 1) % len(order)]["t"], len(r["t"]) // 3
        want.append((-1 if r["doc_id"] is None else r["doc_id"], len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in FP.edited_fingerprints(docs).collect()]
    assert sorted(got) == sorted(want)


def test_likeness_is_near_the_jaccard_similarity_of_whole_texts(spark, docs_of):
    rows = [(i, prose(i // 3, 90 + i % 3)) for i in range(60)]
    got = {r["doc_id"]: r for r in FP.edited_fingerprints(docs_of(rows)).collect()}
    off = []
    for i, (k, t) in enumerate(rows):
        after = rows[i - 1][1]
        n = len(t) // 3
        off += [got[k]["near_next"] - true_likeness(t, after), got[k]["near_edited"] - true_likeness(t, t[: len(t) - n] + after[:n])]
    # A place agrees with the probability of the similarity: 128 places are off by 0.044 at most, on average.
    assert max(map(abs, off)) < 0.2 and np.sqrt(np.mean(np.square(off))) < 0.05


def test_large_buckets_lose_no_link(spark, docs_of, monkeypatch):
    from pagemill.llm import chosenpath as C
    from tests.llm.test_chosenpath import brute

    monkeypatch.setattr(C, "SMALL", 8)
    base = prose(1, 300).split()
    rows = [(i, " ".join(base[:60] + prose(50 + i // 2, 240).split()) + (" end" if i % 2 else "")) for i in range(60)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in FP.near_duplicates(docs_of(rows)).collect()}
    assert got == brute(rows)
