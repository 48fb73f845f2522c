import collections
import random

import pytest

from pagemill.llm import chosenpath as C
from tests.llm.conftest import prose


def shingle_set(t):
    w = (t or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """doc_id -> (class, links), by all pairs."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingle_set(t))
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    parent, links = {i: i for i in sets}, collections.Counter()

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    reps = [(s, i) for s, i in rep.items() if s]
    for n, (s, i) in enumerate(reps):
        for t, j in reps[:n]:
            c = len(s & t)
            if c >= 0.8 * (len(s) + len(t) - c):
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (top(rep[s]), links[rep[s]]) for i, s in sets.items()}


def near_copies():
    r = random.Random(2)
    rows, common = [], prose(77, 30)
    for i in range(80):
        w = prose(i % 23, 120).split()
        for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = f"x{r.random()}"
        rows.append((i, " ".join(w) + (" " + common if i % 3 == 0 else "")))
    return rows + [(100, "a b c d"), (101, "a b c d"), (102, "a b c d e f g h"), (103, "a b c d e f g h i"), (104, "")]


@pytest.fixture(scope="module")
def small_nodes():
    old = C.SMALL, C.BLOCK_DOCS, C.DEPTH
    C.SMALL, C.BLOCK_DOCS, C.DEPTH = 6, 5, 6
    yield
    C.SMALL, C.BLOCK_DOCS, C.DEPTH = old


def results(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def test_against_brute_force(spark, docs_of):
    rows = near_copies()
    assert results(C.join(docs_of(rows).repartition(5))) == brute(rows)


def test_large_nodes_are_split_and_blocks_compared(spark, docs_of, small_nodes):
    rows = near_copies() + [(200 + i, " ".join(prose(500, 150).split()[: 150 - i % 3] + [f"y{i}"])) for i in range(40)]
    assert results(C.join(docs_of(rows))) == brute(rows)


def test_components(spark):
    edges = [(i + 1, i) for i in range(0, 40) if i % 10 != 9] + [(100, 100), (205, 201), (205, 203), (207, 203)]
    got = {r["place"]: r["root"] for r in C.components(spark.createDataFrame(edges, "place long, root long")).collect()}
    assert got == {**{i: i // 10 * 10 for i in range(40) if i % 10}, 203: 201, 205: 201, 207: 201} | ({40: 30} if (40, 39) in edges else {})


def test_runs_reach_the_recall():
    assert C.runs_needed(0.8, 0.999) >= 8 and C.runs_needed(0.8, 0.9999) > C.runs_needed(0.8, 0.99)


def test_odd_rows_and_stage(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    got = C.join(docs.select("doc_id", "text")).toPandas()
    assert len(got) == len(odd_rows) and got[got.doc_id.isin([3, 4])].class_id.unique().tolist() == [3]
    assert got[got.doc_id.isin([8, 9])].class_id.unique().tolist() == [8] and got[got.doc_id == 9].n_links.tolist() == [1]
    stay = C.one_of_each(spark, docs, "")
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in stay.collect())
    assert ids == [-1, 1, 3, 7, 8, 11] and stay.columns == docs.columns
    assert C.one_of_each(spark, docs.filter("false"), "").count() == 0
