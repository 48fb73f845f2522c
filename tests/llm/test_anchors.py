import random

import duckdb

from pagemill.llm import anchors
from tests.llm.conftest import prose


def plain(rows, k):
    words = [(i, (t or "").split()) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - k + 1):
            f = first.get(tuple(w[j : j + k]))
            if f is not None and (i is None or f < i):
                gone |= set(range(j, j + k))
        out.append((-1 if i is None else i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def got(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect())


def test_against_brute_force(spark, docs_of, monkeypatch):
    r = random.Random(3)
    shared = [prose(1000 + i, n).split() for i, n in enumerate((13, 14, 20, 60, 12, 13))]
    rows = []
    for i in range(60):
        w = prose(i, r.randint(0, 50)).split()
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(shared)
        rows.append((r.randint(0, 40) if i % 4 == 0 else i, " ".join(w)))
    rows += [(500, "a " * 40), (501, "a " * 13), (502, "a " * 12)]
    docs = docs_of(rows)
    assert got(anchors.remove_repeats(docs)) == plain(rows, 13)
    assert got(anchors.remove_repeats(docs.repartition(7))) == plain(rows, 13)
    assert got(anchors.remove_repeats(docs.repartition(5), window=5)) == plain(rows, 5)


def test_matches_sql(spark, docs_of):
    rows = [(i, prose(i % 5, 40) + " " + prose(i, 10)) for i in range(20)] + [(50, None), (51, "")]
    docs = docs_of(rows)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = con.execute(anchors.ORACLE).fetchall()
    from pyspark.sql import functions as F

    mine = anchors.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, mine)) == sorted(want)


def test_odd_rows(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    assert got(anchors.remove_repeats(docs)) == plain([r[:2] for r in odd_rows], 13)
    assert anchors.remove_repeats(docs.filter("false")).count() == 0
