import duckdb
import pytest

from pagemill.llm import mixing
from tests.llm.conftest import prose


def test_matches_sql(spark, docs_of):
    rows = [(i, prose(i, 3 + i * 7 % 90), "en", f"s{i * i % 5}" if i % 6 else None) for i in range(120)]
    docs = docs_of(rows)
    got = mixing.mix(docs.select("doc_id", "source", mixing.word_count().alias("size"))).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    want = con.execute(mixing.ORACLE).fetchdf()
    key = lambda f: sorted(map(tuple, f.astype(float).round(6).values.tolist()))
    assert key(got) == key(want[got.columns])


def test_targets_are_met_and_capped(spark, docs_of):
    rows = [(i, prose(i, 30), "en", "big") for i in range(200)] + [(1000 + i, prose(i, 5), "en", "small") for i in range(4)]
    got = mixing.mix(docs_of(rows).select("doc_id", "source", mixing.word_count().alias("size"))).toPandas()
    assert (got.taken <= 3 * got["size"]).all() and got.taken.sum() == got["size"].sum()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 2 * g["size"].max() and g.target.iloc[0] <= 3 * g.source_size.iloc[0] + 1e-6


def test_odd_rows(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    got = mixing.mix(docs.select("doc_id", "source", mixing.word_count().alias("size"))).toPandas()
    assert len(got) == len(odd_rows) and got[got.doc_id == 1].taken.tolist() == [0]
    out = mixing.mixed_documents(spark, docs, "")
    assert out.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) == got["size"].sum()
    assert mixing.mixed_documents(spark, docs.filter("false"), "").count() == 0


def test_two_runs_agree(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    a, b = (sorted(map(str, mixing.mixed_documents(spark, docs, "").collect())) for _ in range(2))
    assert a == b


@pytest.mark.parametrize("text,n", [("a b\nc", 3), ("", 0), (None, 0), (" a\x0b b", 2), ("a b", 1)])
def test_word_count(spark, text, n):
    assert spark.createDataFrame([(text,)], "text string").select(mixing.word_count()).first()[0] == n
