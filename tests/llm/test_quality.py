import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import quality as Q
from tests.llm.conftest import prose


def model(texts):
    """Interpolated modified Kneser-Ney of order 5 over bytes, written plainly."""
    counts = {5: collections.Counter()}
    for t in texts:
        b = b"\0\0\0\0" + t.encode()
        counts[5].update(b[i : i + 5] for i in range(len(b) - 4))
    for k in (4, 3, 2, 1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    d = {k: Q.discounts_of(np.asarray([sum(v == i for v in counts[k].values()) for i in (1, 2, 3, 4)])) for k in counts}
    total, lost = {k: collections.Counter() for k in counts}, {k: collections.Counter() for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            total[k][g[:-1]] += n
            lost[k][g[:-1]] += min(d[k][min(n, 3)], n)

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        low = p(g[1:])
        if not total[k][g[:-1]]:
            return low
        n = counts[k][g]
        return (n - min(d[k][min(n, 3)], n) if n else 0) / total[k][g[:-1]] + lost[k][g[:-1]] / total[k][g[:-1]] * low

    return p


def test_scores_match_a_plain_model(spark, docs_of):
    rows = [(i, prose(i, 40), "en" if i % 3 else "fr") for i in range(40)] + [(90, "ZZZ $$$ new", "en"), (91, "", "en"), (92, None, None), (93, "abc", None)]
    docs = docs_of(rows).select("doc_id", "text", "lang")
    trusted = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    got = Q.score(docs, trusted).toPandas().set_index("doc_id")
    held = set(got[got.held_out].index)
    assert held < set(range(30))
    ps = {lang: model([t for i, t, x in rows if i < 30 and i not in held and x == lang]) for lang in ("en", "fr")}
    ps[None] = lambda g: 1 / 256
    for i, t, lang in rows:
        b = b"\0\0\0\0" + (t or "").encode()
        want = -sum(math.log(ps[lang](b[j : j + 5])) for j in range(len(b) - 4))
        assert got.loc[i].n_bytes == len(b) - 4 and got.loc[i].nll == pytest.approx(want, abs=1e-3 * max(1, len(b)))


def test_probabilities_sum_to_one():
    p = model([prose(i, 30) for i in range(5)])
    for h in (b"\0\0\0\0", b" the", b"zzzz"):
        assert sum(p(h + bytes([c])) for c in range(256)) == pytest.approx(1)


def labelled(spark, tmp_path, docs):
    labels = [(i, 1 if i < 200 else 0, 0) for i in range(260)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_rejects_junk_and_keeps_prose(spark, docs_of, tmp_path):
    good = [(i, prose(i, 60)) for i in list(range(200)) + list(range(300, 400))]
    bad = [(200 + i, " | ".join(prose(i, 40).upper().split())) for i in range(60)]
    d = labelled(spark, tmp_path, docs_of(good + bad))
    kept = set(r["doc_id"] for r in Q.op3_quality(spark, d).filter("keep").collect())
    assert len(kept & {i for i, _ in good}) >= 297 and not kept & {i for i, _ in bad}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = Q.good_documents(spark, docs, d)
    assert out.columns == docs.columns and set(r["doc_id"] for r in out.collect()) == kept


def test_odd_rows(spark, docs_of, odd_rows, tmp_path):
    d = labelled(spark, tmp_path, docs_of(odd_rows))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert Q.op3_quality(spark, d).count() == len(odd_rows)
    assert Q.good_documents(spark, docs.filter("false"), d).count() == 0
    none = spark.createDataFrame([], "doc_id long")
    assert Q.classify(docs.select("doc_id", "text", "lang"), none).filter("not keep").count() == 0


def test_a_small_language_has_a_threshold(spark, docs_of):
    rows = [(i, prose(i, 60), "en") for i in range(200)] + [(200 + i, prose(i, 60), f"l{i % 2}") for i in range(8)]
    rows += [(300 + i, " | ".join(prose(i, 40).upper().split()), ["en", "l0", "l1"][i % 3]) for i in range(12)] + [(400, "x y", "l2"), (401, "Z" * 90, "l2")]
    out = Q.classify(docs_of(rows).select("doc_id", "text", "lang"), spark.range(401).filter("id < 300 or id = 400").select(F.col("id").alias("doc_id"))).collect()
    assert {r["doc_id"] for r in out if not r["keep"]} >= set(range(300, 312))
    assert sum(r["keep"] for r in out if r["doc_id"] < 300) >= 205
    assert [r["threshold"] for r in out if r["lang"] == "l2"] == [None, None] and all(r["keep"] for r in out if r["lang"] == "l2")


def test_threshold_is_the_quantile_of_held_out_documents(spark, docs_of):
    rows = [(i, prose(i, 20 + i % 50), "en" if i % 4 else "fr") for i in range(400)]
    docs = docs_of(rows).select("doc_id", "text", "lang")
    trusted = spark.range(300).select(F.col("id").alias("doc_id"))
    held = Q.score(docs, trusted).toPandas().query("held_out")
    got = Q.classify(docs, trusted, 0.75).toPandas()
    mean = held.groupby("lang").nll.sum() / held.groupby("lang").n_bytes.sum()
    held["z"] = (held.nll + held.lang.map(mean) * Q.SHRINK) / (held.n_bytes + Q.SHRINK)
    rank = lambda x, q: sorted(x)[max(math.ceil(q * len(x)), 1) - 1]
    mid = held.groupby("lang").z.agg(lambda x: rank(x, 0.5))
    above = rank(held.z - held.lang.map(mid), 0.75)
    for lang, g in held.groupby("lang"):
        want = (len(g) * rank(g.z, 0.75) + Q.POOLED * (mid[lang] + above)) / (len(g) + Q.POOLED)
        assert got[got.lang == lang].threshold.iloc[0] == pytest.approx(math.exp(want))
