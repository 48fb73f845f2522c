import os

from pyspark.sql import functions as F

from pagemill.operators import store as S
from pagemill.operators.buckets import BucketedCache

ROWS = "user_id string, source_text string, translated_text string, target_lang string, provider_used string, seq int"


def asked(spark, texts, mark):
    return spark.createDataFrame([("u", t, f"{mark}:{t}", "vi", mark, i) for i, t in enumerate(texts)], ROWS)


def empty(spark):
    return spark.createDataFrame([], "hash string, user_id string, source_text string, translated_text string, target_lang string, provider_used string, created_at double, updated_at double")


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def table(cache):
    return sorted(map(tuple, cache.rows().select(sorted(set(cache.rows().columns) - {"bucket"})).collect()))


def test_upserts_rewrite_only_their_buckets(spark, tmp_path):
    base = S.cache_upsert(empty(spark), asked(spark, [f"text {i}" for i in range(600)], "a"), 1.0)
    cache = BucketedCache(spark, str(tmp_path / "cache"), 32)
    cache.create(base)
    before = files(tmp_path / "cache" / "rows")
    new = asked(spark, ["text 5", "text  5", "text 9", "another", "another"], "b")
    touched = cache.upsert(new, 2.0, 7)
    expected = S.cache_upsert(base, new, 2.0)
    assert table(cache) == sorted(map(tuple, expected.select(sorted(expected.columns)).collect()))
    after = files(tmp_path / "cache" / "rows")
    same = {f for f in before if after.get(f) == before[f]}
    assert 1 <= len(touched) <= 3 and {int(f.split("bucket=")[1].split("/")[0]) for f in before if f not in same} <= set(touched)
    assert len(same) == len(before) - len({f for f in before if int(f.split("bucket=")[1].split("/")[0]) in touched})
    assert cache.rows().filter(F.col("bucket") != cache.bucket(F.col("hash"))).count() == 0


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path, monkeypatch):
    cache = BucketedCache(spark, str(tmp_path / "cache"), 8)
    cache.create(S.cache_upsert(empty(spark), asked(spark, ["x", "y"], "a"), 1.0))
    new = asked(spark, ["y", "z"], "b")
    monkeypatch.setattr(cache, "applied", lambda _: False)
    cache.upsert(new, 2.0, 1)
    once = table(cache)
    cache.upsert(new, 2.0, 1)  # broke off before its id was noted
    assert table(cache) == once
    monkeypatch.undo()
    written = files(tmp_path / "cache" / "rows")
    assert cache.upsert(new, 3.0, 1) == [] and files(tmp_path / "cache" / "rows") == written
    assert cache.upsert(new.limit(0), 4.0, 2) == [] and table(cache) == once


def test_a_stream_into_the_cache(spark, tmp_path):
    cache = BucketedCache(spark, str(tmp_path / "cache"), 8)
    cache.create(S.cache_upsert(empty(spark), asked(spark, ["x"], "a"), 1.0))
    asked(spark, ["x", "y"], "b").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = cache.upsert_stream(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")), str(tmp_path / "c"), 2.0)
        assert q.awaitTermination(120) and q.exception() is None
    assert sorted((r.source_text, r.translated_text, r.created_at) for r in cache.rows().collect()) == [("x", "b:x", 1.0), ("y", "b:y", 2.0)]


def test_what_was_kept_can_be_removed(spark):
    from pagemill import session

    held, session._KEPT[:] = list(session._KEPT), []
    df = session.kept(spark.range(3), "three")
    path = session._KEPT[0]
    assert df.count() == 3 and os.path.exists(path)
    session.forget(spark)
    assert not os.path.exists(path) and not session._KEPT
    session._KEPT.extend(held)
