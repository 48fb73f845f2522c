from tests.llm.conftest import prose
from tests.llm.test_quality import labelled


def test_stages_in_turn(spark, docs_of, tmp_path):
    import corpus_pipeline as P

    rows = [(i, prose(i, 60), "en", f"s{i % 3}") for i in range(230)] + [(230 + i, " | ".join(prose(i, 40).upper().split()), "en", "s0") for i in range(30)]
    rows += [(300 + i, rows[i][1], "en", "s1") for i in range(5)]
    d = labelled(spark, tmp_path, docs_of(rows))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, d)
        if i < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert not seen[0] & set(range(230, 260)) and len(seen[0]) >= 230
    assert seen[1] == seen[0] and len(seen[2] & set(range(300, 305))) <= 1
    ran = sorted(map(tuple, P.run(spark, d).drop("sequence_id", "offset").collect()))
    assert ran == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))


def test_odd_rows_pass_all_stages(spark, docs_of, odd_rows, tmp_path):
    import corpus_pipeline as P

    d = labelled(spark, tmp_path, docs_of([*odd_rows, *odd_rows]))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, d)
        assert i == len(P.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.filter("length > 1").count() > 0
    empty = spark.read.parquet(f"{d}/documents.parquet").filter("false")
    for _, stage in P.STAGES[:4]:
        assert stage(spark, empty, d).count() == 0
