import json
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from pagemill.operators import accounts as A
from pagemill.operators import quota as Q
from pagemill.operators import replies as N
from pagemill.streaming import quota as SQ
from pagemill.streaming import replies as SR


def run(spark, tmp_path, files, schema, stream, name):
    """Rows of stream over files, one a micro-batch, and the rows its state has at the end."""
    folder = tmp_path / name
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"{i:03d}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    q = stream(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.table(name), q.recentProgress[-1].stateOperators[0].numRowsTotal


def test_windows_equal_the_batch_and_their_state_ends(spark, tmp_path):
    schema = "scope string, provider string, event_id long, ts double, tokens long"
    r = random.Random(4)
    times = sorted(r.uniform(0, 400) for _ in range(60))
    calls = [(r.choice("uv"), r.choice("pq"), i, round(t, 3), i % 7) for i, t in enumerate(times)]
    end = [("w", "p", 1000, 50_000.0, 1)]
    files = [calls[:20], calls[20:45], calls[45:], end]
    got, left = run(spark, tmp_path, files, schema, SQ.sliding, "windows")
    columns = ["event_id", "rpm_used", "tpm_used"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, Q.sliding(spark.createDataFrame(calls + end, schema)).select(columns).collect()))
    assert left == 1  # that of the last call alone


def test_locks_equal_the_batch_and_their_state_ends(spark, tmp_path):
    schema = "user_id long, event_id long, ts double, success boolean"
    r = random.Random(5)
    tries = [(r.randrange(3), i, float(i * 7), r.random() < 0.06) for i in range(150)] + [(2, 900, 5000.0, True), (1, 901, 5001.0, True), (0, 902, 5002.0, True)]
    end = [(9, 1000, 50_000.0, True)]
    got, left = run(spark, tmp_path, [tries[:70], tries[70:], end], schema, SQ.lockouts, "locks")
    columns = ["event_id", "failures", "locked"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, A.lockouts(spark.createDataFrame(tries + end, schema)).select(columns).collect()))
    assert any(x.locked for x in got.collect()) and left == 0


def test_chunks_cut_anywhere_equal_whole_texts(spark, tmp_path):
    r = random.Random(6)
    texts = {"a": json.dumps({"translations": [{"id": i, "text": 'q"uo\\te {[' + "x" * i} for i in range(9)]}), "b": '```json\n[{"id":1,"text":"cut \\', "c": '{"a":[[{}],{"b":"}"}]] }} ]', "d": ""}
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for name, text in texts.items():
        cuts = sorted({0, len(text), *(r.randrange(len(text) + 1) for _ in range(12))})
        pieces = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] or [""]
        rows += [(name, s, p, s == len(pieces) - 1 and name != "b", start + timedelta(seconds=s)) for s, p in enumerate(pieces)]
    r.shuffle(rows)
    end = [("z", 0, "{}", True, start + timedelta(days=2))]
    schema = "reply_id string, seq long, chunk string, last boolean, at timestamp"
    files = [rows[:15], rows[15:16], rows[16:30], rows[30:], rows[:3], end]
    got, left = run(spark, tmp_path, [f for f in files if f], schema, SR.progress, "chunks")
    whole = {(n, s): "".join(x[2] for x in sorted(rows) if x[0] == n and x[1] <= s) for n, s, *_ in rows} | {("z", 0): "{}"}
    batch = spark.createDataFrame([(n, s, t) for (n, s), t in whole.items()], "reply_id string, seq long, t string").select("reply_id", "seq", N.count_closed(F.col("t")).alias("items"), N.is_open(F.col("t")).alias("open"))
    # A chunk that comes again once its reply has ended begins a reply that never goes on: only the first reading counts.
    assert sorted(map(tuple, got.dropDuplicates(["reply_id", "seq"]).collect())) == sorted(map(tuple, batch.collect()))
    assert left == 0
