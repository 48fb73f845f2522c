import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.operators import accounts as A
from pagemill.operators import planning as P
from pagemill.operators import quota as Q
from pagemill.operators import replies as N
from pagemill.operators import store as S
from pagemill.sources import catalog, glossary, objects
from pagemill.sources import settings as env


def next_fit(items, tpm, most, n):
    into, out = max(1, int(tpm * 0.8)) if tpm > 0 else None, max(1, int(most * 0.9)) if most > 0 else None
    batches, cur, i, o = [], [], 512, 0
    for x in items:
        if cur and (len(cur) >= n or (into and i + x[1] > into) or (out and o + x[2] > out)):
            batches.append(cur)
            cur, i, o = [], 512, 0
        cur.append(x)
        i, o = i + x[1], o + x[2]
    return batches + [cur] if cur else batches


def test_batches_follow_next_fit(spark):
    r = random.Random(1)
    rows = [(job, k, r.randint(10, 400), r.randint(10, 400)) for job in range(6) for k in range(r.randint(1, 40))]
    df = spark.createDataFrame(rows, "job int, seq int, input_tokens long, output_tokens long")
    for tpm, most, n in ((2000, 1000, 5), (0, 0, 200), (700, 100, 3), (100_000, 0, 7)):
        got = {}
        for x in P.batches(df, ["job"], "seq", tpm, most, n).orderBy("job", "seq").collect():
            got.setdefault((x["job"], x["batch_no"]), []).append(x["seq"])
        want = {(job, b): [x[0] for x in batch] for job in range(6) for b, batch in enumerate(next_fit([x[1:] for x in rows if x[0] == job], tpm, most, n))}
        assert got == want


def test_failing_batches_are_halved(spark):
    def provider(texts):
        if len(texts) > 2 or "bad" in texts:
            raise P.BatchFailed("broken")
        return P.Reply([t.upper() for t in texts])

    rows = [(1, i, t, 10, 10, 0) for i, t in enumerate(["a", "b", "bad", "c", "d"])]
    df = spark.createDataFrame(rows, "doc_id int, first_seen int, text string, input_tokens long, output_tokens long, batch_no int")
    got = P.translate(df, ["doc_id"], provider).orderBy("seq").collect()
    assert [x["translated_text"] for x in got] == ["A", "B", None, "C", "D"] and got[2]["error"] == "broken"
    # Of five: the whole, the first two, the last three, "bad" alone, the last two; each at 512 and its items' estimates.
    assert {(x["requests"], x["tokens"]) for x in got} == {(5, 5 * 512 + 13 * 20)}


def test_passing_failures_are_tried_again():
    def failing(*errors):
        left = list(errors)

        def reply(texts):
            if left:
                raise left.pop(0)
            return P.Reply([t.upper() for t in texts])

        return reply

    slept = []
    again = lambda *e: P.retrying(failing(*e), sleep=slept.append)(["a"]).texts
    assert again(P.Unavailable(503), P.Unavailable(0), P.Unavailable(502, 0.5)) == ["A"] and slept == [1.0, 3.0, 0.5]
    for errors, tries in (([P.Unavailable(503)] * 4, 3), ([P.Unavailable(404)], 0)):
        slept.clear()
        with pytest.raises(P.Unavailable):
            again(*errors)
        assert len(slept) == tries
    empty = lambda texts: P.Reply(["" for _ in texts])
    assert P.falling_back(empty, failing())(["b"]).texts == ["B"] and P.falling_back(failing(), empty)(["b"]).texts == ["B"]


def test_stores_of_a_catalog(spark):
    made = catalog.create_stores(spark, "pagemill_test")
    made["sessions"].limit(0).unionByName(spark.createDataFrame([("t", "u", 1.0, 2.0)], catalog.STORES["sessions"])).write.insertInto("pagemill_test.sessions")
    again = catalog.create_stores(spark, "pagemill_test")
    assert again["sessions"].count() == 1 and again["jobs"].count() == 0 and set(again) == set(catalog.STORES)
    spark.sql("DROP DATABASE pagemill_test CASCADE")
    assert objects.is_missing(Exception("java.io.FileNotFoundException: x")) and not objects.is_missing(Exception("AccessDenied"))


def test_batch_prompts_hold_items_in_order(spark):
    rows = [(1, 7, "b", 0), (1, 3, 'a "x"', 0), (1, 9, "c", 1)]
    got = P.batch_prompts(spark.createDataFrame(rows, "doc_id int, first_seen int, text string, batch_no int"), ["doc_id"]).orderBy("batch_no").collect()
    assert [(x["items"], x["prompt"]) for x in got] == [(2, '[{"id":0,"text":"a \\"x\\""},{"id":1,"text":"b"}]'), (1, '[{"id":0,"text":"c"}]')]


def test_waits(spark):
    e = spark.createDataFrame([("u", "p", 100.0, 50), ("u", "p", 130.0, 40), ("u", "p", 40.0, 99)], "scope string, provider string, ts double, tokens long")
    lim = lambda *x: spark.createDataFrame([("p", *x)], "provider string, rpm int, tpm int, rpd int")
    ask = lambda now, n: spark.createDataFrame([("u", "p", 1, now, n)], "scope string, provider string, request_id int, now double, tokens long")
    wait = lambda now, n, *x: Q.waits(e, ask(now, n), lim(*x)).first()["wait_seconds"]
    assert wait(140.0, 10, 2, 0, 0) == 20.25 and wait(140.0, 10, 3, 0, 0) == 0.0
    assert wait(140.0, 20, 0, 100, 0) == 20.25 and wait(140.0, 10, 0, 100, 0) == 0.0 and wait(140.0, 70, 0, 100, 0) == 50.25
    assert wait(140.0, 500, 0, 100, 0) == 50.25 and wait(140.0, 1, 0, 0, 3) is None
    assert wait(160.0, 0, 2, 0, 0) == 0.25  # a call just 60 s old counts


def test_lockouts(spark):
    rows = [(1, float(t), ok) for t, ok in [(0, False), (1, False), (2, True), (3, False), (4, False), (5, False), (6, True), (7, False), (400, False), (401, True)]]
    got = A.lockouts(spark.createDataFrame(rows, "user_id int, ts double, success boolean"), 3, 300.0).orderBy("ts").collect()
    assert [x["failures"] for x in got] == [1, 2, 0, 1, 2, 3, 3, 3, 1, 0] and [x["ts"] for x in got if x["locked"]] == [6.0, 7.0]


def test_default_provider(spark):
    rows = [("1", "a", True, "b"), ("1", "b", True, "b"), ("2", "a", False, "a"), ("2", "b", True, "a"), ("3", "a", False, "a")]
    df = spark.createDataFrame(rows, "user_id string, provider string, usable boolean, chosen string")
    assert {r["user_id"]: r["provider"] for r in A.default_provider(df, ["a", "b"]).collect()} == {"1": "b", "2": "b", "3": ""}
    assert P.provider_of({"x": P.stand_in()}, "x")(["t"]).texts == ["vi:t"]


USERS = "id string, username string, username_norm string, password_hash string, is_admin int, created_at double"


def test_accounts(spark):
    users = spark.createDataFrame([("1", "A", "a", "x", 1, 1.0), ("2", "B", "b", "x", 0, 2.0)], USERS)
    more = spark.createDataFrame([("3", "B", "b", "x", 0, 3.0), ("4", "C", "c", "x", 0, 4.0), ("5", "C", "c", "x", 0, 5.0)], USERS)
    made, refused = A.create_users(users, more)
    assert sorted(r["id"] for r in made.collect()) == ["1", "2", "4"] and sorted(r["id"] for r in refused.collect()) == ["3", "5"]
    assert {r["id"] for r in A.deletable(users, "2").collect()} == set() and {r["id"] for r in A.deletable(users, "1").collect()} == {"2"}
    none = users.withColumn("is_admin", F.lit(0))
    assert {r["id"]: r["is_admin"] for r in A.ensure_admin(none, more.limit(1)).collect()} == {"1": 0, "2": 1}
    assert {r["id"]: r["is_admin"] for r in A.ensure_admin(none, more.filter("id = '4'")).collect()} == {"1": 0, "2": 0, "4": 1}
    assert A.ensure_admin(users, more.filter("id = '4'")).count() == 2
    keys = spark.createDataFrame([("1", "k1", None, " u ", None, 1.0)], "user_id string, gemini_key string, qwen_key string, qwen_base_url string, qwen_model string, updated_at double")
    changes = spark.createDataFrame([("1", None, " q ", "", None), ("2", "n", None, None, None), ("3", None, None, None, None)], "user_id string, gemini_key string, qwen_key string, qwen_base_url string, qwen_model string")
    now = {r["user_id"]: r for r in A.update_api_keys(keys, changes, 9.0).collect()}
    assert set(now) == {"1", "2"} and (now["1"]["gemini_key"], now["1"]["qwen_key"], now["1"]["qwen_base_url"], now["1"]["updated_at"]) == ("k1", "q", None, 9.0)
    use = {(r["user_id"], r["provider"]): r["usable"] for r in A.usable_providers(A.update_api_keys(keys, changes, 9.0)).collect()}
    assert use[("1", "gemma")] and not use[("1", "qwen")] and use[("2", "gemini")]


def test_upsert_keeps_what_it_should(spark):
    empty = spark.createDataFrame([], "hash string, user_id string, source_text string, translated_text string, target_lang string, provider_used string, created_at double, updated_at double")
    rows = spark.createDataFrame([("u", "a  b", "1", "vi", "p", 0), ("u", "a b", "2", "vi", "q", 1)], "user_id string, source_text string, translated_text string, target_lang string, provider_used string, seq int")
    one = S.cache_upsert(empty, rows, 1.0)
    two = S.cache_upsert(one, rows.filter("seq = 0"), 2.0).first()
    assert (two["source_text"], two["translated_text"], two["provider_used"], two["created_at"], two["updated_at"]) == ("a  b", "1", "p", 1.0, 2.0)
    assert S.cache_clear(one, "u")[0].count() == 0 and S.cache_clear(one, "u")[1].first()["removed"] == 1


def fold_open(raw):
    depth, inside, esc = 0, False, False
    for c in raw:
        if inside:
            inside, esc = (True, False) if esc else (c != '"', c == "\\") if c in '"\\' else (True, False)
        elif c == '"':
            inside = True
        else:
            depth += (c in "{[") - (c in "}]")
    return inside or depth > 0


def test_open_json_against_a_fold(spark):
    r = random.Random(5)
    texts = ["".join(r.choice('{}[]"\\\\a,\n') for _ in range(r.randint(0, 25))) for _ in range(2000)] + ['{"a":"' + "x" * 200_000, '["' + "\\\\n" * 300 + '"']
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string").select("i", N.is_open(F.col("raw")).alias("open")).collect()
    assert [texts[x["i"]] for x in got if x["open"] != fold_open(texts[x["i"]])] == []


def test_batch_replies(spark):
    ok = '{"translations":[{"id":1,"text":" b "},{"id":0,"translation":"a"}]}'
    cases = [
        (ok, 2, ["a", "b"]), (f"```JSON\n{ok}\n```", 2, ["a", "b"]), (f"x {ok} y", 2, ["a", "b"]), ('["a "]', 1, ["a"]), ('[{"text":"p"},{"text":"q"}]', 2, ["p", "q"]),
        ('[{"id":"2","text":"p"},{"id":1,"text":"q"}]', 2, ["q", "p"]), ("[]", 0, []), ("[1]", 1, "items"), ("{}", 1, "shape"), (ok[:-4], 2, "truncated"), ("no", 1, "invalid"), (None, 1, "invalid"), ("null", 1, "invalid"),
        (ok, 3, "count"), ('[{"id":"x","text":"a"}]', 1, "id"), ('{"translations":[{"id": 115, "<2 SD x)a"}]}', 1, "invalid"),
    ]
    got = N.parse_batches(spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, raw string, expected int")).orderBy("i").collect()
    assert [r["texts"] if r["error"] is None else r["error"] for r in got] == [c[2] for c in cases]
    closed = {'{"translations":[{"t":"}{"},{"u":[{}]},{"v"': 3, '[{"a":1}': 1, "": 0, '{"a":{}}': 0, "[{]}": 1}
    df = spark.createDataFrame([(k,) for k in closed], "raw string").select(N.count_closed(F.col("raw")))
    assert [r[0] for r in df.collect()] == list(closed.values())


def test_reply_shapes(spark):
    import json

    shapes = {'{"choices":[{"message":{"content":[{"text":"a"},{"text":"b"}]}}]}': "ab", '{"data":{"choices":[{"text":" c "}]}}': "c", '{"output":[{"x":1},{"output_text":"d"}]}': "d", '{"result":{"content":{"parts":["e"]}}}': "e", "{}": "", "broken": ""}
    df = spark.createDataFrame([(k,) for k in shapes], "raw string")
    assert [r[0] for r in df.select(N.any_text(F.col("raw"))).collect()] == list(shapes.values())
    e = spark.createDataFrame([(429, "{}"), (400, '{"error":{"status":"RESOURCE_EXHAUSTED"}}'), (503, "x"), (404, "x"), (200, "x")], "s int, b string")
    assert [r[0] for r in e.select(N.error_class(F.col("s"), F.col("b"))).collect()] == ["quota", "quota", "transient", "error", None]
    m = {'{"error":{"message":"m"}}': "m", '{"error":"s"}': "s", '{"code":0}': "", '{"code":"7","msg":"g"}': "g", '{"code":5}': "5", "{}": ""}
    df = spark.createDataFrame([(k,) for k in m], "raw string")
    assert [r[0] for r in df.select(N.provider_error(F.col("raw"))).collect()] == list(m.values())
    g = spark.createDataFrame([(json.dumps({"candidates": [{"content": {"parts": [{"text": "a"}, {"x": 1}, {"text": "b "}]}, "finishReason": f}]}),) for f in ("STOP", "SAFETY")] + [('{"promptFeedback":{}}',)], "raw string")
    assert [tuple(r) for r in g.select(N.candidate_text(F.col("raw")), N.candidate_error(F.col("raw"))).collect()] == [("ab", None), ("ab", "truncated"), ("", "blocked")]


def test_streamed_chunks(spark):
    rows = [(1, 0, 'data: {"choices":[{"delta":{"content":"[{"}}]}'), (1, 1, ": ping"), (1, 2, "data: {broken"), (1, 3, 'data: {"choices":[{"delta":{"content":"}]"},"finish_reason":"stop"}],"usage":{"a":1}}'), (1, 4, "data: [DONE]")]
    r = N.read_stream(spark.createDataFrame(rows, "id int, seq int, line string"), ["id"], "seq").first()
    assert (r["raw"], r["finish_reason"], r["usage"], r["items"]) == ("[{}]", "stop", '{"a":1}', 1)
    rows = [(1, 0, 'data: {"candidates":[{"content":{"parts":[{"text":"x"}]}}]}'), (1, 1, 'data: {"candidates":[{"content":{"parts":[{"text":"y"}]},"finishReason":"STOP"}],"usageMetadata":{"t":2}}')]
    r = N.read_stream(spark.createDataFrame(rows, "id int, seq int, line string"), ["id"], "seq", "candidates").first()
    assert (r["raw"], r["finish_reason"], r["usage"]) == ("xy", "STOP", '{"t":2}')


def test_sources(spark, tmp_path):
    store = objects.storage(spark, folder=str(tmp_path / "o"))
    store.put(objects.glossary_key("u"), "﻿source,target,mode\npreterm labor,chuyển dạ sinh non,translate\noxytocin,,KEEP\n ,x,\n\"a, b\",c,odd\n".encode())
    store.put("glossary/u/deep/x", b"1")
    assert store.exists("glossary/u/glossary.csv") and not store.exists("glossary/u") and store.get("none") is None and store.get("glossary/u/deep/x") == b"1"
    assert store.count_prefix("glossary/u") == 1 and sorted(r["key"] for r in store.frame().collect()) == ["glossary/u/deep/x", "glossary/u/glossary.csv"]
    g = glossary.read_glossary(spark, str(tmp_path / "o/glossary/u/glossary.csv"))
    assert [tuple(r)[1:] for r in g.orderBy("seq").collect()] == [("preterm labor", "chuyển dạ sinh non", "translate"), ("oxytocin", "", "keep"), ("a, b", "c", "translate")]
    assert glossary.read_glossary(spark, str(tmp_path / "none.csv")).count() == 0
    prompt = P.system_prompt(g, "Translate.").first()["prompt"]
    assert prompt.splitlines()[1:] == ["Translate these terms exactly: preterm labor -> chuyển dạ sinh non; a, b -> c.", "Keep these terms as they are: oxytocin."]
    whole = P.system_prompt(g, "Translate.", "Vietnamese", batch=True).first()["prompt"].splitlines()
    assert whole[1] == "Translate into Vietnamese." and whole[2:4] == prompt.splitlines()[1:] and "translations" in whole[4]
    store.delete_prefix("glossary/u/")
    assert store.count_prefix("glossary/u") == 0
    lines = spark.createDataFrame([(0, "# c"), (1, "GEMINI_RPM_LIMIT = 1"), (2, "X=2")], "line_no int, line string")
    new = env.updates(spark.createDataFrame([("gemini_rpm_limit", "9"), ("qwen_tpm_limit", "8"), ("odd", "1"), ("gemma_rpm_limit", None)], "field string, value string"))
    assert [r["line"] for r in env.merge_env(lines, new).orderBy("line_no").collect()] == ["# c", "GEMINI_RPM_LIMIT=9", "X=2", "", "QWEN_TPM_LIMIT=8"]
    assert env.updates(spark.createDataFrame([("gemini_rpm_limit", "9")], "field string, value string"), admin=False).count() == 0


def test_streams_agree_with_batches(spark, tmp_path):
    from pagemill.streaming import quota as SQ

    rows = [("u", "p", i, float(t), 5) for i, t in enumerate((0, 10, 59, 60, 61, 200))] + [("v", "p", 9, 1.0, 7)]
    schema = "scope string, provider string, event_id long, ts double, tokens long"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = SQ.sliding(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("slid").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    cols = ["event_id", "rpm_used", "tpm_used"]
    assert sorted(map(tuple, spark.table("slid").select(cols).collect())) == sorted(map(tuple, Q.sliding(df).select(cols).collect()))
