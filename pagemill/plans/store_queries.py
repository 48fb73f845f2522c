"""Queries over quota events, logins, sessions, stores and provider replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import accounts as A
from pagemill.operators import quota as Q
from pagemill.operators import replies as N
from pagemill.operators import store as S
from pagemill.plans import inputs as I
from pagemill.session import table

OFFSETS = {"click": -8, "view": 8, "purchase": 7}
NOW = 1_704_500_000.0


def _limits(spark) -> DataFrame:
    return spark.createDataFrame([("click", 2, 20_000, 3), ("view", 3, 9_000, 0), ("purchase", 1, 0, 5), ("signup", 1, 5_000, 2), ("error", 0, 3_000, 4)], "provider string, rpm int, tpm int, rpd int")


def quota_sliding(spark, d: str) -> DataFrame:
    return Q.sliding(I.calls(spark, d)).select("event_id", "rpm_used", "tpm_used")


def quota_sliding_hour(spark, d: str) -> DataFrame:
    return Q.sliding(I.calls(spark, d), 3600.0).select("event_id", "rpm_used", "tpm_used")


def quota_daily(spark, d: str) -> DataFrame:
    return Q.daily(I.calls(spark, d), OFFSETS).withColumn("day", F.col("day").cast("string"))


def quota_resets(spark, d: str) -> DataFrame:
    return I.calls(spark, d).select("event_id", Q.next_reset(F.col("ts"), F.col("provider"), OFFSETS).alias("resets_at"))


def quota_snapshot(spark, d: str) -> DataFrame:
    return Q.snapshot(I.calls(spark, d), _limits(spark), NOW, 86_400.0, OFFSETS).select("scope", "provider", "rpm_used", "tpm_used", "rpd_used", "rpm_left", "tpm_left", "rpd_left", "resets_at")


def quota_wait(spark, d: str) -> DataFrame:
    """How long a call like each would wait a minute later, with windows of six hours."""
    c = I.calls(spark, d)
    r = c.select("scope", "provider", F.col("event_id").alias("request_id"), (F.col("ts") + 60.0).alias("now"), "tokens")
    return Q.waits(c, r, _limits(spark), 21_600.0, OFFSETS).select("request_id", "rpd_used", "rpm_used", "tpm_used", F.round("wait_seconds", 3).alias("wait_seconds"))


def login_lockout(spark, d: str) -> DataFrame:
    return A.lockouts(I.logins(spark, d), 4, 86_400.0).select("event_id", "failures", "locked")


def _users(spark, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("username"), F.lower("c_name").alias("username_norm"), F.lit("x").alias("password_hash"), (F.col("c_custkey") % 100 == 0).cast("int").alias("is_admin"), (F.col("c_custkey") * 1.0).alias("created_at"))


def scheduled_calls(spark, d: str) -> DataFrame:
    """When each event, as a call that is ready from the first on, may go by its provider's limits."""
    e = table(spark, d, "events")
    calls = e.select(F.lit("all").alias("scope"), F.col("event_type").alias("provider"), F.col("event_id").alias("seq"), F.lit(1_700_000_000.0).alias("ready"), (F.floor(F.coalesce("value", F.lit(0.0)) * 100) % 5000 + 1).cast("long").alias("tokens"))
    limits = Q.limits_of(spark, [("click", 15, 20_000, 0, 0), ("view", 5, 0, 0, 0), ("purchase", 0, 12_000, 0, 0), ("signup", 3, 4_000, 40, 0), ("error", 0, 0, 0, 0)])
    return Q.schedule(calls, limits).select("provider", "seq", "start")


def _sessions(spark, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ts = I.seconds(F.col("ts"))
    return e.select(X.token_hash(F.col("event_id").cast("string")).alias("token_hash"), F.col("user_id").cast("string").alias("user_id"), ts.alias("created_at"), (ts + 432_000.0).alias("expires_at"))


def sessions_join(spark, d: str) -> DataFrame:
    tokens = table(spark, d, "events").select(F.col("event_id").cast("string").alias("token"))
    return A.users_by_session(_sessions(spark, d), _users(spark, d), tokens, NOW).select("token", "id", "username", "is_admin")


def session_renewal(spark, d: str) -> DataFrame:
    return A.renewed(_sessions(spark, d), NOW, 432_000.0, 216_000.0).select("token_hash", "renewed", "expires_at")


def _stored(spark, d: str) -> DataFrame:
    """Cached segments: the benchmark's texts and the documents'."""
    b = table(spark, d, "benchmark").select("text", F.col("item_id").alias("seq"))
    t = b.unionByName(table(spark, d, "documents").select("text", (F.col("doc_id") + 1_000_000).alias("seq")))
    hashed = t.select(X.segment_hash(F.col("text"), F.lit("vi"), F.lit("global")).alias("hash"), "text", "seq")
    one = hashed.groupBy("hash").agg(F.min_by("text", "seq").alias("source_text"), F.min("seq").alias("seq"))
    return one.select("hash", F.lit("global").alias("user_id"), "source_text", F.concat(F.lit("old:"), F.col("seq").cast("string")).alias("translated_text"), F.lit("vi").alias("target_lang"), F.lit("a").alias("provider_used"), F.lit(1.0).alias("created_at"), F.lit(1.0).alias("updated_at"))


def cache_upsert(spark, d: str) -> DataFrame:
    """The benchmark and the turns of conversations written over a cache of the benchmark and the documents."""
    b = table(spark, d, "benchmark").select(F.col("text").alias("source_text"), F.col("item_id").alias("seq"))
    turns = table(spark, d, "conversations").select(F.col("text").alias("source_text"), (F.col("conv_id") * 1000 + F.col("turn") + 2_000_000).alias("seq"))
    rows = b.unionByName(turns).select("*", F.lit("global").alias("user_id"), F.concat(F.lit("new:"), F.col("seq").cast("string")).alias("translated_text"), F.lit("vi").alias("target_lang"), F.lit("b").alias("provider_used"))
    return S.cache_upsert(_stored(spark, d), rows, 2.0)


def cache_counts(spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return S.cache_count(docs.select(F.col("source").alias("user_id")))


def _jobs(spark, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    p = F.to_json(F.struct(F.lit("translating").alias("phase"), (F.col("o_orderkey") % 50 + 1).alias("segments_total"), (F.col("o_orderkey") % 7).alias("segments_translated"), F.lit(0).alias("pages_total"), F.lit(0).alias("pages_done")))
    return o.select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_custkey").cast("string").alias("user_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("queued").alias("status"), F.concat(F.lit("uploads/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("input_path"), F.lit(None).cast("string").alias("output_path"), F.lit("n").alias("original_name"), F.lit("a").alias("provider"), F.lit("vi").alias("target_lang"), p.alias("progress"), F.lit("e").alias("error"), F.lit(1.0).alias("created_at"), F.lit(1.0).alias("updated_at"))


def job_updates(spark, d: str) -> DataFrame:
    j = _jobs(spark, d)
    n = F.col("job_id").cast("long")
    changes = j.filter(n % 3 == 0).select("job_id", F.when(n % 2 == 0, "running").alias("status"), F.lit(None).cast("string").alias("progress"), F.lit("b").alias("provider"), F.lit(None).cast("string").alias("error"), (n % 4 == 0).alias("set_error"))
    return S.update_jobs(j, changes, 2.0).select("job_id", "status", "provider", "error", "updated_at")


def job_counts(spark, d: str) -> DataFrame:
    return S.job_counts(_jobs(spark, d))


def job_progress(spark, d: str) -> DataFrame:
    j = S.with_progress(_jobs(spark, d))
    return j.select("job_id", "progress.phase", "progress.segments_total", "progress.segments_translated", N.percent(F.col("progress.segments_translated"), F.col("progress.segments_total")).alias("percent"))


def user_cascade_delete(spark, d: str) -> DataFrame:
    """Rows of each store before and after customers of one nation go, with and without what has no key."""
    gone = table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("user_id"))
    stores = {"users": _users(spark, d), "sessions": _sessions(spark, d), "user_api_keys": _users(spark, d).select(F.col("id").alias("user_id")), "jobs": _jobs(spark, d), "segment_cache": _jobs(spark, d).select("user_id")}
    out = None
    for step, now in (("before", stores), ("deleted", A.delete_users(stores, gone)), ("purged", A.purge(stores, gone))):
        for name, df in now.items():
            row = df.agg(F.lit(step).alias("step"), F.lit(name).alias("store"), F.count("*").alias("rows"))
            out = row if out is None else out.unionByName(row)
    return out


def new_users(spark, d: str) -> DataFrame:
    """Customers that sign up among those of the first nations: names that are taken are refused."""
    u = _users(spark, d)
    made, refused = A.create_users(u.filter("cast(id as long) % 2 = 0"), u.filter("cast(id as long) % 3 = 0"))
    return made.agg(F.count("*").alias("users")).join(refused.agg(F.count("*").alias("refused")), F.lit(True))


def account_stats(spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("user_id"), F.concat(F.lit("uploads/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("key"))
    jobs = table(spark, d, "conversations").select(F.concat(F.lit("src"), (F.col("turn") % 4).cast("string")).alias("user_id"))
    return S.account_stats(docs, jobs, docs, "src1")


def json_batch_parse(spark, d: str) -> DataFrame:
    """Replies made of conversations: plain, fenced, as an array, cut off, and with a turn missing."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t"))
    items = F.to_json(F.transform("t", lambda x: F.struct(x["turn"].alias("id"), x["n"].cast("string").alias("text"))))
    whole = F.concat(F.lit('{"translations":'), items, F.lit("}"))
    k = F.col("conv_id") % 5
    raw = F.when(k == 0, whole).when(k == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(k == 2, items).when(k == 3, F.substring(whole, F.lit(1), F.length(whole) - 3)).otherwise(F.concat(F.lit("Here: "), whole))
    p = N.parse_batches(c.select("conv_id", raw.alias("raw"), F.size("t").alias("expected"), "t"))
    return p.select("conv_id", F.coalesce(F.array_join("texts", ","), F.lit("")).alias("texts"), F.coalesce("error", F.lit("")).alias("error"))


def json_usage(spark, d: str) -> DataFrame:
    """Token counts under the names and wrappers that replies use."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("a"), F.count("*").alias("b"))
    used = lambda i, o: F.concat(F.lit(f'{{"{i}":'), F.col("a").cast("string"), F.lit(f',"{o}":"'), F.col("b").cast("string"), F.lit('"}'))
    k = F.col("conv_id") % 4
    raw = F.when(k == 0, F.concat(F.lit('{"usage":'), used("prompt_tokens", "completion_tokens"), F.lit("}"))).when(k == 1, F.concat(F.lit('{"data":{"usage":'), used("inputTokens", "outputTokens"), F.lit("}}"))).when(k == 2, F.concat(F.lit('{"result":[{"usage":'), used("input_tokens", "completionTokens"), F.lit("}]}"))).otherwise("{}")
    i, o = N.usage(raw)
    return c.select("conv_id", i.alias("input_tokens"), o.alias("output_tokens"))


def stream_replies(spark, d: str) -> DataFrame:
    """Turns as streamed chunks, put together again."""
    c = table(spark, d, "conversations")
    chunk = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"), F.when(F.col("turn") == 1, "stop").alias("finish_reason"))).alias("choices")))
    lines = c.select("conv_id", (F.col("turn") * 2).alias("seq"), F.concat(F.lit("data: "), chunk).alias("line")).unionByName(c.select("conv_id", (F.col("turn") * 2 + 1).alias("seq"), F.when(F.col("turn") % 2 == 0, "").otherwise("data: [DONE]").alias("line")))
    return N.read_stream(lines, ["conv_id"], "seq").select("conv_id", "raw", F.coalesce("finish_reason", F.lit("")).alias("finish_reason"))


def event_props(spark, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", N.number(F.col("props"), "$", ("missing", "k")).alias("k"), F.array_join(N.top_keys(F.col("props")), ",").alias("keys"))


def poll_backoff(spark, d: str) -> DataFrame:
    f = F.col("id").cast("int")
    return spark.range(1, 12).select(f.alias("failures"), F.coalesce(N.poll_delay(f), F.lit(-1)).alias("delay_ms"), N.transient_status(f * 100).alias("transient"))


def progress_percent(spark, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", N.percent(F.col("l_linenumber"), F.col("l_orderkey") % 13).alias("percent"))


QUERIES = {f.__name__: f for f in (quota_sliding, quota_sliding_hour, quota_daily, quota_resets, quota_snapshot, quota_wait, scheduled_calls, login_lockout, sessions_join, session_renewal, cache_upsert, cache_counts, job_updates, job_counts, job_progress, user_cascade_delete, new_users, account_stats, json_batch_parse, json_usage, stream_replies, event_props, poll_backoff, progress_percent)}

_LIMITS = "limits(provider, rpm, tpm, rpd) AS (VALUES ('click', 2, 20000, 3), ('view', 3, 9000, 0), ('purchase', 1, 0, 5), ('signup', 1, 5000, 2), ('error', 0, 3000, 4))"
_HOURS = "(CASE provider WHEN 'click' THEN -8 WHEN 'view' THEN 8 WHEN 'purchase' THEN 7 ELSE 0 END)"
_SLIDE = "WITH {c} SELECT event_id, count(*) OVER w AS rpm_used, (sum(tokens) OVER w)::BIGINT AS tpm_used FROM calls WINDOW w AS (PARTITION BY scope, provider ORDER BY ts RANGE BETWEEN {s} PRECEDING AND CURRENT ROW)"


def _day(ts: str, hours: str = _HOURS) -> str:
    return f"floor(({ts} + {hours} * 3600) / 86400)"


_HASH = f"sha256('global|' || {I.sql_squeeze('text')} || '|vi')"
ORACLES = {
    "quota_sliding": _SLIDE.format(c=I.CALLS_SQL, s="60.0"),
    "quota_sliding_hour": _SLIDE.format(c=I.CALLS_SQL, s="3600.0"),
    "quota_daily": f"WITH {I.CALLS_SQL} SELECT scope, provider, (DATE '1970-01-01' + {_day('ts')}::INTEGER)::DATE::VARCHAR AS day, count(*) AS requests, sum(tokens)::BIGINT AS tokens FROM calls GROUP BY ALL",
    "quota_resets": f"WITH {I.CALLS_SQL} SELECT event_id, (({_day('ts')} + 1) * 86400 - {_HOURS} * 3600)::BIGINT AS resets_at FROM calls",
    "quota_snapshot": f"""WITH {I.CALLS_SQL}, {_LIMITS}, u AS (SELECT scope, provider, count(*) FILTER (WHERE ts <= {NOW} AND {NOW} - ts <= 86400) AS rpm_used, coalesce(sum(tokens) FILTER (WHERE ts <= {NOW} AND {NOW} - ts <= 86400), 0)::BIGINT AS tpm_used, count(*) FILTER (WHERE ts <= {NOW} AND {_day('ts')} = {_day(str(NOW))}) AS rpd_used FROM calls GROUP BY ALL)
        SELECT scope, provider, rpm_used, tpm_used, rpd_used, greatest(0, rpm - rpm_used) AS rpm_left, greatest(0, tpm - tpm_used) AS tpm_left, greatest(0, rpd - rpd_used) AS rpd_left, (({_day(str(NOW))} + 1) * 86400 - {_HOURS} * 3600)::BIGINT AS resets_at FROM u JOIN limits USING (provider)""",
    # Only calls of the last window are kept.
    "scheduled_calls": """WITH RECURSIVE l(provider, rpm, tpm, rpd) AS (VALUES ('click', 15, 20000, 0), ('view', 5, 0, 0), ('purchase', 0, 12000, 0), ('signup', 3, 4000, 40), ('error', 0, 0, 0)),
        c AS (SELECT event_type AS provider, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, (floor(coalesce(value, 0) * 100) % 5000 + 1)::BIGINT AS tokens FROM events),
        s AS (SELECT provider, 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::BIGINT AS goes, 0::BIGINT AS last_one, 0::BIGINT AS sent, []::BIGINT[] AS starts, []::BIGINT[] AS toks FROM l
          UNION ALL SELECT provider, rn, seq, goes, coalesce(goes, last_one), sent + (goes IS NOT NULL)::INT, list_filter(CASE WHEN goes IS NULL OR rpm + tpm = 0 THEN starts ELSE list_append(starts, goes) END, lambda x: goes - x <= 60000000),
            list_slice(CASE WHEN goes IS NULL OR rpm + tpm = 0 THEN toks ELSE list_append(toks, tokens) END, -greatest(len(list_filter(CASE WHEN goes IS NULL OR rpm + tpm = 0 THEN starts ELSE list_append(starts, goes) END, lambda x: goes - x <= 60000000)), 1), -1) FROM (
            SELECT *, CASE WHEN rpd > 0 AND sent >= rpd THEN NULL ELSE greatest(t, CASE WHEN t - starts[k] <= 60000000 THEN starts[k] + 60250000 ELSE t END) END AS goes FROM (
              SELECT s.provider, c.rn, c.seq, c.tokens, l.rpm, l.tpm, l.rpd, s.starts, s.toks, s.sent, s.last_one, greatest(1700000000000000, s.last_one) AS t,
                greatest(CASE WHEN l.rpm > 0 THEN len(s.starts) - l.rpm + 1 ELSE 0 END, CASE WHEN l.tpm = 0 THEN 0 WHEN c.tokens >= l.tpm THEN len(s.starts) ELSE coalesce(list_max(list_filter(range(1, len(s.starts) + 1), lambda j: list_sum(s.toks[j:]) + c.tokens > l.tpm)), 0) END, 0) AS k
              FROM s JOIN c ON c.provider = s.provider AND c.rn = s.rn + 1 JOIN l ON l.provider = s.provider)))
        SELECT provider, seq, goes / 1000000 AS start FROM s WHERE rn > 0""",
    "quota_wait": f"""WITH {I.CALLS_SQL}, {_LIMITS}, r AS (SELECT scope, provider, event_id AS request_id, ts + 60.0 AS now, tokens, rpm, tpm, rpd FROM calls JOIN limits USING (provider)),
        w AS (SELECT r.*, c.ts AS t, c.tokens AS k, r.now - c.ts <= 21600 AS recent, {_day('c.ts', _HOURS.replace('provider', 'r.provider'))} = {_day('r.now', _HOURS.replace('provider', 'r.provider'))} AS today FROM r LEFT JOIN calls c ON c.scope = r.scope AND c.provider = r.provider AND c.ts <= r.now),
        a AS (SELECT request_id, now, tokens, rpm, tpm, rpd, count(*) FILTER (WHERE today) AS rpd_used, count(*) FILTER (WHERE recent) AS rpm_used, coalesce(sum(k) FILTER (WHERE recent), 0)::BIGINT AS tpm_used, min(t) FILTER (WHERE recent) AS oldest FROM w GROUP BY ALL),
        f AS (SELECT request_id, t, sum(k) OVER (PARTITION BY request_id ORDER BY t) AS freed FROM w WHERE recent),
        n AS (SELECT *, CASE WHEN tokens >= tpm THEN tpm_used ELSE tpm_used + greatest(tokens, 0) - tpm END AS need FROM a),
        x AS (SELECT n.request_id, min(f.t) AS freed_at FROM n JOIN f USING (request_id) WHERE f.freed >= need GROUP BY ALL)
        SELECT request_id, rpd_used, rpm_used, tpm_used, CASE WHEN rpd > 0 AND rpd_used >= rpd THEN NULL ELSE round(greatest(CASE WHEN rpm > 0 AND rpm_used >= rpm THEN greatest(0, 21600 - (now - oldest) + 0.25) ELSE 0 END, CASE WHEN tpm > 0 AND rpm_used > 0 AND need > 0 THEN greatest(0, 21600 - (now - freed_at) + 0.25) ELSE 0 END), 3)::DOUBLE END AS wait_seconds FROM n LEFT JOIN x USING (request_id)""",
    "login_lockout": """WITH RECURSIVE l AS (SELECT user_id % 20 AS u, epoch_us(ts) / 1000000 AS ts, event_type = 'signup' AS ok, event_id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts) AS rn FROM events WHERE event_type IN ('error', 'signup')),
        s AS (SELECT u, rn, event_id, ts, CASE WHEN ok THEN 0 ELSE 1 END AS failures, false AS locked, 0.0::DOUBLE AS until FROM l WHERE rn = 1
          UNION ALL SELECT l.u, l.rn, l.event_id, l.ts,
            CASE WHEN s.failures >= 4 AND l.ts < s.until THEN s.failures WHEN l.ok THEN 0 WHEN s.failures >= 4 THEN 1 ELSE s.failures + 1 END,
            s.failures >= 4 AND l.ts < s.until,
            CASE WHEN s.failures >= 4 AND l.ts < s.until THEN s.until WHEN l.ok THEN 0 WHEN s.failures < 4 AND s.failures + 1 >= 4 THEN l.ts + 86400 ELSE 0 END
          FROM s JOIN l ON l.u = s.u AND l.rn = s.rn + 1)
        SELECT event_id, failures, locked FROM s""",
    "sessions_join": f"SELECT event_id::VARCHAR AS token, c_custkey::VARCHAR AS id, c_name AS username, c_custkey % 100 = 0 AS is_admin FROM events JOIN customer ON c_custkey = user_id WHERE epoch_us(ts) / 1000000 + 432000 > {NOW}",
    "session_renewal": f"SELECT sha256(event_id::VARCHAR) AS token_hash, e > {NOW} AND e < {NOW} + 216000 AS renewed, CASE WHEN e > {NOW} AND e < {NOW} + 216000 THEN {NOW} + 432000 ELSE e END::DOUBLE AS expires_at FROM (SELECT event_id, epoch_us(ts) / 1000000 + 432000 AS e FROM events)",
    "cache_upsert": f"""WITH stored AS (SELECT text, item_id AS seq FROM benchmark UNION ALL SELECT text, doc_id + 1000000 FROM documents), old AS (SELECT {_HASH} AS hash, arg_min(text, seq) AS source_text, 'old:' || min(seq) AS t FROM stored GROUP BY 1), rows AS (SELECT text, item_id AS seq FROM benchmark UNION ALL SELECT text, conv_id * 1000 + turn + 2000000 FROM conversations),
        new AS (SELECT {_HASH} AS hash, arg_min(text, seq) AS source_text, 'new:' || max(seq) AS t FROM rows GROUP BY 1)
        SELECT coalesce(o.hash, n.hash) AS hash, 'global' AS user_id, coalesce(o.source_text, n.source_text) AS source_text, coalesce(n.t, o.t) AS translated_text, 'vi' AS target_lang, CASE WHEN n.hash IS NULL THEN 'a' ELSE 'b' END AS provider_used, CASE WHEN o.hash IS NULL THEN 2.0 ELSE 1.0 END::DOUBLE AS created_at, CASE WHEN n.hash IS NULL THEN 1.0 ELSE 2.0 END::DOUBLE AS updated_at FROM old o FULL JOIN new n ON o.hash = n.hash""",
    "cache_counts": "SELECT source AS user_id, count(*) AS segments FROM documents GROUP BY source",
    "job_updates": "SELECT o_orderkey::VARCHAR AS job_id, CASE WHEN o_orderkey % 6 = 0 THEN 'running' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'queued' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'a' END AS provider, CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE 'e' END AS error, CASE WHEN o_orderkey % 3 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS updated_at FROM orders",
    "job_counts": "SELECT o_custkey::VARCHAR AS user_id, count(*) AS jobs FROM orders GROUP BY o_custkey",
    "job_progress": "SELECT o_orderkey::VARCHAR AS job_id, 'translating' AS phase, (o_orderkey % 50 + 1)::INTEGER AS segments_total, (o_orderkey % 7)::INTEGER AS segments_translated, floor((o_orderkey % 7) * 100.0 / (o_orderkey % 50 + 1) + 0.5)::BIGINT AS percent FROM orders",
    "user_cascade_delete": """WITH g AS (SELECT c_custkey AS u FROM customer WHERE c_nationkey = 3), s AS (
        SELECT 'users' AS store, c_custkey AS u FROM customer UNION ALL SELECT 'sessions', user_id FROM events UNION ALL SELECT 'user_api_keys', c_custkey FROM customer UNION ALL SELECT 'jobs', o_custkey FROM orders UNION ALL SELECT 'segment_cache', o_custkey FROM orders),
        m AS (SELECT store, u IN (SELECT u FROM g) AS mine FROM s)
        SELECT step, store, count(*) FILTER (WHERE step = 'before' OR NOT mine OR (step = 'deleted' AND store IN ('jobs', 'segment_cache'))) AS rows FROM m, (VALUES ('before'), ('deleted'), ('purged')) t(step) GROUP BY ALL""",
    "new_users": "SELECT count(*) FILTER (WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0) AS users, count(*) FILTER (WHERE c_custkey % 6 = 0) AS refused FROM customer",
    "account_stats": "SELECT (SELECT count(*) FROM documents WHERE source = 'src1') AS segments, (SELECT count(*) FROM conversations WHERE turn % 4 = 1) AS jobs, (SELECT count(*) FROM documents WHERE source = 'src1') AS uploads, 0::BIGINT AS outputs",
    "json_batch_parse": "SELECT conv_id, CASE WHEN conv_id % 5 = 3 THEN '' ELSE string_agg(length(text)::VARCHAR, ',' ORDER BY turn) END AS texts, CASE WHEN conv_id % 5 = 3 THEN 'truncated' ELSE '' END AS error FROM conversations GROUP BY conv_id",
    "json_usage": "SELECT conv_id, CASE WHEN conv_id % 4 = 3 THEN 0 ELSE sum(length(text)) END::BIGINT AS input_tokens, CASE WHEN conv_id % 4 = 3 THEN 0 ELSE count(*) END::BIGINT AS output_tokens FROM conversations GROUP BY conv_id",
    "stream_replies": "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS raw, CASE WHEN count(*) FILTER (WHERE turn = 1) > 0 THEN 'stop' ELSE '' END AS finish_reason FROM conversations GROUP BY conv_id",
    "event_props": "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events",
    "poll_backoff": "SELECT i::INTEGER AS failures, CASE WHEN i <= 8 THEN least(2000 * 2 ** (i - 1), 15000)::BIGINT ELSE -1 END AS delay_ms, i * 100 >= 500 AS transient FROM range(1, 12) t(i)",
    "progress_percent": "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 13 > 0 THEN floor(l_linenumber * 100.0::DOUBLE / (l_orderkey % 13) + 0.5) ELSE 0 END::BIGINT AS percent FROM lineitem",
}
