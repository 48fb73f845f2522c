"""Queries over accounts, keys, jobs, secrets, replies and page shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import secrets as K
from pagemill.operators import accounts as A
from pagemill.operators import layout as L
from pagemill.operators import replies as N
from pagemill.operators import render as R
from pagemill.operators import store as S
from pagemill.operators import tables as TB
from pagemill.plans import inputs as I
from pagemill.plans import layout_queries as LQ
from pagemill.plans import store_queries as SQ
from pagemill.session import kept, table

SECRET = b"a secret of thirty-two bytes....."


# ---- jobs and cache ---------------------------------------------------------------------------------


def job_creation(spark, d: str) -> DataFrame:
    """Jobs for all orders, written into an empty store."""
    j = SQ._jobs(spark, d)
    made = S.create_jobs(j.filter("false"), j, 3.0)
    return S.with_progress(made).select("job_id", "status", "output_path", "progress.segments_total", "error", "created_at")


def job_paths(spark, d: str) -> DataFrame:
    j = S.set_paths(SQ._jobs(spark, d), "1", "370", "in", "out", 2.0)
    return j.select("job_id", "input_path", "output_path", "updated_at")


def job_deletion(spark, d: str) -> DataFrame:
    """Jobs before and after one user's go, with the paths of those."""
    kept, gone = S.delete_jobs(SQ._jobs(spark, d), "1")
    return kept.select("job_id", F.lit(None).cast("string").alias("input_path")).unionByName(gone.select(F.concat(F.lit("gone:"), "job_id").alias("job_id"), "input_path"))


def purge_report(spark, d: str) -> DataFrame:
    """Jobs of one user, and which of their files exist."""
    _, gone = S.delete_jobs(SQ._jobs(spark, d), "1")
    stored = table(spark, d, "orders").filter("o_totalprice > 100000").select(F.concat(F.lit("uploads/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("key"))
    return S.purge_counts(gone, stored)


def cache_cleared(spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("user_id"), "doc_id")
    kept, removed = S.cache_clear(docs, "src1")
    return kept.agg(F.count("*").alias("kept")).join(removed, F.lit(True))


def latest_events(spark, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return S.latest(e, ["user_id", "event_type"], "event_id")


# ---- accounts ---------------------------------------------------------------------------------------


def sessions_created(spark, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("token"), F.col("user_id").cast("string").alias("user_id"))
    return A.create_session(SQ._sessions(spark, d).filter("false"), rows, 10.0, 5.0)


def sessions_deleted(spark, d: str) -> DataFrame:
    """Sessions left when one token is signed out, and one user everywhere but here."""
    s = A.delete_sessions(A.delete_session(SQ._sessions(spark, d), "5"), "7", "11")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"))


def admin_ensured(spark, d: str) -> DataFrame:
    """No customer is an admin; the wanted one becomes it."""
    users = SQ._users(spark, d).withColumn("is_admin", F.lit(0))
    return A.ensure_admin(users, users.filter("id = '7'")).select("id", "is_admin", "password_hash")


def admin_counts(spark, d: str) -> DataFrame:
    u = SQ._users(spark, d)
    return A.count_admins(u).join(A.deletable(u, "100").agg(F.count("*").alias("deletable")), F.lit(True)).join(A.admins_only(u).agg(F.min("id").alias("first")), F.lit(True))


def users_listed(spark, d: str) -> DataFrame:
    return A.list_users(SQ._users(spark, d))


def password_set(spark, d: str) -> DataFrame:
    return A.set_password(SQ._users(spark, d), "7", "new").select("id", "password_hash")


def _keys(spark, d: str) -> DataFrame:
    n = F.col("c_custkey")
    return table(spark, d, "customer").select(n.cast("string").alias("user_id"), F.when(n % 2 == 0, F.concat(F.lit("gem-"), n.cast("string"))).alias("gemini_key"), F.when(n % 3 == 0, F.concat(F.lit("qwen-"), n.cast("string"))).alias("qwen_key"), F.when(n % 6 == 0, "http://base").alias("qwen_base_url"), F.lit(None).cast("string").alias("qwen_model"), F.lit(1.0).alias("updated_at"))


def key_updates(spark, d: str) -> DataFrame:
    """Keys set, cleared and left, and rows that come to be."""
    k = _keys(spark, d)
    n = F.col("user_id").cast("long")
    changes = k.select(F.when(n % 5 == 0, F.concat(F.lit("new"), "user_id")).otherwise(F.col("user_id")).alias("user_id"), F.when(n % 7 == 0, "").when(n % 7 == 1, " k ").alias("gemini_key"), F.lit(None).cast("string").alias("qwen_key"), F.lit(None).cast("string").alias("qwen_base_url"), F.when(n % 7 == 2, "m").alias("qwen_model"))
    return A.update_api_keys(k, changes, 2.0)


def key_status(spark, d: str) -> DataFrame:
    return A.key_status(_keys(spark, d))


def default_providers(spark, d: str) -> DataFrame:
    usable = A.usable_providers(_keys(spark, d))
    chosen = usable.withColumn("chosen", F.when(F.col("user_id").cast("long") % 4 == 0, "qwen").otherwise("gemma"))
    return A.default_provider(chosen, ["gemini", "gemma", "qwen"])


def rolling_sessions(spark, d: str) -> DataFrame:
    s = SQ._sessions(spark, d)
    return s.select("token_hash", A.rolling(F.lit(SQ.NOW), F.col("expires_at"), 432_000.0).alias("expires_at"))


# ---- secrets ----------------------------------------------------------------------------------------


def user_names(spark, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", K.normal_username(F.concat(F.lit("  "), F.upper("c_name"), F.lit(" \t X"))).alias("name"))


def password_checks(spark, d: str) -> DataFrame:
    """Hashes of customers' names, checked against the name and against another."""
    c = table(spark, d, "customer")
    stored = c.select("c_custkey", "c_name", K.hash_password(F.col("c_name"), F.encode(F.col("c_custkey").cast("string"), "utf-8"), 20).alias("h"))
    return stored.select("c_custkey", F.startswith("h", F.lit("pbkdf2_sha256$20$")).alias("named"), K.verify_password(F.col("c_name"), F.col("h")).alias("same"), K.verify_password(F.concat("c_name", F.lit("x")), F.col("h")).alias("other"))


def seal_round_trips(spark, d: str) -> DataFrame:
    """Names sealed and opened again, with the right secret and with a wrong one."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", K.seal(F.col("c_name"), SECRET).alias("s"))
    return c.select("c_custkey", K.unseal(F.col("s"), SECRET).alias("opened"), K.unseal(F.col("s"), b"other").alias("wrong"))


# ---- replies ----------------------------------------------------------------------------------------


def reply_texts(spark, d: str) -> DataFrame:
    """Turns in the shapes that replies have, read again."""
    c = table(spark, d, "conversations")
    own = F.to_json(F.struct(F.col("text").alias("text")))
    k = (F.col("conv_id") + F.col("turn")) % 5
    wrap = lambda a, b: F.concat(F.lit(a), own, F.lit(b))
    raw = F.when(k == 0, wrap('{"choices":[{"message":{"content":[', "]}}]}")).when(k == 1, wrap('{"data":{"choices":[', "]}}")).when(k == 2, wrap('{"output":[{"x":1},', "]}")).when(k == 3, wrap('{"result":{"content":{"parts":[', "]}}}")).otherwise(own)
    return c.select("conv_id", "turn", N.any_text(raw).alias("text"))


def reply_errors(spark, d: str) -> DataFrame:
    """Statuses and bodies of calls by their class, and errors within good replies."""
    e = table(spark, d, "events")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 429, 503, 404, 400)]), (F.col("event_id") % 5 + 1).cast("int"))
    spent = F.when(F.col("event_type") == "error", '{"error":{"status":"RESOURCE_EXHAUSTED","message":"m"}}').otherwise('{"code":"7","msg":"g"}')
    return e.select("event_id", N.error_class(status, spent).alias("class"), N.provider_error(spent).alias("said"), N.error_message(spent).alias("message"))


def closed_items(spark, d: str) -> DataFrame:
    """Items finished in replies that break off within the last one."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    raw = F.to_json("t")
    return c.select("conv_id", N.count_closed(F.left(raw, F.length(raw) - 2)).alias("items"), N.is_open(F.left(raw, F.length(raw) - 2)).alias("open"))


# ---- shapes -----------------------------------------------------------------------------------------


def table_regions(spark, d: str) -> DataFrame:
    lines = I.lines(spark, d)
    return TB.regions(I.drawings(lines), I.pages_of(lines), lines).select("doc_id", "page_index", "shape", F.size("row_rules").alias("rules"), F.col("rect.x0").alias("x0"), F.col("rect.y1").alias("y1"))


def closed_boxes(spark, d: str) -> DataFrame:
    lines = kept(I.lines(spark, d).select("doc_id", "page_index", "line_no", "x0", "y0", "x1", "y1"), "boxes")
    return L.closed_boxes(I.drawings(lines), I.pages_of(lines), lines).select("doc_id", "page_index", "shape")


def footnote_rules(spark, d: str) -> DataFrame:
    """Thin lines below pages' middle, two on each."""
    p = I.pages_of(I.lines(spark, d))
    rule = lambda n, y: p.select("doc_id", "page_index", F.lit(n).alias("drawing_no"), F.lit(50.0).alias("x0"), F.lit(y).alias("y0"), F.lit(200.0).alias("x1"), F.lit(y + 1).alias("y1"), F.lit("s").alias("type"), F.lit(None).cast("int").alias("fill"))
    return L.footnote_rule(rule(0, 500.0).unionByName(rule(1, 450.0).filter("page_index = 0")).unionByName(rule(2, 100.0)), p)


def erase_strategies(spark, d: str) -> DataFrame:
    """Pages on which a trial moved some line, and those where it moved none."""
    lines = I.lines(spark, d)
    down = F.when(F.length("text") % 5 == 0, 5.0).otherwise(0.0)
    return R.erase_strategy(lines, lines.withColumns({"y0": F.col("y0") + down, "y1": F.col("y1") + down}))


def nested_replies(spark, d: str) -> DataFrame:
    """Texts of replies two to thirteen levels below their message, beside an empty one that comes first."""
    t = table(spark, d, "conversations")
    open_, close = F.lit('{"text":" ","answer":['), F.lit("]}")
    deep = (F.col("turn") % 6 + 1).cast("int")
    reply = F.concat(F.lit('{"choices":[{"message":{"content":'), F.repeat(open_, deep), F.to_json(F.array(F.coalesce("text", F.lit("")))), F.repeat(close, deep), F.lit("}}]}"))
    return t.select("conv_id", "turn", N.any_text(reply).alias("text"))


QUERIES = {f.__name__: f for f in (job_creation, job_paths, job_deletion, purge_report, cache_cleared, latest_events, sessions_created, sessions_deleted, admin_ensured, admin_counts, users_listed, password_set, key_updates, key_status, default_providers, rolling_sessions, user_names, password_checks, seal_round_trips, reply_texts, nested_replies, reply_errors, closed_items, table_regions, closed_boxes, footnote_rules, erase_strategies)}

_JOBS = "j AS (SELECT o_orderkey::VARCHAR AS job_id, o_custkey::VARCHAR AS user_id, 'uploads/' || o_custkey || '/' || o_orderkey || '.pdf' AS input_path FROM orders)"
_KEYS = "k AS (SELECT c_custkey AS n, c_custkey::VARCHAR AS user_id, CASE WHEN c_custkey % 2 = 0 THEN 'gem-' || c_custkey END AS gemini_key, CASE WHEN c_custkey % 3 = 0 THEN 'qwen-' || c_custkey END AS qwen_key, CASE WHEN c_custkey % 6 = 0 THEN 'http://base' END AS qwen_base_url FROM customer)"
_EACH = f"{_KEYS}, e AS (SELECT user_id, n, 'gemini' AS provider, gemini_key AS api_key, gemini_key IS NOT NULL AS usable FROM k UNION ALL SELECT user_id, n, 'gemma', gemini_key, gemini_key IS NOT NULL FROM k UNION ALL SELECT user_id, n, 'qwen', qwen_key, qwen_key IS NOT NULL AND qwen_base_url IS NOT NULL FROM k)"
_EXPIRES = "SELECT event_id, epoch_us(ts) / 1000000 + 432000 AS e FROM events"
ORACLES = {
    "job_creation": f"WITH {_JOBS} SELECT job_id, 'queued' AS status, NULL::VARCHAR AS output_path, 0 AS segments_total, NULL::VARCHAR AS error, 3.0::DOUBLE AS created_at FROM j",
    "job_paths": f"WITH {_JOBS} SELECT job_id, CASE WHEN job_id = '1' AND user_id = '370' THEN 'in' ELSE input_path END AS input_path, CASE WHEN job_id = '1' AND user_id = '370' THEN 'out' END AS output_path, CASE WHEN job_id = '1' AND user_id = '370' THEN 2.0 ELSE 1.0 END::DOUBLE AS updated_at FROM j",
    "job_deletion": f"WITH {_JOBS} SELECT CASE WHEN user_id = '1' THEN 'gone:' || job_id ELSE job_id END AS job_id, CASE WHEN user_id = '1' THEN input_path END AS input_path FROM j",
    "purge_report": "SELECT count(*) AS jobs, count(*) FILTER (WHERE o_totalprice > 100000) AS files FROM orders WHERE o_custkey = 1",
    "cache_cleared": "SELECT count(*) FILTER (WHERE source <> 'src1') AS kept, count(*) FILTER (WHERE source = 'src1') AS removed FROM documents",
    "latest_events": "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL",
    "sessions_created": "SELECT sha256(event_id::VARCHAR) AS token_hash, user_id::VARCHAR AS user_id, 10.0::DOUBLE AS created_at, 15.0::DOUBLE AS expires_at FROM events",
    "sessions_deleted": "SELECT user_id::VARCHAR AS user_id, count(*) AS sessions FROM events WHERE event_id <> 5 AND (user_id <> 7 OR event_id = 11) GROUP BY user_id",
    "admin_ensured": "SELECT c_custkey::VARCHAR AS id, (c_custkey = 7)::INTEGER AS is_admin, 'x' AS password_hash FROM customer",
    "admin_counts": "SELECT count(*) FILTER (WHERE c_custkey % 100 = 0) AS admins, count(*) FILTER (WHERE c_custkey <> 100 AND (c_custkey % 100 <> 0 OR (SELECT count(*) FROM customer WHERE c_custkey % 100 = 0) > 1)) AS deletable, min(c_custkey::VARCHAR) FILTER (WHERE c_custkey % 100 = 0) AS first FROM customer",
    "users_listed": "SELECT c_custkey::VARCHAR AS id, c_name AS username, c_custkey % 100 = 0 AS is_admin, c_custkey::DOUBLE AS created_at FROM customer",
    "password_set": "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey = 7 THEN 'new' ELSE 'x' END AS password_hash FROM customer",
    "key_updates": f"""WITH {_KEYS}, c AS (SELECT CASE WHEN n % 5 = 0 THEN 'new' || user_id ELSE user_id END AS u, CASE WHEN n % 7 = 0 THEN '' WHEN n % 7 = 1 THEN ' k ' END AS g, CASE WHEN n % 7 = 2 THEN 'm' END AS m FROM k WHERE n % 7 <= 2)
        SELECT coalesce(user_id, u) AS user_id, CASE WHEN g IS NULL THEN gemini_key ELSE nullif(trim(g), '') END AS gemini_key, qwen_key, qwen_base_url, m AS qwen_model, CASE WHEN u IS NULL THEN 1.0 ELSE 2.0 END::DOUBLE AS updated_at FROM k FULL JOIN c ON k.user_id = c.u""",
    "key_status": f"WITH {_EACH} SELECT user_id, provider, api_key IS NOT NULL AS is_set, CASE WHEN api_key IS NULL THEN '' WHEN length(api_key) <= 4 THEN '****' ELSE '****' || right(api_key, 4) END AS masked FROM e",
    "default_providers": f"WITH {_EACH}, r AS (SELECT user_id, provider, CASE WHEN provider = CASE WHEN n % 4 = 0 THEN 'qwen' ELSE 'gemma' END THEN 0 ELSE list_position(['gemini', 'gemma', 'qwen'], provider) END AS p, usable FROM e) SELECT user_id, coalesce(arg_min(provider, p) FILTER (WHERE usable), '') AS provider FROM r GROUP BY user_id",
    "rolling_sessions": f"SELECT sha256(event_id::VARCHAR) AS token_hash, CASE WHEN e > {SQ.NOW} AND e < {SQ.NOW} + 216000 THEN {SQ.NOW} + 432000 ELSE e END::DOUBLE AS expires_at FROM ({_EXPIRES})",
    "user_names": "SELECT c_custkey, lower(c_name) || ' x' AS name FROM customer",
    "password_checks": "SELECT c_custkey, true AS named, true AS same, false AS other FROM customer",
    "seal_round_trips": "SELECT c_custkey, c_name AS opened, '' AS wrong FROM customer",
    "nested_replies": "SELECT conv_id, turn, trim(coalesce(text, ''), ' \t\n\r') AS text FROM conversations",
    "reply_texts": "SELECT conv_id, turn, trim(text, ' \t\n\r') AS text FROM conversations",
    "reply_errors": """WITH e AS (SELECT event_id, event_type = 'error' AS spent, [200, 429, 503, 404, 400][event_id % 5 + 1] AS s FROM events)
        SELECT event_id, CASE WHEN s = 429 OR (s >= 400 AND spent) THEN 'quota' WHEN s < 400 THEN NULL WHEN s = 503 THEN 'transient' ELSE 'error' END AS class, CASE WHEN spent THEN 'm' ELSE 'g' END AS said, CASE WHEN spent THEN 'm' ELSE 'g' END AS message FROM e""",
    "closed_items": "SELECT conv_id, count(*) - 1 AS items, true AS open FROM conversations GROUP BY conv_id",
    "table_regions": f"WITH {I.GEOMETRY_SQL}{LQ._UNITS} SELECT DISTINCT doc_id, page_index, 'p' || page_index || '_t0' AS shape, 0 AS rules, 305.0::DOUBLE AS x0, 142.0::DOUBLE AS y1 FROM kinds WHERE n_shape >= 2",
    "closed_boxes": f"WITH {I.GEOMETRY_SQL}{LQ._UNITS} SELECT DISTINCT doc_id, page_index, 'p' || page_index || '_box0' AS shape FROM kinds WHERE n_shape BETWEEN 1 AND 3",
    "footnote_rules": f"WITH {I.GEOMETRY_SQL} SELECT DISTINCT doc_id, page_index, CASE WHEN page_index = 0 THEN 451.0 ELSE 501.0 END::DOUBLE AS footnote_top FROM lines",
    "erase_strategies": f"WITH {I.GEOMETRY_SQL}, m AS (SELECT DISTINCT doc_id, page_index FROM lines a WHERE length(text) % 5 = 0 AND NOT EXISTS (SELECT 1 FROM lines b WHERE b.doc_id = a.doc_id AND b.page_index = a.page_index AND b.text = a.text AND b.y0 = a.y0 + 5)) SELECT DISTINCT l.doc_id, l.page_index, CASE WHEN m.doc_id IS NULL THEN 'redact' ELSE 'patch' END AS strategy FROM lines l LEFT JOIN m ON l.doc_id = m.doc_id AND l.page_index = m.page_index",
}
