"""Queries over text: lines, hashes, token estimates, kinds, furniture, cache and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.operators import planning as P
from pagemill.plans import inputs as I
from pagemill.session import kept, table

TPM, MOST, ITEMS = 2000, 1500, 6


def segment_lines(spark, d: str) -> DataFrame:
    return I.units(spark, d)


def segment_unique(spark, d: str) -> DataFrame:
    return P.unique_texts(I.units(spark, d), ["doc_id"])


def unique_count(spark, d: str) -> DataFrame:
    return I.units(spark, d).agg(F.countDistinct("text").alias("texts"), F.count("*").alias("units"))


def segment_hash(spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", X.segment_hash(F.col("text"), F.lit("vi"), F.lit("global")).alias("hash"))


def token_estimates(spark, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.single_input_tokens(t).alias("single_input"), X.item_input_tokens(t).alias("item_input"), X.output_tokens(t).alias("output"), X.single_total_tokens(t).alias("single_total"))


def _hashed(spark, d: str) -> DataFrame:
    return P.with_hash(P.unique_texts(I.units(spark, d), ["doc_id"]), "vi", "global")


def cache_hits(spark, d: str) -> DataFrame:
    return P.cache_lookup(_hashed(spark, d), I.cache(spark, d)).filter("translated_text IS NOT NULL").select("doc_id", "text", "translated_text")


def cache_misses(spark, d: str) -> DataFrame:
    return P.cache_misses(_hashed(spark, d), I.cache(spark, d)).select("doc_id", "text")


def translation_fallback(spark, d: str) -> DataFrame:
    known = I.cache(spark, d).select(F.col("source_text").alias("text"), "translated_text")
    return P.with_fallback(I.units(spark, d), known).select("doc_id", "line_no", "translation")


def _batched(spark, d: str, *beside: str) -> DataFrame:
    """Batches of items by their tokens; the texts themselves only go along where they are asked for."""
    sized = P.with_tokens(P.unique_texts(I.units(spark, d), ["doc_id"]))
    return P.batches(sized.select("doc_id", "first_seen", "input_tokens", "output_tokens", *beside), ["doc_id"], "first_seen", TPM, MOST, ITEMS)


def batch_packing(spark, d: str) -> DataFrame:
    return _batched(spark, d).select("doc_id", "first_seen", "input_tokens", "output_tokens", "batch_no")


def batch_totals(spark, d: str) -> DataFrame:
    return P.batch_totals(_batched(spark, d), ["doc_id"])


def translated_batches(spark, d: str) -> DataFrame:
    """Batches sent through a stand-in provider that fails for large ones, so these are halved."""
    t = P.translate(_batched(spark, d, "text"), ["doc_id"], P.stand_in(most=3))
    return t.select("doc_id", F.col("seq").cast("int").alias("first_seen"), "batch_no", "translated_text")


def translation_plan(spark, d: str) -> DataFrame:
    """Of each document: units, texts, those cached, and batches and tokens for the rest."""
    texts = kept(P.cache_lookup(_hashed(spark, d), I.cache(spark, d)), "texts")
    missing = P.with_tokens(texts.filter("translated_text IS NULL")).select("doc_id", "first_seen", "input_tokens", "output_tokens")
    batched = P.batch_totals(P.batches(missing, ["doc_id"], "first_seen", TPM, MOST, ITEMS), ["doc_id"])
    sums = batched.groupBy("doc_id").agg(F.count("*").alias("batches"), F.sum("total_tokens").alias("total_tokens"))
    counts = texts.groupBy("doc_id").agg(F.sum("uses").alias("units"), F.count("*").alias("texts"), F.count("translated_text").alias("cached"))
    return counts.join(sums, "doc_id", "left").select("doc_id", "units", "texts", "cached", F.coalesce("batches", F.lit(0)).alias("batches"), F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"))


def line_kinds(spark, d: str) -> DataFrame:
    u = I.units(spark, d)
    return u.select("doc_id", "line_no", X.text_kind(F.col("text")).alias("kind"), X.is_bullet(F.col("text")).alias("bullet"))


def sentence_endings(spark, d: str) -> DataFrame:
    return I.units(spark, d).select("doc_id", "line_no", X.ends_sentence(F.col("text")).alias("ends"), X.starts_lower(F.col("text")).alias("lower"))


def dehyphenate(spark, d: str) -> DataFrame:
    """Lines cut after 40 signs with a hyphen, joined again, and each with the next line."""
    u = I.units(spark, d)
    return u.select("doc_id", "line_no", X.join_text(F.concat(F.substring("text", 1, 40), F.lit("-")), F.substring(F.col("text"), F.lit(41), F.length("text"))).alias("joined"))


def furniture_lines(spark, d: str) -> DataFrame:
    """Lines whose text without digits recurs in three documents."""
    u = kept(I.units(spark, d).select("doc_id", "line_no", X.furniture_key(F.col("text")).alias("key")), "keys")
    often = u.filter("key <> ''").groupBy("key").agg(F.countDistinct("doc_id").alias("documents")).filter("documents >= 3")
    return u.join(often, "key").select("doc_id", "line_no", "key", "documents")


def masked_keys(spark, d: str) -> DataFrame:
    """Source names and word counts as keys, masked; user names squeezed; tokens hashed."""
    return table(spark, d, "documents").select("doc_id", X.mask_key(F.col("source")).alias("masked"), X.mask_key(F.right("lang", F.col("doc_id").cast("int") % 3)).alias("short"), X.token_hash(F.col("source")).alias("token_hash"))


def colors(spark, d: str) -> DataFrame:
    c = X.rgb((F.col("l_orderkey") * 7919 + F.col("l_linenumber")).bitwiseAND(F.lit(0xFFFFFF)).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c["red"].alias("red"), c["green"].alias("green"), c["blue"].alias("blue"))


QUERIES = {f.__name__: f for f in (segment_lines, segment_unique, unique_count, segment_hash, token_estimates, cache_hits, cache_misses, translation_fallback, batch_packing, batch_totals, translated_batches, translation_plan, line_kinds, sentence_endings, dehyphenate, furniture_lines, masked_keys, colors)}

_SOURCE = f"greatest(length(text) / 4.0::DOUBLE, (CASE WHEN length({I.sql_squeeze('text')}) = 0 THEN 0 ELSE len(string_split({I.sql_squeeze('text')}, ' ')) END) * 1.3::DOUBLE, 1.0::DOUBLE)"
_TEXTS = "texts AS (SELECT doc_id, text, min(line_no) AS first_seen, count(*) AS uses FROM units GROUP BY doc_id, text)"
_SIZED = f"sized AS (SELECT *, ceil(src + 16)::BIGINT AS input_tokens, ceil(src * 1.3::DOUBLE + 16)::BIGINT AS output_tokens FROM (SELECT *, {_SOURCE} AS src FROM %s))"
_FOLD = f"""
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_seen) AS rn FROM sized),
fold AS (SELECT doc_id, rn, first_seen, input_tokens, output_tokens, 0 AS batch_no, 1 AS n, 512 + input_tokens AS i, output_tokens AS o FROM num WHERE rn = 1
  UNION ALL SELECT x.doc_id, x.rn, x.first_seen, x.input_tokens, x.output_tokens, f.batch_no + x.b, CASE WHEN x.b = 1 THEN 1 ELSE f.n + 1 END,
    CASE WHEN x.b = 1 THEN 512 ELSE f.i END + x.input_tokens, CASE WHEN x.b = 1 THEN 0 ELSE f.o END + x.output_tokens
  FROM fold f JOIN LATERAL (SELECT num.*, (f.n >= {ITEMS} OR f.i + num.input_tokens > {int(TPM * 0.8)} OR f.o + num.output_tokens > {int(MOST * 0.9)})::INT AS b FROM num WHERE num.doc_id = f.doc_id AND num.rn = f.rn + 1) x ON true)"""
_KEY = f"lower({I.sql_strip(f'''regexp_replace(regexp_replace(text, '\\p{{Nd}}+', '', 'g'), '{I.WS}+', ' ', 'g')''')})"
_W = I.WS

ORACLES = {
    "segment_lines": f"WITH {I.LINES_SQL} SELECT doc_id, line_no, text FROM units",
    "segment_unique": f"WITH {I.LINES_SQL}, {_TEXTS} SELECT * FROM texts",
    "unique_count": f"WITH {I.LINES_SQL} SELECT count(DISTINCT text) AS texts, count(*) AS units FROM units",
    "segment_hash": f"SELECT doc_id, sha256('global|' || {I.sql_squeeze('text')} || '|vi') AS hash FROM documents",
    "token_estimates": f"SELECT doc_id, ceil(s + 256)::BIGINT AS single_input, ceil(s + 16)::BIGINT AS item_input, ceil(s * 1.3::DOUBLE + 16)::BIGINT AS output, (ceil(s + 256) + ceil(s * 1.3::DOUBLE + 16))::BIGINT AS single_total FROM (SELECT doc_id, {_SOURCE} AS s FROM documents)",
    "cache_hits": f"WITH {I.LINES_SQL}, {_TEXTS}, {I.CACHE_SQL} SELECT doc_id, text, translated_text FROM texts JOIN cache ON hash = sha256('global|' || {I.sql_squeeze('text')} || '|vi')",
    "cache_misses": f"WITH {I.LINES_SQL}, {_TEXTS}, {I.CACHE_SQL} SELECT doc_id, text FROM texts WHERE sha256('global|' || {I.sql_squeeze('text')} || '|vi') NOT IN (SELECT hash FROM cache)",
    "translation_fallback": f"WITH {I.LINES_SQL} SELECT doc_id, line_no, CASE WHEN length(text) % 3 = 0 THEN 'vi:' || text ELSE text END AS translation FROM units",
    "batch_packing": f"WITH RECURSIVE {I.LINES_SQL}, {_TEXTS}, {_SIZED % 'texts'}, {_FOLD} SELECT doc_id, first_seen, input_tokens, output_tokens, batch_no FROM fold",
    "batch_totals": f"WITH RECURSIVE {I.LINES_SQL}, {_TEXTS}, {_SIZED % 'texts'}, {_FOLD} SELECT doc_id, batch_no, count(*) AS items, (sum(input_tokens + output_tokens) + 512)::BIGINT AS total_tokens FROM fold GROUP BY doc_id, batch_no",
    "translated_batches": f"WITH RECURSIVE {I.LINES_SQL}, {_TEXTS}, {_SIZED % 'texts'}, {_FOLD} SELECT doc_id, first_seen, batch_no, 'vi:' || text AS translated_text FROM fold JOIN texts USING (doc_id, first_seen)",
    "translation_plan": f"""WITH RECURSIVE {I.LINES_SQL}, {_TEXTS}, {I.CACHE_SQL}, known AS (SELECT t.*, c.hash IS NOT NULL AS hit FROM texts t LEFT JOIN cache c ON c.hash = sha256('global|' || {I.sql_squeeze('text')} || '|vi')),
        miss AS (SELECT doc_id, text, first_seen FROM known WHERE NOT hit), {_SIZED % 'miss'}, {_FOLD}, sums AS (SELECT doc_id, count(DISTINCT batch_no) AS batches, sum(input_tokens + output_tokens) + 512 * count(DISTINCT batch_no) AS total_tokens FROM fold GROUP BY doc_id)
        SELECT k.doc_id, sum(uses)::BIGINT AS units, count(*) AS texts, count(*) FILTER (WHERE hit) AS cached, coalesce(any_value(s.batches), 0) AS batches, coalesce(any_value(s.total_tokens), 0)::BIGINT AS total_tokens FROM known k LEFT JOIN sums s USING (doc_id) GROUP BY k.doc_id""",
    "line_kinds": rf"WITH {I.LINES_SQL} SELECT doc_id, line_no, CASE WHEN regexp_matches(text, '(?i)^{_W}*(table|box|bảng){_W}*\p{{Nd}}') THEN 'table_title' WHEN regexp_matches(text, '(?i)^{_W}*(figure|fig\.?|table|box|chart|plate|bảng|hình){_W}*\p{{Nd}}+([.\-–—]\p{{Nd}})?') THEN 'caption' ELSE 'paragraph' END AS kind, regexp_matches(text, '^{_W}*([•▪◦‣∙·–—*]|\p{{Nd}}{{1,2}}[.)]|[a-z][.)]){_W}+') AS bullet FROM units",
    "sentence_endings": rf"WITH {I.LINES_SQL} SELECT doc_id, line_no, regexp_matches(text, '[.!?]{_W}*[\x22''”’)\]}}»›]*{_W}*$') AS ends, regexp_matches(text, '^\p{{Ll}}') AS lower FROM units",
    "dehyphenate": rf"WITH {I.LINES_SQL}, p AS (SELECT doc_id, line_no, text[1:40] || '-' AS l, text[41:] AS r FROM units) SELECT doc_id, line_no, CASE WHEN regexp_matches(l, '[\p{{L}}\p{{N}}_]-$') AND regexp_matches(r, '^\p{{Ll}}') THEN l[1:length(l) - 1] || r ELSE l || ' ' || r END AS joined FROM p",
    "furniture_lines": f"WITH {I.LINES_SQL}, k AS (SELECT *, {_KEY} AS key FROM units), o AS (SELECT key, count(DISTINCT doc_id) AS documents FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 3) SELECT doc_id, line_no, key, documents FROM k JOIN o USING (key)",
    "masked_keys": "SELECT doc_id, CASE WHEN length(source) = 0 THEN '' WHEN length(source) <= 4 THEN '****' ELSE '****' || right(source, 4) END AS masked, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '****' END AS short, sha256(source) AS token_hash FROM documents",
    "colors": "SELECT l_orderkey, l_linenumber, ((c >> 16) & 255) / 255.0::DOUBLE AS red, ((c >> 8) & 255) / 255.0::DOUBLE AS green, (c & 255) / 255.0::DOUBLE AS blue FROM (SELECT l_orderkey, l_linenumber, (l_orderkey * 7919 + l_linenumber) & 16777215 AS c FROM lineitem)",
}
