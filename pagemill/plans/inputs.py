"""Inputs derived from the tables, in DataFrames and in SQL: lines with page geometry, events as quota calls and
as logins, small rectangles, and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import planning
from pagemill.session import table

WS = r"[\s\v\p{Z}\x{85}\x1c-\x1f]"
LETTER = r"[\p{L}\p{Nl}\p{No}]"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_squeeze(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def sql_clean(x: str) -> str:
    return sql_strip(f"regexp_replace(replace(replace(replace({x}, chr(173), ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[ \\t]+', ' ', 'g')")


LINES_SQL = f"""
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
units AS (SELECT doc_id, line_no::INTEGER AS line_no, {sql_clean('raw')} AS text FROM raw WHERE regexp_matches({sql_clean('raw')}, '{LETTER}'))"""

GEOMETRY_SQL = LINES_SQL + """,
lines AS (SELECT doc_id, (line_no // 40)::INTEGER AS page_index, line_no, text,
  CASE WHEN length(text) >= 400 OR (line_no // 20) % 2 = 0 THEN 50.0 ELSE 310.0 END::DOUBLE AS x0,
  60.0 + 16 * (line_no % 20) AS y0, CASE WHEN line_no = 0 THEN 14.0 ELSE 10.0 END AS size,
  CASE WHEN length(text) >= 400 THEN 550.0 ELSE (CASE WHEN (line_no // 20) % 2 = 0 THEN 50.0 ELSE 310.0 END) + least(5 * length(text), 240) END::DOUBLE AS x1,
  60.0 + 16 * (line_no % 20) + 12 AS y1 FROM units)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.explode_lines(table(spark, sf_dir, "documents"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines set on pages of two columns of twenty; long ones run across."""
    u = units(spark, sf_dir)
    n, side = F.col("line_no"), (F.floor(F.col("line_no") / 20) % 2) == 0
    long, base = F.length("text") >= 400, F.when(side, 50.0).otherwise(310.0)
    y0 = 60.0 + 16 * (n % 20)
    geometry = {"page_index": F.floor(n / 40).cast("int"), "x0": F.when(long, 50.0).otherwise(base), "y0": y0, "x1": F.when(long, 550.0).otherwise(base + F.least(5 * F.length("text"), F.lit(240))), "y1": y0 + 12, "size": F.when(n == 0, 14.0).otherwise(10.0)}
    style = {"bold": F.lit(False), "italic": F.lit(False), "serif": F.lit(True), "color": F.lit(0), "kind": F.lit("paragraph")}
    return u.withColumns(geometry | style)


def pages_of(lines_: DataFrame) -> DataFrame:
    return lines_.select("doc_id", "page_index").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(792.0)})


def drawings(lines_: DataFrame) -> DataFrame:
    """On each page a filled shape over the first five lines of the right column."""
    shape = {"drawing_no": F.lit(0), "x0": F.lit(305.0), "y0": F.lit(58.0), "x1": F.lit(560.0), "y1": F.lit(142.0), "type": F.lit("f"), "fill": F.lit(1)}
    return pages_of(lines_).select("doc_id", "page_index").withColumns(shape)


def grids(lines_: DataFrame) -> DataFrame:
    """On each page a grid of strokes: a row for each line, up to 20, and 2 to 4 columns by their number. Flat rules are
    drawn as two halves, a little off, and the second column's left rule begins under the first row."""
    n = lines_.groupBy("doc_id", "page_index").agg(F.count("*").alias("n"))
    sized = n.select("doc_id", "page_index", F.least(F.col("n"), F.lit(20)).cast("int").alias("rows"), (F.col("n") % 3 + 2).cast("int").alias("columns"))
    wide = F.col("columns") * 90

    def stroke(x0, y0, x1, y1):
        return F.struct(*[c.cast("double").alias(k) for k, c in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])

    flat = F.transform(F.sequence(F.lit(0), F.col("rows")), lambda i: F.array(stroke(F.lit(40), 56.5 + 16 * i, F.lit(84), 56.5 + 16 * i), stroke(F.lit(86), 57.5 + 16 * i, 40 + wide, 57.5 + 16 * i)))
    upright = F.transform(F.sequence(F.lit(0), F.col("columns")), lambda j: stroke(40 + 90 * j, F.when(j == 1, 57 + 16).otherwise(57), 40 + 90 * j, 57 + 16 * F.col("rows")))
    drawn = sized.select("doc_id", "page_index", F.posexplode(F.concat(F.flatten(flat), upright)).alias("drawing_no", "d"))
    return drawn.select("doc_id", "page_index", "drawing_no", "d.*", F.lit("s").alias("type"), F.lit(None).cast("int").alias("fill"))


def images(lines_: DataFrame) -> DataFrame:
    """On each page a picture behind the last five lines of the right column."""
    return pages_of(lines_).select("doc_id", "page_index").withColumns({"x0": F.lit(305.0), "y0": F.lit(298.0), "x1": F.lit(560.0), "y1": F.lit(390.0)})


def seconds(c) -> F.Column:
    return F.unix_micros(c.cast("timestamp")) / 1_000_000


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: user, kind of event as provider, value as tokens."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("scope"), F.col("event_type").alias("provider"), seconds(F.col("ts")).alias("ts"), F.floor(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("tokens"), "event_id")


CALLS_SQL = "calls AS (SELECT user_id::VARCHAR AS scope, event_type AS provider, epoch_us(ts) / 1000000 AS ts, floor(coalesce(value, 0) * 100)::BIGINT AS tokens, event_id FROM events)"


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as failed logins, sign-ups as good ones, by groups of users so that some are locked out."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "signup"))
    return e.select((F.col("user_id") % 20).alias("user_id"), seconds(F.col("ts")).alias("ts"), (F.col("event_type") == "signup").alias("success"), "event_id")


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line of the documents, by its length, as cached segments."""
    from pagemill.functions import text as X

    u = planning.unique_texts(units(spark, sf_dir).filter(F.length("text") % 3 == 0), [])
    return u.select(X.segment_hash(F.col("text"), F.lit("vi"), F.lit("global")).alias("hash"), F.lit("global").alias("user_id"), F.col("text").alias("source_text"), F.concat(F.lit("vi:"), "text").alias("translated_text")).dropDuplicates(["hash"])


CACHE_SQL = f"""
cache AS (SELECT DISTINCT sha256('global|' || {sql_squeeze('text')} || '|vi') AS hash, 'vi:' || text AS translated_text FROM units WHERE length(text) % 3 = 0)"""
