"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over `://host` and what follows: `||` at its start stands for a label's start in the host, `|` at its
end for the end of the url, `*` for any signs, `^` for one that is no letter, digit or one of `_.%-`, or the end; all else
for itself. A pattern's literal tokens are its runs of ASCII letters and digits that are whole tokens in every url it
fits. Each rule is filed under that of its tokens which the fewest urls hold; a url's tokens fetch the rules filed under
them, and only these run as regular expressions. Of those that fit, the lowest tier counts first, then the longest rule,
then block before allow, then the smaller text.

Everything here is DataFrame functions. An index of at most SMALL bytes is broadcast; a larger one is joined by token,
and tokens that more than their share of the urls hold are dealt by urls, with their rules beside each share.

Defined cases: a null url, or one without `://`, has an empty host and path and fits no rule; a url that fits none is
allowed; A-Z in hosts are lower-cased, and all else counts as it stands, so a rule's host is to be written in lower case
and a host with a port or a user is another one; a rule without whole tokens meets every url; urls of any length count
whole; repeated rows, and rows of one id, are judged each; null ids are kept; an empty table gives an empty result; other
columns are ignored, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shared import partitions, quoted, written

#: Bytes of rules that are broadcast.
SMALL = 8 << 20
#: Rules of op12_urls by host and path; below them its own patterns.
HOSTS = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
PATTERNS = (
    ("^utm_source=", "block"),  # a page's tracked copies
    ("||blog.*^utm_source=", "allow"),
    ("^page=", "block"),  # further pages of a list
    ("/tag/", "block"),
    ("/search?", "block"),
    ("/login^", "block"),
    ("/signup^", "block"),
    ("/cart^", "block"),
    ("||ads.", "block"),
    ("^casino^", "block"),
    ("^xxx^", "block"),
    (".zip|", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parted(url: Column) -> tuple[Column, Column, Column]:
    """host, path and what follows the host."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.substring(rest, F.length(host) + 1, F.length(rest))


def rules_of(spark: SparkSession, rules: list[tuple[str, str, str, int]]) -> DataFrame:
    """A table of rules: rule (its name), verdict, pattern, tier."""
    rows = [F.struct(*[F.lit(v).alias(c) for c, v in zip(("rule", "verdict", "pattern", "tier"), r, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def expression(pattern: Column) -> Column:
    """The regular expression of a pattern."""
    out = F.regexp_replace(pattern, r"[\\.+?{}()\[\]$]", r"\\$0")
    out = F.regexp_replace(out, r"^\|\|", "<host>")
    out = F.regexp_replace(out, r"\|$", "<end>")
    out = F.replace(F.replace(out, F.lit("|"), F.lit(r"\|")), F.lit("*"), F.lit(".*"))
    out = F.replace(out, F.lit("^"), F.lit(r"(?:[^A-Za-z0-9_.%-]|\z)"))
    out = F.regexp_replace(F.regexp_replace(out, "^<host>", r"^://(?:[^/?#]*\\.)?"), "<end>$", r"\\z")
    return F.concat(F.lit("(?s)"), out)


def _low(c: str) -> Column:
    return F.translate(F.col(c), UPPER, LOWER)


def whole_tokens(pattern: str) -> Column:
    """Tokens that stand between signs in every url that the pattern fits."""
    ends = F.regexp_replace(F.regexp_replace(_low(pattern), r"^\|\|", "/"), r"\|$", "/")
    sure = F.regexp_replace(ends, r"^[a-z0-9]+|[a-z0-9]*\*[a-z0-9]*|[a-z0-9]+$", "*")
    return F.array_distinct(F.regexp_extract_all(sure, F.lit("([a-z0-9]+)"), F.lit(1)))


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", small: int = SMALL) -> DataFrame:
    """id_col, host, path, rule, verdict and tier of each of pages; rule and tier are null where none fits."""
    spark = pages.sparkSession
    host, path, rest = parted(F.col(quoted(url)))
    # Row numbers hold for the written table only.
    urls = written(pages.select(F.monotonically_increasing_id().alias("_row"), F.col(quoted(id_col)).alias("_id"), host.alias("host"), path.alias("path"), F.concat(F.lit("://"), host, rest).alias("_url")), "urls")
    tokens = urls.select("_row", "_url", F.explode(F.array_union(F.array(F.lit("")), F.regexp_extract_all(_low("_url"), F.lit("([a-z0-9]+)"), F.lit(1)))).alias("token"))

    given = written(rules.select("rule", "verdict", "pattern", "tier", whole_tokens("pattern").alias("_tokens")), "rules")
    light = (given.agg(F.sum(F.length("rule") + 4 * F.length("pattern") + 64)).first()[0] or 0) <= small
    near = F.broadcast if light else (lambda df: df)
    asked = given.select(F.explode("_tokens").alias("token")).distinct()
    # Counted in each task before anything moves, so a token of all urls sends a row a task.
    counts = tokens.select("token").join(near(asked), "token", "left_semi").groupBy("token").agg(F.count("*").alias("_n"))
    counts = written(asked.join(near(counts) if light else counts, "token", "left").select("token", F.coalesce("_n", F.lit(0)).alias("_n")), "tokens")
    filed = given.select("rule", "verdict", "pattern", "tier", F.explode_outer("_tokens").alias("token")).join(near(counts), "token", "left")
    rarest = filed.groupBy("rule", "verdict", "pattern", "tier").agg(F.min(F.struct("_n", "token")).alias("_least"))
    index = rarest.select("rule", "verdict", "tier", expression(F.col("pattern")).alias("_regex"), F.coalesce(F.col("_least.token"), F.lit("")).alias("token"))

    if light:
        met = tokens.join(F.broadcast(index), "token")
    else:
        total, share = urls.count(), partitions(spark)
        # Tokens of more than a share of the urls: no more than a url's tokens on average times the partitions.
        hot = counts.filter(F.col("_n") * share > total).unionByName(spark.range(1).select(F.lit("").alias("token"), F.lit(total).alias("_n")))
        hot = written(hot.select("token", F.ceil(F.col("_n") * share / F.lit(max(total, 1))).cast("int").alias("_shares")), "hot_tokens")
        dealt = tokens.join(F.broadcast(hot), "token", "left").withColumn("_share", F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_shares")), F.lit(0)).cast("int")).drop("_shares")
        beside = index.join(F.broadcast(hot), "token", "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("_shares", F.lit(1)), F.lit(1)) - 1))).drop("_shares")
        met = dealt.join(beside, ["token", "_share"])
    fits = met.filter(F.regexp_like("_url", F.col("_regex")))
    best = fits.groupBy("_row").agg(F.min(F.struct("tier", -F.length("rule"), F.col("verdict") != "block", "rule", "verdict")).alias("_best"))
    out = urls.join(best.withColumnRenamed("_row", "_of"), F.col("_row") == F.col("_of"), "left")
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit("allow")).alias("verdict"), F.col("_best.tier").alias("tier"))


def op12_urls(spark, sf_dir: str) -> DataFrame:
    rules = rules_of(spark, [*((r, v, f"||{r}", 0) for r, v in HOSTS), *((r, v, r, 1) for r, v in PATTERNS)])
    out = judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
    first = F.col("tier") == 0
    return out.select("page_id", "host", "path", F.when(first, F.col("rule")).alias("rule"), "verdict", F.when(~first, F.col("rule")).alias("pattern"))


#: Each rule against each url, as hosts, paths and expressions written out here.
ORACLE = r"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT rid, page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*((?s:.*))', 1) AS tail FROM u),
h(rule, verdict, name, start) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
f AS (SELECT rid, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS verdict FROM p JOIN h ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY rid),
x(pattern, verdict, expr) AS (VALUES ('^utm_source=', 'block', '[^A-Za-z0-9_.%-]utm_source='), ('||blog.*^utm_source=', 'allow', '^://([^/?#]*[.])?blog[.](?s:.*)[^A-Za-z0-9_.%-]utm_source='), ('^page=', 'block', '[^A-Za-z0-9_.%-]page='),
  ('/tag/', 'block', '/tag/'), ('/search?', 'block', '/search[?]'), ('/login^', 'block', '/login([^A-Za-z0-9_.%-]|$)'), ('/signup^', 'block', '/signup([^A-Za-z0-9_.%-]|$)'), ('/cart^', 'block', '/cart([^A-Za-z0-9_.%-]|$)'),
  ('||ads.', 'block', '^://([^/?#]*[.])?ads[.]'), ('^casino^', 'block', '[^A-Za-z0-9_.%-]casino([^A-Za-z0-9_.%-]|$)'), ('^xxx^', 'block', '[^A-Za-z0-9_.%-]xxx([^A-Za-z0-9_.%-]|$)'), ('.zip|', 'block', '[.]zip$')),
y AS (SELECT rid, min({'l': -len(pattern), 'b': x.verdict <> 'block', 'p': pattern, 'v': x.verdict}) AS best FROM p JOIN x ON regexp_matches('://' || host || tail, expr) GROUP BY rid)
SELECT page_id, host, path, f.rule, coalesce(f.verdict, y.best.v, 'allow') AS verdict, CASE WHEN f.rule IS NULL THEN y.best.p END AS pattern FROM p LEFT JOIN f USING (rid) LEFT JOIN y USING (rid)
"""
