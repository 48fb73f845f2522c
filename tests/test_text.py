import re

import pytest
from pyspark.sql import functions as F

from pagemill.functions import secrets as S
from pagemill.functions import text as X
from pagemill.operators import planning as P


def one(spark, fn, *values):
    names = [f"c{i}" for i in range(len(values))]
    row = spark.createDataFrame([values], ", ".join(f"{n} {'string' if isinstance(v, (str, type(None))) else 'int' if isinstance(v, int) else 'double'}" for n, v in zip(names, values, strict=True)))
    return row.select(fn(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize("fn,value,want", [
    (X.clean, " a­b  \t c ", "ab c"), (X.clean, "ﬁnd ﬂow", "find flow"),
    (X.has_letter, "12 %", False), (X.has_letter, "1 é", True),
    (X.furniture_key, "Page 12  of 30 ", "page of"),
    (X.ends_sentence, 'He said "yes."', True), (X.ends_sentence, "and then", False), (X.ends_sentence, "Done!) ", True),
    (X.text_kind, "Table 3 Doses", "table_title"), (X.text_kind, "Fig. 2-1 x", "caption"), (X.text_kind, "BẢNG 4", "table_title"), (X.text_kind, "Figure skating", "paragraph"),
    (X.is_bullet, "• item", True), (X.is_bullet, "12) item", True), (X.is_bullet, "a. item", True), (X.is_bullet, "abc", False),
    (X.mask_key, "abcdef", "****cdef"), (X.mask_key, "abcd", "****"), (X.mask_key, "", ""), (X.mask_key, None, ""),
    (X.clean_username, "  a  b ", "a b"), (X.clean_username, "ab", None),
    (X.database_url, "postgres://h/d", "postgresql+psycopg://h/d"), (X.database_url, "sqlite:///x", "sqlite:///x"),
    (X.split_list, "a, b,,c ", ["a", "b", "c"]), (X.same_site, " None", "none"), (X.same_site, "odd", "lax"),
    (X.content_disposition, "bản ~a/b.pdf", "attachment; filename=\"bn ~a/b.pdf\"; filename*=UTF-8''b%E1%BA%A3n%20~a/b.pdf"),
    (X.content_disposition, "ả", "attachment; filename=\"document.pdf\"; filename*=UTF-8''%E1%BA%A3"),
    (X.item_input_tokens, "", 17), (X.output_tokens, "", 18), (X.single_total_tokens, "a b c d e f g h i j", 269 + 33),
])
def test_functions(spark, fn, value, want):
    assert one(spark, fn, value) == want


@pytest.mark.parametrize("left,right,want", [("inher-", "ited", "inherited"), ("inher-", "Ited", "inher- Ited"), ("a", "b", "a b"), ("- ", "b", "-  b")])
def test_join(spark, left, right, want):
    assert one(spark, X.join_text, left, right) == want
    assert one(spark, lambda a, b: X.join_lines(F.array(a, b)), left, right) == want


def test_hash_ignores_white_space(spark):
    h = lambda t: one(spark, lambda a, b, c: X.segment_hash(a, b, c), t, "vi", "global")
    assert h("a  b\n") == h(" a b") != h("ab")


@pytest.mark.parametrize("cookie,header,want", [("c", "Bearer x", "c"), ("", "bearer  y ", "y"), (None, "Basic z", None)])
def test_session_token(spark, cookie, header, want):
    assert one(spark, X.session_token, cookie, header) == want


@pytest.mark.parametrize("header,attempt,want", [("2.5", 0, 2.5), ("-3", 0, 0.0), ("soon", 1, 3.0), (None, 2, 8.0)])
def test_retry_delay(spark, header, attempt, want):
    assert one(spark, X.retry_delay, header, attempt) == want


def test_colour(spark):
    assert tuple(one(spark, X.rgb, 0xFF8000)) == (1.0, 128 / 255, 0.0)


def test_secrets(spark):
    key = b"k" * 32
    df = spark.createDataFrame([("pässword", bytearray(b"0123456789abcdef"), " Straße  X ")], "p string, s binary, u string")
    r = df.select(S.hash_password(F.col("p"), F.col("s"), 1000).alias("h"), S.seal(F.col("p"), key).alias("sealed"), S.normal_username(F.col("u")).alias("u"), "p").first()
    assert r["u"] == "strasse x" and r["h"].startswith("pbkdf2_sha256$1000$")
    import base64
    import hashlib
    import hmac

    checks = [("pässword", r["h"], True), ("x", r["h"], False), ("x", "broken", False), (None, r["h"], False), ("x", None, False), ("pässword", r["h"].replace("sha256$1000", "sha256$0"), False), ("pässword", "md5" + r["h"][13:], False)]
    salt, digest = (base64.urlsafe_b64decode(x) for x in r["h"].split("$")[2:])
    assert digest == hashlib.pbkdf2_hmac("sha256", "pässword".encode(), salt, 1000)
    got = spark.createDataFrame(checks, "p string, h string, want boolean").select(S.verify_password(F.col("p"), F.col("h")), "want").collect()
    assert [x[0] for x in got] == [x[1] for x in got]

    mac = lambda k, m: hmac.new(k, m, hashlib.sha256).digest()

    def old(text, labels=S.LABELS):
        nonce, data = b"n" * 16, text.encode()
        stream = b"".join(mac(mac(key, labels.old_seal), nonce + i.to_bytes(8, "big")) for i in range(9))
        body = b"v1" + nonce + bytes(x ^ y for x, y in zip(data, stream, strict=False))
        return base64.urlsafe_b64encode(body + mac(mac(key, labels.old_mac), body)).decode()

    texts = ["old", "", "ü" * 100, "x" * 32, "abcde"]
    sealed = [r["sealed"], *map(old, texts), "!!", r["sealed"][:-8] + "AAAAAAA=", "", old("old")[:-6] + "AAAAA=", old("x", S.Labels(old_seal=b"a"))]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(sealed)], "i int, s string").orderBy("i").select(S.unseal(F.col("s"), key)).collect()
    assert [x[0] for x in got][:10] == ["pässword", *texts, "", "", "", ""] and got[10][0] != "x"
    own = S.Labels(old_seal=b"a", old_mac=b"b")
    assert spark.createDataFrame([(old("y", own),)], "s string").select(S.unseal(F.col("s"), key, own)).first()[0] == "y"
    long = b"k" * 100
    assert spark.createDataFrame([(bytearray(b"m"),)], "m binary").select(S.keyed_digest(long, F.col("m"))).first()[0] == mac(long, b"m")


def test_lines_are_cleaned_once_and_blank_runs_go_as_their_pattern_says(spark):
    signs = [chr(c) for c in range(1, 0x3100)]
    got = spark.createDataFrame([(f"{c}a{c}{c}b{c}",) for c in signs], "c string").select("c", X.strip(F.col("c")).alias("s"), F.regexp_replace("c", rf"^{X.SPACE}+|{X.SPACE}+$", "").alias("r")).collect()
    assert [x["s"] for x in got] == [x["r"] for x in got]
    # The filter and the text had five patterns each.
    plan = P.explode_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_a_text_is_sized_once_for_both_of_its_token_counts(spark):
    units = P.unique_texts(spark.createDataFrame([(1, 0, "a b")], "doc_id long, line_no int, text string"), ["doc_id"])
    plan = P.with_tokens(units)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_words_are_counted_alike_with_and_without_a_pattern(spark):
    texts = ["", " ", "a", "one two", " one", "one ", "one  two", "one\ttwo", "a\nb", "a b\n", "a\u00a0b c", "a\u2003b", "a\u1680b", "a\x1cb", "a\x85b", "\u3000a", "\u201cgr\u00fc\u00df dich\u201d \u2013 ja", "\u4f60 \u597d", "a\u200bb", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    got = {r["i"]: r["n"] for r in rows.select("i", X.word_count(F.col("x")).alias("n")).collect()}
    assert got == {i: None if x is None else len([w for w in re.split(f"[{X.SPACES}]+", x) if w]) for i, x in enumerate(texts)}


def test_queries_of_batches_keep_texts_out_of_the_sorting(spark, tmp_path):
    from pagemill.plans import text_queries as Q

    spark.createDataFrame([(1, "one two\nthree four\none two"), (2, "five")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert "text" not in Q._batched(spark, str(tmp_path)).columns
    assert {(r["doc_id"], r["items"]) for r in Q.batch_totals(spark, str(tmp_path)).collect()} == {(1, 2), (2, 1)}
    assert {r["translated_text"] for r in Q.translated_batches(spark, str(tmp_path)).collect()} == {"vi:one two", "vi:three four", "vi:five"}
