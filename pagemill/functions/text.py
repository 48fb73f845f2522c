"""Text functions as column expressions: cleaning, classification, joining, hashing and token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that agree with Unicode-aware text handling, and the patterns over them.
SPACE = r"[\s\p{Z}\x{85}\x1c-\x1f]"
#: The same characters, one by one.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Common signs, blanks among them, but no other white space: few ranges, as each sign of a text is held against them.
COMMON = r"^[\x20-\x7e\x{a1}-\x{167f}\x{2010}-\x{2027}]*+\z"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
WORD = r"[\p{L}\p{N}_]"
CAPTION = rf"(?iu)^{SPACE}*(figure|fig\.?|table|box|chart|plate|bảng|hình){SPACE}*\p{{Nd}}+([.\-–—]\p{{Nd}})?"
TABLE_TITLE = rf"(?iu)^{SPACE}*(table|box|bảng){SPACE}*\p{{Nd}}"
BULLET = rf"^{SPACE}*([•▪◦‣∙·–—*]|\p{{Nd}}{{1,2}}[.)]|[a-z][.)]){SPACE}+"
SENTENCE_END = rf"[.!?]{SPACE}*[\"'”’)\]}}»›]*{SPACE}*$"
SINGLE_OVERHEAD, BATCH_OVERHEAD, ITEM_OVERHEAD, OUTPUT_OVERHEAD, EXPANSION = 256, 512, 16, 16, 1.3


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.trim(c, F.lit(SPACES))


def clean(c: Column) -> Column:
    """Without soft hyphens, with the fi and fl ligatures spelled out, blanks collapsed and ends stripped."""
    c = F.replace(F.replace(F.replace(c, F.lit("­"), F.lit("")), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    uneven = F.contains(c, F.lit("  ")) | F.contains(c, F.lit("\t"))
    return strip(F.when(uneven, F.regexp_replace(c, r" [ \t]+|\t[ \t]*", " ")).otherwise(c))


def has_letter(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(LETTER)), F.lit(False))


def furniture_key(c: Column) -> Column:
    """What running heads and feet have in common: the text without digits, in lower case."""
    return F.lower(squeeze(F.regexp_replace(c, r"\p{Nd}+", "")))


def ends_sentence(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(SENTENCE_END)), F.lit(False))


def starts_lower(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(r"^\p{Ll}")), F.lit(False))


def is_bullet(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(BULLET)), F.lit(False))


def text_kind(c: Column) -> Column:
    """Kind of a line by its text alone."""
    return F.when(F.rlike(c, F.lit(TABLE_TITLE)), "table_title").when(F.rlike(c, F.lit(CAPTION)), "caption").otherwise("paragraph")


def join_text(left: Column, right: Column) -> Column:
    """left and right as running text: a hyphen between a word and a lower-case start goes."""
    cut = F.rlike(left, F.lit(rf"{WORD}-$")) & starts_lower(right)
    return F.when(cut, F.concat(F.substring(left, F.lit(1), F.length(left) - 1), right)).otherwise(F.concat_ws(" ", left, right))


def join_lines(lines: Column) -> Column:
    """An array of lines as running text."""
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.aggregate(rest, F.element_at(lines, 1), join_text)


def block_id(page: Column, x0: Column, y0: Column, n: Column) -> Column:
    """Readable but not unique: pages may hold two blocks at one rounded place."""
    return F.format_string("p%d_x%d_y%d_n%d", page.cast("int"), F.bround(x0).cast("int"), F.bround(y0).cast("int"), n.cast("int"))


def line_owner(page: Column, line: Column) -> Column:
    return F.concat_ws(":", F.lit("line"), page.cast("string"), line.cast("string"))


def squeeze(c: Column) -> Column:
    """White space collapsed to single blanks and stripped."""
    return strip(F.regexp_replace(c, rf"{SPACE}+", " "))


def segment_hash(text: Column, lang: Column, user: Column) -> Column:
    return F.sha2(F.concat(user, F.lit("|"), squeeze(text), F.lit("|"), lang), 256)


def word_count(c: Column) -> Column:
    """Words between white space of any script. Of common signs with single blanks between words, blanks are counted."""
    blank = F.lit(" ")
    even = F.rlike(c, F.lit(COMMON)) & ~(F.contains(c, F.lit("  ")) | F.startswith(c, blank) | F.endswith(c, blank) | (c == ""))
    return F.when(even, F.length(c) - F.length(F.replace(c, blank, F.lit(""))) + 1).otherwise(F.size(F.array_remove(F.split(squeeze(c), " "), "")))


def source_tokens(c: Column) -> Column:
    return F.greatest(F.length(c) / F.lit(4.0), word_count(c) * F.lit(1.3), F.lit(1.0))


def single_input_tokens(c: Column) -> Column:
    return F.ceil(source_tokens(c) + SINGLE_OVERHEAD)


def item_input_tokens(c: Column) -> Column:
    return item_input(source_tokens(c))


def output_tokens(c: Column) -> Column:
    return output(source_tokens(c))


def item_input(source: Column) -> Column:
    return F.ceil(source + ITEM_OVERHEAD)


def output(source: Column) -> Column:
    return F.ceil(source * EXPANSION + OUTPUT_OVERHEAD)


def single_total_tokens(c: Column) -> Column:
    return single_input_tokens(c) + output_tokens(c)


def input_budget(tpm: int | None) -> int | None:
    """Tokens a batch may send; none without a limit."""
    return max(1, int(tpm * 0.8)) if tpm and tpm > 0 else None


def output_budget(most: int | None) -> int | None:
    return max(1, int(most * 0.9)) if most and most > 0 else None


def mask_key(c: Column) -> Column:
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "").when(F.length(c) <= 4, "****").otherwise(F.concat(F.lit("****"), F.right(c, F.lit(4))))


def token_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def clean_username(c: Column) -> Column:
    """Null where a name is too short or too long after squeezing."""
    s = squeeze(c)
    return F.when((F.length(s) >= 3) & (F.length(s) <= 80), s)


def rgb(color: Column) -> Column:
    part = lambda shift: F.shiftright(color, shift).bitwiseAND(F.lit(255)) / F.lit(255.0)
    return F.struct(part(16).alias("red"), part(8).alias("green"), part(0).alias("blue"))


def before_translation(c: Column) -> Column:
    """Hook for terms before a provider sees a text: leaves it as it is."""
    return c


def after_translation(c: Column) -> Column:
    """Hook for terms in a provider's reply: leaves it as it is."""
    return c


def session_token(cookie: Column, header: Column) -> Column:
    bearer = F.when(F.lower(F.substring(header, 1, 7)) == "bearer ", strip(F.substring(header, F.lit(8), F.length(header))))
    return F.coalesce(F.when(F.length(cookie) > 0, cookie), bearer)


def same_site(c: Column) -> Column:
    s = F.lower(strip(F.coalesce(c, F.lit("lax"))))
    return F.when(s.isin("lax", "strict", "none"), s).otherwise("lax")


def secure_cookie(site: Column, configured: Column) -> Column:
    """A cookie for other sites must be secure."""
    return configured | (same_site(site) == "none")


def retry_delay(header: Column, attempt: Column) -> Column:
    """Seconds to wait: the server's wish, not below 0, or the schedule of attempts (from 0)."""
    asked = header.try_cast("double")
    return F.when(asked.isNotNull(), F.greatest(asked, F.lit(0.0))).otherwise(F.get(F.array(F.lit(1.0), F.lit(3.0), F.lit(8.0)), attempt))


def database_url(c: Column) -> Column:
    """Short database addresses with the driver spelled out."""
    return F.regexp_replace(F.regexp_replace(c, "^postgres://", "postgresql://"), "^postgresql://", "postgresql+psycopg://")


def split_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def content_disposition(name: Column) -> Column:
    """A download header with an ASCII name and the whole name percent-encoded."""
    plain = F.regexp_replace(name, r"[^\x00-\x7f]", "")
    coded = F.url_encode(name)
    for code, sign in ((r"\+", "%20"), (r"\*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        coded = F.regexp_replace(coded, code, sign)
    return F.concat(F.lit('attachment; filename="'), F.when(F.length(plain) > 0, plain).otherwise("document.pdf"), F.lit("\"; filename*=UTF-8''"), coded)
