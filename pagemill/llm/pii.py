"""Personal data with spans in the source text, disguised or not.

Base identifiers are matched on the text as it is. A transducer then rewrites what disguises hide: look-alike
letters and digits, invisible characters, digits spelled in words, and words or brackets for "@" and ".".
It works in pieces (source span -> replacement), so every character of the rewritten text knows its source
span, and identifiers found there are mapped back. A found span that meets a base span of its kind is dropped.

Defined cases: null text is empty; empty texts give no spans; texts of any length are read whole, in time
proportional to their length; repeated rows are treated alike; an empty table gives an empty result."""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.shared import text_of

KINDS = ("email", "ip", "card", "phone")

# How digits are spelled in the corpus's languages.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "une": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "ein": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Look-alikes outside the compatibility forms, which NFKC covers.
LOOKS = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅαοερνιτκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTXIJSaoepvitkABEZHIKMNOPTYX", strict=True))
LOOKS |= dict.fromkeys("​‌‍⁠﻿­‎‏", "")
LOOKS |= dict.fromkeys("              　", " ")
LOOKS |= dict.fromkeys("‐‑‒–—−﹣－", "-")
LOOKS |= dict.fromkeys("․。．｡", ".")


# Top-level names that end an address of bare words where its words may be prose, as in "at this point we".
TOPS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "ai", "app", "dev", "me", "eu", "us", "uk", "de", "fr", "es", "it", "nl", "ch", "at", "be", "ca", "au", "mx", "ar", "br", "pl", "pt", "se", "no", "jp", "cn", "in", "ru", "test", "example")

# What stands before a dot in prose, as in "at the dot here".
BEFORE = ("a", "an", "the", "this", "that", "these", "those", "one", "some", "any", "each", "every", "which", "what", "no", "my", "your", "his", "her", "its", "our", "their")


class Finder:
    def __init__(self) -> None:
        self.domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
        self.local = re.compile(r"[A-Za-z0-9._%+-]*\Z").search
        self.numbers = re.compile(r"[0-9]").search
        self.ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
        self.card = re.compile(r"[0-9](?:[ -]?[0-9])++").finditer
        self.phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
        self.digits = re.compile(r"[0-9]").findall
        names = "|".join(sorted(SPELLED, key=lambda w: (-len(w), w)))
        sep = r"[\s,.\-]{1,3}"
        one = rf"(?:{names}|[0-9])"
        at, dot = r"(?:at|arroba|arobase|klammeraffe|ät)", r"(?:dot|point|punkt|punto)"
        label, tld = r"[a-z0-9][a-z0-9-]*+", r"[a-z][a-z]++(?![\w-])"
        around = lambda x: rf"\s*+[\[({{<]\s*+(?:{x})\s*+[\])}}>]\s*+"
        said_at, said_dot = rf"\s++{at}\s++|{around(at + '|@')}", rf"\s++{dot}\s++|{around(dot + '|dt|[.]')}"
        self.near = re.compile(rf"(?:^|[\s,.\-(:])(?:{names}){sep}{one}(?!\w)").search
        self.near_digit = re.compile(rf"[0-9]{sep}(?:{names})(?!\w)").search
        self.spelled = re.compile(rf"(?<!\w)(?:plus\s+)?(?:\+\s*)?{one}(?:(?:{sep}|(?<=[0-9])|(?<=[0-9])\s*[()]\s*){one})+(?!\w)").finditer
        self.each = re.compile(rf"{names}|[0-9]|\.").finditer
        # In brackets, either sign may stand alone; bare words count only as a whole address or between numbers.
        self.bracketed = re.compile(rf"(?<!\s)\s*+[\[({{<]\s*+(?:({at}|@)|(?:{dot}|dt|\.))\s*+[\])}}>]\s*+").finditer
        # Each sign is a bare word, in brackets or itself; after a plain "@" or dots alone there is nothing to rewrite.
        self.address = re.compile(rf"(?<![\w.%+-])[a-z0-9._%+-]++({said_at}|@){label}(?:(?:{said_dot}|\.){label})*?(?:{said_dot}){tld}(?!(?:{said_dot}){label})").finditer
        self.any_dot = re.compile(said_dot).finditer
        self.prose = re.compile(rf"[^\[({{<@]*\s(?:(?:{'|'.join(BEFORE)})\s+{dot}|\S+\s+point)\s+(?!(?:{'|'.join(TOPS)})\Z)\S+").fullmatch
        self.number_dot = re.compile(rf"(?<=[0-9])\s+{dot}\s+(?=[0-9])|(?:(?<=[a-z]))\s+{dot}\s+(?=(?:{names})(?!\w))").finditer
        self.looks = re.compile("[" + "".join(map(re.escape, LOOKS)) + "！-～①-⒛⁰-ₜ²³¹٠-٩۰-۹०-९\U0001d400-\U0001d7ff]").search

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the identifiers of text as it is."""
        out: list[tuple[int, int, int]] = []
        at, last = text.find("@"), 0
        while at >= 0:
            lo = at
            while lo > last and (c := text[lo - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
                lo -= 1
            if lo < at and (m := self.domain(text, at + 1)):
                out.append((lo, 0, m.end()))
                last = m.end()
                at = text.find("@", last)
            else:
                at = text.find("@", at + 1)
        if self.numbers(text) is None:
            return out
        for m in self.ip(text):
            if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in self.card(text):
            if 12 <= m.end() - m.start() < 38 and 12 <= len(d := self.digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in self.phone(text):
                if 9 <= len(self.digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
        out.sort()
        return out

    def rewrites(self, text: str) -> tuple[str, list[int], list[int], list[int]] | None:
        """The rewritten text, and of each of its pieces the start there, the start and end in text; None if nothing is rewritten."""
        steps: list[tuple[str, list[tuple[int, int, str]]]] = []
        now = text
        looks = [] if text.isascii() or self.looks(text) is None else self._looks(now)
        if looks:
            steps.append((now, looks))
            now = _apply(now, looks)
        low = _lower(now)
        marks: list[tuple[int, int, str]] = []
        if any(x in low for x in "[({<"):
            marks = [(m.start(), m.end(), "@" if m[1] else ".") for m in self.bracketed(low)]
        words = any(x in low for x in ("dot", "point", "punkt", "punto"))
        if words or marks:
            for m in self.address(low):
                if self.prose(m[0]):
                    continue
                if m[1] != "@":
                    marks.append((*m.span(1), "@"))
                marks += [(m.end(1) + x.start(), m.end(1) + x.end(), ".") for x in self.any_dot(low[m.end(1) : m.end()])]
        if words:
            marks += [(m.start(), m.end(), ".") for m in self.number_dot(low)]
        if marks:
            kept, last = [], 0
            for m in sorted(marks):
                if m[0] >= last:
                    kept.append(m)
                    last = m[1]
            steps.append((now, kept))
            now = _apply(now, kept)
            low = _lower(now)
        if self.near(low) or self.near_digit(low):
            said = []
            for m in self.spelled(low):
                run = [x[0] for x in self.each(m[0].removeprefix("plus"))]
                if sum(x != "." for x in run) < 4 or all(x == "." or x.isdigit() for x in run):
                    continue
                # A full stop stays only between digits, as in an address of a machine.
                tight = "".join("." if x == "." else SPELLED.get(x, x) for x in run)
                plus = "+" if m[0].startswith(("plus", "+")) else ""
                said.append((m.start(), m.end(), plus + (tight if tight.count(".") == 3 and ". " not in m[0] else tight.replace(".", ""))))
            if said:
                steps.append((now, said))
                now = _apply(now, said)
        if not steps:
            return None
        # Compose: positions of the last text, piece by piece, go back through the steps.
        return now, *_compose(text, now, steps)

    def _looks(self, text: str) -> list[tuple[int, int, str]]:
        import unicodedata

        out = []
        for i, c in enumerate(text):
            if c > "\x7f":
                to = LOOKS.get(c)
                if to is None:
                    to = unicodedata.normalize("NFKC", c)
                    if not to.isascii():
                        d = unicodedata.digit(c, None)
                        to = None if d is None else str(d)
                if to is not None and to != c:
                    out.append((i, i + 1, to))
        return out

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans; all spans."""
        base = self.base(text)
        changed = self.rewrites(text)
        if changed is None:
            return base, base
        new, at, lo, hi = changed
        added = []
        for s, kind, e in self.base(new):
            i, j = bisect_right(at, s) - 1, bisect_right(at, e - 1) - 1
            # A piece of equal length maps character by character, a rewritten one as a whole.
            same_i, same_j = _plain(at, lo, hi, i, len(new)), _plain(at, lo, hi, j, len(new))
            start = lo[i] + (s - at[i]) if same_i else lo[i]
            end = lo[j] + (e - at[j]) if same_j else hi[j]
            if not any(k == kind and a < end and start < b for a, k, b in base):
                added.append((start, kind, end))
        return base, sorted({*base, *added})


def _lower(text: str) -> str:
    """Lower case, character by character, so that positions stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def luhn(digits: list[str]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _apply(text: str, edits: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for a, b, to in edits:
        out += [text[last:a], to]
        last = b
    return "".join([*out, text[last:]])


def _plain(at: list[int], lo: list[int], hi: list[int], i: int, total: int) -> bool:
    return (at[i + 1] if i + 1 < len(at) else total) - at[i] == hi[i] - lo[i]


def _pieces(text: str, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """(length in the new text, start and end in text), kept pieces and rewritten ones in turn."""
    out, last = [], 0
    for a, b, to in edits:
        if a > last:
            out.append((a - last, last, a))
        if to:
            out.append((len(to), a, b))
        last = b
    if len(text) > last:
        out.append((len(text) - last, last, len(text)))
    return out


def _compose(text: str, new: str, steps: list) -> tuple[list[int], list[int], list[int]]:
    pieces = [(len(text), 0, len(text))]
    for before, edits in steps:
        starts, at = [], 0
        for n, _, _ in pieces:
            starts.append(at)
            at += n
        made: list[tuple[int, int, int]] = []
        for n, a, b in _pieces(before, edits):
            i = bisect_right(starts, a) - 1
            if n == b - a:  # kept: may run over several older pieces
                while a < b:
                    size, lo, hi = pieces[i]
                    till = min(b, starts[i] + size)
                    if size == hi - lo:
                        made.append((till - a, lo + a - starts[i], lo + till - starts[i]))
                    else:
                        made.append((till - a, lo, hi))
                    a, i = till, i + 1
            else:
                j = bisect_right(starts, b - 1) - 1
                lo = pieces[i][1] + (a - starts[i] if pieces[i][0] == pieces[i][2] - pieces[i][1] else 0)
                hi = pieces[j][1] + b - starts[j] if pieces[j][0] == pieces[j][2] - pieces[j][1] else pieces[j][2]
                made.append((n, lo, hi))
        pieces = made
    at, out = 0, ([], [], [])
    for n, lo, hi in pieces:
        for x, v in zip(out, (at, lo, hi), strict=True):
            x.append(v)
        at += n
    return out


FOUND = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType())] + [T.StructField(f"n_{k}_all", T.LongType()) for k in KINDS]


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base identifiers by kind, base_spans and spans (kind:start:end by start, then kind,
    comma-joined; code points, end exclusive), counts of all by kind."""
    schema = T.StructType([docs.schema["doc_id"], *FOUND])

    def scan(batches):
        import pyarrow as pa

        find = Finder().spans
        for b in batches:
            cols: list[list] = [[] for _ in FOUND]
            for t in b.column("text").to_pylist():
                base, every = find(t)
                said = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in x) for x in (base, every)]
                row = [*(sum(k == i for _, k, _ in base) for i in range(4)), *said, *(sum(k == i for _, k, _ in every) for i in range(4))]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.string() if f.dataType == T.StringType() else pa.int64() for f in FOUND]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.names)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(scan, schema)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans", *[f"n_{k}_all" for k in KINDS])
