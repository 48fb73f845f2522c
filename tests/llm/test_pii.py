import re

import pytest

from pagemill.llm import pii

F = pii.Finder()


def said(text):
    base, every = F.spans(text)
    return [(pii.KINDS[k], text[s:e]) for s, k, e in every]


@pytest.mark.parametrize("text,found", [
    ("mail a.b+c@x-y.example.com now", [("email", "a.b+c@x-y.example.com")]),
    ("a@b", []),
    ("1.2.3.4.5 300.1.1.1", [("ip", "1.2.3.4")]),
    ("4111 1111 1111 1111", [("card", "4111 1111 1111 1111")]),
    ("4111 1111 1111 1112", []),
    ("+1 (974) 555-3436 x", [("phone", "+1 (974) 555-3436")]),
    ("john [at] example [dot] com", [("email", "john [at] example [dot] com")]),
    ("see john at mail3 dot example dot com.", [("email", "john at mail3 dot example dot com")]),
    ("look at the dot here", []),
    ("four one one one one one one one one one one one one one one one", [("card", "four one one one one one one one one one one one one one one one")]),
    ("plus one four one five five five five one two one two", [("phone", "plus one four one five five five five one two one two")]),
    ("one nine two dot one six eight dot one dot one", [("ip", "one nine two dot one six eight dot one dot one")]),
    ("jоhn@exаmple.com", [("email", "jоhn@exаmple.com")]),
    ("４１１１ １１１１ １１１１ １１１１", [("card", "４１１１ １１１１ １１１１ １１１１")]),
    ("one or two of the three", []),
    ("", []),
])
def test_spans(text, found):
    assert said(text) == found


def plain_base(text):
    """Base identifiers as the patterns say."""
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.findall("[0-9]", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_against_the_patterns():
    import random

    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice(["1", "2", "4", "7", ".", "-", " ", "+", "(", ")", "@", "a", "b.", "4111111111111111", "\n", "é"]) for _ in range(r.randint(0, 40)))
        assert F.base(t) == plain_base(t), t


def test_long_runs_take_linear_time():
    import time

    t = time.time()
    runs = ["1", "1.", "+1(", "a@", "one ", "one\n\n", "a at ", "a at b dot ", "a at b.", "a at b point ", "(at)", "a (at) b ", "a [dot] ", "( ", "[[", "plus ", "+ ", "1 dot ", "1 ( ", "-1-", "é1 "]
    for text in [x * (300_000 // len(x)) for x in runs] + [f"{a}{c * 300_000}{b}" for c in " \t\n" for a, b in (("", ""), ("( a", ""), ("( at", ")"), ("a at", "b dot c"), ("jane (at)", "b (dot) com"), ("1", "dot 1"), ("one", "two"), ("1 (", ") 1"), ("+", "1"))]:
        F.spans(text)
    assert time.time() - t < 60


def test_odd_rows(spark, docs_of, odd_rows):
    got = pii.find_pii(docs_of(odd_rows)).toPandas()
    assert len(got) == len(odd_rows) and (got[got.doc_id == 1].spans == "").all()
    assert pii.find_pii(docs_of(odd_rows).filter("false")).count() == 0


@pytest.mark.parametrize("text", ["jane [at] example dot com", "jane at example [dot] com", "jane@example dot com", "jane at example dot xyz", "jane at mail.example (dot) dk", "jane at example dot online", "jane <@> mail dot example [.] kr"])
def test_signs_of_an_address_each_in_its_own_way(text):
    assert said(text) == [("email", text)] and said(f"mail {text}, now") == [("email", text)]


@pytest.mark.parametrize("text", ["look at the dot here", "we were at this point we knew", "she came at some point later", "jane at example"])
def test_prose_with_the_words_is_no_address(text):
    assert said(text) == []


def disguised(r):
    """A text with one disguised identifier, its kind, and where it stands."""
    lead, tail = r.choice(["", "Contact: ", "write to\n", "call ", "(see "]), r.choice(["", ", please", ".\nNext", " - thanks", ")"])
    looks = {"a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "x": "х", "i": "і", **{str(d): chr(0xFF10 + d) for d in range(10)}}
    if r.random() < 0.5:
        ats = [" at ", " [at] ", "(at)", " (@) ", "{at}", " AT "]
        dots = [" dot ", " [dot] ", "(dot)", " (.) ", "[.]", " DOT "]
        word = lambda: "".join(r.choice("abcdefghkmnqrsuvwz") for _ in range(r.randint(3, 8)))
        body = word() + r.choice(["", ".x", "_7"]) + r.choice(ats) + word() + "".join(r.choice(dots) + word() for _ in range(r.randint(0, 1))) + r.choice(dots) + r.choice(["com", "travel", "dk", "example"])
        kind = "email"
    else:
        digits = [r.randint(0, 9) for _ in range(15)]
        digits.append(next(d for d in range(10) if pii.luhn([str(x) for x in [*digits, d]])))
        names = ["zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "cero uno dos tres cuatro cinco seis siete ocho nueve", "zéro un deux trois quatre cinq six sept huit neuf"]
        said_ = r.choice(names).split()
        body = r.choice([" ", ", ", "-"]).join(said_[d] for d in digits) if r.random() < 0.5 else "".join(looks[str(d)] for d in digits)
        kind = "card"
    return lead + body + tail, kind, len(lead), len(lead) + len(body)


def test_disguised_identifiers_map_back_to_their_source():
    import random

    r = random.Random(6)
    for _ in range(2000):
        text, kind, start, end = disguised(r)
        assert (start, pii.KINDS.index(kind), end) in F.spans(text)[1], text


def test_every_rewritten_sign_knows_its_source():
    import random

    r = random.Random(7)
    for _ in range(500):
        text = " ".join(disguised(r)[0] for _ in range(3))
        changed = F.rewrites(text)
        if changed is None:
            continue
        new, at, lo, hi = changed
        pieces = [new[a:b] for a, b in zip(at, [*at[1:], len(new)], strict=True)]
        assert "".join(pieces) == new and all(a <= b for a, b in zip(lo, hi, strict=True)) and lo == sorted(lo)
        for p, a, b in zip(pieces, lo, hi, strict=True):
            if len(p) == b - a:  # kept as it was, but for look-alikes
                assert p == text[a:b] or not text[a:b].isascii()
