import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pagemill.llm import turns as M

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, n string, seq int, key string, `a.b` string"


def faults(rows):
    """(role, text, blank, duplicate, truncated) of ordered rows (role, text)."""
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(WHITE)
        blank, again = not bare, (role, text) in seen
        out.append((role, text, blank, again and not blank, not blank and not again and bare[-1] not in ".!?"))
        seen.add((role, text))
    return out


def every_repair(rows):
    """The least (cost, audit, turns) of all edits, with two insertions at most in each gap."""
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    choices = []
    for role, text, blank, again, cut in faults(rows):
        some = [(3, "D", [])]
        if not blank and not again:
            some += [(cut, "K", [(role, text)]), (2 + cut, "R", [("user", text)]), (2 + cut, "R", [("assistant", text)])]
        choices.append(some)
    best = None
    for filled in itertools.product(gaps, repeat=len(rows) + 1):
        for picked in itertools.product(*choices):
            cost = sum(c for c, _, _ in picked) + 2 * sum(map(len, filled))
            if best is not None and cost > best[0]:
                continue
            audit, turns = "I" * len(filled[0]), [(r, "") for r in filled[0]]
            for (_, letter, kept), more in zip(picked, filled[1:], strict=True):
                audit, turns = audit + letter + "I" * len(more), [*turns, *kept, *((r, "") for r in more)]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
                best = min(best or (cost, audit, turns), (cost, audit, turns))
    return best


def plain(rows):
    """The same by what the written turns begin with, row after row: for long conversations."""
    after = {"": {"user": "u"}, "s": {"user": "u"}, "u": {"assistant": "a"}, "a": {"user": "u"}}

    def filled(states):
        for _ in range(2):
            for at, (cost, audit, turns) in list(states.items()):
                for role, to in after[at].items():
                    new = (cost + 2, audit + "I", (turns, (role, "")))
                    states[to] = min(states.get(to, new), new, key=lambda x: x[:2])
        return states

    states = filled({"": (0, "", None)})
    for role, text, blank, again, cut in faults(rows):
        new: dict = {}

        def put(to, x, new=new):
            new[to] = min(new.get(to, x), x, key=lambda y: y[:2])

        for at, (cost, audit, turns) in states.items():
            put(at, (cost + 3, audit + "D", turns))
            if blank or again:
                continue
            for given, to in after[at].items():
                put(to, (cost + 2 + cut, audit + "R", (turns, (given, text))))
            if role[:1] in ("u", "a") and role[:1] in after[at].values() or (role[:1], at) == ("s", ""):
                put(role[:1], (cost + cut, audit + "K", (turns, (role, text))))
        states = filled(new)
    cost, audit, turns = min((states[s] for s in ("", "a") if s in states), key=lambda x: x[:2])
    out = []
    while turns:
        turns, one = turns
        out.append(one)
    return cost, audit, out[::-1]


def expected(rows, repair):
    """Report rows of conversations from (conv_id, turn, role, text) that are left, by conv_id."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv and r[4]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        told = faults([(r[2], r[3]) for r in mine])
        given = [r[1] for r in mine if r[1] is not None]
        cost, audit, turns = repair([(r[2], r[3]) for r in mine]) if mine else (0, "", [])
        pairs = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
        out[conv] = (gaps, sum(f[2] for f in told), sum(f[3] for f in told), sum(f[4] for f in told), pairs, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if what == 4 else role
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, role, text, what != 0)] * (2 if what == 3 else 1)
    return out


def found(spark, rows):
    given = spark.createDataFrame([(*r, "n", 1, "k", "x") for r in rows], SCHEMA).repartition(3)
    report, turns = M.repaired(M.damaged(given), F.col("n"))
    out = report.join(M.digests(turns), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.sha256 or hashlib.sha256(b"").hexdigest()) for r in out}
    assert len(got) == len(out)
    return got


ROLES = ["system", "user", "assistant", "tool", "", None, "user", "assistant"]
TEXTS = ["Yes.", "No?", "cut", " ", None, "Good!\n", "a. b", "\x0b\t", "é…", " "]


def test_small_ones_against_every_edit(spark):
    r = random.Random(7)
    rows = [(c, r.choice([None, 0, 1, 2, 5]), r.choice(ROLES), r.choice(TEXTS)) for c in range(120) for _ in range(r.choice([1, 1, 2, 2, 3]))]
    rows = [x for x in rows if sum(d[4] for d in damaged([y for y in rows if y[0] == x[0]])) <= 3]
    assert found(spark, rows) == expected(damaged(rows), every_repair)


def test_long_ones(spark):
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant"] * 6 + ROLES), r.choice([f"text {t}.", f"text {t}", f"text {t % 50}!", *TEXTS])) for c, n in ((1, 3000), (2, 40), (3, 1), (None, 200)) for t in range(n)]
    rows += [(1, None, "user", "Same."), (1, 7, "user", "Same."), (1, 7, "user", "Same.")]  # ties and repeated rows
    rows += [(4, None, "user", "a row of many."), *[(4, 3, "assistant", "the same row.")] * 700]
    rows += [(5, 1, "user", "long " * 100_000 + "."), (5, 2, "assistant", "x" * 300_000)]
    assert found(spark, rows) == expected(damaged(rows), plain)


def test_real_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", "cut")]
    report, turns = M.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [(r.role, r.text, r.edit) for r in turns.orderBy("seq").collect()] == [("user", "Hi.", "K"), ("assistant", "", "I"), ("user", "Again.", "K"), ("assistant", "cut", "K")]
    assert report.first().cost == 3


def test_both_brute_forces_agree():
    r = random.Random(3)
    for _ in range(60):
        rows = [(r.choice(["system", "user", "assistant", "tool"]), r.choice(["Yes.", "No?", "cut", " "])) for _ in range(r.randint(1, 3))]
        assert every_repair(rows)[:2] == plain(rows)[:2]


def test_products_do_not_depend_on_grouping():
    r = random.Random(5)
    for _ in range(50):
        kinds = bytes(r.choice(range(9)) for _ in range(12))
        left = M.KINDS[kinds[0]]
        for k in kinds[1:]:
            left = M.times(left, M.KINDS[k])
        right = M.KINDS[kinds[-1]]
        for k in kinds[-2::-1]:
            right = M.times(M.KINDS[k], right)
        assert left == right == M.block(kinds, {})


def test_empty(spark):
    assert found(spark, []) == {}


@pytest.mark.parametrize("texts", [(None, None), ("", " ")])
def test_none_left_but_blanks(spark, texts):
    got = found(spark, [(1, None, "user", texts[0]), (1, None, "user", texts[1])])
    assert got == expected(damaged([(1, None, "user", texts[0]), (1, None, "user", texts[1])]), every_repair)
