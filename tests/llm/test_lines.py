import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import lines as L
from tests.llm.conftest import prose


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=30), st.lists(st.integers(0, 9), max_size=30))
def test_patience_aligns_equal_lines_in_order(a, b):
    pairs = L.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_patience_finds_moved_and_inserted_blocks():
    a = list(range(10)) + [50, 51] + list(range(10, 20))
    assert L.patience(a, list(range(20))) == [(i, i) for i in range(10)] + [(i + 2, i) for i in range(10, 20)]
    assert L.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)] and L.patience([], [1]) == []


def test_against_brute_force(spark, docs_of):
    r = random.Random(4)
    pool = [prose(i, 8).replace("\n", " ") for i in range(25)]
    rows = [(i, "\n".join(r.choice([r.choice(pool), prose(1000 + i * 50 + j, 8).replace("\n", " "), "short", ""]) for j in range(r.randint(0, 12)))) for i in range(50)]
    rows += [(100 + i, rows[5][1]) for i in range(5)] + [(200 + i, pool[0]) for i in range(30)]
    out = L.without_repeats(docs_of(rows))
    assert {x["doc_id"]: x["text"] for x in out.collect()} == all_earlier(rows)


def test_odd_rows_and_stage(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    out = L.deduplicated_lines(spark, docs, "")
    assert out.columns == docs.columns and out.count() == len(odd_rows)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got[3] == [odd_rows[2][1]] and got[4] == ["", ""] and got[1] == [None]
    assert L.deduplicated_lines(spark, docs.filter("false"), "").count() == 0
    twice = docs_of([(4, odd_rows[3][1]), (4, odd_rows[3][1])])
    assert sorted(r["text"] for r in L.deduplicated_lines(spark, twice, "").collect()) == ["", odd_rows[3][1]]


def patience_by_hand(a, b):
    """Aligned positions, from the definition: equal ends, then the lines that occur once in both."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in patience_by_hand(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return patience_by_hand(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    once = [(a.index(x), b.index(x)) for x in a if a.count(x) == 1 and b.count(x) == 1]
    best = [[] for _ in once]  # the longest rising run that ends at each; of equals the one that leaves b earlier
    for k, (_, j) in enumerate(once):
        before = [best[m] for m in range(k) if once[m][1] < j]
        best[k] = [*max(before, key=lambda r: (len(r), -r[-1][1]), default=[]), once[k]]
    run = max(best, key=lambda r: (len(r), -r[-1][1]), default=[])
    if not run:
        return []
    out, i0, j0 = [], 0, 0
    for i, j in [*run, (len(a), len(b))]:
        out += [(x + i0, y + j0) for x, y in patience_by_hand(a[i0:i], b[j0:j])]
        if i < len(a):
            out.append((i, j))
        i0, j0 = i + 1, j + 1
    return out


def blocks_by_hand(a, b):
    out, pairs = set(), patience_by_hand(a, b)
    blocks = []
    for i, j in pairs:
        if blocks and blocks[-1][-1] == (i - 1, j - 1):
            blocks[-1].append((i, j))
        else:
            blocks.append([(i, j)])
    for x in blocks:
        if sum(len(a[i]) for i, _ in x) >= L.MIN_CHARS or (a == b and any(a)):
            out |= {i for i, _ in x}
    return out


def all_earlier(rows):
    """doc_id -> kept text, each document aligned with every earlier one."""
    split = [[x.replace("\r", " ").replace("\t", " ").strip(" ") for x in (t or "").split("\n")] for _, t in rows]
    out = {}
    for k, (i, t) in enumerate(rows):
        ls, gone = split[k], set()
        for e in range(k):
            gone |= blocks_by_hand(ls, split[e])
        out[i] = "\n".join(x for j, x in enumerate((t or "").split("\n")) if j not in gone)
    return out


def test_lines_that_the_first_holder_leaves_go_by_the_next(spark, docs_of):
    hot, other = "a line that many documents hold", "another line that several hold"
    own = [f"a line of document {i} and no other" for i in range(60)]
    # The first holders have the line twice, or the two lines in the other order.
    rows = [(i, "\n".join([own[i], hot, own[i] + "x", hot, own[i] + "y"])) for i in range(5)]
    rows += [(5, "\n".join([own[5], other, own[5] + "x", hot, own[5] + "y"]))]
    rows += [(i, "\n".join([own[i], hot, own[i] + "x", other, own[i] + "y"])) for i in range(6, 40)]
    rows += [(i, "\n".join([own[i], own[i] + "x"])) for i in range(40, 60)] + [(i, f"a line of its own for document {i}") for i in range(60, 100)]
    got = {x["doc_id"]: x["text"] for x in L.without_repeats(docs_of(rows)).collect()}
    assert got == all_earlier(rows)
    assert all(hot not in got[i] and other not in got[i] for i in range(7, 40)) and hot in got[4]


def test_runs_of_short_lines_and_short_texts_meet(spark, docs_of):
    verse = "\n".join(f"verse {k}" for k in range(30))
    rows = [(i, f"a line of its own for document {i}\n{verse}\nand one more for document {i}") for i in range(4)]
    rows += [(4, verse), (5, verse), (6, "tiny"), (7, "tiny"), (8, "tiny\n"), (9, "a\n\nb"), (10, "a\n\nb"), (11, " "), (12, " ")]
    rows += [(i, f"a line of its own for document {i}") for i in range(13, 40)]
    got = {x["doc_id"]: x["text"] for x in L.without_repeats(docs_of(rows)).collect()}
    assert [("verse" in got[i]) for i in range(6)] == [True, False, False, False, False, False]
    assert [got[i] for i in range(6, 13)] == ["tiny", "", "tiny\n", "a\n\nb", "", " ", " "]


def test_short_lines_against_all_earlier_documents(spark, docs_of):
    r = random.Random(8)
    words = ["ab", "", "cdefg", "hijklmnop", "qrstuvwxyz abc", "a line of more than twenty", "another line of more than twenty"]
    rows = [(i, "\n".join([f"id {i} {r.random()}", *(r.choice(words) for _ in range(r.randint(3, 12)))])) for i in range(60)]
    rows += [(i, f"a line of its own for document {i}") for i in range(60, 200)]
    assert {x["doc_id"]: x["text"] for x in L.without_repeats(docs_of(rows)).collect()} == all_earlier(rows)


def test_lines_of_most_documents_go(spark, docs_of):
    rows = [(i, f"a line of its own for document {i}\nthe same line in nearly all of them\nthe end of document {i}, its own") for i in range(40)]
    rows += [(i, f"a line of its own for document {i}") for i in range(40, 44)]
    got = {x["doc_id"]: x["text"] for x in L.without_repeats(docs_of(rows)).collect()}
    assert got == all_earlier(rows) and [i for i in got if "the same line" in got[i]] == [0]
