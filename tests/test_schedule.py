import random

import pytest

from pagemill.operators import planning as P
from pagemill.operators import quota as Q

CALLS = "scope string, provider string, seq long, ready double, tokens long"


@pytest.mark.parametrize("rpm,tpm", [(4, 0), (0, 900), (3, 500), (0, 0), (1, 100)])
def test_no_window_passes_a_limit_and_none_waits_in_vain(spark, rpm, tpm):
    r = random.Random(rpm + tpm)
    calls = [(s, "qwen", i, 1000.0 + r.choice([0, 0, 1, 5, 70]) * i, r.choice([0, 1, 50, 200, 800])) for s in "ab" for i in range(60)]
    limits = Q.limits_of(spark, [("qwen", rpm, tpm, 0, 0)])
    got = Q.schedule(spark.createDataFrame(calls, CALLS).repartition(3), limits).collect()
    assert len(got) == len(calls)
    for s in "ab":
        mine = sorted((x for x in got if x.scope == s), key=lambda x: x.seq)
        for i, x in enumerate(mine):
            before = mine[:i]
            earliest = max([x.ready, *(y.start for y in before)])

            def fits(at, x=x, before=before):
                window = [y for y in before if at - y.start <= 60]
                used = sum(y.tokens for y in window)
                return (rpm <= 0 or len(window) < rpm) and (tpm <= 0 or not window or (used == 0 if x.tokens >= tpm else used + x.tokens <= tpm))

            assert x.start >= earliest and fits(x.start)
            # At once, or a margin after the last call that still was in the way.
            assert x.start == earliest or any(abs(y.start + 60.25 - x.start) < 1e-6 and not fits(y.start + 60) for y in before)


def test_a_day_that_is_used_up(spark):
    limits = Q.limits_of(spark, [("gemini", 0, 0, 2, 0)])
    day = 86_400.0
    calls = [("a", "gemini", i, t, 1) for i, t in enumerate((day * 10 + 8 * 3600 + 1, day * 10 + 8 * 3600 + 2, day * 10 + 9 * 3600, day * 11 + 8 * 3600 + 5))]
    assert [x.start is None for x in Q.schedule(spark.createDataFrame(calls, CALLS), limits).orderBy("seq").collect()] == [False, False, True, False]


def test_translate_waits_for_its_start(spark, tmp_path):
    items = spark.createDataFrame([("j", b, b, f"t{b}", 1, 1) for b in range(4)], "job string, batch_no int, first_seen int, text string, input_tokens long, output_tokens long")
    starts = spark.createDataFrame([("j", 0, 105.0), ("j", 1, 99.0), ("j", 2, None)], "job string, batch_no int, start double")
    log = str(tmp_path / "log")

    def sleep(seconds):
        with open(log, "a") as f:
            f.write(f"{seconds}\n")

    got = {r.seq: (r.translated_text, r.error) for r in P.translate(items.coalesce(1), ["job"], P.stand_in(), starts, clock=lambda: 100.0, sleep=sleep).collect()}
    assert got == {0: ("vi:t0", None), 1: ("vi:t1", None), 2: (None, "the day's requests are used up"), 3: ("vi:t3", None)}
    assert sorted(map(float, open(log).read().split())) == [0.0, 0.0, 5.0]
