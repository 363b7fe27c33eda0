"""Scored matches against brute force, in one slice and in many."""

import random

import pytest

from posthorn.operators import matching as X


@pytest.mark.parametrize("slice_rows", [10**6, 60])
def test_scored_matches_equal_brute_force_in_slices(spark, slice_rows):
    draw = random.Random(5)
    some = lambda n: [(draw.randrange(n), k, f"{k}{draw.randrange(m)}") for k, m, c in (("article", 30, 90), ("brand", 9, 60), ("domain", 6, 40)) for _ in range(c)]
    signals, history = some(40), some(25)
    signals += signals[:20]  # repeated rows count once
    found = X.scored_matches(spark.createDataFrame(signals, "message long, kind string, value string"), spark.createDataFrame(history, "company long, kind string, value string"), slice_rows=slice_rows)
    got = {r.message: (r.company, r.confidence, r.method, r.multi_company) for r in found.collect()}
    want = {}
    for m in range(40):
        own = {x[1:] for x in signals if x[0] == m}
        shared = {c: [k for k, _ in own & {x[1:] for x in history if x[0] == c}] for c in range(25)}
        score = {c: sum(X.WEIGHTS[k] for k in ks) for c, ks in shared.items() if sum(X.WEIGHTS[k] for k in ks) >= X.THRESHOLD}
        if score:
            c = min(score, key=lambda c: (-score[c], c))
            want[m] = (c, min(score[c], X.CAP), max(shared[c], key=X.WEIGHTS.get), len(score) > 1)
    assert want and got == want
