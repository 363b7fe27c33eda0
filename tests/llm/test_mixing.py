import math
import random
from collections import Counter

import pytest

from posthorn.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, target string"


def rows(n=400, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.choice(["hot", "hot", "hot", "b", "ä", "", None, "Z"])
        out.append((i, " ".join("w" * (1 + k % 3) for k in range(rng.choice([0, 1, 5, 40, 900]))), s, 1, "x"))
    out += [(5000, None, "only-null", 1, "x"), (None, "a b c", "hot", 1, "x"), (7, "a b", "b", 1, "x"), (7, "a b", "b", 1, "x"), (8, "x y z", "tiny", 1, "x")]
    return out


def size(t):
    return len((t or "").encode().split())


def targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """Targets by the iteration that the contract describes."""
    target, left = [0.0] * len(sizes), share * sum(sizes)
    open_ = [i for i, n in enumerate(sizes) if n]
    while open_:
        unit = left / sum(weights[i % 3] for i in open_)
        full = [i for i in open_ if weights[i % 3] * unit > most * sizes[i]]
        for i in full or open_:
            target[i] = min(most * sizes[i], weights[i % 3] * unit)
            left -= target[i]
        open_ = [i for i in open_ if i not in full] if full else []
    return target


def brute(data, block, weights=(5.0, 2.0, 1.0)):
    """(key, source, size, taken, slots) of every row, by laying out words one by one."""
    names = sorted({s for _, _, s, *_ in data}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(t) for _, t, x, *_ in data if x == s) for s in names]
    goal = targets(sizes, weights)
    total = sum(goal)
    number = math.ceil(total / block)
    edges = [sum(goal[: i + 1]) / total for i in range(len(goal))] if total else []
    ranks = [[] for _ in names]  # slots of each source
    for t in range(number):
        x = (((t + 1) * 0x9E3779B97F4A7C15) % 2**64 >> 11) / 2**53
        ranks[next(i for i, e in enumerate(edges) if x < e or e == edges[-1])].append(t)
    return names, sizes, goal, ranks


def check(data, got, block, weights=(5.0, 2.0, 1.0)):
    """Every source takes exactly the words of the blocks that its slots name, and first words have these slots."""
    names, sizes, goal, ranks = brute(data, block, weights)
    for s, n, g, t in zip(names, sizes, goal, ranks, strict=True):
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {n} and {r.target for r in own}.pop() == pytest.approx(g)
        blocks = -(-n // block)
        t = t[: 2 * blocks]
        width = [min(block, n - b * block) for b in range(blocks)]
        assert sum(r.taken for r in own) == sum(width[i % blocks] for i in range(len(t)))
        assert abs(sum(r.taken for r in own) - g) <= 4 * block
        for r in own:
            # Some place of the document explains words and slots.
            places = range(n - r["size"] + 1) if r["size"] else [0]
            fits = lambda a: r.taken == sum(
                max(0, min(a + r["size"], (b + 1) * block) - max(a, b * block)) * len(t[b::blocks]) for b in range(a // block, (a + r["size"] - 1) // block + 1)
            ) and list(r.slots) == t[a // block :: blocks]
            assert any(map(fits, places)) if r["size"] else (r.taken, list(r.slots)) == (0, [])


def test_targets_by_definition(spark):
    for sizes in ([10, 100, 1000], [7, 7, 7, 7], [], [0, 0], [0, 10], [1, 10, 100, 1, 0, 10], [5, 2, 1], [3, 1000, 7, 9, 2, 2, 2, 500]):
        df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
        got = mixing.source_table(df).orderBy("sid").collect()
        assert [r.src for r in got] == [f"s{i}" for i in range(len(sizes))] and [r.sid for r in got] == list(range(len(sizes)))
        assert [r.target for r in got] == pytest.approx(targets(sizes))
    assert targets([10, 100, 1000]) == [20.0, 200.0, 1.5 * 1110 - 220] and sum(targets([7, 7, 7, 7])) == pytest.approx(42)


@pytest.mark.parametrize(("block", "edges"), [(1, 1000), (7, 0), (32, 1000)])
def test_each_source_gives_what_its_slots_say(spark, block, edges, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 200)
    data = [(d, (t or "")[:90], *rest) for d, t, *rest in rows(120)]
    df = spark.createDataFrame(data, SCHEMA)
    got = mixing.mix(mixing.measured(df), block=block, edges=edges).collect()
    assert Counter((r.key, r.source, r["size"]) for r in got) == Counter((d, s, size(t)) for d, t, s, *_ in data)
    assert all(0 <= r.taken <= 2 * r["size"] and r.copies == len(r.slots) <= 2 for r in got)
    check(data, got, block)


def test_other_points_give_another_mix(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    golden = {r.source: 0 for r in df.collect()}
    other = dict(golden)
    sized = mixing.measured(df)
    for r in mixing.mix(sized).collect():
        golden[r.source] += r.taken
    monkeypatch.setattr(mixing, "_points", lambda first, last: __import__("numpy").full(last - first, 0.999999))  # the last source with a target
    for r in mixing.mix(sized).collect():
        other[r.source] += r.taken
    assert golden != other and [s for s, n in other.items() if n] == [None]


def test_points_are_spread_and_exact_for_late_slots():
    for at in (0, 10**12, 2**62):
        x = mixing._points(at, at + 600)
        assert [float(v) for v in x[:3]] == [((t + 1) * 0x9E3779B97F4A7C15 % 2**64 >> 11) / 2**53 for t in range(at, at + 3)]
        for n in range(50, 600, 50):
            assert abs((x[:n] < 0.3).sum() - n * 0.3) < 4


def test_reruns_and_partitions_agree(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    monkeypatch.setattr(mixing, "CHUNK", 50)
    monkeypatch.setattr(mixing, "BUCKET", 50)

    def run(d):
        return sorted(map(repr, mixing.mix(mixing.measured(d), block=16).drop("row").collect()))

    assert run(df.repartition(3)) == run(df.repartition(7, "text"))


def test_many_sources(spark):
    data = [(i, "w " * (1 + i % 7), f"s{i % 700:03d}", 1, "x") for i in range(2000)]
    sized = mixing.measured(spark.createDataFrame(data, SCHEMA))
    few, many = (sorted(map(repr, mixing.mix(sized, edges=e).collect())) for e in (10**6, 10))
    assert few == many


def test_mixed_documents_keep_columns_and_follow_the_slots(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    want = mixing.mix(mixing.measured(df)).collect()
    assert out.count() == sum(r.copies for r in want)
    taken = sum(size(r.text) for r in out.collect())
    assert math.isclose(taken, 1.5 * sum(size(t) for _, t, *_ in data), rel_tol=0.1)
    monkeypatch.setattr(mixing, "PART", 100)
    told = mixing.mixed_documents(df, slot="at", ordered=True)
    assert told.rdd.getNumPartitions() > 3 and told.columns == [*df.columns, "at"]
    at = [r["at"] for r in told.collect()]
    assert at == sorted(at) == sorted(t for r in want for t in r.slots)


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(mixing.measured(spark.createDataFrame([], SCHEMA))).collect() == []
    df = spark.createDataFrame([(1, None, "a", 1, ""), (2, " ", None, 1, "")], SCHEMA)
    assert sorted((r.key, r.taken, r.target) for r in mixing.mix(mixing.measured(df)).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]
    assert mixing.mixed_documents(df).collect() == [] and mixing.mixed_documents(df, ordered=True).collect() == []
