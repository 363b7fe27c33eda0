import random

import numpy as np
import xxhash

from posthorn.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id long"


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(rows):
    """(doc_id, fingerprint, component_id) by comparing all pairs."""
    fp = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            ids[r] = min(ids.get(r, d), d)
    return sorted(((d, f"{fp[i]:016x}", ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 60, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "A b"), (n + 4, "a  B"), (None, "a b"), (n + 4, "a  B"), (n + 5, "x " * 20000)]
    rng.shuffle(rows)
    return rows


def test_fingerprint_is_the_definition():
    for _, t in corpus():
        assert simhash.fingerprint((t or "").encode()) == slow_fingerprint(t)
    assert simhash.fingerprint("É é A\x0bb\x85c d e".encode()) == slow_fingerprint("É é A\x0bb\x85c d e")


def test_near_duplicates_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 9) for d, t in rows], SCHEMA)  # clashing names
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == brute(rows)


def test_blocks_find_the_same_links(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = [np.uint64(0), np.uint64(1), np.uint64(7), np.uint64(15), np.uint64(31) << np.uint64(40)]
    values = sorted({int(x) for b in base for f in flips for x in (b ^ f, b ^ (f << np.uint64(13)))})
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")

    def labels(block, tile):
        from posthorn.operators.components import connected_components

        found = {r.node: r.root for r in connected_components(simhash.links(df, 4, block, tile)).collect()}
        return {v: found.get(v, v) for v in (r.fp for r in df.collect())}

    want = {}
    for v in (r.fp for r in df.collect()):
        want[v] = v
    for v in list(want):  # single links by brute force
        for w in list(want):
            if ((v ^ w) & (2**64 - 1)).bit_count() <= 4 and want[v] != want[w]:
                a, b = sorted((want[v], want[w]))
                want = {k: a if x == b else x for k, x in want.items()}
    assert labels(16_384, 512) == labels(3, 2) == labels(1, 1) == want


def test_bands_of_bands_share_a_value():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**64, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in values], np.uint64)

    def bands(v):
        out = set()
        for n, (at, bits) in enumerate(simhash._bands(4)):
            rest = v & ((1 << at) - 1) | (v >> (at + bits) << at)
            for k in range(5):
                lo, hi = 52 * k // 5, 52 * (k + 1) // 5
                out.add((n, v >> at & (1 << bits) - 1, k, rest >> lo & (1 << hi - lo) - 1))
        return out

    assert all(bands(int(a)) & bands(int(a ^ f)) for a, f in zip(values, flips, strict=True))


def test_radius_is_inclusive():
    a, b, c = 0, 0b1111, 0b11111 << 20
    child, root = simhash.link_block(np.array([a, b, c], np.uint64), None)
    assert child.tolist() == [b] and root.tolist() == [a]


def test_keep_one_keeps_columns_and_one_row_of_each_group(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 9) for d, t in rows], SCHEMA)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    truth = brute(rows)
    assert kept.count() == len({c for _, _, c in truth})


def test_hot_fingerprints_and_components(spark, monkeypatch):
    from posthorn.operators import components

    monkeypatch.setattr(components, "HOT", 3)
    monkeypatch.setattr(components, "MOST_HOT", 1000)
    rows = corpus()
    rows += [(1000 + i, rows[0][1]) for i in range(30)]
    df = spark.createDataFrame([(d, t, "x", 9) for d, t in rows], SCHEMA)
    assert sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=repr) == brute(rows)
    star = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(100, 101), (7, 200), (200, 201)], "src long, dst long")
    got = {r.node: r.root for r in components.connected_components(star).collect()}
    assert got == {**{i: 0 for i in range(40)}, 100: 100, 101: 100, 200: 0, 201: 0}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.keep_one(df).collect() == []
