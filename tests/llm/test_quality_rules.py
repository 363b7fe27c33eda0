import random

from posthorn.llm import quality_rules as q

SCHEMA = "doc_id long, text string, n_words string, fail_bits int"
TEXTS = [
    None, "", " \n\t", "a", "a b c a b c", "x\n\nx\nx \n x", "é# *$ %&|<> é", "a\x0bb\x0cc\rd\x1ce\x85f g h", "w " * 3000, "\n".join(["same line here"] * 9),
    "A" * 50_000, "UP UP " * 100, "one two three four five " * 2 + " ".join(map(str, range(100))),
]


def brute(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(3)} if len(win) < 2000 else set(range(len(w)))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(covered), len(re.findall("[A-Z]", t)), len(re.findall("[A-Za-z]", t))


def frame(spark):
    return spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(TEXTS)] + [(None, "a", "", 0), (0, "b", "", 0), (0, "b", "", 0)], SCHEMA)


def test_measures_match_brute_force():
    rng = random.Random(2)
    for t in TEXTS + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(80))) for _ in range(60)]:
        assert q.measure_text((t or "").encode()) == brute(t), t


def test_large_texts_use_the_wide_codes(monkeypatch):
    words = [b"%d" % (i % 7) for i in range(50)] + [b"x%d" % i for i in range(50)]
    want = q._repeated(words)

    class Long(list):
        def __len__(self):
            return super().__len__()

    assert want == 50 and q._repeated(Long(words)) == want


def test_ledger_bits_policies_and_ablations(spark):
    led = q.ledger(frame(spark))
    assert led.columns == ["doc_id", *q.MEASURES, "fail_bits"]
    rows = led.collect()
    for r in rows:
        for i, rule in enumerate(q.RULES):
            names = {m: r[m] for m in q.MEASURES}
            assert bool(r.fail_bits >> i & 1) == bool(eval(rule.fails.replace("AND", "and"), {}, names)), rule
    for policy in q.POLICIES:
        mask = q.policy_mask(policy)
        found = {r["rule"]: (r.n_failed, r.n_only) for r in q.ablations(led, policy).collect()}
        bits = [r.fail_bits & mask for r in rows]
        assert found == {x.name: (sum(b >> i & 1 for b in bits), sum(b == 1 << i for b in bits)) for i, x in enumerate(q.RULES) if mask >> i & 1}


def test_filter_keeps_what_the_ledger_keeps(spark):
    df = frame(spark)
    out = q.filter_documents(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    good = [r for r in df.collect() if not any(eval(x.fails.replace("AND", "and"), {}, dict(zip(q.MEASURES, brute(r.text), strict=True))) for x in q.RULES)]
    assert sorted(map(repr, out.collect())) == sorted(map(repr, good))


def test_empty_table(spark):
    assert q.ledger(frame(spark).limit(0)).collect() == [] and q.filter_documents(frame(spark).limit(0)).collect() == []
