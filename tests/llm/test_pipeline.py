import hashlib
import math
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
import corpus_pipeline  # noqa: E402
from posthorn.llm import mixing, quality_rules  # noqa: E402
from posthorn.llm.queries import model_file  # noqa: E402
from tests.llm import test_secrets, test_simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def size(t):
    return len((t or "").encode().split())


def rules_keep(text):
    m = dict(zip(quality_rules.MEASURES, quality_rules.measure_text((text or "").encode()), strict=True))
    mask = quality_rules.policy_mask(quality_rules.CURRENT)
    return not any(mask >> i & 1 and eval(r.fails.replace("AND", "and"), {}, m) for i, r in enumerate(quality_rules.RULES))


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5

    def stage(n, df):
        out = corpus_pipeline.STAGES[n][1](spark, df, SF)
        if n < 4:
            assert out.dtypes == docs.dtypes
        return spark.createDataFrame(out.collect(), out.schema)

    good = stage(0, docs)
    assert {r.doc_id for r in good.collect()} == {d for d, r in rows.items() if rules_keep(r.text)}

    one = stage(1, good)
    groups = test_simhash.brute([(r.doc_id, r.text) for r in good.collect()])
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, _, c in groups})

    clean = stage(2, one)
    before = {r.doc_id: r for r in one.collect()}
    found = {b[0]: b for b in test_secrets.brute([(d, r.text, r.source) for d, r in before.items()])}
    for r in clean.collect():
        text = before[r.doc_id].text
        cut = []
        for kind, a, b in (s.split(":") for s in found[r.doc_id][5].split(",") if s):
            a, b = int(a), int(b)
            if kind == "assign":
                a = b - len(__import__("re").search(r"[A-Za-z0-9+/_.=-]+$", text[a:b])[0].split("=")[-1])
            cut.append((a, b))
        out, at = [], 0
        for a, b in sorted(cut):
            if a >= at:
                out += [text[at:a], "[SECRET]"]
            at = max(at, b)
        assert r.text == "".join(out) + text[at:] and r.n_chars == len(r.text)

    mixed = stage(3, clean)
    own = {r.doc_id: tuple(r) for r in clean.collect()}
    copies = Counter(tuple(r) for r in mixed.collect())
    assert set(copies) <= set(own.values()) and max(copies.values()) <= 2
    total = sum(size(t[1]) for t in own.values())
    assert math.isclose(sum(size(t[1]) * n for t, n in copies.items()), 1.5 * total, rel_tol=0.2)
    want = mixing.mix(mixing.measured(clean)).collect()
    assert {r.key: r.copies for r in want if r.copies} == {t[0]: n for t, n in copies.items()}
    order = [r.doc_id for r in corpus_pipeline.STAGES[3][1](spark, clean, SF).collect()]
    assert order == [d for _, d in sorted((t, r.key) for r in want for t in r.slots)]

    last = corpus_pipeline.STAGES[4][1](spark, mixed, SF)
    library = sentencepiece.SentencePieceProcessor(model_file=model_file())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = []
    for t, n in copies.items():
        ids = library.encode(t[1], add_eos=True)
        wanted += [repr((t[0], t[3], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), ids))] * n
    assert sorted(repr(tuple(r)) for r in last.collect()) == sorted(wanted)
    assert sorted(repr(tuple(r)) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(wanted)


def test_odd_rows_pass_all_stages(spark, tmp_path):
    words = [" ".join(f"w{i}x{j}" for j in range(70)) for i in range(6)]
    long = " ".join(f"v{j}" for j in range(60_000))
    schema = "doc_id long, text string, source string, fail_bits map<string,string>, `key` string, __id int, n_words array<string>"
    rows = [
        (1, words[0], "a", {"k": None}, None, 1, ["x", None]),
        (1, words[0], "a", {"k": None}, None, 1, ["x", None]),  # a repeated row
        (1, words[1], None, None, "x", None, None),  # the same id, another text
        (None, words[2], "a", None, None, None, [None, "x"]),
        (3, words[3], "b", {}, "y", 2, []),
        (4, words[3], "b", {}, "y", 2, []),  # a tie but for its id
        (5, None, "a", None, None, None, None), (6, "", "b", None, None, None, None), (7, "few words", None, None, None, None, None),
        (8, long, "a", None, None, 1, None), (9, words[4] + " token = abcdefghijklmnop", "c", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    docs = df
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, SF)
        assert out.dtypes == df.dtypes
        docs = spark.createDataFrame(out.collect(), out.schema)
        texts = {r.text for r in docs.collect()}
        assert {words[0], words[1], words[2], words[3], long} <= texts or n == 3
        if n == 1:
            assert sorted((r.doc_id or 0, r.text[:3]) for r in docs.collect()) == [(0, "w2x"), (1, "w0x"), (1, "w1x"), (3, "w3x"), (8, "v0 "), (9, "w4x")]
        if n == 2:
            assert words[4] + " token = [SECRET]" in texts
    sf = str(tmp_path)
    df.write.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf)
    assert got.count() == docs.count() and got.where("n_tokens > 60000").count() > 0
    empty = str(tmp_path / "empty")
    df.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []
