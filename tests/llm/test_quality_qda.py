import math
import zlib

import numpy as np
import pytest

from posthorn.llm import quality_qda as q

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score double, quality int"


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0


def test_statistics_are_finite_for_odd_texts():
    for t in ["", " \n", "a", "é" * 10_000, "!!! ###", "word " * 5000, "\n\na\n\na", "|", "7"]:
        x = q.statistics(t.encode())
        assert len(x) == len(q.FEATURES) and all(map(math.isfinite, x))
    assert q.statistics(b"") == [0.0] * len(q.FEATURES)


def test_scores_are_the_density_ratio():
    rng = np.random.default_rng(0)
    x = {k: np.rint(rng.normal(k, 1 + k, (300, len(q.FEATURES))) * q.SCALE) for k in (0, 1)}
    model = q.fit({k: (300, v.sum(0), v.T @ v) for k, v in x.items()}, alpha=0, gamma=0)

    def log_density(rows, k):
        v = x[k] / q.SCALE
        c = np.cov(v.T)
        d = rows / q.SCALE - v.mean(0)
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1]

    rows = np.vstack((x[0][:20], x[1][:20]))
    want = 1 / (1 + np.exp(-np.clip(log_density(rows, 1) - log_density(rows, 0), -500, 500)))
    assert np.allclose(model.scores(rows), want, atol=1e-9)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in q.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == held(d) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    out = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if held(r.doc_id)]
    assert np.mean([a == b for a, b in out]) > 0.95
    # Labels of held-out rows have no influence.
    flipped = labels.withColumn("quality", (1 - labels.quality) * held_column(labels) + labels.quality * (1 - held_column(labels)))
    assert {r.doc_id: r.score for r in q.classify(docs, flipped).collect()} == pytest.approx({d: r.score for d, r in got.items()}, abs=0)


def held_column(labels):
    return (q.fold(labels.doc_id) == 0).cast("int")


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 0.5, 0), (None, "a b", 0.5, 0), (1, "x", 0.5, 1), (1, "x", 0.5, 1)], SCHEMA)
    labels = spark.createDataFrame([(1, None), (None, 1), (1, 1), (1, 0)], "doc_id long, quality int")
    got = q.classify(docs, labels).collect()
    assert sorted((r.doc_id is None, r.held_out) for r in got) == sorted((d is None, held(d)) for d in (1, None, 1, 1))
    assert len({r.score for r in got}) == 1
    assert q.classify(docs.limit(0), labels).collect() == []
    assert len(q.classify(docs, labels.limit(0)).collect()) == 4


def slow_statistics(t):
    """FEATURES by their definitions, over characters instead of bytes."""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", t) if w]
    if not words:
        return [0.0] * len(q.FEATURES)
    solid = "".join(words)
    lines = [x for x in t.split("\n") if __import__("re").search(r"[^\x20\x09-\x0d]", x)]
    n, c = len(words), lambda chars: sum(x in chars for x in t)
    upper, letters = c("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), sum(x.isascii() and x.isalpha() for x in t)
    return [
        math.log(1 + n), math.log(len(solid) / n), math.sqrt(c("#*$%&<>") / len(solid)), math.sqrt(upper / letters) if letters else 0,
        math.sqrt(c("0123456789") / len(solid)), math.sqrt(c(".,;:?'\"()-") / len(solid)), math.sqrt(c("|") / n), math.sqrt(c("!") / n),
        len(set(words)) / n**0.8, math.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n),
        math.sqrt((len(lines) - len(set(lines))) / len(lines)), math.log(1 + n / len(lines)),
        math.sqrt(max(words.count(w) for w in set(words)) / n), math.sqrt(sum(not x.isascii() for x in t) / len(solid)),
    ]


def test_statistics_are_their_definitions(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in [*texts, "é É ß|! 12 #a\nx\n\nx\n\x0b\t", "Hello, \"world\" (a-b); c: d? 'e'!", "|||", "\x00 \x85 "]:
        assert q.statistics((t or "").encode()) == pytest.approx(slow_statistics(t or "")), t


@pytest.mark.parametrize("texts", [["same text"] * 40, [None, ""] * 20, ["a b"] * 20 + [None] * 20])
def test_training_rows_without_any_variance(spark, texts):
    docs = spark.createDataFrame([(i, t, 0.5, 0) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = q.classify(docs, labels).collect()
    assert len(got) == 40 and all(0 <= r.score <= 1 for r in got)


def test_forward_substitution_and_singular_covariances():
    rng = np.random.default_rng(1)
    a = np.tril(rng.normal(size=(14, 14))) + 5 * np.eye(14)
    b = rng.normal(size=(14, 7))
    assert np.allclose(a @ q._forward(a, b), b)
    one = np.outer(np.arange(1.0, 15), np.arange(1.0, 15))
    f = q._cholesky(one)
    assert np.allclose(f @ f.T, one, rtol=1e-3)
