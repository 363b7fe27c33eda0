import pyarrow as pa

from posthorn.llm import secrets, simhash
from posthorn.llm.arrow import slices
from posthorn.llm.rows import fingerprint, row_id

SCHEMA = "doc_id long, text string, a string, b string, m map<string,string>, l array<string>"


def frame(spark):
    rows = [
        (1, "t", None, "x", {"k": None}, ["u", None]),
        (1, "t", "x", None, {"k": None}, ["u", None]),
        (1, "t", "x", None, {"k": None}, [None, "u"]),
        (1, "t", "x", None, {}, [None, "u"]),
        (1, "t", "x", None, None, [None, "u"]),
        (1, "t", "x", None, None, None),
        (1, None, "x", None, None, None),
        (None, None, "x", None, None, None),
        (1, "", "x", None, None, None),
    ]
    return spark.createDataFrame(rows + rows[:2], SCHEMA)


def test_rows_that_differ_anywhere_have_different_ids(spark):
    df = frame(spark)
    for mark in (row_id(df, "doc_id"), fingerprint(df)):
        got = [r[0] for r in df.select(mark).collect()]
        assert len(set(got)) == 9 and got[0] == got[9] and got[1] == got[10] and None not in got


def test_keep_one_and_redact_keep_rows_that_differ_in_a_null(spark):
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, long, None, "x", None, None), (1, other, "x", None, None, None), (1, None, None, "y", {"k": "v"}, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert simhash.keep_one(df).count() == 3
    bare = "Zx9aB3dE6gH9jK2mN5pQ8"
    df = spark.createDataFrame([(1, bare, None, "x", None, None), (1, bare, "x", None, None, None), (1, bare, "x", None, {}, None)], SCHEMA)
    out = secrets.redact(df, owner="a")
    assert sorted((repr(r.a), repr(r.b), r.text) for r in out.collect()) == sorted((repr(r.a), repr(r.b), "[SECRET]") for r in df.collect())


def test_slices_are_bounded_by_rows_and_bytes():
    texts = ["x" * n for n in (5, 9000, 20000, 1, 1, 1, 1, 30000)] * 40
    batch = pa.record_batch([pa.array(texts), pa.array(range(len(texts)))], ["t", "n"])
    parts = list(slices([batch, batch.slice(0, 0)], 16, 25_000))
    assert [x for p in parts for x in p.column(1).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or p.num_rows <= 16 and p.nbytes <= 25_000 for p in parts)
