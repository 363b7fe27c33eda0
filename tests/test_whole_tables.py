import re

from posthorn import catalogue
from posthorn.operators import matching as X

SF = "/root/testdata/sf0.001"


def test_name_classes_give_all_pairs(spark):
    words = ["red", "big", "bolt", "gear", "m8", "steel", "x"]
    names = ["", None, "--"] + [" ".join(w for k, w in enumerate(words) if i >> k & 1) for i in range(1, 128)] * 2 + ["Bolt, RED", "bolt red", "red bolt red"]
    rows = list(enumerate(names))
    found = X.similar_name_classes(spark.createDataFrame(rows, "id long, name string")).collect()
    rep, near = {}, {}
    for a, b, s in found:
        near[a, b] = s
    sets = {i: set(re.findall("[a-z0-9]+", n.lower())) for i, n in rows if n and re.search("[a-z0-9]", n.lower())}
    first = {}
    for i in sets:
        rep[i] = first.setdefault(names[i].lower(), i)
    for i in sets:
        for j in sets:
            if i < j:
                sim = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                a, b = sorted((rep[i], rep[j]))
                assert (1.0 if a == b else near.get((a, b))) == (round(sim, 4) if sim >= 0.5 else None)
    assert all(near[rep[i], i] == 1.0 for i in sets if i != rep[i])
    assert len(found) == len(near) and {x for ab in near for x in ab} <= set(sets)


def test_jaccard_names_has_every_part(spark):
    names = [r[0].lower() for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").collect()]
    got = catalogue.QUERIES["jaccard_names"](spark, SF).collect()
    assert sum(r.similarity == 1.0 for r in got) == len(names) - len(set(names)) > 0


def test_quantity_extract_has_every_line(spark):
    want = {(r.l_orderkey, r.l_linenumber, int(r.l_quantity)) for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect()}
    got = catalogue.QUERIES["quantity_extract"](spark, SF).collect()
    assert {(r.l_orderkey, r.l_linenumber, int(r.quantity)) for r in got} == want and max(r.l_linenumber for r in got) > 2


def test_union_names_has_every_name_once(spark):
    want = {r[0] for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name")) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c).collect()}
    got = [r.name for r in catalogue.QUERIES["union_names"](spark, SF).collect()]
    assert sorted(got) == sorted(want)
