from pyspark.sql import functions as F

from posthorn.functions import mail_rules as R


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_text_cleaning(spark):
    assert values(spark, ["a panose-1:2 11 6 b .MsoNormal {x:y} c", "font-size:14pt; Some text"], R.clean_office) == ["a b c", " Some text"]
    assert values(spark, ["hello\nBrands we work with: A, B", "Brands we represent", "none", None], R.without_capabilities) == ["hello", "", "none", None]
    assert values(spark, ["[One logo][Two logo] text [x]"], R.without_alt_chains) == [" text [x]"]
    assert values(spark, ["x\n> From: Bob <Bob@A.org>\n", "no"], R.forwarded_sender) == ["bob@a.org", None]
    assert values(spark, ["I am away\n-- \nquoted", None], R.preamble) == ["I am away", ""]
    assert values(spark, ["subject", "quoted", "other"], R.zone_weight) == [4, 1, 1]


def test_mass_requests(spark):
    df = spark.createDataFrame([("a@x.org", ["b@x.org"]), ("a@x.org", ["c@y.org"]), ("a@x.org", ["b@x.org", "C@x.org"]), ("a@x.org", ["me@own.org", "A@x.org"]), ("a@x.org", None)], "s string, cc array<string>")
    assert [r[0] for r in df.select(R.mass_request(F.col("s"), F.col("cc"), ("own.org",))).collect()] == [False, True, True, False, False]


def test_brand_arity_and_types(spark):
    df = spark.createDataFrame([(["ABB"], "s", ""), (["ABB", "Wago"], "ABB and WAGO", ""), (["ABB", "Wago"], "s", "ABB 5 шт\nalso wago"), (["ABB", "Wago"], "s", "ABB, wago"), ([], "s", "")], "b array<string>, s string, t string")
    assert [r[0] for r in df.select(R.brand_arity(F.col("b"), F.col("s"), F.col("t"))).collect()] == ["mono", "multi", "multi", "mono", None]
    kinds = {"sensors": ("датчик", "sensor"), "pumps": ("насос", "c++ pump")}
    assert values(spark, ["Насос и ДАТЧИК", "c++ pump", None], lambda t: R.product_types(t, kinds)) == [["sensors", "pumps"], ["pumps"], []]


def test_intake_flow(spark):
    rows = [("client", False, False, False, 90, 0.9, True, False, False), ("client", False, False, False, 90, 0.3, False, False, True), ("client", True, True, True, 90, 0.9, True, False, False), ("vendor", False, False, False, 5, 0.9, True, True, False), ("client", False, False, False, 10, 0.9, True, False, False)]
    df = spark.createDataFrame(rows, "label string, clarify boolean, known boolean, severe boolean, completeness int, confidence double, requisites boolean, internal boolean, mass boolean")
    out = [r.f for r in df.select(R.intake_flow(*(F.col(c) for c in df.columns)).alias("f")).collect()]
    assert [f.review_reason for f in out] == [None, "quality_gate", "detection_conflicts", "internal_sender", "low_completeness"]
    assert (out[0].create_client, out[0].create_request, out[1].flags, out[1].sync_priority, out[3].skip_sync) == (True, True, ["mass_request", "quality_gate"], "low", True)


def test_patterns_hints_and_orders(spark):
    e = values(spark, ["INN: 7701234567, a@b.org www.x.example, ООО «Ромашка»", None], R.pattern_entities)
    assert [(x.kind, x.value) for x in e[0]] == [("email", "a@b.org"), ("inn", "7701234567"), ("website", "www.x.example,"), ("company", "Ромашка")] and e[1] == []
    assert values(spark, ["", "own", None], lambda t: R.filled_from(t, F.lit("hint"))) == ["hint", "own", "hint"]
    assert values(spark, ["+7 (812) 345-67-89", "+4930", None], R.region_of_phone) == ["Saint Petersburg", None, None]
    df = spark.createDataFrame([([("low", "b"), ("high", "z"), ("medium", "a"), ("high", "c")],)], "i array<struct<severity:string,code:string>>")
    assert [x.code for x in df.select(R.ordered_issues(F.col("i")).alias("o")).first().o] == ["c", "z", "a", "b"]
