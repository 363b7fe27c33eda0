"""Small fixtures for what the driver's tables can't show."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from posthorn.functions import entities as E
from posthorn.functions import line_items as LI
from posthorn.functions import text as T
from posthorn.operators import brands, catalog, classify, components, threads
from posthorn.plans import query_spec as Q
from posthorn.sources import exports, mail
from posthorn.streaming import jobs


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_zones_and_quotes(spark):
    body = "Hello\nplease quote\n-- \nAnna\n> old\nFrom: x"
    z = values(spark, [body], lambda t: T.zones(F.lit("s"), t))[0]
    assert (z.current, z.signature, z.quoted) == ("Hello\nplease quote\n", "-- \nAnna", "> old\nFrom: x")
    assert values(spark, ["-- \na\nb\nc\nd\ne\nf\ng\nh\ni", None, ""], T.signature) == [None, None, None]
    long = "> " + "quoted " * 10
    assert values(spark, [long, "new text that is long enough to stand alone\n" + long], lambda t: T.forwarded_only(F.lit("Fwd: x"), t)) == [True, False]


def test_text_functions(spark):
    assert values(spark, ["Re: FWD: Тема", "re:re:re: x", "Отв: y"], T.plain_subject) == ["тема", "re: x", "y"]
    assert values(spark, ["Привет мир", "hello", "123", "hello Привет"], T.language) == ["ru", "en", "unknown", "ru"]
    assert values(spark, ["<p>a&nbsp;b</p><script>x</script><div>c&amp;lt;</div>"], T.strip_html) == ["a b\nc&lt;"]
    assert values(spark, ["8 (912) 345-67-89", "+7 495 123 45 67", "+49 30 1234567", "12"], T.normal_phone) == ["+7 (912) 345-67-89", "+7 (495) 123-45-67", "+49301234567", None]
    assert values(spark, ["+7 (912) 345-67-89", "+7 (495) 123-45-67", "+4930"], T.phone_kind) == ["mobile", "landline", "international"]
    assert values(spark, ["ИНН 7701234567 КПП: 770101001, ОГРН 1027700132195"], T.requisites)[0].asDict() == {"inn": "7701234567", "kpp": "770101001", "ogrn": "1027700132195"}
    q = values(spark, ["10 шт, 1 500 м и 2,5 kg; 999999 шт"], T.quantities)[0]
    assert [(x.quantity, x.unit) for x in q] == [(10.0, "pcs"), (1500.0, "m"), (2.5, "kg")]
    a = values(spark, ["need ab-12/3x, ISO-9001, USB-3 and ХМ5000"], T.articles)[0]
    assert [(x.value, x.reason) for x in a] == [("AB-12/3X", None), ("ISO-9001", "standard"), ("USB-3", "protocol"), ("XM5000", None)]
    assert values(spark, ["abc XR-5 def"], lambda t: T.contexts(t, F.lit("XR-5"), 2)) == ["c XR-5 d"]
    f = values(spark, ["Name: Anna\nТелефон: 123\n"], lambda t: T.form_fields(t, {"name": "name|имя", "phone": "phone|телефон", "x": "x"}))[0]
    assert f.asDict() == {"name": "Anna", "phone": "123", "x": None}


def test_entities_pick_by_zone_and_confidence(spark):
    df = spark.createDataFrame([("call 8 912 345 67 89", "tel 8 (495) 123-45-67 / 8 912 345 67 89", "Anna Smith", "ООО «Ромашка», chief engineer sales team")], "body string, signature string, sender string, form string")
    r = df.select(
        E.find_phone({"body": F.col("body"), "signature": F.col("signature")}).alias("phone"),
        E.find_person({"sender": F.col("sender"), "local": F.lit("anna.smith")}).alias("person"),
        E.find_company({"form": F.col("form"), "domain": F.lit("acme.example")}).alias("company"),
        E.find_position({"form": F.col("form")}).alias("position"),
        E.find_email({"header": F.lit("info@a.org"), "body": F.lit("x anna@a.org")}).alias("email"),
    ).first()
    assert (r.phone.value, r.phone.zone, r.phone.alternate) == ("+7 (495) 123-45-67", "signature", "+7 (912) 345-67-89")
    assert (r.person.value, r.person.confidence, r.person.alternate) == ("Anna Smith", 0.75, None)
    assert (r.company.value, r.company.alternate) == ("Ромашка", "Acme")
    assert r.position.value.startswith("chief engineer") and (r.email.value, r.email.confidence) == ("anna@a.org", 0.5)
    names = spark.createDataFrame([(["1. Pump white AB-12/3", "pump WHITE", "12", "Valve, 3 шт; Seal"],)], "n array<string>").select(E.product_names(F.col("n")).alias("n")).first().n
    assert names == ["Pump white", "Valve", "Seal"]
    b = spark.createDataFrame([(["Bosch / ABB", "bosch", "Other", "WAGO"],)], "b array<string>").select(E.brands(F.col("b")).alias("b")).first().b
    assert b == ["Bosch", "ABB", "WAGO"]


def test_line_items(spark):
    body = "Please send\n1. AB-12/3 Pump white - 4 шт\nXR500\tValve\t2\n3) Gasket large blue 10 pcs\nthanks"
    items = values(spark, [body], LI.line_items)[0]
    assert [(i.article, i.quantity, i.unit, i.description) for i in items] == [("AB-12/3", 4.0, "pcs", "Pump white"), ("XR500", 2.0, "pcs", "Valve")]
    free = values(spark, [body], LI.free_text_items)[0]
    assert [(i.article, i.quantity) for i in free] == [("DESC:GASKET-LARGE-BLUE", 10.0)]
    table = spark.createDataFrame([("f", "Артикул\tНаименование\tКол-во\nAB-1\tНасос\t4\n\tempty\t1"), ("g", None)], "path string, text string")
    assert [tuple(r) for r in LI.attachment_items(table).collect()] == [("f", "AB-1", 4.0, "pcs", "Насос")]


def test_brands_and_clusters(spark):
    aliases = spark.createDataFrame([("Bosch", "bosch"), ("Bosch", "bosch rexroth"), ("ABB", "abb"), ("The", "the")] + [(f"B{i}", f"brand{i}") for i in range(12)], "canonical string, alias string")
    docs = spark.createDataFrame(
        [(1, "Need BOSCH Rexroth pump, not boschx; mail abb@abb.com"), (2, "We sell " + ", ".join(f"brand{i}" for i in range(12)) + ". " + "x" * 50 + " please quote ABB"), (3, None), (4, "the")],
        "doc_id long, text string",
    )
    own = spark.createDataFrame([("Nobody",)], "canonical string")
    assert sorted(map(tuple, brands.detect(docs, aliases, own).collect())) == [(1, "Bosch"), (2, "ABB")]
    both = spark.createDataFrame([(1, "bosch and abb")], "doc_id long, text string")
    assert [r.canonical for r in brands.detect(both, aliases, own.select(F.lit("ABB").alias("canonical"))).collect()] == ["ABB"]
    votes = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (1, "a", 1), (2, "c", 1)], "message int, brand string, score int")
    assert [tuple(r) for r in brands.infer(votes).collect()] == [(1, "a", 3)]


def test_threads_by_headers_and_subject(spark):
    rows = [
        ("5", "<a@x>", None, None, "Order", "u@x"), ("3", "<b@x>", "<a@x>", None, "Re: Order", "v@y"), ("9", "<c@x>", None, "<zz@x> <b@x>", "Re: Order", "u@x"),
        ("1", "<d@x>", "<gone@x>", None, "q", "u@x"), ("2", "<e@x>", "<gone@x>", None, "other", "w@z"), ("7", None, None, None, "Fwd: Topic", "a@k"), ("6", None, None, None, "topic", "b@k"), ("8", None, None, None, "topic", "b@m"),
    ]
    df = spark.createDataFrame(rows, "key string, message_id string, in_reply_to string, references string, subject string, sender string")
    got = {r.key: r.thread_id for r in threads.resolve(df).collect()}
    assert got == {"5": "3", "3": "3", "9": "3", "1": "1", "2": "1", "7": "6", "6": "6", "8": "8"}
    r = spark.createDataFrame([("client", "Re: x", "ok thanks", 0), ("client", "Re: x", "urgent please", 0), ("client", "Re: x", "ok", 2), ("vendor", "Re: x", "ok", 0)], "label string, subject string, body string, new_signals int")
    assert [x.suppressed for x in threads.suppressed(r).collect()] == [True, False, False, False]


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100)}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_query_spec_and_cursors():
    assert [Q.tri_state(x) for x in ("Yes", "0", "maybe", None, True)] == [True, False, None, None, True]
    assert Q.choice("High, x,,low", ("high", "low")) == ["high", "low"] and Q.choice("x", ("high",)) is None
    c = Q.encode_cursor("2024-01-01", "m1")
    assert Q.decode_cursor(c) == ("2024-01-01", "m1") and [Q.decode_cursor(x) for x in ("!!", "", None, "e30")] == [None] * 4
    q = Q.from_params({"status": "review", "min_attachments": "x", "bogus": "1", "brand": ""})
    assert q == Q.MessageQuery(status="review")


def test_pages_concatenate_to_the_whole_list(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(f"m{i}", at + dt.timedelta(hours=i // 4) if i % 9 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "message_key string, updated_at timestamp")
    whole = [r.message_key for r in df.orderBy(*Q.newest_first()).collect()]
    by_offset = [r.message_key for p in range(1, 6) for r in Q.offset_page(df, p, 12).collect()]
    assert by_offset == whole
    seen, cursor = [], None
    while page := Q.keyset_page(df, cursor, 12).collect():
        seen += [r.message_key for r in page]
        if page[-1].updated_at is None:
            break
        cursor = Q.encode_cursor(str(page[-1].updated_at), page[-1].message_key)
    assert seen == whole[: len(seen)] and len(seen) >= 44


def test_rules_decide_ties(spark):
    df = spark.createDataFrame([(0, 0, 0), (3, 3, 0), (4, 4, 0), (2, 0, 0), (50, 1, 0), (0, 3, 5)], "client int, spam int, vendor int")
    label, confidence = classify.decide({c: F.col(c) for c in classify.CLASSES})
    assert [tuple(r) for r in df.select(label, confidence).collect()] == [("unknown", 0.35), ("unknown", 0.7), ("client", 0.7), ("client", 0.95), ("client", 0.94), ("vendor", 0.76)]
    none = classify.rule_hits(spark.createDataFrame([("x",)], "text string"), spark.createDataFrame([], "rule_id int, classifier string, match_type string, pattern string, weight int"))
    assert none.first().hits == []


def test_catalogue_helpers(spark):
    lines = spark.createDataFrame([("Endress+Hauser (E+H) / EH",), ("",)], "line string")
    got = {r.alias for r in catalog.brand_aliases(lines).collect()}
    assert {"E+H", "EH", "Endress+Hauser", "endress-hauser-eh"} <= got
    forms = spark.createDataFrame([("BOSCH",), ("Bosch",), ("bosch",)], "brand string")
    assert [tuple(r) for r in catalog.representative(forms).collect()] == [("bosch", "Bosch", 3)]


def test_exports_and_webhooks(spark, tmp_path):
    df = spark.createDataFrame([("k", 'a,"b"', ["x", "y"], 1.5)], "message_key string, company string, articles array<string>, total double").withColumn("subject", F.lit("s"))
    for c in ("inn", "phone", "sender_email"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    assert json.loads(exports.crm_payloads(df, "1c").first().payload) == {"Number": "k", "Counterparty": 'a,"b"', "Comment": "s", "Sum": 1.5, "articles": ["x", "y"]}
    for kind in ("jsonl", "csv", "parquet"):
        exports.write_export(df, f"file://{tmp_path}/{kind}", kind)
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True, quote='"', escape='"').first().company == 'a,"b"'
    with pytest.raises(ValueError):
        exports.write_export(df, "x", "xls")
    assert exports.signature(b"what do ya want for nothing?", b"Jefe") == "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"
    d = spark.createDataFrame([("a", "{}"), ("b", "bad")], "key string, payload string")

    def post(payload, headers):
        if payload == "bad":
            raise OSError("down")
        return 200 if len(headers["X-Signature"]) == 64 else 500

    assert sorted(map(tuple, exports.deliver(d, post, b"k").collect())) == [("a", 200, None), ("b", None, "down")]
    assert [r.b for r in spark.range(7).select(exports.backoff(F.col("id")).alias("b")).collect()] == [0, 60, 300, 900, 3600, 21600, 21600]


def test_mail_sources(spark, tmp_path):
    (tmp_path / "accounts.txt").write_text("site\tbrand\ta@b.c\tpw\thost\tnote\nno at sign\t1\t2\t3\t4\t5\nshort\tx@y\n")
    assert [(r.mailbox, r.host) for r in mail.accounts(spark, f"file://{tmp_path}/accounts.txt").collect()] == [("a@b.c", "host")]
    raw = (
        "From: =?utf-8?B?0JDQvdC90LA=?= <anna@x.org>\nSubject: =?utf-8?Q?Caf=C3=A9?=\nMessage-ID: <1@x>\nContent-Type: multipart/mixed; boundary=B\n\n"
        "--B\nContent-Type: text/html\n\n<p>Hi <b>there</b></p>\n--B\nContent-Type: text/csv\nContent-Disposition: attachment; filename=p.csv\n\na;b\n--B--\n"
    )
    (tmp_path / "m").mkdir()
    (tmp_path / "m/1.eml").write_text(raw)
    m = mail.mails(spark, f"file://{tmp_path}/m").first()
    assert (m.sender, m.subject, m.message_id, m.body.split(), m.error) == ("Анна <anna@x.org>", "Café", "<1@x>", ["Hi", "there"], None)
    assert [(a.filename, a.content_type) for a in m.attachments] == [("p.csv", "text/csv")]
    assert mail.file_text("a.txt", "ä".encode())[2] == "ä" and mail.file_text("a.exe", b"")[0] == "skipped" and mail.file_text("a.docx", b"x")[0] == "error"
    assert mail.file_text("a.txt", "цена".encode("cp1251"))[2] == "цена"
    (tmp_path / "f").mkdir()
    (tmp_path / "f/t.csv").write_text("a;b")
    assert [(r.status, r.text) for r in mail.attachment_texts(spark, f"file://{tmp_path}/f").collect()] == [("processed", "a;b")]


def test_limiter_counts_allowed_requests_only(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, 1, at + dt.timedelta(seconds=s)) for i, s in enumerate((0, 1, 2, 3, 59, 60, 61))]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").write.parquet(f"file://{tmp_path}/e")
    stream = jobs.source(spark, f"file://{tmp_path}/e", "event_id long, user_id long, ts timestamp")
    got = {r.event_id: r.allowed for r in jobs.run_available(jobs.limiter(stream, allowed=3)).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: True}


def test_scheduler_slots():
    now = dt.datetime(2024, 1, 2, 10, 30)
    assert jobs.slot_due(now, 10, 0, None) and jobs.slot_due(now, 10, 0, now - dt.timedelta(days=1))
    assert not jobs.slot_due(now, 10, 0, now - dt.timedelta(minutes=5)) and not jobs.slot_due(now, 11, 0, None)


def test_document_store(spark, tmp_path):
    from posthorn.sources import store

    project = {
        "id": "p1",
        "recentMessages": [
            {"id": "1", "messageKey": "", "createdAt": "2024-01-01T00:00:00Z", "attachments": ["a.pdf"], "auditLog": [{"at": "2024-01-03T00:00:00Z", "action": "status", "to": "review"}],
             "integrationExports": {"b": {"acknowledgedAt": "x"}, "a": {"acknowledgedAt": "y"}}, "detectedBrands": ["A"], "analysis": {"detectedBrands": ["A", "B", ""], "sender": {"companyName": " ", "cityPhone": "1"}}},
            {"id": "2", "messageKey": "k2", "createdAt": "2024-01-02T00:00:00Z", "attachments": ["x"], "attachmentFiles": [{"filename": "f.xls"}], "threadId": "t"},
        ],
    }
    (tmp_path / "p.json").write_text(json.dumps([project]))
    rows = {r.message_key: r for r in store.messages(store.load(spark, f"file://{tmp_path}/p.json"), "b").collect()}
    a, b = rows["1"], rows["k2"]
    assert (a.attachments, a.brands, a.company, a.phone, a.thread_id, a.export.acknowledgedAt, str(a.updated_at)) == (["a.pdf"], ["A", "B"], None, "1", "message:1", "x", "2024-01-03 00:00:00")
    assert (b.attachments, b.brands, b.export, b.thread_id) == (["f.xls"], [], None, "t")
    found = store.messages(store.load(spark, f"file://{tmp_path}/p.json"))
    assert sorted(r.id for r in store.events(found).collect()) == ["message:1:0", "thread:message:1:0"]
    changes = spark.createDataFrame([("1", "2024-01-05", "done"), ("1", "2024-01-04", "x")], "message_key string, at string, to_status string")
    assert {r.message_key: r.status for r in store.current_status(found, changes).collect()} == {"1": "done", "k2": None}
    acks = spark.createDataFrame([("1", "crm", "e1", "2024")], "message_key string, consumer string, external_id string, at string")
    batch = spark.createDataFrame([("1", "crm", "e2", "2023"), ("1", "erp", "e3", "2024")], acks.schema)
    assert sorted(r.external_id for r in store.acknowledge(acks, batch).collect()) == ["e1", "e3"]
    done, open_ = store.with_cache(found.select("message_key"), spark.createDataFrame([("1", 5)], "message_key string, r int"))
    assert [r.r for r in done.collect()] == [5] and [r.message_key for r in open_.collect()] == ["k2"]
    g = spark.createDataFrame([(["A1"], ["a1", "b2"], None, ["X"], "", "Co", "1", "2")], "articles array<string>, llm_articles array<string>, brands array<string>, llm_brands array<string>, company string, llm_company string, phone string, llm_phone string")
    m = store.merge_gaps(g).first()
    assert (m.articles, m.brands, m.company, m.phone) == (["A1", "b2"], ["X"], "Co", "1")


def test_matching_cascades(spark):
    from posthorn.operators import matching as X

    e = spark.createDataFrame([(1, "77", "Acme", "x@acme.org"), (2, None, "ACME", "z@gmail.com"), (3, None, "Big Acme Trading", "a@b.c"), (4, None, None, None)], "message int, inn string, company string, email string")
    c = spark.createDataFrame([(10, "77", "Acme", "acme.org"), (11, None, "Big Acme", "gmail.com"), (12, None, "Other", "b.c"), (13, None, "Other", "x.y")], "client int, inn string, name string, domain string")
    k = spark.createDataFrame([(12, "A@b.c")], "client int, email string")
    got = [(r.message, r.client, r.method, r.confidence) for r in X.client_candidates(e, c, k).orderBy("message", "rank").collect()]
    assert got == [(1, 10, "inn", 0.95), (1, 11, "name", 0.7), (2, 10, "name", 0.85), (2, 11, "name", 0.7), (3, 12, "email", 0.8), (3, 10, "name", 0.7), (3, 11, "name", 0.7)]
    assert sorted((r.message, r.client, r.confidence) for r in X.worker_match(e, c, k).collect()) == [(1, 10, 0.95), (2, 10, 0.8), (3, 12, 0.9)]
    df = spark.createDataFrame([("red pump big x", "big red pump y", "Zed", "about zed"), ("zed x", "y", "Zed", "no"), (None, "y", "Zed", "zed")], "q string, e string, b string, body string")
    assert [r[0] for r in df.select(X.overlap_gate(F.col("q"), F.col("e"), F.col("b"), F.col("body"))).collect()] == [True, False, False]
    rows = spark.createDataFrame([(1, "Ab", 0), (1, "AB", 1), (1, "c", 2), (1, "C", -1)], "g int, v string, pos int")
    assert X.first_seen(rows, ["g"], F.col("v"), "pos").first()["values"] == ["C", "Ab"]
    arr = spark.createDataFrame([(["AB", "AB-1", "C"],)], "a array<string>")
    assert arr.select(X.shadow_pruned(F.col("a"))).first()[0] == ["AB-1", "C"]


def test_saved_presets_come_before_global_ones(spark):
    rows = spark.createDataFrame([("c", None, "mine", '{"status": "review"}', 1), ("c", "p", "mine", '{"status": "done"}', 0), ("d", None, "x", "{}", 3)], "client_id string, project_id string, preset_key string, query_json string, id int")
    saved = Q.saved_presets(rows, "c", "p")
    assert saved == {"mine": {"status": "done"}}
    assert Q.with_preset(Q.MessageQuery(preset="mine", label="spam"), saved) == Q.MessageQuery(preset="mine", label="spam", status="done")
    assert Q.with_preset(Q.MessageQuery(preset="high_priority_open", priority="low")).priority == "low"


def test_outbox_stream_and_chained_stages(spark, tmp_path):
    spark.createDataFrame([("a", "{}"), ("b", "bad"), ("c", "x")], "key string, payload string").write.parquet(f"file://{tmp_path}/d")
    stream = jobs.source(spark, f"file://{tmp_path}/d", "key string, payload string")

    def post(payload, headers):
        if payload == "bad":
            raise OSError("down")
        return 200 if payload == "{}" else 503

    jobs.outbox(spark, stream, post, b"k", f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    got = {r.key: (r.status, r.response_status, r.next_attempt_at is not None) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {"a": ("delivered", 200, False), "b": ("pending", None, True), "c": ("pending", 503, True)}
    chained = jobs.pipeline([("parse", lambda d: d.withColumn("n", F.length("payload"))), ("keep", lambda d: d.where("n > 1"))], stream)
    assert sorted(r.key for r in jobs.run_available(chained).collect()) == ["a", "b"]
