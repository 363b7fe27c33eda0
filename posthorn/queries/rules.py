"""Rules on written samples: every customer gets the next sample, and SQL holds what must come out of each.

The expected values are written by hand from the rules' definitions, one sample at least for each pattern or branch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posthorn.functions import articles as A
from posthorn.functions import entities as N
from posthorn.functions import mail_rules as R
from posthorn.functions import quantities as Y
from posthorn.functions import text as T
from posthorn.operators import catalog, threads
from posthorn.operators import classify as C
from posthorn.operators import matching as X
from posthorn.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _literal(v: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if v is None else "'" + v.replace("'", "''") + "'"


def samples(name: str, rule: Callable[..., Column], cases: Sequence[tuple]) -> None:
    """Register ``rule`` over samples: a case is its text inputs and, last, the text that must come out."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        place = (F.col("c_custkey") % len(cases)).cast("int")
        inputs = [F.get(F.array(*(F.lit(c).cast("string") for c in column)), place).alias(f"i{n}") for n, column in enumerate(list(zip(*cases, strict=True))[:-1])]
        rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *inputs)
        return rows.select("id", rule(*(F.col(f"i{n}") for n in range(len(inputs)))).cast("string").alias("result"))

    QUERIES[name] = run
    values = ", ".join(f"({i}, {_literal(c[-1])})" for i, c in enumerate(cases))
    ORACLE[name] = f"SELECT c_custkey AS id, result FROM customer JOIN (VALUES {values}) v(place, result) ON place = c_custkey % {len(cases)}"


samples("text_hygiene", T.hygiene, [("a­b​c﻿", "abc"), ("a b", "a b"), ("≪x≫", "«x»"), ("plain", "plain"), (None, None)])
samples("office_residue", R.clean_office, [
    ("a panose-1:2 11 6 b .MsoNormal {x:y} c", "a b c"), ("font-size:14pt; Some text", " Some text"), ("keep this: text", "keep this: text"), ("a  b", "a b"), (None, None),
])
samples("signature_block", T.signature, [("Hello\nplease quote\n-- \nAnna", "-- \nAnna"), ("-- \na\nb\nc\nd\ne\nf\ng\nh\ni", None), ("no mark", None), ("", None)])
samples("zone_texts", lambda b: F.concat_ws("|", T.zones(F.lit("s"), b)["current"], F.coalesce(T.zones(F.lit("s"), b)["signature"], F.lit("none")), T.zones(F.lit("s"), b)["quoted"]), [
    ("Hello\nplease quote\n-- \nAnna\n> old\nFrom: x", "Hello\nplease quote\n|-- \nAnna|> old\nFrom: x"), ("only new", "only new|none|"), ("> all\n> quoted", "|none|> all\n> quoted"), ("", "|none|"),
])
samples("quotation_cut", lambda b: F.concat_ws("|", T.split_quoted(b)["current"], T.split_quoted(b)["quoted"]), [
    ("new\n> old", "new|> old"), ("new\nFrom: a@b.c\nrest", "new|From: a@b.c\nrest"), ("all new\nhere", "all new\nhere|"), (None, "|"),
])
samples("zone_weights", R.zone_weight, [("subject", "4"), ("quoted", "1"), ("other", "1")])
samples("reply_preamble", R.preamble, [("I am away\n-- \nquoted", "I am away"), ("thanks\nOn Monday X wrote:\nold", "thanks"), ("a\n> b", "a"), ("От: x", ""), ("all of it", "all of it"), (None, "")])
samples("capability_lines", R.without_capabilities, [("hello\nBrands we work with: A, B", "hello"), ("Brands we represent", ""), ("none", "none"), (None, None)])
samples("image_chains", R.without_alt_chains, [("[One logo][Two logo] text [x]", " text [x]"), ("no chain", "no chain")])
samples("forwarded_from", R.forwarded_sender, [("x\n> From: Bob <Bob@A.org>\n", "bob@a.org"), ("От: Анна anna@b.ru", "anna@b.ru"), ("from nobody", None), (None, None)])
_LONG = "> " + "quoted " * 10
samples("forwarded_only", lambda s, b: T.forwarded_only(s, b), [("Fwd: x", _LONG, "true"), ("Fwd: x", "new text that is long enough to stand alone\n" + _LONG, "false"), ("x", _LONG, "false"), ("TR: y", "> short", "false")])
samples("mass_mails", lambda s, cc: R.mass_request(s, F.split(cc, ","), ("own.org",)), [
    ("a@x.org", "b@x.org", "false"), ("a@x.org", "c@y.org", "true"), ("a@x.org", "b@x.org,C@x.org", "true"), ("a@x.org", "me@own.org,A@x.org", "false"), ("a@x.org", None, "false"),
])
samples("brand_arity", lambda b, s, t: R.brand_arity(F.split(b, ","), s, t), [
    ("ABB", "s", "", "mono"), ("ABB,Wago", "ABB and WAGO", "", "multi"), ("ABB,Wago", "s", "ABB 5 шт\nalso wago", "multi"), ("ABB,Wago", "s", "ABB, wago", "mono"), ("ABB,Wago", "s", "есть в наличии ABB 5 шт", "mono"),
])
_KINDS = {"sensors": ("датчик", "sensor"), "pumps": ("насос", "c++ pump")}
samples("product_types", lambda t: F.array_join(R.product_types(t, _KINDS), ","), [("Насос и ДАТЧИК", "sensors,pumps"), ("c++ pump", "pumps"), ("c pump", ""), (None, "")])
samples("pattern_entities", lambda t: F.array_join(F.transform(R.pattern_entities(t), lambda e: F.concat_ws("=", e["kind"], e["value"])), ";"), [
    ("INN: 7701234567, a@b.org", "email=a@b.org;inn=7701234567"), ("КПП 770101001 ОГРН: 1027700132195", "kpp=770101001;ogrn=1027700132195"), ("www.x.example ООО «Ромашка»", "website=www.x.example;company=Ромашка"),
    ("8 (912) 345-67-89", "phone=8 (912) 345-67-89"), ("a@b.org A@b.org a@b.org", "email=a@b.org;email=A@b.org"), (None, ""),
])
samples("hint_fill", R.filled_from, [("", "hint", "hint"), ("own", "hint", "own"), (None, "hint", "hint"), (" ", None, None)])
samples("phone_region", R.region_of_phone, [("+7 (812) 345-67-89", "Saint Petersburg"), ("+7 (495) 123-45-67", "Moscow"), ("+7 (111) 123-45-67", None), ("+4930", None), (None, None)])
samples("issue_order", lambda i: F.array_join(F.transform(R.ordered_issues(F.transform(F.split(i, ","), lambda x: F.struct(F.split(x, ":")[0].alias("severity"), F.split(x, ":")[1].alias("code")))), lambda x: x["code"]), ","), [
    ("low:b,high:z,medium:a,high:c", "c,z,a,b"), ("medium:y,medium:x", "x,y"), ("low:q", "q"),
])
samples("article_contexts", lambda t, n: T.contexts(t, n, 2), [("abc XR-5 def", "XR-5", "c XR-5 d"), ("XR-5", "XR-5", "XR-5"), ("none", "XR-5", None)])
samples("shadow_articles", lambda a: F.array_join(X.shadow_pruned(F.split(a, ",")), ","), [("AB,AB-1,C", "AB-1,C"), ("X,Y", "X,Y"), ("AB-12,B-1,12", "AB-12"), ("A,A", "A,A")])
samples("overlap_gate", X.overlap_gate, [
    ("red pump big x", "big red pump y", "Zed", "about zed", "true"), ("zed x", "y", "Zed", "no", "false"), ("zed x", "y", "Zed", "the ZED", "true"), ("red big", "big red pump", "Zed", "zed", "false"), (None, "y", "Zed", "zed", "false"),
])
samples("web_form", lambda t: F.concat_ws("|", *(F.coalesce(T.form_fields(t, {"name": "name|имя", "phone": "phone|телефон"})[f], F.lit("-")) for f in ("name", "phone"))), [
    ("Name: Anna\nТелефон: 123\n", "Anna|123"), ("имя = Б\nphone:", "Б|-"), ("no form", "-|-"),
])
samples("phone_kinds", lambda p: F.concat_ws("|", F.coalesce(T.normal_phone(p), F.lit("-")), F.coalesce(T.phone_kind(T.normal_phone(p)), F.lit("-"))), [
    ("8 (912) 345-67-89", "+7 (912) 345-67-89|mobile"), ("+7 495 123 45 67", "+7 (495) 123-45-67|landline"), ("+49 30 1234567", "+49301234567|international"), ("12", "-|-"),
])
samples("detected_brands", lambda b: F.array_join(N.brands(F.split(b, ",")), ","), [("Bosch / ABB,bosch,Other,WAGO", "Bosch,ABB,WAGO"), ("abb", "abb")])
samples("clean_product_names", lambda n: F.array_join(N.product_names(F.split(n, ";")), ";"), [("1. Pump white AB-12/3;pump WHITE;12;Valve, 3 шт", "Pump white;Valve"), ("Seal", "Seal")])

# One text for each pattern of a request type: subject, body, class and what must come out.
samples("request_patterns", C.request_type_of, [
    ("", "Добрый день, запрос на поставку", "client", "quotation"), ("", "x запрос №5", "client", "quotation"), ("", "Запрос ", "client", "quotation"), ("", "наша заявка на насосы", "client", "quotation"),
    ("", "просим сообщить", "client", "quotation"), ("", "прошу помочь", "client", "quotation"), ("", "расчёт стоимости", "client", "quotation"), ("", "коммерческого предложения", "client", "quotation"), ("", "жду КП, спасибо", "client", "quotation"),
    ("", "жду кп, спасибо", "client", None), ("", "ваш прайс-лист", "client", "quotation"), ("", "счет на поставку", "client", "quotation"), ("", "цена за штуку", "client", "quotation"), ("", "заполнена форма", "client", "quotation"),
    ("", "форма обратной связи", "client", "quotation"), ("", "вопрос с сайта", "client", "quotation"), ("", "price inquiry", "client", "quotation"), ("", "a request for quote", "client", "quotation"), ("", "RFQ 7", "client", "quotation"),
    ("", "rfq 7", "client", None), ("", "your quotation", "client", "quotation"),
    ("", "подтверждаем заказ", "client", "order"), ("", "наш заказ, срочно", "client", "order"), ("", "новый заказ", "client", "order"), ("", "заказываем следующее", "client", "order"), ("", "purchase order 5", "client", "order"),
    ("", "Счёт на оплату № 5", "client", "quotation"), ("", "заказ от 5 мая", "client", "order"), ("", "place an order", "client", "order"),
    ("", "предлагаем услуги", "client", "vendor_offer"), ("", "мы являемся поставщиком", "client", "vendor_offer"), ("", "наша компания производит", "client", "vendor_offer"), ("", "мы официальный дилер", "client", "vendor_offer"), ("", "выгодные условия", "client", "vendor_offer"),
    ("", "рекламация по отгрузке", "client", "complaint"), ("", "некачественный насос", "client", "complaint"), ("", "насос не работает", "client", "complaint"), ("", "возврат денег", "client", "complaint"),
    ("", "нужен ремонт", "client", "service_request"), ("", "шефмонтаж", "client", "service_request"), ("", "негарантийн случай", "client", "service_request"), ("", "негарантийный случай", "client", None),
    ("", "подскажите, пожалуйста", "client", "info_request"), ("", "как купить", "client", "info_request"), ("", "инструкция", "client", "info_request"), ("", "какие сроки", "client", "info_request"),
    ("Re: Fwd: Запрос", "hello", "client", "quotation"), ("Заявка: 12", "hello", "client", "quotation"), ("Заказ", "hello", "client", "order"), ("Заказ", "запрос на кп", "spam", "spam"), ("hello", "nothing", "client", None),
])
samples("technical_values", Y.technical_reason, [
    ("90 мм", "dimension"), ("2\"", "dimension"), ("DN 50", "dimension"), ("1,5 кг", "weight"), ("2.20 kW", "power"), ("240V", "voltage"), ("10 bar", "pressure"), ("50/60HZ", "frequency"), ("1500 min-1", "rpm"), ("-20 °C", "temperature"),
    ("+7 495 123 45 67", "phone"), ("(495) 1234567", "phone"), ("9226513 - 4", None), ("21.04.2026", "date"), ("2026-04-20", "date"), ("9:00 - 18:00", "hours"), ("5 шт", None), ("2 компл", None), ("", None), (None, None),
])
samples("stated_quantities", lambda line, a: F.concat_ws(" ", F.format_string("%.1f", Y.stated(line, a)["quantity"]), Y.stated(line, a)["unit"], Y.stated(line, a)["how"]), [
    ("2 компл по 5 шт", "", "10.0 шт pack"), ("3 упак по 4", "", "12.0 шт pack"), ("9226513-4 шт", "9226513", "4.0 шт article"), ("11TC080-1шт", "11TC080", "1.0 шт article"), ("в кол-ве 5", "", "5.0 шт label"), ("Количество: 10 компл", "", "10.0 компл label"), ("qty 7", "", "7.0 шт label"),
    ("насос 2,5 шт", "", "2.5 шт unit"), ("клапан 4 пары", "", "4.0 пар unit"), ("кабель 6 бухт", "", "6.0 бух unit"),
])
samples("urgency_patterns", C.urgency_of, [
    ("нужно СРОЧНО", "urgent"), ("как можно скорее", "urgent"), ("остановка линии", "urgent"), ("горит срок", "urgent"), ("плановая закупка", "planned"), ("в течение месяца", "planned"), ("на перспективу", "planned"), ("hello", "normal"), (None, "normal"),
])
_BODY = "An ordinary letter that is long enough not to be short. " * 5
samples("auto_reply_patterns", C.auto_reply, [
    ("Re: Automatic reply: x", _BODY, "a@b.c", "subject"), ("Автоответ: меня нет", _BODY, "a@b.c", "subject"), ("Out of the office", _BODY, "a@b.c", "subject"), ("I'm away until May", _BODY, "a@b.c", "subject"), ("ваше письмо получено", _BODY, "a@b.c", "subject"),
    ("Новая заявка № 55", _BODY, "a@b.c", "subject"), ("[case 12] printer", _BODY, "a@b.c", "subject"), ("Your ticket created", _BODY, "a@b.c", "subject"), ("[noreply] x", _BODY, "a@b.c", "subject"), ("please do not reply", _BODY, "a@b.c", "subject"),
    ("не отвечайте на него", _BODY, "a@b.c", "subject"), ("read receipt for you", _BODY, "a@b.c", "subject"), ("ваше уведомление о прочтении", _BODY, "a@b.c", "subject"), ("Иван на больничном", _BODY, "a@b.c", "subject"), ("vacation notice", _BODY, "a@b.c", "subject"),
    ("Alert: disk", _BODY, "a@b.c", "subject"), ("Ваш заказ №12", _BODY, "a@b.c", "subject"), ("your shipping update", _BODY, "a@b.c", "subject"),
    ("x", "Запрос зарегистрирован. " + _BODY, "a@b.c", "body"), ("x", "Вам присвоен номер: 77 " + _BODY, "a@b.c", "body"), ("x", "Данное сгенерированное. " + _BODY, "a@b.c", "body"), ("x", "This is an automatically generated mail. " + _BODY, "a@b.c", "body"),
    ("x", "Do not reply to this. " + _BODY, "a@b.c", "body"), ("x", "не отвечайте на данное сообщение " + _BODY, "a@b.c", "body"), ("x", "Служба поддержки получила " + _BODY, "a@b.c", "body"), ("x", "from postmaster@x.y " + _BODY, "a@b.c", "body"),
    ("x", "Ниже текст вашего письма " + _BODY, "a@b.c", "body"), ("x", "your original message is below " + _BODY, "a@b.c", "body"), ("x", "письмо сформировано автоматически " + _BODY, "a@b.c", "body"), ("x", "это автоматическое письмо " + _BODY, "a@b.c", "body"),
    ("x", "message was auto-generated " + _BODY, "a@b.c", "body"), ("x", _BODY * 3 + "this is an automatic reply", "a@b.c", None),
    ("x", "short", "no-reply@b.c", "sender"), ("x", "Имя: Анна", "no-reply@b.c", None), ("x", _BODY, "no-reply@b.c", None), ("x", "№ 12 " + _BODY, "helpdesk@b.c", "sender"), ("x", "short", "reply@b.c", None), (None, None, None, None),
])


def query(sql: str):
    """Register a function under its own name."""

    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query("""WITH m AS (SELECT o_orderkey AS k, o_custkey AS c, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) SELECT 'm' || CAST(k AS VARCHAR) AS key, 'm' || CAST(min(CAST(k AS VARCHAR)) OVER (PARTITION BY c) AS VARCHAR) AS thread_id FROM m""")
def header_threads(spark, sf):
    """Each order answers the one before it of its customer, by In-Reply-To or as the last of the references."""
    from pyspark.sql.window import Window

    o = table(spark, sf, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    m = o.select(F.col("o_orderkey").alias("k"), "o_custkey", before.alias("p"))
    mid = lambda c: F.concat(F.lit("<"), c.cast("string"), F.lit("@x>"))
    mails = m.select(
        F.concat(F.lit("m"), F.col("k").cast("string")).alias("key"), mid(F.col("k")).alias("message_id"), F.when(F.col("k") % 2 == 0, mid(F.col("p"))).alias("in_reply_to"),
        F.when(F.col("k") % 2 == 1, mid(F.col("p"))).alias("references"), F.concat(F.lit("subject "), F.col("k").cast("string")).alias("subject"), F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("@x.example")).alias("sender"),
    )
    return threads.resolve(mails).select("key", "thread_id")


@query("""WITH f AS (SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN p_brand ELSE lower(p_brand) END AS b FROM part), g AS (SELECT regexp_replace(lower(b), '[^a-z0-9]+', '', 'g') AS k, b, count(*) AS n FROM f GROUP BY 1, 2)
SELECT k AS brand_key, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY k""")
def brand_representative(spark, sf):
    """Spellings of a brand under one key."""
    b = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.lower("p_brand"))
    r = catalog.representative(table(spark, sf, "part").select(b.alias("brand")))
    return r.select(F.col(r.columns[0]).alias("brand_key"), F.col(r.columns[2]).alias("n"))


@query("""WITH v AS (SELECT l_orderkey AS g, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS pos, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END AS v FROM lineitem JOIN part ON p_partkey = l_partkey),
f AS (SELECT g, lower(v) AS k, arg_min(v, pos) AS shown, min(pos) AS first FROM v GROUP BY 1, 2) SELECT g AS message, array_to_string(list(shown ORDER BY first, shown), '|') AS names FROM f GROUP BY g""")
def first_casing(spark, sf):
    """Names regardless of case, the first casing kept, in order of appearance."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    name = F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    pos = F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    rows = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("message"), name.alias("v"), pos.alias("pos"))
    return X.first_seen(rows, ["message"], F.col("v"), "pos").select("message", F.array_join("values", "|").alias("names"))


@query("""WITH e AS (SELECT o_orderkey AS message, CASE WHEN o_orderkey % 4 = 0 THEN lpad(CAST(o_custkey AS VARCHAR), 10, '7') END AS inn, CASE WHEN o_orderkey % 4 = 1 THEN upper(c_name) END AS company, CASE o_orderkey % 4 WHEN 2 THEN 'C' || CAST(o_custkey AS VARCHAR) || '@mail.example' ELSE 'x@d' || CAST(o_custkey % 700 AS VARCHAR) || '.example' END AS email
 FROM orders JOIN customer ON c_custkey = o_custkey), c AS (SELECT c_custkey AS client, lpad(CAST(c_custkey AS VARCHAR), 10, '7') AS inn, CASE WHEN c_custkey % 10 = 0 THEN 'Same' ELSE c_name END AS name, 'd' || CAST(c_custkey % 800 AS VARCHAR) || '.example' AS domain FROM customer),
n AS (SELECT lower(name) AS k, min(client) AS client, count(*) AS n FROM c GROUP BY 1), d AS (SELECT domain AS k, min(client) AS client FROM c GROUP BY 1 HAVING count(*) = 1),
h AS (SELECT message, client, 0.95 AS confidence, 'inn' AS method FROM e JOIN c ON c.inn = e.inn UNION ALL SELECT message, n.client, CASE WHEN n = 1 THEN 0.8 ELSE 0.5 END, 'name' FROM e JOIN n ON n.k = lower(company)
 UNION ALL SELECT message, client, 0.9, 'contact' FROM e JOIN c ON lower(e.email) = 'c' || CAST(client AS VARCHAR) || '@mail.example' UNION ALL SELECT message, d.client, 0.75, 'domain' FROM e JOIN d ON d.k = split_part(e.email, '@', 2)),
r AS (SELECT *, row_number() OVER (PARTITION BY message ORDER BY confidence DESC, client) AS rn FROM h) SELECT message, client, CAST(confidence AS DOUBLE) AS confidence, method FROM r WHERE rn = 1""")
def worker_crm_match(spark, sf):
    """Tax number, name (one or several), contact, domain."""
    o, c, k, own = table(spark, sf, "orders"), table(spark, sf, "customer"), F.col("o_orderkey"), F.col("o_custkey")
    email = F.when(k % 4 == 2, F.concat(F.lit("C"), own.cast("string"), F.lit("@mail.example"))).otherwise(F.concat(F.lit("x@d"), (own % 700).cast("string"), F.lit(".example")))
    e = o.join(c, o.o_custkey == c.c_custkey).select(k.alias("message"), F.when(k % 4 == 0, F.lpad(own.cast("string"), 10, "7")).alias("inn"), F.when(k % 4 == 1, F.upper("c_name")).alias("company"), email.alias("email"))
    key = F.col("c_custkey")
    clients = c.select(key.alias("client"), F.lpad(key.cast("string"), 10, "7").alias("inn"), F.when(key % 10 == 0, "Same").otherwise(F.col("c_name")).alias("name"), F.concat(F.lit("d"), (key % 800).cast("string"), F.lit(".example")).alias("domain"))
    contacts = c.select(key.alias("client"), F.concat(F.lit("c"), key.cast("string"), F.lit("@mail.example")).alias("email"))
    return X.worker_match(e, clients, contacts).select("message", "client", "confidence", "method")


@query("""WITH x AS (SELECT o_orderkey AS id, ['client', 'spam', 'vendor'][1 + o_orderkey % 3] AS label, o_orderkey % 5 = 0 AS clarify, o_custkey % 2 = 0 AS known, o_orderkey % 7 = 0 AS severe, o_orderkey % 101 AS completeness, (o_orderkey % 100) / 100.0 AS confidence,
 o_orderkey % 4 <> 0 AS requisites, o_orderkey % 11 = 0 AS internal, o_orderkey % 13 = 0 AS mass FROM orders),
y AS (SELECT *, label = 'client' AND NOT (severe OR (label = 'client' AND completeness < 20)) AND NOT requisites AND confidence < 0.5 AS gate, severe OR (label = 'client' AND completeness < 20) AS asked FROM x),
z AS (SELECT *, asked OR gate OR internal AS review FROM y)
SELECT id, label <> 'spam' AS parse_to_fields, clarify AS request_clarification, label = 'client' AND NOT known AND NOT review AS create_client, label = 'client' AND NOT review AS create_request, review AS requires_review,
 CASE WHEN review THEN CASE WHEN internal THEN 'internal_sender' WHEN gate THEN 'quality_gate' WHEN severe THEN 'detection_conflicts' ELSE 'low_completeness' END END AS review_reason, label IN ('spam', 'vendor') AS skip_sync,
 concat_ws('|', CASE WHEN mass THEN 'mass_request' END, CASE WHEN gate THEN 'quality_gate' END, CASE WHEN internal THEN 'internal_sender' END) AS flags, CASE WHEN mass THEN 'low' ELSE 'normal' END AS sync_priority FROM z""")
def intake_flow(spark, sf):
    """What happens to a message, and why it is reviewed."""
    k = F.col("o_orderkey")
    label = F.get(F.array(*map(F.lit, ("client", "spam", "vendor"))), (k % 3).cast("int"))
    f = R.intake_flow(label, k % 5 == 0, F.col("o_custkey") % 2 == 0, k % 7 == 0, k % 101, (k % 100) / 100.0, k % 4 != 0, k % 11 == 0, k % 13 == 0)
    rows = table(spark, sf, "orders").select(k.alias("id"), f.alias("f"))
    return rows.select("id", *(f"f.{c}" for c in ("parse_to_fields", "request_clarification", "create_client", "create_request", "requires_review", "review_reason", "skip_sync")), F.array_join("f.flags", "|").alias("flags"), "f.sync_priority")


samples("article_reasons", lambda v, line, n: A.reject_reason(v, line, F.lit(False), n.cast("int")), [
    ("", "", "0", "empty"), ("WORDSECTION12", "", "0", "html_word_meta"), ("XMP.IID:7", "", "0", "html_word_meta"), ("cid:image1", "", "0", "html_word_meta"), ("row-12", "", "0", "html_structure_token"), ("scan.pdf", "", "0", "filename"),
    ("09:30", "", "0", "datetime"), ("15.04.2024", "", "0", "datetime"), ("2024", "", "0", "datetime"), ("04.2024", "", "0", "datetime"), ("09-18.00", "", "0", "datetime"), ("8.30-17.30", "", "0", "hours_range"), ("80/95/70", "", "0", "datetime"), ("40*55*80", "", "0", "size_triple"), ("40х55", "", "0", "size_triple"),
    ("915-506-04-96", "", "0", "phone_fragment"), ("7701234567", "ИНН 7701234567", "0", "inn_like"), ("7701234567", "Арт.: 7701234567", "0", None), ("770123456789", "Арт.: 770123456789", "0", "inn_like"),
    ("IP54", "", "0", "tech_spec"), ("RS485", "", "0", "tech_spec"), ("316L", "", "0", "tech_spec"), ("50Hz", "", "0", "tech_spec"), ("2.5 bar", "", "0", "tech_spec"), ("M20x2", "", "0", "tech_spec"), ("0-600", "", "0", "tech_spec"), ("4-1/2", "", "0", "tech_spec"), ("5P", "", "0", "tech_spec"), ("Ex e", "", "0", "tech_spec"),
    ("R134A", "", "0", "refrigerant"), ("1.60.3.4", "", "3", "section_numbering"), ("1.60.3", "", "1", "section_numbering"), ("1.2.3", "", "3", "hours_range"), ("1.60.3", "", "0", None), ("88.1.82.9.02", "", "1", None), ("DESC:PUMP-X", "", "0", "descriptor_slug"), ("big-red-steel-pump", "", "0", "descriptor_slug"), ("насос-большой-синий", "", "0", "descriptor_slug"),
    ("9pnr0X", "", "0", "ocr_noise"), ("Rloe5....1Mu", "", "0", "ocr_noise"), ("U8qRi-I", "", "0", "ocr_noise"), ("AY3DZAR", "", "0", "ocr_noise"), ("4a3B2c", "", "0", "ocr_noise"), ("152618", "please send 152618", "0", "pure_numeric_no_context"), ("152618", "артикул 152618", "0", None),
    ("DNC-80-PPV-A", "", "0", None), ("QIT35033", "", "0", None), ("8579/12-506", "", "0", None), ("R 480316021", "", "0", None),
])
samples("articles_of_mails", lambda s, b, g, q: F.concat_ws("|", F.array_join(A.extract({"subject": s, "current": b, "signature": g, "quoted": q}, ("FESTO", "R. STAHL"))["articles"], ","), F.when(A.extract({"subject": s, "current": b, "signature": g, "quoted": q}, ("FESTO", "R. STAHL"))["strict"], "strict").otherwise("usual")), [
    ("", "Артикул: 152618", "", "", "152618|usual"), ("", "нужны артикул 34095 34098", "", "", "34095,34098|usual"), ("", "Part number: DNC-80-PPV-A", "", "", "DNC-80-PPV-A,number|usual"), ("", "FESTO:DNC-80-PPV-A", "", "", "DNC-80-PPV-A|usual"),
    ("Запрос WR- 2510", "", "", "", "WR-2510|usual"), ("", "клапан G392-012-000-002 5 шт", "", "", "G392-012-000-002|usual"), ("", "цена R 480316021 10 BAR", "", "", "R 480316021|usual"), ("", "цена R 480316021 10 Bar", "", "", "R 480316021 10|usual"), ("", "dnc-80-ppv-a и DNC-80-PPV-A", "", "", "dnc-80-ppv-a|usual"),
    ("", "встреча 15.04.2024 в 09:30, IP54", "", "", "|usual"), ("", "ok", "tel AB-1234-X", "", "|usual"), ("", "ok", "", "арт AB-1234-X", "AB-1234-X|usual"), ("AB-1/2", "Модель: PEV-W-KL-LED-GH", "", "", "AB-1/2,PEV-W-KL-LED-GH|usual"),
    ("", " ".join(f"{d}.01.2024" for d in range(10, 22)) + " AB-12-X CD-12-Y XY-77", "", "", "|strict"), ("", "АВ-12/3Х заказ", "", "", "|usual"), ("", "АВ-12-3Х заказ", "", "", "AB-12-3X|usual"), (None, None, None, None, "|usual"),
])
