"""Classification as data: rule tables, ordered cases and small decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posthorn.operators.knowledge import domain_of, sender_profile
from posthorn.operators.matching import FREE_DOMAINS

CLASSES = ("client", "spam", "vendor")


#: Rules that a packed table may have; it is configuration, written by hand.
MAX_RULES = 10_000


def rule_hits(docs: DataFrame, rules: DataFrame, text: str = "text", scopes: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with ``hits``, the rules whose pattern fits.

    Rules are counted before they are collected; each document row is tested against an array of
    them, so documents are neither joined nor shuffled. ``scopes`` names texts that a rule's ``scope``
    may ask for; other scopes, and rules without one, look into ``text``.
    """
    names = ["rule_id", "classifier", "match_type", "pattern", "weight"] + ["scope"] * (scopes is not None)
    packed = rules.select(*names).limit(MAX_RULES + 1).collect()
    if len(packed) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    kind = f"array<struct<rule_id:int,classifier:string,match_type:string,pattern:string,weight:int{',scope:string' * (scopes is not None)}>>"
    if not packed:
        return docs.withColumn("hits", F.array().cast(kind))
    table = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in r.asDict().items())) for r in packed)).cast(kind)

    def fits(r: Column) -> Column:
        hay = low(F.col(text))
        for name, c in (scopes or {}).items():
            hay = F.when(r["scope"] == name, low(c)).otherwise(hay)
        by_kind = F.when(r["match_type"] == "exact", hay == r["pattern"]).when(r["match_type"] == "regex", F.regexp_like(hay, r["pattern"]))
        return by_kind.otherwise(F.contains(hay, r["pattern"]))

    return docs.withColumn("hits", F.filter(table, fits))


#: Weight of a known sender, and of a domain that is not a free one.
SENDER_WEIGHT, DOMAIN_WEIGHT = 20, 1


def classify_mails(mails: DataFrame, rules: DataFrame, profiles: DataFrame) -> DataFrame:
    """K1-K3: ``mails`` (id, subject, body, attachments, email) with scores, ``label`` and ``confidence``.

    Rules look into the subject, the body, the attachments' names, the sender's domain or all of it; a sender's
    profile adds SENDER_WEIGHT to its class, and a domain that is not free DOMAIN_WEIGHT to clients.
    """
    host = domain_of(F.col("email"))
    scopes = {"subject": F.col("subject"), "body": F.col("body"), "attachment": F.col("attachments"), "domain": host}
    known = sender_profile(mails.select("id", "email"), profiles).select("id", "classification")
    told = mails.join(known, "id", "left").withColumn("all_text", F.concat_ws("\n", "subject", "body", "attachments", "email"))
    own = F.when((F.coalesce("email", F.lit("")) != "") & ~host.isin(*FREE_DOMAINS), DOMAIN_WEIGHT).otherwise(0)
    hits = rule_hits(told, rules, "all_text", scopes)
    scores = {n: s + F.when(F.col("classification") == n, SENDER_WEIGHT).otherwise(0) + (own if n == "client" else 0) for n, s in class_scores(F.col("hits")).items()}
    found = hits.select("id", *(s.alias(n) for n, s in scores.items()))
    label, confidence = decide({n: F.col(n) for n in CLASSES})
    return found.withColumns({"label": label, "confidence": confidence})


def agreement(label: Column, confidence: Column, ai_label: Column, ai_confidence: Column, threshold: float, other: str, kept: str) -> Column:
    """K5, K7: struct<label, confidence, source> from the rules' answer and a model's.

    The rules decide from ``threshold`` on, or if the model says nothing (``rules``); if both agree, their mean and
    0.15 count, 0.99 at most (``hybrid``); a model that is more than 0.1 surer decides (``other``); else the rules stay (``kept``).
    """
    says = lambda l, c, s: F.struct(l.alias("label"), c.cast("double").alias("confidence"), F.lit(s).alias("source"))
    both = F.least(F.lit(0.99), (confidence + ai_confidence) / 2 + 0.15)
    return (
        F.when((confidence >= threshold) | ai_label.isNull(), says(label, confidence, "rules")).when(label == ai_label, says(label, both, "hybrid"))
        .when(ai_confidence > confidence + 0.1, says(ai_label, ai_confidence, other)).otherwise(says(label, confidence, kept))
    )


def class_scores(hits: Column) -> dict[str, Column]:
    """K1: the sum of weights for each class."""
    return {c: F.aggregate(hits, F.lit(0), _adder(c)) for c in CLASSES}


def _adder(name: str):
    return lambda acc, h: acc + F.when(h["classifier"] == name, h["weight"]).otherwise(0)


def decide(scores: dict[str, Column]) -> tuple[Column, Column]:
    """K2, K3: label and confidence.

    The largest score wins; none or a tie below 4 is unknown; a tie from 4 on goes to the first
    class in order.
    """
    top = F.greatest(*scores.values())
    winners = sum(((s == top).cast("int") for s in scores.values()), F.lit(0))
    first = F.lit("unknown")
    for name in reversed(CLASSES):
        first = F.when(scores[name] == top, name).otherwise(first)
    label = F.when((top <= 0) | ((winners > 1) & (top < 4)), "unknown").otherwise(first)
    total = sum(scores.values(), F.lit(0))
    confidence = F.when(top == 0, 0.35).otherwise(F.least(F.lit(0.99), F.round(0.45 + 0.5 * top / F.greatest(total, F.lit(1)), 2)))
    return label, confidence


def ordered_case(text: Column, families: tuple[tuple[str, str], ...], other: str | None) -> Column:
    """The first family whose pattern occurs in ``text``."""
    out = F.lit(other)
    for name, pattern in reversed(families):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


#: Request types in the order in which they are tried, and what fits each. Fixed values.
REQUEST_PATTERNS: dict[str, tuple[str, ...]] = {
    "quotation": (
        r"(?:^|\W)запрос(?:\s+на)?\s+(?:кп|коммерческ|цен|стоимост|счет|счёт|поставк|оборудован|расчет|расчёт|калькуляц)",
        r"(?:^|\W)запрос(?:\s+от)?\s*(?:№|\d)",
        r"^\W*запрос(?:\s|$)",
        r"(?:^|\W)заявка(?:\s+на|\s+от|\s+№|\s*$|\s+для)",
        r"(?:^|\W)просим\s+(?:выставить|предоставить|рассчитать|просчитать|сообщить|уточнить)",
        r"(?:^|\W)(?:прошу|просьба)\s+(?:выставить|предоставить|рассчитать|просчитать|рассмотреть|сообщить|уточнить|помочь)",
        r"(?:^|\W)расч[её]т(?:\s+стоимост|\s+цен|\s+на)",
        r"(?:^|\W)коммерческ(?:ое|ого)\s+предложен",
        r"(?:^|\W)(?-i:КП)(?:\s|$|[,.:;-])",
        r"(?:^|\W)прайс[-\s]?лист",
        r"(?:^|\W)(?:счёт|счет)\s+на(?:\s|$)",
        r"(?:^|\W)цена(?:\s+на|\s+за)",
        r"(?:^|\W)заполнен(?:а|о)\s+форм",
        r"(?:^|\W)(?:новая\s+)?форма(?:\s+с\s+сайта|\s+обратной\s+связи|\s+на\s+сайте)",
        r"(?:^|\W)вопрос\s+(?:через|с\s+сайт|по)",
        r"(?<![A-Za-z0-9_])price\s+(?:request|quote|inquiry|list)",
        r"(?<![A-Za-z0-9_])request\s+for\s+quot(?:e|ation)",
        r"(?<![A-Za-z0-9_])quotation(?![A-Za-z0-9_])",
        r"(?<![A-Za-z0-9_])(?-i:RFQ)(?![A-Za-z0-9_])",
    ),
    "order": (
        r"(?:^|\W)(?:подтверждаем|подтверждение)\s+заказ",
        r"(?:^|\W)наш\s+заказ(?:\s|$|[,.:;№])",
        r"(?:^|\W)новый\s+заказ(?:\s|$|[,.:;№])",
        r"(?:^|\W)заказ(?:ываем|ать)\s+(?:следующ|товар)",
        r"(?<![A-Za-z0-9_])purchase\s+order(?![A-Za-z0-9_])",
        r"(?:^|\W)счёт\s+на\s+оплату\s*№",
        r"^\W*заказ(?:\s+№|\s+от|\s*$)",
        r"(?<![A-Za-z0-9_])place\s+(?:an\s+)?order",
    ),
    "vendor_offer": (
        r"(?:^|\W)(?:предлагаем|предложение)\s+(?:сотрудничеств|поставк|услуг)",
        r"(?:^|\W)мы\s+являемся\s+(?:производ|поставщ|дистрибьют)",
        r"(?:^|\W)наша\s+компания\s+(?:предлагает|производит|поставляет)",
        r"(?:^|\W)(?:мы|наша\s+компания).{0,40}\s+(?:дистрибьютор|дилер|производитель)",
        r"(?:^|\W)выгодн(?:ое|ые)\s+услови",
    ),
    "complaint": (r"(?:^|\W)(?:претенз|жалоб|рекламац)", r"(?:^|\W)некачествен", r"(?:^|\W)не\s+работает(?:$|\W)", r"(?:^|\W)возврат(?:\s+товар|\s+денег)"),
    "service_request": (r"(?:^|\W)(?:ремонт|сервис|обслуживан|диагностик)", r"(?:^|\W)(?:пусконаладк|монтаж|шеф-?монтаж)", r"(?:^|\W)(?:гарантийн|негарантийн)\s+(?:ремонт|случ)"),
    "info_request": (r"(?:^|\W)подскажите[,\s]+(?:пожалуйста|плз)", r"(?:^|\W)как\s+(?:заказать|купить|оплатить)", r"(?:^|\W)(?:техническ|инструкц|документац|паспорт)", r"(?:^|\W)как(?:ие|ая|ой)\s+(?:срок|условия|гаранти)"),
}
#: Urgency, likewise. Fixed values.
URGENCY_PATTERNS: dict[str, tuple[str, ...]] = {
    "urgent": (
        r"срочн|urgent|asap|немедленн|в кратчайш|до конца дня|сегодня|безотлагательн",
        r"в\s+срочном\s+порядке|как\s+можно\s+(?:скорее|быстрее)|по\s+быстрому",
        r"простой|стоит\s+линия|стоит\s+оборудование|авари[йя]|остановка\s+(?:линии|производства|цеха)",
        r"горит\s+(?:срок|заказ|поставка)|не\s+терпит\s+отлагательств",
    ),
    "planned": (
        r"плановая|план(?:ируем|овый)|ближайш|на следующ",
        r"в\s+течени[ие]\s+(?:месяца|квартала|года)",
        r"на\s+(?:перспективу|будущее|следующий\s+(?:месяц|квартал|год))",
    ),
}
#: Characters of a body that decide its request type.
HEAD = 1500


def _families(patterns: dict[str, tuple[str, ...]]) -> tuple[tuple[str, str], ...]:
    return tuple((name, "(?iu)(?:" + "|".join(p) + ")") for name, p in patterns.items())


def request_type_of(subject: Column, body: Column, label: Column) -> Column:
    """K9: spam first, then a bare subject, then the pattern families; null if nothing fits."""
    clean = F.trim(F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?i)^\s*(?:(?:re|fwd|fw)\s*:\s*)+", ""))
    bare = lambda words: clean.rlike(rf"(?iu)^(?:{words})[\s:№.,!?-]*(?:\d|$)")
    hay = F.concat_ws("\n", clean, F.substring(F.coalesce(body, F.lit("")), 1, HEAD))
    found = ordered_case(hay, _families(REQUEST_PATTERNS), None)
    return F.when(label == "spam", "spam").when(bare("запрос|заявка"), "quotation").when(bare("заказ"), "order").otherwise(found)


def urgency_of(text: Column) -> Column:
    """K10."""
    return ordered_case(F.coalesce(text, F.lit("")), _families(URGENCY_PATTERNS), "normal")


#: Subjects and heads of bodies of automatic mail, senders, and the fields of a form. A word boundary before
#: Cyrillic is none in the source's dialect and is written as a lookbehind here. Fixed values.
AUTO_SUBJECTS = (
    r"^(?:Re:\s*)?(?:Auto(?:matic)?\s*(?:reply|response)|Автоответ|Автоматический ответ)",
    r"^(?:Out of (?:the )?office|Вне офиса|Отсутств|I.m away|I am away)",
    r"(?<![\p{L}\d_])ваш[аеи]?\s+(?:заявк[аеи]|обращени[ея]|запрос|письмо|сообщени[ея])\s+(?:принят|зарегистриров|получен|обработ)",
    r"(?<![\p{L}\d_])(?:заявк[аеи]|обращени[ея]|тикет|ticket|request|case)\s*(?:#|№|номер)?\s*\d+",
    r"(?<![\p{L}\d_])(?:создан[оа]?\s+(?:заявк|обращени|тикет)|(?:ticket|case|request)\s+(?:created|opened|received)(?![\p{L}\d_]))",
    r"^\[?(?:auto|noreply|no-reply|system|notification|уведомление)",
    r"(?<![\p{L}\d_])do\s*not\s*reply(?![\p{L}\d_])|(?<![\p{L}\d_])не\s*отвечайте(?![\p{L}\d_])",
    r"(?<![\p{L}\d_])(?:delivery|read)\s*(?:notification|receipt)(?![\p{L}\d_])",
    r"(?<![\p{L}\d_])уведомлени[ея]\s+о\s+(?:доставке|прочтении|получении)(?![\p{L}\d_])",
    r"(?<![\p{L}\d_])(?:на\s+отпуске|на\s+больничном|не\s+работаю|временно\s+не\s+доступ)",
    r"(?<![\p{L}\d_])(?:vacation|holiday)\s*(?:auto|reply|notice)",
    r"^(?:уведомление|notification|alert)\s*(?:о|от|:)",
    r"^(?:ваш[аеи]?\s+)?(?:заказ|доставка|посылка|отправление)\s+(?:№|#|\d)",
    r"(?<![\p{L}\d_])(?:delivery|shipping)\s+(?:notification|confirmation|update)(?![\p{L}\d_])",
)
AUTO_BODIES = (
    r"(?:ваш[аеи]?\s+)?(?:заявк[аеи]|обращени[ея]|запрос|письмо|сообщени[ея])\s+(?:принят|зарегистриров|получен|обработ|создан)",
    r"(?:присвоен|назначен)\s+(?:номер|id|#|№)\s*[:.]?\s*\d+",
    r"(?:это|данное)\s+(?:автоматическ|сгенерированн)",
    r"(?:this is an?\s+)?auto(?:matic(?:ally)?)?[\s-]*(?:generated|reply|response)",
    r"(?:please\s+)?do\s+not\s+reply\s+(?:to\s+)?this",
    r"не\s+отвечайте\s+на\s+(?:это|данное)\s+(?:письмо|сообщение)",
    r"(?:служба\s+)?(?:техническ(?:ой|ая)\s+)?поддержк[аи]\s+получил[аи]",
    r"(?:noreply|no-reply|mailer-daemon|postmaster|system)@",
    r"(?:ниже\s+)?(?:текст|содержание|копия)\s+(?:вашего|исходного)\s+(?:письма|обращения|заявки|сообщения)",
    r"(?:your\s+)?(?:original\s+)?(?:message|request|inquiry)\s+(?:is\s+)?(?:below|attached|included)",
    r"(?:письмо|сообщение)\s+(?:отправлено|создано|сформировано)\s+автоматически",
    r"это\s+автоматическое\s+(?:уведомление|сообщение|письмо)",
    r"message\s+was\s+(?:auto(?:matically)?[-\s])?generated",
)
AUTO_SENDER = r"^(?:noreply|no-reply|no_reply|mailer-daemon|postmaster|system|notification|support-noreply|helpdesk)@"
AUTO_TICKET, AUTO_FORM = r"(?:номер|ticket|#|№)\s*\d+", r"(?:name|имя|фио|phone|телефон|комментарий|comment)\s*:"
#: Characters of a body that tell automatic mail, and below which one from such a sender needs no ticket number.
AUTO_HEAD, AUTO_SHORT = 600, 200


def auto_reply(subject: Column, body: Column, sender: Column) -> Column:
    """The kind of automatic mail by subject, the head of the body or the sender, or null.

    A sender alone counts for a short text or one with a ticket number, unless it is a filled-in form.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    has = lambda c, *patterns: c.rlike("(?iu)(?:" + "|".join(patterns) + ")")
    head = F.substring(text(body), 1, AUTO_HEAD)
    by_sender = has(text(sender), AUTO_SENDER) & ~has(head, AUTO_FORM) & ((F.length(text(body)) < AUTO_SHORT) | has(head, AUTO_TICKET))
    return F.when(has(text(subject), *AUTO_SUBJECTS), "subject").when(has(head, *AUTO_BODIES), "body").when(by_sender, "sender")


def priority_of(conflict: Column, urgency: Column, positions: Column, value: Column, parsed: Column, articles: Column, brands: Column) -> Column:
    """A severe conflict, urgency, five positions or a high value, then what else is known."""
    return (
        F.when(conflict, "critical").when((urgency == "urgent") | (positions >= 5) | (value > 50_000), "high")
        .when(parsed | (articles > 0) | (brands > 0), "medium").otherwise("low")
    )


def risk_of(conflicts: Column, completeness: Column, confidence: Column, severe: Column, medium: Column) -> Column:
    """Conflicts or severe issues, then thresholds of completeness and confidence."""
    return (
        F.when(conflicts | (completeness < 50) | (confidence < 0.65) | severe, "high")
        .when((completeness < 80) | (confidence < 0.8) | medium, "medium").otherwise("low")
    )


def pipeline_status(label: Column, clarify: Column, review: Column, gate_ok: Column, failed: Column, variant: str = "server") -> Column:
    """The three status functions.

    ``server``: clients are ready if neither review is asked for nor the gate fails. ``runner``:
    clarification comes before the label, after fetch errors. ``stored``: the label comes first.
    """
    spam, client = label == "spam", label == "client"
    if variant == "runner":
        out = F.when(failed, "fetch_error").when(spam, "ignored_spam").when(clarify, "needs_clarification").when(client, "ready_for_crm")
    elif variant == "stored":
        out = F.when(spam, "ignored_spam").when(client, "ready_for_crm").when(clarify, "needs_clarification")
    else:
        out = F.when(spam, "ignored_spam").when(client & (review | ~gate_ok), "review").when(client, "ready_for_crm").when(clarify, "needs_clarification")
    return out.otherwise("review")


#: A company name that is no name. Fixed values.
DIRTY_COMPANY = r"(?iu)(https?://|www\.|@|(?<![\p{L}\d_])(tel|fax|тел|факс)(?![\p{L}\d_])|[<>{}|])"


def quality_gate(request: Column, inn: Column, company: Column, person: Column, phone: Column, products: Column, confidence: Column) -> tuple[Column, Column]:
    """Errors that block, and warnings; null and blank are absent."""
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    asks = F.coalesce(request.isin("quotation", "order"), F.lit(False))
    nobody = ~has(inn) & ~has(company) & ~has(person)
    conditions = {
        "invalid_inn_format": has(inn) & ~inn.rlike("^(\\d{9}|\\d{10}|\\d{12})$"),
        "dirty_company_name": has(company) & company.rlike(DIRTY_COMPANY),
        "no_contact_info": asks & ~has(person) & ~has(company) & ~has(phone),
        "no_product_signal": asks & (products == 0),
        "low_confidence_no_requisites": (confidence > 0) & (confidence < 0.5) & nobody,
    }
    return named(conditions), named({"no_phone_no_inn": ~has(inn) & ~has(phone)})


def named(conditions: dict[str, Column]) -> Column:
    """The names of the conditions that hold."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items())))


#: What a text says that is no request. Fixed values.
NEWSLETTER = r"(?iu)(?:отписат[ьс]|unsubscribe|список\s+рассылки|mailing\s+list|email\s+marketing|view\s+in\s+(?:browser|your\s+browser)|дайджест|digest\s+\w|еженедельн(?:ый|ые)\s+(?:обзор|новости|дайджест)|новости\s+(?:рынка|отрасли|компании|недели)|обзор\s+(?:рынка|недели|событий))"
WEBINAR = r"(?iu)(?:вебинар|webinar|онлайн[- ]?(?:курс|мероприятие|конференция|семинар)|зарегистрируйтесь\s+(?:на|бесплатно)|ближайшие\s+(?:мероприятия|события|вебинары|курсы))"
OUTREACH = r"(?iu)(?:предлага[ею]м\s+(?:вам\s+)?(?:наши|свои)\s+услуги|готовы\s+(?:предложить|сотрудничать|стать\s+вашим)|(?:возможность|предложение)\s+(?:о\s+)?сотрудничества|типография|полиграфи[яю])"


def overrides(label: Column, confidence: Column, text: Column, auto: Column, resume: Column, form: Column, web_form: Column, quoted_form: Column) -> Column:
    """K4: struct<label, confidence> after the overrides, in their order.

    Automatic replies and résumés are spam; forms of a website are clients; without any form,
    newsletters and webinars are spam and offers of services are vendors.
    """
    pair = lambda l, c: F.struct(l.alias("label"), c.alias("confidence"))
    at_least = lambda s, v: F.greatest(s["confidence"], F.lit(v))
    steps = [
        lambda s: F.when(auto, pair(F.lit("spam"), at_least(s, 0.92))),
        lambda s: F.when(resume & (s["label"] != "spam"), pair(F.lit("spam"), at_least(s, 0.95))),
        lambda s: F.when(form & ~resume & (s["label"] == "spam"), pair(F.lit("client"), at_least(s, 0.75))),
        lambda s: F.when(web_form & (s["label"] == "spam"), pair(F.lit("client"), at_least(s, 0.82))),
        lambda s: F.when(quoted_form & (s["label"] != "client"), pair(F.lit("client"), at_least(s, 0.82))),
        lambda s: F.when(~(form | web_form | quoted_form) & (s["label"] != "spam") & (text.rlike(NEWSLETTER) | text.rlike(WEBINAR)), pair(F.lit("spam"), at_least(s, 0.85)))
        .when(~(form | web_form | quoted_form) & (s["label"] == "client") & text.rlike(OUTREACH), pair(F.lit("vendor"), F.least(s["confidence"], F.lit(0.75)))),
    ]
    state = F.array(pair(label, confidence))
    for step in steps:
        state = F.transform(state, _then(step))
    return F.element_at(state, 1)


def _then(step):
    """A step as a function of one struct: its result, or the struct itself where it doesn't apply."""
    return lambda s: F.coalesce(step(s), s)


def relabel(label: Column, confidence: Column, request: Column, evidence: Column) -> Column:
    """K8: struct<label, change> by a language model's request type.

    Unknown labels are raised; ``other`` takes a label away unless articles, brands or a
    confidence of 0.85 stand against it; a vendor's offer turns a client into a vendor.
    """
    out = lambda l, c: F.struct(l.alias("label"), c.alias("change"))
    kept = F.struct(label.alias("label"), F.lit(None).cast("string").alias("change"))
    client_types = request.isin("quotation", "order", "info_request", "complaint")
    return F.coalesce(
        F.when((label == "unknown") & client_types, out(F.lit("client"), F.lit("raised"))).when((label == "unknown") & (request == "vendor_offer"), out(F.lit("vendor"), F.lit("raised")))
        .when((request == "other") & label.isin("client", "vendor") & ~evidence & (confidence < 0.85), out(F.lit("unknown"), F.lit("lowered")))
        .when((request == "other") & label.isin("client", "vendor"), out(label, F.lit("disagreed")))
        .when((request == "vendor_offer") & (label == "client"), out(F.lit("vendor"), F.lit("flipped"))),
        kept,
    )


def moderated(status: Column, verdict: Column, comment: Column) -> Column:
    """Approved messages are ready, those that need rework (which takes a comment) go to review."""
    says = F.coalesce(F.trim(comment) != "", F.lit(False))
    return F.when(verdict == "approved", "ready_for_crm").when((verdict == "needs_rework") & says, "review").otherwise(status)


def brand_context(n: Column) -> Column:
    """K13."""
    return F.when(n < 6, "normal").when(n <= 7, "warning").when(n <= 12, "suspicious").otherwise("catalog")


def worker_class(text: Column) -> tuple[Column, Column]:
    """K6: counts of pattern families, first family that reaches its threshold."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = lambda *ps: sum((low.rlike(p).cast("int") for p in ps), F.lit(0))
    spam = n("unsubscribe", "casino", "winner", "free money") * 0.3
    label = (
        F.when(spam >= 0.6, "spam").when(low.rlike("newsletter|digest"), "newsletter").when(n("complain", "defect", "refund") >= 2, "complaint")
        .when(n("order", "invoice", "delivery") >= 2, "order").when(n("price", "quote", "question") >= 1, "inquiry").otherwise("other")
    )
    return label, F.when(label == "other", 0.3).otherwise(0.7)
