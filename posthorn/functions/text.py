"""Text structure as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities that the plain stripper knows. Fixed values.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: Lines that begin a quoted mail. Fixed values.
QUOTE_MARKERS = r"(?iu)^(>|-{2,} ?(original|forwarded) message|from:|sent:|on .{4,80} wrote:|от:|отправлено:)"
SIGNATURE_MARKERS = r"(?iu)^(-- ?$|best regards|kind regards|regards|sincerely|с уважением)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
GENERIC_NAMES = ("info", "sales", "office", "admin", "support", "order", "zakaz")


def hygiene(c: Column) -> Column:
    """Soft hyphens and zero-width characters go, odd spaces become spaces, doubled angle quotes single."""
    out = F.regexp_replace(c, "[­​‌‍﻿]", "")
    out = F.regexp_replace(out, "[   ]", " ")
    return F.translate(out, "≪≫", "«»")


def strip_html(c: Column) -> Column:
    """Scripts and styles go, block ends become line feeds, other tags spaces, entities are decoded."""
    out = F.regexp_replace(c, r"(?is)<(script|style|head)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|tr|li|h[1-6]|table|ul|ol|nav|footer|article)\s*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    out = reduce(lambda a, e: F.replace(a, F.lit(e[0]), F.lit(e[1])), ENTITIES, out)
    out = F.regexp_replace(out, r"[ \t\r]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")


def html_title(c: Column) -> Column:
    return F.regexp_extract(c, r"(?is)<title>(.*?)</title>", 1)


def lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), "\n", -1)


def first_line(all_lines: Column, pattern: str) -> Column:
    """The number (from 0) of the first line that fits, or the number of lines."""
    hits = F.transform(all_lines, lambda l, i: F.when(F.regexp_like(F.trim(l), F.lit(pattern)), i))
    return F.coalesce(F.array_min(hits), F.size(all_lines))


def split_quoted(c: Column) -> Column:
    """T4: struct<current, quoted>, cut at the first line that begins a quotation."""
    l = lines(c)  # noqa: E741
    at = first_line(l, QUOTE_MARKERS)
    return F.struct(F.array_join(F.slice(l, F.lit(1), at), "\n").alias("current"), F.array_join(F.slice(l, at + 1, F.size(l)), "\n").alias("quoted"))


def signature(c: Column) -> Column:
    """T5: from the last signature marker on, unless it is within the first 30 % of the lines."""
    l = lines(c)  # noqa: E741
    hits = F.transform(l, lambda x, i: F.when(F.regexp_like(F.trim(x), F.lit(SIGNATURE_MARKERS)), i))
    at = F.array_max(hits)
    return F.when(at.isNotNull() & (at >= 0.3 * F.size(l)), F.array_join(F.slice(l, at + 1, F.size(l)), "\n"))


def zones(subject: Column, body: Column) -> Column:
    """Struct of subject, current, signature and quoted text."""
    cut = split_quoted(body)
    sig = signature(cut["current"])
    n = F.length(cut["current"]) - F.coalesce(F.length(sig), F.lit(0))
    return F.struct(subject.alias("subject"), F.substring(cut["current"], F.lit(1), n).alias("current"), sig.alias("signature"), cut["quoted"].alias("quoted"))


def forwarded_only(subject: Column, body: Column) -> Column:
    """Hardly any new text, a long quotation and a forwarding subject."""
    cut = split_quoted(body)
    return (F.length(F.trim(cut["current"])) < 30) & (F.length(cut["quoted"]) > 30) & F.coalesce(subject.rlike("(?i)^(fwd?|tr):"), F.lit(False))


def plain_subject(c: Column) -> Column:
    """Without two levels of reply and forward marks."""
    once = lambda x: F.regexp_replace(x, r"(?iu)^\s*(re|fwd?|aw|отв)\s*:\s*", "")
    return F.lower(F.trim(once(once(c))))


def language(c: Column) -> Column:
    """Cyrillic share above 0.3 is ru, no letters is unknown, else en."""
    cyrillic = F.regexp_count(c, F.lit("[А-Яа-яЁё]"))
    letters = cyrillic + F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.when(F.coalesce(letters, F.lit(0)) == 0, "unknown").when(cyrillic / letters > 0.3, "ru").otherwise("en")


def attachment_category(filename: Column) -> Column:
    """T18."""
    name = F.lower(filename)
    ext = F.regexp_extract(name, r"\.([a-z0-9]+)$", 1)
    return (
        F.when(name.rlike("requisit|реквизит"), "requisites").when(name.rlike("price|прайс"), "price_list").when(ext.isin("xls", "xlsx", "csv", "ods"), "table")
        .when(ext.isin("png", "jpg", "jpeg", "gif", "webp", "svg"), "image").when(ext.isin("doc", "docx", "pdf", "rtf", "txt"), "document")
        .when(ext.isin("zip", "rar", "7z"), "archive").otherwise("other")
    )


def emails(c: Column) -> Column:
    """All addresses, lower-cased, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(EMAIL), F.lit(0)), F.lower))


def local_kind(email: Column) -> Column:
    """Generic, service, numbered or personal."""
    local = F.substring_index(email, "@", 1)
    return (
        F.when(local.isin(*GENERIC_NAMES), "generic").when(local.rlike("^(no-?reply|robot|mailer)"), "service").when(local.rlike("[0-9]"), "numbered").otherwise("personal")
    )


def phones(c: Column) -> Column:
    """Telephone numbers in their written form."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PHONE), F.lit(0)))


def normal_phone(c: Column) -> Column:
    """Russian numbers as +7 (XXX) XXX-XX-XX, others as + and digits; null if the digits are too few or many."""
    d = F.regexp_replace(c, "[^0-9]", "")
    own = F.when(d.rlike("^[78][0-9]{10}$"), F.substring(d, 2, 10)).when(d.rlike("^9[0-9]{9}$"), d)
    russian = F.format_string("+7 (%s) %s-%s-%s", F.substring(own, 1, 3), F.substring(own, 4, 3), F.substring(own, 7, 2), F.substring(own, 9, 2))
    return F.when(own.isNotNull(), russian).when(F.length(d).between(7, 15), F.concat(F.lit("+"), d))


def phone_kind(normal: Column) -> Column:
    """Mobile if the area code begins with 9."""
    return F.when(normal.rlike(r"^\+7 \(9"), "mobile").when(normal.rlike(r"^\+7 \("), "landline").when(normal.isNotNull(), "international")


#: Reasons for which a digit group is no telephone number, in the order in which they are tried. Fixed values.
PHONE_REJECTS = (
    ("date", r"^[0-3][0-9]\.[01][0-9]\.(19|20)?[0-9]{2}$"),
    ("postal", r"^[0-9]{6}$"),
    ("bank", r"^[0-9]{20}$"),
    ("ogrn", r"^([0-9]{13}|[0-9]{15})$"),
    ("inn", r"^[0-9]{12}$"),
    ("kpp", r"^[0-9]{9}$"),
    ("article", r"^[A-Za-z]+-?[0-9]+$"),
)


def phone_reject(c: Column) -> Column:
    """Why a candidate is no telephone number, or null."""
    t = F.trim(c)
    out = F.when(~F.length(F.regexp_replace(t, "[^0-9]", "")).between(7, 15), "length")
    for name, pattern in reversed(PHONE_REJECTS):
        out = F.when(t.rlike(pattern), name).otherwise(out)
    return out


def tax_kind(digits: Column) -> Column:
    """The kind of a tax number by its length."""
    n = F.length(digits)
    return F.when(n == 9, "BY").when(n == 10, "RU_ORG").when(n == 12, "RU_IP")


def requisites(c: Column) -> Column:
    """struct<inn, kpp, ogrn>, each null if absent."""
    pick = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.struct(
        pick(r"(?iu)(?:inn|инн)\D{0,4}([0-9]{12}|[0-9]{10})(?![0-9])").alias("inn"),
        pick(r"(?iu)(?:kpp|кпп)\D{0,4}([0-9]{9})(?![0-9])").alias("kpp"),
        pick(r"(?iu)(?:ogrn|огрн)\D{0,4}([0-9]{15}|[0-9]{13})(?![0-9])").alias("ogrn"),
    )


#: Units and their canonical form. Fixed values.
UNITS = {"шт": "pcs", "штук": "pcs", "pcs": "pcs", "pc": "pcs", "м": "m", "m": "m", "кг": "kg", "kg": "kg", "компл": "set", "set": "set"}


def quantities(c: Column) -> Column:
    """array<struct<quantity, unit>> of numbers with a unit; above 100 000 they are outliers and go."""
    pattern = r"(?iu)(?<![0-9.,])([0-9]{1,3}(?: [0-9]{3})+|[0-9]+(?:[.,][0-9]+)?)\s*(штук|шт|компл|кг|м|pcs|pc|kg|set|m)(?![\p{L}0-9])"
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))
    number = lambda x: F.replace(F.replace(F.regexp_extract(x, pattern, 1), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).cast("double")
    unit = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    each = F.transform(found, lambda x: F.struct(number(x).alias("quantity"), F.element_at(unit, F.lower(F.regexp_extract(x, pattern, 2))).alias("unit")))
    return F.filter(each, lambda q: q["quantity"] <= 100_000)


#: Shapes of article numbers and reasons to reject them, in order. Fixed values.
ARTICLE = r"(?<![\p{L}0-9-])(?=[A-Z0-9./-]*[0-9])[A-Z]{1,5}[A-Z0-9]*(?:[-./][A-Z0-9]+)+(?![\p{L}0-9])|(?<![\p{L}0-9-])[A-Z]{2,5}[0-9]{3,}(?![\p{L}0-9])"
ARTICLE_REJECTS = (
    ("standard", r"^(ISO|GOST|DIN|EN|IEC)[-./]?[0-9]"),
    ("size", r"^[0-9]+X[0-9]+"),
    ("protocol", r"^(UTF|MP|USB|HTTP|TCP)[-./]?[0-9]"),
    ("short", r"^.{1,4}$"),
)


def articles(c: Column) -> Column:
    """array<struct<value, reason>>; accepted ones have no reason. Homoglyphs are folded first."""
    folded = F.translate(F.upper(F.coalesce(c, F.lit(""))), "АВЕКМНОРСТУХ", "ABEKMHOPCTYX")
    reason = lambda a: reduce(lambda out, r: F.when(a.rlike(r[1]), r[0]).otherwise(out), reversed(ARTICLE_REJECTS), F.lit(None).cast("string"))
    found = F.array_distinct(F.regexp_extract_all(folded, F.lit(ARTICLE), F.lit(0)))
    return F.transform(found, lambda a: F.struct(a.alias("value"), reason(a).alias("reason")))


#: Legal forms before or behind a quoted or capitalised name. Fixed values.
COMPANY = r"(?u)(?:ООО|ЗАО|ОАО|ПАО|АО|ИП)\s+[«\"]?([^«»\"\n,;]{2,60})[»\"]?|([A-Z][\w&.-]+(?: [A-Z][\w&.-]+){0,4})\s+(?:GmbH|Ltd|LLC|Inc|AG|S\.A\.)"
POSITION = r"(?iu)((?:chief|senior|lead|head of|главный|ведущий|старший)?\s*(?:manager|engineer|director|buyer|менеджер|инженер|директор|специалист)(?: [\p{L}-]+){0,3})"
PERSON = r"(?u)(?<![\p{L}])([А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+(?: [А-ЯЁ][а-яё]+(?:вич|вна))?|[A-Z][a-z]+ (?:[A-Z]\. )?[A-Z][a-z]+)(?![\p{L}])"


def company(c: Column) -> Column:
    """The first name with a legal form."""
    return F.nullif(F.trim(F.concat(F.regexp_extract(c, COMPANY, 1), F.regexp_extract(c, COMPANY, 2))), F.lit(""))


def position(c: Column) -> Column:
    """E16."""
    return F.nullif(F.trim(F.regexp_extract(c, POSITION, 1)), F.lit(""))


def person(c: Column) -> Column:
    """E14."""
    return F.nullif(F.regexp_extract(c, PERSON, 1), F.lit(""))


def form_fields(c: Column, labels: dict[str, str]) -> Column:
    """Struct of the values behind ``label:`` at a line's beginning."""
    return F.struct(*(F.nullif(F.trim(F.regexp_extract(c, rf"(?imu)^\s*(?:{p})\s*[:=]\s*([^\n]*)$", 1)), F.lit("")).alias(n) for n, p in labels.items()))


def contexts(c: Column, needle: Column, around: int = 100) -> Column:
    """Up to ``around`` characters on both sides of the first occurrence of ``needle``."""
    at = F.instr(c, needle)
    first = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substring(c, first, at - first + F.length(needle) + around))
