"""Smaller rules of mail analysis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from posthorn.functions.text import EMAIL

#: Zones by their weight for evidence. Fixed values.
ZONE_PRIORITY = {"subject": 4, "current": 3, "signature": 2, "quoted": 1, "attachment": 1}
#: Where a signature lists the brands that a sender works with. Fixed values.
CAPABILITY = r"(?iu)(?:Бренды[,\s]*(?:по\s+которым|с\s+которыми|по\s+к-рым)\s+мы|(?:мы\s+)?наиболее\s+активно\s+работаем|Brands?\s+we\s+(?:work\s+with|represent))"
ALT_CHAIN = r"(?:\[[^\]\n]{3,200}\][ \t]*){2,}"
#: Phrases of catalogues rather than requests. Fixed values.
CATALOGUE = r"(?iu)(?:также\s+работаем|можем\s+предложить|есть\s+в\s+наличии|поставляем|в\s+том\s+числе|широкий\s+ассортимент|официальный\s+дилер|дистрибьютор|представитель|authorized\s+dealer|distributor)"
AMOUNT = r"(?iu)(?<![A-Za-z0-9_])\d+\s*(?:шт|штук|ед|компл|пар|м|кг|л)(?![A-Za-z0-9_])"
#: Residue of office formats. Fixed values.
OFFICE = (
    r"(?i)(?<![A-Za-z0-9_])panose-\d+:\s*[\d\s]+",
    r"(?i)(?<![A-Za-z0-9_])(?:font|line|letter|word|text|margin|padding|border|background|color|width|height|display|position)\s*-?[a-z-]*\s*:\s*[^\n;]{1,80}[;\n]",
    r"\.[A-Za-z][A-Za-z0-9_-]{1,40}\s*\{[^}]{0,200}\}",
    r"(?im)^\s*\.?[a-z][a-z0-9_-]{1,30}\s*\{?\s*$",
)
#: Patterns of entity kinds with the group that holds the value. Fixed values.
ENTITY_PATTERNS = {
    "email": (EMAIL, 0),
    "phone": (r"(?:\+7|8)[\s(-]*\d{3}[\s)-]*\d{3}[\s-]*\d{2}[\s-]*\d{2}", 0),
    "inn": (r"(?iu)(?:ИНН|INN)[\s:]*(\d{12}|\d{10})(?!\d)", 1),
    "kpp": (r"(?iu)(?:КПП|KPP)[\s:]*(\d{9})(?!\d)", 1),
    "ogrn": (r"(?iu)(?:ОГРН|OGRN)[\s:]*(\d{15}|\d{13})(?!\d)", 1),
    "website": (r"(?i)(?:https?://|www\.)[^\s<>\"{}|\\^`\[\]]+", 0),
    "company": (r"(?:ООО|ОАО|ЗАО|ПАО|АО|ИП)\s*[«\"]([^»\"]+)[»\"]", 1),
}
CONFIDENCE = 0.7
#: Regions by telephone area code. Fixed values.
AREA_REGIONS = {"495": "Moscow", "499": "Moscow", "812": "Saint Petersburg", "343": "Yekaterinburg", "383": "Novosibirsk", "846": "Samara"}
#: Reply-preamble ends. Fixed values.
PREAMBLE_END = r"(?iu)^(>|-{2,}|from:|on .* wrote:|от:)"


def clean_office(c: Column) -> Column:
    """Style residue of office formats goes; runs of white space become one space."""
    out = c
    for p in OFFICE:
        out = F.regexp_replace(out, p, " ")
    return F.regexp_replace(out, r"\s{2,}", " ")


def zone_weight(zone: Column) -> Column:
    """T7."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ZONE_PRIORITY.items() for x in kv)), zone), F.lit(1))


def preamble(body: Column) -> Column:
    """The lines before an automatic reply's quotation."""
    lines = F.split(F.coalesce(body, F.lit("")), "\n", -1)
    ends = F.transform(lines, lambda l, i: F.when(F.regexp_like(F.trim(l), F.lit(PREAMBLE_END)), i))
    return F.trim(F.array_join(F.slice(lines, F.lit(1), F.coalesce(F.array_min(ends), F.size(lines))), "\n"))


def without_capabilities(c: Column) -> Column:
    """The text before the line that lists a sender's brands."""
    at = F.regexp_instr(c, F.lit(CAPABILITY))
    before = F.substring(c, F.lit(1), at - 1)
    line = F.length(before) - F.length(F.substring_index(before, "\n", -1))
    return F.when(at > 0, F.regexp_replace(F.substring(c, F.lit(1), F.greatest(line, F.lit(0))), r"\s+$", "")).otherwise(c)


def without_alt_chains(c: Column) -> Column:
    """Chains of bracketed image texts become a space."""
    return F.regexp_replace(c, ALT_CHAIN, " ")


def forwarded_sender(c: Column) -> Column:
    """The address of the first ``From:`` line of a forwarded mail."""
    return F.nullif(F.lower(F.regexp_extract(c, rf"(?imu)^[> \t]*(?:from|от)\s*:[^\n]*?({EMAIL})", 1)), F.lit(""))


def mass_request(sender: Column, cc: Column, own_domains: tuple[str, ...]) -> Column:
    """Two or more external copies, or one to another domain."""
    domain = lambda a: F.substring_index(a, "@", -1)
    low = F.transform(F.coalesce(cc, F.array().cast("array<string>")), lambda a: F.lower(F.trim(a)))
    outside = F.filter(low, lambda a: ~domain(a).isin(*own_domains) & (a != F.lower(sender)))
    return (F.size(outside) >= 2) | F.exists(outside, lambda a: domain(a) != domain(F.lower(sender)))


def brand_arity(brands: Column, subject: Column, body: Column) -> Column:
    """Mono or multi by strong evidence (subject, or a line with an amount) and weak evidence; null without brands."""
    lines = F.split(F.coalesce(body, F.lit("")), "\n", -1)
    has = lambda text, b: F.contains(F.lower(text), F.lower(b))
    strong = F.filter(
        brands,
        lambda b: has(F.coalesce(subject, F.lit("")), b) | F.exists(lines, lambda l: has(l, b) & F.regexp_like(l, F.lit(AMOUNT)) & ~F.regexp_like(l, F.lit(CATALOGUE))),
    )
    n, s = F.size(brands), F.size(strong)
    return F.when(n == 1, "mono").when((n > 1) & ((s >= 2) | ((s >= 1) & (s < n))), "multi").when(n > 1, "mono")


def product_types(text: Column, categories: dict[str, tuple[str, ...]]) -> Column:
    """The categories with a keyword in the text, in their order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = [F.when(low.rlike("|".join(_quoted(w.lower()) for w in words)), F.lit(name)) for name, words in categories.items()]
    return F.array_compact(F.array(*hit))


def _quoted(word: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in word)


def intake_flow(label: Column, clarify: Column, known_company: Column, severe: Column, completeness: Column, confidence: Column, requisites: Column, internal: Column, mass: Column) -> Column:
    """What happens to a message next, and why it needs a review."""
    client = label == "client"
    asked = severe | (client & (completeness < 20))
    gate = client & ~asked & ~requisites & (confidence < 0.5)
    review = asked | gate | internal
    why = F.when(internal, "internal_sender").when(gate, "quality_gate").when(severe, "detection_conflicts").otherwise("low_completeness")
    flags = F.array_compact(F.array(F.when(mass, F.lit("mass_request")), F.when(gate, F.lit("quality_gate")), F.when(internal, F.lit("internal_sender"))))
    return F.struct(
        (label != "spam").alias("parse_to_fields"), clarify.alias("request_clarification"), (client & ~known_company & ~review).alias("create_client"),
        (client & ~review).alias("create_request"), review.alias("requires_review"), F.when(review, why).alias("review_reason"), (label == "vendor").alias("is_vendor"),
        label.isin("spam", "vendor").alias("skip_sync"), flags.alias("flags"), F.when(mass, "low").otherwise("normal").alias("sync_priority"),
    )


def pattern_entities(c: Column) -> Column:
    """array<struct<kind, value, confidence>> of all patterns, distinct."""
    text = F.coalesce(c, F.lit(""))
    parts = [_kind(F.regexp_extract_all(text, F.lit(p), F.lit(g)), kind) for kind, (p, g) in ENTITY_PATTERNS.items()]
    return F.array_distinct(F.concat(*parts))


def _kind(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(CONFIDENCE).alias("confidence")))


def filled_from(own: Column, hint: Column) -> Column:
    """A directory's hint where a mail has nothing."""
    return F.coalesce(F.nullif(F.trim(own), F.lit("")), hint)


def region_of_phone(normal: Column) -> Column:
    """The region of a number in its normal form by area code."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in AREA_REGIONS.items() for x in kv)), F.regexp_extract(normal, r"^\+7 \((\d{3})\)", 1))


def ordered_issues(issues: Column) -> Column:
    """Issues (struct of severity and code) by severity, then code."""
    rank = lambda i: F.when(i["severity"] == "high", 0).when(i["severity"] == "medium", 1).otherwise(2)
    keyed = F.array_sort(F.transform(issues, lambda i: F.struct(rank(i).alias("r"), i["code"].alias("code"), i["severity"].alias("severity"))))
    return F.transform(keyed, lambda k: F.struct(k["severity"].alias("severity"), k["code"].alias("code")))


def thread_listing(messages: Column) -> Column:
    """The messages of a thread (struct of created_at and key) from the first to the last."""
    return F.array_sort(messages)
