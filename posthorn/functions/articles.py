"""Articles of a mail: candidates by shape, reasons for rejection, scores and strict mode.

A zone is read line by line. A candidate is a number behind a label, what is of an article's shape in the
text behind a label, or a text of such a shape anywhere; any token with a digit or colon counts as a broad
candidate, so that noise is seen. Each one is normalised, tried against the reasons in their order and, if
none applies, scored by its zone, its label and its line. Many candidates with much noise among them raise
the score that is asked for. All of it is one expression on a row: no Python, no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and tables: fixed values.
_LABEL = r"артикул(?:[ау]|ом|е|ы|ов|ам|ами|ах)?|арт(?=[\s.:#№]|$)"
LABELLED_NUMBER = rf"(?iu)(?:^|[\s(\[])(?:{_LABEL})\.?\s*[:#№]?\s*(\d{{3,6}}(?:\.\d{{1,6}})?(?:[ \t]+\d{{3,6}}(?:\.\d{{1,6}})?){{0,2}})"
LABELLED_TEXT = (
    rf"(?iu)(?:^|[\s(\[])(?:part\s*number|manufacturer\s*part\s*number|mpn|p/n|pn|{_LABEL}|каталож(?:ный|ного)\s+номер|код\s+товара|модель|model)\.?\s*[:#№]?\s*"
    r"([A-Za-zА-ЯЁ][A-Za-zА-ЯЁ0-9.\-/]{0,40}(?:[ \t]+[A-Za-z0-9][A-Za-z0-9./\-]{1,15}){0,5})"
)
_OPEN, _CLOSE = r"(?:^|[\s(\[«\"'>,;])", r"(?=[\s.,;)\]»\"'<—]|$)"
SHAPES = (
    rf"(?i){_OPEN}([A-Z][A-Z0-9]{{1,12}}(?:[-/.][A-Z0-9]{{1,12}}){{1,6}}(?:\+[A-Z0-9]{{1,6}})?){_CLOSE}",
    rf"{_OPEN}([A-Z]{{1,3}}\s+\d{{2,10}}(?:[-/]\d{{1,10}})*(?:\s+[A-Z0-9]{{1,10}}){{0,6}}){_CLOSE}",
    rf"{_OPEN}(\d{{2,6}}(?:\.\d{{1,6}}){{1,5}}(?:[-/]\d{{1,6}})?){_CLOSE}",
    r"(?:^|[\s(\[«\"'>,;:])(\d{2,6}(?:[/-]\d{1,6}){1,4}[A-Z0-9]{0,6})" + _CLOSE,
)
MULTIBLOCK = 1  # of SHAPES: the one that may swallow a technical value behind it
BROAD = r"(?:^|[\s(\[«\"'>,;])([A-Za-zА-ЯЁ0-9][A-Za-zА-ЯЁ0-9.:_\-/+]{3,50})(?=[\s,;)\]»\"'<—]|$)"
TECHNICAL_TAILS = (
    r"(?i)\s+\d+(?:[.,]\d+)?\s*(?:bar|бар|Hz|Гц|VAC|VDC|kW|W|kVA|mm|cm|V|A)$",
    r"(?i)\s+(?:IP\s?\d{2,3}|Ex\s?[a-zа-яё]+|RS\s?\d{3,4}|M\s?\d{1,3}(?:x\d+)?|\d{3}[LHT]|\d{1,3}P)$",
)
DESCRIPTOR_TAIL = r"(?iu)\s+(?:(?:Betriebsdaten|Specification|Характеристик|Описание|Параметры)\s*[:-]|Вас\s+сообщить|(?:сообщит|уточнит|подскажит)[ея]|(?:pcs?|шт|units?)(?![A-Za-z0-9_])).*$"
LOOKALIKE = ("АВСЕНКМОРТХУІ", "ABCEHKMOPTXYI")
ZONES = {"subject": 4, "current": 3, "attachment": 2, "signature": 1, "quoted": 1}
_YEAR = r"^(?:19|20)\d{2}$"
#: Reasons that a token alone shows, in the order in which they are tried.
REASONS: tuple[tuple[str, str], ...] = (
    ("html_word_meta", r"(?i)^(?:page:)?WORDSECTION\d+$|^page:WORDSECTION|^XMP\.[A-Z]+[:#]|^FS\d+$|^IROW\d+$|^cid:|^mailto:|^https?://|^www\.|^[A-Z0-9._%+-]+@[A-Z0-9.-]+"),
    ("html_structure_token", r"^(?:row|column|col|block|cell|header|footer|section|group|item|wrapper|container|nav|aside|main|article|hero|banner|card|tile)-\d+$"),
    ("filename", r"(?i)\.(?:jpe?g|png|gif|bmp|tiff?|pdf|docx?|xlsx?|pptx?|rtf|csv|txt|zip|rar|7z|html?|xml)(?:$|\.)"),
    ("datetime", rf"^\d{{1,2}}:\d{{2}}(?::\d{{2}})?$|^\d{{1,2}}[.\-/]\d{{1,2}}[.\-/]\d{{2,4}}$|{_YEAR}|^\d{{1,2}}[.\-/](?:19|20)\d{{2}}$"),
    ("hours_range", r"^(?:[01]?\d|2[0-4])[.:\-][0-5]?\d[.:\-](?:[01]?\d|2[0-4])(?:[.:\-][0-5]?\d)?$"),
    ("size_triple", r"^\d{1,3}(?:[/×xXхХ*]\d{1,3}){1,2}$"),
    ("phone_fragment", r"^\d{3}-\d{3}-\d{2}-\d{2}$|^\d{3}-\d{2}-\d{2}-\d{3}$|^[78]-\d{3}-\d{3}-\d{2}-\d{2}$|^\+?7[\s\-()]*\d{3}[\s\-()]*\d{3}[\s\-]*\d{2}[\s\-]*\d{2}$|^\+?\d{1,3}\s\d{3}\s\d{3}\s\d{2}\s\d{2}$"),
    ("inn_like", r"^\d{10}$|^\d{12}$"),
    ("tech_spec", r"(?i)^(?:IP\s?\d{2,3}|RS\s?\d{3,4}|\d{3}[LHT]|\d+\s?(?:Hz|Гц)|\d+(?:[.,]\d+)?\s?(?:bar|бар)|M\s?\d{1,3}(?:x\d+)?|\d+\s?-\s?\d+|\d+-\d+/\d+|\d+(?:[.,]\d+)?\s*(?:mm|cm|м|kg|g|A|V|VAC|VDC|kW|W|kVA)|(?-i:\d{1,3}P)|Ex\s?[a-z]+)$"),
    ("refrigerant", r"(?i)^R\d{2,3}[A-Z]?$"),
    ("section_numbering", r"^\d{1,2}(?:\.\d{1,3}){2,4}$"),
    ("descriptor_slug", r"(?i:^DESC[:#-])|^[a-z]+(?:-[a-z]+){3,}$|^(?:[a-zа-яё]+-){2,}[a-zа-яё]+$"),
)
STRICT_LABEL = r"(?iu)(?:^|[\s;,])(?:арт(?:икул)?\.?\s*[:#№]|part\s*number\s*[:#]|p/?n\s*[:#]|mpn\s*[:#])\s*\d"
STRONG_LABEL = r"(?iu)(?<![\p{L}\d_])(?:part\s*number|manufacturer\s*part\s*number|mpn|p/n|pn|арт|артикул|каталож(?:ный|ного)\s+номер|код\s+товара)(?![\p{L}\d_])"
LABEL_LINE, ITEM_LINE = r"(?iu)(?<![\p{L}\d_])(?:part\s*number|mpn|p/n|pn|арт|артикул)(?![\p{L}\d_])", r"(?iu)(?<![\p{L}\d_])(?:поз|позиция|наименование|qty|кол-?во|шт)(?![\p{L}\d_])"
FORMAL = r"(?i)^[A-Z][A-Z0-9]*(?:-[A-Z0-9]+){2,}$"
PREFIXED = r"^[A-Za-z]{2,6}\d{2,8}[A-Za-z]{0,6}$"
#: Scores that are asked for, usually and in strict mode; candidates from which on, and the share of noise above which, it is strict.
LEAST, STRICT_LEAST, MANY, NOISE = 3, 5, 12, 0.3

_CANDIDATE = "array<struct<value:string,zone:string,labelled:boolean,broad:boolean,line:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def prepared(text: Column) -> Column:
    """A zone's text with ``WR- 2510`` closed up and look-alike letters of codes made Latin."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<![\p{L}0-9])([A-Za-zА-ЯЁа-яё]{1,4})(?:-[ \t]+|[ \t]+-)([A-Za-z0-9])", "$1-$2")
    code = r"[А-ЯЁA-Z]{1,5}(?:-[A-Za-zА-ЯЁ0-9]+)+"
    gaps, codes = F.split(out, code, -1), F.regexp_extract_all(out, F.lit(code), F.lit(0))
    return F.array_join(F.zip_with(gaps, codes, lambda g, c: F.concat(g, F.coalesce(F.translate(c, *LOOKALIKE), F.lit("")))), "")


def trimmed(value: Column) -> Column:
    """A text without technical values (10 Bar, IP54, Ex e) at its end; up to five of a kind go."""
    return reduce(lambda c, p: F.trim(F.regexp_replace(c, p, "")), TECHNICAL_TAILS * 5, value)


def normal(value: Column, brands: tuple[str, ...] = ()) -> Column:
    """A code without a brand before it, marks around it and look-alike letters in it; white space as single spaces."""
    out = F.trim(value)
    for b in brands:
        quoted = "".join(c if c.isalnum() or c == " " else "\\" + c for c in b)
        out = F.trim(F.regexp_replace(out, rf"(?i)^{quoted}\s*[:.]?\s*", ""))
    out = F.regexp_replace(F.regexp_replace(out, r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", ""), r"\s+", " ")
    return F.when(out.rlike("[A-Z]"), F.translate(out, *LOOKALIKE)).otherwise(out)


def _shaped(text: Column) -> Column:
    """What has an article's shape in ``text``: array<string>."""
    tidy = lambda v: F.regexp_replace(F.trim(v), r"\s+", " ")
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), (lambda v: trimmed(tidy(v))) if i == MULTIBLOCK else tidy) for i, p in enumerate(SHAPES)]
    return F.concat(*found)


def _of_line(line: Column, zone: str, brands: tuple[str, ...]) -> Column:
    say = lambda values, labelled, broad: F.transform(
        values, lambda v: F.struct(v.alias("value"), F.lit(zone).alias("zone"), F.lit(labelled).alias("labelled"), F.lit(broad).alias("broad"), line.alias("line"))
    )
    numbers = F.flatten(F.transform(F.regexp_extract_all(line, F.lit(LABELLED_NUMBER), F.lit(1)), lambda m: F.split(m, r"[ \t]+")))
    texts = F.transform(F.regexp_extract_all(line, F.lit(LABELLED_TEXT), F.lit(1)), lambda m: normal(trimmed(m), brands))
    inner = F.flatten(F.transform(texts, lambda t: _let(_shaped(t), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(t)))))
    broad = F.filter(F.regexp_extract_all(line, F.lit(BROAD), F.lit(1)), lambda t: t.rlike(r"[\d:]"))
    return F.concat(say(numbers, True, False), say(inner, True, False), say(_shaped(line), False, False), say(broad, False, True))


def candidates(text: Column, zone: str, brands: tuple[str, ...] = ()) -> Column:
    """The candidates of a zone, each text once, labelled ones first of equal texts."""
    every = F.flatten(F.transform(F.split(prepared(text), "\n", -1), lambda line: _of_line(line, zone, brands)))
    return F.when(F.coalesce(text, F.lit("")) != "", _let(every, lambda c: _first_of(c))).otherwise(F.array().cast(_CANDIDATE))


def _first_of(c: Column) -> Column:
    """Structs of ``c`` whose value, in any case, is not earlier in it; labelled, shaped and broad ones in this order."""
    ordered = F.concat(F.filter(c, lambda x: x["labelled"]), F.filter(c, lambda x: ~x["labelled"] & ~x["broad"]), F.filter(c, lambda x: x["broad"]))
    return _let(ordered, lambda o: _let(F.transform(o, lambda x: F.upper(x["value"])), lambda k: F.filter(o, lambda x, i: F.array_position(k, F.upper(x["value"])) == i + 1)))


def ocr_noise(v: Column) -> Column:
    """Letters and digits that no code mixes like that."""
    # Letters before digits, as a d stands for a digit afterwards.
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "l"), "[0-9]", "d"), "[A-Z]", "u"), "[^dlu]", "o")
    pairs = lambda k: F.filter(F.transform(F.sequence(F.lit(2), F.length(k)), lambda i: F.substring(k, i - 1, F.lit(2))), lambda p: F.substring(p, 1, 1) != F.substring(p, 2, 1))
    n = F.length(v)

    def judged(p: Column) -> Column:
        cases, types = F.size(F.filter(p, lambda x: x.isin("lu", "ul"))), F.size(p)
        dotted = v.rlike("[./]") & ((cases >= 1) | (types >= 3)) & (n <= 12)
        dashed = v.rlike("-") & (cases >= 2) & (n <= 10) & ~F.exists(F.split(v, "-"), lambda s: F.length(s) > 5)
        solid = ~v.rlike("[-/.]") & ((cases >= 1) | (types >= 3)) & (n <= 10) & ~v.rlike(PREFIXED)
        digits = F.regexp_count(v, F.lit("[0-9]"))
        mixed = n.between(6, 10) & v.rlike("^[A-Z0-9]+$") & ~v.rlike(r"^[A-Z]{2,6}\d{2,8}[A-Z]{0,6}$") & digits.between(1, 2) & ~F.substring(v, F.lit(1), digits).rlike(r"^\d+$") & ~v.rlike(r"^[A-Z]+\d+$")
        return dotted | dashed | solid | mixed

    both = v.rlike("[A-Za-z]") & v.rlike("[0-9]")
    return n.between(4, 20) & ~v.rlike(r"^[A-Z][A-Z0-9]*(?:[-/][A-Z0-9]+)+$") & (v.rlike(r"\.{2,}") | (both & _let(kind, lambda k: judged(pairs(k)))))


def reject_reason(value: Column, line: Column, labelled: Column, sections: Column) -> Column:
    """The first reason that speaks against a normalised candidate, or null."""
    v = F.trim(value)
    strict = F.coalesce(line, F.lit("")).rlike(STRICT_LABEL)
    small = (F.regexp_extract(v, r"^(\d+)", 1).try_cast("int") <= 20) & (F.size(F.split(v, r"\.")) == 3) & (sections >= 1)
    more = {"inn_like": (F.length(v) == 12) | ~strict, "section_numbering": (sections >= 3) | small, "phone_fragment": ~v.rlike(r"[\p{L}]")}
    out = F.when(F.coalesce(v, F.lit("")) == "", "empty")
    for name, pattern in REASONS:
        out = out.when(v.rlike(pattern) & more.get(name, F.lit(True)), name)
    number = v.rlike(r"^\d+$")
    return out.when(ocr_noise(v), "ocr_noise").when(number & ~labelled & ~F.coalesce(line, F.lit("")).rlike(STRONG_LABEL), "pure_numeric_no_context").when(number & v.rlike(_YEAR), "year_like")


def score(value: Column, zone: Column, labelled: Column, broad: Column, line: Column) -> Column:
    """The points of a candidate by its zone, label, line and form."""
    by_zone = reduce(lambda out, z: F.when(zone == z[0], z[1]).otherwise(out), ZONES.items(), F.lit(1))
    points = ((labelled, 3), (line.rlike(LABEL_LINE), 2), (line.rlike(ITEM_LINE), 1), (value.rlike(FORMAL), 1), (zone.isin("signature", "quoted"), -2), (broad, -1))
    return reduce(lambda total, p: total + F.when(p[0], p[1]).otherwise(0), points, by_zone)


def extract(zones: dict[str, Column], brands: tuple[str, ...] = ()) -> Column:
    """Struct of ``articles`` (best zone, then best score first, each once), ``rejected`` (value, zone, reason) and ``strict``."""
    raw = F.concat(*(candidates(zones[z], z, brands) for z in ZONES if z in zones))
    numbered = sum((F.regexp_count(prepared(zones[z]), F.lit(r"(?m)^\s*\d{1,2}(?:\.\d{1,3}){2,4}\s")) for z in ("current", "attachment", "quoted") if z in zones), F.lit(0))

    def told(c: Column) -> Column:
        v = normal(c["value"], brands)
        return _let(v, lambda n: F.struct(
            F.trim(F.regexp_replace(n, DESCRIPTOR_TAIL, "")).alias("value"), c["zone"].alias("zone"), n.alias("normal"),
            F.when(n == "", "empty_after_normalize").otherwise(reject_reason(n, c["line"], c["labelled"], numbered)).alias("reason"), c["labelled"].alias("labelled"), c["broad"].alias("broad"), c["line"].alias("line"),
        ))

    def scored(kept: Column) -> Column:
        keys = F.transform(kept, lambda x: F.upper(x["value"]))
        again = lambda x: F.size(F.filter(keys, lambda k: k == F.upper(x["value"]))) >= 2
        points = lambda x: score(x["value"], x["zone"], x["labelled"], x["broad"], x["line"]) + F.when(again(x), 1).otherwise(0)
        rank = lambda z: reduce(lambda out, y: F.when(z == y[0], -y[1]).otherwise(out), ZONES.items(), F.lit(0))
        return F.array_sort(F.transform(kept, lambda x, i: F.struct(rank(x["zone"]).alias("rank"), (-points(x)).alias("minus"), i.alias("at"), x["value"].alias("value"))))

    def summed(all_: Column) -> Column:
        bad = F.filter(all_, lambda x: x["reason"].isNotNull())
        strict = (F.size(all_) > MANY) & (F.size(bad) > NOISE * F.size(all_))
        least = F.when(strict, STRICT_LEAST).otherwise(LEAST)
        good = F.filter(scored(F.filter(all_, lambda x: x["reason"].isNull())), lambda x: -x["minus"] >= least)
        key = lambda v: F.upper(F.regexp_replace(v, r"[^\p{L}0-9]+", ""))
        once = _let(F.transform(good, lambda x: x["value"]), lambda vs: _let(F.transform(vs, key), lambda ks: F.filter(vs, lambda v, i: F.array_position(ks, key(v)) == i + 1)))
        return F.struct(once.alias("articles"), F.transform(bad, lambda x: F.struct(x["normal"].alias("value"), x["zone"].alias("zone"), x["reason"].alias("reason"))).alias("rejected"), strict.alias("strict"))

    return _let(F.transform(raw, told), summed)
