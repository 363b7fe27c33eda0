"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Validated values are replaced by values of the same format. The replacement is a keyed
permutation of all valid values of that format, so equal values get equal pseudonyms in every
document, different ones stay different, and nothing is looked up or joined:

========  ==========================================  ==========================================
kind      what is recognised                          what is permuted
========  ==========================================  ==========================================
email     name@domain                                 keyed digest of name and domain, as an
                                                      address below ``.example``
iban      country, check digits, account; mod 97      digits of the account; check digits anew
card      13-19 digits, single spaces or hyphens      all digits but the last; Luhn digit anew
          between groups; Luhn
ip        four numbers of 0-255                       the 32 bits
phone     ``+``, country code and 7-14 digits with    all digits behind the country code
          separators; or ddd-ddd-dddd                 (all digits without one)
ssn       ddd-dd-dddd; area neither 000 nor 666 nor   the valid numbers
          above 899, group and serial not zero
date      yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy of a     the day among the 73 049 days of 1900-2099
          day in 1900-2099
========  ==========================================  ==========================================

What looks alike but doesn't validate (a number that fails Luhn, 2023-02-30) is left alone. Of
digits in groups the leftmost, then longest run of whole groups that is a card is taken, so a
number before or behind it does no harm; likewise for the groups of an IBAN, of which those that
give its country's length come first. What is left of such groups is searched for the other kinds.
Separators, the number of digits and everything else of the text stay.

A permutation of n digits is a Feistel network of ROUNDS rounds on its two halves with addition
modulo powers of ten; a day is one on 17 x 4297 values and an address one on two 16-bit halves,
so no cycle walking is needed. Round values come from SHA-256 of key, kind, length, round and the
other half. Whole texts are rewritten by DataFrame expressions alone: a text is split at the
matches and joined again with the pseudonyms; texts without a match are not touched.

A null text stays null. Empty tables and texts, repeated rows and other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Tests and the query use this key; production passes its own.
DEMO_KEY = "posthorn demonstration key"
KINDS = ("email", "iban", "card", "ip", "phone", "ssn", "date")

#: Calling codes of two digits; 1 and 7 are codes of one digit, all others have three. Fixed values.
CODES = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()
#: Characters of the IBANs of a country. Fixed values.
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "NO15 BE16 DK18 FI18 FK18 FO18 GL18 NL18 SD18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 MN20 XK20 CH21 HR21 LI21 LV21 BG22 BH22 CR22 DE22 GB22 "
        "GE22 IE22 ME22 RS22 VA22 AE23 GI23 IL23 IQ23 OM23 SO23 TL23 AD24 CZ24 ES24 MD24 PK24 RO24 SA24 SE24 SK24 TN24 VG24 AO25 CV25 GW25 LY25 MZ25 "
        "PT25 ST25 DZ26 IR26 IS26 TR26 BI27 CF27 CG27 CM27 DJ27 FR27 GA27 GR27 IT27 KM27 MC27 MG27 MR27 SM27 TD27 AL28 AZ28 BF28 BJ28 BY28 CI28 CY28 "
        "DO28 GT28 HN28 HU28 LB28 MA28 ML28 NE28 NI28 PL28 SN28 SV28 TG28 BR29 EG29 PS29 QA29 UA29 JO30 KW30 MU30 YE30 MT31 SC31 LC32 RU33 "
    ).split()
}
#: A run of digit groups leaves its last group to an address, a day or a mail address that it begins.
_TAIL = r"(?![0-9])(?!(?<=\x20[0-9]{1,3})[./][0-9]{1,3}[./][0-9])(?!(?<=\x20[0-9]{1,20})[A-Za-z0-9._%+-]{0,64}@[A-Za-z0-9-]{1,63}\.)"
_IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
_CARD = r"[0-9](?:[\x20-]?[0-9]){12,18}"
# Patterns: fixed values, in the order in which they are tried at a position.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": rf"(?<![A-Za-z0-9]){_IBAN}(?![A-Za-z0-9])(?:\x20[0-9\x20-]*[0-9](?![A-Za-z]){_TAIL})?",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9+])\+1[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[\x20.-]?\(?[0-9]{1,4}\)?){2,5}(?![0-9])|(?<![0-9-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9]|-[0-9])",
    "card": rf"(?<![0-9-])(?=[0-9](?:[\x20-]?[0-9]){{12}})[0-9][0-9\x20-]{{11,}}[0-9]{_TAIL}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Kinds that are looked for in what cards and IBANs leave of a match.
OTHERS = ("ip", "date", "ssn", "phone")
_PIECES = "array<struct<kind:string,text:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _round(key: Column, label: Column, r: Column, half: Column, modulus: Column) -> Column:
    """A number below ``modulus`` from SHA-256; 60 bits are taken, so the bias is below 1e-8."""
    digest = F.sha2(F.concat_ws("|", key, label, r.cast("string"), half.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def feistel(left: Column, right: Column, a: Column, b: Column, key: Column, label: Column) -> Column:
    """A permutation of pairs (left < a, right < b) as struct<l, r>."""

    def step(s: Column, r: Column) -> Column:
        even = F.pmod(r, F.lit(2)) == 0
        l2 = F.pmod(s["l"] + _round(key, label, r, s["r"], a), a)
        r2 = F.pmod(s["r"] + _round(key, label, r, s["l"], b), b)
        return F.struct(F.when(even, l2).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(r2).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def permute_digits(digits: Column, key: Column, kind: str) -> Column:
    """A permutation of the strings of as many digits; 2 to 34 of them, fewer stay as they are."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    label = F.concat(F.lit(kind + ":"), n.cast("string"))
    pair = feistel(F.substring(digits, F.lit(1), h).cast("long"), F.substring(digits, h + 1, n - h).cast("long"), power(h), power(n - h), key, label)
    out = _let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), h, F.lit("0")), F.lpad(p["r"].cast("string"), n - h, F.lit("0"))))
    return F.when(n >= 2, out).otherwise(digits)


def fill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in turn."""
    gaps = F.split(shape, "[0-9]", -1)
    each = F.filter(F.split(digits, ""), lambda d: d != "")
    return F.concat_ws("", F.zip_with(gaps, each, lambda g, d: F.concat(F.coalesce(g, F.lit("")), F.coalesce(d, F.lit("")))))


def luhn_sum(digits: Column, last_counts: bool) -> Column:
    """The Luhn sum of ``digits``; with ``last_counts`` the last one is the check digit, else it is missing."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d: d.cast("int"))
    odd = 1 if last_counts else 0

    def weigh(d: Column, i: Column) -> Column:
        return F.when(F.pmod(i, F.lit(2)) == odd, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(each, weigh), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """A number of letters (A is 10) and digits, modulo 97, by Horner's rule."""
    each = F.filter(F.split(text, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(each, F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def _email(m: Column, key: Column) -> Column:
    low = F.lower(m)
    name, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    code = lambda label, v, n: F.substring(F.sha2(F.concat_ws("|", key, F.lit(label), v), 256), 1, n)
    return F.concat(F.lit("u"), code("name", F.concat_ws("@", name, domain), 16), F.lit("@d"), code("domain", domain, 10), F.lit(".example"))


def _iban(m: Column, key: Column) -> Column:
    flat = F.regexp_replace(m, " ", "")
    valid = (F.length(flat).between(15, 34)) & (_mod97(F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))) == 1)
    account = F.substring(flat, F.lit(5), F.length(flat))
    new = fill(account, permute_digits(_digits(account), key, "iban"))
    country = F.substring(flat, 1, 2)
    check = _let(new, lambda x: F.lpad((F.lit(98) - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"))
    gaps = F.split(m, "[A-Z0-9]", -1)  # spaces stay where they are
    each = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    whole = F.concat_ws("", F.zip_with(gaps, each(F.concat(country, check, new)), lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))))
    return F.when(valid & (F.length(_digits(account)) >= 2), whole)


def _card(m: Column, key: Column) -> Column:
    d = _digits(m)
    valid = (F.pmod(luhn_sum(d, True), F.lit(10)) == 0) & ~d.rlike("^0+$")
    new = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    whole = _let(new, lambda x: F.concat(x, F.pmod(-luhn_sum(x, False), F.lit(10)).cast("string")))
    return F.when(valid, fill(m, whole))


def _ip(m: Column, key: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65_536), F.lit(65_536), key, F.lit("ip"))
    part = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), F.pmod(x, F.lit(256)).cast("string"))
    return _let(pair, lambda p: F.concat_ws(".", part(p["l"]), part(p["r"])))


def _phone(m: Column, key: Column) -> Column:
    """The country code is read from the digits, so a number is one value however it is spaced."""
    d = _digits(m)
    code = F.when(F.startswith(m, F.lit("+")), F.regexp_extract(d, rf"^(?:[17]|{'|'.join(CODES)}|[0-9]{{3}})", 0)).otherwise("")
    rest = F.substring(d, F.length(code) + 1, F.length(d))
    new = F.concat(code, permute_digits(rest, key, "phone"))
    return F.when(F.length(d).between(8, 15) & (F.length(rest) >= 6), fill(m, new)).when(F.length(d).between(8, 15), fill(m, permute_digits(d, key, "phone")))


def _date(m: Column, key: Column) -> Column:
    day = (
        F.when(m.rlike("-"), F.try_to_date(m, "yyyy-MM-dd")).when(m.rlike("/"), F.try_to_date(m, "MM/dd/yyyy"))
        .otherwise(F.try_to_date(m, "dd.MM.yyyy"))
    )
    n = F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long")
    pair = feistel(F.floor(n / 4297), F.pmod(n, F.lit(4297)), F.lit(17), F.lit(4297), key, F.lit("date"))
    new = _let(pair, lambda p: F.date_add(F.lit("1900-01-01").cast("date"), (p["l"] * 4297 + p["r"]).cast("int")))
    shown = F.when(m.rlike("-"), F.date_format(new, "yyyy-MM-dd")).when(m.rlike("/"), F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))
    return F.when(day.isNotNull(), shown)


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    # Areas without 666 are numbered 0 to 897, groups 0 to 98.
    left = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1
    pair = feistel(left, serial - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("ssn"))
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    number = lambda x: x + F.when(x >= 665, 2).otherwise(1)
    new = _let(pair, lambda p: F.concat_ws("-", pad(number(F.floor(p["l"] / 99)), 3), pad(F.pmod(p["l"], F.lit(99)) + 1, 2), pad(p["r"] + 1, 4)))
    return F.when(valid, new)


_MAKERS = {"email": _email, "iban": _iban, "card": _card, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date}


def _piece(kind: str | None, text: Column) -> Column:
    return F.struct(F.lit(kind).cast("string").alias("kind"), text.alias("text"))


def replacement(match: Column, key: Column, kinds: tuple[str, ...]) -> Column:
    """struct<kind, text> for a match of one of ``kinds``: its pseudonym, or the match itself with a null kind."""
    out = _piece(None, match)
    for kind in reversed(kinds):
        new = _MAKERS[kind](match, key)
        is_kind = F.regexp_like(match, F.lit(f"^(?:{PATTERNS[kind]})$"))
        out = F.when(is_kind & new.isNotNull(), _piece(kind, new)).otherwise(out)
    return out


def _windows(text: Column, kind: str, group: str, most: int, shape: str, key: Column, first: Callable[[Column], Column] | None = None) -> Column:
    """Pieces of ``text``: runs of at most ``most`` whole groups that are a valid ``kind``, and what is between them.

    The leftmost run comes first, of those that begin together one that is ``first``, else the longest.
    """
    tokens = F.regexp_extract_all(text, F.lit(f"{group}+|(?:(?!{group}).)+"), F.lit(0))  # groups and separators in turn

    def body(t: Column) -> Column:
        last = F.floor((F.size(t) - 1) / 2).cast("int")
        separator = lambda k: F.coalesce(F.get(t, 2 * k + 1), F.lit(""))

        def run(i: Column, j: Column) -> Column:
            w = F.array_join(F.slice(t, 2 * i + 1, 2 * (j - i) + 1), "")
            new = _let(w, lambda x: F.when(F.regexp_like(x, F.lit(f"^{shape}$")), _MAKERS[kind](x, key)))
            return F.struct(j.alias("j"), w.alias("old"), new.alias("new"))

        def step(s: Column, i: Column) -> Column:
            runs = F.filter(F.transform(F.sequence(i, F.least(i + (most - 1), last)), lambda j: run(i, j)), lambda x: x["new"].isNotNull())
            longest = lambda x: F.get(x, F.size(x) - 1)
            best = _let(runs, lambda x: F.coalesce(F.get(F.filter(x, lambda y: first(y["old"])), F.lit(0)), longest(x)) if first else longest(x))

            def take(b: Column) -> Column:
                none = F.struct(s["next"].alias("next"), F.concat(s["rest"], F.get(t, 2 * i), separator(i)).alias("rest"), s["out"].alias("out"))
                out = F.concat(s["out"], F.array(_piece(None, s["rest"]), _piece(kind, b["new"])))
                return F.when(b.isNull(), none).otherwise(F.struct((b["j"] + 1).alias("next"), separator(b["j"]).alias("rest"), out.alias("out")))

            return F.when(i < s["next"], s).otherwise(_let(best, take))

        start = F.struct(F.lit(0).alias("next"), F.lit("").alias("rest"), F.array().cast(_PIECES).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), last), start, step, lambda s: F.concat(s["out"], F.array(_piece(None, s["rest"]))))

    return _let(tokens, body)


def _each(pieces: Column, pattern: str, body: Callable[[Column], Column]) -> Column:
    """``pieces`` with matches of ``pattern`` in those without a kind replaced by the pieces that ``body`` gives."""

    def scan(text: Column) -> Column:
        gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.flatten(F.zip_with(gaps, hits, lambda g, h: F.concat(F.array(_piece(None, g)), F.when(h.isNull(), F.array().cast(_PIECES)).otherwise(body(h)))))

    return F.flatten(F.transform(pieces, lambda p: F.when(p["kind"].isNull() & F.regexp_like(p["text"], F.lit(pattern)), scan(p["text"])).otherwise(F.array(p))))


def replacements(match: Column, key: Column) -> Column:
    """Pieces of a match of ANY, as _PIECES: pseudonyms, and with a null kind what stays."""
    lengths = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))
    of_country = lambda w: F.coalesce(F.length(F.regexp_replace(w, " ", "")) == F.try_element_at(lengths, F.substring(w, 1, 2)), F.lit(False))
    whole = F.array(replacement(match, key, ("email", *OTHERS)))
    ibans = _windows(match, "iban", "[A-Z0-9]", 30, _IBAN, key, of_country)
    out = F.when(F.regexp_like(match, F.lit(f"^(?:{PATTERNS['iban']})$")), ibans).otherwise(whole)
    out = _each(out, PATTERNS["card"], lambda h: _windows(h, "card", "[0-9]", 19, _CARD, key))
    return _each(out, "|".join(f"(?:{PATTERNS[k]})" for k in OTHERS), lambda h: F.array(replacement(h, key, OTHERS)))


def pseudonymise(docs: DataFrame, key: str = DEMO_KEY, text: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``counts`` adds ``n_<kind>`` columns.

    A narrow projection: no shuffle and no state.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    t = F.col(f"c{docs.columns.index(text)}")
    plain = docs.toDF(*names)
    secret = F.lit(key)
    # A text without a digit or an @ holds nothing; one without a match is scanned once, the others are scanned once more to be split.
    hits = F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    found = _let(hits, lambda h: F.when(F.size(h) > 0, F.transform(h, lambda m: replacements(m, secret))))
    marked = plain.withColumn("__f", found)
    gaps = F.split(t, ANY, -1)
    whole = F.array_join(F.zip_with(gaps, F.col("__f"), lambda g, m: F.concat(g, F.coalesce(F.array_join(m["text"], ""), F.lit("")))), "")
    new = F.when(F.col("__f").isNull(), t).otherwise(whole)
    kinds = F.transform(F.flatten("__f"), lambda m: m["kind"])
    tally = [F.coalesce(F.size(F.array_compact(kinds)) - F.size(F.array_remove(F.array_compact(kinds), k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    shown = [new.alias(n) if i == docs.columns.index(text) else F.col(n) for i, n in enumerate(names)]
    out = marked.select(*shown, *(tally if counts else []))
    return out.toDF(*docs.columns, *([f"n_{k}" for k in KINDS] if counts else []))
