"""Secret scans with corpus-wide ownership frequency.

Three kinds of spans are certain from a text alone (leftmost, non-overlapping within a kind):
``assign`` (a name such as password or token, ``:`` or ``=`` and a value of 12 or more
characters), ``access`` (``AKIA`` and upper-case letters or digits, 18 or more) and ``hex`` (16
or more of 0-9a-f). A fourth kind, ``bare``, is a token of 20 or more characters that mixes
lower case, upper case and digits and that no certain span overlaps; it is a secret only if the
corpus says so.

The corpus says so by ownership: the SHA-256 of every candidate's value is counted by distinct
repositories and distinct owners. A value that more than ``MAX_OWNERS`` owners hold is a widely
copied example; any other is live-looking, however many repositories of its owners hold it.
Bare candidates that are live-looking are added to the spans; certain spans stay whatever their
verdict, which is reported beside them.

Everything is a DataFrame expression. Positions are code points, end exclusive: the lengths of
the pieces between matches and of the matches are summed up. Only the spans, never the texts,
are shuffled, and counts are partial aggregates on (value, owner) and (value, repository), so a
value in a third of all documents is no hot group.

A null text is an empty one. A null owner or repository counts as one of its own. Repeated rows
are separate rows of one repository. An empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posthorn.functions.arrays import before, let
from posthorn.llm.rows import fingerprint
from posthorn.plans.scratch import materialise

KINDS = ("assign", "access", "hex", "bare")
MAX_OWNERS = 2

# Patterns: fixed values.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_NAME = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
_TOKEN = "[A-Za-z0-9+/_-]"
BARE = rf"(?<!{_TOKEN})(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z]){_TOKEN}{{20,}}"

#: Values of an array that is run through at a time.
PART = 256
#: Code points of the pieces that a text is cut from.
PIECE = 4096
_SPAN = "array<struct<start:int,kind:int,end:int,since:int,hash:string>>"


def _found(text: Column, pattern: str, kind: int, value=lambda m: m, least: int = 1) -> Column:
    """The matches of ``pattern`` whose value has ``least`` characters, as _SPAN.

    ``value`` maps a match to its value, which ends where the match ends; ``since`` is where it
    begins. Java's leftmost matches split the text, so gap lengths and match lengths add up to
    positions.
    """

    def span(hit: Column, end: Column) -> Column:
        return let(
            value(hit),
            lambda v: F.struct(
                (end - F.length(hit)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), (end - F.length(v)).alias("since"),
                F.when(F.length(v) >= least, F.sha2(v, 256)).alias("hash"),
            ),
        )

    def spans(p: Column) -> Column:
        lengths = F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["hit"]))
        ends = F.zip_with(before(lengths, lambda a, x: a + x, PART), lengths, lambda a, x: a + x)
        return F.filter(F.zip_with(p, ends, lambda x, end: span(x["hit"], end)), lambda x: x["hash"].isNotNull())

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)  # one more than matches
    return let(F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), spans)


def _if(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(_SPAN))


def certain_spans(text: Column) -> Column:
    """The spans that a text alone decides, by start and then kind."""
    low = F.lower(text)
    named = F.lit(False)
    for w in ASSIGN_WORDS:
        named = named | F.contains(low, F.lit(w))
    return F.array_sort(
        F.concat(
            _if(named, _found(text, ASSIGN, 0, lambda m: F.regexp_replace(m, ASSIGN_NAME, ""), 12)),
            _if(F.contains(text, F.lit("AKIA")), _found(text, ACCESS, 1)),
            _if(text.rlike(HEX), _found(text, HEX, 2)),
        )
    )


def bare_spans(text: Column, certain: Column) -> Column:
    """Candidates that the corpus decides: mixed tokens that no certain span overlaps."""
    return F.filter(
        _if(text.rlike(BARE), _found(text, BARE, 3)),
        lambda b: ~F.exists(certain, lambda c: (c["start"] < b["end"]) & (b["start"] < c["end"])),
    )


def candidates(docs: DataFrame, keys: dict[str, Column], owner: Column, repository: Column, text: Column) -> DataFrame:
    """``keys``, ``owner``, ``repository``, ``certain``, ``bare`` and a row number, written once; values are hashed."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    found = docs.select(
        *(c.alias(k) for k, c in keys.items()), name(owner).alias("owner"), name(repository).alias("repository"),
        certain_spans(whole).alias("certain"), whole.alias("whole"),
    )
    return materialise(
        found.select(*keys, "owner", "repository", "certain", bare_spans(F.col("whole"), F.col("certain")).alias("bare"),
                     F.monotonically_increasing_id().alias("row")),
        "secret-candidates",
    )


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """``hash``, ``n_owners``, ``n_repositories`` and ``live`` for every candidate value of the corpus."""
    holders = F.array(
        F.struct(F.lit(1).alias("is_owner"), F.col("owner").alias("who")), F.struct(F.lit(0).alias("is_owner"), F.col("repository").alias("who"))
    )
    return (
        found.select(F.explode(F.concat(F.transform("certain", lambda c: c["hash"]), F.transform("bare", lambda c: c["hash"]))).alias("hash"), holders.alias("h"))
        .select("hash", F.explode("h").alias("h")).select("hash", "h.is_owner", "h.who").distinct()
        .groupBy("hash").agg(F.sum("is_owner").alias("n_owners"), F.sum(1 - F.col("is_owner")).alias("n_repositories"))
        .withColumn("live", F.col("n_owners") <= max_owners)
    )


def judged(found: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """``found`` with ``added`` (the live-looking bare spans), ``n_live`` and ``n_example`` (spans by verdict)."""
    each = found.where((F.size("certain") > 0) | (F.size("bare") > 0)).select(
        "row", F.explode(F.concat("certain", "bare")).alias("s"), F.col("s.hash").alias("hash")
    )
    verdict = (
        each.join(ownership(found, max_owners), "hash").groupBy("row")
        .agg(
            F.collect_list(F.when(F.col("live") & (F.col("s.kind") == 3), F.col("s"))).alias("added"),
            F.sum(F.col("live").cast("long")).alias("n_live"),
            F.sum((~F.col("live")).cast("long")).alias("n_example"),
        )
    )
    zero = F.lit(0).cast("long")
    return found.join(verdict, "row", "left").withColumns(
        {"added": F.coalesce("added", F.array().cast(_SPAN)), "n_live": F.coalesce("n_live", zero), "n_example": F.coalesce("n_example", zero)}
    )


def written(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, key: str = "doc_id", owner: str = "source", repository: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of every document: counts of the certain kinds, their digest, and all spans with the verdicts' counts."""
    rows = judged(candidates(docs, {"key": docs[key]}, docs[owner], docs[repository], docs[text]))
    count = lambda k: F.size(F.filter("certain", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        F.col("key").alias(key), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("certain")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("certain", "added"))).alias("spans"), "n_live", "n_example",
    )


def _cut(text: Column, spans: Column, by: str) -> Column:
    """``text`` with the values of ``spans`` replaced; spans that overlap are replaced together.

    Time grows with the text and the number of spans: a stretch is cut from pieces of PIECE code
    points, and the pieces are joined once.
    """

    def stretch(pieces: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        piece = lambda n: F.coalesce(F.get(pieces, n), F.lit(""))
        first, last = F.pmod(a, F.lit(PIECE)) + 1, F.pmod(b, F.lit(PIECE))
        within = F.substring(piece(i), first, b - a)
        across = F.concat(F.substring(piece(i), first, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, j - i - 1), ""), F.substring(piece(j), F.lit(1), last))
        return F.when(b <= a, "").when(i == j, within).otherwise(across)

    def cut(s: Column) -> Column:
        """``s``: spans by start. One that begins before an earlier one ends is no opener."""
        done = before(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x), PART)  # where all earlier spans have ended
        openers = F.filter(F.zip_with(s, done, lambda x, at: F.struct(at.alias("at"), x["since"].alias("since"))), lambda x: x["since"] >= x["at"])
        whole = lambda pieces: F.concat(
            F.array_join(F.transform(openers, lambda x: F.concat(stretch(pieces, x["at"], x["since"]), F.lit(by))), ""),
            stretch(pieces, F.array_max(F.transform(s, lambda x: x["end"])), F.length(text)),
        )
        return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), whole)

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["since"].alias("since"), s["end"].alias("end"))))
    return F.when(F.size(spans) > 0, let(ordered, cut)).otherwise(text)


def redact(
    docs: DataFrame, key: str = "doc_id", owner: str = "source", repository: str = "doc_id", text: str = "text", by: str = "[SECRET]"
) -> DataFrame:
    """``docs`` with the values of all spans replaced by ``by``; every row and column stays.

    Only documents with bare candidates are joined with the corpus's verdict. The others are
    rewritten where they are read, without a shuffle.
    """
    mark = fingerprint(docs)
    found = candidates(docs, {"key": docs[key], "mark": mark}, docs[owner], docs[repository], docs[text])
    added = (
        judged(found).where(F.size("added") > 0)
        .select(F.col("key").alias("__k"), F.col("mark").alias("__m"), "added").dropDuplicates(["__k", "__m"])
    )
    names = [f"c{i}" for i in range(len(docs.columns))]
    k, t = (f"c{docs.columns.index(c)}" for c in (key, text))
    plain = docs.select(*(docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)), mark.alias("__mark"))
    open_ = F.coalesce(F.col(t).rlike(BARE), F.lit(False))
    alone = plain.where(~open_).withColumn("__s", certain_spans(F.coalesce(t, F.lit(""))))
    joined = plain.where(open_).join(added, plain[k].eqNullSafe(added["__k"]) & (plain["__mark"] == added["__m"]), "left")
    joined = joined.withColumn("__s", F.concat(certain_spans(F.coalesce(t, F.lit(""))), F.coalesce("added", F.array().cast(_SPAN))))
    both = alone.select(*names, "__s").unionByName(joined.select(*names, "__s"))
    return both.withColumn(t, _cut(F.col(t), F.col("__s"), by)).select(*names).toDF(*docs.columns)
