"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one long in
which bit *i* says that rule *i* failed, so a policy is a mask: comparing policy versions or
asking what a single rule costs reads the ledger and never the texts again. Filtering writes the
ledger beside the rows and keeps those whose bits are clear under the policy's mask; the written
ledger serves other policies and ablations.

Words are maximal runs without the bytes 0x20 and 0x09-0x0D. A null text measures as an empty
one; empty texts have no words and fail ``few_words``. Repeated rows are separate rows. An
empty table gives an empty ledger. Other columns of the input are ignored, whatever they are
called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posthorn.llm.arrow import slices, utf8
from posthorn.llm.rows import numbered
from posthorn.plans.scratch import materialise

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters",
)
_WHITE = [0x20, *range(0x09, 0x0E)]
_SYMBOLS = list(b"#*$%&|<>")


def _repeated(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    code = dict(zip(words, range(n), strict=True))  # any injective code will do
    c = np.array(list(map(code.__getitem__, words)), np.int64)
    if n < 2_000_000:
        key = (c[:-2] * n + c[1:-1]) * n + c[2:]
    else:  # three codes no longer fit in 63 bits
        pair = np.unique(c[:-1] * n + c[1:], return_inverse=True)[1]
        key = pair[:-1] * n + c[2:]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not twice.size:
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def measure_text(text: bytes) -> tuple[int, ...]:
    """The values of MEASURES for one UTF-8 text."""
    words = text.split()
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = int(seen[:0x80].sum() + seen[0xC0:].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = int(seen[0x41:0x5B].sum())
    return (
        len(words),
        points - int(seen[_WHITE].sum()),
        int(seen[_SYMBOLS].sum()),
        len(lines),
        len(lines) - len(set(lines)),
        _repeated(words),
        upper,
        upper + int(seen[0x61:0x7B].sum()),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [measure_text(x) for x in utf8(batch.column(batch.num_columns - 1))]
        columns = zip(*rows, strict=True) if rows else [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in columns)],
            [*batch.schema.names[:-1], *MEASURES],
        )


@dataclass(frozen=True)
class Rule:
    """A named condition on the measurements; true means that the document fails."""

    name: str
    fails: str


#: Bit i of the ledger belongs to rule i. Rules are only ever appended.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("long_words", "word_chars > 40 * n_words"),
    Rule("shouting", "n_letters >= 100 AND 100 * n_upper > 60 * n_letters"),
)

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "long_words"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "long_words", "shouting"),
}
CURRENT = "v2"


def policy_mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy's rules."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    place = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << place[x] for x in names)


def fail_bits() -> Column:
    """The bits of all rules that fail, from the measurements."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total


def ledger(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, the measurements and ``fail_bits``, one row for each row of ``docs``.

    One narrow pass: no shuffle, and only the keys and the text are read.
    """
    picked = docs.select(*(docs[k].alias(f"k{i}") for i, k in enumerate(keys)), docs[text].cast("string").alias("text"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]] + [f"{m} long" for m in MEASURES])
    measured = picked.mapInArrow(_measure, schema)
    return measured.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), *MEASURES, fail_bits().alias("fail_bits"))


def passes(policy: str | tuple[str, ...], bits: Column | str = "fail_bits") -> Column:
    """True for ledger rows that ``policy`` keeps."""
    col = F.col(bits) if isinstance(bits, str) else bits
    return col.bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def ablations(ledger: DataFrame, policy: str | tuple[str, ...] = CURRENT) -> DataFrame:
    """For each rule of ``policy``: documents that fail it, and those that only it rejects.

    The ledger is first counted by its bits, of which there are at most 2 ** len(RULES) values,
    so all that is shuffled is a row for each task and value.
    """
    mask = policy_mask(policy)
    counted = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(r.name, 1 << i) for i, r in enumerate(RULES) if mask >> i & 1]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rules)))
    return (
        counted.select("bits", "n", each.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def ledgered(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with columns c0, c1, ..., their measurements and ``fail_bits``, written once.

    Rows and ledger are one table: no join is needed to filter, and a reader of bits or
    measurements reads these columns only. The texts pass through one ``mapInArrow`` and are never shuffled.
    """
    plain, names = numbered(docs)
    at = docs.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [measure_text(x) for x in utf8(batch.column(at))]
            columns = zip(*rows, strict=True) if rows else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], [*batch.schema.names, *MEASURES]
            )

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields] + [f"{m} long" for m in MEASURES])
    return materialise(plain.mapInArrow(add, schema).select(*names, *MEASURES, fail_bits().alias("fail_bits")), "quality-ledger")


def filter_documents(docs: DataFrame, policy: str | tuple[str, ...] = CURRENT, text: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that ``policy`` keeps, with the columns of ``docs``; ``ledger`` is what ``ledgered`` wrote of them."""
    rows = ledgered(docs, text) if ledger is None else ledger
    return rows.where(passes(policy)).select(*rows.columns[: len(docs.columns)]).toDF(*docs.columns)
