"""SentencePiece BPE with byte fallback: encoding by a prefix table, and decoding.

Merging from the bottom up is replaced by a table over prefixes. The tokens of a prefix end
with one token that is the same whatever follows, so it is enough to store that last token for
each prefix. Among the pieces that end at a position (all of them come from one pass of an
Aho-Corasick automaton) it is the one whose own merging gives that piece and which is
compatible with the last token before it: merging the two pieces side by side leaves them
apart. Ids are then recovered from the end backwards.

No piece of such a model holds the space mark behind another character, a line feed or any
other character without a piece, so no merge crosses these places. A text is cut there, and a
worker keeps the ids of the chunks it has met in tables of bounded size: two kinds of chunks, each
with a new and an old table of at most CHUNKS chunks, and at most PAIRS verdicts on pairs of pieces.

A null text is an empty one; its ids are the end id alone and it decodes to the empty text.
Repeated rows are separate rows, an empty table gives an empty one and other columns are
ignored. The model file's place is a parameter; models whose normaliser, piece kinds or spaces
differ from what is described here are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from posthorn.llm.arrow import slices, utf8

MARK = "▁"
#: Kinds of pieces in a model file.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_NEVER = float("-inf")
#: Chunks of one kind that a worker remembers (twice as many for a while), and characters of the longest of them.
CHUNKS = 150_000
CHUNK_CHARS = 200
#: Pairs of pieces that a worker remembers; when there are as many, it forgets them all.
PAIRS = 500_000
#: Bytes of texts whose ids a worker holds at a time.
SLICE_BYTES = 2 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class PrefixTable:
    """The encoder and decoder of one model file."""

    def __init__(self, model_file: str) -> None:
        import struct

        with open(model_file, "rb") as f:
            model = list(_fields(f.read()))
        trainer = dict(_fields(next(v for k, v in model if k == 2)))
        normaliser = dict(_fields(next(v for k, v in model if k == 3)))
        if trainer.get(3) != 2 or not trainer.get(35) or normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1):
            raise ValueError("only BPE with byte fallback, identity normalisation and a dummy prefix is handled")
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        for n, raw in enumerate(v for k, v in model if k == 1):
            f = dict(_fields(raw))
            piece, kind = f[1].decode(), f.get(3, _NORMAL)
            self.pieces.append(piece)
            self.kinds.append(kind)
            if kind == _NORMAL:
                self.ids[piece] = n
                self.score[piece] = struct.unpack("<f", f[2])[0]
            elif kind == _BYTE:
                self.bytes[int(piece[3:5], 16)] = n
            elif kind not in (_UNKNOWN, _CONTROL):
                raise ValueError(f"piece {n} is of a kind that is not handled")
        self.end = trainer.get(42, 2)
        single = {p for p in self.ids if len(p) == 1}
        if any(c not in single for p in self.ids for c in p) or any(MARK in p.lstrip(MARK) for p in self.ids) or "\n" in single:
            raise ValueError("pieces must consist of pieces of one character and hold the space mark in front only")
        self.known = re.compile("[" + "".join(map(re.escape, sorted(single))) + "]+|.", re.DOTALL)
        self.single = single
        self.automaton = ahocorasick.Automaton()
        for p, n in self.ids.items():
            self.automaton.add_word(p, (n, len(p)))
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.pieces]
        self.shown = [str(n) for n in range(len(self.pieces))]
        self.plain = {str(n): p.replace(MARK, " ") for p, n in self.ids.items()}
        self.plain |= {str(n): chr(b) for b, n in self.bytes.items() if b < 0x80}  # whole characters
        self.own: list[bool | None] = [None] * len(self.pieces)
        self.apart: dict[int, bool] = {}

    def _merge(self, parts: list[str]) -> list[str]:
        """Merge neighbours, the best score first and the leftmost of equals, until none is a piece."""
        score = self.score.get
        found = [score(x + y, _NEVER) for x, y in zip(parts, parts[1:], strict=False)]
        while found:
            best = max(found)
            if best == _NEVER:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = score(parts[at - 1] + parts[at], _NEVER)
            if at < len(found):
                found[at] = score(parts[at] + parts[at + 1], _NEVER)
        return parts

    def _whole(self, token: int) -> bool:
        """Whether merging a piece's characters gives the piece."""
        ok = self.own[token]
        if ok is None:
            ok = self.own[token] = len(self._merge(list(self.pieces[token]))) == 1
        return ok

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging two pieces side by side leaves just these two."""
        x, y = self.pieces[a], self.pieces[b]
        return self._whole(b) and self._merge(list(x + y)) == [x, y]

    def encode_known(self, text: str) -> list[str]:
        """Ids, as decimal text, of a text all of whose characters are pieces."""
        last = [0] * (len(text) + 1)
        done = -1
        apart, whole = self.apart, self.own
        for at, (token, size) in self.automaton.iter(text):
            if at == done:
                continue
            start = at + 1 - size
            if start:
                pair = last[start] << 32 | token
                ok = apart.get(pair)
                if ok is None:
                    if len(apart) >= PAIRS:
                        apart.clear()
                    ok = apart[pair] = self._apart(last[start], token)
            else:
                ok = whole[token]
                if ok is None:
                    ok = self._whole(token)
            if ok:
                last[at + 1] = token
                done = at
        ids = []
        at = len(text)
        length, shown = self.length, self.shown
        while at:
            token = last[at]
            ids.append(shown[token])
            at -= length[token]
        ids.reverse()
        return ids

    def encode_chunk(self, text: str) -> list[str]:
        """Ids, as decimal text, of a text in which spaces are marks already, without the end id."""
        if self.single.issuperset(text):
            return self.encode_known(text)
        ids: list[str] = []
        for part in self.known.findall(text):
            if part[0] in self.single:
                ids += self.encode_known(part)
            else:
                ids += [self.shown[self.bytes[b]] for b in part.encode()]
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids without the dummy prefix. Control ids have no text."""
        out: list[str] = []
        held = bytearray()
        for n in ids:
            kind = self.kinds[n]
            if kind == _BYTE:
                held.append(int(self.pieces[n][3:5], 16))
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            if kind == _NORMAL:
                out.append(self.pieces[n])
            elif kind == _UNKNOWN:
                out.append(" ⁇ ")
        if held:
            out.append(held.decode(errors="replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text[:1] == " " else text

    def decode_shown(self, ids: str) -> str:
        """The text of ids in decimal. Ids that all are plain pieces are looked up at once."""
        parts = ids.split(" ")
        if parts[-1] == self.shown[self.end]:
            parts.pop()
        try:
            text = "".join(map(self.plain.__getitem__, parts))
        except KeyError:
            return self.decode(map(int, parts))
        return text[1:] if text[:1] == " " else text


class _Chunks(dict):
    """Ids of chunks as decimal text. A key is a chunk; ``to_text`` gives the text that it stands for.

    A full table becomes the old one; what is asked for again moves from there to the new one,
    so chunks that are in use stay and memory is bounded by two tables.
    """

    def __init__(self, table: PrefixTable, to_text) -> None:
        self.table, self.to_text = table, to_text
        self.old: dict[str, str] = {}

    def __missing__(self, key: str) -> str:
        if len(key) > CHUNK_CHARS:
            return " ".join(self.table.encode_chunk(self.to_text(key)))
        if len(self) >= CHUNKS:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = " ".join(self.table.encode_chunk(self.to_text(key)))
        self[key] = found
        return found


class Encoder:
    """Whole texts by way of remembered chunks."""

    def __init__(self, model_file: str) -> None:
        self.table = PrefixTable(model_file)
        self.words = _Chunks(self.table, lambda w: w if w[:1] == "\n" else MARK + w)
        self.runs = _Chunks(self.table, str)
        self.split = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n").findall

    def encode(self, text: str) -> str:
        """The ids as decimal text, the end id included."""
        if not text:
            return str(self.table.end)
        if MARK in text:
            text = text.replace(MARK, " ")
        # A key of ``words`` is a word behind one space, or a line feed and what follows it at once.
        spaced = text.replace("\n", " \n")
        if "  " in spaced or spaced[-1] == " " or text[0] in " \n":
            ids = map(self.runs.__getitem__, self.split(MARK + text.replace(" ", MARK)))
        else:
            ids = map(self.words.__getitem__, spaced.split(" "))
        return f"{' '.join(ids)} {self.table.end}"


@lru_cache(2)
def encoder(model_file: str) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(model_file)


def encode(
    docs: DataFrame, model_file: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",), with_ids: bool = False
) -> DataFrame:
    """``keys``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids``.

    One narrow pass without a shuffle.
    """
    picked = docs.select(*(docs[k].alias(f"k{i}") for i, k in enumerate(keys)), docs[text].cast("string").alias("text"))
    extra = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>"] * with_ids
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]] + extra)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_file)
        for batch in slices(batches, most_bytes=SLICE_BYTES):
            found = [own.encode(x.decode()) for x in utf8(batch.column(batch.num_columns - 1))]
            columns = [
                pa.array([i.count(" ") + 1 for i in found], pa.int64()),
                pa.array([sha(i) for i in found], pa.string()),
                pa.array([sha(own.table.decode_shown(i)) for i in found], pa.string()),
            ]
            if with_ids:
                columns.append(pa.array([np.fromstring(i, np.int32, sep=" ") for i in found], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *(e.split()[0] for e in extra)]
            )

    return picked.mapInArrow(run, schema).toDF(*keys, *(e.split()[0] for e in extra))
