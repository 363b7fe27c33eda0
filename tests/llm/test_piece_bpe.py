import hashlib
import random

import pytest

from posthorn.llm import piece_bpe

tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = tokenizers.path("piece_bpe_32k.model")

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n", " \n ", "a\nb", "a \nb", "\na", "▁", "a▁b", "▁▁ x", "日本語 テスト",
    "😀 x😀\t\r\ny", "<s> </s> <0x0A> <unk>", "\u0000a", "ﬁ é é", "x" * 5000, "ab " * 3000, "   lots    of   spaces   ",
    "a b　c", "⁇", "ab\u0085c", "퟿�", "'" * 40 + "\n" * 40 + "=" * 70,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def random_texts(n, seed):
    rng = random.Random(seed)
    syllables = ["th", "er", "ing", "ción", "é", "ß", "zu", "Über", ".", ",", "!!", "12", "3", "###", "|", "x", "Q", "the", " ", " ", " ", "  ", "\n", "語", "\t"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 120))) for _ in range(n)]


def test_ids_and_decoding_equal_the_library(library):
    own = piece_bpe.Encoder(MODEL)
    for text in ODD + random_texts(1500, 3):
        want = library.encode(text, add_eos=True)
        got = own.encode(text)
        assert got == " ".join(map(str, want)), text
        assert own.table.decode_shown(got) == library.decode(want) == own.table.decode(want), text


def test_decoding_of_any_ids(library):
    own = piece_bpe.Encoder(MODEL).table
    rng = random.Random(9)
    for _ in range(300):
        ids = [rng.randrange(1, 32000) for _ in range(rng.randrange(0, 12))]
        assert own.decode_shown(" ".join(map(str, ids)) or "2") == library.decode(ids)


def test_a_small_chunk_table_gives_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CHUNKS", 5)
    own = piece_bpe.Encoder(MODEL)
    for text in random_texts(200, 4):
        assert own.encode(text) == " ".join(map(str, library.encode(text, add_eos=True)))
    assert len(own.words) <= 6 and len(own.words.old) <= 6


def test_a_small_pair_table_gives_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "PAIRS", 7)
    own = piece_bpe.Encoder(MODEL)
    for text in random_texts(100, 6):
        assert own.encode(text) == " ".join(map(str, library.encode(text, add_eos=True)))
    assert len(own.table.apart) <= 7


def test_digests_on_a_table(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null key"), (7, None), (7, None)]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_tokens int")
    got = piece_bpe.encode(df, MODEL, with_ids=True)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), ids))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert piece_bpe.encode(df.limit(0), MODEL).collect() == []
