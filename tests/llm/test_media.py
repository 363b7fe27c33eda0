import hashlib
import json
import zipfile
import zlib

import pyarrow.fs as pafs
import pytest

from posthorn.llm import media
from posthorn.plans.scratch import new_path

SCHEMA = "doc_id long, text string, media string, key string"
TEXTS = ["", None, "a", "x" * 63, "x" * 64, "x" * 65, "é😀" * 5000, "\u0000", "words " * 40_000, "a"]


def frame(spark):
    return spark.createDataFrame([(i, t, "", "") for i, t in enumerate(TEXTS)] + [(None, "a", "", ""), (2, "a", "", "")], SCHEMA)


def test_images_round_trip():
    for n in (0, 1, 64, 1000, 200_000):
        payload = media.pad(bytes(i * 7 % 256 for i in range(n)))
        assert len(payload) % 64 == 0 and payload
        assert media.decode_image(media.encode_image(payload)).tobytes() == payload
    with pytest.raises(ValueError):
        media.decode_image(media.encode_image(bytes(64))[:-20] + b"x" * 20)


def test_query_columns_match_a_plain_computation(spark):
    got = media.text_media(frame(spark)).collect()
    want = []
    for d, t in [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a"), (2, "a")]:
        raw = (t or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((repr(tuple(r)[:5]) for r in got)) == sorted(map(repr, want))
    assert len({(r.payload_sha256, r.media_sha256, r.media_bytes, r.feature) for r in got}) == len({w[3] for w in want})


def test_small_ranges_and_archives_read_every_member_once(spark):
    uri = new_path(spark, "media-test")
    media.store(frame(spark).coalesce(1), uri, archive_bytes=600, index_bytes=100)
    manifest = json.load(open(f"{uri.removeprefix('file://')}/_MANIFEST.json"))
    assert len(manifest) > 2
    found = media.load(spark, uri, split_bytes=100, batch_bytes=1)
    assert found.rdd.getNumPartitions() > len(manifest)
    assert sorted(r.n_bytes for r in found.collect()) == sorted(len((t or "").encode()) for t in [*TEXTS, "a", "a"])
    media.store(frame(spark).limit(1), uri)  # appends
    assert media.load(spark, uri).count() == 13


def test_ranges_follow_the_index(spark):
    uri = new_path(spark, "media-test")
    media.store(frame(spark).coalesce(1), uri, index_bytes=300)
    (name, size, starts), = json.load(open(f"{uri.removeprefix('file://')}/_MANIFEST.json"))
    zipped = zipfile.ZipFile(f"{uri.removeprefix('file://')}/{name}").infolist()
    assert len(starts) > 3 and set(starts) <= {m.header_offset for m in zipped}
    for split in (1, 500, 10**9):
        parts = media._Reader(uri, split, 1 << 20).partitions()
        assert [p.first for p in parts][1:] == [p.last for p in parts][:-1] and parts[0].first == 0 and parts[-1].last == size
        found = [r for p in parts for r in media._Reader(uri, split, 1 << 20).read(p)]
        assert [x for r in found for x in r.column(4).to_pylist()] == [m.header_offset for m in zipped]
    assert len(media._Reader(uri, 1, 1).partitions()) == len(starts) and len(parts) == 1


def test_keys_of_any_length(spark):
    keys = ["k" * 100_000, "é" * 70_000, "", None]
    df = spark.createDataFrame([(k, "text") for k in keys], "doc_id string, text string")
    assert sorted(r.doc_id or "" for r in media.text_media(df).collect()) == sorted(k or "" for k in keys)


def test_a_failing_index_is_tried_again(tmp_path, monkeypatch):
    calls = []

    class Flaky(pafs.LocalFileSystem):
        def open_input_file(self, path):
            calls.append(path)
            raise OSError("gone")

    with pytest.raises(OSError, match="gone"):
        media.read_index(Flaky(), str(tmp_path / "a.zip"), (0,), tries=3, wait=0)
    assert len(calls) == 3


def test_orphans_of_lost_attempts_are_not_read(spark):
    uri = new_path(spark, "media-test")
    media.store(frame(spark), uri)
    with zipfile.ZipFile(f"{uri.removeprefix('file://')}/part-orphan.zip", "w") as z:
        z.writestr("x", b"x")
    assert media.load(spark, uri).count() == 12


def test_a_damaged_member_is_one_error_row(spark):
    uri = new_path(spark, "media-test")
    media.store(frame(spark).coalesce(1), uri)
    folder = uri.removeprefix("file://")
    name = json.load(open(f"{folder}/_MANIFEST.json"))[0][0]
    m = zipfile.ZipFile(f"{folder}/{name}").infolist()[3]
    with open(f"{folder}/{name}", "r+b") as f:
        f.seek(m.header_offset + 60)
        f.write(b"damage")
    rows = media.load(spark, uri).collect()
    assert len(rows) == 12 and [r.offset for r in rows if r.error] == [m.header_offset]
    with pytest.raises(Exception, match="media member"):
        media.features(media.load(spark, uri)).collect()


def test_a_failing_read_is_tried_again(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m", b"payload")
    member = zipfile.ZipFile(tmp_path / "a.zip").infolist()[0]
    fs, calls = pafs.LocalFileSystem(), []

    class Flaky:
        def read_at(self, n, at):
            calls.append(at)
            raise OSError("gone")

    handle, data, error = media.read_member(Flaky(), fs, str(tmp_path / "a.zip"), member, wait=0)
    assert (data, error, calls) == (b"payload", None, [0])
    assert media.read_member(None, fs, str(tmp_path / "none.zip"), member, tries=2, wait=0)[2].startswith("FileNotFound")


def test_empty_table(spark):
    assert media.text_media(frame(spark).limit(0)).collect() == []
