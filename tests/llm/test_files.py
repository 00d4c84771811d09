import collections
import hashlib
import zlib

import fixtures
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textloom.llm import media, tokencount


def test_token_counts(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = fixtures.rows(3, 60) + [(9000, "a <|endoftext|> b")]
    got = tokencount.count_tokens(fixtures.frame(spark, docs), file_tokens=700, block_tokens=97)
    want = collections.Counter((d, len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in docs)
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got.collect()) == want
    assert tokencount.count_tokens(fixtures.frame(spark, []).limit(0)).collect() == []


def test_scan_of_any_file(spark, tmp_path):
    r = np.random.default_rng(0)
    files = []
    for k in range(4):
        ids = r.integers(0, 12, 1000).astype("<u4")
        if k == 1:
            ids[:] = 3
        if k == 2:
            ids[-1] = 7
        (tmp_path / f"{k}.bin").write_bytes(ids.tobytes())
        files.append((f"{k}.bin", 1000, ids))
    table = spark.createDataFrame([(f, n) for f, n, _ in files] + [("none.bin", 0)], "file string, tokens long")
    got = {(x.file, x.ordinal): (x.first_token, x.n_tokens, x.ended) for x in tokencount.scan(table, str(tmp_path), 7, 4, 64).collect()}
    want = {}
    for f, n, ids in files:
        start = ordinal = 0
        for at in np.flatnonzero(ids == 7).tolist():
            want[(f, ordinal)] = (start, at - start, True)
            start, ordinal = at + 1, ordinal + 1
        if start < n:
            want[(f, ordinal)] = (start, n - start, False)
    assert got == want


@pytest.mark.parametrize("raw", [b"", b"x", b"\xff" * 576, bytes(range(256)) * 9])
def test_png_round_trip(raw):
    n, payload = media.decode(media.encode(raw))
    assert n == len(raw) and payload[:n] == raw and set(payload[n:]) <= {255} and len(payload) % 576 == 0 < len(payload)
    with pytest.raises(ValueError):
        media.decode(media.encode(raw)[:-20] + b"0" * 20)


def test_media(spark):
    docs = fixtures.rows(3, 60)
    rows = media.media_columns(fixtures.frame(spark, docs), archive_bytes=3000, range_bytes=700).collect()
    want = collections.Counter()
    for d, t in docs:
        p = media.padded((t or "").encode())
        want[(d, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert len({(r.payload_sha256, r.n_bytes) for r in rows}) == len({(r.payload_sha256, r.n_bytes, r.media_sha256, r.media_bytes, r.feature) for r in rows})
    assert media.media_columns(fixtures.frame(spark, []).limit(0)).collect() == []


def test_a_member_is_tried_again_by_itself(tmp_path, monkeypatch):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(4):
            z.writestr(f"{i}-={i}", media.encode(b"%d" % i))
    reader = media.ArchiveReader({"path": str(tmp_path), "range_bytes": "200"})
    calls, plain = collections.Counter(), media.ArchiveReader._member

    def flaky(self, store, path, info):
        calls[info.filename] += 1
        if info.filename[0] == "2" and calls[info.filename] < 3:
            raise OSError("once more")
        return plain(self, store, path, info)

    monkeypatch.setattr(media.ArchiveReader, "_member", flaky)
    parts = reader.partitions()
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) > 2 and [r["n_bytes"] for r in got] == [1] * 4 and calls == {"0-=0": 1, "1-=1": 1, "2-=2": 3, "3-=3": 1}


def test_ids_that_a_file_cannot_hold_are_refused(spark):
    frame = fixtures.frame(spark, [(1, "one two three")])
    with pytest.raises(ValueError, match="does not fit"):
        tokencount.count_tokens(frame, end=50256, width=1)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    with pytest.raises(Exception, match="an id of a text is"):
        tokencount.count_tokens(frame, end=t.encode("one two three", add_special_tokens=False).ids[0]).collect()
