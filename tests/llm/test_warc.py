"""WARC archives: round trip, ranges of any size, damage."""

import gzip
import hashlib
import io
import random

import pytest

from claimwise.llm import warc

from .conftest import CLASH


def pages(n, seed):
    r = random.Random(seed)
    texts = ["", "short", "É" * 49, "É" * 50, "y" * 99, "y" * 100, "z" * 100_000]
    texts += ["".join(chr(r.randrange(32, 1000)) for _ in range(r.randrange(400))) for _ in range(n // 3)]
    out = [(k, r.choice([f"http://h{k}.org/a b\r\nX: y", "http://x.org/é", None, ""]), r.choice([*texts, None])) for k in range(n)]
    return out + [(3, "u", "y" * 100), (3, "u", "y" * 100), (None, "u", "y" * 100), (None, "v", "only null keys " * 10), (None, "v", "only null keys " * 10)]


def expected(rows):
    first = {}
    for k, _, h in rows:
        if k is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, k), k)
    out = []
    for k, _, h in rows:
        raw, f = (h or "").encode(), first.get(h)
        again = f is not None and f != k
        out.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def frame(spark, rows, extra=()):
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], "page_id long, url string, html string" + "".join(f", {c} string" for c in extra))


@pytest.mark.parametrize("split,file_bytes,read", [(4 << 20, 1 << 30, 1 << 18), (700, 3000, 64), (97, 1 << 30, 5)])
def test_round_trip(spark, monkeypatch, split, file_bytes, read):
    monkeypatch.setattr(warc, "READ_BYTES", read)
    rows = pages(60, 5)
    made = warc.write_warc(frame(spark, rows, ("k", "u", "p", "d", "first", *CLASH)).repartition(3), file_bytes=file_bytes)
    got = warc.read_warc(made, split_bytes=split).where("record_type != 'warcinfo'").collect()
    assert made.agg({"records": "sum"}).first()[0] == len(rows) + made.count()
    assert sorted((tuple(r) for r in warc.archived_pages(made).collect()), key=repr) == expected(rows)
    by_id = {r.record_id: r for r in got if r.record_type == "response"}
    for r in got:  # payloads come back, or lie where the revisit says
        payload = r.payload if r.record_type == "response" else by_id[r.refers_to_id].payload
        assert hashlib.sha256(payload).hexdigest() == r.payload_digest and len(payload) == r.payload_bytes
        assert r.target_uri is None or not set(r.target_uri) & set("\r\n ")


def test_registered_folder_and_shuffled_copies(spark, tmp_path):
    """Without a broadcast, and found by listing the folder."""
    rows = pages(30, 6)
    spark.conf.set("claimwise.broadcastMaxBytes", "0")
    try:
        warc.write_warc(frame(spark, rows), folder=str(tmp_path / "a"))
    finally:
        spark.conf.unset("claimwise.broadcastMaxBytes")
    listed = warc.archives(spark, str(tmp_path / "a"))
    assert sorted((tuple(r) for r in warc.archived_pages(listed).collect()), key=repr) == expected(rows)
    for r in listed.collect():  # each member is plain gzip
        assert gzip.open(r.path.removeprefix("file:")).read().count(b"WARC/1.1\r\n") >= 1


def members(n):
    fields = lambda k: [("WARC-Record-ID", f"<urn:{k}>"), ("X-Page-Id", str(k))]
    return [warc.encode_record("resource", fields(k), (b"\x1f\x8b\x08 no member %d " % k) * 50, level=0) for k in range(n)]


@pytest.mark.parametrize("step", [1, 13, 1000, 1 << 20])
def test_every_range_owns_what_starts_in_it(step):
    """The magic also occurs inside records (stored uncompressed) and between them."""
    parts = members(4)
    parts.insert(2, b"\x1f\x8b\x08junk between")
    whole = b"".join(parts)
    starts = [sum(map(len, parts[:k])) for k in (0, 1, 3, 4)]
    got = [(a, r) for a in range(0, len(whole), step) for r in warc.read_range(io.BytesIO(whole), a, a + step)] if step > 1 else \
        [(a, r) for a in (0, *starts, *(s + 1 for s in starts)) for r in warc.read_range(io.BytesIO(whole), a, a + 1)]
    if step == 1:
        got = list({r["offset"]: (a, r) for a, r in got}.values())
    assert [r["offset"] for _, r in got] == starts and all(a <= r["offset"] < a + step for a, r in got)
    assert [r["headers"]["x-page-id"] for _, r in got] == list("0123")


def test_several_records_in_a_member_and_long_headers():
    import zlib

    one = gzip.compress(zlib.decompress(members(1)[0], 31) + zlib.decompress(warc.encode_record("resource", [("A", "x" * 700_000), ("B", "y\r\n  z")], b"b"), 31))
    got = list(warc.read_range(io.BytesIO(one), 0, len(one)))
    assert len(got) == 2 and got[0]["offset"] == got[1]["offset"] == 0
    assert len(got[1]["headers"]["a"]) == 700_000 and got[1]["headers"]["b"] == "y z" and got[1]["payload"] == b"b"


def test_damage_is_told():
    a, b, c = members(3)
    flipped = bytearray(b)
    flipped[len(b) // 2] ^= 1
    whole = a + bytes(flipped) + c
    with pytest.raises(warc.Damaged):
        list(warc.read_range(io.BytesIO(whole), 0, len(whole)))
    kept = list(warc.read_range(io.BytesIO(whole), 0, len(whole), errors="keep"))
    assert [r["headers"]["x-page-id"] for r in kept if "headers" in r and "error" not in r][-1] == "2" and any("error" in r for r in kept)
    cut = list(warc.read_range(io.BytesIO(a + b[: len(b) // 2]), 0, 1 << 30, errors="keep"))
    assert "error" not in cut[0] and "breaks off" in cut[1]["error"]
    wrong = warc.encode_record("resource", [("WARC-Payload-Digest", "sha256:" + "0" * 64)], b"x")
    assert "differs" in next(warc.read_range(io.BytesIO(wrong), 0, 9, errors="keep"))["error"]


def test_empty_table(spark):
    made = warc.write_warc(frame(spark, []))
    assert made.count() == 0 and warc.archived_pages(made).count() == 0
