import gzip
import hashlib
import random
import zlib

from trustframe.llm.common import QUERIES
from trustframe.llm.warc import MAGIC, RangeScan, WarcStore, member, parse

PAGE = "page_id long, url string, html string"


def rows():
    rng = random.Random(5)
    big = "".join(chr(rng.randrange(32, 1000)) for _ in range(300000))
    same = "<html>" + "copy " * 100
    out = [(i, f"http://h{i}.example/é?a=b c\r\nX: y", same if i % 3 == 0 else f"<p>page {i} " + "x" * rng.randrange(2000)) for i in range(90)]
    return out + [(500, None, None), (501, "", ""), (502, "u", "short"), (503, "u", "short"), (504, "u", "é" * 49 + "a"), (505, "u", "é" * 49 + "a"),
                  (506, "u", "é" * 50), (507, "u", "é" * 50), (600, "u", big), (601, "u", "y" * (17 << 20)), (602, "u", "y" * (17 << 20)),
                  (None, "u", same), (None, "u", "only null ids " * 20), (None, "u", "only null ids " * 20)]


def brute(pages):
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, _, h in pages:
        raw = (h or "").encode()
        f = first.get(h or "")
        revisit = len(raw) >= 100 and f is not None and f != p
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


def test_query_round_trip(spark, save):
    sf = save(pages=spark.createDataFrame(rows(), PAGE).selectExpr("*", "1 AS payload", "2 AS digest").repartition(3))
    assert sorted((tuple(r) for r in QUERIES["op6_warc"](spark, sf).collect()), key=repr) == brute(rows())
    empty = save(pages=spark.createDataFrame([], PAGE))
    assert QUERIES["op6_warc"](spark, empty).count() == 0


def test_small_ranges_give_each_record_once(spark, tmp_path):
    store = WarcStore(range_bytes=997)
    pages = [r for r in rows() if r[0] is not None and len(r[2] or "") < 10**6]
    path = str(tmp_path / "warc")
    store.write(spark.createDataFrame(pages, PAGE).repartition(2), path)
    got = store.read(spark, path).collect()
    html = {r[0]: (r[2] or "").encode() for r in pages}
    assert len(got) == len(pages)
    for r in got:
        page = int(r["record_id"][10:-1])
        assert r["payload"] is None if r["warc_type"] == "revisit" else bytes(r["payload"]) == html[page]
    # the files are plain WARC: members end to end, nothing between
    for f in (tmp_path / "warc").glob("part-*"):
        raw = f.read_bytes()
        while raw:
            d = zlib.decompressobj(31)
            assert d.decompress(raw).startswith(b"WARC/1.1") and d.eof
            raw = d.unused_data


def test_nested_members_foreign_bytes_and_broken_members(spark, tmp_path):
    inner = member(77, "u", b"inner payload", "d", None, False, "1970-01-01T00:00:00Z", 6)
    noise = random.Random(1).randbytes(5000)
    outer = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: %d\r\n\r\n" % (len(noise) * 2 + len(inner))
                          + noise + inner + noise + b"\r\n\r\n", 0)  # stored: the inner member's bytes stand in the file
    assert inner in outer
    good = member(2, "u", b"good", "d", None, False, "1970-01-01T00:00:00Z", 6)
    broken = bytearray(member(3, "u", b"broken" * 50, "d", None, False, "1970-01-01T00:00:00Z", 6))
    broken[-6] ^= 1
    (tmp_path / "x").write_bytes(b"junk" + MAGIC + b"junk" + outer + gzip.compress(b"no record") + bytes(broken) + good + good[:20])
    for step in (256, 4096, 1 << 20):
        got = WarcStore(range_bytes=step).read(spark, str(tmp_path)).collect()
        assert sorted(r["record_id"] for r in got) == ["<urn:page:1>", "<urn:page:2>"]
    with open(tmp_path / "x", "rb") as f:
        assert [parse(r[2])["record_id"] for r in RangeScan(f, 0, 1 << 20, piece=64)] == ["<urn:page:1>", "<urn:page:2>"]
