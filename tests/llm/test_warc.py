import hashlib
import io
import random

from pyspark.sql import Row

from turnweave.llm import warc

LONG = "<p>ünï 🎉 " + "x" * 200


def brute(rows):
    least = {}
    for p, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            least[h] = min(least.get(h, p), p)
    out = []
    for p, h in rows:
        data = (h or "").encode()
        first = least.get(h)
        revisit = first is not None and first != p
        out.append((str(p), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def answer(spark, rows, **options):
    pages = spark.createDataFrame([Row(page_id=p, url=f"http://a/{p}\r\nX: y", html=h, least="z", payload=1) for p, h in rows], "page_id long, url string, html string, least string, payload int")
    got = warc.round_trip(pages, **options).collect()
    return sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)


ROWS = [(5, LONG), (3, LONG), (9, LONG), (3, LONG), (1, None), (2, ""), (4, "short"), (6, "short"), (None, LONG), (None, "q" * 300), (7, "WARC/1.1\r\n\x1f\x8b\x08" * 40), (8, "\r\n\r\n" * 99)]


def test_round_trip(spark):
    assert answer(spark, ROWS) == brute(ROWS)
    assert answer(spark, ROWS, archive_bytes=500) == brute(ROWS)
    assert answer(spark, []) == []


def records(n):
    out = []
    for i in range(n):
        body = ("body %d " % i).encode() * 50
        out.append(warc.record(i, "http://a/", body, hashlib.sha256(body).hexdigest()))
    return out


def read(data):
    found, gaps = [], []
    for what, begin, end, headers, _ in warc.salvage(io.BytesIO(data), len(data)):
        (found if what == "record" else gaps).append((begin, end, headers.get("WARC-Record-ID")))
    return [f[2] for f in found], [g[:2] for g in gaps]


def test_salvage_of_plain_and_compressed_records(monkeypatch):
    monkeypatch.setattr(warc, "_WINDOW", 700)
    plain = records(6)
    parts = [warc.member(r) if i % 2 else r for i, r in enumerate(plain)]
    names = [f"<urn:page:{i}>" for i in range(6)]
    assert read(b"".join(parts)) == (names, [])
    for i in range(6):
        for damage in ("flip", "cut", "drop"):
            hurt = bytearray(parts[i])
            if damage == "flip":
                hurt[len(hurt) // 2] ^= 0xFF
            elif damage == "cut":
                hurt = hurt[: len(hurt) // 2]
            else:
                hurt = b"junk\x1f\x8b\x08junk WARC/1.1 junk"
            before = sum(map(len, parts[:i]))
            got, gaps = read(b"".join(parts[:i]) + bytes(hurt) + b"".join(parts[i + 1 :]))
            assert got == names[:i] + names[i + 1 :], (i, damage)
            assert gaps == [(before, before + len(hurt))]


def test_salvage_inside_a_member():
    rng = random.Random(3)
    plain = []
    for i in range(5):
        body = bytes(rng.randrange(256) for _ in range(3000))
        plain.append(warc.record(i, "http://a/", body, hashlib.sha256(body).hexdigest()))
    names = [f"<urn:page:{i}>" for i in range(5)]
    whole = warc.member(b"".join(plain))
    assert read(whole) == (names, [])
    # one wrong byte in a record, packed anew: the member's checks hold, the record's do not
    data = bytearray(b"".join(plain))
    data[len(plain[0]) + len(plain[1]) + 1500] ^= 1
    assert read(warc.member(bytes(data)))[0] == names[:2] + names[3:]
    # a wrong byte in the packed form
    hurt = bytearray(whole)
    hurt[len(hurt) // 2] ^= 1
    got, gaps = read(bytes(hurt) + plain[0])
    assert got[:2] == names[:2] and got[-1] == names[0] and names[2] not in got and (0, len(hurt)) in gaps
    # a cut member
    got, gaps = read(whole[: len(whole) * 8 // 10])
    assert got == names[:3] or got == names[:4]
    assert gaps


def test_undigested_records_need_a_whole_member():
    bare = b"WARC/1.1\r\nContent-Length: 3\r\nWARC-Record-ID: x\r\n\r\nabc\r\n\r\n"
    packed = warc.member(bare * 2)
    assert read(packed) == (["x", "x"], [])
    assert read(packed[:-1])[0] == []


def test_long_headers_and_odd_ids(spark):
    url = "http://a/" + "u" * 1_500_000
    rows = [("", url, "a"), ("x\r\ny <>", None, LONG), (None, "http://b", "c"), ("z", "http://b", LONG)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {("", "response", None), ("x\r\ny <>", "response", None), (None, "response", None), ("z", "revisit", "x\r\ny <>")}


def test_a_very_long_payload(spark):
    pages = spark.createDataFrame([(1, "http://a", "ü" * 2_000_000), (2, "http://a", "x")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.payload_bytes) for r in warc.round_trip(pages).collect()) == [(1, 4_000_000), (2, 1)]


def test_nothing_but_junk():
    assert read(b"") == ([], [])
    assert read(b"junk" * 10) == ([], [(0, 40)])
