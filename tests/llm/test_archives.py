import io
import struct
import zipfile

import pytest

from ledgerwake.llm import warczip as W


def archive(records, **kw):
    f = io.BytesIO()
    z = W.ZipWriter(f)
    z.begin(W.DATA)
    at, lines = 0, []
    for r in records:
        z.add(r)
        lines.append(f"{at} {len(r)}\n")
        at += len(r)
    z.finish()
    z.begin(W.INDEX)
    z.add("".join(lines).encode())
    z.finish()
    z.close()
    return f


def test_other_readers_open_our_archives():
    records = [W.record(i, f"http://x/{i}", b"<p>%d</p>" % i) for i in range(5)]
    f = archive(records)
    with zipfile.ZipFile(f) as z:
        assert z.testzip() is None and z.read(W.DATA) == b"".join(records)
    r = W.ZipReader(f, len(f.getvalue()))
    assert set(r.members) == {W.DATA, W.INDEX} and r.read(W.DATA) == b"".join(records)
    assert r.read(W.DATA, len(records[0]), len(records[1])) == records[1]
    with pytest.raises(ValueError):
        r.read(W.DATA, 0, 10**9)


def test_we_open_other_writers_archives():
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("a/é.txt", b"stored")
        z.writestr("big", b"x" * 1000, zipfile.ZIP_DEFLATED)
        with z.open("zip64", "w", force_zip64=True) as g:
            g.write(b"0123456789")
        z.comment = b"a comment"
    r = W.ZipReader(f, len(f.getvalue()))
    assert r.read("a/é.txt") == b"stored" and r.read("zip64", 3, 4) == b"3456"
    with pytest.raises(ValueError, match="compressed"):
        r.read("big")


def test_more_members_than_the_old_format_counts():
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        for i in range(66_000):
            z.writestr(str(i), b"")
    r = W.ZipReader(f, len(f.getvalue()))
    assert len(r.members) == 66_000


def test_broken_files():
    for data in (b"", b"no archive", archive([b"x"]).getvalue()[:-30]):
        with pytest.raises((ValueError, struct.error)):
            W.ZipReader(io.BytesIO(data), len(data))


def test_records():
    fields, http, body = W.parse(W.record(7, "http://x/\r\n", "日本".encode()))
    assert body == "日本".encode() and fields["warc-type"] == "response" and b"Content-Length: 6" in http
    fields, http, body = W.parse(W.record(8, None, b"abc", 7, True))
    assert body == b"" and fields["x-refers-to-page-id"] == "7" and fields["warc-payload-digest"] == "sha1:" + W.base32_sha1(b"abc")


PAGES = [(3, "u", "x"), (1, "u", "x"), (2, None, None), (5, "u", ""), (None, "v", "x"), (1, "u", "x"), (9, "é\r\n", "日"), (10, "u", "y" * 300_000)]


@pytest.mark.parametrize("least", [0, 1, 2])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, payload string")
    first = {}
    for k, _, h in PAGES:
        h = h or ""
        if k is not None and len(h.encode()) >= least:
            first[h] = min(first.get(h, k), k)
    want = []
    for k, _, h in PAGES:
        raw = (h or "").encode()
        again = (h or "") in first and first[h or ""] != k
        want.append(str((k, len(raw), W.base32_sha1(raw), "revisit" if again else "response", first[h or ""] if again else None)))
    got = [str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in W.round_trip(df, least).collect()]
    assert sorted(got) == sorted(want)


def test_small_archives_and_no_pages(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i % 50} " * 40) for i in range(200)], "page_id long, url string, html string")
    made = W.write_archives(W.typed(df), f"file://{tmp_path}/w", archive=1000)
    assert made.count() > 4 and not list((tmp_path / "w").glob(".*.wacz"))
    got = W.read_archives(made, share=3).collect()
    assert sorted(r["page_id"] for r in got) == list(range(200)) and sum(r["record_type"] == "response" for r in got) == 50
    assert W.round_trip(df.limit(0)).count() == 0
