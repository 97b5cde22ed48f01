import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from runlens.llm.warc import archived_pages, warc_chunks, warc_payloads, warc_records, write_warc

SCHEMA = "page_id long, url string, html string"


def brute(rows, least):
    largest, count = {}, {}
    for i, _, html in rows:
        h = (html or "").encode()
        count[h] = count.get(h, 0) + 1
        if len(h) >= least and i is not None:
            largest[h] = max(i, largest.get(h, i))
    out = []
    for i, _, html in rows:
        h = (html or "").encode()
        to = largest.get(h)
        revisit = to is not None and (i is None or i < to)
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if revisit else "response", to if revisit else None, True))
    return sorted(out, key=repr)


def pages(seed):
    r = random.Random(seed)
    texts = ["<p>é日本\n\r\n\r\nWARC/1.1\r\n</p>" * r.randint(1, 200) for _ in range(6)] + [None, "", "\n", "\r\n\r\n", "x" * 1000, "x" * 999, "ü" * 500, "\r\n" * 400_000, "日" * 300_001]
    rows = [(i * 3 - 20, r.choice(["http://a.b/c", None, "http://x/\r\nWARC-Type: evil"]), r.choice(texts)) for i in range(60)]
    return rows + [(500 + i, "http://copy", texts[0]) for i in range(40)] + [(None, "u", texts[0]), (None, None, "y" * 2000), (None, None, "y" * 2000), rows[3], (7000, "v", "z" * 1500), (7000, "v", "z" * 1500), (6999, "v", "z" * 1500), (7001, "w", texts[-1]), (7002, "w", texts[-2])]


@pytest.mark.parametrize("segment", [7, 5000, 1 << 18])
def test_against_brute_force(spark, tmp_path, segment):
    rows = pages(1) if segment > 7 else [(i, u, (h or "")[:1300]) for i, u, h in pages(1)]
    df = spark.createDataFrame([(*x, "clash", 1, "n") for x in rows], SCHEMA + ", payload string, n int, record_id string").repartition(4)
    got = archived_pages(df, str(tmp_path / "w"), segment=segment)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(rows, 1000)


def test_archives_are_plain_warc_and_chunks_are_bounded(spark, tmp_path):
    path = str(tmp_path / "w")
    html = "".join(chr(0x4E00 + i % 999) for i in range(40_000))
    df = spark.createDataFrame([(1, "http://a", html), (2, "http://b", "short")], SCHEMA).coalesce(1)
    write_warc(warc_records(df, "page_id", "url", "html", segment=10_000), path)
    (file,) = (tmp_path / "w").glob("part-*.gz")
    data, found = gzip.decompress(file.read_bytes()), []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and data[n : n + 4] == b"\r\n\r\n" and fields["WARC-Block-Digest"] == "sha1:" + hashlib.sha1(data[:n]).hexdigest()
        found.append((fields, data[:n]))
        data = data[n + 4 :]
    assert [f["WARC-Type"] for f, _ in found] == ["response"] + ["continuation"] * 11 + ["response"]
    block = b"".join(b for _, b in found[:12])
    assert int(found[11][0]["WARC-Segment-Total-Length"]) == len(block) and block.endswith(html.encode())
    assert all(f["WARC-Segment-Origin-ID"] == found[0][0]["WARC-Record-ID"] for f, _ in found[1:12])

    rows = warc_chunks(spark, path, chunk=3000).orderBy("record_id", "chunk").collect()
    assert max(len(r.payload) for r in rows) <= 3000
    one = [r for r in rows if r.target_uri == "http://a"]
    assert b"".join(r.payload for r in one).decode() == html and [r.chunk for r in one] == list(range(len(one)))
    assert [r.last for r in one] == [False] * (len(one) - 1) + [True] and one[-1].payload_bytes == len(html.encode())
    assert one[-1].payload_digest == hashlib.sha1(html.encode()).hexdigest() and all(r.payload_digest is None for r in one[:-1])


def test_segments_in_several_files(spark, tmp_path):
    path = str(tmp_path / "w")
    texts = {i: chr(97 + i) * (1000 * i + 1) for i in range(8)}
    df = spark.createDataFrame([(i, f"http://{i}", t) for i, t in texts.items()], SCHEMA)
    write_warc(warc_records(df, "page_id", "url", "html", segment=600).repartition(5, F.rand(3)).cache(), path)
    got = {r.record_id.split(":")[2]: (r.payload_bytes, r.payload_digest, r.intact) for r in warc_payloads(spark, path).collect()}
    assert got == {str(i): (len(t), hashlib.sha1(t.encode()).hexdigest(), True) for i, t in texts.items()}


def test_foreign_records_and_damage(spark, tmp_path):
    def record(kind, body, *more):
        return ("WARC/1.0\r\n" + "".join(f"{x}\r\n" for x in (f"WARC-Type: {kind}", f"Content-Length: {len(body)}", *more)) + "\r\n").encode() + body + b"\r\n\r\n"

    sha = hashlib.sha1(b"\xff\x00body").digest()
    import base64

    b32 = base64.b32encode(sha).decode()
    good = record("warcinfo", b"software: x\r\n", "WARC-Record-ID: <urn:1>") + record("response", b"HTTP/1.1 200 OK\r\n\r\n\xff\x00body", "Content-Type: application/http", "WARC-Record-ID: <urn:2>", f"WARC-Payload-Digest: sha1:{b32}")
    good += record("resource", b"\xff\x00body!", "WARC-Record-ID: <urn:3>", f"WARC-Payload-Digest: SHA1:{b32}") + record("metadata", b"", "WARC-Record-ID: <urn:4>", "WARC-Payload-Digest: md5:00")
    good += record("response", b"no header", "Content-Type: application/http", "WARC-Record-ID: <urn:5>")
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.warc.gz").write_bytes(gzip.compress(good[:300]) + gzip.compress(good[300:]))
    got = {r.record_id: (r.payload_bytes, r.intact) for r in warc_payloads(spark, str(tmp_path / "a")).collect()}
    assert got == {"<urn:1>": (13, True), "<urn:2>": (6, True), "<urn:3>": (7, False), "<urn:4>": (0, True), "<urn:5>": (9, True)}
    for k, bad in enumerate((good[:-30], good.replace(b"Content-Length: 7", b"Content-Length: 6"), b"junk\r\n\r\n")):
        (tmp_path / f"b{k}").mkdir()
        (tmp_path / f"b{k}/x.warc.gz").write_bytes(gzip.compress(bad))
        with pytest.raises(Exception, match="archive ends|Content-Length|no WARC"):
            warc_payloads(spark, str(tmp_path / f"b{k}")).collect()


def test_empty_table(spark, tmp_path):
    assert archived_pages(spark.createDataFrame([], SCHEMA), str(tmp_path / "w")).count() == 0
