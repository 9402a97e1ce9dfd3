import hashlib

import pytest

from tests.llm import edge
from tidewater.llm import warc as A

ROWS = [
    (1, "http://a.example/x y\r\nEvil: 1", "<p>é" + "x" * 1200), (2, None, "<p>é" + "x" * 1200), (9, "http://b", "<p>é" + "x" * 1200),
    (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "http://c", "<p>é" + "x" * 1200), (None, None, None),
    (7, "http://long", "0123456789" * 700_000), (8, "u", "y" * 999), (10, "u", "y" * 999), (9, "http://b", "<p>é" + "x" * 1200), (11, "u", "\r\n\r\nWARC/1.1\r\n" * 90),
]


def brute(rows):
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        visit = len(b) >= 1000 and same and i != max(same)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if visit else "response", max(same) if visit else None))
    return sorted(out, key=str)


def pages(spark, rows=ROWS):
    return edge.with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_round_trip(spark, tmp_path):
    out = A.round_trip(pages(spark), str(tmp_path / "w"))
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out.collect()), key=str)
    assert got == brute(ROWS)
    texts = {(r["page_id"], bytes(r["payload"]).decode()) for r in out.filter("record_type = 'response'").collect()}
    assert (7, "0123456789" * 700_000) in texts and (11, "\r\n\r\nWARC/1.1\r\n" * 90) in texts


def test_archives_lead_with_a_dictionary_and_decode_alone(spark, tmp_path):
    rows = [(i, f"http://x/{i}", edge.words(i, 400)) for i in range(300)]
    A.write(pages(spark, rows).coalesce(1), str(tmp_path / "w"), archive_bytes=200_000)
    files = sorted((tmp_path / "w").rglob("part-*"))
    assert len(files) > 1
    seen = 0
    for f in files:
        data = f.read_bytes()
        assert data[:4] == b"\x5d\x2a\x4d\x18"
        records = [A.parsed(x)[0] for x in A.frames(data)]
        assert records[0]["warc-type"] == "warcinfo"
        seen += sum(r["warc-type"] == "response" for r in records)
    assert seen == 300 and sum(f.stat().st_size for f in files) < 0.8 * sum(len(r[2]) for r in rows)


def test_damage_is_refused():
    rows = [x + b"\n" for _, x in A.archives(iter([A.page_record(1, "u", b"abc" * 300, hashlib.sha1(b"abc" * 300).hexdigest(), None)]))]
    data = b"".join(rows)
    assert len(list(A.frames(data))) == 2
    for bad in (data[:-3], data[: len(rows[0]) + 20], data + b"zzz", data + b"zzzzzzzzzzzz"):
        with pytest.raises(ValueError):
            list(A.frames(bad))
    good = A.page_record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    for bad in (good.replace(b"WARC/1.1", b"WARX/1.1"), good.replace(b"WARC-Date", b"WARC-Dote"), good[:-1], good + b"x"):
        with pytest.raises(ValueError):
            A.parsed(bad)
    with pytest.raises(ValueError):
        A.page_row(*A.parsed(good.replace(b"abc", b"abd")))


def test_empty_table(spark, tmp_path):
    assert A.round_trip(pages(spark).limit(0), str(tmp_path / "w")).count() == 0
