import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from molquarry.llm import warc_zip
from molquarry.llm.common import written
from molquarry.llm.warc_zip import members, page_digests, read_packages, stored_range, with_revisits, write_packages

LONG = "<p>same text é</p>" * 100
ROWS = [(1, "http://a/ b", LONG), (2, "u", LONG), (9, None, LONG), (9, "again", LONG), (None, "x", LONG), (4, "s", "short"), (5, "s", "short"), (6, "n", None), (7, "e", ""), (8, "m", "\r\n\r\nWARC/1.1\r\n" * 20), (10, "big", "日" * 400_000)]


def brute(rows):
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = max(same) if len(raw) >= 1000 and same else page_id
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "response" if first == page_id else "revisit", None if first == page_id else first))
    return sorted(out, key=str)


def source(raw):
    return pa.BufferReader(raw)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, payload string").repartition(3)
    assert sorted(map(tuple, page_digests(spark, pages).collect()), key=str) == brute(ROWS)
    assert page_digests(spark, pages.limit(0)).collect() == []


def test_payloads_and_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_zip, "STRETCH", 100)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    packages = write_packages(with_revisits(pages), f"file://{tmp_path}/w")
    got = read_packages(packages, payloads=True).where("record_type = 'response'").collect()
    want = {r[0]: (r[2] or "").encode() for r in ROWS}
    assert all(bytes(r["payload"]) == want[r["page_id"]] for r in got)
    with zipfile.ZipFile(next((tmp_path / "w").glob("*.wacz"))) as package:  # other readers can read it
        assert package.testzip() is None and {m.compress_type for m in package.infolist()} == {0}


@pytest.mark.parametrize("limit", [None, 10])
def test_zip64_directories(monkeypatch, limit):
    raw = io.BytesIO()
    if limit:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for i in range(4):
            z.writestr(f"m{i}", f"member {i} " * 20)
        z.comment = b"a comment PK"
    if limit:
        assert b"PK\x06\x06" in raw.getvalue()
    found = members(source(raw.getvalue()))
    assert [m.name for m in found] == [f"m{i}" for i in range(4)]
    for i, m in enumerate(found):
        at, n = stored_range(source(raw.getvalue()), m)
        assert raw.getvalue()[at : at + n] == (f"member {i} " * 20).encode()


def test_bad_packages():
    with pytest.raises(ValueError):
        members(source(b"no package"))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m", "text " * 100)
    with pytest.raises(ValueError):
        stored_range(source(raw.getvalue()), members(source(raw.getvalue()))[0])
