import base64
import gzip
import hashlib
import pathlib

import pytest

from tessera.llm import warc

MARK = "\r\n\r\nWARC/1.1\r\n"
LONG = "é" * 5000 + MARK + "q" * 3000
ROWS = [(1, "u", "abc"), (2, "u2", "abc"), (3, None, None), (4, "x y\n", ""), (5, "u", MARK * 3 + "zz"), (6, "u", LONG), (6, "u", LONG), (None, "n", "abc"), (None, "n", "only"), (7, "u", MARK), (0, "u", LONG), (9, "u", "\r\n\r\n"), (10, "u", "\n" * 3000), (11, "u", "WARC/1.1\r\nx"), (12, "u", "x\r\n\r\nWARC/1.1"), (13, "u", LONG + "2"), (13, "u", LONG + "3"), (13, "u", LONG + "3"), (14, "u", "A" * 3000), (14, "u", "B" * 3000), (None, "u", "C" * 3000), (None, "u", "D" * 3000), (None, "u", "D" * 3000), (15, "u", "E" * 600_000), (15, "u", "F" * 600_000), (None, "u", "G" * 600_000), (None, "u", "H" * 600_000)]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        own = first.get(h or "")
        again = own is not None and own != i
        out.append((i, len((h or "").encode()), digest(h), "revisit" if again else "response", own if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [64, 1000, warc.CHUNK])
def test_round_trip(spark, size):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    assert sorted((tuple(r) for r in warc.archive_and_read(pages, size).collect()), key=str) == expected(ROWS)


def test_archives_are_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x" * 2500), (2, "http://b", "x" * 2500), (3, "http://c", "y")], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"), 1000)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in pathlib.Path(tmp_path / "w").glob("part-*"))
    kinds, payloads, at = [], {}, 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        assert data[at : at + 10] == b"WARC/1.1\r\n"
        size = int(head["Content-Length"])
        assert data[end + 4 + size : end + 8 + size] == b"\r\n\r\n" and size <= 1000
        kinds.append(head["WARC-Type"])
        origin = head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"])
        payloads[origin] = payloads.get(origin, b"") + data[end + 4 : end + 4 + size]
        at = end + 8 + size
    assert sorted(kinds) == ["continuation", "continuation", "response", "response", "revisit"]
    sha1 = hashlib.sha1(b"x" * 2500).hexdigest()
    assert payloads == {f"<urn:page:1:{sha1}>": b"x" * 2500, f"<urn:page:2:{sha1}>": b"", f"<urn:page:3:{hashlib.sha1(b'y').hexdigest()}>": b"y"}


def test_missing_chunks_are_seen(spark):
    rows = [("1:aa", "response", None, k, False, None, None, None, "0-1", b"x") for k in (1, 3)]
    with pytest.raises(Exception, match="no chunk 2"):
        warc.payloads(spark.createDataFrame(rows, warc._PARTS)).collect()
    with pytest.raises(Exception, match="no end"):
        warc.payloads(spark.createDataFrame(rows[:1], warc._PARTS)).collect()


def test_no_piece_holds_the_version_line():
    for text in (MARK * 5, "WARC/1.1" * 9, "a" * 10 + "WARC/1.1", ""):
        parts = list(warc.chunks(text.encode(), 7))
        assert b"".join(parts) == text.encode() and not any(b"WARC/1.1" in x for x in parts) and all(len(x) <= 7 for x in parts)


def test_empty_and_more_columns(spark):
    pages = spark.createDataFrame([(1, "u", "a", "b", 5)], "page_id long, url string, html string, first_id string, _digest int")
    assert [tuple(r) for r in warc.archive_and_read(pages).collect()] == [(1, 1, digest("a"), "response", None)]
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_damage_is_seen(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "abcdef")], "page_id long, url string, html string"), str(tmp_path / "w"), compression="none")
    parts = [p for p in pathlib.Path(tmp_path / "w").glob("part-*.txt") if b"abcdef" in p.read_bytes()]  # others are empty
    assert len(parts) == 1
    parts[0].write_bytes(parts[0].read_bytes().replace(b"abcdef", b"abcdeX"))
    for crc in pathlib.Path(tmp_path / "w").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="digest"):
        warc.payloads(warc.read_chunks(spark, str(tmp_path / "w"))).collect()


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), pa.array([b"a" * 6, None, b"b" * 4, b"c" * 99, b""])], ["n", "data"])
    got = [x.column(0).to_pylist() for x in warc.parts(iter([batch, batch.slice(0, 0)]), 1, 10)]
    assert got == [[1, 2, 3], [4], [5]]
