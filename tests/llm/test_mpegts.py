import hashlib
import os
import random
import zlib

import pytest

from tessera.llm import mpegts as M


def test_round_trip():
    r = random.Random(3)
    for n in [1, 5, 100, 150, *range(155, 195), 300, 368, 1000, 32767, 32768, 32769, 65536, 300000, *(r.randrange(1, 70000) for _ in range(60))]:
        for unit in (M.UNIT, 192, 173, 65000):
            if n > 70000 and unit < 1000:
                continue
            data = os.urandom(n)
            stream = M.mux(data, unit)
            found = M.demux(stream)
            assert found.payload == data and found.discontinuities == 0 and len(stream) % 188 == 0
            assert found.units == -(-n // unit) and found.stamps == [k * M.TICKS for k in range(found.units)]
            assert len(found.random_access) == -(-found.units // M.GROUP)


def test_padding():
    assert M.payload_of(None) == (b" " * 192, 0) == M.payload_of("")
    assert M.payload_of("a" * 192) == (b"a" * 192, 192)
    assert len(M.payload_of("é" * 97)[0]) == 384


def test_damage():
    stream = bytearray(M.mux(b"x" * 5000))
    lost = M.demux(bytes(stream[: 188 * 5] + stream[188 * 6 :]))
    assert lost.discontinuities == 1 and lost.payload != b"x" * 5000
    for at, value in ((188 * 3, 0), (10, 99), (188 + 20, 1)):
        bad = bytearray(stream)
        bad[at] = value
        with pytest.raises(ValueError):
            M.demux(bytes(bad))
    with pytest.raises(ValueError):
        M.demux(b"abc")


def test_tables(spark):
    rows = spark.createDataFrame([(1, "abc", 9), (1, "abc", 8), (None, None, 7), (4, "é" * 40000, 6)], "doc_id long, text string, media int")
    got = sorted((tuple(r) for r in M.read_media(M.to_media(rows)).collect()), key=str)
    assert len(got) == 4 and got[0][:3] == (1, 3, 192) and got[0] == got[1]
    by = {r[0]: r for r in got}
    payload = b"abc" + b" " * 189
    assert by[1][3:5] == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert by[1][5] == len(M.mux(payload)) and by[1][6] == hashlib.sha256(M.mux(payload)).hexdigest()
    assert by[4][1:3] == (80000, 80064) and by[None][1:3] == (0, 192)
    assert M.read_media(M.to_media(rows.limit(0))).count() == 0
