"""MPEG transport streams that hold texts without loss, and features of what is read back.

A text becomes UTF-8 bytes, padded by spaces to a positive multiple of 192. These bytes are cut into access units; each is
a PES packet of private data with a time stamp, spread over transport packets of 188 bytes. A program association and a
program map table come first. The first unit of a group carries a clock reference and is marked as a random-access point.
Unused room of a unit's last packet is an adaptation field of stuffing bytes.

Reading parses the tables with their CRC, checks the continuity counters, reassembles the elementary packets and lists time
stamps and random-access points. Nothing of the input but the text enters the stream, so equal texts give equal streams.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import map_batches

PACKET, UNIT, BLOCK = 188, 32_768, 192
PROGRAM, PMT_PID, DATA_PID, STREAM_TYPE, STREAM_ID = 1, 0x1000, 0x101, 0x06, 0xBD
#: 90 kHz ticks between units, and units from one random-access point to the next.
TICKS, GROUP = 3_600, 8


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1) ^ (0x04C11DB7 if value & 0x80000000 else 0)
        out.append(value & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value = ((value << 8) & 0xFFFFFFFF) ^ _CRC[(value >> 24) ^ byte]
    return value


def _section(table_id: int, number: int, body: bytes) -> bytes:
    size = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | size >> 8, size & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _stamp(ticks: int) -> bytes:
    """A presentation time in the five bytes of a PES header."""
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | (t >> 30 & 7) << 1, t >> 22 & 255, 0x01 | (t >> 15 & 127) << 1, t >> 7 & 255, 0x01 | (t & 127) << 1])


def _clock(ticks: int) -> bytes:
    base = ticks & (1 << 33) - 1
    return (base << 15 | 0x7E00).to_bytes(6, "big")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """Padded bytes of a text, null as empty, and its own number of bytes."""
    data = (text or "").encode()
    return data + b" " * (-len(data) % BLOCK or (0 if data else BLOCK)), len(data)


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """A transport stream that holds the payload."""
    if not 0 < unit <= 65_000:
        raise ValueError("an access unit has 1 to 65000 bytes")
    out, counter = [_PAT, _PMT], 0
    for k, at in enumerate(range(0, len(payload), unit)):
        data = payload[at : at + unit]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (8 + len(data)).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(k * TICKS) + data
        field = bytes([0x50]) + _clock(k * TICKS) if k % GROUP == 0 else b""
        room = PACKET - 4 - (1 + len(field) if field else 0)
        first, rest = pes[:room], pes[room:]
        if len(first) < room:  # one packet holds all: stuff it
            spare = room - len(first)
            field = (field or (b"\x00" if spare > 1 else b"")) + b"\xff" * (spare if field else max(0, spare - 2))
        n = 1 + -(-len(rest) // (PACKET - 4))
        grid = np.empty((n, PACKET), np.uint8)
        grid[:, 0] = 0x47
        grid[:, 1] = DATA_PID >> 8
        grid[0, 1] |= 0x40
        grid[:, 2] = DATA_PID & 255
        grid[:, 3] = 0x10 | ((counter + np.arange(n)) & 15)
        counter += n
        head = bytes([len(field)]) + field if field or len(first) < room else b""
        if head:
            grid[0, 3] |= 0x20
        grid[0, 4:] = np.frombuffer(head + first, np.uint8)
        if n > 1:
            whole = len(rest) // (PACKET - 4)
            grid[1 : 1 + whole, 4:] = np.frombuffer(rest, np.uint8, whole * (PACKET - 4)).reshape(whole, PACKET - 4)
            if tail := rest[whole * (PACKET - 4) :]:
                spare = PACKET - 4 - len(tail)  # at least one byte: the length of the field
                grid[n - 1, 3] |= 0x20
                grid[n - 1, 4:] = np.frombuffer((bytes([spare - 1]) + b"\x00" * (spare > 1) + b"\xff" * (spare - 2)) + tail, np.uint8)
        out.append(grid.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes
    packets: int
    units: int
    random_access: list[int]  # packet numbers
    stamps: list[int]
    discontinuities: int
    stream_types: dict[int, int]

    def feature(self) -> str:
        gaps = {b - a for a, b in zip(self.stamps, self.stamps[1:], strict=False)}
        return f"packets={self.packets};units={self.units};rap={','.join(map(str, self.random_access))};pts={self.stamps[0] if self.stamps else ''}-{self.stamps[-1] if self.stamps else ''};step={','.join(map(str, sorted(gaps)))};lost={self.discontinuities};pids={','.join(f'{p:x}:{t:x}' for p, t in sorted(self.stream_types.items()))}"


def _parse_section(packet: np.ndarray, offset: int, table_id: int) -> bytes:
    data = packet[offset:].tobytes()
    start = 1 + data[0]
    size = (data[start + 1] & 15) << 8 | data[start + 2]
    section = data[start : start + 3 + size]
    if section[0] != table_id or crc32_mpeg(section) != 0:
        raise ValueError("a program table is damaged")
    return section


def demux(stream: bytes) -> Stream:
    """Read a transport stream with one program; raises ValueError where sync bytes or tables are damaged."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    grid = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (grid[:, 0] != 0x47).any():
        raise ValueError("lost sync")
    pids = (grid[:, 1].astype(np.int32) & 31) << 8 | grid[:, 2]
    has_field, has_data = (grid[:, 3] & 0x20) != 0, (grid[:, 3] & 0x10) != 0
    offsets = np.where(has_field, 5 + grid[:, 4].astype(np.int32), 4)
    k = int(np.flatnonzero(pids == 0)[0]) if (pids == 0).any() else -1
    if k < 0:
        raise ValueError("no program association table")
    programs = _parse_section(grid[k], int(offsets[k]), 0)[8:-4]
    pmt = int.from_bytes(programs[2:4], "big") & 0x1FFF
    k = int(np.flatnonzero(pids == pmt)[0]) if (pids == pmt).any() else -1
    if k < 0:
        raise ValueError("no program map table")
    body = _parse_section(grid[k], int(offsets[k]), 2)[8:-4]
    at, types = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF), {}
    while at < len(body):
        types[int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF] = body[at]
        at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0xFFF)
    lost, payloads, stamps, access, units = 0, [], [], [], 0
    for pid in types:
        rows = np.flatnonzero(pids == pid)
        counters = grid[rows, 3] & 15
        moves = has_data[rows].astype(np.int32)
        lost += int((((counters[:-1] + moves[1:]) & 15) != counters[1:]).sum())
        marked = has_field[rows] & (grid[rows, 4] > 0) & ((grid[rows, 5] & 0x40) != 0)
        access += rows[marked].tolist()
        rows = rows[has_data[rows]]
        own, start = grid[rows], offsets[rows]
        flat = own[np.arange(PACKET) >= start[:, None]].tobytes()
        ends = np.cumsum(PACKET - start)
        begins = np.flatnonzero(own[:, 1] & 0x40)
        cuts = [*(ends[begins] - (PACKET - start[begins])).tolist(), len(flat)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if flat[a : a + 3] != b"\x00\x00\x01":
                raise ValueError("a PES packet does not begin where a packet says so")
            if flat[a + 7] & 0x80:
                s = flat[a + 9 : a + 14]
                stamps.append((s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1)
            size = int.from_bytes(flat[a + 4 : a + 6], "big")
            payloads.append(flat[a + 9 + flat[a + 8] : a + 6 + size if size else b])
            units += 1
    return Stream(b"".join(payloads), len(grid), units, access, stamps, lost, types)


def to_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key long, n_bytes long, media binary): the stream of every row. Null text counts as empty; repeated rows stay."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, media = [], []
            for x in batch.column(1).to_pylist():
                payload, n = payload_of(x)
                sizes.append(n)
                media.append(mux(payload))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

        return apply

    return map_batches(df.selectExpr(f"cast(`{key}` as long) id", f"`{text}` t"), "id long, n_bytes long, media binary", make).withColumnRenamed("id", key)


def read_media(df: DataFrame, key: str = "doc_id", media: str = "media", size: str = "n_bytes") -> DataFrame:
    """Digests of the payload read back from a column of streams, and features of the streams."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], [], []]
            for x in batch.column(2).to_pylist():
                stream = demux(x)
                row = (len(stream.payload), hashlib.sha256(stream.payload).hexdigest(), zlib.crc32(stream.payload[-16:]), len(x), hashlib.sha256(x).hexdigest(), stream.feature())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], ["id", "n_bytes", *names])

        return apply

    ddl = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(df.selectExpr(f"cast(`{key}` as long) id", f"`{size}` n_bytes", f"`{media}` m"), ddl, make).withColumnRenamed("id", key)
