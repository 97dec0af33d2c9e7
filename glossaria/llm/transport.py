"""MPEG transport streams as media columns (operator 5).

``mux`` stores bytes as private-data PES units in 188-byte packets; ``demux``
parses program tables, checks continuity counters, reassembles elementary
packets and lists each unit's timestamp and whether random access is possible.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

PACKET, SYNC, CLOCK = 188, 0x47, 90_000
PMT_PID, MEDIA_PID, STREAM_TYPE, STREAM_ID, PROGRAM = 0x1000, 0x0100, 0x06, 0xBD, 1
#: Payload bytes of a unit (its length field has 16 bits), units between random-access points, ticks a unit.
UNIT, ACCESS_EVERY, TICKS = 32_768, 8, CLOCK // 25

_CRC = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = (_c << 1 ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _CRC.append(_c)


def section_crc(data: bytes) -> int:
    """CRC-32 as program tables have it; 0 over a section with its own checksum."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


_PAT = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(2, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15, 0])
    return (head + section).ljust(PACKET, b"\xff")


def _stamp(mark: int, t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def _unit_packets(unit: bytes, k: int, counter: int) -> np.ndarray:
    """The packets of one unit: the first carries the clock, the last is stuffed."""
    pts = k * TICKS
    pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, pts) + unit
    base = pts & (1 << 33) - 1
    clock = bytes([base >> 25 & 255, base >> 17 & 255, base >> 9 & 255, base >> 1 & 255, (base & 1) << 7 | 0x7E, 0])
    adapt = bytes([7, 0x50 if k % ACCESS_EVERY == 0 else 0x10]) + clock
    room = PACKET - 4 - len(adapt)
    if len(pes) < room:
        adapt = bytes([7 + room - len(pes)]) + adapt[1:] + b"\xff" * (room - len(pes))
        room = len(pes)
    rest = len(pes) - room
    full, tail = divmod(rest, PACKET - 4)
    out = np.empty((1 + full + (tail > 0), PACKET), np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF
    out[:, 3] = 0x10 | (counter + np.arange(len(out))) & 15
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    out[0, 4:] = np.frombuffer(adapt + pes[:room], np.uint8)
    body = np.frombuffer(pes, np.uint8)[room:]
    out[1 : 1 + full, 4:] = body[: full * (PACKET - 4)].reshape(full, PACKET - 4)
    if tail:
        pad = PACKET - 4 - tail
        out[-1, 3] |= 0x20
        out[-1, 4] = pad - 1
        if pad > 1:
            out[-1, 5] = 0
            out[-1, 6 : 4 + pad] = 0xFF
        out[-1, 4 + pad :] = body[full * (PACKET - 4) :]
    return out


def mux(data: bytes) -> bytes:
    """``data`` as one private stream; tables are repeated at random-access points."""
    parts, tables, counter = [], 0, 0
    for k, at in enumerate(range(0, len(data), UNIT)):
        if k % ACCESS_EVERY == 0:
            parts += [_table_packet(0, tables, _PAT), _table_packet(PMT_PID, tables, _PMT)]
            tables += 1
        packets = _unit_packets(data[at : at + UNIT], k, counter)
        counter += len(packets)
        parts.append(packets.tobytes())
    return b"".join(parts)


@dataclass
class Unit:
    pid: int
    pts: int | None
    dts: int | None
    random_access: bool
    packet: int
    data: bytes


@dataclass
class Stream:
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[Unit] = field(default_factory=list)
    n_packets: int = 0
    sync_losses: int = 0
    continuity_errors: int = 0
    table_errors: int = 0

    def payload(self) -> bytes:
        return b"".join(u.data for u in self.units)


def _aligned(data: bytes) -> tuple[np.ndarray, int]:
    """Packets, and how often the sync byte had to be searched for."""
    n = len(data) // PACKET
    rows = np.frombuffer(data, np.uint8, n * PACKET).reshape(n, PACKET)
    if n * PACKET == len(data) and (not n or (rows[:, 0] == SYNC).all()):
        return rows, 0
    found, lost, at = [], 0, 0
    while (at := data.find(SYNC, at)) >= 0 and at + PACKET <= len(data):
        follows = at + PACKET
        if follows == len(data) or data[follows] == SYNC or (found and found[-1] + PACKET == at):
            lost += (found[-1] + PACKET if found else 0) != at
            found.append(at)
            at = follows
        else:
            at += 1
    lost += (found[-1] + PACKET if found else 0) != len(data)
    return np.stack([np.frombuffer(data, np.uint8, PACKET, p) for p in found]) if found else np.empty((0, PACKET), np.uint8), lost


def _start_of_payload(row: np.ndarray) -> int:
    return 4 if not row[3] & 0x20 else min(PACKET, 5 + int(row[4]))


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _read_unit(pid: int, raw: bytes, access: bool, packet: int) -> Unit | None:
    if len(raw) < 9 or raw[:3] != b"\x00\x00\x01":
        return None
    length, flags, head = int.from_bytes(raw[4:6], "big"), raw[7] >> 6, raw[8]
    pts = _read_stamp(raw[9:14]) if flags & 2 and len(raw) >= 14 else None
    dts = _read_stamp(raw[14:19]) if flags == 3 and len(raw) >= 19 else pts
    return Unit(pid, pts, dts, access, packet, raw[9 + head : 6 + length if length else None])


def _followed(own: np.ndarray) -> tuple[int, np.ndarray]:
    """Breaks in the counters of one stream's packets with payload, and which aren't repeats."""
    step = np.diff(own[:, 3].astype(np.int64) & 15) & 15
    again = np.concatenate([[False], (step == 0) & (own[1:] == own[:-1]).all(axis=1)])
    told = (own[:, 3] & 0x20 > 0) & (own[:, 4] > 0) & (own[:, 5] & 0x80 > 0)  # a break that the stream announces
    return int(((step != 1) & ~again[1:] & ~told[1:]).sum()), ~again


def _sections(own: np.ndarray) -> tuple[list[bytes], int]:
    """The whole sections with a right checksum in a table's packets, and how many weren't."""
    out, errors, held = [], 0, None
    for row in own:
        body = row[_start_of_payload(row) :].tobytes()
        if row[1] & 0x40:
            skip = 1 + (body[0] if body else 0)
            parts = [(held or b"") + body[1:skip]] if held is not None else []
            parts.append(body[skip:])
        elif held is not None:
            parts = [held + body]
        else:
            continue
        for k, part in enumerate(parts):
            held = None
            while part and part[0] != 0xFF:
                size = 3 + (int.from_bytes(part[1:3], "big") & 0xFFF) if len(part) >= 3 else 0
                if not size or size > len(part):
                    held = part
                    break
                if size < 12 or section_crc(part[:size]):
                    errors += 1
                else:
                    out.append(part[:size])
                part = part[size:]
            if held is not None and k < len(parts) - 1:  # another begins before its end
                errors += 1
    return out, errors + (held is not None)


def demux(data: bytes) -> Stream:
    """Everything that the stream's packets hold.

    Damage is counted, never raised: bytes between packets (``sync_losses``), a
    counter that doesn't follow its predecessor (``continuity_errors``, of tables, too,
    but for breaks that the stream announces), a table that is cut short or has a wrong
    checksum (``table_errors``, and the table is ignored). Tables may span packets. One
    repeat of a packet is legal and is passed over.
    """
    rows, lost = _aligned(data)
    out = Stream(n_packets=len(rows), sync_losses=lost)
    if not len(rows):
        return out
    pids = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
    tables = [0]
    for pid in tables:
        own = rows[(pids == pid) & (rows[:, 3] & 0x10 > 0)]
        if not len(own):
            continue
        breaks, once = _followed(own)
        out.continuity_errors += breaks
        found, errors = _sections(own[once])
        out.table_errors += errors
        for body in found:
            end = len(body) - 4
            if body[0] == 0 and pid == 0:
                for at in range(8, end, 4):
                    number, where = int.from_bytes(body[at : at + 2], "big"), int.from_bytes(body[at + 2 : at + 4], "big") & 0x1FFF
                    if number and number not in out.programs:
                        out.programs[number] = where
                        if where not in tables:
                            tables.append(where)
            elif body[0] == 2:
                at = 12 + (int.from_bytes(body[10:12], "big") & 0xFFF)
                while at + 5 <= end:
                    out.streams[int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF] = body[at]
                    at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0xFFF)
    for pid in sorted(out.streams):
        where = np.flatnonzero((pids == pid) & (rows[:, 3] & 0x10 > 0))
        if not len(where):
            continue
        own = rows[where]
        breaks, once = _followed(own)
        out.continuity_errors += breaks
        own, where = own[once], where[once]
        starts = np.flatnonzero(own[:, 1] & 0x40)
        for a, b in zip(starts, [*starts[1:], len(own)], strict=True):
            unit = own[a:b]
            plain = unit[1:-1, 3] & 0x20 == 0
            first = unit[0, _start_of_payload(unit[0]) :].tobytes()
            if plain.all():
                middle = unit[1:-1, 4:].tobytes()
            else:
                middle = b"".join(r[_start_of_payload(r) :].tobytes() for r in unit[1:-1])
            last = unit[-1, _start_of_payload(unit[-1]) :].tobytes() if b - a > 1 else b""
            access = bool(unit[0, 3] & 0x20 and unit[0, 4] and unit[0, 5] & 0x40)
            if got := _read_unit(pid, first + middle + last, access, int(where[a])):
                out.units.append(got)
    return out


UNITS = "array<struct<pid: int, pts: bigint, dts: bigint, random_access: boolean, packet: bigint, n_bytes: bigint>>"


def _listed(s: Stream) -> list[dict]:
    return [{"pid": u.pid, "pts": u.pts, "dts": u.dts, "random_access": u.random_access, "packet": u.packet, "n_bytes": len(u.data)} for u in s.units]


def index_streams(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each stream of the binary column ``media_col``, with its units.

    ``units`` has pid, pts, dts, random_access, the first packet's number and the
    size of each elementary packet, in stream order; ``payload`` the bytes joined.
    Null media give a row without units; damage is counted (see :func:`demux`).
    Narrow; columns other than the two named are not read.
    """

    def fn(media):
        got = [demux(m or b"") for m in media]
        return (
            [[{"program": n, "pid": p} for n, p in sorted(s.programs.items())] for s in got],
            [_listed(s) for s in got],
            [s.payload() for s in got],
            *[[getattr(s, k) for s in got] for k in ("n_packets", "sync_losses", "continuity_errors", "table_errors")],
        )

    return map_rows(df, [id_col], [media_col], f"programs array<struct<program: int, pid: int>>, units {UNITS}, payload binary, n_packets long, sync_losses long, continuity_errors long, table_errors long", lambda: fn, rows=32)


def text_streams(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as UTF-8, padded with zero bytes to a positive multiple of 64, as a stream."""

    def fn(texts):
        return ([mux(padded(t)) for t in texts],)

    return map_rows(df, [id_col], [text_col], "media binary", lambda: fn, rows=32)


def padded(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "replace")
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def stream_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each whole text as a stream, reads it back and describes what was read.

    Null counts as empty, whose payload is 64 zero bytes; equal texts give equal
    rows; null and repeated ids pass through; an empty table gives an empty table; texts are
    stored whole, one at a time; other columns are not read, whatever their names.
    ``feature`` has the tables, packets, units, random-access points, first and last
    timestamp and errors found; ``units`` has every unit's timestamps, whether random
    access is possible there, its first packet and its size.
    """

    def one(text):
        n = len((text or "").encode("utf-8", "replace"))
        media = mux(padded(text))
        got = demux(media)
        data = got.payload()
        stamps = [u.pts for u in got.units]
        feature = f"programs={len(got.programs)};streams={len(got.streams)};packets={got.n_packets};units={len(got.units)};access={sum(u.random_access for u in got.units)};pts={min(stamps)}-{max(stamps)};errors={got.sync_losses + got.continuity_errors + got.table_errors}"
        return n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, _listed(got)

    def fn(texts):
        return list(zip(*map(one, texts), strict=True))

    return map_rows(df, [id_col], [text_col], f"n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units {UNITS}", lambda: fn, rows=64)
