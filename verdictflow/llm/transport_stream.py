"""MPEG transport streams as a media column: multiplexing, parsing and features.

A payload is cut into access units, each one packetized elementary stream (PES) packet with its presentation time stamp; these are
spread over transport packets of 188 bytes. Program tables (PAT, PMT, with their CRC) stand before every random-access point,
whose first packet carries the random-access indicator and a clock reference. The parser trusts nothing of that: it follows the tables to the
elementary streams, checks the continuity counter of each PID, honours adaptation fields and reassembles sections and PES packets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, PAT_PID, NULL_PID = 188, 0x47, 0x0000, 0x1FFF
PRIVATE_PES_TYPE, PRIVATE_STREAM_1 = 0x06, 0xBD
CLOCK = 90_000  # ticks of a time stamp in a second

# This writer's own choices.
PROGRAM, PMT_PID, ES_PID = 1, 0x1000, 0x0100
UNIT = 8192  # bytes of an access unit
RATE = 25  # access units a second
RANDOM_ACCESS = 8  # every so many units can be started at
BLOCK = 64  # payloads are padded to a multiple of this


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The CRC of program tables; 0 over a section that includes a right CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    whole = head + body
    return whole + section_crc(whole).to_bytes(4, "big")


_PAT = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_PES_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def payload(text: str | None) -> bytes:
    """UTF-8 of `text` (null: empty) with zero bytes up to a positive multiple of BLOCK."""
    raw = (text or "").encode("utf-8")
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def mux(data: bytes) -> bytes:
    """A transport stream that carries `data`."""
    out: list[bytes] = []
    counters: Counter = Counter()

    def packet(pid: int, start: bool, body: bytes, field: bytes = b"") -> None:
        """One transport packet; `field` is an adaptation field without its length, grown by stuffing as needed."""
        room = PACKET - 4 - len(body)
        if room:
            field = b"" if room == 1 else (field or b"\x00").ljust(room - 1, b"\xff")
            body = bytes([room - 1]) + field + body
        out.append(bytes([SYNC, start << 6 | pid >> 8, pid & 0xFF, (0x30 if room else 0x10) | counters[pid]]) + body)
        counters[pid] = counters[pid] + 1 & 15

    for k, at in enumerate(range(0, len(data), UNIT)):
        unit, pts, field = data[at : at + UNIT], k * CLOCK // RATE, b""
        if k % RANDOM_ACCESS == 0:
            for pid, table in ((PAT_PID, _PAT), (PMT_PID, _PMT)):
                packet(pid, True, (b"\x00" + table).ljust(PACKET - 4, b"\xff"))
            field = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + unit
        cut = PACKET - 4 - (len(field) + 1 if field else 0)
        packet(ES_PID, True, pes[:cut], field)
        for i in range(cut, len(pes), PACKET - 4):
            packet(ES_PID, False, pes[i : i + PACKET - 4])
    return b"".join(out)


class Stream:
    """What demux() reads: payload, units, errors and tables."""

    def __init__(self):
        self.packets = self.continuity_errors = self.sync_errors = self.table_errors = self.packet_errors = 0
        self.programs: dict[int, int] = {}
        self.streams: dict[int, int] = {}
        self.units: list[tuple[int, int, int, int, bool]] = []  # (pts, first packet, offset in the payload, bytes, random access)
        self.payload = b""


def demux(media: bytes | None) -> Stream:
    """Parse a transport stream; errors are counted, and what is whole is still read: after a lost sync byte from the next packet on that can be told."""
    s, media = Stream(), media or b""
    last: dict[int, int] = {}
    sections: dict[int, bytes] = {}
    open_: dict[int, list] = {}  # PID -> [first packet, random access, parts]
    chunks: list[bytes] = []
    size = 0

    def close(pid: int) -> None:
        nonlocal size
        if pid not in open_:
            return
        first, rap, parts = open_.pop(pid)
        pes = b"".join(parts)
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            s.packet_errors += 1
            return
        length = int.from_bytes(pes[4:6], "big")
        body = pes[9 + pes[8] : 6 + length if length else None]
        if length and len(pes) < 6 + length:
            s.packet_errors += 1
        pts = -1
        if pes[7] & 0x80 and len(pes) >= 14:
            p = pes[9:14]
            pts = (p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1
        s.units.append((pts, first, size, len(body), rap))
        chunks.append(body)
        size += len(body)

    def tables(pid: int, start: bool, body: bytes) -> None:
        if start:
            body = body[1 + body[0] :]
        elif pid not in sections:
            return
        got = sections.pop(pid, b"") + body if not start else body
        while len(got) >= 3 and got[0] != 0xFF:
            n = 3 + (int.from_bytes(got[1:3], "big") & 0x0FFF)
            if len(got) < n:
                sections[pid] = got
                return
            section, got = got[:n], got[n:]
            if n < 12 or section_crc(section):
                s.table_errors += 1
            elif section[0] == 0 and pid == PAT_PID:
                for i in range(8, n - 4, 4):
                    if program := int.from_bytes(section[i : i + 2], "big"):
                        s.programs[program] = int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF
            elif section[0] == 2:
                i = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
                while i + 5 <= n - 4:
                    s.streams[int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF] = section[i]
                    i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0x0FFF)

    at = -PACKET
    while (at := at + PACKET) + PACKET <= len(media):
        if media[at] != SYNC:  # go on where two sync bytes stand a packet apart, or one the last packet's length from the end
            s.sync_errors += 1
            at = media.find(SYNC, at)
            while at >= 0 and at + PACKET < len(media) and media[at + PACKET] != SYNC:
                at = media.find(SYNC, at + 1)
            if at < 0 or at + PACKET > len(media):
                break
        k = s.packets
        s.packets += 1
        a, low, control = media[at + 1], media[at + 2], media[at + 3]
        pid, begin, rap, jump = (a & 0x1F) << 8 | low, at + 4, False, False
        if a & 0x80:  # the sender knows that it is damaged
            s.packet_errors += 1
            continue
        if pid == NULL_PID or not control & 0x10 and not control & 0x20:
            continue
        if control & 0x20:
            n = media[begin]
            if n:
                rap, jump = bool(media[begin + 1] & 0x40), bool(media[begin + 1] & 0x80)
            begin += 1 + n
        if not control & 0x10:
            continue
        counter, before = control & 15, last.get(pid)
        last[pid] = counter
        if before is not None and not jump and counter != before + 1 & 15:
            if counter == before:  # a repeated packet
                continue
            s.continuity_errors += 1
            if pid in open_:
                s.packet_errors += 1
                del open_[pid]
        body = media[begin : at + PACKET]
        if control & 0xC0:  # scrambled, so nothing that this reader can put together
            s.packet_errors += 1
            open_.pop(pid, None)
            continue
        if pid == PAT_PID or pid in s.programs.values():
            if body:
                tables(pid, bool(a & 0x40), body)
        elif pid in s.streams:
            if a & 0x40:
                close(pid)
                open_[pid] = [k, rap, [body]]
            elif pid in open_:
                open_[pid][2].append(body)
    if at < 0 or at != len(media):
        s.sync_errors += 1
    for pid in list(open_):
        close(pid)
    s.payload = b"".join(chunks)
    return s


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's payload as a transport stream.

    A null or empty text is one block of zero bytes. Rows may repeat and ids be null; other columns are not read. No shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len((t or "").encode("utf-8")) for t in texts], pa.int64()), pa.array([mux(payload(t)) for t in texts], pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


COUNTS = ("packets", "programs", "streams", "continuity_errors", "sync_errors", "table_errors", "packet_errors")
_UNIT = pa.struct([("pts", pa.int64()), ("packet", pa.int64()), ("offset", pa.int64()), ("bytes", pa.int64()), ("random_access", pa.bool_())])


def decode(df: DataFrame, media_col: str = "media") -> DataFrame:
    """The columns of `df` and what its streams hold: payload, error counts, and `units` with time stamps and random-access points.

    A null stream is read as an empty one: no packets, no units, an empty payload. Damaged streams give what is whole and the counts
    of their errors. Columns of `df` that have the name of a result give way to it.
    """
    own = ["payload", *COUNTS, "units"]
    kept = [f for f in df.schema if f.name not in own]
    names = [f.name for f in kept]
    plain = [f"c{k}" for k in range(len(names))]  # a batch function takes no names with dots

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                read = [demux(m) for m in part.column(names.index(media_col)).to_pylist()]
                counts = [pa.array([v if isinstance(v := getattr(s, c), int) else len(v) for s in read], pa.int64()) for c in COUNTS]
                units = pa.array([[dict(zip(("pts", "packet", "offset", "bytes", "random_access"), u)) for u in s.units] for s in read], pa.list_(_UNIT))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([s.payload for s in read], pa.binary()), *counts, units], names=[*plain, *own])

    schema = ", ".join([*[f"{p} {f.dataType.simpleString()}" for f, p in zip(kept, plain)], "payload binary", *[f"{c} long" for c in COUNTS], "units array<struct<pts: long, packet: long, offset: long, bytes: long, random_access: boolean>>"])
    return df.select(*[F.col(f"`{n}`").alias(p) for n, p in zip(names, plain)]).mapInArrow(run, schema).toDF(*names, *own)
