"""Media columns: bytes stored as MPEG transport streams, and read back.

``store`` writes a stream of 188-byte packets: a program association and a
program map table, then the payload as elementary packets (PES) of up to
``UNIT`` bytes, each with a presentation timestamp ``STEP`` ticks after the last
one.  Every ``GROUP``-th unit starts at a random-access point, where the tables
are repeated.

``read`` takes such a stream apart: the program tables (with their CRC) give the
elementary PID, continuity counters are checked packet by packet, elementary
packets are put together again, and timestamps are listed with the random-access
points.  A packet sent twice counts once, and a signalled discontinuity is no
error.  Damaged streams yield what is intact plus the counts of errors: a packet
or table whose fields point outside it is left out.

Cases: a null or empty text is stored as 64 zero bytes; equal payloads give equal
streams, so repeated rows and ties do; a very long text is one stream, made and read
in a batch of its own; a null stream reads as no packets; null ids are ids like
others; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.kernels import by_batch

PACKET, SYNC = 188, 0x47
PMT_PID, MEDIA_PID, PROGRAM = 0x1000, 0x0100, 1
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD
UNIT, STEP, GROUP = 8192, 3600, 8
PAD = 64
BATCH = 1 << 20


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    size = len(body) + 9
    head = bytes([table_id, 0xB0 | size >> 8, size & 0xFF, extension >> 8, extension & 0xFF, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


_PAT = _section(0x00, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))
_PMT = _section(0x02, PROGRAM, bytes([0xE0 | MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0xF0, 0, PRIVATE_DATA, 0xE0 | MEDIA_PID >> 8, MEDIA_PID & 0xFF, 0xF0, 0]))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15, 0])
    return (head + section).ljust(PACKET, b"\xff")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _clock(pts: int) -> bytes:
    """A program clock reference with extension 0."""
    return (pts << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    out, counter, tables = [], 0, 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        chunk, pts = payload[at : at + UNIT], unit * STEP & (1 << 33) - 1
        entry = unit % GROUP == 0
        if entry:
            out += [_table_packet(0, _PAT, tables), _table_packet(PMT_PID, _PMT, tables)]
            tables += 1
        size = len(chunk) + 8
        pes = bytes([0, 0, 1, PRIVATE_STREAM, size >> 8, size & 0xFF, 0x84, 0x80, 5]) + _stamp(pts) + chunk
        pos, first = 0, True
        while pos < len(pes):
            extra = b""
            if first and entry:
                extra = bytes([7, 0x50]) + _clock(pts)
            room = 184 - len(extra)
            left = len(pes) - pos
            if left < room:
                gap = room - left
                if extra:
                    extra = bytes([7 + gap]) + extra[1:] + b"\xff" * gap
                else:
                    extra = bytes([gap - 1]) + (b"\x00" + b"\xff" * (gap - 2) if gap > 1 else b"")
                room = left
            out.append(bytes([SYNC, (0x40 if first else 0) | MEDIA_PID >> 8, MEDIA_PID & 0xFF, (0x30 if extra else 0x10) | counter]) + extra + pes[pos : pos + room])
            counter = counter + 1 & 15
            pos, first = pos + room, False
    return b"".join(out)


class Demux:
    """What a transport stream holds: ``payload``, ``stamps`` (time, is a random-access point) and error counts."""

    def __init__(self, stream: bytes):
        self.packets = self.sync_errors = self.counter_errors = self.crc_errors = self.length_errors = 0
        self.programs: dict[int, int] = {}
        self.streams: dict[int, int] = {}
        self.stamps: list[tuple[int, bool]] = []
        self.payload = b""
        units: list[bytes] = []
        last: dict[int, tuple[int, bytes, bool]] = {}  # counter, payload, came twice
        open_: dict[int, list] = {}
        for at in range(0, len(stream) - PACKET + 1, PACKET):
            self.packets += 1
            if stream[at] != SYNC:
                self.sync_errors += 1
                continue
            b1, control = stream[at + 1], stream[at + 3]
            pid, counter, start = (b1 & 0x1F) << 8 | stream[at + 2], control & 15, at + 4
            entry = jump = False
            if control & 0x20:
                size = stream[start]
                if size > PACKET - 5:
                    self.length_errors += 1
                    open_.pop(pid, None)
                    continue
                if size:
                    jump, entry = bool(stream[start + 1] & 0x80), bool(stream[start + 1] & 0x40)
                start += 1 + size
            if not control & 0x10:
                continue
            body = stream[start : at + PACKET]
            if pid in last and not jump:
                before, said, twice = last[pid]
                if counter == before and body == said and not twice:
                    last[pid] = (counter, body, True)
                    continue
                if counter != before + 1 & 15:
                    self.counter_errors += 1
                    open_.pop(pid, None)  # a packet is missing: this elementary packet can't be whole
            last[pid] = (counter, body, False)
            if pid == 0 or pid in self.programs.values():
                if b1 & 0x40:
                    self._table(body)
            elif pid in self.streams:
                if b1 & 0x40:
                    if pid in open_:
                        self._unit(open_.pop(pid), units)
                    open_[pid] = [entry, body]
                elif pid in open_:
                    open_[pid].append(body)
        for parts in open_.values():
            self._unit(parts, units)
        self.sync_errors += len(stream) % PACKET > 0
        self.payload = b"".join(units)

    def _table(self, body: bytes) -> None:
        body = body[1 + body[0] :] if body else body
        size = 3 + ((body[1] & 0x0F) << 8 | body[2]) if len(body) > 2 else 0
        section = body[:size]
        if size < 12 or len(section) < size:
            self.length_errors += 1
        elif crc32_mpeg(section):
            self.crc_errors += 1
        elif section[0] == 0:
            for i in range(8, size - 7, 4):
                self.programs[section[i] << 8 | section[i + 1]] = (section[i + 2] & 0x1F) << 8 | section[i + 3]
        elif section[0] == 2 and size >= 16:
            i = 12 + ((section[10] & 0x0F) << 8 | section[11])
            while i + 5 <= size - 4:
                self.streams[(section[i + 1] & 0x1F) << 8 | section[i + 2]] = section[i]
                i += 5 + ((section[i + 3] & 0x0F) << 8 | section[i + 4])

    def _unit(self, parts: list, units: list[bytes]) -> None:
        pes = b"".join(parts[1:])
        if len(pes) < 9 or pes[:3] != b"\0\0\1" or (pes[4] << 8 | pes[5]) + 6 != len(pes) or 9 + pes[8] > len(pes) or pes[7] & 0x80 and pes[8] < 5:
            self.length_errors += 1
            return
        if pes[7] & 0x80:
            s = pes[9:14]
            self.stamps.append(((s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1, parts[0]))
        units.append(pes[9 + pes[8] :])

    def feature(self) -> str:
        """Counts, time span and random-access points as text."""
        times = [t for t, _ in self.stamps]
        entries = [t for t, entry in self.stamps if entry]
        errors = self.sync_errors + self.counter_errors + self.crc_errors + self.length_errors
        return f"packets={self.packets};units={len(times)};pts={min(times, default=0)}-{max(times, default=0)};entries={','.join(map(str, entries))};errors={errors}"


def _padded(data: bytes) -> bytes:
    return data.ljust(max(PAD, -(-len(data) // PAD) * PAD), b"\0")


def _parts(sizes: list[int]):
    """Ranges of rows with about ``BATCH`` bytes each; a longer one stands alone."""
    lo = total = 0
    for k, size in enumerate(sizes):
        if k > lo and total + size > BATCH:
            yield lo, k
            lo, total = k, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def _store(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        sizes = [x or 0 for x in pc.binary_length(texts).to_pylist()]
        for lo, hi in _parts(sizes):  # streams leave in small batches
            media = [mux(_padded(x or b"")) for x in texts.slice(lo, hi - lo).to_pylist()]
            yield pa.record_batch({"id": batch.column(0).slice(lo, hi - lo), "n_bytes": pa.array(sizes[lo:hi], pa.int64()), "media": pa.array(media, pa.binary())})


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` and ``media``: each text's UTF-8 bytes, zero-padded to 64, as a transport stream."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(own.dtypes)["id"]
    return own.mapInArrow(by_batch(_store), f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def _read(batches):
    for batch in batches:
        rows = []
        for media in batch.column(2):
            media = media.as_py()
            d = Demux(media or b"")
            stamps = [{"pts": t, "random_access": e} for t, e in d.stamps]
            rows.append(
                {
                    "payload_bytes": len(d.payload),
                    "payload_sha256": hashlib.sha256(d.payload).hexdigest(),
                    "tail_crc32": zlib.crc32(d.payload[-64:]),
                    "media_bytes": len(media or b""),
                    "media_sha256": hashlib.sha256(media or b"").hexdigest(),
                    "feature": d.feature(),
                    "stamps": stamps,
                    "counter_errors": d.counter_errors,
                }
            )
        cols = pa.Table.from_pylist(rows, schema=_READ).to_batches()
        for part in cols:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *part.columns], names=["id", "n_bytes", *_READ.names])


_READ = pa.schema(
    [
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()),
        ("feature", pa.string()),
        ("stamps", pa.list_(pa.struct([("pts", pa.int64()), ("random_access", pa.bool_())]))),
        ("counter_errors", pa.int64()),
    ]
)


def read(stored: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Digests, features, timestamps with random-access points and error counts of stored streams."""
    own = stored.select(F.col(id_col).alias("id"), F.col("n_bytes"), F.col(media_col).alias("media"))
    kind = dict(own.dtypes)["id"]
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, stamps array<struct<pts:long,random_access:boolean>>, counter_errors long"
    return own.mapInArrow(by_batch(_read), schema).withColumnRenamed("id", id_col)
