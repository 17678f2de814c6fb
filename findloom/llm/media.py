"""ISO media containers: boxes, sample tables, keyframe byte ranges."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
#: 8-bit samples of a media unit, units from one keyframe to the next, units of a chunk.
UNIT, KEYFRAMES, CHUNK, RATE = 64, 16, 8, 8000
CODEC = b"raw "


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def _u32(*values: int) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    """Bytes 0 up to a positive multiple of ``unit``."""
    size = max(unit, -(-len(payload) // unit) * unit)
    return payload.ljust(size, b"\0")


def mux(payload: bytes) -> bytes:
    """A container with one track of unsigned 8-bit samples, in units of 64.

    The sample tables are those of any track: sizes, durations, chunk offsets
    and sync samples. Equal payloads give equal bytes.
    """
    units = len(payload) // UNIT
    if not units or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of the unit")
    ftyp = _box(b"ftyp", b"isom", _u32(512), b"isom", b"iso2", b"mp42")
    chunks, rest = divmod(units, CHUNK)
    runs = ([(1, CHUNK)] if chunks else []) + ([(chunks + 1, rest)] if rest else [])
    offsets = range(0, len(payload), UNIT * CHUNK)
    entry = struct.pack(">I4s6xH8xHHHHI", 36, CODEC, 1, 1, 8, 0, 0, RATE << 16)
    sync = range(1, units + 1, KEYFRAMES)
    wide = len(payload) > 0xF0000000
    matrix = _u32(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

    def moov(base: int) -> bytes:
        place = np.fromiter(offsets, np.int64, len(offsets)) + base
        stbl = _box(
            b"stbl",
            _full(b"stsd", _u32(1), entry),
            _full(b"stts", _u32(1, units, UNIT)),
            _full(b"stsc", _u32(len(runs)), *(_u32(at, n, 1) for at, n in runs)),
            _full(b"stsz", _u32(UNIT, units)),
            _full(b"co64" if wide else b"stco", _u32(len(place)), place.astype(">i8" if wide else ">u4").tobytes()),
            _full(b"stss", _u32(len(sync)), np.fromiter(sync, ">u4", len(sync)).tobytes()),
        )
        length = units * UNIT
        minf = _box(b"minf", _full(b"smhd", _u32(0)), _box(b"dinf", _full(b"dref", _u32(1), _full(b"url ", flags=1))), stbl)
        head = struct.pack(">IIIIHH", 0, 0, RATE, min(length, 0xFFFFFFFF), 0x55C4, 0)
        mdia = _box(b"mdia", _full(b"mdhd", head), _full(b"hdlr", _u32(0), b"soun", bytes(12), b"sound\0"), minf)
        tkhd = _full(b"tkhd", _u32(0, 0, 1, 0, min(length, 0xFFFFFFFF), 0, 0), _u32(0, 0x01000000), matrix, _u32(0, 0), flags=3)
        mvhd = _full(b"mvhd", _u32(0, 0, RATE, min(length, 0xFFFFFFFF), 0x10000, 0x01000000, 0, 0), matrix, bytes(24), _u32(2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    base = len(ftyp) + len(moov(0)) + len(head)
    return b"".join((ftyp, moov(base), head, payload))


def boxes(data: bytes, lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the contents of each box in a range."""
    while lo < hi:
        if lo + 8 > hi:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1:
            if lo + 16 > hi:
                raise ValueError("a box header is cut off")
            size, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
        elif size == 0:
            size = hi - lo
        if size < head or lo + size > hi:
            raise ValueError("a box reaches out of its parent")
        yield kind, lo + head, lo + size
        lo += size


def walk(data: bytes, lo: int, hi: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """All boxes below a range with their paths; the n-th ``trak`` is told apart by its start."""
    for kind, a, b in boxes(data, lo, hi):
        yield (*path, kind), a, b
        if kind in CONTAINERS:
            yield from walk(data, a, b, (*path, kind))


def _table(data: bytes, at: int, end: int, columns: int, kind: str = ">u4") -> np.ndarray:
    n = struct.unpack_from(">I", data, at + 4)[0]
    width = np.dtype(kind).itemsize * columns
    if at + 8 + n * width > end:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, kind, n * columns, at + 8).reshape(n, columns).astype(np.int64)


def _track(data: bytes, lo: int, hi: int) -> dict:
    found = {path[-1]: (a, b) for path, a, b in walk(data, lo, hi)}
    for kind in (b"mdhd", b"stsd", b"stts", b"stsc"):
        if kind not in found:
            raise ValueError(f"no {kind.decode()} box")
    a, _ = found[b"mdhd"]
    long = data[a] == 1
    scale, duration = struct.unpack_from(">IQ" if long else ">II", data, a + (20 if long else 12))
    codec = data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16]
    if b"stsz" in found:
        a, b = found[b"stsz"]
        one, n = struct.unpack_from(">II", data, a + 4)
        if not one and a + 12 + 4 * n > b:
            raise ValueError("a sample table is cut off")
        sizes = np.full(n, one, np.int64) if one else np.frombuffer(data, ">u4", n, a + 12).astype(np.int64)
    elif b"stz2" in found:
        a, _ = found[b"stz2"]
        bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
        raw = np.frombuffer(data, ">u2" if bits == 16 else "u1", n if bits >= 8 else -(-n // 2), a + 12).astype(np.int64)
        sizes = raw if bits >= 8 else np.stack((raw >> 4, raw & 15), axis=1).ravel()[:n]
    else:
        raise ValueError("no stsz box")
    if b"co64" in found:
        place = _table(data, *found[b"co64"], 1, ">i8").ravel()
    else:
        place = _table(data, *found[b"stco"], 1).ravel() if b"stco" in found else np.zeros(0, np.int64)
    runs = _table(data, *found[b"stsc"], 3)
    last = np.append(runs[1:, 0], len(place) + 1) if len(runs) else np.zeros(0, np.int64)
    of_chunk = np.repeat(runs[:, 1], last - runs[:, 0]) if len(runs) else np.zeros(0, np.int64)
    if int(of_chunk.sum()) != len(sizes) or len(of_chunk) != len(place):
        raise ValueError("the sample tables disagree")
    first = np.cumsum(of_chunk) - of_chunk
    before = np.cumsum(sizes) - sizes
    offsets = np.repeat(place, of_chunk) + before - np.repeat(before[first] if len(first) else first, of_chunk)
    sync = _table(data, *found[b"stss"], 1).ravel() - 1 if b"stss" in found else np.arange(len(sizes))
    if len(sizes) and (offsets + sizes).max() > len(data):
        raise ValueError("a sample reaches out of the file")
    return {"codec": codec.decode("latin-1"), "timescale": scale, "duration": duration, "sizes": sizes, "offsets": offsets, "sync": sync}


def demux(data: bytes) -> list[dict]:
    """The tracks of a container, from its boxes alone; no payload is decoded."""
    tracks = []
    for kind, a, b in boxes(data, 0, len(data)):
        if kind == b"moov":
            tracks += [_track(data, x, y) for inner, x, y in boxes(data, a, b) if inner == b"trak"]
    return tracks


def samples(data: bytes, track: dict) -> bytes:
    """The track's samples in order. Neighbouring ones are read as one range."""
    at, size = track["offsets"], track["sizes"]
    if not len(at):
        return b""
    turn = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + size[:-1])))
    stop = np.append(turn[1:], len(at)) - 1
    return b"".join(data[a:b] for a, b in zip(at[turn].tolist(), (at + size)[stop].tolist(), strict=True))


def with_containers(rows: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """Rows (id, n_bytes, media): each payload, null being empty, padded and stored in a container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [p or b"" for p in b.column(1).to_pylist()]
            for lo in range(0, len(data), 512):
                part = data[lo : lo + 512]
                media = pa.array([mux(pad(p)) for p in part], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(part)), pa.array([len(p) for p in part], pa.int64()), media], ["id", "n_bytes", "media"])

    return rows.select(F.col(id_col).alias("id"), F.col(payload_col).alias("p")).mapInArrow(run, f"id {rows.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


_COLUMNS = "codec string, timescale long, duration long, n_samples long, keyframes array<struct<offset:long,length:long>>, error string"
_RANGES = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))


def media_columns(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """``rows`` without the media but with the columns of its first track: codec,
    timescale, duration, n_samples, keyframes (byte ranges) and error.

    A null, empty or broken container has nulls and the reason in ``error``.
    """
    kept = [c for c in rows.columns if c != media_col]
    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in b.column(len(kept)).to_pylist():
                try:
                    t = demux(data or b"")[0]
                except (ValueError, IndexError, struct.error) as why:
                    out.append((None, None, None, None, None, str(why) or "no track"))
                    continue
                ranges = [{"offset": int(t["offsets"][k]), "length": int(t["sizes"][k])} for k in t["sync"]]
                out.append((t["codec"], t["timescale"], t["duration"], len(t["sizes"]), ranges, None))
            cols = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), _RANGES, pa.string()]
            names = [f.split()[0] for f in _COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(kept))), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [*kept, *names])

    return rows.select(*kept, media_col).mapInArrow(run, ", ".join([*fields, _COLUMNS]))


_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, timescale long, duration long, n_samples long, keyframes array<struct<offset:long,length:long>>"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            out = []
            for data in b.column(2).slice(lo, 256).to_pylist():
                t = demux(data)[0]
                payload = samples(data, t)
                at, size = t["offsets"][t["sync"]], t["sizes"][t["sync"]]
                feature = f"{t['codec'].strip()};{t['timescale']};{t['duration']};{len(t['sizes'])};{len(t['sync'])};{zlib.crc32(payload[at[0] - t['offsets'][0] :][: int(size[0])]) if len(at) else 0:08x}"
                ranges = [{"offset": o, "length": n} for o, n in zip(at.tolist(), size.tolist(), strict=True)]
                out.append(
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature)
                    + (t["codec"].strip(), t["timescale"], t["duration"], len(t["sizes"]), ranges)
                )
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), _RANGES]
            names = [f.split()[0] for f in _DIGESTS.split(", ")]
            cols = list(zip(*out, strict=True)) or [()] * len(types)
            own = [b.column(k).slice(lo, len(out)) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text in a container of a written table, read it back, and report.

    Rows (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, codec, timescale, duration, n_samples,
    keyframes), one for each input row; what follows ``feature`` is read from
    the boxes alone, keyframes being byte ranges of the container. Null and
    empty texts are 64 bytes 0. ``feature`` joins codec, timescale, duration,
    samples, keyframes and the checksum of the first keyframe. Rows that repeat
    a text have equal values; a null doc_id stays null.
    """
    stored = materialize(with_containers(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("p")), "id", "p"), "media")
    return stored.mapInArrow(_digests, _DIGESTS)
