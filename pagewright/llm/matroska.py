"""Media columns: Matroska files as packet tables.

`parse` walks variable-length EBML elements: header, segment, tracks, clusters (blocks with no, Xiph, fixed-size or
EBML lacing) and cues; it gives a table of packets with track, timestamp and byte range. `mux` builds such files from
packets; `mux_texts` stores a payload as 8-bit PCM samples, 576 to a packet.

Defined results: a null or empty text is one packet of 255s; equal texts give equal files; elements of unknown size end
where an element of a higher level begins; unknown elements are skipped; `parse` raises `MatroskaError` for whatever is
wrong with a file, and nothing else; in the packet table a null file has no row, and a damaged one has one row with the
reason as its `error` and no packet.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

PACKET = 576
RATE = 8000
#: Packets of a block, and blocks of a cluster; a cluster's timestamps have to fit 16 bits.
LACE, BLOCKS = 8, 16

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, SAMPLING, CHANNELS, BITS = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, VOID = 0x4282, 0xEC
_TOP = {EBML, SEGMENT}
_LEVEL1 = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}


class MatroskaError(ValueError):
    """A file that isn't well formed."""


@dataclass
class Packet:
    track: int
    timestamp: int  # in units of the file's timestamp scale
    offset: int
    size: int
    keyframe: bool
    cluster: int


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float | None = None
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, byte position of the cluster
    clusters: list[int] = field(default_factory=list)  # byte positions


def vint(data: bytes, at: int, marked: bool = False) -> tuple[int | None, int]:
    """A variable-length integer and where it ends; with `marked` the length mark stays (ids). All ones is None."""
    if at >= len(data) or not data[at]:
        raise MatroskaError(f"no length mark at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise MatroskaError("the file ends within an integer")
    value = int.from_bytes(data[at : at + n], "big")
    if marked:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def elements(data: bytes, at: int, end: int, stop: set[int] = frozenset()):
    """(id, begin of element, begin of content, end of content) of what lies between at and end.

    An element of unknown size reaches to `end`; its reader says with send() where it really ended."""
    while at < end:
        begin = at
        name, at = vint(data, at, True)
        if name in stop:
            return
        size, at = vint(data, at)
        to = end if size is None else at + size
        if to > end:
            raise MatroskaError(f"element {name:X} at byte {begin} goes beyond its parent")
        ended = yield name, begin, at, to
        if ended is not None:
            yield  # the answer to send()
        at = to if ended is None else ended


def _unsigned(data: bytes, a: int, b: int) -> int:
    if b - a > 8:
        raise MatroskaError(f"an integer of {b - a} bytes")
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise MatroskaError(f"a float of {b - a} bytes")
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames. kind: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if not kind:
        return [(at, end)]
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == 2:
        if (end - at) % n:
            raise MatroskaError("fixed-size lacing with a remainder")
        sizes = [(end - at) // n] * (n - 1)
    elif kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for i in range(n - 1):
            begin = at
            value, at = vint(data, at)
            if value is None:
                raise MatroskaError("a lace of unknown size")
            # later sizes are differences, shifted to be unsigned
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * (at - begin) - 1) - 1))
    out = []
    for s in sizes:
        out.append((at, at + s))
        at += s
    if at > end or any(s < 0 for s in sizes):
        raise MatroskaError("laces longer than their block")
    return [*out, (at, end)]


def _block(data: bytes, at: int, end: int, base: int, cluster: int, media: Media, simple: bool, key: bool = True, duration: int | None = None) -> None:
    track, at = vint(data, at)
    if at + 3 > end:
        raise MatroskaError("a block without header")
    when, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    ranges = laces(data, at + 3, end, flags >> 1 & 3)
    step = duration // len(ranges) if duration is not None else media.tracks.get(track, {}).get("frame", 0)
    for i, (a, b) in enumerate(ranges):
        media.packets.append(Packet(track, base + when + i * step, a, b - a, bool(flags & 128) if simple else key, cluster))


def _cluster(data: bytes, begin: int, at: int, end: int, media: Media) -> int:
    """Reads a cluster; where it ended."""
    media.clusters.append(begin)
    base = 0
    for name, first, a, b in elements(data, at, end, _LEVEL1 | _TOP):
        if name == TIMESTAMP:
            base = _unsigned(data, a, b)
        elif name == SIMPLE_BLOCK:
            _block(data, a, b, base, begin, media, True)
        elif name == BLOCK_GROUP:
            inner = {n: (c, d) for n, _, c, d in elements(data, a, b)}
            if BLOCK in inner:
                _block(data, *inner[BLOCK], base, begin, media, False, REFERENCE not in inner, _unsigned(data, *inner[BLOCK_DURATION]) if BLOCK_DURATION in inner else None)
        at = b
    return at


def _track(data: bytes, at: int, end: int, media: Media) -> None:
    t: dict = {"codec": "", "type": 0, "frame": 0}
    number = 0
    for name, _, a, b in elements(data, at, end):
        if name == TRACK_NUMBER:
            number = _unsigned(data, a, b)
        elif name == TRACK_TYPE:
            t["type"] = _unsigned(data, a, b)
        elif name == CODEC:
            t["codec"] = data[a:b].decode()
        elif name == 0x23E383:  # nanoseconds a frame
            t["frame"] = _unsigned(data, a, b) // media.scale
        elif name == AUDIO:
            for n, _, c, d in elements(data, a, b):
                if n == SAMPLING:
                    t["rate"] = _float(data, c, d)
                elif n in (CHANNELS, BITS):
                    t["channels" if n == CHANNELS else "bits"] = _unsigned(data, c, d)
    media.tracks[number] = t


def parse(data: bytes) -> Media:
    """Everything that the packet table needs, with absolute byte ranges."""
    try:
        return _parse(data)
    except MatroskaError:
        raise
    except (LookupError, ValueError, ArithmeticError, TypeError, RuntimeError, struct.error) as e:  # a place, text or number that can't be
        raise MatroskaError(f"{type(e).__name__}: {e}") from e


def _parse(data: bytes) -> Media:
    media = Media()
    for name, _, at, end in elements(data, 0, len(data)):
        if name == EBML:
            for n, _, a, b in elements(data, at, end):
                if n == DOC_TYPE:
                    media.doc_type = data[a:b].decode()
        elif name == SEGMENT:
            walk, origin = elements(data, at, end, _TOP), at
            for n, begin, a, b in walk:
                if n == INFO:
                    for m, _, c, d in elements(data, a, b):
                        if m == SCALE:
                            media.scale = _unsigned(data, c, d)
                            if not 0 < media.scale < 1 << 40:
                                raise MatroskaError("a timestamp scale that can't be")
                        elif m == DURATION:
                            media.duration = _float(data, c, d)
                elif n == TRACKS:
                    for m, _, c, d in elements(data, a, b):
                        if m == TRACK:
                            _track(data, c, d, media)
                elif n == CLUSTER:
                    ended = _cluster(data, begin, a, b, media)
                    if ended != b:  # a cluster of unknown size
                        walk.send(ended)
                elif n == CUES:
                    for m, _, c, d in elements(data, a, b):
                        if m == CUE_POINT:
                            when, places = 0, []
                            for k, _, e, f in elements(data, c, d):
                                if k == CUE_TIME:
                                    when = _unsigned(data, e, f)
                                elif k == CUE_POSITIONS:
                                    x = {q: _unsigned(data, g, h) for q, _, g, h in elements(data, e, f)}
                                    places.append((x.get(CUE_TRACK, 0), origin + x.get(CUE_CLUSTER, 0)))
                            media.cues += [(when, t, p) for t, p in places]
    return media


# Writing


def _size(n: int, width: int | None = None) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(name: int, content: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _size(len(content)) + content


def _number(name: int, value: int) -> bytes:
    return _element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _lacing(frames: list[bytes], kind: int) -> bytes:
    """The head of a laced block."""
    sizes = [len(f) for f in frames]
    if not kind:
        return b""
    out = bytes([len(frames) - 1])
    if kind == 1:
        out += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == 3 and len(sizes) > 1:
        out += _size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            w = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            out += _size(b - a + (1 << 7 * w - 1) - 1, w)
    return out


def mux(frames: list[bytes], frame_ms: int, rate: int = RATE, lacing: tuple[int, ...] = (2, 3, 1)) -> bytes:
    """A file with one 8-bit PCM track. The kinds of lacing take turns, block by block."""
    head = _element(EBML, _number(0x4286, 1) + _number(0x42F7, 1) + _number(0x42F2, 4) + _number(0x42F3, 8) + _element(DOC_TYPE, b"matroska") + _number(0x4287, 4) + _number(0x4285, 2))
    info = _element(INFO, _number(SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", float(frame_ms * len(frames)))) + _element(0x4D80, b"pagewright") + _element(0x5741, b"pagewright"))
    audio = _element(AUDIO, _element(SAMPLING, struct.pack(">d", float(rate))) + _number(CHANNELS, 1) + _number(BITS, 8))
    tracks = _element(TRACKS, _element(TRACK, _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _element(CODEC, b"A_PCM/INT/LIT") + _number(0x23E383, frame_ms * 1_000_000) + audio))
    body, cues = [info, tracks], []
    at = len(info) + len(tracks)
    for c in range(0, len(frames), LACE * BLOCKS):
        base, blocks = c * frame_ms, []
        for j, i in enumerate(range(c, min(c + LACE * BLOCKS, len(frames)), LACE)):
            group = frames[i : i + LACE]
            kind = lacing[j % len(lacing)] if len(group) > 1 else 0
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", (i - c) * frame_ms) + bytes([0x80 | kind << 1]) + _lacing(group, kind) + b"".join(group)))
        cluster = _element(CLUSTER, _number(TIMESTAMP, base) + b"".join(blocks))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, base) + _element(CUE_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + _element(SEGMENT, b"".join(body) + _element(CUES, b"".join(cues)))


def padded(text: str | None, unit: int = PACKET) -> tuple[bytes, int]:
    """The text's bytes, filled with 255 to a positive multiple of `unit`, and their number before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % unit if data else unit), len(data)


def mux_text(text: str | None) -> tuple[bytes, int]:
    data, n = padded(text)
    return mux([data[i : i + PACKET] for i in range(0, len(data), PACKET)], PACKET * 1000 // RATE), n


def payload(data: bytes, media: Media, track: int = 1) -> bytes:
    """The bytes of a track's packets, in order."""
    return b"".join([data[p.offset : p.offset + p.size] for p in media.packets if p.track == track])


def feature(media: Media, samples: bytes) -> str:
    """Counts, duration, and mean, deviation and sign changes of the samples around their middle."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    turns = int(np.count_nonzero(np.diff(x > 127)))
    total, squares = int(x.sum()), int((x * x).sum())
    mean = total / len(x) if len(x) else 0.0
    spread = max(0.0, squares / len(x) - mean * mean) ** 0.5 if len(x) else 0.0
    step = 1_000_000_000 // media.scale
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};seconds={(media.duration or 0) / step:.3f};mean={mean:.6f};deviation={spread:.6f};turns={turns}"


def mux_texts(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """All columns and a Matroska file of each text, as binary."""
    common.ship(docs.sparkSession)
    docs = docs.drop(out)

    def run(batches):
        common.only("matroska")
        for b in batches:
            column = b.column(b.schema.get_field_index(text))
            for i in range(0, b.num_rows, 100):
                files = [mux_text(t)[0] for t in column.slice(i, 100).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.slice(i, 100).columns, pa.array(files, pa.binary())], [*b.schema.names, out])

    return docs.mapInArrow(run, common.plus(docs, out, "binary"))


PACKETS = "track int, packet int, timestamp_ms double, offset long, size int, keyframe boolean, cluster_offset long, error string"


def packets(files: DataFrame, key: str, media: str = "media") -> DataFrame:
    """The packet table: one row per packet with key, track, number, timestamp and byte range; a damaged file has one row
    with its error."""
    common.ship(files.sparkSession)
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in PACKETS.split(", ")]

    def run(batches):
        common.only("matroska")
        for b in batches:
            for i, data in enumerate(b.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    m = parse(data)
                    for p in m.packets:
                        if p.track is None or p.track >= 1 << 31:
                            raise MatroskaError(f"track {p.track} can't be")
                    step, parts = 10_000, m.packets
                except MatroskaError as e:
                    step, parts = 1, [str(e)]
                for j in range(0, len(parts), step):
                    part = parts[j : j + step]
                    if isinstance(part[0], str):
                        rows = [(None, None, None, None, None, None, None, part[0])]
                    else:
                        rows = [(p.track, j + n, p.timestamp * m.scale / 1e6, p.offset, p.size, p.keyframe, p.cluster, None) for n, p in enumerate(part)]
                    keys = pa.array([b.column(0)[i].as_py()] * len(part), b.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], [key, *names])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, media).mapInArrow(run, f"{key} {kind}, {PACKETS}")


DIGESTS = [("n_bytes", "long", pa.int64()), ("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()), ("media_bytes", "long", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string())]


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text, parse the stored bytes and describe what they hold. One pass, no shuffle, one file at a time."""
    common.ship(docs.sparkSession)

    def one(t):
        data, n = mux_text(t)
        m = parse(data)
        back = payload(data, m)
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(m, back)

    def run(batches):
        common.only("matroska")
        for b in batches:
            rows = list(zip(*(one(t) for t in b.column(1).to_pylist()))) or [[]] * len(DIGESTS)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, d[2]) for c, d in zip(rows, DIGESTS))], [key, *(d[0] for d in DIGESTS)])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{a} {b}" for a, b, _ in DIGESTS))
