"""Media columns: ISO base media containers in a binary column.

encode_media writes bytes as a track of raw 8-bit samples; probe_media walks
the nested boxes of any such container, decodes its sample tables and returns
codec, duration and the byte ranges of keyframes without looking at payloads.
Samples of movie fragments are read like those of the movie's own tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, table, text_slices

#: 8-bit samples a second, bytes in a frame, frames in a chunk. The first frame of a chunk is a keyframe.
RATE, FRAME, CHUNK = 8000, 4096, 8
#: A payload's length is a positive multiple of this.
BLOCK = 64
#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"dinf", b"mvex", b"moof", b"traf"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    return struct.pack(">I4s", size, kind) + b"".join(parts)


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes, wide: bool | None = None) -> bytes:
    """A container with one raw track whose samples are payload, in order. wide: 64-bit offsets, by default where 32 bits do not do."""
    n = -(-len(payload) // FRAME)
    last = len(payload) - FRAME * (n - 1)
    chunks = -(-n // CHUNK)
    in_last = n - CHUNK * (chunks - 1)
    runs = ([(n - 1, FRAME)] if n > 1 else []) + [(1, last)]
    if last == FRAME:
        runs = [(n, FRAME)]
    stts = _full(b"stts", struct.pack(">I", len(runs)), *[struct.pack(">II", *r) for r in runs])
    stsz = _full(b"stsz", struct.pack(">II", FRAME, n)) if last == FRAME else _full(b"stsz", struct.pack(">II", 0, n), np.array([FRAME] * (n - 1) + [last], dtype=">u4").tobytes())
    shape = [(1, CHUNK, 1)] if in_last == CHUNK or chunks == 1 else [(1, CHUNK, 1), (chunks, in_last, 1)]
    if chunks == 1:
        shape = [(1, in_last, 1)]
    stsc = _full(b"stsc", struct.pack(">I", len(shape)), *[struct.pack(">III", *s) for s in shape])
    stss = _full(b"stss", struct.pack(">I", chunks), (np.arange(chunks) * CHUNK + 1).astype(">u4").tobytes())
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    stsd = _full(b"stsd", struct.pack(">I", 1), entry)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    wide = len(payload) + 4096 + 20 * n > 0xFFFFFFF0 if wide is None else wide

    def moov(first: int) -> bytes:
        places = first + np.arange(chunks, dtype=np.int64) * (FRAME * CHUNK)
        offsets = _full(b"co64", struct.pack(">I", chunks), places.astype(">u8").tobytes()) if wide else _full(b"stco", struct.pack(">I", chunks), places.astype(">u4").tobytes())
        stbl = _box(b"stbl", stsd, stts, stss, stsc, stsz, offsets)
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, len(payload), 0x55C4, 0), version=1)
        hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"raw\0")
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=3)
        mvhd = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, len(payload)), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    before = len(ftyp) + len(moov(0)) + len(head)
    return b"".join((ftyp, moov(before), head, payload))


#: Deeper boxes are an error: no real file nests as deep.
MAX_DEPTH = 32


def walk(data, lo: int, hi: int) -> Iterator[tuple]:
    """(path, start, end) of the content of each box in data[lo, hi), outer before inner."""
    open_boxes = [((), lo, hi)]
    while open_boxes:
        path, lo, hi = open_boxes.pop()
        if lo + 8 > hi:
            continue
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1:
            if lo + 16 > hi:
                raise ValueError("cut box header")
            size, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
        elif size == 0:
            size = hi - lo
        if size < head or lo + size > hi:
            raise ValueError(f"box {kind!r} at {lo} does not fit")
        here = (*path, kind)
        if len(here) > MAX_DEPTH:
            raise ValueError("boxes nested too deep")
        yield here, lo + head, lo + size
        open_boxes.append((path, lo + size, hi))
        if kind in CONTAINERS:
            open_boxes.append((here, lo + head, lo + size))


def _table(data, lo: int, hi: int, skip: int, n: int, width: int, kind: str = ">u4") -> np.ndarray:
    size = n * width * np.dtype(kind).itemsize
    if lo + skip + size > hi:
        raise ValueError("cut sample table")
    return np.frombuffer(data, dtype=kind, count=n * width, offset=lo + skip).astype(np.int64).reshape(n, width)


def _track_box(t: dict, kind: bytes, data, lo: int, hi: int) -> None:
    """What a box inside of a track says, added to t."""
    if kind == b"tkhd":
        t["id"] = struct.unpack_from(">I", data, lo + (20 if data[lo] == 1 else 12))[0]
    elif kind == b"mdhd":
        wide = data[lo] == 1
        t["timescale"], t["duration"] = struct.unpack_from(">IQ" if wide else ">II", data, lo + (20 if wide else 12))
    elif kind == b"hdlr":
        t["handler"] = bytes(data[lo + 8 : lo + 12]).decode("latin-1")
    elif kind == b"stsd" and struct.unpack_from(">I", data, lo + 4)[0]:
        t["codec"] = bytes(data[lo + 12 : lo + 16]).decode("latin-1").strip()
    elif kind in (b"stts", b"stsc", b"stss", b"stco", b"co64"):
        n = struct.unpack_from(">I", data, lo + 4)[0]
        width, unit = {b"stts": (2, ">u4"), b"stsc": (3, ">u4"), b"co64": (1, ">u8")}.get(kind, (1, ">u4"))
        t[{b"stss": "sync", b"co64": "chunks", b"stco": "chunks"}.get(kind, kind.decode())] = _table(data, lo, hi, 8, n, width, unit)
    elif kind == b"stsz":
        fixed, n = struct.unpack_from(">II", data, lo + 4)
        if fixed and n * fixed > len(data):
            raise ValueError("more samples than bytes")
        t["sizes"] = np.full(n, fixed, np.int64) if fixed else _table(data, lo, hi, 12, n, 1)[:, 0]


    elif kind == b"stz2":  # sizes of 4, 8 or 16 bits
        bits, n = data[lo + 7], struct.unpack_from(">I", data, lo + 8)[0]
        if bits not in (4, 8, 16):
            raise ValueError(f"sample sizes of {bits} bits")
        if bits == 4:
            pairs = _table(data, lo, hi, 12, -(-n // 2), 1, "u1")[:, 0]
            t["sizes"] = np.column_stack([pairs >> 4, pairs & 15]).ravel()[:n]
        else:
            t["sizes"] = _table(data, lo, hi, 12, n, 1, ">u2" if bits == 16 else "u1")[:, 0]


#: Fields that a fragment's boxes may have, in order: (flag, bytes, name).
_TFHD = ((0x1, 8, "base"), (0x2, 4, "description"), (0x8, 4, "duration"), (0x10, 4, "size"), (0x20, 4, "flags"))
_TRUN = ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "composition"))
#: The flag of a sample that is no keyframe.
NO_SYNC = 0x10000


def _run(data, lo: int, hi: int, use: dict, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Offset, size and keyframe mark of the samples of a track run, and how long they last."""
    flags, n = struct.unpack_from(">II", data, lo)
    at, first = lo + 8, None
    if flags & 0x1:
        base += struct.unpack_from(">i", data, at)[0]
        at += 4
    if flags & 0x4:
        first = struct.unpack_from(">I", data, at)[0]
        at += 4
    there = [name for flag, name in _TRUN if flags & flag]
    if not there and n * max(1, use.get("size", 0)) > len(data):
        raise ValueError("more samples than bytes")
    each = _table(data, at, hi, 0, n, len(there)) if there else np.zeros((n, 0), np.int64)
    column = lambda name: each[:, there.index(name)] if name in there else np.full(n, use.get(name, 0), np.int64)
    marks = column("flags").copy()
    if first is not None and n:
        marks[0] = first
    sizes = column("size")
    return base + np.cumsum(sizes) - sizes, sizes, marks & NO_SYNC == 0, int(column("duration").sum())


def tracks(data) -> list[dict]:
    """What the sample tables of each track say: codec, timescale, duration, and
    offset, size and keyframe mark of every sample, those in fragments after
    those of the movie. Payloads are not read. ValueError if a table does not
    hold together or a sample lies outside of the file. Edit lists and
    composition offsets say when samples are shown, not where they lie, and are
    passed by; the duration is the track's own."""
    found: list[dict] = []
    defaults: dict[int, dict] = {}
    more: dict[int, list] = {}
    fragment, use, base, track = 0, {}, 0, 0
    for path, lo, hi in walk(data, 0, len(data)):
        kind = path[-1]
        if kind == b"trak":
            found.append({"sync": None})
        elif b"trak" in path:
            _track_box(found[-1], kind, data, lo, hi)
        elif kind == b"trex":
            track, _, duration, size, flags = struct.unpack_from(">5I", data, lo + 4)
            defaults[track] = {"duration": duration, "size": size, "flags": flags}
        elif kind == b"moof":
            fragment = base = lo - 8
        elif kind == b"tfhd":
            flags, track = struct.unpack_from(">II", data, lo)
            use, at = dict(defaults.get(track, {})), lo + 8
            for flag, width, name in _TFHD:
                if flags & flag:
                    use[name] = struct.unpack_from(">Q" if width == 8 else ">I", data, at)[0]
                    at += width
            base = use.get("base", fragment)
        elif kind == b"trun":
            samples = _run(data, lo, hi, use, base)
            more.setdefault(track, []).append(samples)
            if len(samples[0]):  # a run without an offset goes on where the last one ends
                use["base"] = base = base if struct.unpack_from(">I", data, lo)[0] & 0x1 else int(samples[0][-1] + samples[1][-1])
    for t in found:
        sizes, places = t.get("sizes", np.zeros(0, np.int64)), t.get("chunks", np.zeros((0, 1), np.int64))[:, 0]
        shape = t.get("stsc", np.zeros((0, 3), np.int64))
        if len(sizes) and (not len(places) or not len(shape)):
            raise ValueError("samples without chunks")
        if len(places) and "sizes" not in t:
            raise ValueError("chunks without sample sizes")
        if len(sizes) and ("stts" not in t or t["stts"][:, 0].sum() != len(sizes)):
            raise ValueError("sample times do not add up to the samples")
        if len(shape) and (shape[0, 0] != 1 or shape[:, 0].max() > max(len(places), 1)) and len(sizes):
            raise ValueError("chunk runs outside of the chunks")
        runs = np.diff(np.append(shape[:, 0], len(places) + 1)) if len(shape) and len(sizes) else np.zeros(0, np.int64)
        if (runs < 0).any():
            raise ValueError("chunk runs out of order")
        upto = np.cumsum(np.repeat(shape[: len(runs), 1], runs)[: len(places)])
        if len(sizes) and upto[-1] < len(sizes):
            raise ValueError("fewer places than samples")
        chunk_of = np.searchsorted(upto, np.arange(len(sizes)), side="right")
        ahead = np.cumsum(sizes) - sizes
        first = np.searchsorted(chunk_of, chunk_of)  # of each sample's chunk
        t["offsets"] = places[chunk_of] + ahead - ahead[first] if len(sizes) else np.zeros(0, np.int64)
        keys = np.arange(len(sizes)) if t["sync"] is None else t["sync"][:, 0] - 1
        if len(keys) and (keys.min() < 0 or keys.max() >= len(sizes)):
            raise ValueError("keyframe without a sample")
        mark = np.zeros(len(sizes), bool)
        mark[keys] = True
        for offsets, of, key, lasts in more.get(t.get("id"), ()):
            t["offsets"], sizes, mark = np.append(t["offsets"], offsets), np.append(sizes, of), np.append(mark, key)
            t["duration"] = t.get("duration", 0) + lasts
        t["sizes"], t["keyframes"] = sizes, np.flatnonzero(mark)
        if len(sizes) and (t["offsets"].min() < 0 or sizes.max() > len(data) or (t["offsets"] > len(data) - sizes).any()):
            raise ValueError("sample outside of the file")
    return found


PROBE = T.StructType(
    [
        T.StructField("codec", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("keyframes", T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("size", T.LongType())]))),
        T.StructField("media_error", T.StringType()),
    ]
)


def first_track(data) -> tuple[dict | None, str | None]:
    """The first track of a container, or why there is none."""
    if data is None:
        return None, "null"
    try:
        found = tracks(data)
    except (ValueError, struct.error, IndexError, OverflowError) as e:
        return None, str(e) or type(e).__name__
    return (found[0], None) if found else (None, "no track")


def probe(data, track: tuple | None = None) -> tuple:
    """PROBE's values for the first track of a container."""
    t, error = track or first_track(data)
    if t is None:
        return None, None, None, None, error
    ms = t["duration"] * 1000 // t["timescale"] if t.get("timescale") else None
    keys = t["keyframes"]
    return t.get("codec"), ms, len(t["sizes"]), list(zip(t["offsets"][keys].tolist(), t["sizes"][keys].tolist(), strict=True)), None


def demux(data, t: dict | None = None) -> bytes:
    """The samples of the first track, in order, read from their places."""
    view = memoryview(data)
    t = t or tracks(data)[0]
    ends = t["offsets"] + t["sizes"]
    # neighbours in the file are read in one piece
    cut = np.flatnonzero(t["offsets"][1:] != ends[:-1]) + 1
    lo, hi = np.append(0, cut), np.append(cut, len(ends))
    return b"".join(view[t["offsets"][a] : ends[b - 1]] for a, b in zip(lo, hi, strict=True) if b > a)


def encode_media(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, media_col: str = "media") -> DataFrame:
    """Add n_bytes and a container that holds the text's UTF-8 bytes, zero-padded to a positive multiple of 64.

    Null text counts as empty. Columns of keep (default: all) stay unless a new
    one has their name. No shuffle; a row's size bounds what a task holds.
    """

    def make():
        def compute(texts):
            raw = [t.encode("utf-8", "replace") for t in texts]
            return [[len(r) for r in raw], [mux(pad(r)) for r in raw]]

        return compute

    keep = df.columns if keep is None else keep
    return map_texts(df, text_col, keep, [T.StructField("n_bytes", T.LongType()), T.StructField(media_col, T.BinaryType())], make)


def probe_media(df: DataFrame, media_col: str = "media", digest: bool = False) -> DataFrame:
    """Replace the column of containers by PROBE's columns (and digests of the bytes read back, if asked for).

    Null bytes, bytes that are no container, containers without a track and
    tables that do not hold together (samples outside of the file, forged
    counts, boxes nested too deep) give nulls and a reason in media_error;
    nothing raises. A track without samples has none, no keyframes and an empty
    payload. Columns of df named like new ones are replaced, all others stay.
    Repeated rows give equal values, an empty table an empty one.
    """
    extra = [T.StructField(n, k) for n, k in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))] if digest else []
    fields = [*PROBE.fields, *extra]
    names = {f.name for f in fields}
    keep = [c for c in df.columns if c != media_col and c not in names]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{media_col}`").alias("__media"))
    schema = T.StructType([source.schema[c] for c in keep] + fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in (part for whole in batches for part in text_slices(whole, len(keep))):
            rows = []
            for cell in batch.column(len(keep)):
                data = None if not cell.is_valid else cell.as_buffer()
                track = first_track(data)
                seen = probe(data, track)
                if digest and seen[4] is None:
                    payload = demux(data, track[0])
                    keys = seen[3]
                    ends = [f"{name} {k[0]}+{k[1]}" for name, k in (("first", keys[0]), ("last", keys[-1]))] if keys else []
                    feature = "|".join([f"{seen[0]}|{seen[1]}ms|{seen[2]} samples|{len(keys)} keyframes", *ends])
                    seen += (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature)
                elif digest:
                    seen += (None,) * len(extra)
                rows.append(seen)
            columns = [pa.array(list(c), type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else []
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = encode_media(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return probe_media(media, digest=True).drop("keyframes", "media_error")
