"""Media columns: AVI motion-JPEG written, indexed, decoded and parted into shots."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from photolake.llm.common import raw, slices, texts
from photolake.session import table

#: A frame has 24 x 24 cells; a cell is one 8 x 8 block of one grey value, so its quantised DC holds a byte exactly.
SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
BINS = 32
ZIGZAG = np.array([y * 8 + x for s in range(15) for y, x in sorted(((i, s - i) for i in range(8) if 0 <= s - i < 8), reverse=s % 2 == 0)])
#: Huffman code lengths of the DC categories 0 to 8 of the frames written here; the AC table has the end of block alone.
DC_LENGTHS = {3: [3, 4, 5, 6, 7], 4: [0, 1, 2, 8]}


def _codes(lengths: dict[int, list[int]]) -> list[tuple[int, int, int]]:
    """Canonical ``(symbol, code, length)``."""
    out, code, before = [], 0, 0
    for n in sorted(lengths):
        code <<= n - before
        before = n
        for s in lengths[n]:
            out.append((s, code, n))
            code += 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, lengths: dict[int, list[int]]) -> bytes:
    return bytes([kind]) + bytes(len(lengths.get(n, ())) for n in range(1, 17)) + bytes(s for n in sorted(lengths) for s in lengths[n])


HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0, 8] + [1] * 63))
    + _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * SIDE, 8 * SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, _table(0x00, DC_LENGTHS) + _table(0x10, {1: [0]}))
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)


def _symbol_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference from -255 to 255, the end of block included."""
    value, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    code = {s: (c, n) for s, c, n in _codes(DC_LENGTHS)}
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        c, n = code[cat]
        value[d + 255] = (c << cat | (d if d >= 0 else d + (1 << cat) - 1)) << 1
        length[d + 255] = n + cat + 1
    return value, length


_VALUE, _LENGTH = _symbol_tables()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG images of the rows of ``samples`` (frames by 576 bytes)."""
    diff = np.diff(samples.astype(np.int16), axis=1, prepend=np.int16(128)) + np.int16(255)
    length = _LENGTH[diff]
    ends = np.cumsum(length, axis=1)
    bits = ends[:, -1]
    words = (bits + 15) // 16 + 1  # each frame begins at a 16-bit word
    first = np.cumsum(words) - words
    at = (ends - length) + (first * 16)[:, None]
    value = _VALUE[diff] << (32 - (at & 15) - length)
    index = (at >> 4).ravel()
    value = value.ravel()
    n = int(words.sum()) + 1
    out = np.bincount(index, weights=value >> 16, minlength=n) + np.bincount(index + 1, weights=value & 0xFFFF, minlength=n)
    octets = out.astype(">u2").view(np.uint8)
    sizes = (bits + 7) // 8
    last = 2 * first + sizes - 1
    octets[last] |= ((1 << (8 * sizes - bits)) - 1).astype(np.uint8)
    data = octets.tobytes()
    return [HEADER + data[a : a + k].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for a, k in zip((2 * first).tolist(), sizes.tolist())]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(frames: list[bytes]) -> bytes:
    """An AVI file of JPEG frames with its index."""
    most = max(map(len, frames), default=0)
    side = 8 * SIDE
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", side * side, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    chunks = [_chunk(b"00dc", f) for f in frames]
    index, at = [], 4
    for f, c in zip(frames, chunks):
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", b"".join(index)))


def indexed_frames(media: bytes) -> tuple[float, list[bytes]]:
    """Frames a second and the video frames of an AVI file, in the order of its index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index, rate = 12, None, b"", float(FPS)
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            micros = struct.unpack_from("<I", media, at + 20)[0]
            rate = 1e6 / micros if micros else rate
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("an AVI file without frames")
    entries = np.frombuffer(index, dtype=[("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    video = entries[(entries["id"] == b"00dc") | (entries["id"] == b"00db")]
    # offsets count from the list's name, or in some files from the file's start
    base = 0 if len(video) and int(video["at"][0]) > movi else movi
    return rate, [media[base + a + 8 : base + a + 8 + k] for a, k in zip(video["at"].tolist(), video["size"].tolist())]


class Image:
    """What a frame's headers say: its size, first quantiser and Huffman tables."""

    def __init__(self, data: bytes) -> None:
        at, self.tables, self.quant = 2, {}, {}
        while True:
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    counts, lengths, p = body[1:17], {}, 17
                    for n, k in enumerate(counts, 1):
                        lengths[n] = list(body[p : p + k])
                        p += k
                    self.tables[body[0]] = self._lookup(lengths)
                    body = body[p:]
            elif marker in (0xC0, 0xC1):
                bits, self.height, self.width, parts, _, _, self.q = struct.unpack_from(">BHHB3B", body)
                if bits != 8 or parts != 1:
                    raise ValueError("only grey frames of 8 bits are read")
            elif marker == 0xDA:
                self.dc, self.ac = body[2] >> 4, 0x10 | body[2] & 15
                break
        self.header = data[:at]
        self.columns, self.rows = -(-self.width // 8), -(-self.height // 8)

    @staticmethod
    def _lookup(lengths: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
        symbol, size = np.zeros(1 << 16, np.int64), np.full(1 << 16, 16, np.int64)
        for s, c, n in _codes({n: x for n, x in lengths.items() if x}):
            symbol[c << (16 - n) : (c + 1) << (16 - n)] = s
            size[c << (16 - n) : (c + 1) << (16 - n)] = n
        return symbol, size


def coefficients(image: Image, scans: list[bytes]) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Quantised DC of every block of all frames, and the other coefficients of the blocks that have any.

    All frames are decoded side by side, one block of each at a time.
    """
    clean = [s.replace(b"\xff\x00", b"\xff") + bytes(16) for s in scans]
    sizes = np.fromiter(map(len, clean), np.int64, len(clean))
    buffer = b"".join(clean)
    eight = np.ndarray(len(buffer) - 7, dtype=">u8", buffer=buffer, strides=(1,))
    pos, limit = (np.cumsum(sizes) - sizes) * 8, np.cumsum(sizes) * 8 - 64
    dc_symbol, dc_size = image.tables[image.dc]
    ac_symbol, ac_size = image.tables[image.ac]
    n = image.rows * image.columns
    dc = np.zeros((len(scans), n), dtype=np.int32)
    predicted = np.zeros(len(scans), dtype=np.int64)
    others: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def peek(p: np.ndarray) -> np.ndarray:
        return eight[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)

    def extended(v: np.ndarray, cat: np.ndarray) -> np.ndarray:
        bits = ((v >> np.uint64(1)) >> (63 - cat).astype(np.uint64)).astype(np.int64)
        return bits + np.where((cat > 0) & (bits >> np.maximum(cat - 1, 0) == 0), 1 - (1 << cat), 0)

    for b in range(n):
        pos = np.minimum(pos, limit)
        v = peek(pos)
        code = (v >> np.uint64(48)).astype(np.int64)
        size, cat = dc_size[code], dc_symbol[code]
        predicted += extended(v << size.astype(np.uint64), cat)
        dc[:, b] = predicted
        pos = pos + size + cat
        code = ((v << (size + cat).astype(np.uint64)) >> np.uint64(48)).astype(np.int64)
        symbol = ac_symbol[code]
        open_ = np.flatnonzero(symbol)
        if not len(open_):
            pos += ac_size[code]
            continue
        k = np.ones(len(open_), dtype=np.int64)
        pos[symbol == 0] += ac_size[code[symbol == 0]]
        got = []
        while len(open_):
            p = np.minimum(pos[open_], limit[open_])
            v = peek(p)
            code = (v >> np.uint64(48)).astype(np.int64)
            symbol, size = ac_symbol[code], ac_size[code]
            run, cat = symbol >> 4, symbol & 15
            value = extended(v << size.astype(np.uint64), cat)
            pos[open_] = p + size + cat
            k = k + run
            here = (cat > 0) & (k < 64)
            got.append((open_[here], k[here], value[here]))
            k = k + 1
            more = (k < 64) & (symbol != 0)
            open_, k = open_[more], k[more]
        others[b] = tuple(np.concatenate(x) for x in zip(*got))
    return dc, others


def cells(image: Image, scans: list[bytes]) -> np.ndarray:
    """The mean grey value of every 8 x 8 block (frames by blocks), which is all its DC tells."""
    dc, _ = coefficients(image, scans)
    q = int(image.quant[image.q][0])
    return np.clip((dc * q + 4) // 8 + 128, 0, 255).astype(np.uint8)


def pixels(image: Image, scans: list[bytes]) -> np.ndarray:
    """Decoded frames (frames by height by width)."""
    dc, others = coefficients(image, scans)
    f, n = dc.shape
    block = np.zeros((f, n, 64))
    block[:, :, 0] = dc
    for b, (frame, k, value) in others.items():
        block[frame, b, k] = value
    block *= image.quant[image.q]
    flat = np.zeros_like(block)
    flat[:, :, ZIGZAG] = block
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * x[None] * np.pi / 16) * np.where(x == 0, np.sqrt(1 / 8), 0.5)
    out = np.einsum("xu,fnuv,yv->fnxy", basis, flat.reshape(f, n, 8, 8), basis, optimize=True)
    out = np.clip(np.rint(out + 128), 0, 255).astype(np.uint8).reshape(f, image.rows, image.columns, 8, 8)
    return out.transpose(0, 1, 3, 2, 4).reshape(f, image.rows * 8, image.columns * 8)[:, : image.height, : image.width]


def read_cells(media: list[bytes]) -> tuple[list[np.ndarray], list[float]]:
    """Per file its frames' cells (frames by cells) and frames a second; frames with the same headers are decoded together."""
    images: list[Image] = []
    groups: dict[int, list[tuple[int, int, bytes]]] = {}
    out, rates = [], []
    for i, m in enumerate(media):
        rate, frames = indexed_frames(m)
        rates.append(rate)
        out.append([None] * len(frames))
        for j, f in enumerate(frames):
            g = next((g for g, x in enumerate(images) if f.startswith(x.header)), None)
            if g is None:
                g = len(images)
                images.append(Image(f))
            groups.setdefault(g, []).append((i, j, f[len(images[g].header) : f.rfind(b"\xff\xd9")]))
    for g, found in groups.items():
        for (i, j, _), c in zip(found, cells(images[g], [s for _, _, s in found])):
            out[i][j] = c
    return [np.stack(x) if x else np.zeros((0, FRAME), np.uint8) for x in out], rates


def shots(frames: np.ndarray, reach: int = 8, factor: float = 2.5, least: float = 0.12) -> list[tuple[int, int]]:
    """First and last frame of each shot.

    A cut stands where the difference of neighbouring histograms (half the absolute
    sum, as a share of the cells) exceeds ``least`` and the mean of the differences up
    to ``reach`` frames around by ``factor`` of their standard deviations.
    """
    n = len(frames)
    if n < 2:
        return [(0, n - 1)] if n else []
    histogram = np.bincount((np.arange(n)[:, None] * BINS + (frames >> 3)).ravel(), minlength=n * BINS).reshape(n, BINS)
    d = np.abs(np.diff(histogram, axis=0)).sum(axis=1) / (2 * frames.shape[1])
    at = np.arange(len(d))
    a, b = np.maximum(at - reach, 0), np.minimum(at + reach + 1, len(d))
    one, two = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    # the difference itself is not among those around it
    k = np.maximum(b - a - 1, 1)
    mean = (one[b] - one[a] - d) / k
    spread = np.sqrt(np.maximum((two[b] - two[a] - d * d) / k - mean * mean, 0))
    cuts = np.flatnonzero((d >= least) & (d > mean + factor * spread + 1e-12)) + 1
    edges = [0, *cuts.tolist(), n]
    return [(x, y - 1) for x, y in zip(edges[:-1], edges[1:])]


# --- DataFrame operators ----------------------------------------------------------------


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 21):
        data = raw(batch.column("text"))
        padded = [d + b"\xff" * (FRAME - len(d) % FRAME if len(d) % FRAME or not d else 0) for d in data]
        n = [len(p) // FRAME for p in padded]
        frames = encode_frames(np.frombuffer(b"".join(padded), np.uint8).reshape(-1, FRAME))
        media, at = [], 0
        for k in n:
            media.append(avi(frames[at : at + k]))
            at += k
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(d) for d in data], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in slices(batches, "media", 1 << 23):
        media = batch.column("media").to_pylist()
        frames, rates = read_cells(media)
        payloads = [f.tobytes() for f in frames]
        features = [f"frames={len(f)};mean={f.mean():.3f};clips=" + ",".join(f"{a}-{b}@{a / r:.2f}-{(b + 1) / r:.2f}s" for a, b in shots(f)) for f, r in zip(frames, rates)]
        columns = [
            pa.array([len(p) for p in payloads], pa.int64()),
            pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
            pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
            pa.array([len(m) for m in media], pa.int64()),
            pa.array([hashlib.sha256(m).hexdigest() for m in media]),
            pa.array(features),
        ]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=names)


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media", 1 << 23):
        ids = batch.column("doc_id").to_pylist()
        out = []
        for doc_id, frames, rate in zip(ids, *read_cells(batch.column("media").to_pylist())):
            out += [(doc_id, k, a, b, a / rate, (b + 1) / rate) for k, (a, b) in enumerate(shots(frames))]
        kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc_id", "clip", "first_frame", "last_frame", "start_s", "end_s"])


def store(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each whole text as an AVI file of grey JPEG frames.

    The text's UTF-8 bytes (null: none) are filled up with bytes 255 to a positive
    multiple of 576; each byte is the grey value of one cell of a frame.
    """
    rows = texts(docs)
    return rows.mapInArrow(_store, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """``(doc_id, clip, first_frame, last_frame, start_s, end_s)``: the shots of each AVI file in ``media`` (null: none)."""
    rows = media.select("doc_id", "media").where("media IS NOT NULL")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_clips, f"doc_id {kind}, clip int, first_frame long, last_frame long, start_s double, end_s double")


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores each text as ``store`` does, reads the files back and gives digests and shots of each.

    Both steps run on the same small batches in one pass, so no media is kept: the files
    are written to and read from memory. ``feature`` has each shot's first and last frame
    and its seconds. Equal texts give equal values; null and empty texts are one frame of
    255, long ones any number of frames; repeated rows are stored each, and an empty table
    gives an empty result. Other columns are left out, whatever their names.
    """
    rows = texts(docs)
    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(lambda batches: _digest(_store(batches)), kinds)


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed clips (shots) of every document stored as motion-JPEG."""
    return clips(store(table(spark, sf_dir, "documents")))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as motion-JPEG and read back."""
    return round_trip(table(spark, sf_dir, "documents"))
