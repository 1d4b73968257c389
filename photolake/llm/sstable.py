"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending order of their key::

    data blocks | index block | Bloom filter | footer (64 bytes)

A data block is a zstd frame of entries, each ``shared, unshared, value length`` as
varints, the key's own bytes and the value; every 16th entry (a restart) stores its key
whole, and the restarts' offsets end the block, so a key is found by binary search. The
index has the last key, offset and length of each block. Values are little-endian ids
of 2 bytes, or 4 for vocabularies over 65,536.
"""

from __future__ import annotations

import bisect
import io
import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photolake.llm.common import WordHash, raw, slices, texts
from photolake.session import shared_dir, stored, table

MAGIC = b"PLSST001"
FOOTER = struct.Struct("<QQQQQQII8s")
RESTART, BLOCK_BYTES, SHARD_BYTES = 16, 1 << 16, 1 << 24
BITS_PER_KEY, HASHES = 10, 7


def sort_key(doc_id: int | None) -> bytes:
    """Nine bytes in the order of ids, null last."""
    return b"\xff" * 9 if doc_id is None else b"\0" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def doc_id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\xff" else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _bloom_bits(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return ((h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).ravel()


class ShardWriter:
    """Collects entries in key order and lays out one shard."""

    def __init__(self, width: int) -> None:
        self.out, self.index, self.keys = io.BytesIO(), [], []
        self.width, self.ids = width, 0
        self.packer = zstandard.ZstdCompressor(level=3)
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.restarts, self.n, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.n, self.last = self.n + 1, key
        self.keys.append(key)
        self.ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self.close_block()

    def close_block(self) -> None:
        if self.n:
            data = self.packer.compress(bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts)))
            self.index.append((self.last, self.out.tell(), len(data)))
            self.out.write(data)
            self._new_block()

    def finish(self) -> bytes:
        self.close_block()
        index_at = self.out.tell()
        for key, at, n in self.index:
            self.out.write(struct.pack("<HQI", len(key), at, n) + key)
        bloom_at = self.out.tell()
        bits = np.zeros(max(64, -(-len(self.keys) * BITS_PER_KEY // 8) * 8), dtype=np.uint8)
        if self.keys:
            # the filter holds ids without the number that tells repeats apart
            bits[_bloom_bits([k[:9] for k in self.keys], len(bits))] = 1
        self.out.write(np.packbits(bits).tobytes())
        self.out.write(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, len(bits), len(self.keys), self.ids, self.width, len(self.index), MAGIC))
        return self.out.getvalue()


class ShardReader:
    """Reads a shard from a seekable file; only the parts that a call needs."""

    def __init__(self, file) -> None:
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        self.index_at, self.index_bytes, self.bloom_at, self.bits, self.n, self.ids, self.width, n_blocks, magic = FOOTER.unpack(self._at(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        data, self.index, at = self._at(self.index_at, self.index_bytes), [], 0
        for _ in range(n_blocks):
            k, offset, length = struct.unpack_from("<HQI", data, at)
            at += 14
            self.index.append((data[at : at + k], offset, length))
            at += k
        self.lasts, self._filter = [k for k, _, _ in self.index], None

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def may_hold(self, key: bytes) -> bool:
        return bool(self.may_hold_each([key])[0])

    def may_hold_each(self, keys: list[bytes]) -> np.ndarray:
        """For each key whether the shard can hold it, by its last key and the Bloom filter, which is read once."""
        if not self.lasts or not keys:
            return np.zeros(len(keys), dtype=bool)
        if self._filter is None:
            self._filter = np.unpackbits(np.frombuffer(self._at(self.bloom_at, self.bits // 8), np.uint8))
        heads = [k[:9] for k in keys]
        maybe = self._filter[_bloom_bits(heads, self.bits)].reshape(len(keys), HASHES).all(axis=1)
        return maybe & np.fromiter((h <= self.lasts[-1][:9] for h in heads), bool, len(heads))

    def block(self, i: int) -> tuple[bytes, list[int]]:
        data = zstandard.ZstdDecompressor().decompress(self._at(*self.index[i][1:]))
        n = struct.unpack_from("<I", data, len(data) - 4)[0]
        return data[: len(data) - 4 * (n + 1)], list(struct.unpack_from(f"<{n}I", data, len(data) - 4 * (n + 1)))

    def entries(self, data: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            yield key, data[at + rest : at + rest + n]
            at += rest + n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            for key, value in self.entries(self.block(i)[0]):
                yield key, np.frombuffer(value, f"<u{self.width}")

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry of ``doc_id``: Bloom filter, then binary search of index and restarts."""
        want, found = sort_key(doc_id), []
        if not self.may_hold(want):
            return found
        for i in range(bisect.bisect_left(self.lasts, want), len(self.index)):
            data, restarts = self.block(i)
            at = bisect.bisect_left([next(self.entries(data, r))[0] for r in restarts], want)
            for key, value in self.entries(data, restarts[max(0, at - 1)]):
                if key[:9] > want:
                    return found
                if key[:9] == want:
                    found.append(np.frombuffer(value, f"<u{self.width}"))
        return found


# --- tokens -----------------------------------------------------------------------------

#: UTF-8 of the white space that has more than one byte, as the tokenizer's pattern knows it.
_WIDE_SPACE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE_START = sorted({w if len(w) == 2 else w[:2] for w in _WIDE_SPACE})
_HEAD = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


class PieceEncoder:
    """Byte-level BPE of whole texts by the ids of their pieces.

    The tokenizer's own pattern always splits where a space follows what is no white
    space, so a piece (from such a space to the next) has the same ids in any text.
    Pieces met before come from a table of at most about ``most`` of them, by a 64-bit
    hash and their first eight bytes; both are worked out for all pieces at once.
    """

    def __init__(self, path: str, most: int = 500_000) -> None:
        # threads of their own would each keep memory beside the task's
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.most, self.bits = most, max(4, math.ceil(math.log2(2 * most)) + 1)
        self.hash = WordHash()
        self.n = 0
        self.flat = np.zeros(1 << 16, dtype=f"<u{self.width}")
        self.ends = np.zeros(1 << 14, dtype=np.int64)
        self.hashes, self.heads = (np.zeros(1 << 14, dtype=np.uint64) for _ in range(2))
        self._rebuild(0)

    def _rebuild(self, keep: int) -> None:
        """Forgets all but the first pieces, which are the most common."""
        self.n = keep
        self.slots, self.entries = np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits, dtype=np.int32)
        self._insert(self.hashes[:keep], np.arange(keep))

    def _insert(self, h: np.ndarray, entry: np.ndarray) -> None:
        """Puts entries under distinct hashes; one that is there already is replaced."""
        slot, wait, mask = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h)), (1 << self.bits) - 1
        while len(wait):
            at = slot[wait]
            found = self.slots[at]
            free = (found == 0) | (found == h[wait])
            self.slots[at[free]] = h[wait[free]]
            done = free & (self.slots[at] == h[wait])
            self.entries[at[done]] = entry[wait[done]]
            wait = wait[~done]
            slot[wait] = (slot[wait] + 1) & mask

    def _find(self, h: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Entries by hash and first bytes, -1 where there is none."""
        slot, wait, mask = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h)), (1 << self.bits) - 1
        out = np.full(len(h), -1, dtype=np.int64)
        while len(wait):
            at = slot[wait]
            found = self.slots[at]
            hit = found == h[wait]
            out[wait[hit]] = self.entries[at[hit]]
            on = ~hit & (found != 0)
            wait = wait[on]
            slot[wait] = (at[on] + 1) & mask
        hit = np.flatnonzero(out >= 0)
        out[hit[self.heads[out[hit]] != head[hit]]] = -1
        return out

    def _encode(self, pieces: list[bytes], simple: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has; ``simple`` ones have one space, in front."""
        # simple pieces are encoded as one text: each begins with the only id that has a space
        rows = [b"".join(pieces[i : i + 256]).decode() for i in range(0, len(pieces), 256)] if simple else [p.decode() for p in pieces]
        lists = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]
        ids = np.concatenate(lists)
        return ids, np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids))) if simple else np.fromiter(map(len, lists), np.int64)

    def _learn(self, pieces: list[bytes], simple: bool, h: np.ndarray, head: np.ndarray) -> None:
        ids, sizes = self._encode(pieces, simple)
        n, used = self.n, int(self.ends[self.n - 1]) if self.n else 0
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(pieces) > len(self.ends):
            self.ends, self.hashes, self.heads = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ends, self.hashes, self.heads))
        new = slice(n, n + len(pieces))
        self.flat[used : used + len(ids)] = ids
        self.ends[new], self.hashes[new], self.heads[new] = used + np.cumsum(sizes), h, head
        self.n += len(pieces)
        self._insert(h, np.arange(n, self.n))

    def __call__(self, documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all UTF-8 texts, and where each begins (one more at the end)."""
        text = b"".join(documents)
        lengths = np.fromiter(map(len, documents), np.int64, len(documents))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        if not text:
            return np.zeros(0, self.flat.dtype), starts
        if self.n > self.most:
            self._rebuild(self.most // 3)
        octets = np.frombuffer(text, np.uint8)
        space = octets == 32
        white = space | ((octets >= 9) & (octets <= 13))
        for wide in _WIDE_SPACE if any(w in text for w in _WIDE_START) else ():
            at = text.find(wide)
            while at >= 0:
                white[at + len(wide) - 1] = True
                at = text.find(wide, at + len(wide))
        space[1:] &= ~white[:-1]
        space[starts[:-1][lengths > 0]] = True
        first = np.flatnonzero(space)
        last = np.append(first[1:], len(octets))
        h = np.maximum(self.hash(octets, first, last), np.uint64(1))
        eight = np.ndarray(len(text), dtype="<u8", buffer=text + bytes(8), strides=(1,))
        head = eight[first] & _HEAD[np.minimum(last - first, 8)]
        at = self._find(h, head)
        while len(missing := np.flatnonzero(at < 0)):
            where = missing[np.sort(np.unique(h[missing], return_index=True)[1])]
            spaces = np.concatenate([[0], np.cumsum(octets == 32)])
            simple = (octets[first[where]] == 32) & (spaces[last[where]] - spaces[first[where]] == 1)
            for kind in (True, False):
                if len(mine := where[simple == kind]):
                    self._learn([text[a:b] for a, b in zip(first[mine].tolist(), last[mine].tolist())], kind, h[mine], head[mine])
            at[missing] = self._find(h[missing], head[missing])
        begins = np.where(at > 0, self.ends[at - 1], 0)
        sizes = self.ends[at] - begins
        place = np.cumsum(sizes) - sizes
        ids = self.flat[np.arange(int(sizes.sum())) + np.repeat(begins - place, sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return ids, upto[np.searchsorted(first, starts)]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder_for(path: str) -> PieceEncoder:
    """The encoder of this worker process, which keeps its table from one task to the next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path that all executors share."""
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (pa.fs.LocalFileSystem(), uri) if uri.startswith("/") else pa.fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the ids of every whole text of ``docs`` to shards in ``folder``; the manifest, one row for each.

    Shards follow each other in ascending ``doc_id``, null last; rows of the same id
    stand together in the order of their texts' hash. Null texts are empty and have the
    end id alone. A task closes a shard at about ``shard_bytes`` and writes it under a
    name of its own attempt, so a retried or speculative task never touches another's
    file; the manifest, which is stored, names only those that count.
    """
    rows = texts(docs, F.xxhash64("text").alias("tie"))
    by = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, first, shard, before, repeat = encoder_for(tokenizer_path), None, None, 0, b"", 0
        fs, root = _filesystem(folder)

        def close() -> pa.RecordBatch:
            name = f"{root}/shard-{uuid.uuid4().hex}.sst"
            data = writer.finish()
            with fs.open_output_stream(name) as f:
                f.write(data)
            return pa.RecordBatch.from_pylist([{"path": name, "first_key": first[0], "first_tie": first[1], "shard": shard, "docs": len(writer.keys), "ids": writer.ids, "bytes": len(data)}], schema=manifest)

        for batch in slices(batches, "text", 1 << 18):
            ids, starts = encoder(raw(batch.column("text")))
            end = np.array([end_id], dtype=f"<u{encoder.width}").tobytes()
            for i, (doc_id, tie) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist())):
                key = sort_key(doc_id)
                repeat = repeat + 1 if key == before else 0
                before = key
                if writer is None:
                    writer, first = ShardWriter(encoder.width), (key, tie)
                writer.add(key + struct.pack(">I", repeat) if repeat else key, ids[starts[i] : starts[i + 1]].tobytes() + end)
                if writer.out.tell() >= shard_bytes:
                    yield close()
                    writer, shard = None, shard + 1
        if writer is not None:
            yield close()

    manifest = pa.schema([("path", pa.string()), ("first_key", pa.binary()), ("first_tie", pa.int64()), ("shard", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
    kinds = "path string, first_key binary, first_tie long, shard int, docs long, ids long, bytes long"
    _make(folder)
    done = stored(ordered.mapInArrow(write, kinds), "sst-manifest")
    # one row for each shard
    before = Window.orderBy("first_key", "first_tie", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return done.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _make(folder: str) -> None:
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)


def read_shards(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, ids)`` of every document, read from the shard files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _filesystem(row["path"])
                with fs.open_input_file(path) as f:
                    at, out, held = row["start"], [], 0
                    for key, ids in ShardReader(f):
                        wide = ids.astype("<u4").tobytes()
                        out.append((doc_id_of(key), at, len(ids), zlib.crc32(wide), wide))
                        at, held = at + len(ids), held + len(wide)
                        if held > 1 << 22:
                            yield _batch(out)
                            out, held = [], 0
                    if out:
                        yield _batch(out)

    def _batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return manifest.select("path", "start").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def lookup(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """``(doc_id, ids)`` of the given ids, at most 100,000: each shard is asked through its Bloom filter and index.

    An id that several rows had has as many rows; one that none had has none.
    """
    if len(doc_ids) > 100_000:
        raise ValueError("join with read_shards() for more than 100,000 ids")
    wanted = list(dict.fromkeys(doc_ids))
    shared = manifest.sparkSession.sparkContext.broadcast((wanted, [sort_key(d) for d in wanted]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = _filesystem(path)
                with fs.open_input_file(name) as f:
                    shard, (asked, keys) = ShardReader(f), shared.value
                    hits = [(asked[i], ids.astype(int).tolist()) for i in np.flatnonzero(shard.may_hold_each(keys)).tolist() for ids in shard.get(asked[i])]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in hits]), pa.array([x for _, x in hits], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return manifest.select("path").mapInArrow(ask, "doc_id long, ids array<long>")


def token_output(docs: DataFrame) -> DataFrame:
    """Writes ``docs`` to shards in the shared folder and reads each document's place back.

    Null and empty texts have the end alone; texts of any length are one entry each, and
    repeated ids one each as well, by a number behind the id. A null id comes last. An
    empty table gives an empty result. Other columns are not read. Ids are integers.
    """
    import public_tokenizers

    folder = f"{shared_dir(docs.sparkSession)}/sst-{uuid.uuid4().hex}"
    manifest = write_shards(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(manifest).drop("ids")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids in the shards."""
    return token_output(table(spark, sf_dir, "documents"))


def stage_token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shards of all documents that are left, by a row for each; see ``token_output``."""
    return token_output(docs)
