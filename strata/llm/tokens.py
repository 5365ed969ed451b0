"""Token-ID output as sorted-string-table files.

Documents are tokenised, ordered by id and written as immutable files: prefix-compressed entries in compressed blocks, then a
sparse index (one entry a block), a Bloom filter and a fixed footer. A lookup reads the footer, asks the filter, finds the block
by binary search in the index, and decodes that block alone.

File layout (all integers little-endian; `uv` is a LEB128 varint):

    block*   zstd of entries: uv shared key bytes, uv other key bytes, uv value bytes, key rest, value;
             every 16th entry shares nothing; a crc32 of the compressed bytes follows the block
    index    zstd of, for each block: uv key length, last key, uv offset, uv length
    bloom    u32 hash count, bits
    footer   index offset u64, index length u64, bloom offset u64, bloom length u64, entries u64, tokens u64, bytes a token u32,
             magic "STRATSS1"

A key is 8 bytes, the id with its sign bit flipped, big-endian; a NULL id has the empty key and so comes first. Repeated ids are
neighbours. A value is the ids of one document with its end id.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import Recent, claim, cut, holds, new_shared_path, open_fs, ship_package, slices

END_ID = 2
MAGIC = b"STRATSS1"
FOOTER = struct.Struct("<QQQQQQI8s")
BLOCK_BYTES = 1 << 16
FILE_BYTES = 64 << 20
RESTART = 16
HASHES = 7
BITS_A_KEY = 10
#: Fixed value: the splitting rule that the short way knows.
LETTER_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# --- files -----------------------------------------------------------------


def encode_key(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def decode_key(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = zlib.crc32(key, 0x51A7), zlib.crc32(key, 0xB10C) | 1
    return [(a + i * b + i * i * i) % bits for i in range(hashes)]


class Writer:
    """Writes one file to a stream, in key order."""

    def __init__(self, out, token_bytes: int) -> None:
        self.out, self.token_bytes = out, token_bytes
        self.at = self.entries = self.tokens = 0
        self.block, self.in_block, self.last = bytearray(), 0, b""
        self.index = bytearray()
        self.keys: list[bytes] = []
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        if self.entries and key < self.last:
            raise ValueError("keys out of order")
        shared = 0
        if self.in_block % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        for n in (shared, len(key) - shared, len(value)):
            put_varint(self.block, n)
        self.block += key[shared:]
        self.block += value
        if not self.entries or key != self.last:
            self.keys.append(key)
        self.last = key
        self.in_block += 1
        self.entries += 1
        self.tokens += len(value) // self.token_bytes
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.in_block:
            return
        packed = self.zip.compress(bytes(self.block))
        put_varint(self.index, len(self.last))
        self.index += self.last
        put_varint(self.index, self.at)
        put_varint(self.index, len(packed))
        self._write(packed + struct.pack("<I", zlib.crc32(packed)))
        self.block, self.in_block = bytearray(), 0

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.flush()
        index_at, packed = self.at, self.zip.compress(bytes(self.index))
        self._write(packed)
        bits = max(64, len(self.keys) * BITS_A_KEY)
        flags = np.zeros(bits, bool)
        for key in self.keys:
            flags[bloom_places(key, bits, HASHES)] = True
        bloom_at, bloom = self.at, struct.pack("<IQ", HASHES, bits) + np.packbits(flags, bitorder="little").tobytes()
        self._write(bloom)
        self._write(FOOTER.pack(index_at, len(packed), bloom_at, len(bloom), self.entries, self.tokens, self.token_bytes, MAGIC))


class Reader:
    """Random access to one file of a pyarrow file system."""

    def __init__(self, path: str) -> None:
        files, plain = open_fs(path)
        self.file = files.open_input_file(plain)
        size = self.file.size()
        index_at, index_n, bloom_at, bloom_n, self.entries, self.tokens, self.token_bytes, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.unzip = zstandard.ZstdDecompressor()
        self.dtype = np.dtype(f"<u{self.token_bytes}")
        raw, at = self.unzip.decompress(self.file.read_at(index_n, index_at)), 0
        self.last_keys: list[bytes] = []
        self.blocks: list[tuple[int, int]] = []
        while at < len(raw):
            n, at = get_varint(raw, at)
            self.last_keys.append(raw[at : at + n])
            offset, at = get_varint(raw, at + n)
            length, at = get_varint(raw, at)
            self.blocks.append((offset, length))
        bloom = self.file.read_at(bloom_n, bloom_at)
        self.hashes, self.bits = struct.unpack_from("<IQ", bloom)
        self.bloom = bloom[12:]

    def close(self) -> None:
        self.file.close()

    def maybe(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, self.bits, self.hashes))

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        offset, length = self.blocks[k]
        packed = self.file.read_at(length + 4, offset)
        if zlib.crc32(packed[:-4]) != struct.unpack("<I", packed[-4:])[0]:
            raise ValueError("a block is damaged")
        raw, at, key = self.unzip.decompress(packed[:-4]), 0, b""
        while at < len(raw):
            shared, at = get_varint(raw, at)
            n, at = get_varint(raw, at)
            size, at = get_varint(raw, at)
            key = key[:shared] + raw[at : at + n]
            yield key, raw[at + n : at + n + size]
            at += n + size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, value in self.block(k):
                yield decode_key(key), np.frombuffer(value, self.dtype)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Token ids of each document with this id."""
        key = encode_key(doc_id)
        found: list[np.ndarray] = []
        if not self.maybe(key):
            return found
        for k in range(bisect.bisect_left(self.last_keys, key), len(self.blocks)):
            for other, value in self.block(k):
                if other == key:
                    found.append(np.frombuffer(value, self.dtype))
                elif other > key:
                    return found
        return found


# --- tokenising ------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def _tokenizer(definition: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


#: A piece of letters that composed normalisation leaves alone, then marks that are tokens of their own.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^`{|}~]*)")


class WordCache:
    """Token ids of white-space-separated pieces, by the tokenizers library, each distinct piece once.

    Right for tokenizers that drop white space and never look across it, as word-level BPE files do. Where the file's rules are
    known (lower case, letters apart from marks, byte-level characters), plain words go straight to the library's BPE model;
    every other piece goes through its whole chain.
    """

    #: Bytes that remembered pieces may take.
    PIECE_BYTES = 64 << 20

    def __init__(self, definition: str) -> None:
        self.tokenizer = _tokenizer(definition)
        self.model = self.tokenizer.model
        self.token_bytes = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.token_bytes}")
        self.known = Recent(self.ids, self.PIECE_BYTES)
        self.marks = Recent(lambda marks: b"".join([self.pack(t.id) for t in self.model.tokenize(marks)]), 1 << 20)
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.pack = struct.Struct("<H" if self.token_bytes == 2 else "<I").pack
        rules = json.loads(definition)
        kinds = [x.get("type") for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        split = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": LETTER_RULE}
        from tokenizers.pre_tokenizers import ByteLevel

        spell = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {ord(c): spell.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(33, 127), *range(0xDF, 0x100)])} if self.plain else {}

    def ids(self, piece: bytes) -> bytes:
        text = piece.decode()
        m = _PLAIN.fullmatch(text) if self.plain else None
        if m is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        out = b"".join([self.pack(t.id) for t in self.model.tokenize(m[1].lower().translate(self.spelling))])
        return out + self.marks[m[2]] if m[2] else out

    def encode(self, texts: Iterable[bytes]) -> list[bytes]:
        return [b"".join(map(self.known.__getitem__, t.split())) + self.end for t in texts]


_CACHES: dict[int, WordCache] = {}
holds("tokens", _CACHES.clear)


def _cache(definition: str) -> WordCache:
    claim("tokens")
    key = hash(definition)
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = WordCache(definition)
    return _CACHES[key]


# --- operators -------------------------------------------------------------


@dataclass
class TokenFiles:
    """Files in ascending id order: path, ids of all earlier documents, first and last key."""

    files: list[tuple[str, int, bytes, bytes]]

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """Token ids of each document with this id, by binary search over files, then inside the file."""
        key = encode_key(doc_id)
        found: list[np.ndarray] = []
        for k in range(bisect.bisect_left([f[3] for f in self.files], key), len(self.files)):
            if self.files[k][2] > key:
                break
            reader = Reader(self.files[k][0])
            found += reader.get(doc_id)
            reader.close()
        return found


def write_tokens(docs: DataFrame, definition: str, path: str, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> TokenFiles:
    """Tokenise whole texts (NULL: empty) and write files under path, a folder that all executors share.

    definition is the content of a tokenizers JSON file. Every task writes files under names of its own and moves them into
    place when whole; only files of tasks that succeeded are listed, so retried or lost tasks leave no trace in the result.
    An id that many documents have is dealt over several files by the texts' hashes.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(definition)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        cache = _cache(sent.value)
        files, plain = open_fs(path)
        files.create_dir(plain, recursive=True)
        rows: list[tuple] = []
        writer = stream = None
        name = first = b""

        def finish() -> None:
            writer.close()
            stream.close()
            files.move(f"{plain}/_{name}", f"{plain}/{name}")
            rows.append((part, len(rows), f"{path}/{name}", writer.entries, writer.tokens, first, writer.last))

        for batch in slices(batches, "text", 1 << 20):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for doc_id, value in zip(batch.column(0).to_pylist(), cache.encode(texts), strict=True):
                if writer is None:
                    name = f"{part:06d}-{len(rows):04d}-{uuid.uuid4().hex}.sst"
                    stream = files.open_output_stream(f"{plain}/_{name}")
                    writer, first = Writer(stream, cache.token_bytes), encode_key(doc_id)
                writer.add(encode_key(doc_id), value)
                if writer.at + len(writer.block) >= file_bytes:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        names = ["part", "seq", "path", "entries", "tokens", "first", "last"]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = cut(ordered.mapInArrow(write, "part int, seq int, path string, entries bigint, tokens bigint, first binary, last binary"))
    found, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: (r.part, r.seq)):  # a row for each file, not for each document
        found.append((r.path, start, bytes(r.first), bytes(r.last)))
        start += r.tokens
    return TokenFiles(found)


def read_tokens(spark: SparkSession, written: TokenFiles, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; also ids if asked."""
    ship_package(spark)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list) -> pa.RecordBatch:
            doc_id, start, n, crc, ids = zip(*found, strict=True)
            columns = [pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, found, held = Reader(path), [], 0
                for doc_id, ids in reader.scan():
                    found.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32) if with_ids else None))
                    start += len(ids)
                    held += len(ids) * with_ids + 1
                    if held > 200_000:
                        yield rows(found)
                        found, held = [], 0
                reader.close()
                if found:
                    yield rows(found)

    files = spark.createDataFrame([f[:2] for f in written.files], "path string, start bigint")
    return files.repartition(max(1, len(written.files)), "path").mapInArrow(read, schema)


def tokenize_to_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as token files and read them back: doc_id, start, n_tokens, ids_crc32 of every row of docs.

    A NULL text counts as empty and holds the end id alone. Repeated rows are repeated. A NULL id comes first. An empty table
    writes no file. Other columns are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, definition, path or new_shared_path(spark, "tokens"), id_col, text_col))
