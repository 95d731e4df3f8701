"""Token ids in fixed-width bit-packed files, with random access.

A file holds the documents of one range of ids.  Layout, all little-endian:

    magic 8 bytes | bits, documents, tokens, blocks: 4 x uint64
    document offsets: (documents + 1) x uint64, in tokens
    block offsets: (blocks + 1) x uint64, in bytes from the start of the body
    body: blocks of BLOCK ids, each id in ``bits`` bits, least significant bit first

``bits`` is the least that holds the vocabulary.  A block begins at a byte, so any
range of tokens is read from its blocks alone and unpacked with numpy.

Writing is one shuffle: documents are ranged by id, sorted within the partition,
encoded and written there.  An attempt writes a file under its own name and renames
it when it is complete, so repeated and speculative tasks leave one whole file.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.batches import buffer_of, pieces
from tidegauge.llm.hash_arrays import folder_uri, make_folder
from tidegauge.llm.segments import SegmentCache, segment

MAGIC = b"TOKBITS1"
BLOCK = 4096


def width(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    as_bits = np.unpackbits(np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(as_bits[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    as_bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits).reshape(count, bits)
    full = np.zeros((count, 32), np.uint8)
    full[:, :bits] = as_bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1)


def write_file(filesystem: pafs.FileSystem, path: str, ids: list[np.ndarray], lengths: np.ndarray, bits: int) -> None:
    """Write one file; it appears under its name only when whole."""
    total = int(lengths.sum())
    blocks = -(-total // BLOCK)
    block_bytes = BLOCK * bits // 8
    ends = np.minimum(np.arange(blocks + 1) * block_bytes, -(-total * bits // 8)).astype("<u8")
    attempt = f"{path}.{uuid.uuid4().hex}"
    with filesystem.open_output_stream(attempt) as out:
        out.write(MAGIC + np.array([bits, len(lengths), total, blocks], "<u8").tobytes())
        out.write(np.concatenate(([0], np.cumsum(lengths))).astype("<u8").tobytes())
        out.write(ends.tobytes())
        rest = np.zeros(0, np.uint32)
        for i, x in enumerate(ids):
            rest = np.concatenate((rest, x))
            whole = len(rest) if i == len(ids) - 1 else len(rest) // BLOCK * BLOCK
            out.write(pack(rest[:whole], bits))
            rest = rest[whole:]
    filesystem.move(attempt, path)


class TokenFile:
    """Random access to one file."""

    def __init__(self, filesystem: pafs.FileSystem, path: str):
        self.file = filesystem.open_input_file(path)
        head = self.file.read_at(40, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.bits, self.documents, self.tokens, blocks = (int(x) for x in np.frombuffer(head[8:], "<u8"))
        self.offsets = np.frombuffer(self.file.read_at(8 * (self.documents + 1), 40), "<u8").astype(np.int64)
        at = 40 + 8 * (self.documents + 1)
        self.blocks = np.frombuffer(self.file.read_at(8 * (blocks + 1), at), "<u8").astype(np.int64)
        self.body = at + 8 * (blocks + 1)

    def read(self, start: int, end: int) -> np.ndarray:
        """Tokens ``start`` to ``end`` of the file."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-end // BLOCK)
        data = self.file.read_at(int(self.blocks[last] - self.blocks[first]), int(self.body + self.blocks[first]))
        count = min(last * BLOCK, self.tokens) - first * BLOCK
        return unpack(data, count, self.bits)[start - first * BLOCK:end - first * BLOCK]

    def document(self, number: int) -> np.ndarray:
        return self.read(int(self.offsets[number]), int(self.offsets[number + 1]))


class WordTokenizer:
    """A tokenizer file, each distinct segment encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # Letters of either case, and all white space, are one to a tokenizer that makes them so; a special
        # name is not, but no segment holds one that segments break.
        normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        either = [(chr(c), chr(c + 32)) for c in range(65, 91)] + [(chr(c), " ") for c in range(9, 14)]
        self.folded = (all(normal(f"x{a}y") == normal(f"x{b}y") for a, b in either)
                       and all(len(segment(pa.array([s]))[0]) > 1 for s in self.special))
        self.cache = SegmentCache(self._encode, (np.uint32,))

    def _encode(self, segments: list[bytes]) -> list[tuple]:
        got = self.tokenizer.encode_batch_fast([s.decode() for s in segments], add_special_tokens=False)
        return [(x.ids,) for x in got]

    def batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each row closed by ``end_id``, and the numbers of ids."""
        codes, distinct, rows = segment(texts, self.folded)
        ids, cuts = self.cache.join(0, self.cache.find(distinct)[codes], rows)
        lengths = np.diff(cuts)
        # Names of special tokens in a text are one token, which segments would break.
        data = buffer_of(texts)[0].tobytes()  # of these rows alone: the buffer is that of the whole batch
        plain = texts.to_pylist() if any(s.encode() in data for s in self.special) else []
        named = [i for i, t in enumerate(plain) if t and any(s in t for s in self.special)]
        if named:
            rows_of = [ids[cuts[i]:cuts[i + 1]] for i in range(len(lengths))]
            for i in named:
                rows_of[i] = np.array(self.tokenizer.encode(plain[i], add_special_tokens=False).ids, np.uint32)
            lengths = np.array([len(x) for x in rows_of])
            ids = np.concatenate(rows_of)
        return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process, kept between its tasks."""
    return WordTokenizer(path)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, doc_id: str = "doc_id",
                 text: str = "text") -> list[tuple[str, int, int]]:
    """Write the ids of all documents in ascending id order; (path, documents, tokens) of each file, in order.

    A null id comes first; rows of one id stand in any order.  A null or empty text
    has its end id only.  No documents give no files.  Beside each file lies the same
    range's document ids as ``.docs`` (signed 64-bit; the least number for null).
    """
    numbered = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    # Rows of one id may be many: they are dealt over several ranges.
    numbered = numbered.withColumn("__tie", F.xxhash64("text", F.spark_partition_id()))
    ranged = numbered.repartitionByRange("doc_id", "__tie").sortWithinPartitions("doc_id", "__tie").drop("__tie")

    def run(batches):
        words = tokenizer(tokenizer_path)
        bits = width(words.size)
        ids, lengths, keys = [], [], []
        for piece in pieces(batches):
            x, n = words.batch(piece.column("text"), end_id)
            ids.append(x.astype(np.uint16 if bits <= 16 else np.uint32))
            lengths.append(n)
            keys.append(piece.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy())
        if not keys:
            return
        number = TaskContext.get().partitionId()
        filesystem, base = pafs.FileSystem.from_uri(folder)
        path = f"{base}/part-{number:06d}"
        n = np.concatenate(lengths)
        write_file(filesystem, f"{path}.ids", ids, n, bits)
        with filesystem.open_output_stream(attempt := f"{path}.{uuid.uuid4().hex}") as out:
            out.write(np.concatenate(keys).astype("<i8").tobytes())
        filesystem.move(attempt, f"{path}.docs")
        yield pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([path]), pa.array([len(n)]), pa.array([int(n.sum())])],
            ["number", "path", "documents", "tokens"])

    folder = make_folder(folder)
    files = ranged.mapInArrow(run, "number long, path string, documents long, tokens long").collect()
    return [(f.path, f.documents, f.tokens) for f in sorted(files, key=lambda f: f.number)]


def read_tokens(spark, folder: str, files: list[tuple[str, int, int]], arrays: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (and ids).

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is over the
    document's ids as little-endian unsigned 32-bit integers.
    """
    uri = folder_uri(folder)
    base = np.concatenate(([0], np.cumsum([f[2] for f in files]))).tolist()
    least = np.iinfo(np.int64).min

    def run(batches):
        filesystem, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                f = TokenFile(filesystem, f"{path}.ids")
                with filesystem.open_input_file(f"{path}.docs") as docs:
                    keys = np.frombuffer(docs.read(), "<i8")
                at = 0
                while at < f.documents:  # about two million tokens at a time
                    end = max(at + 1, int(np.searchsorted(f.offsets, f.offsets[at] + (2 << 20), "right")) - 1)
                    cuts = f.offsets[at:end + 1]
                    ids = f.read(int(cuts[0]), int(cuts[-1]))
                    cuts = cuts - cuts[0]
                    view = memoryview(ids.astype("<u4")).cast("B")
                    crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    columns = [pa.array(keys[at:end], mask=keys[at:end] == least), pa.array(before + f.offsets[at:end]),
                               pa.array(np.diff(cuts)), pa.array(crc, pa.int64())]
                    if arrays:
                        columns.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])
                    at = end

    listing = spark.createDataFrame([(p, b) for (p, _, _), b in zip(files, base, strict=False)], "path string, start long")
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * arrays
    return listing.repartition(max(1, len(files))).mapInArrow(run, fields)
