"""Token-id output as directly addressable codes.

Every document's token ids (plus an end id) are stored in ascending document
order, cut into segments of whole documents.  A segment splits each id into
chunks, lowest first: level ``l`` holds the ``l``-th chunk of all ids that
have one, a continuation bitmap says which of them go on at level ``l + 1``,
and a rank directory (set bits before each 512-bit block) gives the place
there.  Any token is reached by one rank per level; nothing else is decoded.

Segments are rows of a Parquet table (``part, seg, start, n_docs, n_tokens,
payload``), so that Spark's committer handles lost executors and any store
that Spark can write will do.

Edge cases: a null text is empty and gives the end id alone; a null document
id sorts first and stays null; repeated rows are each stored; rows of one id
with different texts follow in the order of the texts' hash; an empty table
gives no segment; further input columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import Memo, new_path, small_batches

MAGIC = b"DAC1"
RANK_BLOCK = 512
SEGMENT_SCHEMA = "part int, seg int, start long, n_docs long, n_tokens long, payload binary"
_HEAD = struct.Struct("<4sIIIQQ")  # magic, chunk bits, levels, null ids, documents, tokens


def pack(doc_ids: list[int | None], offsets: np.ndarray, ids: np.ndarray, chunk_bits: int = 8) -> bytes:
    """One segment.  ``offsets`` has one entry more than ``doc_ids``; null ids must come first."""
    if chunk_bits not in (8, 16):
        raise ValueError("chunk_bits is 8 or 16")
    kind = np.dtype("<u1" if chunk_bits == 8 else "<u2")
    parts, rest, levels = [], ids.astype(np.uint32), 0
    while len(rest) or not levels:
        high = rest >> np.uint32(chunk_bits)
        more = high > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (RANK_BLOCK // 8)))
        per_block = np.bitwise_count(bits).reshape(-1, RANK_BLOCK // 8).sum(axis=1, dtype=np.uint64)
        ranks = (np.cumsum(per_block) - per_block).astype("<u4")
        parts += [struct.pack("<Q", len(rest)), (rest & np.uint32((1 << chunk_bits) - 1)).astype(kind).tobytes(), bits.tobytes(), ranks.tobytes()]
        rest, levels = high[more], levels + 1
    nulls = sum(d is None for d in doc_ids)
    head = _HEAD.pack(MAGIC, chunk_bits, levels, nulls, len(doc_ids), len(ids))
    return b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), offsets.astype("<u8").tobytes(), *parts])


class Segment:
    """Reads one segment; ``seg[i]`` is token ``i`` without decoding any other."""

    def __init__(self, payload: bytes):
        magic, self.chunk_bits, levels, nulls, docs, self.n_tokens = _HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = _HEAD.size
        kind = np.dtype("<u1" if self.chunk_bits == 8 else "<u2")

        def take(n: int, dtype) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(payload, dtype, n, at)
            at += got.nbytes
            return got

        self.doc_ids: list[int | None] = [None] * nulls + take(docs, "<i8")[nulls:].tolist()
        self.offsets = take(docs + 1, "<u8").astype(np.int64)
        self.levels = []
        for _ in range(levels):
            n = int(take(1, "<u8")[0])
            chunks = take(n, kind)
            blocks = -(-n // RANK_BLOCK)
            self.levels.append((chunks, take(blocks * RANK_BLOCK // 8, "<u1"), take(blocks, "<u4")))

    def __len__(self) -> int:
        return self.n_tokens

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (level * self.chunk_bits)
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            first = i // RANK_BLOCK * (RANK_BLOCK // 8)
            before = int(np.bitwise_count(bits[first : i >> 3]).sum()) + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
            i = int(ranks[i // RANK_BLOCK]) + before
        raise ValueError("the last level goes on")

    def decode(self) -> np.ndarray:
        """All ids, level by level."""
        if not self.n_tokens:
            return np.zeros(0, np.uint32)
        at, out = np.arange(self.n_tokens), np.zeros(self.n_tokens, np.uint32)
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(level * self.chunk_bits)
            at = at[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out

    def document(self, k: int) -> list[int]:
        return [self[i] for i in range(self.offsets[k], self.offsets[k + 1])]


#: White space, ASCII, Latin-1 letters and signs, general punctuation: each stable under NFC, lower-cased one to one.
_SAFE = re.compile("[\t\n\r -~\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u00ff\u2010-\u2027\u2030-\u205e]*")
#: The tokenizer's pieces, over such text in lower case.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\t\n\r a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 on.
_BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(0x100 + k) for k, b in enumerate(x for x in range(256) if x not in set(_PRINTED))}


class WordEncoder:
    """Ids of whole texts, with bounded caches.

    For tokenizers that normalise by NFC and lower case and whose pieces are
    contractions, letter runs, digits and runs of other signs.  Text of common
    characters is cut into these pieces and each new piece goes straight to
    the library's BPE model; of any other text, each white-space chunk (white
    space is dropped and ends pieces) goes through its whole pipeline.
    """

    def __init__(self, tokenizer_path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenize = tokenizer.model.tokenize
        packers = [struct.Struct(f"<{n}I").pack for n in range(32)]

        def packed(ids: list[int]) -> bytes:
            return packers[len(ids)](*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}I", *ids)

        def piece(text: str) -> bytes:
            return packed([t.id for t in tokenize(text if text.isascii() else "".join(map(_BYTE_CHARS.__getitem__, text.encode())))])

        self.pieces = Memo(piece, most, "tokens")
        self.chunks = Memo(lambda chunk: packed(tokenizer.encode(chunk, add_special_tokens=False).ids) if chunk else b"", most // 10, "tokens")

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text and _SAFE.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))
        chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join([self(c) if "<|" not in c and _SAFE.fullmatch(c) else self.chunks[c] for c in chunks])


_encoders: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_segments(docs: DataFrame, path: str, *, tokenizer_path: str, end_id: int = 1, segment_tokens: int = 1 << 20, chunk_bits: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document and write the segments, in ascending document order."""
    small_batches(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seg, start = TaskContext.get().partitionId(), 0, 0
        encode_text = encoder_for(tokenizer_path)
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, held, size, seg, start
            lengths = np.array([len(x) // 4 for x in held], np.int64)
            payload = pack(ids, np.concatenate(([0], np.cumsum(lengths))), np.frombuffer(b"".join(held), "<u4"), chunk_bits)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], names=["part", "seg", "start", "n_docs", "n_tokens", "payload"])
            seg, start, ids, held, size = seg + 1, start + size, [], [], 0
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                held.append(encode_text(text.as_py()) + end)
                size += len(held[-1]) // 4
                if size >= segment_tokens:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    # equal (id, text) rows are interchangeable, so a running number may part a hot id over partitions
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(F.asc_nulls_first("id"), F.asc("h"), F.asc("salt"))
    dealt.sortWithinPartitions(F.asc_nulls_first("id"), F.asc("h")).select("id", "text").mapInArrow(encode, SEGMENT_SCHEMA).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    segments = spark.read.parquet(path)
    # a row for each written part: as many as tasks of the write, whatever the number of documents
    sizes = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases, total = {}, 0
    for part, n in sizes:
        bases[part] = total
        total += n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, payload in zip(*(batch.column(k) for k in range(3))):
                seg = Segment(payload.as_py())
                ids = seg.decode().astype("<u4")
                base = bases[part.as_py()] + start.as_py()
                crcs = [zlib.crc32(ids[a:b].data) for a, b in zip(seg.offsets[:-1], seg.offsets[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(seg.doc_ids, pa.int64()), pa.array(seg.offsets[:-1] + base), pa.array(np.diff(seg.offsets)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("part", "start", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(spark: SparkSession, docs: DataFrame, *, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token segments (in the shared folder unless ``path`` is given) and read them back."""
    path = path or new_path(spark, "tokens")
    write_segments(docs, path, tokenizer_path=tokenizer_path, **options)
    return read_documents(spark, path)
