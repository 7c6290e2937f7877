"""Blocks of documents, and packed rows that travel between them and buckets.

A *block* is a run of documents of one input partition, at most ``BLOCK_BYTES`` of
text unless one document alone is longer. Blocks list what they hold once, however often
it occurs, so that what makes up a third of the corpus costs one entry per block; no text
is grouped by key, and each Python task holds one block or one bucket. Blocks are written
before they are read more than once: their names are those of partitions, which differ
from one reading of a table to the next.

Lists and texts travel as zstd frames, which keeps shuffles near the size of the
compressed input.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 32 << 20
CHUNK_BYTES = 1 << 20

BLOCK_SCHEMA = "block bigint, kind int, seq int, ids array<bigint>, head binary, body binary"
_ARROW_BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("kind", pa.int32()),
        ("seq", pa.int32()),
        ("ids", pa.list_(pa.int64())),
        ("head", pa.binary()),
        ("body", pa.binary()),
    ]
)

_ASCII_WORD = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
#: Whitespace beyond ASCII blanks, and controls some engines count as such.
_OTHER_BLANK = (
    rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf"
)
_HAS_OTHER_BLANK = re.compile(_OTHER_BLANK)
_ENDS_OTHER_BLANK = re.compile(rb"(?:" + _OTHER_BLANK + rb")\Z")


def partitions(docs: DataFrame) -> int:
    """Tasks and buckets for a table: as many as its input has splits, and not fewer than shuffles have."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt to all cores where they come from fewer files than there are cores.

    A small table's file is split by its size, but its rows may be in one of the splits.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    few = rows.rdd.getNumPartitions() <= 2 * cores and len(rows.inputFiles()) < cores
    return rows.repartition(cores) if few else rows


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; other columns can't clash."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def give_back() -> None:
    """Return memory that is free to the system. A worker outlives its tasks, and would keep for each what its largest needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """``run``, a function of batches for mapInArrow, whose worker gives memory back in the end."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def glued_words(text: bytes) -> list[bytes]:
    """Cut before each ASCII blank that follows a non-blank character.

    Pre-tokenizers that let a token start with blanks, but never hold blanks after
    other characters, treat the pieces independently. Joined, they give the text.
    """
    words = _ASCII_WORD.findall(text)
    if _HAS_OTHER_BLANK.search(text):
        merged: list[bytes] = []
        for w in words:
            if merged and _ENDS_OTHER_BLANK.search(merged[-1]):
                merged[-1] += w
            else:
                merged.append(w)
        return merged
    return words


def pack(items: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, items), np.uint32, len(items))
    head = np.array([len(items)], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + lens.tobytes() + b"".join(items))


def unpack(blob: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[:4], "little")
    ends = (np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [data[s:e] for s, e in zip([4 + 4 * n, *ends], ends)]


def pack_array(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a).tobytes())


def unpack_array(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype)


def press(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays, by byte planes, and byte strings in one frame."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def expand(blob: bytes, *kinds) -> list:
    """What ``press`` was given; kinds are the dtypes, or bytes."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[:8], "little")
    sizes = np.frombuffer(data, "<u8", n, 8).astype(np.int64)
    ends = np.cumsum(sizes) + 8 * (n + 1)
    parts = [data[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]
    return [p if k is bytes else np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(np.dtype(k).itemsize, -1).T).view(k).ravel() for p, k in zip(parts, kinds, strict=True)]


def hash_buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of 64-bit hashes; sorted hashes are in sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes, and the end."""
    return np.searchsorted(hash_buckets(hashes, buckets), np.arange(buckets + 1))


def deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=np.uint64(0))


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list, list[bytes]]]:
    """(block id, document ids, texts as UTF-8) of a partition of (id, text) rows; a null text is empty."""
    home = TaskContext.get().partitionId() << 24
    seq, held, ids, texts = 0, 0, [], []
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            t = t or b""
            if texts and held + len(t) > limit:
                yield home + seq, ids, texts
                seq, held, ids, texts = seq + 1, 0, [], []
            ids.append(i)
            texts.append(t)
            held += len(t)
    if texts:
        yield home + seq, ids, texts


def chunks(ids: list, texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    start, held = 0, 0
    for k, t in enumerate(texts):
        if k > start and held + len(t) > limit:
            yield ids[start:k], texts[start:k]
            start, held = k, 0
        held += len(t)
    if len(texts) > start:
        yield ids[start:], texts[start:]


def deal(words: list[bytes], n: int) -> list[list[bytes]]:
    """Words by bucket."""
    out: list[list[bytes]] = [[] for _ in range(n)]
    crc = zlib.crc32
    for w in words:
        out[crc(w) % n].append(w)
    return out


def block_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW_BLOCK, strict=True)], schema=_ARROW_BLOCK)


def text_rows(docs: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """The texts of ``docs`` in block rows of kind 1."""

    def packed(batches):
        for block, ids, texts in blocks(batches, limit):
            for seq, (some, parts) in enumerate(chunks(ids, texts)):
                yield block_rows([(block, 1, seq, some, None, pack(parts))])

    return docs.mapInArrow(packed, BLOCK_SCHEMA)


def at_blocks(rows: DataFrame, n: int) -> DataFrame:
    """Block rows brought together by block, payloads before texts."""
    return rows.repartitionById(n, F.expr(f"cast(pmod(shiftright(block, 24), {n}) as int)")).sortWithinPartitions("block", "kind", "seq")


def walk(batches: Iterator[pa.RecordBatch], open_body: Callable = unpack) -> Iterator[tuple[int, list, int, list, list[bytes]]]:
    """(block, payloads, chunk, ids, texts) for each chunk of the rows of ``at_blocks``."""
    block, payloads = None, []
    for batch in batches:
        columns = [batch.column(i) for i in range(6)]
        for i in range(batch.num_rows):
            b, kind, seq, ids, head, body = (c[i].as_py() for c in columns)
            if b != block:
                block, payloads = b, []
            if kind == 0:
                payloads.append((head, body))
            else:
                yield block, payloads, seq, ids, open_body(body)
