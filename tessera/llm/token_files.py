"""Operator 2: token ids in binary files, Huffman-coded from global counts.

Texts are encoded by the vocabulary's own library, each new word of a task once (the
pre-tokenizer drops blanks, so words parted by ASCII blanks are independent; plain words
are put together from pieces), and an end id is appended. Documents are dealt to parts by ranges of their ids, found from
the id column alone. One canonical code is made from the counts of all ids (a table
the size of the vocabulary). Spark sorts the documents of each part by id, and a task
writes them as they come as independent blocks of whole documents with bit-offset
checkpoints, so that it holds one block at a time.

A file set is a Parquet folder of blocks (part, block, before, doc_ids, sizes,
payload) and the code's lengths; ``read`` decodes it without anything else.

Defined results: a null or empty text gives the end id alone; null document ids come
first; rows of one id (ties) come in the order of their token ids' bytes, and an id that
fills several parts is dealt to these in turn, each in that order; other columns are
ignored; an empty table gives no blocks. A very long text is one block.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import store
from .bpe_codec import encoder
from .huffman import Code, code_lengths

BLOCK_IDS = 1 << 18
REMEMBERED = 1_000_000
LEAST = -(1 << 63)

#: How the vocabulary's own pre-tokenizer cuts words. Of ASCII without capitals and apostrophes, PIECES does the same.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN, PIECES = re.compile(rb"[!-&(-@\[-~]+"), re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")

#: Ids of words by vocabulary file and width, kept between the tasks of a worker.
_KNOWN: dict[tuple[str, str], _Ids] = {}


class _Ids(dict):
    """Ids of words as little-endian bytes, worked out when a word is first asked for.

    Plain words are put together from their pieces, which the library's model encodes
    without its normalizer and pre-tokenizer; all others go through the whole library.
    """

    def __init__(self, vocabulary: str, wide: str):
        super().__init__()
        self.tokenizer, self.width = encoder(vocabulary), np.dtype(wide).itemsize
        self.model = self.tokenizer.model if _cuts_plainly(vocabulary) else None

    def __missing__(self, word: bytes) -> bytes:
        if self.model is None or not PLAIN.fullmatch(word) or b"<|" in word:
            ids = self.tokenizer.encode([word.decode()], is_pretokenized=True, add_special_tokens=False).ids
            out = b"".join([i.to_bytes(self.width, "little") for i in ids])
        elif len(pieces := PIECES.findall(word)) > 1:
            out = b"".join(map(self.__getitem__, pieces))
        else:
            out = b"".join([t.id.to_bytes(self.width, "little") for t in self.model.tokenize(word.decode())])
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out
        return out


def _cuts_plainly(vocabulary: str) -> bool:
    """Whether the vocabulary leaves lower-case ASCII as it is and cuts it as PIECES does."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if not all(n in ({"type": "NFC"}, {"type": "Lowercase"}, blanks) for n in (spec["normalizer"] or {}).get("normalizers", [])):
        return False
    split, *more = spec["pre_tokenizer"]["pretokenizers"]
    own = split == {"type": "Split", "pattern": {"Regex": CUTS}, "behavior": "Removed", "invert": True}
    return own and [(m["type"], m.get("add_prefix_space"), m.get("use_regex")) for m in more] == [("ByteLevel", False, False)]


def _encode(texts: list[bytes], vocabulary: str, wide: str, end: bytes) -> list[bytes]:
    """Ids of each text and the end id, as little-endian bytes."""
    known = _KNOWN.get((vocabulary, wide)) or _KNOWN.setdefault((vocabulary, wide), _Ids(vocabulary, wide))
    return [b"".join(map(known.__getitem__, (t if b"<|" in t else t.lower()).split())) + end for t in texts]


def _vocabulary_size(vocabulary: str) -> tuple[int, str]:
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["normalizer"] is None or not any(n.get("type") == "Lowercase" for n in spec["normalizer"].get("normalizers", [])) or spec["pre_tokenizer"]["pretokenizers"][0]["behavior"] != "Removed":
        raise ValueError(f"{vocabulary}: only vocabularies that lower-case and drop blanks are encoded word by word here")
    if any("<|" not in t["content"] for t in spec["added_tokens"]):
        raise ValueError(f"{vocabulary}: a special string without <| could be changed by lower-casing")
    n = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return n, "<u2" if n <= 1 << 16 else "<u4"


def _encoded(docs: DataFrame, vocabulary: str, n_ids: int, wide: str, end_id: int, bounds: list[int]) -> DataFrame:
    """(part, doc_id, body) for each document, and for each task a row of part -1 with its counts of ids."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("body", pa.binary())])

    def run(batches):
        end, counts, cuts, turn = np.array([end_id], wide).tobytes(), np.zeros(n_ids, np.int64), np.array(bounds, np.int64), 0
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            coded = _encode(texts, vocabulary, wide, end)
            keys = b.column(0).fill_null(LEAST).to_numpy()
            low, high = np.searchsorted(cuts, keys, "left"), np.searchsorted(cuts, keys, "right")
            part = low + (turn + np.arange(len(keys))) % (high - low + 1)  # an id that fills parts is dealt in turn
            turn += len(keys)
            counts += np.bincount(np.frombuffer(b"".join(coded), wide), minlength=n_ids)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), b.column(0), pa.array(coded, pa.binary())], schema=schema)
        row = [[-1], [None], [zstandard.ZstdCompressor().compress(counts.tobytes())]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)

    return docs.mapInArrow(run, "part int, doc_id bigint, body binary")


def _counts(encoded: DataFrame, n_ids: int) -> np.ndarray:
    def run(batches):
        total = np.zeros(n_ids, np.int64)
        for b in batches:
            for body in b.column(0).to_pylist():
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = encoded.where("part = -1").select("body").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n_ids, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of ``docs`` to the folder ``path``."""
    docs = X.plain(docs, id_col, text_col)
    parts, (n_ids, wide) = X.partitions(docs), _vocabulary_size(vocabulary)
    keys = docs.select(F.coalesce("doc_id", F.lit(LEAST)).alias("k"))
    bounds = keys.agg(F.percentile_approx("k", [k / parts for k in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    encoded = store.written(_encoded(docs, vocabulary, n_ids, wide, end_id, sorted(bounds or [])), "encoded")
    lengths = code_lengths(_counts(encoded, n_ids))
    spark = docs.sparkSession
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(Code(lengths))
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches):
        code, part = shared.value, None
        block = before = held = 0
        ids, bodies = [], []

        def written():
            nonlocal block, before, held, ids, bodies
            sizes = [len(x) // np.dtype(wide).itemsize for x in bodies]
            row = [[part], [block], [before], [ids], [sizes], [code.pack(np.frombuffer(b"".join(bodies), wide))]]
            block, before, held, ids, bodies = block + 1, before + held, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)

        for b in batches:
            for p, i, body in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                n = len(body) // np.dtype(wide).itemsize
                if bodies and (p != part or held + n > BLOCK_IDS):
                    yield written()
                if p != part:
                    part, block, before = p, 0, 0
                ids.append(i)
                bodies.append(body)
                held += n
        if bodies:
            yield written()

    dealt = encoded.where("part >= 0").repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "body")
    dealt.mapInArrow(run, "part int, block int, before bigint, doc_ids array<bigint>, sizes array<bigint>, payload binary").write.parquet(f"{path}/blocks")
    store.forget(encoded)


def read(spark: SparkSession, path: str, digests: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, or ids, from a folder of ``write``."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").first().lengths, np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.select("part", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    totals = sorted((r.part, r.n) for r in sizes.collect())  # one row a part
    ends = np.cumsum([n for _, n in totals]).tolist()
    before = {p: end - n for (p, n), end in zip(totals, ends)}
    shared = spark.sparkContext.broadcast((Code(lengths), before))

    def run(batches):
        code, before = shared.value
        for b in batches:
            for part, start, doc_ids, sizes, payload in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                ids = code.unpack(payload).astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                raw = memoryview(ids).cast("B") if len(ids) else b""
                last = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())] if digests else [ids[s:e].tolist() for s, e in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + before[part] + start), pa.array(sizes, pa.int64()), pa.array(last, pa.int64() if digests else pa.list_(pa.int32()))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"],
                )

    out = "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digests else "ids array<int>")
    return blocks.select("part", "before", "doc_ids", "sizes", "payload").mapInArrow(run, out)


def query(docs: DataFrame, vocabulary: str) -> DataFrame:
    path = store.new_path(docs.sparkSession, "token-files")
    write(docs, vocabulary, path)
    return read(docs.sparkSession, path)
