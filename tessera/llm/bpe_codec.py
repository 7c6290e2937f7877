"""Operator 5: BPE encoding and decoding through a table of distinct words.

1. Spark splits texts into words. Blocks of documents, written once, hold their words as
   numbers, and list what each of these places stands for.
2. The lists, a row for each block and word, become a table that is bucketed by word. Its
   distinct words are encoded once each by the vocabulary's own library. Rows travel in
   packets, one for each bucket among some rows of a task, so that there are never more
   packets than rows; so they do on the way back.
3. Decoding is a join: each id of a distinct word, with its place in it, meets the
   id-to-piece table, whose size is the vocabulary's, and a word's pieces are put together.
4. Encoded words are joined with the lists by word, without a shuffle, and their ids go
   back to their block by place, where those of a document follow each other. Of pieces
   that give the very word, as they nearly always do, only that is sent.

Words are cut before ASCII blanks that follow something else, where no token of such a
vocabulary reaches over; joined, they are the text.

Defined results: a null or empty text has no ids and decodes to the empty text;
repeated rows each give a row; a null id stays null; other columns are ignored; an
empty table gives none. Special strings inside texts become their special ids, and
are decoded to themselves. Very long texts are encoded whole. Ties don't arise: no
row's result depends on another row. An id without a piece ends the job.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import store

BLOCK_BYTES, CHUNK_BYTES = 32 << 20, 4 << 20
#: Before an ASCII blank, but not after a blank of any kind, or a control that some engines take for one.
#: The blank is looked for first: Java tries both at each character, and few are blanks.
CUT = r"(?=[\t-\r ])(?<=[^\t-\r \x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff])"
#: Rows and bytes that make packets.
PACKET_ROWS, PACKET_BYTES = 1 << 18, 16 << 20
_BLOCKS = "block bigint, ids array<bigint>, body binary"
_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("body", pa.binary())])


def byte_symbols() -> dict[str, int]:
    """Byte by the printable character that stands for it in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def encoder(vocabulary: str):
    """A tokenizer with truncation and padding off."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.no_truncation()
    t.no_padding()
    return t


def encode_words(tokenizer, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words one after another (uint32), and how many each has."""
    ids, counts = [], np.zeros(len(words), np.uint32)
    step = 2000
    for k in range(0, len(words), step):
        got = tokenizer.encode([w.decode() for w in words[k : k + step]], is_pretokenized=True, add_special_tokens=False)
        ids.append(np.array(got.ids, np.uint32))
        if len(got.ids):
            at = np.array(got.word_ids, np.int64)
            counts[k : k + step] = np.bincount(at, minlength=min(step, len(words) - k))
    return np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts


def pieces(vocabulary: str) -> dict[int, bytes]:
    """Piece by id of a byte-level vocabulary."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["decoder"]["type"] != "ByteLevel":
        raise ValueError(f"{vocabulary}: not a byte-level vocabulary")
    back = byte_symbols()
    table = {i: bytes(back[c] for c in p) for p, i in spec["model"]["vocab"].items()}
    return table | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


def _numbered(batches, limit: int = BLOCK_BYTES, chunk: int = CHUNK_BYTES):
    """Rows with some documents' ids, sizes and word numbers, and for each block one without ids that has its words."""
    home, blocks = TaskContext.get().partitionId() << 24, itertools.count()
    block, held, own = home + next(blocks), 0, defaultdict(itertools.count().__next__)

    def row(ids, body: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block, ids, body), _ARROW)], schema=_ARROW)

    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(1)
        ends = texts.offsets.to_numpy()
        values = texts.values
        length = np.concatenate([[0], np.cumsum(pc.binary_length(values.cast(pa.binary())).to_numpy(zero_copy_only=False), dtype=np.int64)])[ends]
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(length, length[i] + chunk, side="right")) - 1)
            if held and held + length[j] - length[i] > limit:
                yield row(None, X.pack([w.encode() for w in own]))
                block, held, own = home + next(blocks), 0, defaultdict(itertools.count().__next__)
            coded = values.slice(ends[i], ends[j] - ends[i]).dictionary_encode()
            number = np.fromiter(map(own.__getitem__, coded.dictionary.to_pylist()), np.uint32, len(coded.dictionary))
            yield row(batch.column(0).slice(i, j - i).to_pylist(), X.press(np.diff(ends[i : j + 1]).astype(np.int64), number[coded.indices.to_numpy()]))
            held += length[j] - length[i]
            i = j
    if held or own:
        yield row(None, X.pack([w.encode() for w in own]))


def _strings(blob: bytes) -> pa.Array:
    """What ``X.pack`` was given, without an object for each."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[:4], "little")
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data).slice(4 + 4 * n)])


def _listed(batches):
    """(word, block, place) of blocks' words."""
    for b in batches:
        for block, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = _strings(body)
            for k in range(0, len(words), 50_000):
                some = words.slice(k, 50_000).cast(pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([some, pa.array(np.full(len(some), block)), pa.array(np.arange(k, k + len(some), dtype=np.int32))], names=["word", "block", "place"])


def _packets(batches, limit: int = PACKET_ROWS, most: int = PACKET_BYTES):
    """(key, blob) of rows of a key, integers and strings: those of a key among ``limit`` rows in one frame, by the last integer."""
    held, rows, size = [], 0, 0
    for b in batches:
        if b.num_rows:
            held, rows, size = [*held, b], rows + b.num_rows, size + b.nbytes
        if rows >= limit or size >= most:
            yield from _framed(held)
            held, rows, size = [], 0, 0
    if held:
        yield from _framed(held)


def _framed(batches: list[pa.RecordBatch]):
    table = pa.Table.from_batches(batches).combine_chunks()
    whole = [k for k, t in enumerate(table.schema.types) if pa.types.is_integer(t)]
    key, *numbers = (table.column(k).to_numpy().astype(np.int64) for k in whole)
    by = np.lexsort((numbers[-1], key))
    key, numbers = key[by], [x[by].view(np.uint64) for x in numbers]
    texts = []
    for k in range(len(whole), table.num_columns):
        c = table.column(k).cast(pa.large_binary()).combine_chunks().take(pa.array(by))
        sizes = pc.fill_null(pc.binary_length(c), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        data = c.buffers()[2]
        texts.append((sizes, np.concatenate([[0], np.cumsum(np.maximum(sizes, 0), dtype=np.int64)]), memoryview(data) if data else memoryview(b"")))
    lead = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0])).tolist()
    blobs = []
    for i, j in zip(lead, [*lead[1:], len(key)]):
        blobs.append(X.press(*(X.deltas(x[i:j]) for x in numbers), *(part for sizes, at, data in texts for part in (sizes[i:j], bytes(data[at[i] : at[j]])))))
    for k in range(0, len(lead), 1000):
        yield pa.RecordBatch.from_arrays([pa.array(key[lead[k : k + 1000]]), pa.array(blobs[k : k + 1000], pa.binary())], names=["key", "blob"])


def _unframed(blob: bytes, numbers: int, texts: int) -> tuple[list[np.ndarray], list[pa.Array]]:
    """Integers and strings of a packet."""
    got = X.expand(blob, *[np.uint64] * numbers, *[np.int32, bytes] * texts)
    columns = []
    for sizes, data in zip(got[numbers::2], got[numbers + 1 :: 2]):
        ends = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0), dtype=np.int64)])
        valid = pa.py_buffer(np.packbits(sizes >= 0, bitorder="little").tobytes()) if (sizes < 0).any() else None
        columns.append(pa.Array.from_buffers(pa.large_binary(), len(sizes), [valid, pa.py_buffer(ends), pa.py_buffer(data)]))
    return [np.cumsum(x, dtype=np.uint64).view(np.int64) for x in got[:numbers]], columns


def _unlisted(batches):
    """The rows of ``_listed`` from packets."""
    for b in batches:
        for blob in b.column(0).to_pylist():
            (block, place), (words,) = _unframed(blob, 2, 1)
            for k in range(0, len(place), 50_000):
                some = words.slice(k, 50_000).cast(pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([some, pa.array(block[k : k + 50_000]), pa.array(place[k : k + 50_000].astype(np.int32))], names=["word", "block", "place"])


def _joined(column: pa.Array, places: np.ndarray, ends: np.ndarray) -> list[memoryview]:
    """The column's values at runs of places, each run put together."""
    _, offsets, data = column.take(pa.array(places)).buffers()
    at = np.frombuffer(offsets, np.int64)[np.concatenate([[0], ends])].tolist()
    values = memoryview(data) if data else memoryview(b"")
    return [values[s:e] for s, e in zip(at, at[1:])]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """Token ids and decoded text of each row of ``docs``.

    digests: n_tokens, ids_sha256 and decoded_sha256 instead of n_tokens, ids and
    decoded. A digest is of the decimal ids joined by commas, or of the UTF-8 text.
    """
    spark, n = docs.sparkSession, X.partitions(docs)
    words = F.when(F.length("text") > 0, F.split("text", CUT, -1)).otherwise(F.array().cast("array<string>"))
    blocks = store.bucketed(X.plain(docs, id_col, text_col).select("doc_id", words.alias("words")).mapInArrow(X.tidy(_numbered), _BLOCKS), "blocks", n, "block")
    listed = blocks.where("ids is null").select("block", "body").mapInArrow(X.tidy(_listed), "word string, block bigint, place int")
    dealt = listed.select(F.expr(f"pmod(hash(word), {n})").cast("bigint").alias("bucket"), "block", "place", "word").mapInArrow(X.tidy(_packets), "bucket bigint, blob binary")  # as a bucketed table has it
    listed = dealt.repartitionById(n, F.col("bucket").cast("int")).select("blob").mapInArrow(X.tidy(_unlisted), "word string, block bigint, place int")
    listed = store.bucketed(listed, "listed", n, "word")
    store.release(spark)  # the shuffle's files

    def encode(batches):
        tokenizer = encoder(vocabulary)
        for b in batches:
            if b.num_rows:
                ids, counts = encode_words(tokenizer, b.column(0).cast(pa.binary()).to_pylist())
                ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))], names=["word", "ids"])

    encoded = store.bucketed(listed.select("word").distinct().mapInArrow(X.tidy(encode), "word string, ids array<int>"), "encoded", n, "word")
    table = pieces(vocabulary)
    width = 2 if max(table) < 1 << 16 else 4
    table = spark.createDataFrame(pa.table({"id": pa.array(list(table), pa.int32()), "piece": pa.array(list(table.values()), pa.binary())}))  # as long as the vocabulary; from rows, Spark would start workers of a second kind
    met = encoded.select("word", F.posexplode("ids").alias("at", "id")).join(F.broadcast(table), "id", "left")
    piece = F.coalesce("piece", F.raise_error(F.lit("an id without a piece")).cast("binary"))
    own = met.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("at", "id", piece.alias("piece")))).alias("own"))
    together = lambda of: F.aggregate("own", F.lit(b""), lambda acc, x: F.concat(acc, of(x)))
    packed = together(lambda x: F.unhex(F.lpad(F.hex(x["id"]), 2 * width, "0")))
    back = together(lambda x: x["piece"])
    coded = own.select("word", packed.alias("packed"), F.when(back != F.encode("word", "UTF-8"), back).alias("other"))
    answers = listed.join(coded, "word", "left").select(F.col("block").alias("home"), "place", F.coalesce("packed", F.lit(b"")).alias("packed"), "other").mapInArrow(X.tidy(_packets), "home bigint, blob binary")
    kind = f">u{width}"
    fields = [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *fields])

    def finish(known: pa.Table, rows: pa.Table) -> pa.Table:
        try:
            return whole(known, rows)
        finally:
            X.give_back()

    def whole(known: pa.Table, rows: pa.Table) -> pa.Table:
        got = [_unframed(blob, 1, 2) for blob in known.column("blob").to_pylist()]
        texts, bodies = rows.column("ids").to_pylist(), rows.column("body").to_pylist()
        piece_of = next((_strings(body) for ids, body in zip(texts, bodies, strict=True) if ids is None), pa.array([], pa.large_binary()))
        at = np.empty(len(piece_of), np.int64)
        if got:
            at[np.concatenate([places for (places,), _ in got])] = np.arange(len(at))
        ids_of, others = (pa.concat_arrays([strings[k] for _, strings in got] or [piece_of]) for k in (0, 1))
        if got and others.null_count < len(others):
            piece_of = pc.coalesce(others.take(pa.array(at)), piece_of)
        decimal = pa.array([b"%d," % i for i in range(1 << 16)], pa.large_binary()) if kind == ">u2" else None
        done = []
        for doc_ids, body in zip(texts, bodies, strict=True):
            if doc_ids is None:
                continue
            sizes, places = X.expand(body, np.int64, np.uint32)
            ends = np.cumsum(sizes)
            back = [str(x, "utf-8", "replace") for x in _joined(piece_of, places, ends)]
            ids = [np.frombuffer(x, kind) for x in _joined(ids_of, at[places], ends)]
            if not digests:
                columns = [x.astype(np.int32) for x in ids], back
            elif decimal is None:
                columns = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in ids], [hashlib.sha256(x.encode()).hexdigest() for x in back]
            else:
                total = np.cumsum(list(map(len, ids)))
                shown = _joined(decimal, np.concatenate(ids).astype(np.uint16), total)
                columns = [hashlib.sha256(x[:-1]).hexdigest() for x in shown], [hashlib.sha256(x.encode()).hexdigest() for x in back]
            done.append(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((doc_ids, list(map(len, ids)), *columns), arrow)], schema=arrow))
        return pa.concat_tables(done) if done else arrow.empty_table()

    schema = "doc_id bigint, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return answers.groupBy("home").cogroup(blocks.groupBy("block")).applyInArrow(finish, schema)
