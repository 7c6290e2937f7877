"""Operator 4: removal of repeated 200-byte strings by hash-compared suffix sorting.

1. Anchors. In each window of NEED bytes the GRAM-byte string with the least hash is an
   anchor: two equal windows have equal anchors at equal places, wherever they are.
2. Repeats. Blocks send their distinct anchor hashes to buckets and learn which of them
   occur elsewhere (or twice in the block).
3. Sorting. Each occurrence of a repeated anchor goes to the anchor's bucket with the
   bytes that any window around it can hold. There suffixes are sorted forwards and
   backwards by hash comparison, common extensions are found by binary search, and
   what is claimed is compared byte by byte. An anchor of more than HOT occurrences has
   no bucket of its own: places of windows around it are taken PLACES at a time, and its
   occurrences go, once for each such segment, to the bucket of the bytes that all
   windows of the segment share, with the bytes that they reach over. Two equal windows
   have an equal place, and so meet there.
4. Removal. Covered ranges return to their block, and are merged and cut there.

Anchors that many texts share are listed once a block in step 2; in step 3 equal
surroundings are sent once a chunk of a block. Around a hot anchor, texts can differ
within a bucket's group in 2 * (PLACES - 1) bytes and no others, however many they are.

Defined results: matches never cross documents; overlaps count and repeats are judged
on the input; repeated rows are occurrences like any other; null and empty texts and
those shorter than NEED lose nothing; a null id stays null; other columns are ignored;
an empty table gives none. A cut inside a character leaves bytes that aren't UTF-8.
Very long texts are worked on whole, in a block of their own. Ties: of two equal strings
both go, and of grams with equal hashes the first in a window is its anchor.
"""

from __future__ import annotations

import hashlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import store
from . import words as W
from .suffixes import Strings, repeated_around

NEED = 200
GRAM = NEED // 2
WINDOW = NEED - GRAM + 1
#: Occurrences from which on an anchor's surroundings are dealt by segments of window
#: places, and the places of a segment.
HOT = 10_000
PLACES = 3
#: Bytes that are sorted at once in a bucket, unless one anchor's occurrences have more.
SORTED_BYTES = 2 << 20


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash, least place, greatest place) of the anchors of some texts; the
    places are those of the anchor in the windows that have it."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    none = np.zeros(0, np.int64)
    if not len(lens) or lens.max() < NEED:
        return none, none, none.astype(np.uint64), none, none
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(lens) - lens
    n = len(data) - GRAM + 1
    prefix = W.prefix_hashes(data)
    _, down = W.POWERS.get(len(data) + 1)
    grams = W.mix((prefix[GRAM:] - prefix[:-GRAM]) * down[:n])
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // WINDOW) * WINDOW, 0xFFFFFFFFFFFFFFFF, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - NEED + 1
    least = np.minimum(behind[:windows], ahead[WINDOW - 1 : WINDOW - 1 + windows])
    inside = np.zeros(len(data) + 1, np.int32)
    long = lens >= NEED
    inside[begin[long]] += 1
    np.add.at(inside, begin[long] + lens[long] - NEED + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[:windows]) > 0)
    least = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)  # never falls from window to window
    first = np.flatnonzero(np.diff(least, prepend=-1))
    last = np.append(first[1:], len(least)) - 1
    at = least[first]
    text = np.searchsorted(begin, at, side="right") - 1
    # least hashes are small; mixed, they spread over buckets
    return text, at - begin[text], W.mix(grams[at] + np.uint64(1)), at - window[last], at - window[first]


def _repeated(texts: DataFrame, buckets: int, hot: int) -> DataFrame:
    """Block rows of kind 0 with the block's anchor hashes that occur twice or more anywhere,
    and which of them occur more than ``hot`` times. A block whose rows several tasks read is
    listed and answered by each of them."""

    def sent(block, found):
        hashes, counts = np.unique(np.concatenate(found), return_counts=True)
        cut = X.cuts(hashes, buckets)
        for b in np.flatnonzero(np.diff(cut)).tolist():
            own = slice(cut[b], cut[b + 1])
            blob = X.press(X.deltas(hashes[own]), counts[own].astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([block]), pa.array([blob], pa.binary())], names=["bucket", "block", "blob"])

    def listed(batches):
        now, found = None, []
        for block, _, _, _, texts in X.walk(batches):
            if found and block != now:
                yield from sent(now, found)
                found = []
            now = block
            found += [anchors(texts[i:j])[2] for i, j in W.some_at_once(texts, 1 << 20)]
        if found:
            yield from sent(now, found)

    def answered(batches):
        lists = []
        for batch in batches:
            for bucket, block, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                deltas, counts = X.expand(blob, np.uint64, np.uint32)
                lists.append((bucket, block, np.cumsum(deltas, dtype=np.uint64), counts))
        if lists:
            every = np.unique(np.concatenate([h for _, _, h, _ in lists]))
            total = np.zeros(len(every), np.int64)
            for _, _, h, counts in lists:
                total[np.searchsorted(every, h)] += counts
            for bucket, block, h, _ in lists:
                often = total[np.searchsorted(every, h)]
                own = often > 1
                if own.any():
                    yield X.block_rows([(block, 0, bucket, None, None, X.press(X.deltas(h[own]), (often[own] > hot).view(np.uint8)))])

    return texts.mapInArrow(listed, "bucket int, block bigint, blob binary").repartitionById(buckets, F.col("bucket")).mapInArrow(answered, X.BLOCK_SCHEMA)


_REQUEST = (np.uint64, np.uint16, np.uint16, np.uint8, bytes, np.int32, np.int32, np.int64)


def _by_segment(texts: list[bytes], text: np.ndarray, at: np.ndarray, least: np.ndarray, greatest: np.ndarray):
    """(key, text, start, anchor, end) of the segments of window places around some anchors."""
    for t, p, low, high in zip(text.tolist(), at.tolist(), least.tolist(), greatest.tolist()):
        body = texts[t]
        for j in range(low // PLACES, high // PLACES + 1):
            a, b = j * PLACES, min((j + 1) * PLACES, WINDOW) - 1
            yield xxhash.xxh64_intdigest(body[p - a : p + NEED - b], j), t, max(0, p - b), p, min(len(body), p + NEED - a)


def _surroundings(batches, buckets: int):
    """Requests (bucket, block, chunk, blob): occurrences of repeated anchors with the bytes around them."""
    held, members = None, None
    for block, payloads, seq, _, texts in X.walk(batches):
        if payloads is not held:
            known = [X.expand(body, np.uint64, bool) for _, body in payloads]
            held, members = payloads, None
            if known:
                members, hot = np.concatenate([np.cumsum(d, dtype=np.uint64) for d, _ in known]), np.concatenate([f for _, f in known])
                order = np.argsort(members)
                members, hot = members[order], hot[order]
        if members is None:
            continue
        text, at, hashes, least, greatest = anchors(texts)
        to = np.minimum(np.searchsorted(members, hashes), len(members) - 1)
        repeated = members[to] == hashes
        one, split = np.flatnonzero(repeated & ~hot[to]), np.flatnonzero(repeated & hot[to])
        found = [(h, t, max(0, p - NEED + GRAM), p, p + NEED) for h, t, p in zip(hashes[one].tolist(), text[one].tolist(), at[one].tolist())]
        found.extend(_by_segment(texts, text[split], at[split], least[split], greatest[split]))
        found.sort(key=itemgetter(0))
        entries: dict[tuple[int, int, bytes], int] = {}
        spots, twice, of = [], [], []
        for h, t, low, p, end in found:
            key = (h, p - low, texts[t][low:end])
            e = entries.setdefault(key, len(entries))
            if e == len(twice):
                twice.append(0)
            else:
                twice[e] = 1
            of.append(e)
            spots.append((t, p))
        keys = list(entries)
        entry_hash = np.array([k[0] for k in keys], np.uint64)
        cut = X.cuts(entry_hash, buckets)
        of, spots = np.array(of, np.int32), np.array(spots, np.int64).reshape(-1, 2)
        spot_cut = np.searchsorted(of, cut)
        for b in range(buckets):
            if cut[b] < cut[b + 1]:
                own, s = keys[cut[b] : cut[b + 1]], slice(spot_cut[b], spot_cut[b + 1])
                blob = X.press(
                    entry_hash[cut[b] : cut[b + 1]],
                    np.array([k[1] for k in own], np.uint16),
                    np.array([len(k[2]) for k in own], np.uint16),
                    np.array(twice[cut[b] : cut[b + 1]], np.uint8),
                    b"".join([k[2] for k in own]),
                    of[s] - np.int32(cut[b]),
                    spots[s, 0].astype(np.int32),
                    spots[s, 1],
                )
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([block]), pa.array([seq], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "block", "seq", "blob"])


def _covered(batches):
    """Block rows of kind 0 with the ranges that repeats cover: head is the chunk, body (text, start, end)."""
    asked = []
    for batch in batches:
        for bucket, block, seq, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            asked.append((bucket, block, seq, *X.expand(blob, *_REQUEST)))
    if not asked:
        return
    hashes, left, size, twice = (np.concatenate([a[k] for a in asked]) for k in (3, 4, 5, 6))
    left, size = left.astype(np.int64), size.astype(np.int64)
    data = b"".join([a[7] for a in asked])
    ends = np.cumsum(size)
    first_of: dict[tuple[int, int, bytes], int] = {}
    same = np.array([first_of.setdefault((h, n, data[e - m : e]), k) for k, (h, n, m, e) in enumerate(zip(hashes.tolist(), left.tolist(), size.tolist(), ends.tolist()))])
    single = np.flatnonzero(same == np.arange(len(same)))  # equal surroundings are sorted once
    order = single[np.argsort(hashes[single], kind="stable")]
    by = hashes[order]
    group = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
    held = np.cumsum(size[order])
    reach = np.zeros((len(hashes), 2), np.int64)
    begin = 0
    while begin < len(order):  # whole groups, about SORTED_BYTES at once
        until = np.searchsorted(held, (held[begin - 1] if begin else 0) + SORTED_BYTES, side="right")
        k = np.searchsorted(group, until, side="right") - 1
        end = int(group[k]) if group[k] > begin else int(group[k + 1]) if k + 1 < len(group) else len(order)
        end = len(order) if until >= len(order) else end
        own, keys = order[begin:end], by[begin:end]
        text = b"".join([data[e - n : e] for e, n in zip(ends[own].tolist(), size[own].tolist())])
        first = np.searchsorted(keys, keys)
        spot = np.cumsum(size[own]) - size[own] + left[own]
        strings = Strings(np.frombuffer(text, np.uint8), spot, left[own], size[own] - left[own])
        reach[own] = np.stack(repeated_around(strings, first, np.searchsorted(keys, keys, side="right") - first, NEED), axis=1)
        begin = end
    reach = reach[same]
    full = np.flatnonzero((twice > 0) | (np.bincount(same)[same] > 1))
    reach[full] = np.stack([left[full], (size - left)[full]], axis=1)
    base = 0
    for a in asked:
        own = reach[base : base + len(a[3])][a[8]]
        base += len(a[3])
        hit = np.flatnonzero(own[:, 1])
        if len(hit):
            body = X.press(a[9][hit], a[10][hit] - own[hit, 0], a[10][hit] + own[hit, 1])
            yield X.block_rows([(a[1], 0, a[0], None, int(a[2]).to_bytes(4, "little"), body)])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, or kept (bytes) with removed (starts and ends)."""
    docs = X.plain(docs, id_col, text_col)
    n = buckets = X.partitions(docs)
    texts = store.written(X.text_rows(docs), "blocks")  # once: what a block holds must not depend on how a later step splits its input
    asked = X.at_blocks(texts.unionByName(_repeated(texts, buckets, hot)), n).mapInArrow(lambda b: _surroundings(b, buckets), "bucket int, block bigint, seq int, blob binary")
    ranges = asked.repartitionById(buckets, F.col("bucket")).mapInArrow(_covered, X.BLOCK_SCHEMA)

    def cut(batches):
        held, chunk = None, {}
        for _, payloads, seq, ids, parts in X.walk(batches):
            if payloads is not held:
                held, chunk = payloads, {}
                for head, body in payloads:
                    chunk.setdefault(int.from_bytes(head, "little"), []).append(body)
            found = [X.expand(b, np.int32, np.int64, np.int64) for b in chunk.get(seq, [])]
            spans: dict[int, list[tuple[int, int]]] = {}
            if found:
                text, start, end = (np.concatenate([f[k] for f in found]) for k in range(3))
                by = np.lexsort((start, text))
                for t, s, e in zip(text[by].tolist(), start[by].tolist(), end[by].tolist()):
                    own = spans.setdefault(t, [])
                    if own and s <= own[-1][1]:
                        own[-1] = (own[-1][0], max(e, own[-1][1]))
                    else:
                        own.append((s, e))
            kept, removed = [], [spans.get(t, []) for t in range(len(parts))]
            for t, own in zip(parts, removed):
                at, left = 0, []
                for s, e in own:
                    left.append(t[at:s])
                    at = e
                kept.append(b"".join([*left, t[at:]]))
            columns = [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in parts], pa.int64()),
                pa.array([sum(e - s for s, e in own) for own in removed], pa.int64()),
                pa.array([len(own) for own in removed], pa.int64()),
            ]
            columns += [pa.array([hashlib.sha256(k).hexdigest() for k in kept])] if digests else [pa.array(kept, pa.binary()), pa.array([[x for span in own for x in span] for own in removed], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", *(["kept_sha256"] if digests else ["kept", "removed"])])

    out = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, " + ("kept_sha256 string" if digests else "kept binary, removed array<bigint>")
    return X.at_blocks(texts.unionByName(ranges), n).mapInArrow(cut, out)
