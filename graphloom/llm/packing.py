"""Packing token sequences into windows of fixed length by minimum bin slack.

Every document's ids and an end id are cut into full windows; what remains of each document is
packed: a window starts with the longest remaining length, and a subset-sum dynamic program over
bitsets (bit s: total s can be reached) picks the multiset of other remaining lengths that brings it
closest to capacity; the counts of each length are backtracked from the bitsets.  A gap that no
multiset fills is filled by cutting a piece from another remainder.  When a pool of documents is
used up, its last, open window is cut at powers of two, which need no padding.

Pools are runs of rows in one task, so nothing is shuffled, and memory is bounded by a pool
(POOL_TOKENS ids and one more document).  Sequence ids are the task's number and a count.

Defined cases: a null or empty text is packed as its end id alone; equal rows are packed each on
its own; every id of every document lies in exactly one piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import table
from .tokens import word_encoder
from .wordarrays import slices

CAPACITY = 2048
END_ID = 1
POOL_TOKENS = 1 << 21


def best_multiset(lengths: list[int], counts: list[int], room: int) -> dict[int, int]:
    """How often to use each length (at most its count) to come closest to room without exceeding it."""
    mask = (1 << (room + 1)) - 1
    reach = [1]
    full = 1 << room
    for length, count in zip(lengths, counts, strict=True):
        bits = reach[-1]
        left, step = min(count, room // length), 1
        while left:  # counts in binary parts
            take = min(step, left)
            bits |= bits << (length * take) & mask
            left -= take
            step *= 2
        reach.append(bits)
        if bits & full:
            break
    at = reach[-1].bit_length() - 1
    used: dict[int, int] = {}
    for i in range(len(reach) - 2, -1, -1):
        length, n = lengths[i], 0
        while not reach[i] >> at & 1:  # fewest copies first
            at -= length
            n += 1
        if n:
            used[length] = n
        if not at:
            break
    return used


def pack_lengths(totals: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of pieces (document, start, length), gapless; only the last windows may be short, and are powers of two."""
    windows: list[list[tuple[int, int, int]]] = []
    by_length: dict[int, list[tuple[int, int]]] = {}
    for d, total in enumerate(totals):
        start = 0
        while total - start >= capacity:
            windows.append([(d, start, capacity)])
            start += capacity
        if total > start:
            by_length.setdefault(total - start, []).append((d, start))
    order = sorted(by_length, reverse=True)

    def take(length: int) -> tuple[int, int]:
        piece = by_length[length].pop()
        if not by_length[length]:
            del by_length[length]
            order.remove(length)
        return piece

    while order:
        longest = order[0]
        pieces = [(*take(longest), longest)]
        room = capacity - longest
        if room and order:
            # The longest first: they are the hardest to place.
            fitting = [x for x in order if x <= room]
            for length, n in best_multiset(fitting, [len(by_length[x]) for x in fitting], room).items():
                for _ in range(n):
                    pieces.append((*take(length), length))
                    room -= length
        if room and order:
            # Nothing fills the gap: cut the shortest remainder that is longer.
            length = min((x for x in order if x > room), default=None)
            if length is not None:
                d, start = take(length)
                pieces.append((d, start, room))
                rest = length - room
                if rest not in by_length:
                    by_length[rest] = []
                    order.append(rest)
                    order.sort(reverse=True)
                by_length[rest].append((d, start + room))
                room = 0
        windows.append(pieces)
        if room and order:
            raise AssertionError("an open window with remainders left")
    if windows:
        windows += _at_powers(windows.pop(), capacity)
    return windows


def _at_powers(pieces: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """A short window cut into windows whose lengths are powers of two."""
    total = sum(p[2] for p in pieces)
    if total == capacity:
        return [pieces]
    out, left = [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            room, window = 1 << bit, []
            while room:
                d, start, length = left.pop()
                if length > room:
                    left.append((d, start + room, length - room))
                    length = room
                window.append((d, start, length))
                room -= length
            out.append(window)
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the piece's ids."""

    def pool_rows(pool, first_sequence):
        keys = pa.concat_arrays([k for k, _, _ in pool])
        sizes = np.concatenate([s for _, _, s in pool])
        ids = np.concatenate([i for _, i, _ in pool])
        begin = np.cumsum(sizes) - sizes
        windows = pack_lengths(sizes.tolist(), capacity)
        doc, start, length, sequence, offset = [], [], [], [], []
        for w, pieces in enumerate(windows):
            at = 0
            for d, s, n in pieces:
                doc.append(d)
                start.append(s)
                length.append(n)
                sequence.append(first_sequence + w)
                offset.append(at)
                at += n
        doc_a = np.array(doc, np.int64)
        four = memoryview(ids.astype("<u4").tobytes())
        from_ = (begin[doc_a] + np.array(start, np.int64)).tolist() if doc else []
        crc = [zlib.crc32(four[4 * a : 4 * (a + n)]) for a, n in zip(from_, length, strict=True)]
        cols = [keys.take(pa.array(doc_a)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(sizes[doc_a].astype(np.int64)), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            cols.append(pa.array([ids[a : a + n].astype(np.int32) for a, n in zip(from_, length, strict=True)], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names), len(windows)

    def run(batches):
        encoder = word_encoder(path)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 33
        pool, held = [], 0
        for batch, raw in slices(batches):
            ids, sizes = encoder.encode([t.decode() for t in raw])
            ids = np.insert(ids, np.cumsum(sizes), END_ID)
            pool.append((batch.column(0), ids, sizes + 1))
            held += len(ids)
            if held >= POOL_TOKENS:
                out, n = pool_rows(pool, sequence)
                yield out
                sequence += n
                pool, held = [], 0
        if pool:
            yield pool_rows(pool, sequence)[0]

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, schema)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
