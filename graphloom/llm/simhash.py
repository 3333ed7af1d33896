"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has 64 bits; a bit is set if it is set in over half of the hashes of the
text's 3-word shingles.  Two fingerprints link at 3 or fewer differing bits.  Half that radius is
one flipped bit and half a step more: the 64 bits fall into three groups, and every distinct
fingerprint emits, for each group taken out, what is left and all variants of it with one bit
flipped (131 keys).  Of at most 3 differing bits at least one lies in some group unless there are
none, so with that group taken out at most two are left and both fingerprints emit a common key.
Keys are shuffled; fingerprints that meet are compared in full, and each link is reported only at
the first group and lowest key where its two ends meet, so no link comes twice.

Rows that meet in one key are compared with each other only in runs of up to RUN.  A longer run
(a dense cloud of near copies) is split exactly instead: its fingerprints go on to a second round
in which they emit all variants within two bits.  Where a variant is within one bit of one
fingerprint, all others that emit it are at most three bits from that one, so a link to the smallest such
fingerprint replaces all pairs, and every close pair is so linked at one of its variants.

Defined cases: a null or empty text has fingerprint zero and links like any other; fewer than
three words make one shingle; equal rows and equal texts share a fingerprint and one node; a
null id keeps its fingerprint and links, but is never the smallest id of its component unless all
ids there are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import components, frozen, partitions, table
from .wordarrays import slices

RADIUS = 3
RUN = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bits of the three groups.
GROUPS = [sum(1 << i for i in range(64) if i % 3 == g) for g in range(3)]


def fingerprint(text: bytes, width: int = 3) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size)
    w = min(width, len(words))
    stops = ends[w - 1 :] - 1
    starts = np.concatenate([[0], ends[: len(words) - w]])
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], 42) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, len(starts))
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        bits += np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint's 64 bits as a signed long) of each row."""

    def run(batches):
        for batch, raw in slices(batches):
            fp = np.fromiter(map(fingerprint, raw), np.uint64, len(raw)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, fp long")


def _emit(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fp), 4096):
            some = fp[at : at + 4096]
            for g, group in enumerate(GROUPS):
                left = some & np.uint64(~group & (2**64 - 1))
                flips = np.array([0, *(1 << i for i in range(64) if not group >> i & 1)], np.uint64)
                key = (left[:, None] ^ flips[None]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), g, np.int8)), pa.array(key.view(np.int64)), pa.array(np.repeat(some, len(flips)).view(np.int64))], ["g", "key", "fp"]
                )


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _first_meeting(g: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a pair is close, and this group and key are the first where its ends meet."""
    x = a ^ b
    ok = _popcount(x) <= RADIUS
    for i, group in enumerate(GROUPS):
        outside = np.uint64(~group & (2**64 - 1))
        ok &= (g <= i) | (_popcount(x & outside) > 2)
    outside = np.array([~m & (2**64 - 1) for m in GROUPS], np.uint64)[g]
    y = x & outside
    low = y & (~y + np.uint64(1))
    one, two = (a & outside) ^ low, (b & outside) ^ low
    n = _popcount(y)
    first = np.where(n == 0, a & outside, np.minimum(one, two))
    return ok & (key == np.where(n == 1, np.minimum(a & outside, b & outside), first))


def _meet(batches):
    """Rows sorted by group and key: links between those that meet, and the rows of long runs (as g >= 0)."""
    held: list[np.ndarray] | None = None
    spilling = None

    def out(a, b, g, key):
        return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int8)), pa.array(key.view(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["g", "key", "a", "b"])

    def runs(g, key, fp):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        begin = np.flatnonzero(new)
        return begin, np.diff([*begin, len(g)])

    def work(g, key, fp):
        begin, size = runs(g, key, fp)
        wide = np.repeat(size > RUN, size)
        if wide.any():
            yield out(fp[wide], fp[wide], g[wide], key[wide])
        keep = np.repeat((size > 1) & (size <= RUN), size)
        g, key, fp = g[keep], key[keep], fp[keep]
        for shift in range(1, min(RUN, len(g))):
            same = (g[shift:] == g[:-shift]) & (key[shift:] == key[:-shift])
            if not same.any():
                break
            at = np.flatnonzero(same)
            gg, kk, a, b = g[at], key[at], fp[at], fp[at + shift]
            good = _first_meeting(gg, kk, a, b)
            if good.any():
                yield out(a[good], b[good], np.full(good.sum(), -1), kk[good])

    for batch in batches:
        cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy().view(np.uint64)]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            held = None
        if spilling is not None:
            same = (cols[0] == spilling[0]) & (cols[1] == spilling[1])
            n = int(same.sum())
            if n:
                yield out(cols[2][:n], cols[2][:n], cols[0][:n], cols[1][:n])
                cols = [c[n:] for c in cols]
            if not len(cols[0]):
                continue
            spilling = None
        last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1]) + 1 if (cols[0] != cols[0][-1]).any() or (cols[1] != cols[1][-1]).any() else 0
        tail = [c[last:] for c in cols]
        if last:
            yield from work(*(c[:last] for c in cols))
        if len(tail[0]) > RUN:
            yield out(tail[2], tail[2], tail[0], tail[1])
            spilling = (tail[0][0], tail[1][0])
        else:
            held = tail
    if held is not None:
        yield from work(*held)


_TWO = np.array([1 << i | 1 << j for i in range(64) for j in range(i)], np.uint64)
_ONE = np.array([0, *(1 << i for i in range(64))], np.uint64)


def _balls(batches):
    """Every variant within two bits of fingerprints of long runs; far: two bits away."""
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for flips, far in ((_ONE, False), (_TWO, True)):
            for at in range(0, len(fp), 32):
                some = fp[at : at + 32]
                key = (some[:, None] ^ flips[None]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), far)), pa.array(np.repeat(some, len(flips)).view(np.int64))], ["key", "far", "fp"])


def _stars(batches):
    """Rows sorted by key, far, fp: a link from each row to its key's first row, if that is near."""
    key = first = None
    for batch in batches:
        k = batch.column(0).to_numpy()
        far = batch.column(1).to_numpy(zero_copy_only=False)
        fp = batch.column(2).to_numpy()
        if not len(k):
            continue
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        new[0] = key is None or k[0] != key
        near = new & ~far
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        hub = np.where(at >= 0, fp[np.maximum(at, 0)], 0 if first is None else first[0])
        ok = np.where(at >= 0, near[np.maximum(at, 0)], first is not None and first[1]) & (hub != fp)
        if at[-1] >= 0:
            first = (fp[at[-1]], bool(near[at[-1]]))
        key = k[-1]
        if ok.any():
            pairs = np.unique(np.stack([fp[ok], hub[ok]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """Links a, b between fingerprints (fp, as longs): all within RADIUS, but inside long runs only such as connect the same."""
    spark = distinct.sparkSession
    n = partitions(spark)
    keys = distinct.select("fp").mapInArrow(_emit, "g byte, key long, fp long")
    met = frozen(keys.repartition(n, "g", "key").sortWithinPartitions("g", "key").mapInArrow(_meet, "g byte, key long, a long, b long"))
    dense = met.where("g >= 0").select("a").distinct()
    balls = dense.mapInArrow(_balls, "key long, far boolean, fp long")
    stars = balls.repartition(n, "key").sortWithinPartitions("key", "far", "fp").mapInArrow(_stars, "a long, b long")
    return met.where("g < 0").select("a", "b").union(stars)


def _rooted(prints: DataFrame) -> DataFrame:
    """fp, its smallest id and root (the smallest fingerprint reachable over links) of each distinct fingerprint."""
    distinct = frozen(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component (the smallest id reachable over links) of each row of docs."""
    prints = frozen(fingerprints(docs, id_col, text_col))
    rooted = _rooted(prints)
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each component: that with the smallest id, nulls last, then the smallest hash of its text, then the first.

    Rows are told apart by their place in a stored copy, so ids may be null or name several texts.
    """
    rows = frozen(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.monotonically_increasing_id().alias("row")))
    known = F.col("d").getField(id_col)
    text = F.col("d").getField(text_col)
    order = F.struct(known.isNull().alias("none"), known.alias("id"), F.xxhash64(text).alias("h"), F.col("row").alias("row"))
    prints = frozen(fingerprints(rows.select(order.alias("k"), text.alias("text")), "k", "text"))
    kept = _rooted(prints).groupBy("root").agg(F.min("least").alias("k")).select("k.row")
    return rows.join(kept, "row", "left_semi").select("d.*")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
