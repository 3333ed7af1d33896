"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is WINDOW consecutive words of one document; words under a window whose words also
start anywhere else are removed.

1. The texts are written to a table in the shared folder; every row gets its base, the number of bytes of text before it in the
   whole table (and one for each row).  Rows whose bases lie in the same SHARD bytes are a shard, so a shard has about that
   much text, however many or long its rows are; a place in the corpus is a base and a word's position.
2. Candidates: of every window the word gram (GRAM words) with the smallest hash is its anchor, so equal windows
   have equal anchors, and anchors are few.  Anchors are counted; those that occur once can't
   be in a repeated window.  The others set bits in a bitmap of a fixed 2^BITMAP bits.
3. Confirmation: windows whose anchor's bit is set are grouped by a 127-bit hash.  A window that
   starts at two places or more is confirmed, its smallest place stands for it, and every shard
   that holds it is noted.  Equal windows of one shard travel as one row, so a window that every
   document has makes a row a shard, not a row a document.
4. Compilation: for each shard, the confirmed passages that its documents hold (runs of confirmed windows,
   taken from the texts of their smallest places) are cut into phrases, one every PHRASE words, so
   that every confirmed window holds a whole phrase; an automaton of the phrases is built.
5. Streaming: the shard's documents run through its automaton.  Around each located phrase the windows are
   looked up among the passages' windows and their words compared with the passage's words; words under equal ones go.

The bitmap only saves work: as it fills up, more windows reach step 3, with the same result.

Defined cases: a null or empty text has no words and stays as it is; equal rows are separate
places, so all copies of a long text lose their words; ids may be null or repeated; neither the rows of a partition nor the words of
a text have a bound of their own.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import frozen, partitions, table
from .wordarrays import Words, slices, sliding, window_hashes

WINDOW = 35
GRAM = 24
PHRASE = 18
BITMAP = 26
#: Bytes of text of a shard, as a power of two.
SHARD = 20
_BLOCK = 9


def _placed(docs: DataFrame) -> DataFrame:
    """docs (with a column text) written, with base: the bytes of text, and one for each row, before the row."""

    def run(batches):
        task = TaskContext.get()
        part, before = task.partitionId() if task else 0, 0
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0).to_numpy().astype(np.int64) + 1
            off = before + np.cumsum(size) - size
            before += int(size.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(off), pa.array(off + size)], [*batch.schema.names, "part", "off", "upto"])

    names = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes)
    marked = frozen(docs.mapInArrow(run, f"{names}, part int, off long, upto long"))
    starts, total = [], 0
    for r in sorted(marked.groupBy("part").agg(F.max("upto").alias("n")).toLocalIterator(), key=lambda r: r["part"]):
        starts.append((r["part"], total))
        total += r["n"]
    starts = marked.sparkSession.createDataFrame(starts, "part int, before long")
    numbered = marked.join(F.broadcast(starts), "part")  # a row a partition
    return numbered.withColumn("base", F.col("before") + F.col("off")).drop("part", "before", "off", "upto")


def _inside(w: Words, window: int) -> np.ndarray:
    """Which windows lie in one text."""
    n = max(0, len(w) - window + 1)
    return w.doc[:n] == w.doc[window - 1 :] if n else np.zeros(0, bool)


def _windows(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, hashes and second hashes (63 bits) of all windows, and which of them lie in one text."""
    h = w.hashes()
    first, second = window_hashes(h, window, 1), window_hashes(h, window, 3)
    return h, first, (second >> np.uint64(1)).view(np.int64), _inside(w, window)


def _anchors(h: np.ndarray, inside: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and of every window's anchor (0 for windows that don't lie in one text)."""
    grams = window_hashes(h, gram, 2) | np.uint64(1)
    return grams, np.where(inside, sliding(grams, window - gram + 1), np.uint64(0))


def _count_anchors(window, gram):
    def run(batches):
        for _, raw in slices(batches):
            w = Words(raw)
            if len(w) < window:
                continue
            h = w.hashes()
            inside = _inside(w, window)
            grams, anchor = _anchors(h, inside, window, gram)
            # A gram is an anchor if it is the smallest of some window that holds it.
            reach = window - gram
            padded = np.concatenate([np.zeros(reach, np.uint64), anchor, np.zeros(reach, np.uint64)])
            hashes, n = np.unique(grams[sliding(padded, reach + 1, np.maximum) == grams], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["h", "n"])

    return run


def bitmap(repeated: DataFrame, bits: int = BITMAP) -> np.ndarray:
    """2^bits bits, set at the low bits of the hashes in h: at most 2^(bits - 6) words come to the driver, whatever the input."""
    slot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = repeated.groupBy(F.shiftright(slot, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((h & {(1 << bits) - 1}L) & 63 as int))")).alias("w")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["at"].to_numpy()] = words["w"].to_numpy().view(np.uint64)
    return out


def _hits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(len(bits) * 64 - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _candidates(bits, window, gram, shard_bits):
    """Windows whose anchor may repeat: hash, second hash * 2 + (more than once here), the smallest place of the shard's rows at hand."""

    def run(batches):
        for batch, raw in slices(batches):
            w = Words(raw)
            if len(w) < window:
                continue
            h, first, second, inside = _windows(w, window)
            _, anchor = _anchors(h, inside, window, gram)
            at = np.flatnonzero(inside & _hits(bits.value, anchor))
            if not len(at):
                continue
            base, pos = batch.column("base").to_numpy()[w.doc[at]], at - w.first[w.doc[at]]
            shard, first, second = base >> shard_bits, first[at], second[at]
            order = np.lexsort((pos, base, second, first))
            first, second, base, pos, shard = (x[order] for x in (first, second, base, pos, shard))
            new = np.ones(len(first), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (shard[1:] != shard[:-1])
            begin = np.flatnonzero(new)
            more = np.diff([*begin, len(first)]) > 1
            yield pa.RecordBatch.from_arrays([pa.array(first[begin].view(np.int64)), pa.array(second[begin] << 1 | more), pa.array(base[begin]), pa.array(pos[begin].astype(np.int32))], ["h", "s", "base", "pos"])

    return run


def _confirm(shard_bits):
    """Rows sorted by hash: (shard, base, pos) for every shard that holds a confirmed window, base and pos being its smallest place."""

    def run(batches):
        key, held, kept = None, None, False

        def out(shard, base, pos):
            return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(base), pa.array(pos)], ["shard", "base", "pos"])

        for batch in batches:
            if not batch.num_rows:
                continue
            h, s, base, pos = (batch.column(i).to_numpy() for i in range(4))
            second, more = s >> 1, (s & 1).astype(bool)
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (second[1:] != second[:-1])
            if key == (h[0], second[0]):
                # The run of the batch before goes on: its first row is sent now if it wasn't confirmed yet.
                new[0] = False
                if not kept:
                    yield out(np.array([held[0] >> shard_bits]), np.array([held[0]]), np.array([held[1]], np.int32))
                    kept = True
            begin = np.flatnonzero(new)
            group = np.cumsum(new) - 1  # -1: the run that goes on
            going = group < 0
            size = np.bincount(group[~going], minlength=len(begin))
            sure = (size > 1) | more[begin]
            if len(begin):
                at = begin[np.maximum(group, 0)]
                keep = going | sure[np.maximum(group, 0)]
                least = np.where(going, held[0], base[at]) if going.any() else base[at]
                place = np.where(going, held[1], pos[at]) if going.any() else pos[at]
            else:
                keep, least, place = going, np.full(len(h), held[0]), np.full(len(h), held[1])
            if keep.any():
                yield out(base[keep] >> shard_bits, least[keep], place[keep].astype(np.int32))
            if len(begin):
                last = begin[-1]
                key, held, kept = (h[last], second[last]), (base[last], pos[last]), bool(sure[-1])

    return run


def _blocks(sources, window):
    """The words of texts that windows are taken from, in blocks of positions with the rest of their last windows."""

    def run(batches):
        for batch in batches:
            chosen = batch.filter(pa.array(_hits(sources.value, batch.column("hash").to_numpy().view(np.uint64))))
            at, block, text = [], [], []
            for place, t in zip(chosen.column("base").to_pylist(), chosen.column("text").to_pylist(), strict=True):
                words = (t or "").encode().split()
                for i in range(0, len(words) - window + 1, 1 << _BLOCK):
                    at.append(place)
                    block.append(i >> _BLOCK)
                    text.append(b" ".join(words[i : i + (1 << _BLOCK) + window - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(block, pa.int32()), pa.array(text, pa.string())], ["base", "block", "text"])

    return run


def _passages(window):
    """Rows of (block, text, places of confirmed windows in it with the shards that need them): passages by shard."""

    def run(batches):
        for batch in batches:
            shards, texts = [], []
            for i in range(batch.num_rows):
                words = batch.column("text")[i].as_py().encode().split()
                shard = batch.column("shards")[i].values.to_numpy()
                pos = batch.column("positions")[i].values.to_numpy() - (batch.column("block")[i].as_py() << _BLOCK)
                order = np.lexsort((pos, shard))
                shard, pos = shard[order], pos[order]
                new = np.ones(len(pos), bool)
                new[1:] = (shard[1:] != shard[:-1]) | (pos[1:] > pos[:-1] + 1)
                begin = np.flatnonzero(new)
                end = pos[np.concatenate([begin[1:] - 1, [len(pos) - 1]])] + window
                shards += shard[begin].tolist()
                texts += [b" ".join(words[s:e]).decode() for s, e in zip(pos[begin].tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(texts, pa.string())], ["shard", "text"])

    return run


class Automaton:
    """Phrases of some passages, and the passages' windows by their hashes."""

    def __init__(self, passages: list[bytes], window: int, phrase: int):
        self.window, self.phrase = window, phrase
        self.find = ahocorasick.Automaton()
        self.words = w = Words(passages)
        for d in range(len(passages)):
            for s in range(int(w.first[d]), int(w.first[d + 1]) - phrase + 1, phrase):
                text = w.data[w.start[s] : w.end[s + phrase - 1]].tobytes().decode("latin-1")
                self.find.add_word(f" {text} ", 1)
        self.find.make_automaton()
        _, first, second, inside = _windows(w, window)
        at = np.flatnonzero(inside)
        order = np.lexsort((second[at], first[at]))
        self.at = at[order]
        self.first, self.second = first[self.at], second[self.at]

    def _same(self, w: Words, mine: int, other: int, n: int) -> bool:
        """Whether n words of w from mine on are the passages' words from other on; passages have one blank between words."""
        p = self.words
        text = w.data[w.start[mine] : w.end[mine + n - 1]].tobytes()
        want = p.data[p.start[other] : p.end[other + n - 1]].tobytes()
        return text == want or b" ".join(text.split()) == want

    def confirmed(self, w: Words, at: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Which windows of w, at some places, have the words of a passage's window."""
        place = np.searchsorted(self.first, first)
        ok, todo = np.zeros(len(at), bool), np.arange(len(at))
        while len(todo):  # equal first hashes stand next to each other
            live = place[todo] < len(self.first)
            todo = todo[live]
            todo = todo[self.first[place[todo]] == first[todo]]
            some = todo[self.second[place[todo]] == second[todo]]
            mine, other = at[some], self.at[place[some]]
            # Windows next to each other here and in the passages are compared as one run.
            new = np.ones(len(some), bool)
            new[1:] = (mine[1:] != mine[:-1] + 1) | (other[1:] != other[:-1] + 1)
            for s, e in zip(np.flatnonzero(new).tolist(), [*np.flatnonzero(new)[1:].tolist(), len(some)], strict=True) if len(some) else ():
                if self._same(w, mine[s], other[s], e - s + self.window - 1):
                    ok[some[s:e]] = True
                else:
                    for i in range(s, e):
                        ok[some[i]] |= self._same(w, mine[i], other[i], self.window)
            todo = todo[~ok[todo]]
            place[todo] += 1
        return ok

    def remove(self, texts: list[bytes]) -> tuple[Words, np.ndarray]:
        """The words of texts, and which of them are to be removed."""
        w = Words(texts)
        gone = np.zeros(len(w), bool)
        if not len(self.first):
            return w, gone
        _, first, second, inside = _windows(w, self.window)
        near = np.zeros(len(first) + 1, np.int64)
        for d in np.flatnonzero(w.count >= self.window):
            a, b = int(w.first[d]), int(w.first[d + 1])
            joined = b" ".join([b"", *texts[d].split(), b""]).decode("latin-1")
            ends = np.fromiter((e for e, _ in self.find.iter(joined)), np.int64)
            if not len(ends):
                continue
            size = w.end[a:b] - w.start[a:b] + 1
            after = np.cumsum(size)  # the blank after each word
            last = np.searchsorted(after, ends) + a
            start = last - self.phrase + 1
            low, high = np.maximum(start + self.phrase - self.window, a), np.minimum(start, b - self.window)
            ok = low <= high
            np.add.at(near, low[ok], 1)
            np.add.at(near, high[ok] + 1, -1)
        at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & inside) if len(first) else np.zeros(0, np.int64)
        at = at[self.confirmed(w, at, first[at], second[at])]
        edge = np.zeros(len(w) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.window, -1)
        gone[:] = np.cumsum(edge)[:-1] > 0
        return w, gone


def _stream(window, phrase, emit):
    """Rows sorted by shard, passages (kind 0) before documents (kind 1)."""

    def run(batches):
        shard, passages, automaton = None, [], None
        for batch, raw in slices(batches):
            shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, len(shards)], strict=True):
                if s == e:
                    continue
                if shards[s] != shard:
                    shard, passages, automaton = shards[s], [], None
                if not kinds[s]:
                    passages += raw[s:e]
                    continue
                automaton = automaton or Automaton(passages, window, phrase)
                passages = []
                texts = raw[s:e]
                yield emit(batch.slice(s, e - s), texts, *automaton.remove(texts))

    return run


def _repeated(docs: DataFrame, emit, schema: str, window: int, gram: int, phrase: int, bits: int, shard_bits: int, extra: list[str]) -> DataFrame:
    """emit's rows for all documents; docs has the columns id, text and extra."""
    spark = docs.sparkSession
    n = partitions(spark)
    placed = _placed(docs)
    anchors = placed.select("text").mapInArrow(_count_anchors(window, gram), "h long, n int")
    repeated = anchors.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    filled = spark.sparkContext.broadcast(bitmap(repeated, bits))
    found = placed.select("base", "text").mapInArrow(_candidates(filled, window, gram, shard_bits), "h long, s long, base long, pos int")
    rows = frozen(found.repartition(n, "h").sortWithinPartitions("h", F.shiftright("s", 1), "base", "pos").mapInArrow(_confirm(shard_bits), "shard long, base long, pos int"))
    # Confirmed windows by the document and block of positions they are taken from, for 64 shards at a time.
    key = ("base", F.shiftright("pos", _BLOCK).alias("block"))
    wanted = rows.groupBy(*key, F.shiftright("shard", 6).alias("group")).agg(F.collect_list(F.struct("shard", "pos")).alias("c"))
    wanted = wanted.select("base", "block", F.col("c.shard").alias("shards"), F.col("c.pos").alias("positions"))
    sources = spark.sparkContext.broadcast(bitmap(rows.select(F.xxhash64("base").alias("h")).distinct(), bits))
    places = placed.select("base", F.xxhash64("base").alias("hash"), "text").mapInArrow(_blocks(sources, window), "base long, block int, text string")
    passages = places.join(wanted, ["base", "block"]).mapInArrow(_passages(window), "shard long, text string")
    names = ["id", *extra]
    kinds = dict(docs.dtypes)
    passages = passages.select("shard", F.lit(0).alias("kind"), "text", *(F.lit(None).cast(kinds[c]).alias(c) for c in names))
    documents = placed.select(F.shiftright("base", shard_bits).alias("shard"), F.lit(1).alias("kind"), "text", *names)
    both = passages.union(documents)
    return both.repartition(n, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_stream(window, phrase, emit), schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, phrase: int = PHRASE, bits: int = BITMAP, shard_bits: int = SHARD) -> DataFrame:
    """id, n_words, n_removed and kept_sha256 (of the kept words joined by blanks) of each row."""

    def emit(batch, texts, w, gone):
        kept = []
        for d, t in enumerate(texts):
            g = gone[w.first[d] : w.first[d + 1]]
            words = t.split()
            kept.append(hashlib.sha256(b" ".join([x for x, k in zip(words, g, strict=True) if not k] if g.any() else words)).hexdigest())
        removed = np.add.reduceat(np.concatenate([gone, [0]]).astype(np.int64), w.first[:-1]) * (w.count > 0) if len(texts) else w.count
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(w.count.astype(np.int64)), pa.array(removed), pa.array(kept)], [id_col, "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _repeated(rows, emit, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, n_removed long, kept_sha256 string", window, gram, phrase, bits, shard_bits, [])


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM, phrase: int = PHRASE, bits: int = BITMAP, shard_bits: int = SHARD) -> DataFrame:
    """docs with repeated passages taken out of the texts; what stands between kept words stays, texts without one stay as they are."""
    others = [c for c in docs.columns if c != text_col]
    safe = [f"c{i}" for i in range(len(others))]

    def emit(batch, texts, w, gone):
        out = batch.column("text").to_pylist()
        for d in np.flatnonzero(np.bincount(w.doc[gone], minlength=len(texts))):
            a, b = int(w.first[d]), int(w.first[d + 1])
            keep = ~gone[a:b]
            base = int(w.text_start[d])
            # Each kept word with the white space before it.
            before = np.concatenate([[base], w.end[a : b - 1]])
            parts = [w.data[s:e].tobytes() for s, e in zip(before[keep], w.end[a:b][keep], strict=True)]
            out[d] = b"".join(parts).strip().decode()
        columns = {text_col: pa.array(out, pa.string()), **{o: batch.column(s) for o, s in zip(others, safe, strict=True)}}
        return pa.RecordBatch.from_arrays([columns[c] for c in docs_columns], docs_columns)

    docs_columns = docs.columns
    rows = docs.select(F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(f"`{o}`").alias(s) for o, s in zip(others, safe, strict=True)))
    return _repeated(rows, emit, docs.schema, window, gram, phrase, bits, shard_bits, safe)


def op3_passages(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM starts),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM win SEMI JOIN rep USING (h)),
gl AS (SELECT doc_id, count(*) AS n_removed, list(i) AS g FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(g, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gl USING (doc_id)
"""
