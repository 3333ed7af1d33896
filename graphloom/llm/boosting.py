"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counts over the whole text, made with array operations.  Trees are fitted on at
most FIT_ROWS labelled documents (those whose hash is smallest, none of them held out), with
features cut into bins, and flattened into arrays; scoring walks all rows of a batch through each
tree at once with numpy.

Defined cases: a null or empty text has statistics zero and is scored like any other; repeated
documents are scored each on its own, and of those that repeat an id one is learned from; a document with several labels counts as good if all are 1; null
labels and labels without a document are left out; without any usable label every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import frozen, table
from .wordarrays import Words, slices

FIT_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = ("n_words", "word_length", "long_words", "symbols", "upper", "digits", "marks", "bars", "exclaims", "non_ascii", "lines", "dup_lines", "types", "top_word", "same_as_last", "line_length")
_CLASSES = np.zeros((8, 256), bool)
_CLASSES[0, list(b"#*$%&<>{}[]\\^~=_@")] = True
_CLASSES[1, 65:91] = True
_CLASSES[2, 48:58] = True
_CLASSES[3, list(b".,;:?'\"()-")] = True
_CLASSES[4, list(b"|")] = True
_CLASSES[5, list(b"!")] = True
_CLASSES[6, 0xC0:256] = True
_CLASSES[7, list(b"\n")] = True


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES per text: shares and averages over the whole text."""
    w = Words(texts)
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    bounds = w.text_start
    sums = [np.concatenate([[0], np.cumsum(row[w.data])])[bounds] for row in _CLASSES]
    counts = [np.diff(s) for s in sums]
    counts[7] = counts[7] - 1  # the newline after each text
    letters = np.zeros(n)
    words = np.maximum(w.count, 1)
    length = w.end - w.start
    if len(w):
        np.add.at(letters, w.doc, length)
        hashes = w.hashes()
        order = np.lexsort((hashes, w.doc))
        h, d = hashes[order], w.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        begin = np.flatnonzero(new)
        size = np.diff([*begin, len(h)])
        types = np.bincount(d[begin], minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, d[begin], size)
        same = np.zeros(len(h), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
        out[:, 2] = np.bincount(w.doc, length >= 12, n) / words
        out[:, 12], out[:, 13], out[:, 14] = types / words, top / words, np.bincount(w.doc, same, n) / words
    size = np.maximum(letters, 1)
    out[:, 0], out[:, 1] = np.log1p(w.count), letters / words
    for column, i in ((3, 0), (4, 1), (5, 2), (6, 3), (7, 4), (8, 5), (9, 6)):
        out[:, column] = counts[i] / size
    out[:, 10] = np.log1p(counts[7])
    for i in np.flatnonzero(counts[7] > 0):
        lines = [x for x in texts[i].split(b"\n") if x.strip()]
        out[i, 11] = 1 - len(set(lines)) / max(1, len(lines))
    out[:, 15] = np.log1p(letters / (counts[7] + 1))
    return out


class Boosted:
    """Trees as arrays: node k of all trees asks whether feature[k] <= cut[k] and goes to left[k], else left[k] + 1; leaves have left -1."""

    def __init__(self, base: float, roots, feature, cut, left, value):
        self.base, self.roots, self.feature, self.cut, self.left, self.value = base, roots, feature, cut, left, value

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                inner = self.left[node] >= 0
                if not inner.any():
                    break
                at = node[inner]
                right = x[rows[inner], self.feature[at]] > self.cut[at]
                node[inner] = self.left[at] + right
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, penalty: float = 1.0) -> Boosted:
    """Logistic boosting with second-order gains on binned features."""
    if not len(y):
        return Boosted(0.0, [], *(np.zeros(1, t) for t in (int, float)), np.array([-1]), np.zeros(1))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    total = np.full(len(y), base)
    roots, feature, cut, left, value = [], [], [], [], []

    def node() -> int:
        for column, start in ((feature, 0), (cut, 0.0), (left, -1), (value, 0.0)):
            column.append(start)
        return len(left) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        roots.append(node())
        todo = [(roots[-1], np.arange(len(y)), 0)]
        while todo:
            at, rows, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * least:
                for f in range(x.shape[1]):
                    if not len(edges[f]):
                        continue
                    b = binned[rows, f]
                    gl = np.cumsum(np.bincount(b, g[rows], len(edges[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(edges[f]) + 1))[:-1]
                    n = np.cumsum(np.bincount(b, minlength=len(edges[f]) + 1))[:-1]
                    gain = gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty)
                    gain[(n < least) | (len(rows) - n < least)] = -1
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], (f, i))
            if best[1] is None:
                value[at] = rate * gs / (hs + penalty)
                total[rows] += value[at]
                continue
            f, i = best[1]
            feature[at], cut[at] = f, float(edges[f][i])
            goes = binned[rows, f] <= i
            left[at] = node()
            node()
            todo += [(left[at], rows[goes], level + 1), (left[at] + 1, rows[~goes], level + 1)]
    return Boosted(base, roots, np.array(feature), np.array(cut), np.array(left), np.array(value))


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and f, the array of FEATURES, of each row."""

    def run(batches):
        for batch, raw in slices(batches):
            x = features(raw)
            f = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), f], [id_col, "f"])

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, f array<double>")


def sample(labels: DataFrame, id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> DataFrame:
    """id, quality: the fit_rows labelled ids outside the held-out fifth whose hash is smallest."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min("quality").alias("quality"))
    return known.orderBy(F.xxhash64(id_col), id_col).limit(fit_rows)


def train(stats: DataFrame, known: DataFrame, id_col: str = "doc_id") -> Boosted:
    """Fitted on known, at most fit_rows labels, which is also the bound of what is broadcast and collected: of documents that repeat an id one counts."""
    named = stats.join(F.broadcast(known), id_col).groupBy(id_col).agg(F.max("f").alias("f"), F.max("quality").alias("quality"))
    rows = named.orderBy(id_col).select("f", "quality").toArrow().combine_chunks()
    x = rows["f"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, (rows["quality"].to_numpy() == 1).astype(float))


def score(stats: DataFrame, model: Boosted, id_col: str = "doc_id") -> DataFrame:
    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], [id_col, "score"])

    return stats.select(id_col, "f").mapInArrow(run, f"`{id_col}` {dict(stats.dtypes)[id_col]}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """id, held_out, score, predicted of each row of docs."""
    stats = frozen(statistics(docs, id_col, text_col))
    scored = score(stats, train(stats, sample(labels, id_col, fit_rows), id_col), id_col)
    out = F.coalesce(held_out(id_col), F.lit(False))
    return scored.select(id_col, out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Rows of docs that the classifier doesn't reject, with all columns."""
    known = frozen(sample(labels, id_col, fit_rows))
    model = train(statistics(docs.join(F.broadcast(known.select(id_col)), id_col, "left_semi"), id_col, text_col), known, id_col)
    names = docs.columns

    def run(batches):
        for batch, raw in slices(batches, text_col):
            good = pa.array(model.score(features(raw)) >= THRESHOLD)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in names], names)

    return docs.mapInArrow(run, docs.schema)


def op8_boosted_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
