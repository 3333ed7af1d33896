"""Personal data: patterns with checks, and a linear-chain CRF over word shapes for what they miss.

Patterns find emails, IPv4 addresses, payment cards (Luhn) and international phone numbers.
A conditional random field, trained here from a small labelled table, labels every word; its
runs of one label become further spans where no pattern matched, e.g. phone numbers without a
plus sign and spelled-out emails.  Words are described by their shape only.  Decoding is exact
Viterbi over all sequences (whole lines) of a batch at once; a long line is decoded in pieces, chained by
the best scores between their ends, which gives the labels of the whole line.

Defined cases: a null text is an empty one and has no spans; repeated rows are scanned each on
its own; other columns of the input are ignored by find_pii and kept by redact.
"""

from __future__ import annotations

import functools
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import Disjoint, code_points
from .wordarrays import Words, slices

KINDS = ("email", "ip", "card", "phone")
_ORDER = {k: i for i, k in enumerate(KINDS)}
PATTERNS = {
    # An email is looked for from its sign; the part before it is found by going back.
    "email": re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    # What fails from a run's first digit fails from its others too.
    "ip": re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DIGIT = re.compile(r"[0-9]")
_LOCAL = string.ascii_letters + string.digits + "._%+-"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in found.split("."))
    digits = "".join(c for c in found if "0" <= c <= "9")
    return 9 <= len(digits) <= 15 if kind == "phone" else 12 <= len(digits) <= 19 and _luhn(digits)


def _matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches without overlaps, in time proportional to the text's length."""
    if kind != "email":
        for m in PATTERNS[kind].finditer(text):
            yield m.span()
        return
    after = 0
    at = text.find("@")
    while at >= 0:
        start = after + len(text[after:at].rstrip(_LOCAL))
        m = PATTERNS[kind].match(text, at) if start < at else None
        if m:
            yield start, m.end()
        after = m.end() if m else at + 1
        at = text.find("@", after)


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the matches that pass their checks, by start, then kind."""
    kinds = ("email",) * ("@" in text) + ("ip", "card", "phone") * bool(_DIGIT.search(text))
    found = [(k, s, e) for k in kinds for s, e in _matches(k, text) if _valid(k, text[s:e])]
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]]))


# ---------------------------------------------------------------- word shapes

# What a byte says of the shape of its word.
_DIGITS, _AT, _DOT, _PLUS, _DASH, _PAREN, _LETTER = range(7)
_CLASS = np.zeros((7, 256), np.int32)
_CLASS[_DIGITS, 48:58] = 1
for _row, _chars in ((_AT, b"@"), (_DOT, b"."), (_PLUS, b"+"), (_DASH, b"-/"), (_PAREN, b"()[]<>")):
    _CLASS[_row, list(_chars)] = 1
_CLASS[_LETTER, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CUES = {w: i + 1 for i, group in enumerate((("at", "(at)", "[at]"), ("dot", "(dot)", "[dot]", "punkt", "punto", "point"), ("tel", "phone", "call", "fax", "mobile", "tel:", "phone:", "call:", "fax:", "mobile:"), ("card", "visa", "mastercard", "card:", "visa:"), ("ip", "host", "server", "ip:", "host:", "address:"), ("email", "mail", "e-mail", "email:", "mail:", "e-mail:", "write"), ("com", "org", "net", "edu", "de", "com.", "org.", "net."))) for w in group}
N_CODES = 8 * 5 * 3 * 2 * 3 * 2 * 2 * 2


def shape_codes(words: Words) -> np.ndarray:
    """A small integer for the shape of each word: counts of digits, dots and dashes, marks, letters, cue group."""
    if not len(words):
        return np.zeros(0, np.int32)
    # Sums between word starts; white space belongs to no class.
    digits, at, dot, plus, dash, paren, letter = (np.add.reduceat(row[words.data], words.start) for row in _CLASS)
    cue = np.zeros(len(words), np.int32)
    length = words.end - words.start
    for i in np.flatnonzero((length >= 2) & (length <= 11) & _cue_like(words)):
        cue[i] = _CUES.get(words.data[words.start[i] : words.end[i]].tobytes().decode("ascii", "replace").lower(), 0)
    code = cue
    for value, n in ((np.digitize(digits, (1, 3, 5, 9)), 5), (np.minimum(dot, 2), 3), (np.minimum(at, 1), 2), (np.minimum(dash, 2), 3), (np.minimum(plus, 1), 2), (np.minimum(paren, 1), 2), (np.minimum(letter, 1), 2)):
        code = code * n + value
    return code.astype(np.int32)


@functools.cache
def _cue_table() -> np.ndarray:
    out = np.zeros((256, 256), bool)
    for w in _CUES:
        for a in {w[0], w[0].upper()}:
            for b in {w[1], w[1].upper()}:
                out[ord(a), ord(b)] = True
    return out


def _cue_like(words: Words) -> np.ndarray:
    """Words whose first two and whose last bytes might be a cue's."""
    last = np.zeros(256, bool)
    last[[ord(c) for w in _CUES for c in {w[-1], w[-1].upper()}]] = True
    return _cue_table()[words.data[words.start], words.data[np.minimum(words.start + 1, len(words.data) - 1)]] & last[words.data[words.end - 1]]


# ---------------------------------------------------------------- the field

LABELS = ("O", *KINDS)
N_LABELS = len(LABELS)


def viterbi(emission: np.ndarray, start: np.ndarray, length: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The best label of every word; sequence i has rows start[i] to start[i] + length[i] of emission."""
    path = np.zeros(len(emission), np.uint8)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    most = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(most), side="left")  # sequences longer than t
    back, final, score = [], np.zeros((len(start), N_LABELS), np.float32), None
    for t in range(most):
        n = active[t]
        now = emission[start[:n] + t]
        if t:
            with_step = score[:n, :, None] + transition
            back.append(with_step.argmax(1).astype(np.uint8))
            now = now + with_step.max(1)
        score = now
        ended = active[t + 1] if t + 1 < most else 0
        final[ended:n] = score[ended:n]
    label = final.argmax(1).astype(np.uint8)
    for t in range(most - 1, -1, -1):
        n = active[t]
        path[start[:n] + t] = label[:n]
        if t:
            label[:n] = back[t - 1][np.arange(n), label[:n]]
    return path


def _between(emission: np.ndarray, start: np.ndarray, length: np.ndarray, transition: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The best score of each piece by the label before it (none before pieces that open a sequence) and its last label."""
    order = np.argsort(-length, kind="stable")
    begin, size = start[order], length[order]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")
    step = transition.astype(np.float64)
    score = np.where(opens[order][:, None, None], 0.0, step) + emission[begin][:, None]
    for t in range(1, int(size[0])):
        n = active[t]
        score[:n] = (score[:n, :, :, None] + step).max(2) + emission[begin[:n] + t][:, None]
    out = np.empty_like(score)
    out[order] = score
    return out


def decode(emission: np.ndarray, start: np.ndarray, length: np.ndarray, transition: np.ndarray, piece: int = 256) -> np.ndarray:
    """viterbi()'s labels of whole sequences, in about as many steps as a piece has words.

    The pieces of a long sequence are scored for every label before them and every last label; the
    best chain of these fixes the labels at the pieces' ends, and each piece is decoded between them.
    """
    pieces = -(-length // piece)
    if not (pieces > 1).any():
        return viterbi(emission, start, length, transition)
    line = np.repeat(np.arange(len(start)), pieces)
    within = np.arange(len(line)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at, size = start[line] + within * piece, np.minimum(piece, length[line] - within * piece)
    cut = np.flatnonzero(pieces[line] > 1)
    opens = within[cut] == 0
    between = _between(emission, at[cut], size[cut], transition, opens)
    back, score = np.zeros((len(cut), N_LABELS), np.int64), None
    last = np.zeros(len(cut), np.int64)
    for i in range(len(cut)):
        chained = between[i] if opens[i] else score[:, None] + between[i]
        back[i], score = chained.argmax(0), chained.max(0)
        last[i] = score.argmax()
    for i in range(len(cut) - 1, 0, -1):
        if not opens[i]:
            last[i - 1] = back[i, last[i]]
    emission = emission.copy()
    inner = np.flatnonzero(~opens)
    emission[at[cut[inner]]] += transition[last[inner - 1]]
    ends = at[cut] + size[cut] - 1
    fixed = emission[ends, last]
    emission[ends] = -np.inf
    emission[ends, last] = fixed
    return viterbi(emission, at, size, transition)


class Crf:
    """Weights by label of a word's shape and of its neighbours' shapes, and of label pairs."""

    def __init__(self, own, before, after, transition):
        self.own, self.before, self.after, self.transition = own, before, after, transition

    def emission(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """first: True where a sequence begins."""
        out = self.own[codes]
        if len(codes) > 1:
            inner = ~first[1:, None]
            out[1:] += self.before[codes[:-1]] * inner
            out[:-1] += self.after[codes[1:]] * inner
        return out


def sequences(words: Words) -> np.ndarray:
    """Index of each sequence's first word: a text's or a line's first word."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    lines = np.cumsum(words.data == 10)
    line = lines[words.start]
    new = np.ones(n, bool)
    new[1:] = line[1:] != line[:-1]
    return np.flatnonzero(new)


#: The labelled table: words with {kind: words}; each line is one sequence.
LABELLED = """
call me on {phone:(415) 555-0132} after lunch
tel {phone:020 7946 0958} or leave a note
phone: {phone:555-867-5309}
our fax: {phone:(030) 555-1234-77} is open all day
you can call {phone:(212) 555 0187} any time
mobile {phone:0171 5550 1987} is mine
the desk has {phone:+44 20 7946 0958} as number
dial {phone:+1 (017) 555-7713} now
reach us under {phone:+49-30-5550-123} in the morning
write {email:jane dot doe at example dot org} for more
mail {email:info (at) example (dot) com} soon
email: {email:bob at mail dot net}
ask me, or {email:ann at host dot com.} thanks
now, or {email:tom at place dot org,} please
{email:kim at corp dot net}
send it to {email:carol.smith@example.com} please
a note from {email:77@mail5.example.net} came in
e-mail {email:sales [at] shop [dot] com} about it
server {ip:10.2.33.4} is down again
the host {ip:192.168.0.77} did not answer
from {ip:203.0.113.9} to here
card {card:4539 1488 0343 6467} was used
paid by visa {card:4485-2757-4230-8327} on that day
mastercard: {card:5425233430109903} is on file
number {card:4007000000027} here
in 1984 there were 12 people at the house
he was at home and the dot on the map was red
chapter 3 of book 17 has 221 pages
about 45,000 people came to the city in 2004
version 2.0 of the license and version 3.
the price is 19.99 or 1,250.00 in all
see section 4.2.1 for the rest of it
licensed under cc by-nc 4.0.
token = "908038b7daaf91e730d2f64001c52934d43d9336" there
we meet at noon at the north gate
a mail came by train and the server was new
the card is red and the host was kind
born on 12/05/1977 in the old town
from 10-12 to 14-16 they work
one two three four five six seven
words of plain text and no numbers at all
well-known half-way up-to-date things (and more) are here
this and that | and | more ### of *** it %%% &&& $$$
THE!! BIG!! ONES!! ARE!! HERE!!
der die das und nicht an der stelle
la de el los una ciudad de la sierra
le un de la est une ville du nord
42
2021-03-04 10:22 it began
call of the wild and mail order at the dot com age
id 77812 and id 99120 were sent
phone calls and visa rules at the border
score 3-2 and 104-99 in the end
""".strip().splitlines()


def _labelled() -> Iterator[tuple[list[str], list[int]]]:
    for line in LABELLED:
        words, labels = [], []
        for part in re.split(r"(\{[^}]*\})", line):
            m = re.fullmatch(r"\{(\w+):(.*)\}", part)
            these = (m[2] if m else part).split()
            words += these
            labels += [LABELS.index(m[1]) if m else 0] * len(these)
        yield words, labels


@functools.cache
def train(rounds: int = 400, rate: float = 0.5, decay: float = 5e-4) -> Crf:
    """Maximum likelihood with a squared penalty, by gradient steps over forward-backward sums."""
    data = []
    for words, labels in _labelled():
        w = Words([" ".join(words).encode()])
        data.append((shape_codes(w), np.array(labels)))
    used = np.unique(np.concatenate([c for c, _ in data]))
    at = np.full(N_CODES, -1)
    at[used] = np.arange(len(used))
    k = len(used)
    own, before, after = (np.zeros((k, N_LABELS)) for _ in range(3))
    trans = np.zeros((N_LABELS, N_LABELS))
    memory = [np.full_like(x, 1e-6) for x in (own, before, after, trans)]
    for _ in range(rounds):
        grads = [-decay * x * len(data) for x in (own, before, after, trans)]
        for codes, gold in data:
            c, n = at[codes], len(codes)
            e = own[c].copy()
            e[1:] += before[c[:-1]]
            e[:-1] += after[c[1:]]
            alpha, beta = np.zeros((n, N_LABELS)), np.zeros((n, N_LABELS))
            alpha[0] = e[0]
            for t in range(1, n):
                alpha[t] = e[t] + np.logaddexp.reduce(alpha[t - 1][:, None] + trans, axis=0)
            for t in range(n - 2, -1, -1):
                beta[t] = np.logaddexp.reduce(trans + (e[t + 1] + beta[t + 1])[None], axis=1)
            z = np.logaddexp.reduce(alpha[-1])
            miss = -np.exp(alpha + beta - z)
            miss[np.arange(n), gold] += 1
            np.add.at(grads[0], c, miss)
            np.add.at(grads[1], c[:-1], miss[1:])
            np.add.at(grads[2], c[1:], miss[:-1])
            for t in range(1, n):
                grads[3] -= np.exp(alpha[t - 1][:, None] + trans + (e[t] + beta[t])[None] - z)
                grads[3][gold[t - 1], gold[t]] += 1
        for x, g, m in zip((own, before, after, trans), grads, memory):
            m += g * g
            x += rate * g / np.sqrt(m)
    full = []
    for x in (own, before, after):
        table = np.zeros((N_CODES, N_LABELS), np.float32)
        table[used] = x
        full.append(table)
    full[0][at < 0, 0] += 1.0  # an unseen shape leans to no label
    return Crf(*full, trans.astype(np.float32))


_TRIM = b".,;:!?\"'`*#$%&|"


def _plausible(kind: str, span: bytes) -> bool:
    digits = sum(48 <= b < 58 for b in span)
    if kind == "email":
        low = span.lower()
        return b"@" in span or bool(re.search(rb"(?:^|\s)[(\[]?at[)\]]?\s", low) and re.search(rb"\s[(\[]?dot[)\]]?\s", low))
    if kind == "ip":
        return digits >= 4 and span.count(b".") == 3
    return 7 <= digits <= 15 if kind == "phone" else 12 <= digits <= 19


def crf_spans(words: Words, model: Crf) -> list[tuple[int, str, int, int]]:
    """(text index, kind, start byte, end byte) of runs that the field labels and that hold what their kind needs."""
    begin = sequences(words)
    if not len(begin):
        return []
    first = np.zeros(len(words), bool)
    first[begin] = True
    codes = shape_codes(words)
    label = decode(model.emission(codes, first), begin, np.diff([*begin, len(words)]), model.transition)
    edge = np.ones(len(words), bool)
    edge[1:] = (label[1:] != label[:-1]) | first[1:]
    runs = np.flatnonzero(edge)
    ends = np.concatenate([runs[1:], [len(words)]])
    out = []
    for i in np.flatnonzero(label[runs]):
        d = int(words.doc[runs[i]])
        base = int(words.text_start[d])
        s, e = int(words.start[runs[i]]) - base, int(words.end[ends[i] - 1]) - base
        text = words.texts[d]
        while s < e and text[s] in _TRIM:
            s += 1
        while s < e and text[e - 1] in _TRIM:
            e -= 1
        if _plausible(kind := LABELS[label[runs[i]]], text[s:e]):
            out.append((d, kind, s, e))
    return out


def _cover(spans: list) -> Disjoint:
    """The positions that spans (by start) cover."""
    out: list[tuple[int, int]] = []
    for _, s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return Disjoint(out)


def scan(texts: list[bytes], model: Crf) -> list[tuple[list, list]]:
    """For each text its pattern spans and all spans, as (kind, start, end) in code points."""
    more: dict[int, list] = {}
    for d, kind, s, e in crf_spans(Words(texts), model):
        more.setdefault(d, []).append((kind, s, e))
    out = []
    for d, raw in enumerate(texts):
        if d not in more and not any(c in raw for c in b"@0123456789"):
            out.append(([], []))
            continue
        base = pattern_spans(raw.decode())
        spans = list(base)
        if d in more:
            # Spans of different kinds may overlap in the patterns; what the field adds overlaps none of them.
            taken, at = _cover(base), code_points(raw)
            for kind, s, e in more[d]:
                s, e = int(at[s]), int(at[e])
                if taken.free(s, e):
                    spans.append((kind, s, e))
        out.append((base, sorted(spans, key=lambda x: (x[1], _ORDER[x[0]], x[2]))))
    return out


def joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, counts of pattern spans by kind, base (list as text), spans (list as text), n_crf."""
    model = train()

    def run(batches):
        for batch, raw in slices(batches):
            found = scan(raw, model)
            yield pa.RecordBatch.from_pydict(
                {
                    id_col: batch.column(id_col),
                    **{f"n_{k}": pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS},
                    "base": pa.array([joined(base) for base, _ in found], pa.string()),
                    "spans": pa.array([joined(spans) for _, spans in found], pa.string()),
                    "n_crf": pa.array([len(spans) - len(base) for base, spans in found], pa.int64()),
                }
            )

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base string, spans string, n_crf long"
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span, from patterns or the field, replaced by its kind in brackets; other texts untouched, null stays null."""
    model, names = train(), docs.columns

    def run(batches):
        for batch, raw in slices(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            for i, (_, spans) in enumerate(scan(raw, model)):
                out, at = [], 0
                for kind, s, e in spans:
                    if s >= at:
                        out += [texts[i][at:s], f"[{kind.upper()}]"]
                    at = max(at, e)
                if spans:
                    texts[i] = "".join([*out, texts[i][at:]])
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(c).type) if c == text_col else batch.column(c) for c in names], names)

    return docs.mapInArrow(run, docs.schema)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    from .frames import table

    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_crf")
