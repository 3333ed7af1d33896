"""Secret scans: candidates by form, and a random forest that removes false positives.

A candidate is a run of 16 or more key characters that isn't a plain word, or a value assigned to a
name like password or token.  The forest looks at its length; its character transitions (how surprising each letter is after
the one before it, by the letter pairs of dictionary words, and how often each kind of character follows each other kind); how
much of it dictionary words cover; the path or source it stands in; and the words around it.  It is
trained here on labelled findings, made by rule from a table of forms (LABELLED).  The dictionary is the words among a public
vocabulary's tokens, whose file is a parameter, and the words below.

Defined cases: a null or empty text has no findings; a null path is an empty one; repeated rows
are scanned each on its own; a text of any length is scanned whole, and so is an assigned value of any length.
"""

from __future__ import annotations

import functools
import math
import re
import string

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import table
from .spans import Disjoint, code_points
from .tokens import read_ranks
from .wordarrays import slices

_KINDS = ("sign", "digit", "upper", "lower")
FEATURES = ("length", "entropy", "digits", "upper", "signs", "vowels", "covered", "surprise", "hex", "distinct", "named", "public", "quoted", "assigned", "after", "test_path", "prefix", "parts", "repeat", *(f"{a}_{b}" for a in _KINDS for b in _KINDS))
_RUN = re.compile(rb"[A-Za-z0-9+/_.~-]{16,}={0,2}")
_NAME = rb"(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[:=]{1,2}\s{0,3}[\"']?"
# A value ends at white space or a quote; after 200 characters also where the next assignment begins.
_ASSIGNED = re.compile(rb"(?i)" + _NAME + rb"([^\s\"']{6,200}(?:(?!" + _NAME + rb"[^\s\"']{6})[^\s\"'])*)")
_NAMED = re.compile(rb"(?i)secret|token|passw|pwd|api|key|credential|auth|private|bearer")
_PUBLIC = re.compile(rb"(?i)commit|sha|md5|hash|digest|integrity|uuid|guid|checksum|version|revision|etag|public|example|http|www|path|file|id\b")
_TEST_PATH = re.compile(r"(?i)test|example|sample|mock|fixture|doc")
_PREFIX = re.compile(rb"AKIA[0-9A-Z]{12,}|gh[pousr]_|sk_(?:live|test)_|xox[baprs]-|AIza|eyJ|glpat-|SG\.|-----BEGIN")
#: A small dictionary; what matters is how much of a candidate common words cover.
_WORDS = sorted("able access account action address admin after all and api app area array auth base before block body buffer build button cache call case check child class clean client close code color column commit config connect content control copy count create current data database date default delete detail device display document domain down drop each edit email empty end entry error event example export fail false field file filter find first float folder for format from function get global group handle hash head help here home host html http image import index info init input insert integer item json key label last length level library license line link list load local location log login long main make manager map mark master match max member menu message method min mode model module name net new next node none not null number object offset old open option order output owner page param parent parse part password path pattern place plain play point port post print private process product project property public query queue random range read record region release remove replace report request reset resource response result return root row run sample save schema script search secret section select send server service session set show simple size sort source start state status stop store stream string style submit sum support switch system table target task template temp test text the this time title token tool top total trace tree true type under update upload url user util value version view web width window with word work write year your".split(), key=len, reverse=True)
_KIND = np.zeros(256, np.int8)
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 1, 2, 3


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Byte spans to judge, without overlaps; of overlapping ones the assigned value, then the earlier, stays."""
    found = Disjoint(m.span(1) for m in _ASSIGNED.finditer(text)) if b"=" in text or b":" in text else Disjoint()
    for m in _RUN.finditer(text):
        s, e = m.span()
        while e > s and text[e - 1] in b".-":
            e -= 1
        kinds = set(_KIND[np.frombuffer(text[s:e], np.uint8)].tolist())
        if e - s >= 16 and (1 in kinds or {2, 3} <= kinds):
            found.add(s, e)
    return found.spans


class Dictionary:
    """Words of four letters or more in an automaton, and how surprising each letter is after the one before it, by their letter pairs."""

    def __init__(self, words: set[str]):
        self.find = ahocorasick.Automaton()
        pairs = np.full((26, 26), 0.5)
        for w in words:
            self.find.add_word(w, len(w))
            letters = np.frombuffer(w.encode(), np.uint8).astype(int) - 97
            np.add.at(pairs, (letters[:-1], letters[1:]), 1)
        self.find.make_automaton()
        self.surprise = -np.log2(pairs / pairs.sum(1, keepdims=True))

    def covered(self, low: bytes) -> float:
        """The share of characters that lie in a word."""
        edge = np.zeros(len(low) + 1, np.int64)
        for end, n in self.find.iter(low.decode("latin-1")):
            edge[end + 1 - n] += 1
            edge[end + 1] -= 1
        return float((np.cumsum(edge)[:-1] > 0).mean())

    def surprising(self, low: bytes) -> float:
        """The mean surprise of letters after letters; that of a random letter if there are none."""
        a = np.frombuffer(low, np.uint8).astype(int) - 97
        letter = (a >= 0) & (a < 26)
        both = np.flatnonzero(letter[1:] & letter[:-1])
        return float(self.surprise[a[both], a[both + 1]].mean()) if len(both) else math.log2(26)


@functools.cache
def dictionary(vocabulary: str | None = None) -> Dictionary:
    """The words below, and of a file of ranks those tokens that are a blank and four to twenty letters, in lower case."""
    words = {w for w in _WORDS if len(w) >= 4}
    if vocabulary:
        words |= {t[1:].decode().lower() for t in read_ranks(vocabulary) if re.fullmatch(rb" [A-Za-z]?[a-z]{3,19}", t)}
    return Dictionary(words)


def describe(text: bytes, span: tuple[int, int], path: str, known: Dictionary) -> list[float]:
    s, e = span
    c = text[s:e]
    before = text[max(0, s - 48) : s]
    name = b" ".join(before.split()[-3:])
    a = np.frombuffer(c, np.uint8)
    kind = _KIND[a]
    n = len(c)
    counts = np.bincount(a, minlength=256)
    share = counts[counts > 0] / n
    low = c.lower()
    return [
        math.log1p(n),
        float(-(share * np.log2(share)).sum()),
        float((kind == 1).mean()),
        float((kind == 2).mean()),
        float((kind == 0).mean()),
        sum(low.count(v) for v in (b"a", b"e", b"i", b"o", b"u")) / n,
        known.covered(low),
        known.surprising(low),
        sum(b in b"0123456789abcdef" for b in low) / n,
        len(share) / n,
        float(bool(_NAMED.search(name))),
        float(bool(_PUBLIC.search(name))),
        float(before[-1:] in (b'"', b"'")),
        float(bool(re.search(rb"[:=]\s*[\"']?$", before))),
        float(bool(_PUBLIC.search(text[e : e + 24]))),
        float(bool(_TEST_PATH.search(path))),
        float(bool(_PREFIX.match(c))),
        float(len(re.split(rb"[-_./]", c))),
        float(counts.max() / n),
        *(np.bincount(kind[:-1] * 4 + kind[1:], minlength=16) / max(1, n - 1)),
    ]


#: Labelled findings by form: 1 a secret, 0 not; {h32} stands for 32 hex digits, {b}, {a}, {d} and {u} for base64, letters and digits, digits, capitals and digits, {w} for a word.
LABELLED = """
1|src|token = "{h40}"
1|src|token = "{h32}" {w}
1|src/app.py|api_key = "{a32}"
1|config.yml|secret: '{b44}'
1|src|password = "{a12}!"
1|src|{w} and password={h18} {w}
1|src|pwd: {a14}
0|src|the password: {w}{w}, {w}
0|src|a token: {w}. {w}
1|src|passwd: "{a10}#{d4}"
1|src|aws_key = AKIA{u16}
1|src|auth = ghp_{a36}
1|web.js|key: "AIza{a35}"
1|pay.rb|stripe sk_live_{a24}
1|bot.py|bearer xoxb-{d12}-{a24}
1|src|private_key={b64}
1|src|secret_token={h64}
1|.env|API_TOKEN={a40}
1|.env|DB_PASSWORD="{a16}"
1|src|use token {h40} {w}
1|log|authorization: bearer eyJ{b60}.{b80}
0|git.log|commit {h40}
0|lock|sha256:{h64}
0|package-lock.json|"integrity": "sha512-{b86}=="
0|src|md5 checksum {h32}
0|src|uuid {h8}-{h4}-{h4}-{h4}-{h12}
0|src|id={h8}-{h4}-{h4}-{h4}-{h12}
0|src|{w}{w}{w}{w}{w}
0|src|get_{w}_{w}_from_{w}2
0|src|{w}.{w}.{w}.{w}3.{w}
0|docs|token = "your_api_key_here_{d1}"
0|tests/a.py|password = "example_password1"
0|tests/b.py|token = "xxxxxxxxxxxxxxxxxxxx{d1}"
0|docs|secret: "change_me_{w}_please1"
0|src|password = "password123"
0|src|see http://www.{w}.com/{w}/{w}/{w}{d4}
0|src|path /usr/lib/{w}/{w}{d2}/{w}
0|src|{w}{d4}@mail{d1}.example.com
0|src|number {d16} {w}
0|src|{w} {d20}
0|src|file {w}-{w}-{w}-{d4}-{d2}-{d2}.txt
0|src|version {d2}.{d2}.{d4}-{w}-{d8}
0|src|{d3}.{d3}.{d3}.{d3}-{d3}.{d3}
0|src|Get{w}And{w}From{w}Table
0|src|data:image/png;base64,iVBORw0KGgo{b120}
1|deploy.sh|export SECRET_KEY={a50}
1|settings.py|SECRET_KEY = '{a30}#{d3}!{a15}'
1|main.tf|access_key = "AKIA{u16}"
1|main.tf|secret_key = "{b40}"
1|app.js|const apiKey = "{a39}";
1|ci.yml|NPM_TOKEN: npm_{a36}
1|ci.yml|token: glpat-{a20}
1|Program.cs|Password={a14};Server={w}
1|src|{w} secret key: {b43}=
1|src|authorization: basic {b36}==
1|src|client_secret="{a8}-{a16}~{a8}"
1|log|x-api-key: {h32}
1|src|mysql://{w}:{a16}@{w}.{w}.net/{w}
1|src|passphrase "{a24}"
1|notes.txt|the api key is {a32} {w}
1|src|auth_token={h40}&{w}={w}
0|Cargo.lock|checksum = "{h64}"
0|go.sum|{w}.org/{w} v1.{d2}.0 h1:{b43}=
0|yarn.lock|resolved "https://{w}.{w}.com/{w}/-/{w}-{d1}.{d1}.{d1}.tgz#{h40}"
0|log|request id {h16} took {d3}
0|log|trace_id={h32} span_id={h16}
0|log|etag "{h32}"
0|src|session {w}_{w}_{d8} of {w}
0|README|export TOKEN=your_{w}_token_goes_here1
0|README|api_key = "<your-{w}-api-key-1>"
0|config.yml|password: changeme_{w}_{d2}
0|config.yml|password: ${{w}_{w}_PASSWORD1}
0|src|token = request.headers.{w}_token_{d1}
0|src|secret = os.environ_{w}_{w}_{d2}
0|test_auth.py|api_key = "test_{w}_key_{d4}"
0|src|index {h7}..{h7} {d6}
0|src|blob {h40}
0|src|{u1}{w}{u1}{w}{u1}{w}Factory{d1}
0|src|{w}{w}{w}{d4}.{w}.{w}/{w}-{w}
0|src|isbn {d3}-{d1}-{d4}-{d4}-{d1}
0|src|timestamp {d4}-{d2}-{d2}T{d2}:{d2}:{d2}.{d6}Z-{w}
0|src|public key fingerprint SHA256:{b43}
0|src|color palette {h6}-{h6}-{h6}-{h6}
0|src|sequence ACGTACGTGGCATTACGGATCA{d2}
0|src|build-{w}-{d8}-{w}-{h8}.log
0|src|{w}_{w}_{w}_{w}_{w}_{d2}
""".strip().splitlines()


#: What findings stand among: words and names that say nothing about them.
SURROUNDINGS = ("", "{w} {w} {w} ", "{w}@{w}.example.com. {w} ", "see http://{w}.org/{w} {w} ", "{w}\n{w}: {d2}\n")


@functools.cache
def labelled(vocabulary: str | None = None, repeats: int = 30, seed: int = 11, forms: tuple[str, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of findings made from forms (LABELLED if none are given)."""
    known = dictionary(vocabulary)
    rng = np.random.default_rng(seed)
    pools = {"h": "0123456789abcdef", "b": string.ascii_letters + string.digits + "+/", "a": string.ascii_letters + string.digits, "d": string.digits, "u": string.ascii_uppercase + string.digits}
    parts = "er the an re on in ti th es ou st ing ed en at or nd wh ha he ent tion ble ly".split()

    def fill(m):
        if m[1] == "w":
            return str(rng.choice(_WORDS)) if rng.random() < 0.5 else "".join(rng.choice(parts, rng.integers(1, 5)))
        return "".join(rng.choice(list(pools[m[1]]), int(m[2])))

    x, y = [], []
    for line in forms if forms is not None else LABELLED:
        label, path, form = line.split("|", 2)
        for _ in range(repeats):
            start = re.sub(r"\{([hbaduw])(\d*)\}", fill, str(rng.choice(SURROUNDINGS))).encode()
            text = start + re.sub(r"\{([hbaduw])(\d*)\}", fill, form + " {w} {w}").encode()
            for span in (c for c in candidates(text) if c[0] >= len(start)):
                x.append(describe(text, span, path, known))
                y.append(int(label))
    return np.array(x), np.array(y)


class RandomForest:
    """Trees on bootstrap rows and random features, as arrays: node k asks whether feature[k] <= cut[k]; leaves hold the share of secrets."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.roots, self.feature, self.cut, self.left, self.value = [], [], [], [], []
        for _ in range(trees):
            self.roots.append(self._node())
            todo = [(self.roots[-1], rng.integers(0, len(y), len(y)), 0)]
            while todo:
                at, rows, level = todo.pop()
                part = y[rows]
                self.value[at] = float(part.mean())
                if level == depth or len(rows) < 4 or part.min() == part.max():
                    continue
                best = (1e-9, None)
                whole = part.mean() * (1 - part.mean()) * len(rows)
                for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
                    order = np.argsort(x[rows, f], kind="stable")
                    v, s = x[rows[order], f], np.cumsum(part[order])
                    n = np.arange(1, len(rows))
                    ones = s[:-1]
                    rest = s[-1] - ones
                    gain = whole - ones * (n - ones) / n - rest * (len(rows) - n - rest) / (len(rows) - n)
                    gain[v[1:] == v[:-1]] = -1
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        middle = (v[i] + v[i + 1]) / 2
                        best = (gain[i], (f, middle if middle < v[i + 1] else v[i]))
                if best[1] is None:
                    continue
                self.feature[at], self.cut[at] = best[1]
                self.left[at] = self._node()
                self._node()
                goes = x[rows, best[1][0]] <= best[1][1]
                todo += [(self.left[at], rows[goes], level + 1), (self.left[at] + 1, rows[~goes], level + 1)]
        self.feature, self.cut, self.left, self.value = (np.array(c) for c in (self.feature, self.cut, self.left, self.value))

    def _node(self) -> int:
        for column, start in ((self.feature, 0), (self.cut, 0.0), (self.left, -1), (self.value, 0.0)):
            column.append(start)
        return len(self.left) - 1

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                inner = np.flatnonzero(self.left[node] >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = self.left[at] + (x[inner, self.feature[at]] > self.cut[at])
            total += self.value[node]
        return total / max(1, len(self.roots))


@functools.cache
def train(vocabulary: str | None = None) -> RandomForest:
    return RandomForest(*labelled(vocabulary))


def find_secrets(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """A row per candidate: id, start and end (code points), length, score, secret.  vocabulary: a file of ranks whose words the dictionary takes."""
    model = train(vocabulary)

    def run(batches):
        known = dictionary(vocabulary)
        for batch, raw in slices(batches):
            paths = batch.column(2).to_pylist()
            rows, spans, x = [], [], []
            for i, t in enumerate(raw):
                found = candidates(t)
                at = code_points(t) if found else None
                for span in found:
                    rows.append(i)
                    spans.append(tuple(int(at[k]) for k in span))
                    x.append(describe(t, span, paths[i] or "", known))
            score = model.score(np.array(x)) if x else np.zeros(0)
            start, end = (pa.array([s[k] for s in spans], pa.int64()) for k in (0, 1))
            length = pa.array([e - s for s, e in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), start, end, length, pa.array(score), pa.array(score >= threshold)], [id_col, "start", "end", "length", "score", "secret"])

    path = F.col(path_col) if path_col else F.lit("")
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).alias("text"), path.alias("path")).mapInArrow(run, f"`{id_col}` {kind}, start long, end long, length long, score double, secret boolean")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return find_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
