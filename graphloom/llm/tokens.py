"""Tokenising whole texts in batches with the tokenizers library, each distinct chunk once.

Texts are cut at white space, where no token and no match of the split pattern reaches across;
the library encodes every distinct chunk of a batch once, and array operations put the ids of the texts
together.  Chunks are kept for later batches as long as they are short and their number and characters stay within
MOST_CHUNKS and MOST_CHARACTERS.
"""

from __future__ import annotations

import base64
import functools
import re
from itertools import chain, repeat

import numpy as np
from tokenizers import AddedToken, Regex, Tokenizer, models, pre_tokenizers

# Bounds on memory only: beyond them the cache keeps short chunks that were used thrice or more.
MOST_CHUNKS = 700_000
MOST_CHARACTERS = 24 << 20
LONG = 64


@functools.cache
def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens that merge into token: what the lower ranks make of it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    most = ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], most), i) for i in range(len(parts) - 1))
        if rank >= most:
            raise ValueError(f"rank {most} isn't a merge of two tokens")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


@functools.cache
def byte_level(path: str, pattern: str) -> Tokenizer:
    """A byte-level BPE tokenizer with the vocabulary and merges that a file of ranks stands for."""
    ranks, chars = read_ranks(path), byte_characters()
    name = lambda token: "".join(chars[b] for b in token)
    order = sorted(ranks, key=ranks.__getitem__)
    merges = [tuple(map(name, _parts(t, ranks))) for t in order if len(t) > 1]
    out = Tokenizer(models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


@functools.cache
def from_file(path: str) -> Tokenizer:
    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


_ODD_WORD_GAP = re.compile(r"[^\S\n\t\r\x0b\x0c ]")
_WORD_GAP = re.compile(r"[\n\t\r\x0b\x0c ]+")
#: Between a sign and white space: no match of the byte vocabulary's pattern holds both.  What some take for white space and others
#: for a sign counts as neither here.
_SPACE_BEGINS = re.compile(r"(?<=\S)(?=[\n\t\r\x0b\x0c ])")
_ASCII_SPACE = frozenset(" \t\n\r\x0b\x0c")
#: One match of the word vocabulary's pattern: letters, or signs without an apostrophe.
_ONE_WORD = re.compile(r"[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")
#: Signs after a plain letter begin a match of that pattern; cutting there makes fewer distinct chunks.
_SIGN = re.compile(r"[.,!|*%$#&](?<=[a-z].)")


@functools.cache
def byte_encoder(path: str, pattern: str) -> "Encoder":
    """One encoder a worker process, so that its cache serves many tasks."""
    return Encoder(byte_level(path, pattern), True)


@functools.cache
def word_encoder(path: str) -> "Encoder":
    return Encoder(from_file(path), False)


class Encoder:
    """Encodes batches of texts.  keeps_space: white space is part of tokens (byte level), else it is dropped."""

    def __init__(self, tokenizer: Tokenizer, keeps_space: bool):
        self.tokenizer, self.keeps_space = tokenizer, keeps_space
        vocab = tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.word_end = np.zeros(len(self.token_bytes), bool)
        for name, i in vocab.items():
            self.token_bytes[i] = len(name)  # a character of the vocabulary is a byte
            self.word_end[i] = name.endswith("</w>")
        self._clear()

    def _clear(self):
        self.at: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.hits = np.zeros(1 << 12, np.int64)
        self.used = self.n = self.characters = 0

    def _sweep(self):
        """Keep the short chunks that were used often since the last sweep, at most half of the bounds."""
        sizes = np.fromiter(map(len, self.at), np.int64, self.n)
        hits, least = np.where(sizes <= LONG, self.hits[: self.n], 0), 3
        while int((hits >= least).sum()) > MOST_CHUNKS // 2 or int(sizes[hits >= least].sum()) > MOST_CHARACTERS // 2:
            least *= 2
        old, keep = self.at, hits >= least
        ids, begin, size = self.ids, self.begin, self.size
        self._clear()
        chosen = [(c, i) for c, i in old.items() if keep[i]]
        if chosen:
            at = np.fromiter((i for _, i in chosen), np.int64, len(chosen))
            sizes = size[at]
            ends = np.cumsum(sizes)
            self._place([c for c, _ in chosen], ids[np.arange(int(ends[-1])) + np.repeat(begin[at] - (ends - sizes), sizes)], sizes)

    def _add(self, chunks: list[str]) -> None:
        """Encode new chunks: those of one kind of white space and word joined to long texts, which the library
        does much faster, the others one by one."""
        joins, rest = [], []
        for c in chunks:
            (joins if self._joins(c) else rest).append(c)
        for i in range(0, len(joins), 2000):
            some = joins[i : i + 2000]
            ids = np.array(self.tokenizer.encode(("" if self.keeps_space else " ").join(some), add_special_tokens=False).ids, np.uint32)
            if self.keeps_space:
                # Chunks end where their bytes end.
                want = np.cumsum(np.fromiter((len(c.encode()) for c in some), np.int64, len(some)))
                ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), want) + 1
            else:
                ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                raise ValueError("a chunk isn't encoded on its own")
            self._place(some, ids, np.diff(ends, prepend=0))
        if rest:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._place(rest, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)

    def _joins(self, chunk: str) -> bool:
        return chunk[:1] in _ASCII_SPACE and not chunk[-1:].isspace() if self.keeps_space else bool(_ONE_WORD.fullmatch(chunk))

    def _place(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        need, found = len(ids), sizes
        while self.used + need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(found) > len(self.size):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        self.ids[self.used : self.used + need] = ids
        self.size[self.n : self.n + len(found)] = sizes
        self.begin[self.n : self.n + len(found)] = self.used + np.cumsum(sizes) - sizes
        self.at.update(zip(chunks, range(self.n, self.n + len(found)), strict=True))
        self.used += need
        self.n += len(found)
        self.characters += sum(map(len, chunks))

    def _chunks(self, text: str) -> list[str]:
        if not self.keeps_space:
            if any(c in text for c in "\x1c\x1d\x1e\x1f") or not (text.isascii() or not _ODD_WORD_GAP.search(text)):
                return [c for c in _WORD_GAP.split(text) if c]
            # bytes.lower() lowers A-Z only, which the vocabulary's normalizer does too.
            return _SIGN.sub(r" \g<0>", text.encode().lower().decode()).split()
        if " ".join(text.split()) != text.replace("\n", " "):
            return _SPACE_BEGINS.split(text)
        # Only single blanks and line ends between words.
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        if self.n > MOST_CHUNKS or self.characters > MOST_CHARACTERS:
            self._sweep()
        chunked = [self._chunks(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, chunked), np.int64, len(chunked))
        chunks = list(chain.from_iterable(chunked))
        at = np.fromiter(map(self.at.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = [chunks[i] for i in missing]
            self._add(list(dict.fromkeys(new)))
            at[missing] = np.fromiter(map(self.at.__getitem__, new), np.int64, len(new))
        self.hits[: self.n] += np.bincount(at, minlength=self.n)
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.begin[at] - (ends - size), size)]
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(ends)
