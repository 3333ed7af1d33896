"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

encode_documents returns each text's ids and the character at which each token starts; of a token that starts inside a
character, that is the character its first byte belongs to.  decode_documents turns ids into bytes by the reversed byte table
and bytes into text, which puts characters together that several tokens share, with a replacement sign for bytes that don't make one.

Defined cases: a null or empty text has no ids and decodes to nothing; equal rows give equal
results; strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import table
from .tokens import byte_characters, byte_encoder, byte_level
from .wordarrays import slices


class ByteTable:
    """The bytes of every token id, taken back from the vocabulary's characters."""

    def __init__(self, tokenizer):
        vocab = tokenizer.get_vocab()
        back = {c: b for b, c in enumerate(byte_characters())}
        tokens = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            tokens[i] = bytes(back[c] for c in name)
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and each token's number of bytes."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.arange(total) + np.repeat(self.begin[ids] - (ends - size), size)], size


@functools.cache
def _table(path: str, pattern: str) -> ByteTable:
    return ByteTable(byte_level(path, pattern))


def decode_text(ids: np.ndarray, path: str, pattern: str) -> str:
    return _table(path, pattern).decode(np.asarray(ids, np.int64))[0].tobytes().decode("utf-8", "replace")


def _encoded(batches, path, pattern):
    """Runs of rows with their ids, sizes (ids a text), bytes and each token's bytes; the round trip is the caller's to check."""
    encoder, back = byte_encoder(path, pattern), _table(path, pattern)
    for batch, raw in slices(batches):
        ids, sizes = encoder.encode([t.decode() for t in raw])
        data, token_bytes = back.decode(ids)
        yield batch, raw, ids, sizes, data, token_bytes


def _starts(sizes: np.ndarray, data: np.ndarray, token_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the character of its text at which it starts, and whether it starts inside that character."""
    lead = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    byte_at = np.cumsum(token_bytes) - token_bytes
    inside = ~lead[byte_at] if len(byte_at) else np.zeros(0, bool)
    first = np.concatenate([[0], np.cumsum(token_bytes)])[np.cumsum(sizes) - sizes] if len(sizes) else np.zeros(0, np.int64)
    return before[byte_at] - inside - np.repeat(before[first], sizes), inside


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) and starts (array of int: the character at which each token starts) of each row."""

    def run(batches):
        for batch, _, ids, sizes, data, token_bytes in _encoded(batches, path, pattern):
            starts, _ = _starts(sizes, data, token_bytes)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(starts.astype(np.int32)))], [id_col, "ids", "starts"]
            )

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>, starts array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of each row of encoded; null ids give a null text, bytes that make no character a replacement sign."""

    def run(batches):
        back = _table(path, pattern)
        for batch in batches:
            ids = batch.column(1)
            at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
            data, size = back.decode(ids.flatten().to_numpy())
            ends = np.concatenate([[0], np.cumsum(size)])[at]
            whole, known = data.tobytes(), ids.is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([whole[s:e].decode("utf-8", "replace") if k else None for s, e, k in zip(ends, ends[1:], known, strict=False)], pa.string())], [id_col, "text"])

    return encoded.select(id_col, F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, text string")


def digest_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, n_split (tokens that start inside a character) and starts_crc32 (of the tokens'
    characters as 32-bit numbers) of each row, without moving the ids out of the task."""

    def run(batches):
        for batch, raw, ids, sizes, data, token_bytes in _encoded(batches, path, pattern):
            at = np.concatenate([[0], np.cumsum(sizes)])
            byte_at = np.concatenate([[0], np.cumsum(token_bytes)])[at]
            starts, inside = _starts(sizes, data, token_bytes)
            split = np.diff(np.concatenate([[0], np.cumsum(inside)])[at])
            four, places, whole = ids.astype("<u4").tobytes(), memoryview(starts.astype("<u4").tobytes()), data.tobytes()
            rows = range(len(raw))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes),
                    pa.array([hashlib.sha256(four[4 * at[i] : 4 * at[i + 1]]).hexdigest() for i in rows], pa.string()),
                    pa.array([hashlib.sha256(whole[byte_at[i] : byte_at[i + 1]]).hexdigest() for i in rows], pa.string()),
                    pa.array(split.astype(np.int64)),
                    pa.array([zlib.crc32(places[4 * at[i] : 4 * at[i + 1]]) for i in rows], pa.int64()),
                ],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "n_split", "starts_crc32"],
            )

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, starts_crc32 long"
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, schema)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
