"""Byte-level BPE by automaton matching and backtracking.

Bytes are mapped to Latin-1 so that a ``pyahocorasick`` automaton can
hold the vocabulary. From each position the longest match is tried first; a token may follow another only if the two, merged alone, stay those
two tokens (memoised). A position from which no continuation exists is marked
dead, so no state is visited twice and the work is linear in the piece. A
sequence whose neighbours are all compatible is the one that the merge rules give.

Results: null and empty text encode to no ids. Text of any length is encoded
whole. Only the text column is read, so extra columns cannot clash.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from citeweave.llm.common import map_arrow, texts
from citeweave.llm.segments import Memo, joined, plain_segments, segment_lists, written_out

#: Characters with the Unicode property White_Space (fixed values).
WHITE = "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Bytes of text that are numbered at once: more share more segments.
SLICE = 16 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BytePairCodec:
    """Encoder and decoder for a rank file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.vocab = {i: b for b, i in self.ranks.items()}
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.longest_token = max(map(len, self.ranks))
        self.fits: dict[int, bool] = {}
        self.pieces = Memo(lambda p: " ".join(map(str, self.encode_bytes(p.encode("utf-8", "surrogatepass")))), 200_000)
        self.segments = Memo(self._split, 350_000)
        self.spans = Memo(self.decode_decimal, 350_000)
        self.by_text = {str(i): b for i, b in self.vocab.items()}

    def merged(self, data: bytes) -> list[int]:
        """The merge rules applied literally: the lowest-ranked neighbouring pair first."""
        rank, none = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]  # of each part with the next
        while ranks and (least := min(ranks)) < none:
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow ``a``; with ``a`` = -1, whether merging yields ``b`` at all."""
        known = self.fits.get(a << 32 | b)
        if known is None:
            if len(self.fits) > 400_000:
                self.fits.clear()
            want = [b] if a < 0 else [a, b]
            known = self.fits[a << 32 | b] = self.merged(b"".join([self.vocab[i] for i in want])) == want
        return known

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        n, text, width = len(data), data.decode("latin-1"), self.longest_token
        prefix, fits = self.automaton.longest_prefix, self.fits
        out, lengths, pos, last = [], [], 0, -1
        dead = bytearray(n + 1)
        length = prefix(text[:width]) if n else 0
        while pos < n:
            while length:
                token = ranks.get(data[pos : pos + length])
                if token is not None and not dead[pos + length]:
                    known = fits.get(last << 32 | token)
                    if known is None:
                        known = self.compatible(last, token)
                    if known:
                        break
                length -= 1
            if length:
                out.append(token)
                lengths.append(length)
                pos, last = pos + length, token
                length = prefix(text[pos : pos + width])
            else:  # no continuation from here: go on with a shorter token before it
                dead[pos] = 1
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                out.pop()
                length = lengths.pop()
                pos -= length
                length -= 1
                last = out[-1] if out else -1
        return out

    def _split(self, text: str) -> str:
        """Ids of a text as decimals, each match of the pattern separately."""
        return " ".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode_decimal(self, text: str) -> str:
        """Ids as decimals joined by spaces."""
        return " ".join(map(self.segments.__getitem__, plain_segments(text)))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(offsets, codes, ids of the distinct segments as decimals); only an empty segment has no ids."""
        offsets, codes, later, own = segment_lists(texts)
        return offsets, codes, [self.segments[s] if s else "" for s in written_out(later) + own]

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.encode_decimal(text).split()))

    def decode(self, ids) -> bytes:
        return b"".join([self.vocab[i] for i in ids])

    def decode_decimal(self, ids: str) -> bytes:
        return b"".join(map(self.by_text.__getitem__, ids.split(" "))) if ids else b""


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec a Python worker and vocabulary."""
    return BytePairCodec(path, pattern)


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row of ``df``, whole texts.

    ``with_ids=False`` leaves the ids in the worker and returns their digests only.
    Rows may repeat and ids may be null: each row gives one row.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batch: pa.RecordBatch) -> dict:
        own = codec(path, pattern)
        offsets, codes, ids = own.encode_all(texts(batch))
        some = np.fromiter(map(bool, ids), bool, len(ids))[codes]  # an empty first segment would leave a space
        offsets, codes = np.concatenate([[0], np.cumsum(some)])[offsets], codes[some]
        decimals = joined(offsets, codes, pa.array(ids, pa.large_string()), " ").to_pylist()
        decoded = joined(offsets, codes, pa.array([own.spans[i] for i in ids], pa.large_binary()), b"").to_pylist()
        out = {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [d.count(" ") + 1 if d else 0 for d in decimals],
            "ids_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decimals],
            "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded],
        }
        return out | ({"ids": [list(map(int, d.split())) for d in decimals]} if with_ids else {})

    return map_arrow(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")), run, schema, SLICE)


def decode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, content binary): the bytes that each row's ids stand for; null ids give no bytes."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        own = codec(path, pattern)
        return {"doc_id": batch.column("doc_id"), "content": [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]}

    return map_arrow(df.select(df[id_col].alias("doc_id"), df[ids_col].alias("ids")), run, f"doc_id {id_type}, content binary")


def pack_ids(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)
