"""Secret scans: keyword automaton, anchored patterns near its hits, checksums.

An Aho-Corasick automaton over lower-cased keywords finds where a pattern could start;
only there is the anchored pattern tried, each kind leftmost and non-overlapping. Long
hexadecimal runs have no keyword: one byte translation marks their class and a substring
search finds runs of 32, so texts without any are passed over at memory speed.

Kinds whose format embeds a checksum (tokens that end in a base-62 CRC-32, payment card
numbers by Luhn, account numbers by mod 97) count only if it holds.

Results: null counts as the empty text, which has no span. Spans are in code points, end
exclusive. Repeated rows and null ids give a row each. Extra columns are never read.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from citeweave.llm.common import map_arrow, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE = ("assign", "access", "hex")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MASK = "[SECRET]"


def _crc_token(text: str) -> bool:
    """The last six characters are the base-62 CRC-32 of the rest behind the prefix."""
    body, tail = text.split("_", 1)[1][:-6], text[-6:]
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        digits = BASE62[rest] + digits
    return digits == tail


def _luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def _mod97(text: str) -> bool:
    packed = re.sub(r"\x20", "", text)
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


#: kind -> (keywords, lower case; pattern tried at the hit; check). Keywords and formats are fixed values.
KINDS: dict[str, tuple] = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), ASSIGN, lambda m: len(m[2]) >= 8),
    "access": (("akia",), ACCESS, lambda m: len(m[0]) >= 16),
    "vcs": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), re.compile(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), lambda m: _crc_token(m[0])),
    "key": (("-----begin",), re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----"), lambda m: True),
    "card": (("card",), re.compile(r"card(?:\x20?(?:number|no\.?|nr\.?))?\x20?[:=#]?\x20?((?:[0-9][ -]?){12,18}[0-9])(?![0-9])", re.I | re.A), lambda m: _luhn(m[1])),
    "account": (("iban",), re.compile(r"iban\x20?[:=]?\x20?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", re.I | re.A), lambda m: _mod97(m[1].upper())),
}
_CLASS = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
_RUN = b"1" * 32


@functools.cache
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, (keywords, _, _) in KINDS.items():
        for word in keywords:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, in order of start, then of kind as listed."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lower-cased; offsets must stay
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    found, past = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end - size + 1, kind) for end, (kind, size) in automaton().iter(low))
    for start, kind in hits:
        if start >= past[kind] and (m := KINDS[kind][1].match(text, start)):
            past[kind] = m.end()
            if KINDS[kind][2](m):
                found.append((start, m.end(), kind))
    if _RUN in text.encode("utf-8", "surrogatepass").translate(_CLASS):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    rank = {k: i for i, k in enumerate((*BASE, *[k for k in KINDS if k not in BASE]))}
    return sorted(found, key=lambda s: (s[0], rank[s[2]], s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def mask(text: str, spans: list[tuple[int, int, str]], by: str = MASK) -> str:
    """The text with every span, or run of overlapping spans, replaced."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end, _ in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], by]
        at = end
    return "".join([*out, text[at:]])


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``df``."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        all_spans = [scan(t) for t in texts(batch)]
        base = [[s for s in spans if s[2] in BASE] for spans in all_spans]
        return {
            "doc_id": batch.column("doc_id"),
            **{f"n_{kind}": [sum(s[2] == kind for s in spans) for spans in base] for kind in BASE},
            "base_sha256": [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base],
            "spans": [joined(spans) for spans in all_spans],
        }

    return map_arrow(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")), run, f"doc_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(df: DataFrame, text_col: str = "text", by: str = MASK) -> DataFrame:
    """``df`` with every secret in ``text_col`` masked; null stays null, other columns stay as they are.

    Rows pass in slices of bounded bytes, so a batch of many texts is never held twice as strings.
    """
    at = df.columns.index(text_col)
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # columns may have any names

    def run(batch: pa.RecordBatch) -> dict:
        held = [t if t is None else mask(t, scan(t), by) for t in batch.column(at).to_pylist()]
        return {f"c{i}": held if i == at else batch.column(i) for i in range(batch.num_columns)}

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return map_arrow(plain, run, schema).toDF(*df.columns)
