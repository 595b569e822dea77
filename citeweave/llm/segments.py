"""Texts as sequences of segments that a byte-level BPE encodes separately.

The pre-token pattern always starts anew where a run of white space starts. So a text
can be cut there, and equal segments encode alike. Arrow cuts and numbers the segments
of many texts at once; each distinct one is then encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A run of white space and what follows it, or white space at the end.
SEGMENT = re.compile(r"\s*\S+|\s+")
#: Python counts these as white space; the pre-tokeniser does not.
ODD = re.compile("[\x1c-\x1f]")
#: Characters with the Unicode property White_Space, for RE2 (fixed values).
WHITE = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LONGEST_KEPT = 48


class Memo(dict):
    """What ``make`` gives for a text, kept while there is room.

    The first texts seen are mostly the frequent ones, so a full memo stays as it is; it
    starts anew only after many more misses, when the corpus has changed.
    """

    def __init__(self, make: Callable, room: int):
        super().__init__()
        self.make, self.room, self.missed = make, room, 0

    def __missing__(self, key):
        made = self.make(key)
        if len(self) < self.room:
            if len(key) <= LONGEST_KEPT:
                self[key] = made
        else:
            self.missed += 1
            if self.missed > 8 * self.room:
                self.clear()
                self.missed = 0
        return made


def plain_segments(text: str) -> list[str]:
    """Segments of one text; one whose white space is in doubt stays whole."""
    return [text] if ODD.search(text) else SEGMENT.findall(text)


def segment_lists(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array, list[str]]:
    """(offsets, codes, later, own): the segments of text i have codes[offsets[i]:offsets[i+1]].

    A code below ``len(later)`` is a distinct segment behind a blank (not stored) or line
    end (stored); the others count on in ``own``: first segments of texts, and all of
    those texts in which white space stands together.
    """
    whole = pa.array(texts, pa.string())
    slow = np.asarray(pc.match_substring_regex(whole, f"[{WHITE}][{WHITE}]"))
    fast = pc.if_else(pa.array(slow), "", whole) if slow.any() else whole
    # Every run has one character here: a blank is cut away, a line end stays in front.
    lists = pc.split_pattern(pc.replace_substring(fast, "\n", " \n"), " ")
    encoded = lists.flatten().dictionary_encode()
    offsets, codes = np.asarray(lists.offsets).astype(np.int64), np.array(encoded.indices, np.int64)
    later, firsts = encoded.dictionary, offsets[:-1]
    own = later.take(pa.array(codes[firsts])).to_pylist()
    codes[firsts] = len(later) + np.arange(len(firsts))
    if slow.any():
        parts, bounds = [], np.zeros(len(texts) + 1, np.int64)
        for i, s in enumerate(slow):
            part = codes[offsets[i] : offsets[i + 1]]
            if s:
                segments = plain_segments(texts[i])
                part = len(later) + len(own) + np.arange(len(segments))
                own += segments
            parts.append(part)
            bounds[i + 1] = bounds[i] + len(part)
        offsets, codes = bounds, np.concatenate(parts)
    return offsets, codes, later, own


def written_out(later: pa.Array) -> list[str]:
    """The segments of ``later`` with their blank."""
    return [s if s[:1] == "\n" else " " + s for s in later.to_pylist()]


def joined(offsets: np.ndarray, codes: np.ndarray, values: pa.Array, separator) -> pa.Array:
    """One value a text: the values of its codes joined."""
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), values.take(pa.array(codes)))
    return pc.binary_join(lists, pa.scalar(separator, values.type))
