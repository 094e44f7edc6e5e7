"""Texts of a batch as one array of folded code points: what the vectorised kernels of this subpackage run over."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np

from .canon import _translation, fold_table, wide_forms, wide_pattern

_MARKS = re.compile("[\u0300-\u036f\u3099\u309a]")


@dataclass
class Codes:
    """``chars``: folded code points of all texts without invisible characters and (unless kept) spaces; ``start[i]:start[i+1]`` is text i."""

    chars: np.ndarray
    start: np.ndarray

    def row_of(self) -> np.ndarray:
        """For each character its text's number."""
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))


def encode(texts: list[str | None], keep_newlines: bool = False) -> Codes:
    """Null counts as "". Accents are composed in the few texts that have combining marks."""
    return encode_map(texts, keep_newlines)[0]


def encode_map(texts: list[str | None], keep_newlines: bool = False, widen: bool = True) -> tuple[Codes, list[str], np.ndarray]:
    """As ``encode``; also the composed texts, and for each kept character its place in all of them laid end to end.

    Without ``widen``, characters that look like several stay as they are.
    """
    if widen:
        wide, many = wide_pattern(), {ord(k): v for k, v in wide_forms().items()}
        texts = [t.translate(many) if t and wide.search(t) else t for t in texts]
    ready = [unicodedata.normalize("NFC", t.translate(_translation())) if t and _MARKS.search(t) else (t or "") for t in texts]
    sizes = np.fromiter((len(t) for t in ready), np.int64, len(ready))
    raw = np.frombuffer("".join(ready).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    chars = fold_table()[raw]
    keep = chars != 0
    if not keep_newlines:
        keep &= chars != 10
    counts = np.concatenate([[0], np.cumsum(keep)])
    start = counts[np.concatenate([[0], np.cumsum(sizes)])]
    return Codes(chars[keep], start.astype(np.int64)), ready, np.flatnonzero(keep)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64 (public domain constants)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + _MIX
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def segment_hashes(chars: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every segment ``chars[start[i]:start[i+1]]``, from the sum of mixed (place, character)."""
    sizes = np.diff(start)
    place = np.arange(len(chars), dtype=np.int64) - np.repeat(start[:-1], sizes)
    with np.errstate(over="ignore"):
        each = mix((place.astype(np.uint64) << np.uint64(21)) | chars.astype(np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        return mix(total[start[1:]] - total[start[:-1]] + sizes.astype(np.uint64)).view(np.int64)


def gram_hashes(chars: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive items, by start; shorter input gives none."""
    n = len(chars) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = mix(h ^ chars[j : j + n].astype(np.uint64))
    return h.view(np.int64)
