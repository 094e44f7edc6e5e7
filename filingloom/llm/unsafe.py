"""Problem 10: abusive, hateful or sexual content, by multiple-instance learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import widen
from .codes import encode, gram_hashes

#: The classifier is fitted on at most so many documents labelled 0 and 1 (the least by hash of their id); everything else sees all rows.
MAX_LABELLED = (3_000, 2_000)
#: Weights of the model, one per hash bucket, and the lengths of the character sequences that are features.
BUCKETS, GRAMS = 1 << 19, (1, 2, 3, 4)
#: Share of labels of either kind that are taken to be wrong.
WRONG = 0.04
#: A sentence of more characters than SPAN is read in windows of SPAN characters, each half over the next.
SPAN = 24
#: How strongly long sentences count their features less.
DAMP = 0.5
#: A document at or above this score counts as unsafe.
UNSAFE = 0.6

_ENDS = np.array(sorted(ord(c) for c in "。!?;\n"), np.uint32)
_TABLES: dict[str, np.ndarray] = {}


def _class() -> np.ndarray:
    """Code point -> 0 dropped (marks between letters are disguise), 1 kept as it is, 2 digit."""
    if "class" not in _TABLES:
        t = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000:
                s = chr(c)
                t[c] = 2 if s.isdigit() else 1 if s.isalpha() else 0
        lower = np.arange(0x110000, dtype=np.uint32)
        lower[65:91] += 32
        _TABLES.update({"class": t, "lower": lower})
    return _TABLES["class"]


def sentences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, sentence starts with the end, text of each sentence). Letters and ideographs only; a run of digits is one 0; long sentences in windows.

    A sentence ends at a full stop, a question or exclamation mark, a semicolon or a line feed. Sentences without letters are left out.
    """
    kind = _class()
    codes = encode([t if t is None else t + "\n" for t in texts], keep_newlines=True)
    c = codes.chars
    end = np.isin(c, _ENDS) | ((c == 46) & np.concatenate([kind[c[1:]] != 2, [True]])[: len(c)])
    k = kind[c]
    digit = k == 2
    first = digit & ~np.concatenate([[False], digit[:-1]])[: len(c)]
    keep = (k == 1) | first
    sent = np.cumsum(end) - end  # number of ends before
    row = codes.row_of()
    chars = np.where(digit, np.uint32(48), _TABLES["lower"][c])[keep]
    of = sent[keep]
    _, first = np.unique(of, return_index=True)
    size = np.diff(np.concatenate([first, [len(chars)]]))
    windows = np.maximum(1, -(-(size - SPAN) // (SPAN // 2)) + 1)
    at = np.repeat(np.arange(len(first)), windows)
    step = np.arange(len(at)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = first[at] + step * (SPAN // 2)
    length = np.minimum(SPAN, first[at] + size[at] - begin)
    start = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    index = np.arange(start[-1]) - np.repeat(start[:-1] - begin, length)
    return chars[index], start, row[keep][begin] if len(begin) else np.zeros(0, np.int64)


def features(chars: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, sentence) of every feature of every sentence."""
    sent = np.repeat(np.arange(len(start) - 1), np.diff(start))
    buckets, where = [], []
    for k in GRAMS:
        h = gram_hashes(chars, k)
        inside = sent[: len(h)] == sent[k - 1 :] if len(h) else np.zeros(0, bool)
        buckets.append(((h[inside] ^ k) & (BUCKETS - 1)).astype(np.int32))
        where.append(sent[: len(h)][inside].astype(np.int32))
    return np.concatenate(buckets), np.concatenate(where)


def _damp(s: np.ndarray, m: int) -> np.ndarray:
    """What a sentence's sum of weights is multiplied by: long sentences count their features less."""
    return (np.maximum(np.bincount(s, minlength=m), 1) / 40.0) ** -DAMP


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sentence_scores(texts: list[str | None], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, text) of every sentence. weights: BUCKETS values and the bias."""
    chars, start, row = sentences(texts)
    b, s = features(chars, start)
    m = len(start) - 1
    return _chance(np.bincount(s, weights=weights[b], minlength=m) * _damp(s, m) + weights[-1]), row


def noisy_or(scores: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """1 - product of (1 - score) by text; a text without sentences gets 0."""
    return 1 - np.exp(np.bincount(row, weights=np.log1p(-np.minimum(scores, 1 - 1e-12)), minlength=n)) if len(row) else np.zeros(n)


def fit(texts: list[str | None], labels: np.ndarray, rounds: int = 60, rate: float = 0.02, pull: float = 1e-3, strength: float = 3.0) -> np.ndarray:
    """Weights that maximise the likelihood of document labels under noisy-or over sentence scores.

    The prior mean of a weight is the log odds of its feature among the labelled documents, shrunk by ``strength`` documents of the
    average kind, times a scale that is chosen with the bias on a grid; ``pull`` holds weights near it. A label is taken to be wrong in a
    share WRONG of cases, which bounds its pull. Adagrad over the whole sample from a fixed start: equal samples give equal weights.
    """
    n = len(texts)
    y = np.asarray(labels, float)
    parts = []
    ones, all_ = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i in range(0, n, 200):
        chars, start, row = sentences(texts[i : i + 200])
        b, s = features(chars, start)
        cells = np.unique(row[s] * BUCKETS + b)
        all_ += np.bincount(cells % BUCKETS, minlength=BUCKETS)
        ones += np.bincount(cells % BUCKETS, weights=y[i + cells // BUCKETS], minlength=BUCKETS)
        parts.append((b, s, row + i, _damp(s, len(start) - 1)))
    share = y.mean()
    p = (ones + strength * share) / (all_ + strength)
    odds = np.log(p / (1 - p)) - np.log(share / (1 - share))

    def sums(w: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(s, weights=w[b], minlength=len(damp)) * damp for b, s, _, damp in parts]

    def safe(q: list[np.ndarray]) -> np.ndarray:
        """Log of the chance that no sentence of a document is unsafe."""
        return sum(np.bincount(row, weights=np.log1p(-np.minimum(x, 1 - 1e-9)), minlength=n) for x, (_, _, row, _) in zip(q, parts, strict=True))

    def likelihood(q: list[np.ndarray]) -> float:
        seen = WRONG + (1 - 2 * WRONG) * (1 - np.exp(safe(q)))
        return float((y * np.log(seen) + (1 - y) * np.log(1 - seen)).sum())

    first = sums(odds)
    grid = [(likelihood([_chance(a * z + c) for z in first]), a, c) for a in (0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.7, 1.0) for c in (-2.0, -3.0, -4.0, -5.0, -6.0, -8.0, -10.0, -13.0, -16.0)]
    _, scale, bias = max(grid)
    mean = scale * odds
    w, g2, gb2 = mean.copy(), np.full(BUCKETS, 1e-2), 1e-2
    for _ in range(rounds):
        q = [_chance(z + bias) for z in sums(w)]
        none = np.exp(safe(q))
        seen = WRONG + (1 - 2 * WRONG) * (1 - none)
        slope = (y / seen - (1 - y) / (1 - seen)) * (1 - 2 * WRONG) * none
        dz = [slope[row] * x for x, (_, _, row, _) in zip(q, parts, strict=True)]  # d document / d z = (1 - document) * sentence
        grad = -pull * n * (w - mean)
        for d, (b, s, _, damp) in zip(dz, parts, strict=True):
            grad += np.bincount(b, weights=(d * damp)[s], minlength=BUCKETS)
        g2 += grad * grad
        w += rate * grad / np.sqrt(g2)
        gb = sum(d.sum() for d in dz)
        gb2 += gb * gb
        bias += rate * gb / np.sqrt(gb2)
    out = np.zeros(BUCKETS + 1, np.float32)
    out[:-1] = w
    out[-1] = bias
    return out


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "unsafe") -> np.ndarray:
    """Weights from at most MAX_LABELLED documents of either label. Without a label of each kind every score is that of the bias."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k is not null and y in (0, 1)").dropDuplicates(["k"])
    least = lambda y: known.filter(F.col("y") == y).orderBy(F.xxhash64("k")).limit(MAX_LABELLED[y])
    sample = least(0).union(least(1))
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k").dropDuplicates(["k"]).orderBy("k").select("t", "y").collect()  # at most the sum of MAX_LABELLED
    if len({r["y"] for r in rows}) < 2:
        out = np.zeros(BUCKETS + 1, np.float32)
        out[-1] = -8
        return out
    return fit([r["t"] for r in rows], np.array([r["y"] for r in rows]))


def scores(documents: DataFrame, weights: np.ndarray, keep: list, text: str = "text") -> DataFrame:
    """keep, score, sentences, worst (number of the worst sentence's text from 1, 0 without) and worst_score, for every row.

    A null, empty or letterless text scores 0. Texts are read whole. The model sent to the executors has a fixed size of 2 MB.
    """
    src = documents.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = widen(src, "score double, sentences int, worst int, worst_score double", ("__text",))
    sent = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, row = sentence_scores(b.column(b.num_columns - 1).to_pylist(), sent.value)
            n = b.num_rows
            count = np.bincount(row, minlength=n)
            first = np.cumsum(count) - count
            top, at = np.zeros(n), np.zeros(n, np.int64)
            if len(p):
                order = np.lexsort((-np.arange(len(p)), p, row))
                last = np.flatnonzero(np.concatenate([row[order][1:] != row[order][:-1], [True]]))
                top[row[order][last]] = p[order][last]
                at[row[order][last]] = order[last] - first[row[order][last]] + 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(noisy_or(p, row, n)), pa.array(count.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(top)], names=schema.names)

    return src.mapInArrow(run, schema)
