"""Problem 9: evaluation texts inside the corpus, by a positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .codes import encode, gram_hashes

#: Consecutive characters of one term.
TERM = 8
#: Terms of evaluation items that are sent to the executors (8 bytes each); more are matched by a join instead.
MAX_SENT_TERMS = 4_000_000


def _is_word() -> np.ndarray:
    """Code point -> letter, ideograph or digit."""
    table = np.zeros(0x110000, bool)
    for code in range(0x110000):
        if not 0xD800 <= code < 0xE000 and chr(code).isalnum():
            table[code] = True
    return table


_WORDS: list[np.ndarray] = []


def word_chars(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, starts) of the texts in their one form, letters, ideographs and digits only."""
    if not _WORDS:
        _WORDS.append(_is_word())
    c = encode(texts)
    keep = _WORDS[0][c.chars]
    at = np.concatenate([[0], np.cumsum(keep)])
    return c.chars[keep], at[c.start]


def postings(df: DataFrame, key: str, text: str, only: np.ndarray | None = None, k: int = TERM) -> DataFrame:
    """(term, key, pos): every term of every text with its place among the text's word characters.

    ``only``: sorted hashes; other terms are not stored. Null and short texts have no terms; texts are indexed whole.
    """
    src = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).filter("key is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            chars, start = word_chars(b.column(1).to_pylist())
            h = gram_hashes(chars, k)
            row = np.repeat(np.arange(len(keys)), np.diff(start))[: len(h)]
            pos = np.arange(len(h)) - start[row] if len(h) else np.zeros(0, np.int64)
            ok = pos <= (np.diff(start)[row] - k) if len(h) else np.zeros(0, bool)
            if only is not None and len(h):
                i = np.searchsorted(only, h)
                ok &= (i < len(only)) & (only[np.minimum(i, max(len(only) - 1, 0))] == h) if len(only) else False
            h, row, pos = h[ok], row[ok], pos[ok]
            for s in range(0, len(h), 200_000):
                e = s + 200_000
                yield pa.RecordBatch.from_arrays([pa.array(h[s:e]), pa.array(keys[row[s:e]].astype(np.int64)), pa.array(pos[s:e].astype(np.int32))], names=["term", "key", "pos"])

    return src.mapInArrow(run, "term bigint, key bigint, pos int")


def passage_matches(corpus: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", run: int = 24, k: int = TERM) -> DataFrame:
    """(doc_id, item_id, item_pos, doc_pos, chars): each maximal run of at least ``run`` equal word characters of item and document.

    The index holds the corpus postings of terms that occur in an item. A run of ``run`` characters has run - k + 1 consecutive terms;
    for each such window of an item its rarest term (by corpus frequency, then hash) is the anchor. Postings of anchors, adjusted by the
    term's offset in the item, name the alignments (document, item, document place - item place); the lists of the other terms are
    looked up by document, term and place for those alignments only. Consecutive places of an alignment are one exact phrase.
    Texts without the look of word characters, null texts and null keys match nothing; repeated rows count once.
    """
    own = materialize(postings(items.dropDuplicates([item]), item, text, None, k).select("term", F.col("key").alias("item_id"), F.col("pos").alias("item_pos")), "item-terms")
    if own.count() <= MAX_SENT_TERMS:
        only = np.unique(own.select("term").distinct().toArrow()["term"].to_numpy())
        index = postings(corpus, key, text, only, k)
    else:
        index = postings(corpus, key, text, None, k).join(own.select("term").distinct(), "term", "left_semi")
    index = materialize(index.select("term", F.col("key").alias("doc_id"), F.col("pos").alias("doc_pos")).distinct(), "index")
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    ranked = own.join(df, "term", "left").withColumn("rank", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "item_pos"))
    span = run - k
    windows = W.partitionBy("item_id").orderBy("item_pos").rowsBetween(0, span)
    anchors = ranked.withColumn("best", F.min("rank").over(windows)).withColumn("full", F.count("*").over(windows)).filter(F.col("full") == span + 1).select("item_id", "best.term", "best.item_pos").distinct()
    aligned = anchors.join(index, "term").select("doc_id", "item_id", (F.col("doc_pos") - F.col("item_pos")).alias("shift")).distinct()
    due = aligned.join(own, "item_id").withColumn("doc_pos", F.col("item_pos") + F.col("shift")).filter("doc_pos >= 0")  # an item's own terms at the places where its alignments want them
    cells = due.join(index, ["doc_id", "term", "doc_pos"], "left_semi").select("doc_id", "item_id", "shift", "item_pos").distinct()
    lane = W.partitionBy("doc_id", "item_id", "shift").orderBy("item_pos")
    islands = cells.withColumn("island", F.col("item_pos") - F.row_number().over(lane)).groupBy("doc_id", "item_id", "shift", "island").agg(F.min("item_pos").alias("item_pos"), (F.count("*") + k - 1).alias("chars"))
    return islands.filter(F.col("chars") >= run).select("doc_id", "item_id", "item_pos", (F.col("item_pos") + F.col("shift")).alias("doc_pos"), "chars")


def leaked_items(matches: DataFrame) -> DataFrame:
    """(doc_id, item_id, passages, longest, proximity): one row per leak; proximity is the least distance between two of its passages."""
    w = W.partitionBy("doc_id", "item_id").orderBy("doc_pos")
    gap = F.col("doc_pos") - F.lag(F.col("doc_pos") + F.col("chars")).over(w)
    return matches.withColumn("gap", gap).groupBy("doc_id", "item_id").agg(F.count("*").alias("passages"), F.max("chars").alias("longest"), F.min("gap").alias("proximity"))
