"""Problem 7: the same or nearly the same records across splits."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.evaluate import common_length as lcs_length
from ..session import materialize, stored, widen
from .canon import canon_texts
from .codes import gram_hashes

#: A word: an ideograph (or other character) of its own, or a run of Latin letters and digits with the marks of a number.
WORD = re.compile(r"[A-Za-zÀ-ɏ]+|\d[\d,.]*\d%?|\d%?|[^\W_]")


def agreement(a: str, b: str, least: float = 0.0) -> float:
    """Twice the characters that agree in order over both lengths; 0 if either text is empty, or if that is below ``least``.

    Rows end as soon as what is left of ``b`` can't bring the common characters to the number that ``least`` asks for.
    """
    if not a or not b:
        return 0.0
    need = math.ceil(least * (len(a) + len(b)) / 2 - 1e-9)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    row = full = (1 << len(a)) - 1
    for start in range(0, len(b), 32):
        for c in b[start : start + 32]:
            hit = row & where.get(c, 0)
            row = ((row + hit) | (row - hit)) & full
        if len(a) - row.bit_count() + max(0, len(b) - start - 32) < need:
            return 0.0
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


#: Buckets of the character counts that bound the agreement of two texts.
BUCKETS = 64


def bags(forms: list[str]) -> np.ndarray:
    """For each text the counts of its characters in BUCKETS buckets."""
    sizes = np.fromiter((len(f) for f in forms), np.int64, len(forms))
    c = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.repeat(np.arange(len(forms)) * BUCKETS, sizes) + ((c * np.uint32(2654435761)) >> np.uint32(26))
    return np.bincount(at, minlength=len(forms) * BUCKETS).astype(np.int32).reshape(-1, BUCKETS)


def could_agree(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which texts of the bags ``b`` may agree with that of the bag ``a``. The characters common to both bags bound the common subsequence from above."""
    return 2 * np.minimum(a, b).sum(axis=1) >= least * (a.sum() + b.sum(axis=1)) - 1e-9


def word_grams(form: str, k: int = 5) -> np.ndarray:
    """Distinct hashes of each k consecutive words; a text of fewer words gives one hash of all of them."""
    words = WORD.findall(form)
    if not words:
        return np.zeros(0, np.int64)
    ids = np.fromiter((hash_word(w) for w in words), np.uint64, len(words))
    return np.unique(gram_hashes(ids, min(k, len(words))))


def hash_word(w: str) -> int:
    if len(w) == 1:
        return ord(w)
    h = 1469598103934665603
    for c in w:
        h = ((h ^ ord(c)) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


def text_forms(df: DataFrame) -> DataFrame:
    """``df`` with the form of each row's text in place of the text; blank texts are left out."""
    src = df.select(*[c for c in df.columns if c != "text"], F.col("text").alias("__text"))
    schema = widen(src, "form string", ("__text",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = canon_texts(b.column(b.num_columns - 1).to_pylist())
            out = pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(forms, pa.string())], names=schema.names)
            yield out.filter(pa.array([f != "" for f in forms]))

    return src.mapInArrow(run, schema)


def couples(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, starts): each two consecutive characters of every text with how often they stood before in it, so that tokens of a text are distinct."""
    sizes = np.fromiter((len(f) for f in forms), np.int64, len(forms))
    c = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(forms)), sizes)
    inner = np.flatnonzero(text[1:] == text[:-1])
    pair, of = (c[inner] << 21) | c[inner + 1], text[inner]
    order = np.lexsort((pair, of))
    pair, of = pair[order], of[order]
    at = np.arange(len(pair))
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])
    nth = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return pair + (np.minimum(nth, (1 << 21) - 1) << 42), np.searchsorted(of, np.arange(len(forms) + 1))


def may_agree(a: list[str], b: list[str], least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each text of ``a`` the texts of ``b`` whose length and shared couples of characters allow an agreement of ``least``; leaves out none that agrees."""
    return meeting(couples(a), np.array([len(x) for x in a], np.int64), postings(b), least)


def postings(forms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The couples of all texts in their order, the text of each, and the lengths of the texts."""
    tokens, starts = couples(forms)
    order = np.argsort(tokens, kind="stable")
    return tokens[order], np.repeat(np.arange(len(forms), dtype=np.int32), np.diff(starts))[order], np.array([len(x) for x in forms], np.int64)


def meeting(a: tuple[np.ndarray, np.ndarray], long: np.ndarray, b: tuple[np.ndarray, np.ndarray, np.ndarray], least: float) -> Iterator[tuple[int, np.ndarray]]:
    """As ``may_agree``, for the couples and lengths of one side and the postings of the other.

    Texts of s characters together that agree have L >= least * s / 2 characters in common order. These fall into runs that stand in both
    texts, and between two runs is one of the s - 2L other characters at least, so there are 1 + s - 2L runs at most, and a run of r
    characters has r - 1 couples: the texts share 3L - s - 1 couples or more.
    """
    (ta, sa), (tb, of, size) = a, b
    if not len(long) or not len(size):
        return
    first, last = np.searchsorted(tb, ta), np.searchsorted(tb, ta, "right")
    for i, n_i in enumerate(long.tolist()):
        s = size + n_i
        common = np.ceil(least * s / 2 - 1e-9)
        fits = common <= np.minimum(size, n_i)
        if not fits.any():
            continue
        lo, hi = first[sa[i] : sa[i + 1]], last[sa[i] : sa[i + 1]]
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(of[at], minlength=len(size))
        yield i, np.flatnonzero(fits & (shared >= 3 * common - s - 1))


#: Characters of the texts of one block; each block of evaluation forms meets each block of training forms of a length that can agree.
#: Blocks of training forms that a task takes for one block of evaluation forms, one after the other.
BLOCK, TOGETHER = 400_000, 4


def agreeing(forms: DataFrame, least: float) -> DataFrame:
    """(field, e, t, containment, similarity) of every pair of an evaluation and a training form that agree. forms: places (side, field), id, form.

    Lengths are dealt into bands of a factor 1.5; forms of agreement ``least`` are at most ``reach`` bands apart. A band is cut into blocks
    by its characters. Blocks are stored once, as a folder each, and a task reads the two that it compares from there, so nothing is
    copied for each pair of blocks, and a task holds two blocks, however many forms there are.
    """
    reach = int(np.ceil(np.log((2 - least) / least) / np.log(1.5) - 1e-9)) if least > 0 else 99
    band = F.floor(F.log(F.length("form")) / F.log(F.lit(1.5)) + 1e-9).cast("int")
    each = forms.select(F.explode("places").alias("place"), "id", "form").select("place.side", "place.field", band.alias("band"), "id", "form")
    sizes = materialize(each.select("side", "field", "band", "id", F.length("form").alias("chars")).dropDuplicates(["side", "field", "id"]), "sizes")
    cut = materialize(sizes.groupBy("side", "field", "band").agg(F.ceil(F.sum("chars") / BLOCK).cast("int").alias("blocks")), "cut")  # some lines a field
    block = F.concat_ws("-", "side", "field", "band", F.pmod("id", F.col("blocks")).cast("string"))
    dealt = each.join(F.broadcast(cut), ["side", "field", "band"]).select(block.alias("block"), "id", "form").repartition("block").dropDuplicates(["block", "id"])
    root = stored(dealt, "blocks", "block", "zstd")
    there = sizes.join(F.broadcast(cut), ["side", "field", "band"]).select("side", "field", "band", block.alias("block")).distinct()
    e, t = (there.filter(F.col("side") == x).select("field", F.col("band").alias(f"band_{x}"), F.col("block").alias(x)) for x in "et")
    cells = e.join(t, "field").filter(F.abs(F.col("band_e") - F.col("band_t")) <= reach)
    cells = cells.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("e").orderBy("t")) - 1) / TOGETHER)).groupBy("field", "e", "part").agg(F.collect_list("t").alias("t"))
    cells = materialize(cells.drop("part"), "cells")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for field, one, others in zip(*(b.column(c).to_pylist() for c in ("field", "e", "t")), strict=True):
                ids_a, a = read_block(root, one)
                side_a, bags_a, long = couples(a), bags(a), np.array([len(x) for x in a], np.int64)
                for other in others:
                    ids_b, bs = read_block(root, other)
                    bags_b, rows = bags(bs), []
                    for i, js in meeting(side_a, long, postings(bs), least):
                        for j in js[could_agree(bags_a[i], bags_b[js], least)].tolist():
                            x, y = a[i], bs[j]
                            similarity = 1.0 if x == y else agreement(x, y, least)
                            if similarity >= least - 1e-12:
                                gx, gy = word_grams(x), word_grams(y)
                                rows.append((field, ids_a[i], ids_b[j], len(np.intersect1d(gx, gy)) / max(1, len(gx)), similarity))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["field", "e", "t", "containment", "similarity"])

    tasks = max(1, min(cells.count(), 20_000))
    return cells.repartition(tasks).mapInArrow(compare, "field int, e bigint, t bigint, containment double, similarity double")


def read_block(root: str, block: str) -> tuple[list[int], list[str]]:
    """ids and forms of a stored block."""
    files, path = fs.FileSystem.from_uri(f"{root}/block={block}")
    x = pq.read_table(path, columns=["id", "form"], filesystem=files, partitioning=None, use_threads=False)
    return x["id"].to_pylist(), x["form"].to_pylist()


def split_overlaps(records: DataFrame, key: str, split: str, texts: list[str], train: str = "train", evaluation: tuple[str, ...] = ("validation", "test"), least: float = 0.8, splits: DataFrame | None = None) -> DataFrame:
    """(key_train, key_eval, field, containment, similarity) for every evaluation record and training record that agree.

    ``splits``: (key, split), where ``records`` don't hold the split.

    1. Each distinct text is brought to its one form; each distinct form of a field and side is handled once, with its records aside, which
       know texts by hash, so that no text is moved for each of its records.
    2. Every pair of an evaluation and a training form is a candidate whose lengths, shared couples of characters and character counts
       allow the agreement (``agreeing``). These bounds follow from the agreement, so no agreeing pair is left out.
    3. Each candidate is checked exactly: characters in agreement >= ``least``. containment is the share of the evaluation form's
       word five-grams that the training form holds.
    Null and blank texts never agree; records without key or split are left out; repeated rows count once; an empty table gives no rows.
    """
    side = F.when(F.col(split) == train, F.lit("t")).when(F.col(split).isin(*evaluation), F.lit("e"))
    fields = F.array(*[F.struct(F.lit(i).alias("field"), F.col(t).cast("string").alias("text")) for i, t in enumerate(texts)])
    own = [side.alias("side")] if splits is None else []
    flat = records.select(F.col(key).cast("string").alias("key"), *own, F.explode(fields).alias("x")).filter("key is not null and x.text is not null").select("*", "x.field", "x.text").drop("x").withColumn("raw", F.unhex(F.md5("text")))
    placed = flat.drop("text")
    if splits is not None:
        placed = placed.join(splits.select(F.col(key).cast("string").alias("key"), side.alias("side")).distinct(), "key")
    spelled = materialize(placed.filter("side is not null").groupBy("key", "side", "field").agg(F.min("raw").alias("raw")), "spelled")
    places = spelled.groupBy("raw").agg(F.collect_set(F.struct("side", "field")).alias("places"))
    once = flat.select("raw", "text").dropDuplicates(["raw"]).join(places, "raw")
    forms = materialize(text_forms(once).withColumn("id", F.xxhash64("form")), "forms", "zstd")
    member = spelled.join(forms.select("raw", "id"), "raw").select("key", "side", "field", "id")

    found = materialize(agreeing(forms, least), "agreeing")
    me = member.filter("side = 'e'").select(F.col("key").alias("key_eval"), "field", F.col("id").alias("e"))
    mt = member.filter("side = 't'").select(F.col("key").alias("key_train"), "field", F.col("id").alias("t"))
    name = F.element_at(F.array(*map(F.lit, texts)), F.col("field") + 1)
    return found.join(me, ["field", "e"]).join(mt, ["field", "t"]).select("key_train", "key_eval", name.alias("field"), "containment", "similarity")
