"""Problem 8: documents into containers of fixed capacity."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, widen

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern of the public byte-level vocabulary (GPT-2).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Places where a pre-token is sure to end: between two kinds of characters, unless the first is a blank or an apostrophe, which may belong to what follows.
_BORDER = regex.compile(r"(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])")


def pieces(t: str, size: int) -> list[str]:
    """The text cut into pieces of about ``size`` characters whose tokens together are those of the whole; a run without a sure border stays whole."""
    out, at = [], 0
    while len(t) - at > size:
        m = _BORDER.search(t, at + size)
        if not m:
            break
        out.append(t[at : m.start()])
        at = m.start()
    return [*out, t[at:]]


def token_counts(df: DataFrame, text: str, keep: list, path: str = TOKENIZER, piece: int = 20_000) -> DataFrame:
    """keep and ``tokens``, the exact number of tokens of the text; 0 for null and empty texts.

    ``path``: a tiktoken rank file that the driver can read; it is sent to the executors. Long texts are encoded in pieces (``pieces``).
    """
    src = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = widen(src, "tokens bigint", ("__text",))
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(SparkFiles.get(name))
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            n = [sum(len(enc.encode_ordinary(x)) for x in pieces(t, piece)) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)


def first_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of every size, each in the first bin that has room (sizes in the order given, all <= capacity).

    A tournament tree holds the most room left below each node; the first bin with room is found from the root in log(bins) steps.
    """
    n = max(1, len(sizes))
    leaves = 1 << (n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    out = np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < s:
                node += 1
        out[i] = node - leaves
        tree[node] -= s
        node //= 2
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left >= right else right
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return out


def pack(items: DataFrame, windows: DataFrame, key: str = "doc_id", size: str = "tokens", group_items: int = 4_000, seed: int = 17) -> DataFrame:
    """(window_id, capacity, key, part, tokens, group, bin): where every item, or part of an item, goes for each capacity.

    Items are spread over groups of about ``group_items`` by a seeded hash of their key, so groups are random, bounded and packed
    independently: sorted by falling size, then first fit by a tournament tree. An item longer than the capacity is cut into full
    containers, and its rest is packed like an item; no other item is cut. Bins are numbered within their group.
    Items of size 0 or without size take no space and lie in their group's first container; items without key are left out; repeated rows
    count once; capacities below 1 are left out.
    """
    w = windows.select(F.col("window_id").cast("int").alias("window_id"), F.col("capacity_tokens").cast("bigint").alias("capacity")).filter("capacity >= 1").dropDuplicates(["window_id"])
    once = items.select(F.col(key).alias("key"), F.greatest(F.lit(0), F.coalesce(F.col(size).cast("bigint"), F.lit(0))).alias("tokens")).filter("key is not null").dropDuplicates(["key"])
    groups = max(1, -(-once.count() // group_items))
    placed = once.withColumn("group", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(groups)).cast("int"))
    each = placed.crossJoin(F.broadcast(w))  # windows: a few rows, one per capacity
    kind = dict(once.dtypes)["key"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["tokens", "key"], ascending=[False, True], kind="stable")
        sizes = pdf["tokens"].to_numpy()
        full, rest = sizes // capacity, sizes % capacity
        whole = (rest == 0) & (sizes > 0)
        full, rest = np.where(whole, full - 1, full), np.where(whole, capacity, rest)
        order = np.argsort(-rest, kind="stable")
        bins = np.empty(len(rest), np.int64)
        bins[order] = first_fit(rest[order], capacity)
        base = bins.max() + 1
        keys = pdf["key"].to_numpy()
        at = np.repeat(np.arange(len(keys)), full)
        part = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full)
        return pd.DataFrame(
            {
                "window_id": pdf["window_id"].iloc[0],
                "capacity": capacity,
                "key": np.concatenate([keys[at], keys]),
                "part": np.concatenate([part, full]).astype(np.int64),
                "tokens": np.concatenate([np.full(len(at), capacity), rest]).astype(np.int64),
                "group": pdf["group"].iloc[0],
                "bin": np.concatenate([base + np.arange(len(at)), bins]).astype(np.int64),
            }
        )

    return each.groupBy("window_id", "group").applyInPandas(run, f"window_id int, capacity bigint, key {kind}, part bigint, tokens bigint, `group` int, bin bigint")


def fills(packed: DataFrame) -> DataFrame:
    """(window_id, group, bin, items, tokens, capacity, fill) of every container."""
    return packed.groupBy("window_id", "group", "bin").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.first("capacity").alias("capacity")).withColumn("fill", F.col("tokens") / F.col("capacity"))


def packed_documents(documents: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``pack`` over the token counts of ``documents``, which are counted once and kept in the shared folder."""
    sized = materialize(token_counts(documents, text, [F.col(key).alias("doc_id")], path), "tokens")
    return pack(sized, windows).withColumnRenamed("key", "doc_id")
