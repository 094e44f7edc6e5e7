"""Problem 5: defective prompt and response pairs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, widen
from .canon import canon_texts
from .codes import gram_hashes, mix
from .cutoff import ANSWER, answer_columns, answer_scores, chinese, no_answer, parts
from .overlap import WORD, hash_word, lcs_length

#: Words of a shingle; words of a lead, whose shingles are clustered; hash functions and bands of the signature; least similarity of two
#: leads of one cluster. Six words of twenty-four in a row may differ: 16 shingles of 30 are common.
SHINGLE, LEAD, HASHES, BANDS, SIMILAR = 2, 24, 48, 24, 0.5
#: Leads of one bucket that a task compares at once, in pairs; larger buckets are cut into blocks.
BUCKET = 4_000
#: Shingle hashes that are sent to the executors (8 bytes each); more are matched by a join.
MAX_SENT_SHINGLES = 2_000_000
#: An answer is foreign to the prompts if it shares fewer of its shingles with them than this part of what prompts share among each other.
FOREIGN = 0.6
# Greetings that say nothing of the answer.
GREETING = re.compile(r"^(?:您好|你好|抱歉|很抱歉|非常抱歉|对不起)[,!。:]?")


def words(form: str) -> list[str]:
    return ["0" if w[0].isdigit() else w for w in WORD.findall(form)]


def shingles(ws: list[str], k: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of k consecutive words (of all words, where there are fewer)."""
    if not ws:
        return np.zeros(0, np.int64)
    return np.unique(gram_hashes(np.fromiter((hash_word(w) for w in ws), np.uint64, len(ws)), min(k, len(ws))))


_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64))


def band_keys(sets: list[np.ndarray]) -> list[np.ndarray]:
    """For every shingle set the keys of its MinHash bands; none for an empty set."""
    size = np.fromiter((len(x) for x in sets), np.int64, len(sets))
    full = np.flatnonzero(size)
    out = [np.zeros(0, np.int64)] * len(sets)
    if len(full):
        items = np.concatenate([sets[i] for i in full]).view(np.uint64)
        first = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        sig = np.stack([np.minimum.reduceat(mix(items ^ s), first) for s in _SEEDS], axis=1).reshape(len(full), BANDS, -1)
        key = np.zeros((len(full), BANDS), np.uint64)
        for j in range(sig.shape[2]):
            key = mix(key ^ sig[:, :, j])
        key = mix(key ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)
        for i, k in zip(full.tolist(), key, strict=True):
            out[i] = k
    return out


def lead_words(bare: str, n: int = LEAD) -> list[str]:
    """The first words, without greetings."""
    return words(GREETING.sub("", GREETING.sub("", bare))[: 8 * n])[:n]


def is_copy(bare: str, gold: str, slack: int = 2, lead: int = 30) -> bool:
    """The answer repeats the gold text from beginning to end: ``slack`` characters may differ, and up to ``lead`` may stand before it.

    A lead-in before a literal repetition may be as long as the gold text.
    """
    if not gold or len(gold) < 4 or not len(gold) - slack <= len(bare) <= len(gold) + max(lead, len(gold)):
        return False
    if bare.endswith(gold):
        return True
    if len(bare) > len(gold) + lead or lcs_length(gold, bare) < len(gold) - slack:
        return False
    return edits_to_tail(gold, bare) <= slack


def edits_to_tail(a: str, b: str) -> int:
    """Least edit distance between ``a`` and any ending of ``b`` (rows over a, vectorised by a running minimum)."""
    bb = np.frombuffer(b[::-1].encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(bb)
    idx = np.arange(n + 1)
    row = idx.copy()
    for i, c in enumerate(a[::-1], 1):
        sub = row[:-1] + (bb != ord(c))
        best = np.minimum(row[1:] + 1, sub)
        new = np.concatenate([[i], best])
        row = np.minimum.accumulate(new - idx) + idx
    return int(row.min())


def shares(sets: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """For every set the share of its items that are in ``known`` (sorted); 1 for an empty set."""
    size = np.fromiter((len(x) for x in sets), np.int64, len(sets))
    if not size.sum() or not len(known):
        return np.where(size > 0, 0.0, 1.0)
    items = np.concatenate(sets)
    hit = known[np.minimum(np.searchsorted(known, items), len(known) - 1)] == items
    got = np.bincount(np.repeat(np.arange(len(sets)), size), weights=hit, minlength=len(sets))
    return np.where(size > 0, got / np.maximum(size, 1), 1.0)


def prompt_rows(df: DataFrame, prompt: str) -> DataFrame:
    """form (without label and final mark) and its shingles for every different prompt that isn't blank."""
    src = df.select(F.col(prompt).cast("string").alias("g")).filter("g is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bare = [x for x in (parts(None, f)[1] for f in canon_texts(b.column(0).to_pylist())) if x]
            yield pa.RecordBatch.from_arrays([pa.array(bare, pa.string()), pa.array([shingles(words(x)) for x in bare], pa.list_(pa.int64()))], names=["form", "shingles"])

    return src.mapInArrow(run, "form string, shingles array<bigint>")


def reply_rows(df: DataFrame, source: str, key: str, prompt: str, reply: str, known: np.ndarray | None) -> DataFrame:
    """source, key, prompt_id, the columns ANSWER, label (open, empty, language, copy or null), shingles and share, for each pair once.

    share: how many of the answer's shingles are in ``known``, the prompts' shingles (sorted); null where ``known`` isn't sent.
    """
    once = df.filter(F.col(key).isNotNull()).dropDuplicates([source, key])
    src = once.select(F.col(source).cast("string").alias("source"), F.col(key).cast("string").alias("key"), F.xxhash64(F.col(prompt).cast("string")).alias("prompt_id"), F.col(prompt).cast("string").alias("__p"), F.col(reply).cast("string").alias("__r"))
    schema = widen(src, ANSWER + ", label string, shingles array<bigint>, share double", ("__p", "__r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(b.num_columns - 1).to_pylist()
            both = canon_texts([*b.column(b.num_columns - 2).to_pylist(), *raw])
            golds, forms = both[: b.num_rows], both[b.num_rows :]
            cols = answer_columns(raw, forms)
            bare = cols[3].to_pylist()
            labels: list[str | None] = []
            for gold, form, x in zip(golds, forms, bare, strict=True):
                if parts(None, form)[2]:
                    labels.append("open")
                elif no_answer(x):
                    labels.append("empty")
                elif is_copy(x, parts(None, gold)[1]):
                    labels.append("copy")
                else:
                    labels.append(None if chinese(x) else "language")
            sets = [shingles(words(x)) for x in bare]
            share = pa.nulls(b.num_rows, pa.float64()) if known is None else pa.array(shares(sets, known))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *cols, pa.array(labels, pa.string()), pa.array(sets, pa.list_(pa.int64())), share], names=schema.names)

    return src.mapInArrow(run, schema)


def lead_rows(rows: DataFrame) -> DataFrame:
    """source, key, prompt_id, share, shingles, lead (the shingles of the first words), bands and lead_id of ``rows``."""
    src = rows.select("source", "key", "prompt_id", "share", "shingles", "bare")
    schema = widen(src, "lead array<bigint>, bands array<bigint>", ("bare",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lead = [shingles(lead_words(x)) for x in b.column(b.num_columns - 1).to_pylist()]
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lead, lists), pa.array(band_keys(lead), lists)], names=schema.names)

    return src.mapInArrow(run, schema).withColumn("lead_id", F.xxhash64("lead"))


def bucket_links(ids: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(id, root) of the members of one bucket that hang together by pairs of sets with a Jaccard similarity of SIMILAR or more; all pairs are compared."""
    size = np.array([len(x) for x in sets], np.int64)
    of = np.repeat(np.arange(len(sets)), size)
    items = np.concatenate(sets)
    order = np.argsort(items, kind="stable")
    items, of = items[order], of[order]
    root = np.arange(len(sets))
    for i in range(1, len(sets)):
        lo, hi = np.searchsorted(items, sets[i]), np.searchsorted(items, sets[i], "right")
        n = hi - lo
        shared = np.bincount(of[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(sets))[:i]
        near = np.unique(root[:i][shared >= SIMILAR * (size[:i] + size[i] - shared)])
        if len(near):
            root[i] = near[0]
            if len(near) > 1:
                root[np.isin(root, near)] = near[0]
    joined = root != np.arange(len(sets))
    return ids[joined], ids[root[joined]]


def near_leads(flat: DataFrame, most: int = BUCKET) -> DataFrame:
    """(a, b): links that connect the leads of ``flat`` (band, lead_id, lead) that hang together by pairs of SIMILAR or more.

    A band of up to ``most`` leads is one group, where all pairs are compared. A larger one is dealt into blocks by a hash of lead and band; after
    all pairs of every block are compared, only one lead of each group found goes on to the next round, until the band fits or doesn't
    shrink any more. That connects most of what hangs together; every link that is left out, since leads lay in different blocks, were
    held by another lead or met in no band, is found by ``missing_links``. No task holds more than twice ``most`` leads.
    """
    from .companies import components

    def inside(t: pa.Table) -> pa.Table:
        a, b = bucket_links(t["lead_id"].to_numpy(), [np.array(x, np.int64) for x in t["lead"].to_pylist()])
        return pa.table({"band": np.full(len(a), t["band"][0].as_py()), "a": a, "b": b})

    level, out, before = flat, None, None
    while True:
        size = level.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
        size = materialize(size.withColumn("blocks", F.ceil(F.col("n") / most).cast("int")), "bands")
        hot = size.filter("blocks > 1").agg(F.count("*"), F.sum("n")).first()
        stuck = before is not None and hot[0] and hot[1] > 0.8 * before
        dealt = level.join(size.filter("blocks = 1") if stuck else size, "band").withColumn("block", F.pmod(F.xxhash64("lead_id", "band"), F.col("blocks")).cast("int"))
        found = materialize(dealt.groupBy("band", "block").applyInArrow(inside, "band bigint, a bigint, b bigint"), "near")
        out = found if out is None else out.unionByName(found)
        if not hot[0] or stuck:
            break
        roots = level.join(size.filter("blocks > 1").select("band"), "band", "left_semi").join(found.select("band", F.col("a").alias("lead_id")), ["band", "lead_id"], "left_anti")
        level, before = materialize(roots, "roots"), hot[1]
    links = materialize(out.select("a", "b").distinct(), "links")
    comp = components(links.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")))
    clusters = comp.select(F.col("node").cast("bigint").alias("lead_id"), F.col("root").cast("bigint").alias("cluster"))
    return links.unionByName(missing_links(flat.select("lead_id", "lead").dropDuplicates(["lead_id"]), clusters, most)).distinct()


def missing_links(leads: DataFrame, clusters: DataFrame, most: int = BUCKET) -> DataFrame:
    """(a, b): links between different ``clusters`` (lead_id, cluster; a lead without one is its own) of ``leads`` (lead_id, lead); leaves out no two clusters that hang together.

    Two leads of a similarity of SIMILAR have SIMILAR of the shingles of either in common; so the rarest ones of both meet, of each lead as many as
    may be missing and one more. Leads meet over these. The largest cluster that meets over a shingle is not compared inside, the others are
    compared with all that meet there, in blocks of ``most``.
    """
    each = leads.select("lead_id", F.explode("lead").alias("g"))
    common = each.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
    rare = each.join(common, "g", "left").groupBy("lead_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "g"))).alias("r"))  # the shingles of one lead
    part = (F.size("r") - F.ceil(F.size("r") * SIMILAR - 1e-9) + 1).cast("int")
    slots = rare.select("lead_id", F.explode(F.slice("r", F.lit(1), part)).alias("x")).filter("x.n > 1").select("lead_id", F.col("x.g").alias("g"))
    slots = materialize(slots.join(clusters, "lead_id", "left").withColumn("cluster", F.coalesce("cluster", "lead_id")), "slots")
    here = slots.groupBy("g", "cluster").agg(F.count("*").alias("n")).groupBy("g").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("held"), F.count("*").alias("clusters")).filter("clusters > 1")
    here = here.select("g", "main", F.ceil(F.col("n") / most).cast("int").alias("wide"), F.ceil((F.col("n") - F.col("held")) / most).cast("int").alias("high"))
    rows = materialize(slots.join(here, "g").join(leads, "lead_id"), "meeting")
    block = lambda n: F.pmod(F.xxhash64("lead_id", "g"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = rows.filter("cluster != main").select("g", "lead_id", "cluster", "lead", F.lit(True).alias("one"), block("high").alias("high"), every("wide").alias("wide"))
    all_ = rows.select("g", "lead_id", "cluster", "lead", F.lit(False).alias("one"), every("high").alias("high"), block("wide").alias("wide"))

    def across(t: pa.Table) -> pa.Table:
        one = t["one"].to_numpy()
        lists = [np.array(x, np.int64) for x in t["lead"].to_pylist()]
        ids, cluster = t["lead_id"].to_numpy(), t["cluster"].to_numpy()
        a, b = cross_links(ids[one], cluster[one], [x for x, o in zip(lists, one, strict=True) if o], ids[~one], cluster[~one], [x for x, o in zip(lists, one, strict=True) if not o])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return one.unionByName(all_).groupBy("g", "high", "wide").applyInArrow(across, "a bigint, b bigint")


def cross_links(ids: np.ndarray, cluster: np.ndarray, sets: list[np.ndarray], to: np.ndarray, to_cluster: np.ndarray, to_sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links that connect the clusters of the first leads with those of the others, by pairs of sets with a Jaccard similarity of SIMILAR or more; all pairs are compared."""
    a: list[int] = []
    b: list[int] = []
    if not sets or not to_sets:
        return a, b
    size = np.array([len(x) for x in to_sets], np.int64)
    of = np.repeat(np.arange(len(to_sets)), size)
    items = np.concatenate(to_sets)
    order = np.argsort(items, kind="stable")
    items, of = items[order], of[order]
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        lo, hi = np.searchsorted(items, x), np.searchsorted(items, x, "right")
        n = hi - lo
        shared = np.bincount(of[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(to_sets))
        near = np.flatnonzero((shared >= SIMILAR * (size + len(x) - shared)) & (to_cluster != cluster[i]))
        for k in np.unique(to_cluster[near], return_index=True)[1].tolist():
            j = near[k]
            p, q = top(int(cluster[i])), top(int(to_cluster[j]))
            if p != q:
                up[p] = q
                a.append(int(ids[i]))
                b.append(int(to[j]))
    return a, b


def lead_clusters(rows: DataFrame, most: int = BUCKET) -> DataFrame:
    """(lead_id, cluster): leads (lead_id, lead, bands) that hang together by pairs of which SIMILAR or more of the shingles are common.

    Equal leads are one row. Leads meet in the buckets of their MinHash bands (similarity 0.5: in one of them with a chance of 0.999), where
    pairs are verified; pairs that don't meet there are found over their rarest shingles, so that none is left out (``near_leads``). Labels are
    spread along the links until nothing changes.
    """
    from .companies import components

    one = rows.filter(F.size("lead") > 0).select("lead_id", "lead", "bands").dropDuplicates(["lead_id"])
    good = near_leads(materialize(one.select("lead_id", "lead", F.explode("bands").alias("band")), "leads"), most)
    comp = components(good.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")))
    return one.select("lead_id").join(comp.select(F.col("node").cast("bigint").alias("lead_id"), F.col("root").cast("bigint").alias("cluster")), "lead_id", "left").select("lead_id", F.coalesce("cluster", "lead_id").alias("cluster"))


def refusals(foreign: DataFrame, gold: DataFrame, asked: int, prompts: int = 2) -> DataFrame:
    """(source, key) of the refusals among ``foreign`` (as ``lead_rows``), answers that aren't worded like prompts; gold: (g, n) the shingles of ``asked`` prompts.

    1. Leads are clustered. A cluster that recurs over ``prompts`` or more different prompts is a template of refusals, and so are all its answers.
    2. What refusals are worded like is learned from these templates: the log odds of each shingle among their different leads
       against the prompts. An answer outside of them is a refusal if its shingles speak for it in sum.
    Without a recurring template there are no refusals.
    """
    clusters = materialize(lead_clusters(foreign), "clusters")
    f = foreign.join(clusters, "lead_id")
    # a template held by a third of all rows is combined by cluster and prompt before it is counted
    spread = f.groupBy("cluster", "prompt_id").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.count("*").alias("prompts"))
    f = materialize(f.join(spread, "cluster").select("source", "key", "lead_id", "shingles", "prompts"), "foreign")
    shown = f.filter(F.col("prompts") >= prompts).dropDuplicates(["lead_id"])
    model = shown.select(F.explode("shingles").alias("g")).groupBy("g").agg(F.count("*").alias("r"))
    sizes = shown.agg(F.count("*").alias("rs"))  # one row
    rest = f.filter(F.col("prompts") < prompts).select("source", "key", F.explode("shingles").alias("g"))
    odds = F.log(F.coalesce("r", F.lit(0)) + 0.5) - F.log(F.col("rs") + 1) - F.log(F.coalesce("n", F.lit(0)) + 0.5) + F.log(F.lit(asked + 1.0))
    odds = F.when(F.col("r").isNull() & F.col("n").isNull(), 0.0).otherwise(odds)  # never seen: says nothing
    told = rest.join(model, "g", "left").join(gold, "g", "left").crossJoin(F.broadcast(sizes)).groupBy("source", "key").agg(F.sum(odds).alias("odds"), F.max("r").alias("r"))
    return f.filter(F.col("prompts") >= prompts).select("source", "key").unionByName(told.filter("odds > 0 and r is not null").select("source", "key"))


def defects(df: DataFrame, source: str = "config", key: str = "sample_id", prompt: str = "reference", reply: str = "prediction", prompts: int = 2, least: int = 5) -> DataFrame:
    """(source, key, defect) for each defective pair, with at most one defect.

    An answer is foreign if fewer of its shingles occur in prompts than FOREIGN times what prompts (half of them) share with other
    prompts; answers of fewer than ``least`` shingles are not judged. Foreign answers in templates that recur over at least ``prompts`` different prompts, and what is worded like these, are
    refusals (``refusals``). Then empty, copy, language and truncated (``cutoff``).
    Nulls count as empty answers; pairs without key are left out; repeated rows count once; a null prompt can't be copied.
    """
    asked = materialize(prompt_rows(df, prompt), "prompts")
    gold = materialize(asked.select(F.explode("shingles").alias("g")).groupBy("g").agg(F.count("*").alias("n")), "gold")
    known = np.sort(gold.select("g").toArrow()["g"].to_numpy().copy()) if gold.count() <= MAX_SENT_SHINGLES else None
    rows = materialize(reply_rows(df, source, key, prompt, reply, known), "replies")
    pair = ["source", "key"]
    if known is None:
        part = rows.select(*pair, F.explode("shingles").alias("g")).join(gold, "g", "left").groupBy(*pair).agg(F.avg(F.col("n").isNotNull().cast("int")).alias("share"))
        rows = materialize(_add(rows.drop("share"), part), "replies").withColumn("share", F.coalesce("share", F.lit(1.0)))
    each = asked.select(F.xxhash64("form").alias("id"), F.explode("shingles").alias("g")).join(gold, "g").groupBy("id").agg(F.avg((F.col("n") > 1).cast("int")).alias("own"))
    usual = each.agg((F.coalesce(F.median("own"), F.lit(1.0)) * FOREIGN).alias("usual"))
    foreign = rows.filter(F.col("label").isNull() & (F.size("shingles") >= least)).crossJoin(F.broadcast(usual)).filter("share < usual")  # usual: one row
    refused = refusals(materialize(lead_rows(foreign), "foreign"), gold, asked.count(), prompts).withColumn("refusal", F.lit("refusal"))
    cuts = answer_scores(rows, asked.select("form")).filter("cut").select(*pair, F.lit("truncated").alias("truncated"))
    out = _add(_add(rows.select(*pair, F.when(F.col("label") != "open", F.col("label")).alias("label")), refused), cuts)
    return out.withColumn("defect", F.coalesce("label", "refusal", "truncated")).filter("defect is not null").select(*pair, "defect")


def _add(x: DataFrame, y: DataFrame) -> DataFrame:
    """``x`` with the columns of ``y`` by (source, key); a null source equals itself."""
    y = y.withColumnRenamed("source", "s_").withColumnRenamed("key", "k_")
    return x.join(y, F.col("source").eqNullSafe(F.col("s_")) & (F.col("key") == F.col("k_")), "left").drop("s_", "k_")
