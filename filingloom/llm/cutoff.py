"""Problem 2: texts cut off by field limits."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, widen
from .canon import canon_texts

#: Longest ending, in characters, whose continuations are counted; weight of the shorter ending in the estimate of a longer one.
DEPTH, WEIGHT = 10, 10.0
#: Endings that are sent to the executors (8 bytes each); more are matched by a join.
MAX_SENT_ENDINGS = 4_000_000

# Labels and markup that stand before an answer (one form, spaces dropped).
LABEL = re.compile(r"^(?:[*#>`_\-]|\d{1,2}[.、)](?=\D|$)|监管问询(?:子)?问题|问询(?:问题|函)?(?=[:*]|$)|(?:子)?问题\d*(?=[:：]|$)|答(?:案|复)?(?=[:：]|$)|[:：])+")
MARKED = re.compile(r"[。?!…*`_#\"'”’)\]】》」;.]+$")
THINK = re.compile(r"<think>.*?(?:</think>|$)", re.S)
# What stands in for an answer that isn't there (one form, without brackets and marks).
STAND_INS = {"无", "暂无", "空", "略", "没有", "暂缺", "待补充", "none", "null", "nan", "n/a", "na", "nil", "未知", "无内容", "无回答", "无输出"}
# Brackets and quotes, opening and closing.
OPEN, CLOSE = "([{“‘《【「", ")]}”’》】」"
FINAL, HANGING = "。?!", ",、:(“‘《【「[{<"


def parts(text: str | None, form: str | None = None) -> tuple[str, str, bool]:
    """(body, bare, open): the answer's form without reasoning and label, the same without final marks, and whether a reasoning block is open."""
    form = form if form is not None else ""
    opened = "<think>" in form and "</think>" not in form.split("<think>")[-1]
    body = THINK.sub("", form).replace("</think>", "")
    body = LABEL.sub("", body)
    return body, MARKED.sub("", body), opened


def no_answer(bare: str) -> bool:
    """Nothing visible, only marks, a label, or a stand-in."""
    inner = bare.strip("".join(set(OPEN + CLOSE)) + "-/").lower()
    return not any(c.isalnum() for c in inner) or inner in STAND_INS


_PAIRED = re.compile(f"[{re.escape(OPEN + CLOSE)}]")
_HAN, _KANA, _OTHER = re.compile("[㐀-鿿]"), re.compile("[぀-ヿ]"), re.compile(r"[가-힣]|[A-Za-zÀ-ɏЀ-ӿͰ-Ͽ]{5}")


def unclosed(body: str) -> bool:
    """An opening bracket or quote without its closing one."""
    depth = [0] * len(OPEN)
    for c in _PAIRED.findall(body):
        if (i := OPEN.find(c)) >= 0:
            depth[i] += 1
        elif depth[i := CLOSE.find(c)]:
            depth[i] -= 1
    return any(depth)


def chinese(body: str) -> bool:
    """Whether the text is Chinese: ideographs outweigh words of other scripts, and there is little kana."""
    han, kana, other = (len(p.findall(body)) for p in (_HAN, _KANA, _OTHER))
    return not (kana >= 3 and kana >= 0.15 * (han + kana)) and han >= 1.5 * other


def _numbers(form: str) -> str:
    return re.sub(r"\d[\d,.]*", "0", form)


def _longer(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The hash of an ending with one character more behind it: two odd multipliers and a shift that brings high bits down."""
    with np.errstate(over="ignore"):
        h = (h + c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def _bits(only: np.ndarray) -> np.ndarray:
    """Which low bits occur among the hashes: most lookups end here."""
    out = np.zeros(1 << 22, bool)
    out[only.view(np.uint64) & np.uint64(len(out) - 1)] = True
    return out


def _counted(texts: list[str], is_gold: list[bool], only: np.ndarray | None, bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, occurrences, occurrences at the end of a sentence) of each ending of up to DEPTH characters; only places before a further character, or the end of a gold text."""
    found: list[np.ndarray] = []
    finals: list[np.ndarray] = []
    joined = "\x00".join(texts) + "\x00"
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(chars == 0)
    start = np.concatenate([[0], ends[:-1] + 1])
    row = np.repeat(np.arange(len(texts)), ends - start + 1)[: len(chars)]
    place = np.arange(len(chars)) - start[row]
    mark = np.isin(chars, [ord(c) for c in FINAL + ";"])
    gold = np.array(is_gold, bool)
    usable = (chars != 0) | gold[row]  # position p stands for the ending before p
    final = mark | (chars == 0)
    stop = (chars == ord(".")) & np.concatenate([chars[1:] == 0, [True]])
    final |= stop
    if only is not None and bits is None:
        bits = _bits(only)
    wide = chars.astype(np.uint64)
    h = np.zeros(len(chars) + 1, np.uint64)
    for k in range(1, DEPTH + 1):
        h = _longer(h[: len(chars) - k + 1], wide[k - 1 :])  # by start, one character more each time
        at = np.arange(k, len(chars))
        hk = h[at - k].view(np.int64) ^ np.int64(k)
        ok = usable[at] & (place[at] >= k)
        if only is not None:
            ok &= bits[hk.view(np.uint64) & np.uint64(len(bits) - 1)]
        hk, at = hk[ok], at[ok]
        if only is not None:
            i = np.minimum(np.searchsorted(only, hk), max(len(only) - 1, 0))
            hit = only[i] == hk if len(only) else np.zeros(len(hk), bool)
            hk, at = hk[hit], at[hit]
        found.append(hk)
        finals.append(final[at])
    at = np.flatnonzero(usable & (place >= 1))
    found.append(np.zeros(len(at), np.int64))  # the empty ending: key 0
    finals.append(final[at])
    keys, inv = np.unique(np.concatenate(found), return_inverse=True)
    f = np.concatenate(finals)
    return keys, np.bincount(inv, minlength=len(keys)), np.bincount(inv, weights=f, minlength=len(keys)).astype(np.int64)


def ending_hashes(bares: list[str]) -> list[np.ndarray]:
    """For every text the hashes of its last 1, 2, ... DEPTH characters, numbers as one character; all texts at once."""
    tails = [_numbers(t)[-DEPTH:] for t in bares]
    size = np.fromiter((len(t) for t in tails), np.int64, len(tails))
    table = np.zeros((len(tails), DEPTH), np.uint64)  # right-aligned
    table[np.arange(DEPTH) >= DEPTH - size[:, None]] = np.frombuffer("".join(tails).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(tails), DEPTH), np.int64)
    for k in range(1, DEPTH + 1):
        h = np.zeros(len(tails), np.uint64)
        for j in range(DEPTH - k, DEPTH):
            h = _longer(h, table[:, j])
        out[:, k - 1] = h.view(np.int64) ^ np.int64(k)
    return [out[i, :n] for i, n in enumerate(size.tolist())]


#: Columns that ``answer_columns`` gives.
ANSWER = "chars int, bytes int, body string, bare string, form string, endings array<bigint>, sign int"


def answer_columns(raw: list[str | None], forms: list[str]) -> list[pa.Array]:
    """chars, bytes (of the raw text), body, bare, form, endings, sign of a batch of texts and their forms. sign: 1 surely cut, -1 nothing to judge, 0 else.

    Surely cut: an open reasoning block, an unclosed bracket or quote, a broken character (U+FFFD), or a hanging comma, colon or bracket at the
    end. Nothing to judge: null or empty answers, and answers in another language that are not surely cut.
    """
    rows = []
    for r, form in zip(raw, forms, strict=True):
        body, bare, opened = parts(r, form)
        if opened:
            sign = 1
        elif no_answer(bare):
            sign = -1
        elif "�" in form[-3:] or unclosed(body) or body[-1] in HANGING:
            sign = 1
        else:
            sign = 0 if chinese(body) else -1
        rows.append((len(r or ""), len((r or "").rstrip("�").encode("utf-8", "surrogatepass")), body, bare, form, sign))
    cols = list(zip(*rows, strict=True)) or [()] * 6
    types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]
    out = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
    return [*out[:5], pa.array(ending_hashes(list(cols[3])), pa.list_(pa.int64())), out[5]]


def answers(df: DataFrame, text: str, keep: list) -> DataFrame:
    """keep and the columns ANSWER of every row's text."""
    src = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = widen(src, ANSWER, ("__text",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(b.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *answer_columns(raw, canon_texts(raw))], names=schema.names)

    return src.mapInArrow(run, schema)


def ending_counts(texts: DataFrame, endings: DataFrame) -> DataFrame:
    """(ending, n, final) over ``texts`` (form, gold), for the hashes in ``endings`` (ending); the key 0 is the empty ending."""
    wanted = materialize(endings.distinct(), "wanted")
    only = None
    if wanted.count() <= MAX_SENT_ENDINGS:
        only = np.sort(wanted.toArrow()["ending"].to_numpy().copy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bits(only) if only is not None else None
        for b in batches:
            forms = [_numbers(x) for x in b.column(0).to_pylist()]
            if forms:
                k, n, f = _counted(forms, b.column(1).to_pylist(), only, bits)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64)), pa.array(f)], names=["ending", "n", "final"])

    counts = texts.select("form", "gold").mapInArrow(run, "ending bigint, n bigint, final bigint").groupBy("ending").agg(F.sum("n").alias("n"), F.sum("final").alias("final"))
    return counts if only is not None else counts.join(wanted.union(wanted.sparkSession.createDataFrame([(0,)], "ending bigint")), "ending", "left_semi")


def fit_censored(values: np.ndarray, counts: np.ndarray, limit: float) -> tuple[float, float]:
    """Maximum-likelihood mean and deviation of log lengths where values >= limit are only known to reach it (Newton steps by EM)."""
    x = np.log(np.maximum(values, 1))
    cut = math.log(max(limit, 1))
    seen = values < limit
    n, m = counts[seen].sum(), counts[~seen].sum()
    if n < 2:
        return float(x.mean()), 1.0
    mu, sd = float(np.average(x[seen], weights=counts[seen])), float(max(np.sqrt(np.cov(x[seen], fweights=counts[seen])), 1e-3)) if n > 1 else 1.0
    norm = NormalDist()
    for _ in range(200):
        z = (cut - mu) / sd
        tail = max(1 - norm.cdf(z), 1e-12)
        lam = norm.pdf(z) / tail
        e1 = mu + sd * lam  # moments of a value beyond the limit
        e2 = sd * sd * (1 + z * lam - lam * lam)
        new = (float((x[seen] * counts[seen]).sum()) + m * e1) / (n + m)
        var = (float((counts[seen] * (x[seen] - new) ** 2).sum()) + m * (e2 + (e1 - new) ** 2)) / (n + m)
        done = abs(new - mu) < 1e-7
        mu, sd = new, max(math.sqrt(var), 1e-3)
        if done:
            break
    return mu, sd


def censoring(hist: list[tuple[str, str, int, int]], least: int = 5, ratio: float = 5.0) -> list[tuple[str, str, int, float, int]]:
    """(source, unit, limit, posterior, values) from length histograms (source, unit, length, count).

    Candidate limits are lengths with at least ``least`` values and ``ratio`` times the mean count of the 20 lengths around. For each,
    the length distribution is fitted with that limit as censoring point; the posterior that a value of this length was cut there is
    one minus the expected count of values that end there of themselves over the count seen.
    """
    out = []
    for key in sorted({(s, u) for s, u, _, _ in hist}):
        rows = sorted((n, c) for s, u, n, c in hist if (s, u) == key and n > 0)
        values, counts = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        total = np.concatenate([[0], np.cumsum(counts)])
        around_all = (total[np.searchsorted(values, values + 10, "right")] - total[np.searchsorted(values, values - 10)] - counts) / 20
        spikes = np.flatnonzero((counts >= least) & (counts >= ratio * np.maximum(around_all, 0.2)))
        for v, c, around in zip(values[spikes], counts[spikes], around_all[spikes], strict=True):
            mu, sd = fit_censored(values, counts, v)
            near = max(around, counts.sum() * NormalDist(mu, sd).pdf(math.log(v)) / v)
            out.append((key[0], key[1], int(v), float(min(max(1 - near / c, 0.01), 0.99)), int(c)))
    return out


def limits(lengths: DataFrame) -> DataFrame:
    """(s, unit, len, p): detected field limits of ``lengths`` (s, unit, len), by ``censoring`` over exact length counts, one source and unit at a time.

    A task gets one row per different length of a source: n texts of c characters together have at most sqrt(2 c) different lengths.
    """

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        found = censoring([(key[0], key[1], int(n), int(c)) for n, c in zip(x["len"], x["n"], strict=True)])
        return pd.DataFrame([r[:4] for r in found], columns=["s", "unit", "len", "p"])

    hist = lengths.groupBy("s", "unit", "len").agg(F.count("*").alias("n"))
    return hist.groupBy("s", "unit").applyInPandas(run, "s string, unit string, len int, p double")


def final_chances(live: DataFrame, counts: DataFrame) -> DataFrame:
    """(source, key, rate, p_final) of ``live`` (source, key, endings): the share of sentence ends among all places, and behind the record's own endings.

    Each ending's estimate leans on that of the shorter one with WEIGHT. Up to MAX_SENT_ENDINGS counts are sent to the executors; more are joined.
    """
    base = counts.filter("ending = 0").select(F.col("n").alias("n0"), F.col("final").alias("f0"))
    if counts.count() > MAX_SENT_ENDINGS:
        step = lambda p, x: (x["final"] + WEIGHT * p) / (x["n"] + WEIGHT)
        ends = live.select("source", "key", F.posexplode("endings").alias("i", "ending"))
        per = ends.join(counts, "ending", "left").groupBy("source", "key").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("final", F.lit(0)).alias("final")))).alias("c"))  # at most DEPTH a record
        per = per.crossJoin(F.broadcast(base)).withColumn("rate", (F.col("f0") + 0.5) / (F.col("n0") + 1))  # base: one row
        return per.withColumn("p_final", F.aggregate("c", F.col("rate"), step)).select("source", "key", "rate", "p_final")
    sent = counts.orderBy("ending").toArrow()
    keys, n, final = (sent[c].to_numpy().copy() for c in ("ending", "n", "final"))
    zero = np.searchsorted(keys, 0)
    rate = float((final[zero] + 0.5) / (n[zero] + 1)) if zero < len(keys) and keys[zero] == 0 else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            i = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            hit = keys[i] == flat
            seen, ended = np.where(hit, n[i], 0), np.where(hit, final[i], 0)
            first = np.cumsum(size) - size
            p = np.full(len(size), rate)
            for k in range(DEPTH):
                rows = np.flatnonzero(size > k)
                at = first[rows] + k
                p[rows] = (ended[at] + WEIGHT * p[rows]) / (seen[at] + WEIGHT)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(size), rate)), pa.array(p)], names=["source", "key", "rate", "p_final"])

    return live.select("source", "key", "endings").filter("size(endings) > 0").mapInArrow(run, "source string, key string, rate double, p_final double")


def cut_scores(df: DataFrame, source: str, key: str, text: str, gold: str | None = None, share: float = 0.05, marked: float = 0.02) -> DataFrame:
    """(source, key, cut, p_cut, p_limit, p_final, chars) for each record once: ``answer_scores`` of the records' answers.

    Null keys are left out; a null source is kept; an empty table gives no rows.
    """
    cols = [F.col(source).cast("string").alias("source"), F.col(key).cast("string").alias("key")]
    a = materialize(answers(df.filter(F.col(key).isNotNull()).dropDuplicates([source, key]), text, cols), "answers")
    texts = None
    if gold:
        golden = df.select(F.col(gold).cast("string").alias("g")).filter("g is not null").distinct()
        texts = answers(golden, "g", []).filter("bare != ''").select(F.col("bare").alias("form"))
    return answer_scores(a, texts, share, marked)


def answer_scores(a: DataFrame, gold: DataFrame | None = None, share: float = 0.05, marked: float = 0.02) -> DataFrame:
    """(source, key, cut, p_cut, p_limit, p_final, chars) of ``a`` (source, key and the columns ANSWER, stored); gold: (form) of complete texts.

    p_limit: the censoring posterior at the value's own length in characters or bytes, at least ``share``. p_final: the estimated chance that a sentence ends
    after the value's last characters, from the continuations of these characters in all texts (longer endings lean on shorter
    ones). Both are joined by Bayes' rule; ``marked`` is the likelihood ratio of a final mark. Answers that are surely cut (``answer_columns``) are cut
    whatever their posterior.
    """
    texts = a.select("form", F.lit(False).alias("gold"))
    if gold is not None:
        texts = texts.union(gold.select("form", F.lit(True)))
    live = a.filter("sign = 0")
    counts = materialize(ending_counts(texts, live.select(F.explode("endings").alias("ending"))), "endings")
    per = final_chances(live, counts)
    unit = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("len")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("len"))))
    lens = a.select("source", "key", F.coalesce("source", F.lit("")).alias("s"), unit.alias("u")).select("source", "key", "s", "u.unit", "u.len")
    at = lens.join(limits(lens), ["s", "unit", "len"]).groupBy("source", "key").agg(F.max("p").alias("p_limit"))
    safe = lambda x, y, on: x.join(y.withColumnRenamed("source", "s_").withColumnRenamed("key", "k_"), F.col("source").eqNullSafe(F.col("s_")) & (F.col("key") == F.col("k_")), on).drop("s_", "k_")
    ended = F.col("body").rlike("[。?!.][\"”’)*`]*$") & ~F.col("body").rlike("\\.\\.+$")
    short = a.select("source", "key", "sign", "chars", ended.alias("ended"))
    all_ = safe(safe(short, per.select("source", "key", "rate", "p_final"), "left"), at, "left").withColumn("p_limit", F.greatest(F.coalesce("p_limit", F.lit(0.0)), F.lit(share)))
    odds = F.col("p_limit") / (1 - F.col("p_limit")) * ((1 - F.col("p_final")) / (1 - F.col("rate"))) / (F.col("p_final") / F.col("rate"))
    odds = odds * F.when(F.col("ended"), marked).otherwise(1.0)
    p = F.when(F.col("sign") == 1, 1.0).when(F.col("sign") == -1, 0.0).otherwise(odds / (1 + odds))
    return all_.withColumn("p_cut", p).select("source", "key", (F.col("p_cut") >= 0.5).alias("cut"), "p_cut", "p_limit", "p_final", "chars")
