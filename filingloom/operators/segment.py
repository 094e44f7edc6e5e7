"""Segmentation of question documents: blocks, sub-questions, professional requests. Offsets need match positions, so rows run through Arrow."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..functions import rules as R

_SPACE = re.compile(f"{R.WS}*\n{R.WS}*")
_HAN_GAP = re.compile(f"(?<={R.HAN}){R.WS}+(?={R.HAN})")
_DROPS = [re.compile(R.BOARD_NOTE), re.compile(R.PAGE_MARK), *(re.compile("(?m)" + x) for x in R.DROPPED_LINES)]


def compact(t: str) -> str:
    """As ``functions.text.compact``, for one string."""
    for drop in _DROPS:
        t = drop.sub("", t)
    return _HAN_GAP.sub("", _SPACE.sub("", re.sub("[ \t\r\f\v]+", " ", t))).strip(" \n\t；;")


def merge_spans(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Overlapping spans as one, their values joined in order of start and end."""
    out: list[list] = []
    for a, b, v in sorted(spans, key=lambda s: s[:2]):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
            out[-1][2] += "；" + v
        else:
            out.append([a, b, v])
    return [tuple(x) for x in out]


def professional_spans(t: str, patterns: tuple[str, ...] = R.PROFESSIONAL) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), compact(m[0]).strip("。；; ")) for p in patterns for m in re.finditer(p, t)]
    return merge_spans([s for s in found if s[2]])


def without_professional(t: str) -> tuple[str, str]:
    """(text without requests to professionals, these requests once each, in order)."""
    spans = professional_spans(t)
    if not spans:
        return compact(t), ""
    edges = [0, *[e for a, b, _ in spans for e in (a, b)], len(t)]
    rest = "".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    rest = re.sub(r"[。；;]{2,}", "。", compact(rest)).strip(" ，,。；;")
    return rest, "；".join(dict.fromkeys(v for _, _, v in spans))


def strip_requester(t: str) -> str:
    """As ``functions.text.strip_requester``, for one string."""
    t = re.sub("^" + R.REQUESTER, "", t).strip()
    return re.sub(f"^请(?={R.one_of(R.LEADING_VERBS)})", "", t).strip().strip(" ，,。；;")


def is_request(t: str, least: int = 8) -> bool:
    own = strip_requester(without_professional(t)[0])
    return len(own) >= least and bool(re.search(R.REQUEST_VERB, own))


def _markers(t: str, trigger: str, skip: list[tuple[int, int, str]]) -> list[re.Match]:
    first = re.search(trigger, t)
    spans = skip + [(m.start(), m.end(), "") for m in re.finditer(R.REFERENCE_MARKER, t)]
    return [m for m in re.compile(R.CHILD_MARKER).finditer(t, first.start() if first else 0) if not any(a <= m.start() < b for a, b, _ in spans)]


def child_marks(t: str) -> list[re.Match]:
    """Marks of sub-questions of a cleaned parent: behind its first request, outside of references and requests to advisers."""
    return _markers(t, R.REQUEST_TRIGGER, professional_spans(t))


def children(t: str) -> list[tuple[str, str, str]]:
    """(label, text, method) of the numbered sub-questions of a parent, else of its requests split at semicolons."""
    t = compact(t)
    marks = child_marks(t)
    if marks:
        ends = [m.start() for m in marks[1:]] + [len(t)]
        texts = [(m[1], compact(t[m.end() : e])) for m, e in zip(marks, ends, strict=True)]
        return [(label, x, "numbered") for label, x in texts if x]
    first = re.search(R.REQUEST_TRIGGER, t)
    whole = compact(t[first.start() :]) if first else ""
    if not whole or not is_request(whole):
        return []
    parts = [p for p in (compact(x) for x in re.split("[；;]", whole)) if p]
    if len(parts) > 1 and all(map(is_request, parts)):
        return [(str(i), p, "semicolon") for i, p in enumerate(parts, 1)]
    return [("1", whole, "whole")]


def strict_children(block: str, least: int = 8) -> list[tuple[int, int, str]]:
    """(start, end, text) of numbered sub-questions of ``least`` characters or more with a request verb; starts stand at the marker."""
    marks = _markers(block, R.STAGE_ONE_TRIGGER, [])
    ends = [m.start() for m in marks[1:]] + [len(block)]
    found = [(m.start(), e, compact(block[m.end() : e])) for m, e in zip(marks, ends, strict=True)]
    return [x for x in found if len(x[2]) >= least and re.search(R.CHILD_VERB, x[2])]


def before_answer(block: str) -> str:
    """The block up to the first answer: an answer line, an inline answer mark, or a numbered section after a request to professionals."""
    cuts = [len(block)]
    for m in (re.search("(?m)" + R.ANSWER_LINE, block), re.search(R.ANSWER_INLINE, block)):
        if m:
            cuts.append(m.start())
    section = re.search("(?m)" + R.ANSWER_SECTION, block)
    if section and re.search(R.ANSWER_SECTION_AFTER, block[: section.start()]):
        cuts.append(section.start())
    return block[: min(cuts)].strip()


def topic_of(*sources: str) -> str:
    for s in sources:
        if m := re.search(R.TOPIC, s):
            return m[0].rstrip("。；：: ")
    return sources[-1].rstrip("。；：: ")


def parent_blocks(t: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, label, topic, block) of the question blocks of a document: from one label to the next, cut at the answer, with a request."""
    starts = list(re.finditer("(?m)" + R.PARENT_START, t))
    sections = [(m.start(), compact(m[1])) for m in re.finditer("(?m)" + R.SECTION_HEADING, t)]
    out, section = [], ""
    for m, end in zip(starts, [*(x.start() for x in starts[1:]), len(t)], strict=False):
        block = before_answer(t[m.start() : end])
        if re.search(R.STAGE_ONE_TRIGGER, block):
            section = next((s for at, s in reversed(sections) if at <= m.start()), section)
            out.append((m.start(), m.start() + len(block), m[1], topic_of(m[1], block[:120], section), block))
    return out


def numbered_blocks(t: str, numbers: str = "[1-7]") -> list[tuple[int, int, int, str, str]]:
    """(number, start, stop, topic, block) of the numbered questions of a letter: from a numbered line to the next, to a section title or to the footer."""
    starts = list(re.finditer(rf"(?m)^\s*({numbers})\.", t))
    sections, footer = re.compile(R.SECTION_TITLE), re.compile(R.FOOTER)
    titles = [(m.start(), m[1]) for m in sections.finditer(t)]
    out = []
    for m, end in zip(starts, [*(x.start() for x in starts[1:]), len(t)], strict=False):
        for stop in (sections, footer):
            if cut := stop.search(t, m.end(), end):
                end = cut.start()
        block = footer.split(compact(t[m.start() : end]))[0].strip(" ，,。；;")
        own = re.search(R.OWN_TOPIC, block)
        earlier = [s for at, s in titles if at < m.start()]
        topic = own[1].strip() if own else compact(earlier[-1]).split("、", 1)[-1] if earlier else ""
        out.append((int(m[1]), m.start(), end, topic, block))
    return out


def source_texts(pages: DataFrame, keys: list[str], page: str = "page_number", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((keys, text), (keys, page, from_, to_)): the pages of each key in order under page marks, and where each page's own text stands in it.

    Null texts are empty. One text per key is gathered: a letter, not a corpus.
    """
    p = pages.select(*keys, F.col(page).alias("page"), F.coalesce(text, F.lit("")).alias("t"), "document_id")
    mark = F.concat(F.lit("\n[[PAGE:"), F.col("page").cast("string"), F.lit("]]\n"))
    whole = p.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "document_id", F.concat(mark, "t", F.lit("\n")).alias("c")))), lambda s: s["c"]), "").alias("text"))
    n = p.select(*keys, "page", "document_id", F.length(mark).alias("m"), F.length("t").alias("n"))
    order = W.partitionBy(*keys).orderBy("page", "document_id").rowsBetween(W.unboundedPreceding, -1)
    spans = n.withColumn("from_", F.coalesce(F.sum(F.col("m") + F.col("n") + 1).over(order), F.lit(0)) + F.col("m"))
    return whole, spans.select(*keys, "page", "from_", (F.col("from_") + F.col("n")).alias("to_"))


def explode_rows(df: DataFrame, text: str, keep: list[str], fields: str, f: Callable[[str], list[tuple]]) -> DataFrame:
    """keep, ord (from 1) and ``fields`` for every tuple that ``f`` gives for the text, over Arrow batches. A null text gives no rows."""
    kind = TY.ArrayType(TY.StructType.fromDDL(fields))

    def run(s: pd.Series) -> pd.Series:
        names = kind.elementType.fieldNames()
        return pd.Series([[dict(zip(names, x, strict=True)) for x in f(t)] if isinstance(t, str) else [] for t in s], dtype=object)

    return df.select(*keep, F.posexplode(F.pandas_udf(run, kind)(F.col(text))).alias("ord", "x")).select(*keep, (F.col("ord") + 1).alias("ord"), "x.*")


def derived_children(questions: DataFrame, keep: list[str], text: str = "parent_question_text") -> DataFrame:
    return explode_rows(questions, text, keep, "label string, child string, method string", children)


def question_blocks(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    return explode_rows(documents, text, keep, "start int, stop int, label string, topic string, block string", parent_blocks)


def professional_requests(questions: DataFrame, keep: list[str], text: str) -> DataFrame:
    return explode_rows(questions, text, keep, "cleaned string, request string", lambda t: [without_professional(t)])


def merged_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping half-open intervals of each key as one: keys, start, end, parts."""
    order = W.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(before.isNull() | (F.col(start) >= before), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("__island", island).groupBy(*keys, "__island").agg(F.min(start).alias("start"), F.max(end).alias("stop"), F.count("*").alias("parts")).drop("__island")


def heading_as_of(lines: DataFrame, keys: list[str], order: list[str], heading: str, name: str = "section") -> DataFrame:
    """Every row with the last non-null ``heading`` at or before it."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(heading, ignorenulls=True).over(w))
