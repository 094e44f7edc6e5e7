"""Text scalars as Column expressions. A null text gives null unless stated; nothing here runs Python per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

Col = Column | str
_c = lambda x: F.col(x) if isinstance(x, str) else x


def strip(x: Col, more: str = "") -> Column:
    """White space (and the characters ``more``) removed at both ends."""
    cls = R.WS[:-1] + more + "]"
    return F.regexp_replace(_c(x), f"(?!{R.HAN})(?:^{cls}+|{cls}+$)", "")


def _blanks(x: Column) -> Column:
    return F.regexp_replace(x, "[ \t\r\f\u000b]+", " ")


def _between_han(x: Column) -> Column:
    """No space between ideographs; the first test, of one range, ends the search at most places."""
    return F.regexp_replace(x, f"(?!{R.HAN})(?<={R.HAN}){R.WS}+(?={R.HAN})", "")


def _joined(x: Column) -> Column:
    """Line breaks vanish with the space around them; texts of one line aren't searched."""
    return F.when(x.contains("\n"), F.regexp_replace(x, f"(?!{R.HAN}){R.WS}*\n{R.WS}*", "")).otherwise(x)


def clean_page_text(x: Col) -> Column:
    """Wide spaces as spaces, invisible marks dropped, blanks collapsed; lines stripped, empty ones dropped, no space inside ideographs."""
    t = _blanks(F.translate(_c(x), "\u3000\u00a0\u200b\ufeff", "  "))
    lines = F.filter(F.transform(F.split(t, "[\n\u001c\u001d\u001e\u0085\u2028\u2029]"), lambda s: strip(s)), lambda s: s != "")
    tidy = lambda s: F.regexp_replace(F.regexp_replace(_between_han(s), f"(?<={R.HAN}){R.WS}+(?=[，。；：！？、）】])", ""), f"(?<=[（【]){R.WS}+(?={R.HAN})", "")
    return F.array_join(F.transform(lines, tidy), "\n")


def page_status(x: Col, least: int = 40) -> Column:
    """needs_ocr where fewer than ``least`` characters are left after stripping (also for null), else success."""
    return F.when(F.length(strip(F.coalesce(_c(x), F.lit("")))) < least, "needs_ocr").otherwise("success")


def report_text(x: Col) -> Column:
    """One line of report text: line breaks vanish with the space around them."""
    return strip(_between_han(_joined(_blanks(F.translate(_c(x), "\u3000", " ")))))


def compact(x: Col) -> Column:
    """Question text without board disclaimer, page marks, page numbers and code lines, on one line, stripped of space and semicolons."""
    t = F.regexp_replace(F.regexp_replace(_c(x), R.BOARD_NOTE, ""), R.PAGE_MARK, "")
    for line in R.DROPPED_LINES:
        t = F.regexp_replace(t, "(?md)" + line, "")
    t = _between_han(_joined(_blanks(t)))
    return F.regexp_replace(t, "^[ \n\t；;]+|[ \n\t；;]+$", "")


def without_space(x: Col) -> Column:
    return F.regexp_replace(_c(x), R.WS, "")


def answer_text(x: Col) -> Column:
    """An answer without reasoning, in half-width signs, without markup and space, without one leading label."""
    t = F.translate(F.regexp_replace(_c(x), "(?s)<think>.*?</think>", ""), R.FULL_WIDTH, R.HALF_WIDTH)
    return F.regexp_replace(without_space(F.regexp_replace(t, "[*#]", "")), R.ANSWER_LABEL, "")


def strip_requester(x: Col) -> Column:
    """A request without the words that name who is asked, and without marks at its ends."""
    t = strip(F.regexp_replace(_c(x), "^" + R.REQUESTER, ""))
    t = strip(F.regexp_replace(t, f"^请(?={R.one_of(R.LEADING_VERBS)})", ""))
    return F.regexp_replace(t, "^[ ，,。；;]+|[ ，,。；;]+$", "")


def is_complete(x: Col) -> Column:
    """Not empty and without a sign that something was left out; false for null."""
    return F.coalesce((_c(x) != "") & ~_c(x).rlike(R.OMISSION), F.lit(False))


def topic_query(topic: Col, keywords: Col) -> Column:
    """The query of a risk topic: its name and its words."""
    return F.concat_ws(" ", _c(topic), _c(keywords))


def fill(template: str, **values: Column) -> Column:
    """The template with every {name} replaced by its column; a null value is empty."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def background(x: Col) -> Column:
    """The text before the first request."""
    return F.split(_c(x), R.REQUEST_TRIGGER, 2).getItem(0)


def retrieval_query(topic: Col, parent: Col, question: Col) -> Column:
    """Topic, background of the parent and question joined by full stops; empty parts left out; never null."""
    parts = [F.nullif(F.coalesce(_c(x), F.lit("")), F.lit("")) for x in (topic, background(parent), question)]
    return report_text(F.concat_ws("。", *parts))


def report_year(x: Col) -> Column:
    """The first four digits as a number; 0 without, also for null."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(_c(x).cast("string"), F.lit("")), "\\d{4}", 0), F.lit("")).cast("int"), F.lit(0))


def numeral(x: Col) -> Column:
    """A number in digits or in Chinese numerals up to 99; null otherwise."""
    n = _c(x)
    one = lambda s: F.instr(F.lit("一二三四五六七八九十"), s)
    left, right = F.substring_index(n, "十", 1), F.substring_index(n, "十", -1)
    digit = lambda s, empty: F.when(s == "", empty).when((F.length(s) == 1) & (one(s) > 0), one(s)).otherwise(empty)
    return F.when(n.rlike("^\\d+$"), n.cast("int")).when((F.length(n) == 1) & (one(n) > 0), one(n)).when(n.contains("十"), digit(left, 1) * 10 + digit(right, 0)).cast("int")


def question_number(text: Col, key: Col, fallback: Col) -> Column:
    """The number that the text starts with, else that after _q in the key, else ``fallback``."""
    found = F.nullif(F.regexp_extract(compact(F.coalesce(_c(text), F.lit(""))), R.QUESTION_NUMBER, 1), F.lit(""))
    own = F.transform(F.array(found), numeral).getItem(0)  # the text is searched once, however often the number is looked at
    return F.coalesce(own, F.nullif(F.regexp_extract(F.coalesce(_c(key), F.lit("")), "_q(\\d+)", 1), F.lit("")).cast("int"), _c(fallback))


def page_range(start: Col, end: Col) -> Column:
    """p3 or p3-4; null without pages."""
    a, b = _c(start), _c(end)
    return F.when(a.isNull() & b.isNull(), None).when(a.eqNullSafe(b), F.concat(F.lit("p"), a)).otherwise(F.concat_ws("-", F.concat(F.lit("p"), a), b))


def topic_title(*sources: Col) -> Column:
    """The first heading phrase among the sources, without marks at its end."""
    found = [F.nullif(F.regexp_extract(F.coalesce(_c(s), F.lit("")), R.TOPIC, 0), F.lit("")) for s in sources]
    return F.regexp_replace(F.coalesce(*found), "[。；：: ]+$", "")


def token_text(x: Col) -> Column:
    """The normalised lower-case text that ``terms`` reads."""
    return F.lower(report_text(F.coalesce(_c(x), F.lit(""))))


def tokens(x: Col) -> Column:
    """``terms`` of a raw text."""
    return terms(token_text(x))


def terms(t: Col) -> Column:
    """Terms of a normalised text: overlapping ideograph pairs (one ideograph where it stands alone), then Latin and number terms.

    Commas inside numbers are dropped; a term with a per-cent sign comes with and without it. Duplicates are kept.
    """
    t = _c(t)
    pairs = F.regexp_extract_all(t, F.lit(f"(?=({R.HAN}{{2}}))"), F.lit(1))
    single = F.regexp_extract_all(t, F.lit(f"(?<!{R.HAN})({R.HAN})(?!{R.HAN})"), F.lit(1))
    latin = F.transform(F.regexp_extract_all(t, F.lit("[a-z0-9]+(?:[.,][a-z0-9]+)*%?"), F.lit(0)), lambda s: F.regexp_replace(s, ",", ""))
    bare = F.transform(F.filter(latin, lambda s: s.endswith("%")), lambda s: F.regexp_replace(s, "%$", ""))
    return F.concat(pairs, single, latin, bare)
