"""Problem 3: one form for texts that look the same.

``one_form`` runs DuckDB inside Arrow partitions. The embedded SQL maps compatibility forms and look-alike letters with
``translate``, composes accents with ``nfc_normalize`` and removes invisible characters and spaces with a regular expression.
``look`` is the same rule for one Python string; ``fold_table`` the same character map for arrays of code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import widen

# Letters of other scripts that look like Latin ones (after the Unicode confusables data, upright fonts).
CYRILLIC = "АВЕЅІЈКМНОРСТХҮԌԚԜаеѕіјорсхуһԁԛԝӏ"
CYRILLIC_LATIN = "ABESIJKMHOPCTXYGQWaesijopcxyhdqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοϲ"
GREEK_LATIN = "ABEZHIKMNOPTYXCjoc"
ARMENIAN, ARMENIAN_LATIN = "ՍՕօսհոցզ", "UOouhngq"
CHEROKEE, CHEROKEE_LATIN = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᏔᏃ", "ABCDEGHJKLMPSTVWZ"
# Dashes and dots of one look.
DASHES, DOTS = "‐‑‒–−﹣", "・•∙⋅･"
# CJK radicals that have no compatibility mapping, and the ideographs they stand for.
RADICALS = "⺟⻁⻄⻅⻆⻉⻋⻑⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻧⻨⻩⻪⻬⻮⻰⻳"
RADICAL_IDEOGRAPHS = "母虎西见角贝车長长门青韦页风飞食马骨鬼鱼鸟卤麦黄黾齐齿龙龟"

#: Characters without a look of their own, in the syntax of both regular-expression engines used here.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u2800\u3164\uffa0\ufe00-\ufe0f"
SEPARATOR = "\x1e"


@lru_cache(maxsize=1)
def fold_pairs() -> tuple[str, str]:
    """Two strings of equal length: characters, and the one character each is mapped to.

    Compatibility forms come from a rule (every character whose NFKC form is one other character); look-alikes from the lists above.
    """
    pairs: dict[str, str] = {}
    for code in [*range(0xA0, 0xAC00), *range(0xF900, 0xFFF0), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200), *range(0x2F800, 0x2FA20)]:
        c = chr(code)
        n = unicodedata.normalize("NFKC", c)
        if n != c and len(n) == 1:
            pairs[c] = n
    for a, b in ((CYRILLIC, CYRILLIC_LATIN), (GREEK, GREEK_LATIN), (ARMENIAN, ARMENIAN_LATIN), (CHEROKEE, CHEROKEE_LATIN), (RADICALS, RADICAL_IDEOGRAPHS), (DASHES, "-" * len(DASHES)), (DOTS, "·" * len(DOTS))):
        pairs.update(zip(a, b, strict=True))
    pairs = {a: pairs.get(b, b) for a, b in pairs.items()}
    return "".join(pairs), "".join(pairs.values())


@lru_cache(maxsize=1)
def wide_forms() -> dict[str, str]:
    """Characters that look like several (ligatures, units, words in one square), and these, in their one form.

    By a rule: BMP characters whose NFKC form has two or more characters, none of them a blank or a mark. The ellipsis is no case: it looks unlike three points.
    """
    a, b = fold_pairs()
    one = str.maketrans(a, b)
    out = {}
    for code in [*range(0xA0, 0xAC00), *range(0xFB00, 0xFFF0)]:
        n = unicodedata.normalize("NFKC", chr(code))
        if len(n) > 1 and not set(n) & set(". ") and not any(unicodedata.category(x)[0] in "MZC" for x in n) and unicodedata.normalize("NFC", n) == n:
            out[chr(code)] = n.translate(one)
    return out


@lru_cache(maxsize=1)
def _translation() -> dict[int, str]:
    a, b = fold_pairs()
    return str.maketrans(a, b) | {ord(k): v for k, v in wide_forms().items()}


@lru_cache(maxsize=1)
def wide_pattern() -> re.Pattern:
    return re.compile("[" + "".join(wide_forms()) + "]")


def is_blank(c: str) -> bool:
    """A space or an invisible character."""
    return unicodedata.category(c) in ("Cf", "Cc", "Zs", "Zl", "Zp") or bool(re.match(f"[{INVISIBLE}]", c))


def look(text: str | None) -> str:
    """The one form of a text: look-alikes mapped, accents composed, invisible characters and spaces dropped. None gives ""."""
    if not text:
        return ""
    out = text.translate(_translation())
    return unicodedata.normalize("NFC", "".join(c for c in out if not is_blank(c)))


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point -> code point of its one form; 0 for characters that are dropped, but 10 for the line feed."""
    table = np.arange(0x110000, dtype=np.uint32)
    for a, b in zip(*fold_pairs(), strict=True):
        table[ord(a)] = ord(b)
    for code in [*range(0x3100), *range(0xFE00, 0x10000), *range(0xE0000, 0xE0200), *range(0x3164, 0x3165), *range(0x1D173, 0x1D17B)]:
        if is_blank(chr(code)):
            table[code] = 0
    table[10] = 10
    return table


def _sql() -> str:
    """Runs over the relation b(i, t): row number and text without the separator."""
    drop = rf"[\p{{Cf}}\p{{Cc}}\p{{Z}}{INVISIBLE}]+"
    return rf"""
      WITH whole AS (SELECT translate(string_agg(coalesce(t, ''), '{SEPARATOR}' ORDER BY i), $a, $b) s FROM b),
           rows AS (SELECT unnest(string_split(s, '{SEPARATOR}')) t FROM whole),
           narrow AS (SELECT CASE WHEN regexp_matches(t, $any) THEN array_to_string(list_transform(string_split(t, ''), lambda c: coalesce($many[list_position($wide, c)], c)), '') ELSE t END t FROM rows),
           bare AS (SELECT regexp_replace(t, '{drop}', '', 'g') t FROM narrow)
      SELECT CASE WHEN regexp_matches(t, '\p{{M}}') THEN nfc_normalize(t) ELSE t END form FROM bare
    """


#: Characters of one DuckDB call; a call holds all texts of its part as one string, so that the map is built once for many rows.
PART_CHARS = 4_000_000


def canon_texts(texts: list[str | None]) -> list[str]:
    """The one form of every text, by one embedded DuckDB per call, in parts of bounded size. None gives ""."""
    import duckdb

    a, b = fold_pairs()
    out: list[str] = []
    with duckdb.connect(config={"threads": 1}) as con:
        part: list[str] = []
        held = 0

        def flush() -> None:
            nonlocal part, held
            if part:
                con.register("b", pa.table({"i": pa.array(range(len(part)), pa.int64()), "t": pa.array(part, pa.string())}))
                out.extend(x[0] for x in con.execute(_sql(), {"a": a, "b": b, "any": wide_pattern().pattern, "wide": list(wide_forms()), "many": list(wide_forms().values())}).fetchall())
                con.unregister("b")
            part, held = [], 0

        for t in texts:
            t = (t or "").replace(SEPARATOR, "").replace("\x00", "")
            if held and held + len(t) > PART_CHARS:
                flush()
            part.append(t)
            held += len(t)
        flush()
    return out


def one_form(df: DataFrame, text: str, keep: list[Column], form: str = "form") -> DataFrame:
    """``keep`` and the one form of column ``text``.

    Null and blank texts give "". Row order within a partition is kept; texts of any length are processed whole. Columns of the
    input that are not named in ``keep`` are not read, so clashing names do no harm.
    """
    src = df.select(*keep, F.col(text).cast("string").alias("__text"))
    kept = [f for f in src.schema.fields if f.name != "__text"]
    schema = widen(src, f"`{form}` string", ("__text",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = canon_texts(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(forms, pa.string())], names=[*(f.name for f in kept), form])

    return src.mapInArrow(run, schema)


def form_keys(df: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """``keep`` with form_md5, raw_md5 and visible (characters of the form): what comparisons need, without the texts."""
    import hashlib

    src = df.select(*keep, F.col(text).cast("string").alias("__text"))
    kept = [f for f in src.schema.fields if f.name != "__text"]
    schema = widen(src, "form_md5 binary, raw_md5 binary, visible int", ("__text",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5 = lambda s: hashlib.md5(s.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
        for b in batches:
            raw = b.column(b.num_columns - 1).to_pylist()
            forms = canon_texts(raw)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([md5(f) for f in forms], pa.binary()), pa.array([md5(r or "") for r in raw], pa.binary()), pa.array([len(f) for f in forms], pa.int32())],
                names=[*(f.name for f in kept), "form_md5", "raw_md5", "visible"],
            )

    return src.mapInArrow(run, schema)


def same_look_pairs(keys: DataFrame, kind: str = "record_kind", key: str = "key") -> DataFrame:
    """Pairs (kind, key_a, key_b) of records of one kind whose forms agree and whose strings differ; the smaller key first.

    ``keys`` has kind, key, form_md5, raw_md5. Re-delivered rows count once. A form with one spelling gives nothing, however many
    records share it: spellings are counted first, with map-side combination, and only forms of two or more spellings are joined.
    The join runs from spelling to spelling and then to their members, so its rows are those of the result.
    """
    rows = keys.select(F.col(kind).alias("record_kind"), F.col(key).alias("key"), "form_md5", "raw_md5").distinct()
    spelled = rows.groupBy("record_kind", "form_md5").agg(F.min("raw_md5").alias("lo"), F.max("raw_md5").alias("hi")).filter("lo != hi").select("record_kind", "form_md5")
    many = rows.join(spelled, ["record_kind", "form_md5"], "left_semi")
    a = many.select("record_kind", "form_md5", F.col("raw_md5").alias("raw_a"), F.col("key").alias("key_a"))
    b = many.select("record_kind", "form_md5", F.col("raw_md5").alias("raw_b"), F.col("key").alias("key_b"))
    return a.join(b, ["record_kind", "form_md5"]).filter("raw_a != raw_b and key_a < key_b").select("record_kind", "key_a", "key_b").distinct()


def look_classes(keys: DataFrame, kind: str = "record_kind", key: str = "key") -> DataFrame:
    """(kind, key, class_id, records, spellings) of the records whose form has more than one spelling: one row per record, whatever its class holds."""
    rows = keys.select(F.col(kind).alias("record_kind"), F.col(key).alias("key"), "form_md5", "raw_md5").distinct()
    spelled = rows.groupBy("record_kind", "form_md5", "raw_md5").agg(F.count("*").alias("n"))
    size = spelled.groupBy("record_kind", "form_md5").agg(F.sum("n").alias("records"), F.count("*").alias("spellings")).filter("spellings > 1")
    return rows.join(size, ["record_kind", "form_md5"]).select("record_kind", "key", F.hex("form_md5").alias("class_id"), "records", "spellings")
