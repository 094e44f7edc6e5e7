"""Problem 4: noise in text from scanned pages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, widen
from .canon import fold_table, look
from .codes import encode_map

# Groups of ideographs that look alike, so that recognition may take any of a group for any other.
GLYPHS = (
    "可司句 亚业 方万 兀元无 己已巳 未末 碓确 颔额 耍要 埋理 吿告 台合 谁准淮 生牛午 人入八 面而 曰日目自白 木本 佘余 土士上 干千于 "
    "天夫大太犬 间问闻 侯候 拆折析 货贷 洒酒 幕募慕 帐账 王玉壬主 住往 汇江 微徽 戊成戍戌 申中甲由田 右石古 刀力 凡几 厂广 乌鸟 今令 "
    "免兔 竞竟 拔拨 辨辩辫 氏民 矢失 史吏 体休 冶治 泠冷 傅博 慨概 籍藉 崇祟 暑署 毫亳 晴睛情 杨扬 抢枪 裸棵 徙徒 剌刺 贝见 旦且 代伐 "
    "仑仓 末朱 来米 各名 后右 明朋 期斯 季李 束東 策荣 未禾 手毛 小少 又叉 及乃 外处 任仕 估佑 侍待 复夏 损捐 抵低 购构 债侦 租粗 "
    "账胀 现规 资贫 募暮 率卒 晋普 密蜜 端瑞 栽裁 拟似 形刑 列例 建健 技枝 支友 办为 比此 北比 化北 存在 有育 金全 会合 公分 国园 回固因困"
).split()
# Letters (and the bar) that recognition puts for digits, each with its digit.
LETTERS, DIGITS = "lI|OoSsBZz", "1110055822"

#: Links that are sent to the executors as one sorted array (16 bytes each); more are joined to the pages' sites by key.
MAX_SENT_LINKS = 1_000_000
#: Context buckets and dimensions of the skip-gram vectors; least cosine of a rare word and the frequent word that it is read as. A word of
#: few contexts has an uncertain vector: one seen in n contexts needs n / (n + DOUBT) of it.
CONTEXTS, DIMENSIONS, COSINE, DOUBT = 512, 32, 0.5, 16

_BROKEN = re.compile(r"([^\W\d_㐀-鿿])[^\S\n]*[-\u2010\u2011\u2012\u00ac\u00ad\uff0d][^\S\n]*\n[^\S\n]*(?=[^\W\d_㐀-鿿])")
_HEAD = 4
_AS_DIGITS = str.maketrans(LETTERS, DIGITS)


def glyph_pairs() -> list[tuple[int, int]]:
    """(c, meant): every two different characters of a group, either way."""
    return sorted({(ord(a), ord(b)) for g in GLYPHS for a in g for b in g if a != b})


class Pages:
    """A batch of page texts. ``ready``: composed texts; ``flat``: code points of all of them folded place by place, a line feed after each text,
    digits as they are, other blanks 32; ``offset``: where each text starts in it; ``c``, ``start``, ``place``: characters without blanks, each digit
    as 0, by text, and their places in ``flat``."""

    def __init__(self, texts: list[str | None]) -> None:
        codes, self.ready, place = encode_map(texts, widen=False)
        self.c = codes.chars.copy()
        self.c[(self.c >= 48) & (self.c < 58)] = 48
        self.start = codes.start
        size = np.fromiter((len(t) for t in self.ready), np.int64, len(self.ready))
        self.offset = np.concatenate([[0], np.cumsum(size + 1)])
        self.place = place + np.searchsorted(np.cumsum(size), place, "right")
        self.flat = fold_table()[np.frombuffer("".join(t + "\n" for t in self.ready).encode("utf-32-le", "surrogatepass"), np.uint32)]
        self.flat[self.flat == 0] = 32

    def text(self, i: int) -> str:
        """The folded text i, place by place."""
        return self.flat[self.offset[i] : self.offset[i + 1] - 1].tobytes().decode("utf-32-le", "surrogatepass")

    def glyphs(self) -> tuple[np.ndarray, np.ndarray]:
        """For each character of a glyph group: its index in ``c`` and its (left, self, right) packed into 63 bits; page borders are 0."""
        c, wanted = self.c, np.zeros(0x110000, bool)
        wanted[[ord(x) for g in GLYPHS for x in g]] = True
        at = np.flatnonzero(wanted[c])
        first, last = np.zeros(len(c) + 1, bool), np.zeros(len(c) + 1, bool)
        first[self.start[:-1]] = True
        last[self.start[1:]] = True  # the place after a page's end
        left = np.where(first[at], 0, c[at - 1])
        right = np.where(last[at + 1], 0, c[np.minimum(at + 1, max(len(c) - 1, 0))])
        return at, (left.astype(np.int64) << 42) | (c[at].astype(np.int64) << 21) | right.astype(np.int64)

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, letters, digits, points) of every run of Latin letters, digits and bars, with points and commas inside numbers: places in ``flat`` and how many it has."""
        f = self.flat
        digit = (f >= 48) & (f < 58)
        letter = ((f | 32) >= 97) & ((f | 32) < 123) & (f < 128) | (f == 124)
        core = digit | letter
        like = digit | np.isin(f, [ord(x) for x in LETTERS])
        inner = ((f == 46) | (f == 44)) & np.concatenate([[False], like[:-1]]) & np.concatenate([like[1:], [False]])
        run = np.concatenate([[False], core | inner, [False]])
        edge = np.flatnonzero(run[1:] != run[:-1])
        begin, end = edge[::2], edge[1::2]
        if not len(begin):
            return begin, end, begin, begin, begin
        count = lambda m: (total := np.concatenate([[0], np.cumsum(m)]))[end] - total[begin]
        return begin, end, count(letter), count(digit), count(f == 46)


def token_key(form: str) -> int:
    """A negative 64-bit key of a token's form; keys of glyphs are positive."""
    return (xxhash.xxh64_intdigest(form) >> 1) - (1 << 63)


def token_forms(token: str) -> list[str]:
    """What a token with letters may be a reading of: N: a number, each run of digits (and commas) as 0; W: a Latin word in lower case."""
    forms = []
    if any(x.isdigit() for x in token):
        if all(x in LETTERS or not x.isalpha() for x in token):
            forms.append("N:" + re.sub(r"\d+(?:,\d+)*", "0", token))
        if token.isalnum() and not token.isdigit():
            forms.append("W:" + token.lower())
    elif len(token) >= 3 and token.isalpha():
        forms.append("W:" + token.lower())
    return forms


def word_counts(pages: DataFrame, text: str = "text") -> DataFrame:
    """(key, form, n) over all pages: of every glyph with its neighbours (form is null), and of every form of a token; aggregated per batch, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = Pages(b.column(0).to_pylist())
            keys, n = np.unique(p.glyphs()[1], return_counts=True)
            begin, end, letters, _, points = p.tokens()
            forms = Counter({"N:0" + ".0" * i: int(k) for i, k in enumerate(np.bincount(points[letters == 0])) if k})
            some = letters > 0
            for token, k in Counter(_strings(p.flat, begin[some], end[some])).items():
                for form in token_forms(token):
                    forms[form] += k
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([keys, np.array([token_key(x) for x in forms], np.int64)])), pa.array([None] * len(keys) + list(forms), pa.string()), pa.array(n.tolist() + list(forms.values()), pa.int64())],
                names=["key", "form", "n"],
            )

    t = pages.select(F.col(text).cast("string").alias("t")).filter("t is not null")
    return t.mapInArrow(run, "key bigint, form string, n bigint").groupBy("key", "form").agg(F.sum("n").alias("n"))


def _strings(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[str]:
    """The ASCII strings between the places."""
    line = np.minimum(flat, 127).astype(np.uint8).tobytes().decode("ascii")
    return [line[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def links(counts: DataFrame, ratio: float = 0.35, least: int = 4, words: int = 10) -> DataFrame:
    """(key, meant, rare, freq, support): readings that are rare beside a frequent one which differs by plausible glyph edits, before vectors judge them.

    Glyphs, key (l, c, r) packed, meant the other glyph: either the whole triple is frequent (``least``) with the other glyph, or both its
    words (l c) and (c r) are (``words``). rare and freq are the two-character words of the side that is rarer. Numbers with letters, meant 0:
    the same shape in digits. Latin words with digits: a word of ``words`` occurrences whose letters look like the digits; bit i of meant
    tells whether the i-th 1 is an i and no l.
    """
    spark = counts.sparkSession
    mask = F.lit(0x1FFFFF).cast("bigint")
    triples = counts.filter("form is null").select(F.shiftright("key", 42).alias("l"), F.shiftright("key", 21).bitwiseAND(mask).alias("c"), F.col("key").bitwiseAND(mask).alias("r"), "n")
    g = F.broadcast(spark.createDataFrame(glyph_pairs(), "c bigint, meant bigint"))  # the fixed list
    left = triples.groupBy("l", "c").agg(F.sum("n").alias("nl"))
    right = triples.groupBy("c", "r").agg(F.sum("n").alias("nr"))
    x = triples.join(g, "c")
    x = x.join(triples.select("l", F.col("c").alias("meant"), "r", F.col("n").alias("m")), ["l", "meant", "r"], "left")
    x = x.join(left, ["l", "c"]).join(right, ["c", "r"])
    x = x.join(left.select("l", F.col("c").alias("meant"), F.col("nl").alias("ml")), ["l", "meant"], "left").join(right.select(F.col("c").alias("meant"), "r", F.col("nr").alias("mr")), ["meant", "r"], "left")
    x = x.na.fill(0, ["m", "ml", "mr"])
    whole = (F.col("m") >= least) & (F.col("n") <= ratio * F.col("m"))
    both = (F.col("m") < least) & (F.col("ml") >= words) & (F.col("mr") >= words) & (F.col("nl") <= ratio * F.col("ml")) & (F.col("nr") <= ratio * F.col("mr"))
    on_left = (F.col("r") == 0) | ((F.col("l") > 0) & (F.col("nl") * F.col("mr") <= F.col("nr") * F.col("ml")))
    word = lambda c: F.when(on_left, F.shiftleft("l", 21) + F.col(c)).otherwise(F.shiftleft(F.col(c), 21) + F.col("r"))
    key = F.shiftleft("l", 42) + F.shiftleft("c", 21) + F.col("r")
    glyphs = x.filter(whole | both).select(key.alias("key"), "meant", word("c").alias("rare"), word("meant").alias("freq"), F.greatest("m", "ml", "mr").alias("support"))

    t = counts.filter("form is not null")
    digits = F.col("form").rlike("^..*[0-9]")
    bare = F.substring("form", 3, 1 << 30)
    numbers = t.filter("form like 'N:%'")
    odd = numbers.filter(F.col("form").rlike("[A-Za-z|].*[A-Za-z|]")).withColumn("shape", F.concat(F.lit("N:"), F.regexp_replace(F.translate(bare, LETTERS, DIGITS), "[0-9]+(?:,[0-9]+)*", "0")))
    sound = numbers.filter(~F.col("form").rlike("[A-Za-z|].*[A-Za-z|]")).select(F.col("form").alias("shape"), F.col("key").alias("freq"), F.col("n").alias("support"))
    shapes = odd.join(sound, "shape").filter(F.col("n") <= ratio * F.col("support")).select("key", F.lit(0).cast("bigint").alias("meant"), F.col("key").alias("rare"), "freq", "support")

    skeleton = F.translate(bare, "olisbz", "011582")
    latin = t.filter("form like 'W:%'").withColumn("skeleton", skeleton).withColumn("bare", bare)
    known = latin.filter(~digits & (F.col("n") >= words)).select("skeleton", F.col("bare").alias("word"), F.col("key").alias("freq"), F.col("n").alias("support"))
    pair = F.zip_with(F.split("bare", ""), F.split("word", ""), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    ones = F.filter(F.col("pair"), lambda p: p["a"] == "1")
    bits = F.aggregate(F.transform(ones, lambda p, i: F.when(p["b"] == "i", F.pow(F.lit(2.0), i)).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b).cast("bigint")
    spelled = latin.filter(digits).join(known, "skeleton").withColumn("pair", pair).filter(F.forall("pair", lambda p: (p["a"] == p["b"]) | p["a"].rlike("[0-9]")))
    spelled = spelled.filter(F.col("n") <= ratio * F.col("support")).select("key", bits.alias("meant"), F.col("key").alias("rare"), "freq", "support")
    return glyphs.unionByName(shapes).unionByName(spelled)


def _contexts(c: np.ndarray, at: np.ndarray, side: int) -> np.ndarray:
    """Context buckets of characters at places ``at``, one of four places around a word; digits are one character."""
    x = c[at].astype(np.int64)
    x[(x >= 48) & (x < 58)] = 48
    return ((x * 4 + side) * 2654435761 >> 9) % CONTEXTS


def skip_grams(pages: DataFrame, wanted: np.ndarray | None, text: str = "text") -> DataFrame:
    """(word, context, n) for the words in ``wanted`` (sorted keys; None: all): contexts are the two characters on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = Pages(b.column(0).to_pylist())
            c = p.c
            pair = (c[:-1].astype(np.int64) << 21) | c[1:].astype(np.int64)
            glyph = np.zeros(0x110000, bool)
            glyph[[ord(x) for g in GLYPHS for x in g]] = True
            found: list[tuple[np.ndarray, np.ndarray]] = []

            def add(word: np.ndarray, line: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
                for at, side in ((before, 0), (before - 1, 1), (after, 2), (after + 1, 3)):
                    ok = (at >= 0) & (at < len(line))
                    found.append((word[ok], _contexts(line, at[ok], side)))

            at = np.flatnonzero(glyph[c[:-1]] | glyph[c[1:]]) if wanted is None else np.flatnonzero(_among(wanted, pair))
            add(pair[at], c, at - 1, at + 2)
            begin, end, letters, _, points = p.tokens()
            plain = letters == 0
            keys = np.array([token_key("N:0" + ".0" * i) for i in range(int(points[plain].max(initial=0)) + 1)], np.int64)
            add(keys[points[plain]], p.flat, begin[plain] - 1, end[plain])
            some = np.flatnonzero(~plain)
            known: dict[str, list[int]] = {}
            which, keys = [], []
            for i, s in zip(some.tolist(), _strings(p.flat, begin[some], end[some]), strict=True):
                if s not in known:
                    own = [token_key(x) for x in token_forms(s)]
                    known[s] = own if wanted is None else [k for k in own if _among(wanted, np.array([k], np.int64))[0]]
                for k in known[s]:
                    which.append(i)
                    keys.append(k)
            which = np.array(which, np.int64)
            add(np.array(keys, np.int64), p.flat, begin[which] - 1, end[which])
            word, context = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((context, word))
            word, context = word[order], context[order]
            new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (context[1:] != context[:-1])])[: len(word)])
            yield pa.RecordBatch.from_arrays([pa.array(word[new]), pa.array(context[new].astype(np.int32)), pa.array(np.diff(np.append(new, len(word))))], names=["word", "context", "n"])

    t = pages.select(F.col(text).cast("string").alias("t")).filter("t is not null")
    return t.mapInArrow(run, "word bigint, context int, n bigint").groupBy("word", "context").agg(F.sum("n").alias("n"))


def _among(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which items of ``x`` are in the sorted ``keys``."""
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x if len(keys) else np.zeros(len(x), bool)


def vectors(grams: DataFrame) -> DataFrame:
    """(word, seen, vector): skip-gram vectors of unit length from (word, context, n), and the contexts seen.

    The skip-gram objective with negative sampling is at its optimum where the product of word and context vector is the pointwise mutual
    information of word and context (shifted by the log of the negatives, here one); the vectors of a given dimension are its best
    factorisation. Positive parts are taken. What reaches the driver are the context totals and the second moments of the contexts: fixed sizes,
    from at most 16 tasks.
    """
    rows = materialize(grams.groupBy("word").agg(F.collect_list(F.struct("context", "n")).alias("c")).select("word", F.col("c.context").alias("context"), F.col("c.n").alias("n")), "contexts")  # at most CONTEXTS a word
    totals = np.zeros(CONTEXTS)
    for r in grams.groupBy("context").agg(F.sum("n").alias("n")).collect():  # CONTEXTS rows
        totals[r[0]] = r[1]

    def information(b: pa.RecordBatch) -> np.ndarray:
        n = np.zeros((b.num_rows, CONTEXTS))
        for i, (c, k) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
            n[i, c] = k
        with np.errstate(divide="ignore", invalid="ignore"):
            f = np.log(n * totals.sum() / n.sum(1, keepdims=True) / totals)
        return np.where(n > 0, np.maximum(f, 0), 0)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((CONTEXTS, CONTEXTS))
        for b in batches:
            f = information(b)
            m += f.T @ f
        yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], names=["m"])

    m = sum((np.frombuffer(r[0]).reshape(CONTEXTS, CONTEXTS) for r in rows.coalesce(16).mapInArrow(moments, "m binary").collect()), np.zeros((CONTEXTS, CONTEXTS)))
    basis = np.linalg.eigh(m)[1][:, -DIMENSIONS:]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [sum(k) for k in b.column(2).to_pylist()]
            u = information(b) @ basis
            u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seen, pa.int64()), pa.array(list(u), pa.list_(pa.float64()))], names=["word", "seen", "vector"])

    return rows.mapInArrow(project, "word bigint, seen bigint, vector array<double>")


def confirmed(pages: DataFrame, linked: DataFrame, text: str = "text", cosine: float | None = None) -> DataFrame:
    """(key, meant, cosine): the linked readings whose rare word is a neighbour of the frequent one in the skip-gram space, the nearest for every key."""
    linked = materialize(linked, "links")
    words = materialize(linked.select(F.col("rare").alias("word")).union(linked.select("freq")).distinct(), "words")
    wanted = np.sort(words.toArrow()["word"].to_numpy().copy()) if words.count() <= MAX_SENT_LINKS else None
    grams = skip_grams(pages, wanted, text)
    v = vectors(materialize(grams if wanted is not None else grams.join(words, "word", "left_semi"), "grams"))
    v = materialize(v, "vectors")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = linked.join(v.select(F.col("word").alias("rare"), "seen", F.col("vector").alias("a")), "rare").join(v.select(F.col("word").alias("freq"), F.col("vector").alias("b")), "freq").withColumn("cosine", dot)
    near = near.filter(F.col("cosine") >= (COSINE if cosine is None else cosine) * F.col("seen") / (F.col("seen") + DOUBT))
    return near.groupBy("key").agg(F.max(F.struct("support", "cosine", "meant")).alias("x")).select("key", "x.meant", "x.cosine")


def title_of(path: str | None) -> tuple[str, str]:
    """(title, company) from a file's path: <code>_<company><title><serial>.<type>."""
    m = re.match(r"(\d{6})_([^/]*)$", (path or "").rsplit("/", 1)[-1])
    folder = re.search(r"\d{6}_([^/]+)/", path or "")
    company = look(folder[1]) if folder else ""
    name = re.sub(r"\d{10,}(?=\.)", "", m[2]) if m else ""
    name = look(name.rsplit(".", 1)[0])
    return (name[len(company) :] if company and name.startswith(company) else name), company


def is_title(line: str, title: str, company: str, slack: int = 1) -> bool:
    """The line (in its one form) is the title, with or without company and page; ``slack`` characters may be misread."""
    if not title or abs(len(line) - len(title)) > len(company) + 24:
        return False
    bare = line
    if company:
        at = bare.find(company)
        if at >= 0:
            bare = bare[:at] + re.sub(r"^(?:\(集团\))?股份有限公司", "", bare[at + len(company) :])
    bare = re.sub(r"(?:第|§)[0-9lIOo]{1,4}页?$|(?:第|§)?[0-9lIOo]{1,4}页$", "", bare) if bare != title else bare
    if bare == title:
        return True
    for rest in (bare, re.sub(r"^[0-9lIOo]{1,4}(?=\d{4}年|关于)", "", bare), re.sub(r"[0-9lIOo]{1,4}$", "", bare), re.sub(r"^[0-9lIOo]{1,4}", "", bare)):
        if len(rest) == len(title) and sum(x != y for x, y in zip(rest, title, strict=True)) <= slack:
            return True
    return False


def is_page_number(line: str, page: int) -> bool:
    """The line (in its one form) is the page's own number, with or without marks and the number of pages."""
    if len(line) > 24:
        return False
    m = re.fullmatch(r"[^\w]*(?:第|§|Page|page|P\.?)?[^\w]*([0-9lIOo]{1,5})(?:页|[^\w]*(?:/|of|共)[^\w]*[0-9lIOo]+页?|页[,，]?(?:/|共)[0-9lIOo]+页)?[^\w]*", line)
    return bool(m) and m[1].translate(str.maketrans("lIOo", "1100")).lstrip("0") == str(page)


def mended(token: str, forms: dict[str, int]) -> str | None:
    """The token as the number or word that it is read as; ``forms``: its confirmed forms with ``meant``. None without one."""
    for form, meant in forms.items():
        if form.startswith("N:"):
            return token.translate(_AS_DIGITS)
        upper = sum(x.isupper() for x in token) > sum(x.islower() for x in token) / 2
        ones = 0
        out = []
        for x in token:
            if x == "1":
                x = "i" if meant >> ones & 1 else "l"
                ones += 1
            elif x in "0582":
                x = "osbz"["0582".index(x)]
            else:
                out.append(x)
                continue
            out.append(x.upper() if upper else x)
        return "".join(out)
    return None


def page_sites(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, key): the keys of all glyphs and of all tokens with letters and digits of every page (document_id, page_number, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = Pages(b.column(2).to_pylist())
            at, key = p.glyphs()
            row = np.searchsorted(p.start, at, "right") - 1
            begin, end, letters, digits, _ = p.tokens()
            mixed = (letters > 0) & (digits > 0)
            rows, keys = row.tolist(), key.tolist()
            for i, s in zip((np.searchsorted(p.offset, begin[mixed], "right") - 1).tolist(), _strings(p.flat, begin[mixed], end[mixed]), strict=True):
                for form in token_forms(s):
                    rows.append(i)
                    keys.append(token_key(form))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), b.column(1).take(pa.array(rows, pa.int64())), pa.array(keys, pa.int64())], names=["document_id", "page_number", "key"])

    return pages.mapInArrow(run, widen(pages, "key bigint", ("t",)))


def page_noise(pages: DataFrame, accepted: DataFrame, document: str = "document_id", page: str = "page_number", source: str = "source_file", text: str = "text", repair: bool = True) -> DataFrame:
    """(document_id, page_number, noise array, text): the kinds of noise of each page and, with ``repair``, its text mended.

    ``accepted``: (key, meant), stored. Up to MAX_SENT_LINKS links are sent to the executors; more reach each page by a join on its sites' keys.
    Furniture lines (title at the head, page number at head or foot) are removed, words broken over lines are joined, misread characters
    and digits are replaced; a page with noise is set as paragraphs (``reflow``).
    """
    src = pages.select(F.col(document).alias("document_id"), F.col(page).cast("int").alias("page_number"), F.col(source).cast("string").alias("s"), F.col(text).cast("string").alias("t")).filter("document_id is not null and page_number is not null")
    schema = widen(src, "noise array<string>, text string", ("s", "t"))
    whole: dict[int, int] | None = None
    arrays = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if accepted.count() <= MAX_SENT_LINKS:
        sent = accepted.select("key", "meant").orderBy("key").toArrow()
        arrays = sent["key"].to_numpy().copy(), sent["meant"].to_numpy().copy()
        whole = {k: m for k, m in zip(*(x.tolist() for x in arrays), strict=True) if k < 0}
    else:
        own = page_sites(src.select("document_id", "page_number", "t")).distinct().join(accepted, "key").groupBy("document_id", "page_number").agg(F.collect_list(F.struct("key", "meant")).alias("own"))
        src = src.join(own, ["document_id", "page_number"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        titles: dict[str | None, tuple[str, str]] = {}
        for b in batches:
            texts = b.column(3).to_pylist()
            p = Pages(texts)
            each = [{r["key"]: r["meant"] for r in v or []} for v in b.column(4).to_pylist()] if whole is None else None
            at, key = p.glyphs()
            row = np.searchsorted(p.start, at, "right") - 1
            if each is None:
                hit = np.flatnonzero(_among(arrays[0], key))
                to = arrays[1][np.searchsorted(arrays[0], key[hit])].tolist()
            else:
                hit = np.flatnonzero(np.fromiter((k in each[r] for k, r in zip(key.tolist(), row.tolist(), strict=True)), bool, len(key)))
                to = [each[r][k] for k, r in zip(key[hit].tolist(), row[hit].tolist(), strict=True)]
            fixes: list[list[tuple[int, str]]] = [[] for _ in texts]
            for r, place, m in zip(row[hit].tolist(), p.place[at[hit]].tolist(), to, strict=True):
                fixes[r].append((place - int(p.offset[r]), chr(m)))
            tokens: list[list[tuple[int, str]]] = [[] for _ in texts]
            begin, end, letters, digits, _ = p.tokens()
            mixed = (letters > 0) & (digits > 0)
            row = np.searchsorted(p.offset, begin[mixed], "right") - 1
            for r, place, s in zip(row.tolist(), begin[mixed].tolist(), _strings(p.flat, begin[mixed], end[mixed]), strict=True):
                allowed = whole if each is None else each[r]
                new = mended(s, {f: allowed[k] for f in token_forms(s) if (k := token_key(f)) in allowed})
                if new is not None:
                    tokens[r].append((place - int(p.offset[r]), new))
            noise, out = [], []
            for j, (t, number, path) in enumerate(zip(p.ready, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if path not in titles:
                    titles[path] = title_of(path)
                n, fixed = one_page(t, p.text(j), number, titles[path], fixes[j], tokens[j], repair)
                noise.append(n)
                out.append(fixed if texts[j] is not None else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(noise, pa.list_(pa.string())), pa.array(out, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)


def one_page(t: str, plain: str, number: int, title: tuple[str, str], fixes: list[tuple[int, str]], tokens: list[tuple[int, str]], repair: bool) -> tuple[list[str], str | None]:
    """The kinds of noise of one page, and its text repaired. ``plain`` is the text with every character folded, place by place.

    fixes and tokens: (place, characters put there); tokens in furniture lines are no noise of their own.
    """
    noise = set()
    chars = list(t)
    if fixes:
        noise.add("misread")
        flat = list(plain)
        for p, m in fixes:
            chars[p] = flat[p] = m
        plain = "".join(flat)
    forms = plain.split("\n")
    drop = set()
    last = len(forms) - 1
    for i in {*range(min(_HEAD, last + 1)), *range(max(0, last - 1), last + 1)}:
        form = "".join(forms[i].split())
        if not form:
            continue
        if i < _HEAD and is_title(form, *title):
            noise.add("header")
            drop.add(i)
        elif (i < 2 or i >= last - 1) and is_page_number(form, number):
            noise.add("page_number")
            drop.add(i)
    ends = np.cumsum([len(f) + 1 for f in forms]) if tokens else None
    for p, new in tokens:
        if int(np.searchsorted(ends, p, "right")) not in drop:
            noise.add("misread")
            chars[p : p + len(new)] = new
    body = "".join(chars)
    if drop:
        body = "\n".join(x for i, x in enumerate(body.split("\n")) if i not in drop)
    joined = _BROKEN.sub(r"\1", body)
    if joined != body:
        noise.add("broken_word")
    return sorted(noise), (reflow(joined) if noise else t) if repair else None


_ITEM = re.compile(r"^(?:[(（]?[一二三四五六七八九十\d]+[)）、.．]|[•·●■◆-]\s|[^。；]{1,12}[:：])")


def reflow(t: str) -> str:
    """Wrapped lines joined into paragraphs: without a space between ideographs, with one between Latin words.

    A line goes on in the next one if it has no final mark, is at least half as long as the longest line, and no blank line, item or
    label follows.
    """
    out: list[str] = []
    rows = [x.strip() for x in t.split("\n")]
    width = max(map(len, rows))
    open_ = False
    for s in rows:
        if not s:
            open_ = False
            continue
        if open_ and out and not _ITEM.match(s):
            gap = " " if out[-1][-1].isascii() and out[-1][-1].isalnum() and s[0].isascii() and s[0].isalpha() else ""
            out[-1] += gap + s
        else:
            out.append(s)
        open_ = s[-1] not in "。！？!?：:" and 2 * len(s) >= width
    return "\n".join(out)


def paragraphs(text: Column, when: Column) -> Column:
    """``reflow`` of the texts for which ``when`` holds, the others as they are."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: reflow(t) if t else t)

    return F.when(when, F.pandas_udf(run, "string")(F.when(when, text))).otherwise(text)


def scanned_noise(pages: DataFrame, repair: bool = True, **columns: str) -> DataFrame:
    """``page_noise`` with what is learned from all pages: links of rare words to their frequent neighbours. Re-delivered pages count once.

    Null and empty texts have no noise; pages without key are left out; an empty table gives no rows.
    """
    name = lambda c: columns.get(c, {"document": "document_id", "page": "page_number", "source": "source_file"}.get(c, c))
    document, page, text = name("document"), name("page"), name("text")
    once = pages.select(document, page, name("source"), text).filter(F.col(document).isNotNull() & F.col(page).isNotNull()).dropDuplicates([document, page])
    pages = materialize(once, "pages")
    accepted = materialize(confirmed(pages, links(materialize(word_counts(pages, text), "counts")), text), "accepted")
    return page_noise(pages, accepted, repair=repair, **columns)
