"""DuckDB SQL fragments that mirror the text scalars. RE2 has no lookaround, so neighbours are captured and written back, twice over."""

from __future__ import annotations

from ..functions import rules as R

WS, HAN = R.WS, R.HAN


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$")


def blanks(x: str) -> str:
    return sub(x, "[ \t\r\f\v]+", " ")


def squeeze(x: str, left: str, right: str) -> str:
    for _ in range(2):
        x = sub(x, f"({left}){WS}+({right})", "\\1\\2")
    return x


def clean_page(x: str) -> str:
    t = blanks(f"translate({x}, {lit(''.join(map(chr, (0x3000, 0xA0, 0x200B, 0xFEFF))))}, '  ')")
    line = squeeze(squeeze(squeeze("s", HAN, HAN), HAN, "[，。；：！？、）】]"), "[（【]", HAN)
    lines = f"list_filter(list_transform(string_split_regex({t}, {lit('[' + chr(10) + chr(28) + chr(29) + chr(30) + chr(0x85) + chr(0x2028) + chr(0x2029) + ']')}), lambda s: {strip('s')}), lambda s: s <> '')"
    return f"array_to_string(list_transform({lines}, lambda s: {line}), chr(10))"


def report(x: str) -> str:
    t = blanks(f"replace({x}, '　', ' ')")
    return strip(squeeze(sub(t, f"{WS}*\n{WS}*"), HAN, HAN))


def compact(x: str) -> str:
    t = sub(sub(x, R.BOARD_NOTE), R.PAGE_MARK)
    for line in R.DROPPED_LINES:
        t = sub(t, "(?m)" + line)
    return sub(squeeze(sub(blanks(t), f"{WS}*\n{WS}*"), HAN, HAN), "^[ \n\t；;]+|[ \n\t；;]+$")


def answer(x: str) -> str:
    t = f"translate({sub(x, '(?s)<think>.*?</think>')}, {lit(R.FULL_WIDTH)}, {lit(R.HALF_WIDTH)})"
    return f"regexp_replace({sub(sub(t, '[*#]'), WS)}, {lit(R.ANSWER_LABEL)}, '')"


def background(x: str) -> str:
    return f"string_split_regex({x}, {lit(R.REQUEST_TRIGGER)})[1]"


def query_text(topic: str, parent: str, question: str) -> str:
    parts = ", ".join(f"nullif(coalesce({p}, ''), '')" for p in (topic, background(parent), question))
    return report(f"concat_ws('。', {parts})")


def token_text(x: str) -> str:
    return f"lower({report(f'coalesce({x}, {lit(str())})')})"


def terms(t: str) -> str:
    """The list of terms of a normalised text; ``t`` is a column, as it is read once per place."""
    pairs = f"list_filter(list_transform(range(1, length({t})), lambda i: substr({t}, i, 2)), lambda s: regexp_full_match(s, '{HAN}{{2}}'))"
    single = f"regexp_extract_all(regexp_replace({t}, '([^一-鿿])', '\\1\\1', 'g'), '(?:^|[^一-鿿])({HAN})(?:$|[^一-鿿])', 1)"
    latin = f"list_transform(regexp_extract_all({t}, '[a-z0-9]+(?:[.,][a-z0-9]+)*%?'), lambda s: replace(s, ',', ''))"
    bare = f"list_transform(list_filter({latin}, lambda s: s LIKE '%\\%' ESCAPE '\\'), lambda s: regexp_replace(s, '%$', ''))"
    return f"list_concat(list_concat({pairs}, {single}), list_concat({latin}, {bare}))"


def term_rows(keys: str, x: str, source: str) -> str:
    """SELECT keys, term: one row per term of column ``x`` of ``source``."""
    return f"SELECT {keys}, unnest({terms('tt')}) term FROM (SELECT {keys}, {token_text(x)} tt FROM {source})"


PAGES = "(SELECT DISTINCT ON (document_id, page_number) * FROM page_records)"
QUESTIONS = "(SELECT DISTINCT ON (question_id) * FROM question_records)"
PREDICTIONS = "(SELECT DISTINCT ON (config, sample_id) * FROM predictions)"

CHUNKS = f"""
  p AS (SELECT stock_code, report_year, document_id, page_number page, {report('text')} t FROM {PAGES} WHERE document_type = 'annual_report'),
  o AS (SELECT *, sum(length(t) + 1) OVER w - length(t) - 1 AS start FROM p WHERE t <> '' WINDOW w AS (PARTITION BY stock_code, report_year ORDER BY page, document_id ROWS UNBOUNDED PRECEDING)),
  r AS (SELECT stock_code, report_year, string_agg(t, chr(10) ORDER BY page, document_id) txt FROM o GROUP BY ALL),
  w AS (SELECT stock_code, report_year, unnest(range(0, 1 + greatest(0, ceil((length(txt) - 750) / 650.0))::INT)) k, txt FROM r),
  s AS (SELECT stock_code, report_year, k, txt, {strip('substr(txt, k::INT * 650 + 1, 750)')} text FROM w),
  chunks AS (SELECT stock_code, report_year, k, txt, row_number() OVER (PARTITION BY stock_code, report_year ORDER BY k)::INT chunk_no, text FROM s WHERE length(text) >= 50)
"""


def bm25(docs: str, queries: str, part: str, k: int) -> str:
    """docs(part, doc_id, text), queries(part, query_id, text); part: a column name."""
    return f"""
  dt AS ({term_rows(f'{part}, doc_id', 'text', docs)}),
  tf AS (SELECT {part}, doc_id, term, count(*) tf FROM dt GROUP BY ALL),
  dl AS (SELECT {part}, doc_id, sum(tf) dl FROM tf GROUP BY ALL),
  df AS (SELECT {part}, term, count(*) df FROM tf GROUP BY ALL),
  st AS (SELECT d.{part}, count(*) n, avg(coalesce(dl, 0)) avgdl FROM {docs} d LEFT JOIN dl ON dl.{part} IS NOT DISTINCT FROM d.{part} AND dl.doc_id = d.doc_id GROUP BY ALL),
  qt AS (SELECT {part}, query_id, term, count(*) qtf FROM ({term_rows(f'{part}, query_id', 'text', queries)}) GROUP BY ALL),
  sc AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / CASE WHEN avgdl > 0 THEN avgdl ELSE 1 END)) * (1 + ln(qtf))) score
         FROM qt JOIN tf USING ({part}, term) JOIN dl USING ({part}, doc_id) JOIN df USING ({part}, term) JOIN st USING ({part}) GROUP BY ALL),
  al AS (SELECT DISTINCT q.query_id, d.doc_id FROM (SELECT DISTINCT {part}, query_id FROM qt) q JOIN {docs} d USING ({part})),
  rk AS (SELECT query_id, doc_id, round(coalesce(score, 0.0)::DOUBLE, 9) score FROM al LEFT JOIN sc USING (query_id, doc_id))
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, round(score, 6) score FROM rk
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {k}
"""


#: To be put behind CHUNKS: the pages of every chunk that have visible text in its window.
CHUNK_PAGES = f"""
  met AS (SELECT c.stock_code, c.report_year, c.chunk_no, o.page, substr(c.txt, (greatest(c.k * 650, o.start) + 1)::INT, (least(c.k * 650 + 750, o.start + length(o.t) + 1) - greatest(c.k * 650, o.start))::INT) piece
    FROM chunks c JOIN o ON o.t <> '' AND o.stock_code IS NOT DISTINCT FROM c.stock_code AND o.report_year IS NOT DISTINCT FROM c.report_year AND o.start < c.k * 650 + 750 AND o.start + length(o.t) + 1 > c.k * 650),
  ranges AS (SELECT stock_code, report_year, chunk_no, min(page) page_start, max(page) page_end FROM met WHERE {strip('piece')} <> '' GROUP BY ALL)
"""
PAGE_RANGE = "CASE WHEN page_start IS NULL AND page_end IS NULL THEN NULL WHEN page_start IS NOT DISTINCT FROM page_end THEN 'p' || page_start ELSE concat_ws('-', 'p' || page_start, page_end::VARCHAR) END"


def numeral(x: str) -> str:
    """As functions.text.numeral."""
    d = lambda s, empty: f"CASE WHEN length({s}) = 1 AND instr('一二三四五六七八九十', {s}) > 0 THEN instr('一二三四五六七八九十', {s}) ELSE {empty} END"
    left, right = f"split_part({x}, '十', 1)", f"string_split({x}, '十')[-1]"
    return f"CASE WHEN regexp_full_match({x}, '\\d+') THEN try_cast({x} AS INT) WHEN length({x}) = 1 THEN {d(x, 'NULL')} WHEN contains({x}, '十') THEN ({d(left, 1)}) * 10 + ({d(right, 0)}) END"


def points(x: str, company: str) -> str:
    """The list of 'dimension:point' of a cleaned text, as operators.evaluate.key_points."""
    words = lambda ws: "list_filter([" + ", ".join(lit(w) for w in ws) + f"], lambda w: contains({x}, w))"
    find = lambda p: f"regexp_extract_all({x}, {lit(p)})"
    actions = f"list_filter({words(R.ACTIONS)}, lambda w: w <> '披露' OR NOT contains({x}, '补充披露'))"
    own = f"CASE WHEN coalesce({company}, '') <> '' AND contains({x}, {company}) THEN [{company}] ELSE [] END"
    dims = {"fin_item": words(R.FINANCIAL_ITEMS), "action": actions, "risk_or_disclosure": f"list_concat({find(R.WHETHER)}, {find(R.RATIONALE)})", "time_scope": f"list_concat({words(R.TIME_SCOPES)}, {find(R.YEAR)})", "entity": f"list_concat({find(R.ENTITY)}, {own})"}
    out = "[]::VARCHAR[]"
    for d, v in dims.items():
        out = f"list_concat({out}, list_transform(list_distinct({v}), lambda w: '{d}:' || w))"
    return out


def matched(a: str, b: str) -> str:
    """How many of list ``a`` agree with one of list ``b``."""
    text = lambda v: f"substr({v}, instr({v}, ':') + 1)"
    return f"len(list_filter({a}, lambda u: len(list_filter({b}, lambda v: split_part(u, ':', 1) = split_part(v, ':', 1) AND (contains({text('u')}, {text('v')}) OR contains({text('v')}, {text('u')})))) > 0))"


def without_professional(x: str) -> str:
    """The text without requests to advisers, as operators.segment.without_professional; ``x`` is a compacted text."""
    rest = x
    for p in R.PROFESSIONAL:
        rest = sub(rest, p)
    rest = sub(sub(compact(rest), "[。；;]{2,}", "。"), "^[ ，,。；;]+|[ ，,。；;]+$")
    any_ = " OR ".join(f"regexp_matches({x}, {lit(p)})" for p in R.PROFESSIONAL)
    return f"CASE WHEN {any_} THEN {rest} ELSE {x} END"


def strip_requester(x: str) -> str:
    t = strip(f"regexp_replace({x}, {lit('^' + R.REQUESTER)}, '')")
    t = strip(f"regexp_replace({t}, {lit('^请(' + '|'.join(R.LEADING_VERBS) + ')')}, '\\1')")
    return sub(t, "^[ ，,。；;]+|[ ，,。；;]+$")


#: ROUGE-L of every prediction by the rows of the dynamic program, one character of the gold text at a time.
ROUGE = f"""
RECURSIVE src AS (SELECT config, sample_id, {answer("coalesce(prediction, '')")} a, {answer("coalesce(reference, '')")} b FROM {PREDICTIONS}),
  cells AS (SELECT config, sample_id, a, b, i.i::INT i, substr(a, i.i::INT, 1) c FROM src, unnest(range(1, length(a) + 1)) i(i) WHERE length(b) > 0),
  dp AS (
    SELECT config, sample_id, i, c, b, 0 j, 0 v FROM cells
    UNION ALL
    SELECT config, sample_id, i, c, b, j + 1, max(t) OVER (PARTITION BY config, sample_id ORDER BY i ROWS UNBOUNDED PRECEDING)
    FROM (SELECT config, sample_id, i, c, b, j, greatest(v, coalesce(lag(v) OVER (PARTITION BY config, sample_id ORDER BY i), 0) + CASE WHEN c = substr(b, j + 1, 1) THEN 1 ELSE 0 END) t FROM dp WHERE j < length(b))),
  lcs AS (SELECT config, sample_id, max(v) n FROM dp WHERE j = length(b) GROUP BY ALL),
  rouge AS (SELECT s.config, s.sample_id, coalesce(2.0 * n / (length(a) + length(b)), 0)::DOUBLE rouge_l FROM src s LEFT JOIN lcs ON lcs.config IS NOT DISTINCT FROM s.config AND lcs.sample_id = s.sample_id)"""


def professional(x: str) -> tuple[str, str]:
    """(text without requests to advisers, these requests once each in order of place), of a raw text."""
    rest = x
    for p in R.PROFESSIONAL:
        rest = sub(rest, p)
    any_ = " OR ".join(f"regexp_matches({x}, {lit(p)})" for p in R.PROFESSIONAL)
    cleaned = f"CASE WHEN {any_} THEN {sub(sub(compact(rest), '[。；;]{2,}', '。'), '^[ ，,。；;]+|[ ，,。；;]+$')} ELSE {compact(x)} END"
    found = "[]::VARCHAR[]"
    for p in R.PROFESSIONAL:
        found = f"list_concat({found}, regexp_extract_all({x}, {lit(p)}))"
    placed = f"list_sort(list_transform({found}, lambda m: {{'at': instr({x}, m), 'm': m}}))"
    values = f"list_filter(list_transform({placed}, lambda s: {sub(compact('s.m'), '^[。；; ]+|[。；; ]+$')}), lambda v: v <> '')"
    return cleaned, values
