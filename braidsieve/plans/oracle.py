"""SQL fragments for DuckDB: the normal form, tokens and n-grams of texts.

DuckDB has NFC but no NFKC; the compatibility letters are mapped by ``translate`` with strings made from the Unicode tables
by rule (full-width forms, mathematical letters and digits, letter-like signs, superscripts, special spaces), and
ligatures are replaced one by one.
"""

from __future__ import annotations

import unicodedata

_BLOCKS = ((0xA0, 0x180), (0x2000, 0x2200), (0x2460, 0x24EB), (0x3000, 0x3001), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x1F100, 0x1F150))
_SINGLE = [(chr(p), k) for a, b in _BLOCKS for p in range(a, b) if len(k := unicodedata.normalize("NFKC", chr(p))) == 1 and k != chr(p)]
_FROM, _TO = ("".join(x[i] for x in _SINGLE).replace("'", "''") for i in (0, 1))
_JOINED = [(chr(p), unicodedata.normalize("NFKC", chr(p))) for p in range(0xFB00, 0xFB07)]


def normal(text: str) -> str:
    """The normal form of a text expression."""
    x = f"regexp_replace({text}, '\\p{{Cf}}+', '', 'g')"
    for a, b in _JOINED:
        x = f"replace({x}, '{a}', '{b}')"
    x = f"lower(nfc_normalize(translate({x}, '{_FROM}', '{_TO}')))"
    x = f"regexp_replace({x}, '(\\p{{L}})σ($|[^\\p{{L}}])', '\\1ς\\2', 'g')"  # the sigma at a word's end
    x = f"regexp_replace({x}, '\\p{{P}}+', ' ', 'g')"
    return f"trim(regexp_replace({x}, '[\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+', ' ', 'g'))"


def tokens(text: str) -> str:
    """The list of tokens of a text expression."""
    return f"regexp_extract_all({normal(text)}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')"


def grams(tok: str, n: str) -> str:
    """All n-grams of a token list, in order, as strings; none if it is shorter."""
    return f"[array_to_string({tok}[i : i + {n} - 1], ' ') for i in range(1, len({tok}) - ({n}) + 2)]"


def view(choices: bool) -> str:
    """The searched text of mini_benchmark and eval_items."""
    q = "coalesce(question, '')"
    return f"CASE WHEN coalesce(len(choices), 0) = 0 THEN {q} ELSE {q} || chr(10) || array_to_string(choices, chr(10)) END" if choices else q


def wilson(k: str, n: str) -> tuple[str, str]:
    z = "1.96"
    mid = f"(({k})::DOUBLE/({n}) + {z}*{z}/(2*({n})))"
    half = f"({z} * sqrt(({k})::DOUBLE/({n})*(1-({k})::DOUBLE/({n}))/({n}) + {z}*{z}/(4.0*({n})*({n}))))"
    d = f"(1 + {z}*{z}/({n}))"
    low = f"CASE WHEN ({n}) = 0 OR ({k}) = 0 THEN 0.0 ELSE greatest(0.0, ({mid} - {half}) / {d}) END"
    high = f"CASE WHEN ({n}) = 0 OR ({k}) = ({n}) THEN 1.0 ELSE least(1.0, ({mid} + {half}) / {d}) END"
    return low, high


MINI_CORPUS = "SELECT pos AS doc_key, coalesce(id, 'row-' || pos) AS doc_id, text FROM mini_corpus WHERE text IS NOT NULL"
DOCUMENTS = "SELECT doc_id AS doc_key, CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents WHERE text IS NOT NULL"


def index(n: int | str, *, choices: bool = True, stop_k: int | None = None, min_tokens: int | None = None, items: str = "mini_benchmark") -> str:
    """CTEs: it (item_id, tok), ent (eid, tok, ids, len, size), eg (eid, size, g, df), kept, tot (eid, total)."""
    least = min(4, int(n)) if min_tokens is None else min_tokens
    stop = f"WHERE df < {stop_k}" if stop_k else ""
    return f"""
it AS (SELECT item_id, {tokens(view(choices))} AS tok FROM {items}),
ent AS (SELECT *, row_number() OVER (ORDER BY tok) AS eid FROM (
  SELECT tok, list(item_id ORDER BY item_id) AS ids, len(tok) AS len, least({n}, len(tok)) AS size FROM it WHERE len(tok) >= {least} GROUP BY tok)),
eg AS (SELECT *, count(*) OVER (PARTITION BY size, g) AS df FROM (
  SELECT eid, size, unnest(list_distinct({grams('tok', 'size')})) AS g FROM ent)),
kept AS (SELECT * FROM eg {stop}),
tot AS (SELECT eid, count(*) AS total FROM kept GROUP BY eid)"""


def hits(n: int | str, partial: float, near: float, *, slack: float | None = None, snippet: int = 0, docs: str = MINI_CORPUS, **of) -> str:
    """CTEs up to hits, with all columns of a hit."""
    base = f"""WITH {index(n, **of)},
d AS (SELECT doc_key, doc_id, {tokens('text')} AS tok FROM ({docs})),
dg AS (SELECT doc_key, size, unnest(range(0, len(tok) - size + 1)) AS p, unnest({grams('tok', 'size')}) AS g
  FROM d CROSS JOIN (SELECT DISTINCT size FROM kept)),
m AS (SELECT doc_key, eid, p, g FROM dg JOIN kept USING (size, g)),
whole AS (SELECT doc_key, eid, count(DISTINCT g) AS matched, min(p) AS st FROM m GROUP BY ALL),
pairs AS (SELECT * FROM whole JOIN tot USING (eid) WHERE matched >= {partial} * total - 1e-12)"""
    if slack is None:
        best = "best AS (SELECT * FROM pairs)"
    else:
        best = f"""
spans AS (SELECT doc_key, eid, total, greatest(1, ceil({slack} * (len - size + 1))) AS span FROM pairs JOIN ent USING (eid)),
ends AS (SELECT a.doc_key, a.eid, a.p, s.total, count(DISTINCT b.g) AS matched, min(b.p) AS st
  FROM spans s JOIN m a USING (doc_key, eid) JOIN m b ON b.doc_key = a.doc_key AND b.eid = a.eid AND b.p <= a.p AND b.p > a.p - s.span GROUP BY ALL),
best AS (SELECT doc_key, eid, total, matched, st FROM ends QUALIFY row_number() OVER (PARTITION BY doc_key, eid ORDER BY matched DESC, p) = 1)"""
    words = f"substring(array_to_string(d.tok[st + 1 : st + ent.len + 3], ' '), 1, {snippet})" if snippet else "''"
    return f"""{base},
{best},
scored AS (
  SELECT ids, eid, doc_key, doc_id, matched::DOUBLE / total AS containment, matched AS matched_ngrams, total AS total_ngrams, size AS ngram_size,
    matched::DOUBLE / total >= {near} AND contains(' ' || array_to_string(d.tok, ' ') || ' ', ' ' || array_to_string(ent.tok, ' ') || ' ') AS exact,
    ent.len < {n} AS short, st AS window_start, {words} AS snippet
  FROM best JOIN ent USING (eid) JOIN d USING (doc_key)),
hits AS (
  SELECT unnest(ids) AS item_id, doc_key, doc_id, CASE WHEN exact THEN 3 WHEN containment >= {near} THEN 2 WHEN containment >= {partial} THEN 1 ELSE 0 END AS rank,
    ['NONE', 'PARTIAL', 'NEAR_DUPLICATE', 'EXACT'][CASE WHEN exact THEN 3 WHEN containment >= {near} THEN 2 WHEN containment >= {partial} THEN 1 ELSE 0 END + 1] AS level,
    containment, matched_ngrams, total_ngrams, ngram_size, exact, short, window_start, snippet
  FROM scored WHERE exact OR containment >= {partial})
"""
