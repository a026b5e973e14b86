"""SQL for DuckDB: plain form, words and record cards of texts, and the queries that can be said with them.

The character classes come from the same Unicode tables as the operators', the plans do not: pairs are found by joins over
all common runs.  DuckDB has no compatibility normalisation; the compatibility letters are mapped one by one.
"""

from __future__ import annotations

import unicodedata

from braidsieve.llm import text as tx
from braidsieve.plans import oracle as core
from braidsieve.plans.pairs import _pairs


def _class(points: list[int]) -> str:
    return "".join(f"\\x{{{p:x}}}" for p in sorted(points))


def _tables() -> tuple[str, str, str, str, str]:
    t = tx.tables()
    unseen = [p for p, to in t.first.items() if to is None]
    spaces = [p for p, to in t.first.items() if to == " "]
    built = [p for a, b in ((0x370, 0x530), (0x1F00, 0x2000)) for p in range(a, b) if t.alike.match(chr(p))]
    plain = {p: unicodedata.normalize("NFC", unicodedata.normalize("NFD", chr(p)).translate(t.latin)) for p in {*t.latin, *built}}
    plain = {p: to for p, to in plain.items() if len(to) == 1}
    return _class(unseen), _class(spaces), _class(list(plain)), "".join(map(chr, plain)), "".join(plain.values())


_UNSEEN, _SPACES, _ALIKE, _FROM, _TO = _tables()
_LETTER = r"\p{L}\p{N}\x{300}-\x{36f}"


def plain(text: str) -> str:
    """The plain form of a text expression."""
    x = f"regexp_replace(regexp_replace({text}, '[{_UNSEEN}]+', '', 'g'), '[{_SPACES}]', ' ', 'g')"
    for a, b in core._JOINED:
        x = f"replace({x}, '{a}', '{b}')"
    x = f"nfc_normalize(translate({x}, '{core._FROM}', '{core._TO}'))"
    word = f"CASE WHEN regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[{_ALIKE}]') THEN translate(w, '{_FROM}', '{_TO}') ELSE w END"
    return f"nfc_normalize(array_to_string([{word} for w in regexp_extract_all({x}, '[{_LETTER}]+|[^{_LETTER}]+')], ''))"


def words(plain_text: str) -> str:
    """The words of an expression that is in plain form."""
    low = f"regexp_replace(lower({plain_text}), '(\\p{{L}})σ($|[^\\p{{L}}])', '\\1ς\\2', 'g')"
    return f"regexp_extract_all(replace({low}, '_', ' '), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}\\s\\p{{P}}\\p{{Z}}]')"


def _words_of(name: str, key: str, text: str, table: str) -> str:
    """A CTE (id, w)."""
    return f"{name}_p AS (SELECT {key} AS id, {plain(text)} AS p FROM {table} WHERE {text} IS NOT NULL), {name} AS (SELECT id, {words('p')} AS w FROM {name}_p)"


def _run_sets(name: str, of: str, k: int) -> str:
    return f"{name} AS (SELECT id, list_distinct({core.grams('w', str(k))}) AS s FROM {of} WHERE len(w) >= {k})"


_TEXTS = "SELECT 'mini_corpus' AS table_name, pos, text FROM mini_corpus UNION ALL SELECT 'mini_benchmark', pos, question FROM mini_benchmark"
_ROWS = f"""rows AS (SELECT table_name, pos, text, {plain('text')} AS p FROM ({_TEXTS}) WHERE text IS NOT NULL),
worded AS (SELECT *, {words('p')} AS w FROM rows), r AS (SELECT * FROM worded WHERE len(w) > 0)"""
_FIELDS = "[f for f in regexp_split_to_array(p, '[\\n|]') if trim(f, chr(32) || chr(9) || chr(10) || chr(13)) <> '']"
_IS_FIELD = "contains(f, ':') AND regexp_matches(split_part(f, ':', 1), '[\\p{L}\\p{N}]') AND regexp_matches(f[strpos(f, ':') + 1 :], '[^\\s\\p{Z}]')"
_CARDS = f"""{_ROWS},
fielded AS (SELECT *, array_to_string(w, ' ') AS seq, {_FIELDS} AS fields FROM r),
carded AS (SELECT *, CASE WHEN len(fields) >= 3 AND len([f for f in fields if {_IS_FIELD}]) = len(fields)
  THEN array_to_string(list_sort([array_to_string({words('f')}, ' ') for f in fields]), chr(30)) END AS rec FROM fielded),
keyed AS (SELECT table_name, pos, coalesce(rec, min(rec) OVER (PARTITION BY table_name, seq), seq) AS key FROM carded)"""

_NEAR = f"{_words_of('t', 'item_id', 'question', 'mini_benchmark')}, {_run_sets('a', 't', 3)}, {_pairs('a', 'a', 'u.id < v.id', 0.5)}"
_CLASSES = f"""{_NEAR}, named AS (SELECT id, min(id) OVER (PARTITION BY array_to_string(w, ' ')) AS class_id FROM t WHERE len(w) >= 3)"""

SQL = {
    "p2_found": f"WITH {_NEAR} SELECT id_a, id_b FROM p",
    "p2_groups": f"""WITH RECURSIVE {_CLASSES}, e AS (SELECT id_a AS a, id_b AS b FROM p UNION SELECT id_b, id_a FROM p),
reach AS (SELECT id, id AS m FROM named UNION SELECT e.b, r.m FROM reach r JOIN e ON r.id = e.a), grp AS (SELECT id, min(m) AS group_id FROM reach GROUP BY 1),
l AS (SELECT x.class_id, count(DISTINCT y.class_id) AS links FROM e JOIN named x ON x.id = e.a JOIN named y ON y.id = e.b WHERE x.class_id <> y.class_id GROUP BY 1)
SELECT id, class_id, group_id, coalesce(links, 0) AS links FROM named JOIN grp USING (id) LEFT JOIN l USING (class_id)""",
    "p2_list": f"""WITH {_CLASSES}, c0 AS (SELECT lower(regexp_replace(id_a, '^\\s+|\\s+$', '', 'g')) AS a, lower(regexp_replace(id_b, '^\\s+|\\s+$', '', 'g')) AS b,
  CASE WHEN NOT isnan(jaccard) AND jaccard BETWEEN 0 AND 1 THEN jaccard END AS s FROM gsm8k_test_dupes),
old AS (SELECT least(a, b) AS id_a, greatest(a, b) AS id_b, max(s) AS listed_jaccard FROM c0 WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b GROUP BY 1, 2),
held AS (SELECT o.*, p.jaccard, x.class_id AS x, y.class_id AS y FROM old o LEFT JOIN p USING (id_a, id_b) LEFT JOIN named x ON x.id = id_a LEFT JOIN named y ON y.id = id_b),
shown AS (SELECT * FROM held WHERE jaccard IS NOT NULL),
far AS (SELECT DISTINCT least(x.class_id, y.class_id) AS id_a, greatest(x.class_id, y.class_id) AS id_b FROM p JOIN named x ON x.id = id_a JOIN named y ON y.id = id_b WHERE x.class_id <> y.class_id),
star AS (SELECT class_id AS id_a, id AS id_b FROM named WHERE id <> class_id)
SELECT id_a, id_b, jaccard, listed_jaccard, CASE WHEN jaccard IS NULL THEN 'removed' WHEN abs(jaccard - listed_jaccard) <= 0.006 THEN 'kept' ELSE 'rescored' END AS status FROM held
UNION ALL SELECT id_a, id_b, p.jaccard, NULL, 'added' FROM far JOIN p USING (id_a, id_b) WHERE (id_a, id_b) NOT IN (SELECT (least(x, y), greatest(x, y)) FROM shown WHERE x <> y)
UNION ALL SELECT id_a, id_b, 1.0, NULL, 'added' FROM star WHERE (id_a, id_b) NOT IN (SELECT (id_a, id_b) FROM shown)""",
    "p4_found": f"WITH {_ROWS} SELECT a.table_name, a.pos AS pos_a, b.pos AS pos_b FROM r a JOIN r b ON a.table_name = b.table_name AND a.p = b.p AND a.pos < b.pos AND a.text <> b.text",
    "p5_found": f"WITH {_CARDS}, f AS (SELECT *, min(pos) OVER (PARTITION BY table_name, key) AS first_pos FROM keyed) SELECT table_name, first_pos, pos AS copy_pos FROM f WHERE pos <> first_pos",
    "p5_records": f"WITH {_CARDS} SELECT table_name, min(pos) AS first_pos, count(*) AS copies FROM keyed GROUP BY table_name, key",
    "p6_check": "SELECT count(*) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS gaps, 0::BIGINT AS cut_in_vain, 0::BIGINT AS unplaced FROM documents",
    "p7_found": f"""WITH {_words_of('t', 'doc_id', 'text', 'documents')}, {_words_of('q', 'item_id', 'question', 'eval_items')}, {_run_sets('d', 't', 3)}, {_run_sets('i', 'q', 3)},
g AS (SELECT id AS item_id, len(s) AS total, unnest(s) AS g FROM i), h AS (SELECT id AS doc_id, unnest(s) AS g FROM d)
SELECT doc_id, item_id FROM h JOIN g USING (g) GROUP BY doc_id, item_id, total HAVING 2 * count(*) >= total""",
    "p8_found": f"""WITH {_words_of('t', 'doc_id', 'text', 'documents')}, r AS (SELECT id, {core.grams('w', '5')} AS runs FROM t WHERE len(w) >= 20)
SELECT id AS doc_id FROM r WHERE 1 - len(list_distinct(runs))::DOUBLE / len(runs) >= 0.3 - 1e-12""",
}
