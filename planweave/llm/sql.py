"""SQL that must give the same rows as the queries of this subpackage, from the definitions: plain joins, no hashing, no index.

Texts are brought to their consistent form by SQL functions; the characters a
single character stands for are told by rule from the Unicode tables.
"""

from __future__ import annotations

import unicodedata

from planweave.llm import canon
from planweave.llm.consistent import ARABIC_FORMS, EXTRA_COMPOSITIONS, ZWNJ, expand
from planweave.plans.catalogue import ENTITIES_SQL


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _blocks():
    """Code points of the scripts and forms that the tables may hold."""
    for low, high in ((0x20, 0x600), (0x600, 0x780), (0x2000, 0x2200), (0xFB00, 0xFB07), (0xFB50, 0xFF00), (0xFF01, 0xFFE7), (0x3000, 0x3001), (0xFEFF, 0xFF00)):
        yield from range(low, high)


def _tables() -> tuple[str, str, str, list[tuple[str, str]]]:
    """Characters with one other character, these, characters that go, and pairs of a character and the several it stands for."""
    source, target, gone, longer = [], [], [], []
    for cp in _blocks():
        c, out = chr(cp), "".join(map(chr, expand(cp)))
        # Composed characters are left whole where composing brings them back.
        composed = unicodedata.normalize("NFC", out)
        if cp == ZWNJ or composed == c or unicodedata.category(c) == "Cn":
            continue
        if not out:
            gone.append(c)
        elif len(out) == 1:
            source.append(c)
            target.append(out)
        elif len(composed) == 1:
            source.append(c)
            target.append(composed)
        else:
            longer.append((c, out))
    return "".join(source), "".join(target), "".join(gone), longer


def form(text: str) -> str:
    """SQL of the consistent form of a text."""
    source, target, gone, longer = _tables()
    s = f"nfc_normalize({text})"
    for c, out in longer:
        if c.isalpha():
            s = f"replace({s}, {_lit(c)}, {_lit(out)})"
    s = f"translate({s}, {_lit(source + gone)}, {_lit(target)})"
    s = f"nfc_normalize({s})"
    for (a, b), c in EXTRA_COMPOSITIONS.items():
        s = f"replace({s}, {_lit(a + b)}, {_lit(c)})"
    s = f"translate({s}, {_lit(''.join(ARABIC_FORMS))}, {_lit(''.join(ARABIC_FORMS.values()))})"
    z = chr(ZWNJ)
    s = f"regexp_replace({s}, '{z}+', '{z}', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '{z}([^\\p{{L}}\\p{{M}}]|$)', '\\1', 'g'), '([^\\p{{L}}\\p{{M}}]|^){z}', '\\1', 'g')"
    return f"trim(regexp_replace({s}, ' +', ' ', 'g'), ' ')"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{M}}\\p{{N}}{chr(ZWNJ)}]+')"


P1 = f"""WITH t AS (SELECT 'text_fa' AS field, clause_id AS id, {form('text_fa')} AS f FROM clauses WHERE text_fa IS NOT NULL UNION ALL SELECT 'text_en', clause_id, {form('text_en')} FROM clauses WHERE text_en IS NOT NULL),
  w AS (SELECT field, id, {_words('f')} AS w FROM t),
  g AS (SELECT DISTINCT field, id, array_to_string(w[k : k + 2], ' ') AS g FROM (SELECT field, id, w, unnest(range(1, len(w) - 1)) AS k FROM w)),
  n AS (SELECT field, id, count(*) AS n FROM g GROUP BY field, id),
  c AS (SELECT a.field, a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.field = b.field AND a.g = b.g AND a.id < b.id GROUP BY a.field, a.id, b.id)
  SELECT field, a AS clause_a, b AS clause_b FROM c JOIN n x USING (field) JOIN n y USING (field) WHERE x.id = a AND y.id = b AND c.c >= 0.6 * (x.n + y.n - c.c) - 1e-9
  UNION SELECT a.field, a.id, b.id FROM w a JOIN w b ON a.field = b.field AND a.w = b.w AND a.id < b.id"""

P6 = f"""WITH t AS (SELECT 'text_fa' AS field, clause_id AS id, text_fa AS t FROM clauses WHERE text_fa IS NOT NULL UNION ALL SELECT 'heading_fa', clause_id, heading_fa FROM clauses WHERE heading_fa IS NOT NULL),
  f AS (SELECT field, id, t, {form('t')} AS f FROM t)
  SELECT a.field, a.id AS clause_a, b.id AS clause_b FROM f a JOIN f b ON a.field = b.field AND a.f = b.f AND a.id < b.id AND a.t <> b.t"""

_DIGITS = "".join(chr(0x6F0 + k) for k in range(10))


def _leak_words(text: str) -> str:
    return f"regexp_extract_all(lower(translate(replace({form(text)}, '{chr(ZWNJ)}', ''), '{_DIGITS}', '0123456789')), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"


P7 = f"""WITH d AS (SELECT doc_id AS id, {_leak_words('text')} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id AS id, {_leak_words('text')} AS w FROM eval_items WHERE text IS NOT NULL),
  dg AS (SELECT DISTINCT id, array_to_string(w[k : k + 7], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS k FROM d)), ig AS (SELECT DISTINCT id, array_to_string(w[k : k + 7], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS k FROM i))
  SELECT DISTINCT dg.id AS doc_id, ig.id AS item_id FROM dg JOIN ig ON dg.g = ig.g"""

P4_NEAREST = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM clause_vectors WHERE len(embedding) = 128), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE isfinite(list_dot_product(e, e)) AND list_dot_product(e, e) > 0),
  s AS (SELECT q.vec_id, b.vec_id AS neighbour, round(list_dot_product(q.e, b.e) / (q.n * b.n), 9) AS similarity FROM u q, u b WHERE q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id)
  SELECT vec_id, neighbour, similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS r FROM s) WHERE r <= 10"""


def _key(value: str) -> str:
    """SQL of the compact key of a value, as ``canon.key_sql`` says it."""
    w = canon.Wording()
    s = f"lower(translate(regexp_replace({value}, '[\\p{{Cf}}\\p{{Mn}}]', '', 'g'), {_lit(canon._FROM)}, {_lit(canon._TO)}))"
    s = f"trim(regexp_replace({s}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
    for pattern, into in (
        (f"^({'|'.join(w.placeholders)})$", ""), (f"^({w.articles}) ", ""), (" (the|an|a)$", ""), (f"( ({w.counters}))? [\\p{{N}}]+$", ""), (f"^({w.obligations}) ", f"{w.modals[0]} "),
    ):
        s = f"regexp_replace({s}, '{pattern}', '{into}')"
    return f"replace({s}, ' ', '')"


_ANY_MODAL = "|".join(canon.MODALS)
P2 = f"""WITH {ENTITIES_SQL},
  raw AS (SELECT clause_id, pos, f.field, json_extract(e, '$.' || f.field) AS v FROM ent, (VALUES ('subject'), ('object'), ('relation')) f(field)),
  val AS (SELECT clause_id, pos, field, CASE WHEN field = 'relation' THEN 'relation' ELSE 'element' END AS kind, k - 1 AS item, CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') ELSE CAST(v AS VARCHAR) END AS value
    FROM (SELECT clause_id, pos, field, unnest(l) AS v, generate_subscripts(l, 1) AS k FROM (SELECT clause_id, pos, field, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE [v] END AS l FROM raw WHERE v IS NOT NULL)) WHERE json_type(v) <> 'NULL'),
  free AS (SELECT v.* FROM val v WHERE NOT EXISTS (SELECT 1 FROM canon_terms t WHERE t.kind = v.kind AND t.term = v.value)),
  spelt AS (SELECT term_id, kind, {_key('f')} AS f FROM (SELECT term_id, kind, unnest(list_concat([term, term_fa], coalesce(aliases, []))) AS f FROM canon_terms) WHERE f IS NOT NULL),
  forms AS (SELECT kind, f, min(term_id) AS term_id FROM (SELECT kind, term_id, unnest(CASE WHEN kind = 'element' AND regexp_matches(f, '^[a-z]+$') THEN [f, f || 's', f || 'es']
    WHEN regexp_matches(f, '^({_ANY_MODAL})') THEN list_transform([{', '.join(map(_lit, canon.MODALS))}], lambda x: x || regexp_replace(f, '^({_ANY_MODAL})', '')) ELSE [f] END) AS f FROM spelt WHERE f <> '') GROUP BY kind, f),
  keys AS (SELECT DISTINCT kind, value, {_key('value')} AS k FROM free),
  near AS (SELECT kind, k, term_id FROM (SELECT k.kind, k.k, f.term_id, row_number() OVER (PARTITION BY k.kind, k.k ORDER BY levenshtein(k.k, f.f), f.term_id) AS r FROM (SELECT DISTINCT kind, k FROM keys WHERE k <> '') k JOIN forms f ON k.kind = f.kind
    WHERE abs(length(k.k) - length(f.f)) <= 2 AND levenshtein(k.k, f.f) <= CASE WHEN length(f.f) < {canon.ONE_EDIT} THEN 0 WHEN length(f.f) < {canon.TWO_EDITS} THEN 1 ELSE 2 END) WHERE r = 1)
  SELECT free.clause_id, CAST(free.pos AS BIGINT) AS pos, free.field, CAST(free.item AS BIGINT) AS item, coalesce(n.term_id, 0) AS term_id FROM free JOIN keys k ON free.kind = k.kind AND free.value = k.value LEFT JOIN near n ON k.kind = n.kind AND k.k = n.k"""

SQL = {"p1_found": P1, "p2_found": P2, "p4_nearest": P4_NEAREST, "p6_found": P6, "p7_found": P7}
