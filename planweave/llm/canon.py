"""Freely typed values mapped to the entries of a reference list, in SQL only.

Values and reference forms are brought to a compact key (script forms folded,
articles, numbers and blanks taken out).  A form of length n may differ by k
edits (0 below 4 letters, 1 below 6, else 2); it is cut into k + 1 segments, of
which one survives k edits in a place shifted by at most k.  Distinct values
are joined on these positional substrings, verified with ``levenshtein``, and
those with no form are found by an anti-join.  Joins go by the sizes that are met:
one way whatever the length of the list.

Defined results: a null value has no row; a text that begins with a bracket
but is no JSON array is a value as it stands; a value equal to a term of its kind
has no row; placeholders and values with an empty key are unmatched (0); of
several nearest forms the least id is taken; an empty reference list leaves
everything unmatched; repeated values are matched once and joined back.
"""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

from pyspark.sql import DataFrame

from planweave.functions.shared import stored
from planweave.llm.consistent import expand
from planweave.operators.entities import entities

# Words before and after a value that do not change what it means, words for an obligation and verbs that stand for one another, values that stand for none.
ARTICLES = "a|an|the|any|each|every|it|this|that|some|all|one"
COUNTERS = "unit|no|nr|number|type"
OBLIGATIONS = "has to|have to|needs to|ought to"
MODALS = ["must", "shall", "should"]
PLACEHOLDERS = ["xx", "xxx", "tbd", "tba", "n a", "na", "none", "null", "nil", "unknown", "nan", "todo", "نامشخص"]
# Lengths from which a form may differ by one and by two edits.
ONE_EDIT, TWO_EDITS = 4, 6


class Wording(NamedTuple):
    """What the owner of a list says of wording that does not change what a value means; all of it may be empty.

    articles: words before a value; counters: words before a number at its end; obligations: spellings of the first of
    the modals; modals: words for an obligation that stand for one another; placeholders: values that stand for none;
    plurals: endings that element forms may have besides.
    """

    articles: str = ARTICLES
    counters: str = COUNTERS
    obligations: str = OBLIGATIONS
    modals: tuple[str, ...] = tuple(MODALS)
    placeholders: tuple[str, ...] = tuple(PLACEHOLDERS)
    plurals: tuple[str, ...] = ("s", "es")


#: No wording at all: what the join alone matches.
BARE = Wording("", "", "", (), (), ())


def _translations() -> tuple[str, str]:
    """Characters with a one-character folded form, and these forms, by rule from the Unicode tables."""
    source, target = [], []
    blocks = [range(0xC0, 0x250), range(0x370, 0x530), range(0x600, 0x700), range(0x750, 0x780), range(0xFB50, 0xFEFD), range(0xFF01, 0xFF5F)]
    for block in blocks:
        for cp in block:
            out = [c for c in expand(cp) if not unicodedata.combining(chr(c))]
            if len(out) == 1:
                c = unicodedata.normalize("NFKD", chr(out[0]))[0]
                if c.isdigit():
                    c = str(unicodedata.digit(c))
                if c != chr(cp):
                    source.append(chr(cp))
                    target.append(c)
    return "".join(source), "".join(target)


_FROM, _TO = _translations()


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def key_sql(value: str, wording: Wording = Wording()) -> str:
    """SQL of the compact key of a value, its braces doubled for formatted queries."""
    s = f"lower(translate(regexp_replace({value}, {_lit(r'[\p{Cf}\p{Mn}]')}, ''), {_lit(_FROM)}, {_lit(_TO)}))"
    s = f"trim(regexp_replace({s}, {_lit(r'[^\p{L}\p{N}]+')}, ' '))"
    if wording.placeholders:
        s = f"regexp_replace({s}, {_lit(f'^({"|".join(wording.placeholders)})$')}, '')"
    if wording.articles:
        s = f"regexp_replace({s}, {_lit(f'^({wording.articles}) ')}, '')"
        s = f"regexp_replace({s}, {_lit(' (the|an|a)$')}, '')"
    if wording.counters:
        s = f"regexp_replace({s}, {_lit(f'( ({wording.counters}))?' + r' \p{N}+$')}, '')"
    if wording.obligations and wording.modals:
        s = f"regexp_replace({s}, {_lit(f'^({wording.obligations}) ')}, {_lit(wording.modals[0] + ' ')})"
    return f"replace({s}, ' ', '')".replace("{", "{{").replace("}", "}}")


def _variants(wording: Wording) -> str:
    """SQL of the forms that stand for a form."""
    cases = []
    if wording.plurals:
        endings = "".join(f", concat(form, {_lit(e)})" for e in wording.plurals)
        cases.append(f"WHEN kind = 'element' AND form RLIKE '^[a-z]+$' THEN array(form{endings})")
    if wording.modals:
        any_ = "|".join(wording.modals)
        cases.append(f"WHEN form RLIKE '^({any_})' THEN transform(array({', '.join(map(_lit, wording.modals))}), x -> concat(x, regexp_replace(form, '^({any_})', '')))")
    return f"CASE {' '.join(cases)} ELSE array(form) END" if cases else "array(form)"


def mapped(values: DataFrame, terms: DataFrame, wording: Wording = Wording()) -> DataFrame:
    """(kind, value, term_id) of distinct values (kind, value); terms: (term_id, kind, term, term_fa, aliases)."""
    spark = values.sparkSession
    spellings = spark.sql(
        "SELECT term_id, kind, explode(concat(array(term, term_fa), coalesce(aliases, array()))) AS form FROM {terms}", terms=terms
    )
    keyed = spark.sql(f"SELECT term_id, kind, {key_sql('form', wording)} AS form FROM {{spellings}} WHERE form IS NOT NULL", spellings=spellings)
    forms = spark.sql(
        f"""SELECT kind, form, min(term_id) AS term_id FROM (
             SELECT kind, term_id, explode({_variants(wording)}) AS form FROM {{keyed}} WHERE form <> '') GROUP BY kind, form""",
        keyed=keyed,
    )
    # Stored, as they are read several times: the forms, the keys of the distinct values, the matches.
    forms = stored(forms, "forms")
    keys = stored(spark.sql(f"SELECT kind, value, {key_sql('value', wording)} AS k FROM {{values}}", values=values), "keys")
    # Segment i of a form of n letters starts at floor(i n / (k + 1)).
    pieces = spark.sql(
        f"""SELECT kind, form, term_id, n, edits, i, start, substring(form, start + 1, stop - start) AS piece FROM (
              SELECT *, CAST(floor(i * n / (edits + 1)) AS INT) AS start, CAST(floor((i + 1) * n / (edits + 1)) AS INT) AS stop FROM (
                SELECT *, explode(sequence(0, edits)) AS i FROM (
                  SELECT *, length(form) AS n, CASE WHEN length(form) < {ONE_EDIT} THEN 0 WHEN length(form) < {TWO_EDITS} THEN 1 ELSE 2 END AS edits FROM {{forms}})))""",
        forms=forms,
    )
    # A value's substrings at each place where a segment of a form of n letters can stand.  There are three places at
    # most for each length of forms, whatever their number, so these are broadcast.
    places = spark.sql("SELECT DISTINCT kind, n, edits, i, start, length(piece) AS size FROM {pieces}", pieces=pieces)
    cut = spark.sql(
        """SELECT /*+ BROADCAST(f) */ v.kind, v.k, f.n, f.i, substring(v.k, f.start + shift + 1, f.size) AS piece FROM (
              SELECT kind, k, m, m + more AS n, explode(sequence(-2, 2)) AS shift FROM (
                SELECT kind, k, length(k) AS m, explode(sequence(-2, 2)) AS more FROM (SELECT DISTINCT kind, k FROM {keys} WHERE k <> ''))) v
            JOIN {places} f ON v.kind = f.kind AND v.n = f.n
            WHERE abs(v.m - f.n) <= f.edits AND abs(v.shift) <= f.edits AND f.start + v.shift >= 0 AND f.start + v.shift + f.size <= v.m""",
        keys=keys, places=places,
    )
    near = stored(spark.sql(
        """SELECT kind, k, min_by(term_id, struct(d, term_id)) AS term_id FROM (
              SELECT DISTINCT c.kind, c.k, f.term_id, f.edits, levenshtein(c.k, f.form) AS d FROM {cut} c
              JOIN {pieces} f ON c.kind = f.kind AND c.n = f.n AND c.i = f.i AND c.piece = f.piece)
            WHERE d <= edits GROUP BY kind, k""",
        cut=cut, pieces=pieces,
    ), "near")
    return spark.sql(
        """SELECT v.kind, v.value, n.term_id FROM {keys} v JOIN {near} n ON v.kind = n.kind AND v.k = n.k
           UNION ALL
           SELECT v.kind, v.value, CAST(0 AS BIGINT) FROM {keys} v ANTI JOIN {near} n ON v.kind = n.kind AND v.k = n.k""",
        keys=keys, near=near,
    )


def entity_values(clauses: DataFrame) -> DataFrame:
    """(clause_id, pos, field, item, kind, value) of each non-null subject, object and relation value."""
    spark = clauses.sparkSession
    members = entities(clauses).where("is_object")
    return spark.sql(
        """SELECT clause_id, CAST(pos AS BIGINT) AS pos, field, CAST(item AS BIGINT) AS item, CASE WHEN field = 'relation' THEN 'relation' ELSE 'element' END AS kind, value FROM (
             SELECT clause_id, pos, field, posexplode(coalesce(CASE WHEN raw LIKE '[%]' THEN from_json(concat('{{"a":', raw, '}}'), 'a array<string>').a END, array(raw))) AS (item, value) FROM (
               SELECT clause_id, pos, stack(3, 'subject', e.subject, 'object', e.object, 'relation', e.relation) AS (field, raw) FROM (
                 SELECT clause_id, pos, from_json(entity, 'subject string, object string, relation string') AS e FROM {members}))
             WHERE raw IS NOT NULL)
           WHERE value IS NOT NULL""",
        members=members,
    )


def canonical_entities(clauses: DataFrame, terms: DataFrame, wording: Wording = Wording()) -> DataFrame:
    """(clause_id, pos, field, item, term_id) of values not written exactly as a term; 0: the list has none."""
    spark = clauses.sparkSession
    terms = spark.sql("SELECT CAST(term_id AS BIGINT) AS term_id, kind, term, term_fa, aliases FROM {terms}", terms=terms)
    rows = entity_values(clauses)
    free = spark.sql("SELECT r.* FROM {rows} r ANTI JOIN {terms} t ON r.kind = t.kind AND r.value = t.term", rows=rows, terms=terms)
    values = spark.sql("SELECT DISTINCT kind, value FROM {free}", free=free)
    found = mapped(values, terms, wording)
    return spark.sql(
        "SELECT r.clause_id, r.pos, r.field, r.item, coalesce(m.term_id, CAST(0 AS BIGINT)) AS term_id FROM {free} r LEFT JOIN {found} m ON r.kind = m.kind AND r.value = m.value",
        free=free, found=found,
    )
