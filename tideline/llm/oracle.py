"""SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from tideline.llm.licence_texts import OPENING, SPELLINGS
from tideline.llm.licences import all_licences


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    """SQL for the normalised form of a text: lines of copyright and titles left out, then letters and digits."""
    mark = r"^[^\pL\pN]*"
    holder = rf"{mark}(copyright[^\pL\pN]*(\(c\)|©|<year>|\[?yyyy|(19|20)\d\d|by )|\(c\)[^\pL\pN]*(copyright|(19|20)\d\d)|©)"
    dated = rf"regexp_matches(l, '{mark}copyright .*\b(19|20)\d\d\b') AND NOT regexp_matches(l, '{mark}copyright treaty')"
    names = "mit|expat|isc|zlib|zlib/libpng|(new |modified |simplified )?bsd|bsd[- ][23][- ]clause"
    title = (
        rf"{mark}(the )?({names})([^\pL\pN]*(new|revised|simplified|or))*[^\pL\pN]*licen[cs]e"
        r"([^\pL\pN]*(mit|isc|zlib|bsd[- ][23][- ]clause))?[^\pL\pN]*$"
    )
    reserved = rf"{mark}all rights reserved[^\pL\pN]*$"
    out = f"regexp_matches(l, '{holder}|{reserved}|{title}') OR ({dated})"
    lines = f"array_to_string(list_filter(string_split(lower({text}), chr(10)), lambda l: NOT ({out})), ' ')"
    plain = f"' ' || regexp_replace({lines}, '[^\\pL\\pN]+', ' ', 'g') || ' '"
    for found, one in SPELLINGS:
        plain = f"replace({plain}, ' {found} ', ' {one} ')"
    return f"trim(regexp_replace({plain}, ' +', ' ', 'g'))"


def _key(plain: str) -> str:
    """SQL for the digest that is looked up."""
    return f"md5(regexp_replace({plain}, '{OPENING}', 'licensed under '))"


_KNOWN = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in all_licences())

_LICENCES = f"""
WITH known AS (
    SELECT {_key("c")} AS digest, min(l) AS licence FROM (SELECT l, {_canonical("t")} AS c FROM (VALUES {_KNOWN}) AS v(l, t)) GROUP BY 1
), lines AS (
    SELECT doc_id, {_key("c")} AS digest
    FROM (SELECT doc_id, {_canonical("line")} AS c
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
    WHERE c <> ''
), notices AS (
    SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS notice_lines
    FROM lines JOIN known USING (digest) GROUP BY doc_id
), wholes AS (
    SELECT doc_id, c, {_key("c")} AS digest FROM (SELECT doc_id, {_canonical("text")} AS c FROM documents)
)
SELECT w.doc_id, md5(w.c) AS digest, CASE WHEN w.c <> '' THEN k.licence END AS licence,
       coalesce(n.notices, '') AS notices, coalesce(n.notice_lines, 0) AS notice_lines
FROM wholes w LEFT JOIN known k USING (digest) LEFT JOIN notices n ON n.doc_id = w.doc_id
"""

_HARD_NEGATIVES = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS alike, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
    FROM vectors a JOIN vectors v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM scores WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.alike
 AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

LLM_ORACLE: dict[str, str] = {"op5_licences": _LICENCES, "op11_hard_negatives": _HARD_NEGATIVES}
