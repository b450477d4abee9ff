"""DuckDB twins of the fixtures in ``plans/fixtures.py`` (oracle side)."""

from __future__ import annotations

import re

DUCK_FIXTURES = {
    "fx_samples": "SELECT doc_id AS idx, text AS input, source AS label, lang AS category FROM documents",
    "fx_samples_null": """SELECT doc_id AS idx, text AS input, source AS label,
 CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS category FROM documents""",
    "fx_labelled": """SELECT d.doc_id AS idx, d.text AS input, concat(d.lang, '-', cast(l.quality AS VARCHAR)) AS label,
 d.lang AS category FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "fx_samples_multi": """SELECT l_orderkey AS idx, concat('order ', cast(l_orderkey % 97 AS VARCHAR)) AS input,
 max(l_returnflag) AS label, list_sort(list(DISTINCT p_brand)) AS category
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""",
    "fx_predictions": """SELECT doc_id AS idx, lang AS task,
 array_to_string(regexp_split_to_array(trim(text), '\\s+')[1:12], ' ') AS expected,
 CASE WHEN doc_id % 4 = 0 THEN array_to_string(regexp_split_to_array(trim(text), '\\s+')[1:12], ' ')
      WHEN doc_id % 4 = 1 THEN translate(array_to_string(regexp_split_to_array(trim(text), '\\s+')[1:12], ' '),
           'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
      WHEN doc_id % 4 = 2 THEN array_to_string(regexp_split_to_array(trim(text), '\\s+')[4:15], ' ')
      ELSE 'mock text' END AS predicted
FROM documents""",
    "fx_nli": """SELECT doc_id AS idx, text AS premise, CASE WHEN lang = 'de' THEN '' ELSE lang END AS logic,
 CASE WHEN doc_id % 2 = 0 THEN 'not_entailment' ELSE 'entailment' END AS label FROM documents""",
    "fx_choices": """SELECT a.conv_id, a.turn, a.text AS premise, b.text AS choice1, c.text AS choice2
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn + 2""",
    "fx_facts": """SELECT concat('f', cast(p_partkey AS VARCHAR)) AS uid,
 concat_ws(' ', p_name, p_brand, p_type) AS fact FROM part""",
    "fx_questions": """SELECT l_orderkey AS question_id,
 string_agg(concat('f', cast(l_partkey AS VARCHAR), '|CENTRAL'), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS explanation,
 CASE WHEN l_orderkey % 2 = 0 THEN 'Easy' ELSE 'Challenge' END AS arcset,
 concat('Which one? (A) ', cast(min(l_partkey) AS VARCHAR), ' parts (B) ', cast(max(l_partkey) AS VARCHAR),
   ' parts (C) none') AS question,
 substr('ABC', cast(l_orderkey % 3 AS INT) + 1, 1) AS answer_key
FROM lineitem GROUP BY l_orderkey""",
    "fx_answers": """SELECT l_orderkey AS qid, list({
 'number': CASE WHEN l_linenumber % 3 = 0 THEN cast(cast(trunc(l_quantity) AS INT) AS VARCHAR) ELSE '' END,
 'date': {'day': CASE WHEN l_linenumber % 3 = 1 THEN cast(day(l_shipdate) AS VARCHAR) ELSE '' END,
   'month': CASE WHEN l_linenumber % 3 = 1 THEN cast(month(l_shipdate) AS VARCHAR) ELSE '' END,
   'year': CASE WHEN l_linenumber % 3 = 1 THEN cast(year(l_shipdate) AS VARCHAR) ELSE '' END},
 'spans': CASE WHEN l_linenumber % 3 = 2 THEN [l_returnflag, l_linestatus] ELSE cast([] AS VARCHAR[]) END}
 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_returnflag, l_linestatus) AS answers
FROM lineitem GROUP BY l_orderkey""",
    "fx_concepts": """SELECT user_id, cast(cast(ts AS DATE) AS VARCHAR) AS day,
 list(event_type ORDER BY ts, event_id) AS program_modules
FROM events GROUP BY user_id, cast(ts AS DATE)""",
    "fx_results": """SELECT event_id, concat('model-', event_type) AS model, concat('d', cast(user_id % 4 AS VARCHAR)) AS dataset,
 concat('p', cast(event_id % 5 AS VARCHAR)) AS prompt,
 cast((event_id * 37) % 129 AS DOUBLE) / 128 AS random_demos,
 cast((event_id * 53 + user_id) % 129 AS DOUBLE) / 128 AS informative_demos
FROM events""",
}

_FX = re.compile(r"\bfx_[a-z_]+\b")


def with_fixtures(sql: str) -> str:
    """Prefix ``sql`` with CTEs for every fixture it names.

    A query that starts with its own ``WITH`` gets the fixture CTEs merged
    into the same clause.
    """
    names = [n for n in DUCK_FIXTURES if re.search(rf"\b{n}\b", sql)]
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({DUCK_FIXTURES[n]})" for n in names)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
