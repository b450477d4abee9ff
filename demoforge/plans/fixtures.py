"""Stand-in inputs built from the driver tables (Spark side).

Each fixture is a Spark SQL text over the driver tables, passed as DataFrame
parameters so the optimizer sees one plan.  The DuckDB twins live in
``plans/oracle.py``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from demoforge.session import read_table

SPARK_FIXTURES = {
    "fx_samples": """
SELECT doc_id AS idx, text AS input, source AS label, lang AS category FROM {documents}
""",
    "fx_samples_null": """
SELECT doc_id AS idx, text AS input, source AS label,
 CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS category FROM {documents}
""",
    "fx_labelled": """
SELECT d.doc_id AS idx, d.text AS input, concat(d.lang, '-', cast(l.quality AS STRING)) AS label,
 d.lang AS category FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
""",
    "fx_samples_multi": """
SELECT l_orderkey AS idx, concat('order ', cast(l_orderkey % 97 AS STRING)) AS input,
 max(l_returnflag) AS label, sort_array(collect_set(p_brand)) AS category
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_orderkey
""",
    "fx_predictions": """
SELECT doc_id AS idx, lang AS task,
 array_join(slice(split(trim(text), '\\\\s+'), 1, 12), ' ') AS expected,
 CASE WHEN doc_id % 4 = 0 THEN array_join(slice(split(trim(text), '\\\\s+'), 1, 12), ' ')
      WHEN doc_id % 4 = 1 THEN translate(array_join(slice(split(trim(text), '\\\\s+'), 1, 12), ' '),
           'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
      WHEN doc_id % 4 = 2 THEN array_join(slice(split(trim(text), '\\\\s+'), 4, 12), ' ')
      ELSE 'mock text' END AS predicted
FROM {documents}
""",
    "fx_nli": """
SELECT doc_id AS idx, text AS premise, CASE WHEN lang = 'de' THEN '' ELSE lang END AS logic,
 CASE WHEN doc_id % 2 = 0 THEN 'not_entailment' ELSE 'entailment' END AS label FROM {documents}
""",
    "fx_choices": """
SELECT a.conv_id, a.turn, a.text AS premise, b.text AS choice1, c.text AS choice2
FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
JOIN {conversations} c ON a.conv_id = c.conv_id AND c.turn = a.turn + 2
""",
    "fx_facts": """
SELECT concat('f', cast(p_partkey AS STRING)) AS uid, concat_ws(' ', p_name, p_brand, p_type) AS fact FROM {part}
""",
    "fx_questions": """
SELECT l_orderkey AS question_id,
 array_join(transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_suppkey))),
   x -> concat('f', cast(x.l_partkey AS STRING), '|CENTRAL')), ' ') AS explanation,
 CASE WHEN l_orderkey % 2 = 0 THEN 'Easy' ELSE 'Challenge' END AS arcset,
 concat('Which one? (A) ', cast(min(l_partkey) AS STRING), ' parts (B) ', cast(max(l_partkey) AS STRING),
   ' parts (C) none') AS question,
 substr('ABC', cast(l_orderkey % 3 AS INT) + 1, 1) AS answer_key
FROM {lineitem} GROUP BY l_orderkey
""",
    "fx_answers": """
SELECT l_orderkey AS qid, transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_suppkey,
  l_quantity, l_shipdate, l_returnflag, l_linestatus))), x -> named_struct(
 'number', CASE WHEN x.l_linenumber % 3 = 0 THEN cast(cast(x.l_quantity AS INT) AS STRING) ELSE '' END,
 'date', named_struct('day', CASE WHEN x.l_linenumber % 3 = 1 THEN cast(day(x.l_shipdate) AS STRING) ELSE '' END,
   'month', CASE WHEN x.l_linenumber % 3 = 1 THEN cast(month(x.l_shipdate) AS STRING) ELSE '' END,
   'year', CASE WHEN x.l_linenumber % 3 = 1 THEN cast(year(x.l_shipdate) AS STRING) ELSE '' END),
 'spans', CASE WHEN x.l_linenumber % 3 = 2 THEN array(x.l_returnflag, x.l_linestatus)
               ELSE cast(array() AS ARRAY<STRING>) END)) AS answers
FROM {lineitem} GROUP BY l_orderkey
""",
    "fx_concepts": """
SELECT user_id, cast(to_date(ts) AS STRING) AS day,
 transform(array_sort(collect_list(struct(ts, event_id, event_type))), x -> x.event_type) AS program_modules
FROM {events} GROUP BY user_id, to_date(ts)
""",
    "fx_results": """
SELECT event_id, concat('model-', event_type) AS model, concat('d', cast(user_id % 4 AS STRING)) AS dataset,
 concat('p', cast(event_id % 5 AS STRING)) AS prompt,
 cast((event_id * 37) % 129 AS DOUBLE) / 128 AS random_demos,
 cast((event_id * 53 + user_id) % 129 AS DOUBLE) / 128 AS informative_demos
FROM {events}
""",
}

_TABLE_REF = re.compile(r"\{(\w+)\}")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SPARK_FIXTURES[name]
    tables = {t: read_table(spark, sf_dir, t) for t in set(_TABLE_REF.findall(sql))}
    return spark.sql(sql, **tables)
