"""DuckDB oracle SQL per named query (same column names as the Spark side)."""

from __future__ import annotations

from demoforge.plans.oracle_fixtures import with_fixtures

# Demo choice as a plain join: every distinct tuple (latest position first)
# whose input differs from the sample's and that passes the criterion.
_DEMO_PAIRS = """
t AS (SELECT input, label, category, max(idx) AS last FROM {src} GROUP BY input, label, category),
pairs AS (
  SELECT s.idx, t.label, t.last,
         row_number() OVER (PARTITION BY s.idx ORDER BY t.last DESC) AS rn
  FROM {src} s JOIN t ON t.input <> s.input {cond})
"""


def demo_pairs(src: str, strategy: str) -> str:
    cond = "AND s.category IS NOT DISTINCT FROM t.category" if strategy == "cluster-random" else ""
    return _DEMO_PAIRS.format(src=src, cond=cond)


def _demos_sql(src: str, strategy: str) -> str:
    return f"""WITH {demo_pairs(src, strategy)}
SELECT idx, string_agg(cast(last AS VARCHAR), ' ' ORDER BY rn) AS demo_idxs
FROM pairs WHERE rn <= 3 GROUP BY idx HAVING count(*) = 3"""


ORACLE: dict[str, str] = {}

ORACLE["strategy_gap"] = """
WITH s AS (SELECT * FROM fx_labelled),
t AS (SELECT input, label, category, max(idx) AS last FROM s GROUP BY input, label, category),
pi AS (SELECT s.idx, t.label, t.last, row_number() OVER (PARTITION BY s.idx ORDER BY t.last DESC) AS rn
       FROM s JOIN t ON t.input <> s.input AND s.category IS NOT DISTINCT FROM t.category),
kept AS (SELECT idx FROM pi WHERE rn <= 3 GROUP BY idx HAVING count(*) = 3),
pr AS (SELECT s.idx, t.label, t.last, row_number() OVER (PARTITION BY s.idx ORDER BY t.last DESC) AS rn
       FROM s JOIN kept USING (idx) JOIN t ON t.input <> s.input),
keptr AS (SELECT idx FROM pr WHERE rn <= 3 GROUP BY idx HAVING count(*) = 3),
vi AS (SELECT idx, label, count(*) AS c, max(last) AS m FROM pi WHERE rn <= 3 GROUP BY idx, label),
vr AS (SELECT idx, label, count(*) AS c, max(last) AS m FROM pr WHERE rn <= 3 GROUP BY idx, label),
mi AS (SELECT idx, arg_max(label, c * 1000000000000 + m) AS pred FROM vi GROUP BY idx),
mr AS (SELECT idx, arg_max(label, c * 1000000000000 + m) AS pred FROM vr GROUP BY idx),
j AS (SELECT s.idx, s.label, mi.pred AS pi, mr.pred AS pr FROM s JOIN kept USING (idx) JOIN keptr USING (idx)
      JOIN mi USING (idx) JOIN mr USING (idx))
SELECT 'demo_majority' AS model, count(*) AS n_samples,
 round(avg(CASE WHEN pr IS NOT DISTINCT FROM label THEN 1.0 ELSE 0.0 END), 6) AS random_demos,
 round(avg(CASE WHEN pi IS NOT DISTINCT FROM label THEN 1.0 ELSE 0.0 END), 6) AS informative_demos,
 round(avg(CASE WHEN pi IS NOT DISTINCT FROM label THEN 1.0 ELSE 0.0 END)
     - avg(CASE WHEN pr IS NOT DISTINCT FROM label THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS difference
FROM j
"""

ORACLE["demos_random"] = _demos_sql("fx_samples", "random")
ORACLE["demos_category"] = _demos_sql("fx_samples", "cluster-random")
ORACLE["demos_null_category"] = _demos_sql("fx_samples_null", "cluster-random")
ORACLE["demos_overlap"] = """
WITH t AS (SELECT input, label, category, max(idx) AS last FROM fx_samples_multi GROUP BY input, label, category),
pairs AS (
  SELECT s.idx, t.last, row_number() OVER (PARTITION BY s.idx ORDER BY t.last DESC) AS rn
  FROM fx_samples_multi s JOIN t ON t.input <> s.input AND len(list_intersect(s.category, t.category)) > 0)
SELECT idx, string_agg(cast(last AS VARCHAR), ' ' ORDER BY rn) AS demo_idxs
FROM pairs WHERE rn <= 3 GROUP BY idx HAVING count(*) = 3"""


def oracle_sql() -> dict[str, str]:
    return {k: with_fixtures(v) for k, v in ORACLE.items()}

PY_WS = r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WORDS = "list_filter(regexp_split_to_array(@X@, '" + PY_WS + "+'), lambda w: w <> '')"


def words(x: str) -> str:
    return _WORDS.replace("@X@", x)


def _fewshot_sql(src: str) -> str:
    return f"""WITH {demo_pairs(src, 'cluster-random')},
pr AS (
  SELECT p.idx, string_agg(concat('Input: ', s2.input, ' Prediction: ', p.label), '\n' ORDER BY p.rn) AS body
  FROM pairs p JOIN {src} s2 ON s2.idx = p.last WHERE p.rn <= 3 GROUP BY p.idx HAVING count(*) = 3)
SELECT pr.idx, concat(pr.body, '\nInput: ', s.input, ' Prediction:') AS prompt FROM pr JOIN {src} s USING (idx)"""


ORACLE["first_n"] = "SELECT idx, label FROM fx_samples ORDER BY idx LIMIT 50"
ORACLE["max_chars"] = "SELECT idx, length(input) AS n_chars FROM fx_samples WHERE length(input) < 2000"
ORACLE["max_words"] = f"""WITH f AS ({_fewshot_sql('fx_samples')})
SELECT idx, len({words('prompt')}) AS n_words FROM f WHERE len({words('prompt')}) <= 2000"""
ORACLE["filter_questions"] = "SELECT question_id FROM fx_questions WHERE explanation IS NOT NULL AND arcset = 'Easy'"
_FLAT = """array_to_string(list_transform(answers, lambda a: CASE WHEN coalesce(a.number, '') <> '' THEN a.number
  WHEN a.date IS NOT NULL AND {test} THEN concat_ws(' ', a.date.day, a.date.month, a.date.year)
  ELSE array_to_string(coalesce(a.spans, []), ' ') END), ' ')"""
FLAT_AS_WRITTEN = _FLAT.format(test="concat_ws(' ', a.date.day, a.date.month, a.date.year) <> ''")
FLAT_SKIP = _FLAT.format(test="trim(concat_ws(' ', a.date.day, a.date.month, a.date.year)) <> ''")
ORACLE["non_blank_answers"] = f"""SELECT qid, answer FROM (SELECT qid, {FLAT_AS_WRITTEN} AS answer FROM fx_answers)
WHERE answer IS NOT NULL AND trim(answer) <> ''"""
ORACLE["select_tasks"] = """SELECT t.task_id, min(p.p_name) AS p_name
FROM part p JOIN (VALUES ('ring'), ('blue'), ('zzz')) t(task_id) ON strpos(p.p_name, t.task_id) > 0
GROUP BY t.task_id"""
ORACLE["name_filter"] = "SELECT event_id, model, dataset FROM fx_results WHERE strpos(model, 'click') > 0 AND dataset = 'd1'"
ORACLE["wh_category"] = f"""SELECT idx, CASE WHEN starts_with(input, 'To') THEN array_to_string({words('input')}[1:2], ' ')
 ELSE {words('input')}[1] END AS category FROM fx_samples"""
ORACLE["first_token"] = f"SELECT idx, {words('input')}[1] AS token, lower({words('input')}[1]) AS token_lower FROM fx_samples"
_PREM = f"list_distinct({words('lower(premise)')})"
ORACLE["overlap_bucket"] = f"""SELECT conv_id, turn, CASE WHEN len({_PREM}) > 0 THEN cast(floor(greatest(
  len(list_intersect(list_distinct({words('lower(choice1)')}), {_PREM})) / len({_PREM}),
  len(list_intersect(list_distinct({words('lower(choice2)')}), {_PREM})) / len({_PREM})) * 10) / 10 AS DOUBLE)::VARCHAR END AS bucket
FROM fx_choices"""
ORACLE["bag_key"] = f"SELECT idx, concat(logic, array_to_string(list_sort({words('premise')}), ' ')) AS bag_key FROM fx_nli"
_IDS = """list_filter(list_transform(string_split(explanation, '|'), lambda p: """ + words("p") + """[-1]),
  lambda x: x IS NOT NULL AND x <> '' AND NOT (x = upper(x) AND x <> lower(x)))"""
ORACLE["parse_fact_ids"] = f"SELECT question_id, array_to_string({_IDS}, ' ') AS fact_ids FROM fx_questions"
ORACLE["answer_by_key"] = """SELECT question_id, CASE WHEN strpos(question, concat(' (', answer_key, ') ')) > 0 THEN
 regexp_replace(split_part(split_part(question, concat(' (', answer_key, ') '), 2),
   CASE answer_key WHEN 'A' THEN '(B)' WHEN 'B' THEN '(C)' WHEN 'C' THEN '(D)' WHEN 'D' THEN '(E)' WHEN 'E' THEN '(XX)'
   WHEN 'XX' THEN '(0)' WHEN '0' THEN '(1)' WHEN '1' THEN '(2)' WHEN '2' THEN '(3)' WHEN '3' THEN '(4)'
   WHEN '4' THEN '(5)' WHEN '5' THEN '(XX)' END, 1), '^""" + PY_WS + "+|" + PY_WS + """+$', '', 'g') END AS answer
FROM fx_questions"""
ORACLE["rewrite_text"] = """SELECT idx, replace(input, ' -> ', '. ') AS context,
 replace(replace(concat('Context: ', input), chr(10) || 'Answer', '? Yes, or No? ' || chr(10) || 'Answer'), chr(10), ' ') AS yesno
FROM fx_samples"""
ORACLE["flatten_answer"] = f"SELECT qid, {FLAT_AS_WRITTEN} AS answer FROM fx_answers"
ORACLE["flatten_answer_skip"] = f"SELECT qid, {FLAT_SKIP} AS answer FROM fx_answers"
ORACLE["concept_string"] = "SELECT user_id, day, array_to_string(program_modules, ' ') AS concept FROM fx_concepts"
REASONING = """l1 AS (
  SELECT l_orderkey, l_linestatus,
   list([[cast(l_linenumber AS VARCHAR)], CASE WHEN l_linenumber % 4 = 0 THEN [l_returnflag]
        ELSE [l_returnflag, l_linestatus, cast(l_partkey AS VARCHAR)] END]
     ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS expl
  FROM lineitem GROUP BY l_orderkey, l_linestatus),
fx_reasoning AS (SELECT l_orderkey AS idx, list(expl ORDER BY l_linestatus) AS reasoning FROM l1 GROUP BY l_orderkey)"""
TAILS = "list_transform(flatten(reasoning), lambda r: array_to_string(r[-1][-2:], ' '))"
ORACLE["relation_tails"] = f"WITH {REASONING} SELECT idx, array_to_string({TAILS}, '|') AS tails FROM fx_reasoning"
ORACLE["first_answer"] = "SELECT idx, category[1] AS answer FROM fx_samples_multi"
ORACLE["label_code"] = "SELECT idx, CASE WHEN strpos(label, 'not') > 0 THEN 0 ELSE 1 END AS code FROM fx_nli"
ORACLE["default_category"] = """SELECT idx, coalesce(category, 'None') AS cat_none, coalesce(category, '') AS cat_blank,
 category IS NULL AS is_null FROM fx_samples_null"""
ORACLE["qa_prompt"] = "SELECT idx, concat('Question: ', category, ' Context: ', input, ' Answer:') AS prompt FROM fx_samples"
ORACLE["fewshot_prompt"] = _fewshot_sql("fx_samples")
ORACLE["render_templates"] = """
SELECT idx, 'gpt3' AS template, concat(premise, chr(10) || 'Question: ', logic, ' True, False or Neither?') AS input,
 CASE WHEN label = 'entailment' THEN 'True' ELSE 'False' END AS label FROM fx_nli
UNION ALL
SELECT idx, 'plain' AS template, premise AS input, label FROM fx_nli WHERE logic <> ''"""
ORACLE["cut_at_marker"] = f"""WITH f AS ({_fewshot_sql('fx_samples')})
SELECT idx, CASE WHEN idx % 2 = 0 THEN 'davinci' ELSE 'text-davinci-003' END AS model,
 CASE WHEN idx % 2 = 0 THEN split_part(prompt, 'Input', 1) ELSE prompt END AS cut FROM f"""
ORACLE["run_key"] = """SELECT page_id, concat_ws('-', string_split(url, '/')[-1], string_split(concat('tasks/', url), '/')[-1],
 'cluster-random') AS run_key FROM pages"""
ORACLE["mark_seen"] = """WITH a AS (SELECT event_id, dataset, CASE WHEN dataset IN ('d1', 'd2') AND strpos(model, 'click') > 0
   THEN concat('$^*$', model) ELSE model END AS m FROM fx_results),
b AS (SELECT event_id, dataset, CASE WHEN dataset IN ('d1', 'd2') AND strpos(m, 'ick') > 0 THEN concat('$^*$', m) ELSE m END AS m FROM a)
SELECT event_id, CASE WHEN dataset IN ('d1', 'd2') AND strpos(m, 'view') > 0 THEN concat('$^*$', m) ELSE m END AS model FROM b"""

# ---- metrics -------------------------------------------------------------------


def _f1(expected_set: str, pred_words: str) -> str:
    tp = f"len(list_filter({pred_words}, lambda w: list_contains({expected_set}, w)))"
    fp = f"(len({pred_words}) - {tp})"
    fn = f"len(list_filter({expected_set}, lambda e: NOT list_contains({pred_words}, e)))"
    den = f"({tp} + 0.5 * ({fp} + {fn}))"
    return f"CASE WHEN {den} > 0 THEN {tp} / {den} END"


CHAR_F1 = _f1(
    "list_distinct(list_filter(string_split(lower(expected), ''), lambda ch: ch <> '' AND NOT regexp_matches(ch, '^"
    + PY_WS + "$')))",
    words("lower(predicted)"),
)
TOKEN_F1 = _f1(f"list_distinct({words('lower(expected)')})", words("lower(predicted)"))
_ET = "regexp_extract_all(lower(expected), '[a-z0-9]+')"
_PT = "regexp_extract_all(lower(predicted), '[a-z0-9]+')"
_FULL = f"((1::BIGINT << len({_ET})) - 1)"
_MASKS = (f"list_transform({_PT}, lambda w: coalesce(list_sum(list_transform(range(len({_ET})), "
          f"lambda i: CASE WHEN {_ET}[i + 1] = w THEN (1::BIGINT << i) ELSE 0::BIGINT END)), 0::BIGINT))")
_V = (f"list_reduce(list_prepend({_FULL}, {_MASKS}), "
      f"lambda v, mk: ((v + (v & mk)) | (v & ~mk)) & {_FULL})")
_LCS = f"(len({_ET}) - bit_count({_V}))"
ROUGE = (f"CASE WHEN len({_ET}) = 0 OR len({_PT}) = 0 OR {_LCS} = 0 THEN 0.0 "
         f"ELSE 2.0 * {_LCS} / (len({_ET}) + len({_PT})) END")
EXACT = "CASE WHEN expected IS NOT DISTINCT FROM predicted THEN 1.0 ELSE 0.0 END"
FOLDED = "CASE WHEN lower(expected) IS NOT DISTINCT FROM lower(predicted) THEN 1.0 ELSE 0.0 END"

ORACLE["accuracy_folded"] = f"SELECT task, count(*) AS n, round(avg({FOLDED}), 6) AS score FROM fx_predictions GROUP BY task"
ORACLE["accuracy_exact"] = f"SELECT task, count(*) AS n, round(avg({EXACT}), 6) AS score FROM fx_predictions GROUP BY task"
ORACLE["char_f1"] = f"SELECT idx, round({CHAR_F1}, 6) AS score FROM fx_predictions"
ORACLE["token_f1"] = f"SELECT idx, round({TOKEN_F1}, 6) AS score FROM fx_predictions"
ORACLE["rouge_l"] = f"SELECT idx, round({ROUGE}, 6) AS score FROM fx_predictions"


def draw_sql(parts: str, n: str) -> str:
    return f"(cast(concat('0x', substr(md5(concat_ws('|', {parts})), 1, 12)) AS BIGINT) % {n})"


ORACLE["bootstrap_scores"] = f"""
WITH sc AS (SELECT idx, {ROUGE} AS score FROM fx_predictions),
pos AS (SELECT score, row_number() OVER (ORDER BY idx) - 1 AS pos FROM sc),
nn AS (SELECT count(*) AS n FROM sc),
picks AS (SELECT r // 100 AS round_id, r % 100 AS j FROM range(20000) t(r)),
pp AS (SELECT round_id, {draw_sql("'0', '', round_id, j", 'nn.n')} AS pos FROM picks, nn)
SELECT round_id, round(sum(score) / 100, 6) AS score FROM pp JOIN pos USING (pos) GROUP BY round_id"""
ORACLE["score_tasks"] = f"""SELECT task, count(*) AS n, round(avg({EXACT}), 6) AS accuracy_exact,
 round(avg({FOLDED}), 6) AS accuracy_folded, round(avg({CHAR_F1}), 6) AS char_f1, round(avg({TOKEN_F1}), 6) AS token_f1,
 round(avg({ROUGE}), 6) AS rouge_l FROM fx_predictions GROUP BY task"""

MEANS = """SELECT model, dataset, prompt, round(avg(random_demos), 6) AS random_demos,
 round(avg(informative_demos), 6) AS informative_demos, round(avg(informative_demos - random_demos), 6) AS difference
FROM fx_results GROUP BY model, dataset, prompt"""
ORACLE["mean_scores"] = MEANS
BEST = """SELECT model, dataset, prompt, round(mean, 6) AS informative_demos FROM (
 SELECT *, row_number() OVER (PARTITION BY model, dataset ORDER BY mean DESC, prompt) AS rn
 FROM (SELECT model, dataset, prompt, avg(informative_demos) AS mean FROM fx_results GROUP BY ALL)
 WHERE mean IS NOT NULL) WHERE rn = 1"""
ORACLE["best_prompt"] = BEST
ORACLE["best_prompt_rows"] = f"SELECT event_id FROM fx_results r SEMI JOIN ({BEST}) b USING (model, dataset, prompt)"
CONCEPT = "array_to_string(program_modules, ' ')"
ORACLE["value_counts"] = f"SELECT {CONCEPT} AS concept, count(*) AS n FROM fx_concepts GROUP BY 1"
ORACLE["distinct_concepts"] = f"SELECT DISTINCT {CONCEPT} AS concept FROM fx_concepts"
ORACLE["category_index"] = """SELECT idx, category, row_number() OVER (PARTITION BY category ORDER BY idx) - 1 AS cat_pos,
 count(*) OVER (PARTITION BY category) AS cat_size FROM fx_samples"""
ORACLE["retained_share"] = """SELECT count(*) AS n_before, count(*) FILTER (WHERE length(input) < 1000) AS n_kept,
 round(avg(CASE WHEN length(input) < 1000 THEN 1.0 ELSE 0.0 END), 6) AS share FROM fx_samples"""
ORACLE["skip_report"] = f"""WITH f AS ({_fewshot_sql('fx_samples')})
SELECT count(*) AS n_total, count(*) FILTER (WHERE f.idx IS NULL) AS n_few_demos,
 count(*) FILTER (WHERE f.idx IS NOT NULL AND len({words('f.prompt')}) > 1500) AS n_too_long,
 count(*) FILTER (WHERE f.idx IS NOT NULL AND len({words('f.prompt')}) <= 1500) AS n_kept
FROM fx_samples s LEFT JOIN f USING (idx)"""
MELT = """SELECT event_id, model, dataset, prompt, 'random' AS type, random_demos AS score FROM fx_results
UNION ALL SELECT event_id, model, dataset, prompt, 'info' AS type, informative_demos AS score FROM fx_results"""
ORACLE["melt_strategies"] = MELT
ORACLE["box_stats"] = f"""WITH m AS ({MELT}),
q AS (SELECT dataset, model, type, count(score) AS n, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median,
      quantile_cont(score, 0.75) AS q3 FROM m GROUP BY ALL),
f AS (SELECT m.dataset, m.model, m.type,
      least(any_value(q1), min(score) FILTER (WHERE score >= q1 - 1.5 * (q3 - q1))) AS whisker_lo,
      greatest(any_value(q3), max(score) FILTER (WHERE score <= q3 + 1.5 * (q3 - q1))) AS whisker_hi
      FROM m JOIN q USING (dataset, model, type) GROUP BY ALL)
SELECT dataset, model, type, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
 round(whisker_lo, 6) AS whisker_lo, round(whisker_hi, 6) AS whisker_hi FROM q JOIN f USING (dataset, model, type)"""
_MODELS = ["model-click", "model-error", "model-purchase", "model-signup", "model-view"]
ORACLE["wide_report"] = "SELECT dataset, prompt, " + ", ".join(
    f"round(avg(informative_demos) FILTER (WHERE model = '{m}'), 6) AS \"{m}\"" for m in _MODELS
) + " FROM fx_results GROUP BY dataset, prompt"
ORACLE["rename_models"] = """SELECT event_id, m.new AS model, m.map_order FROM fx_results r JOIN
 (VALUES ('model-view', 'View-1B', 0), ('model-click', 'Click-3B', 1), ('model-purchase', 'Buy-11B', 2)) m(model, new, map_order)
 USING (model)"""
ORACLE["run_grid"] = """SELECT dataset, prompt, model, strategy FROM (SELECT DISTINCT dataset, prompt FROM fx_results),
 (VALUES ('m-small'), ('m-large')) a(model), (VALUES ('random'), ('cluster-random')) b(strategy)"""
ORACLE["tail_means"] = f"SELECT * FROM ({MEANS}) ORDER BY model DESC, dataset DESC, prompt DESC LIMIT 10"

# ---- sources, joins, windows, composed samples ---------------------------------
ORACLE["scan_jsonl"] = f"SELECT qid, {FLAT_AS_WRITTEN} AS answer, len(answers)::BIGINT AS n_items FROM fx_answers"
ORACLE["explode_map"] = "SELECT user_id, day, array_to_string(program_modules, ' ') AS concept FROM fx_concepts"
FACT_TABLES = """ts AS (
 SELECT concat('f', cast(p_partkey AS VARCHAR)) AS uid, concat_ws(' ', coalesce(p_name, ''), coalesce(p_brand, ''),
   coalesce(p_type, ''), coalesce(cast(p_size AS VARCHAR), '')) AS text, 0 AS t FROM part
 UNION ALL SELECT concat('f', cast(s_suppkey AS VARCHAR)), concat_ws(' ', coalesce(s_name, ''),
   coalesce(cast(s_nationkey AS VARCHAR), '')), 1 FROM supplier
 UNION ALL SELECT concat('n', cast(n_nationkey AS VARCHAR)), coalesce(n_name, ''), 2 FROM nation),
tst AS (SELECT uid, arg_min(text, t) AS text FROM ts GROUP BY uid)"""
ORACLE["table_set_texts"] = f"WITH {FACT_TABLES} SELECT uid, text FROM tst"
SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END"
ORACLE["read_split"] = f"SELECT doc_id, split FROM (SELECT doc_id, {SPLIT} AS split FROM documents) WHERE split = 'train'"
ORACLE["union_splits"] = f"""SELECT doc_id, split FROM (SELECT doc_id, {SPLIT} AS split FROM documents)
 WHERE split IN ('validation', 'test')"""
ORACLE["cache_missing"] = "SELECT task, 'cluster-random' AS strategy, idx FROM fx_predictions WHERE idx % 2 <> 0"
ORACLE["annotated_only"] = "SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)"
ORACLE["attach_labels"] = "SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)"
QIDS = f"qi AS (SELECT *, {_IDS} AS fact_ids FROM fx_questions WHERE explanation IS NOT NULL)"
ORACLE["lookup_facts"] = f"""WITH {QIDS},
ex AS (SELECT question_id, unnest(fact_ids) AS uid, unnest(range(len(fact_ids))) AS p FROM qi),
j AS (SELECT ex.question_id, ex.p, f.fact FROM ex LEFT JOIN fx_facts f USING (uid)),
g AS (SELECT question_id, string_agg(fact, ' | ' ORDER BY p) AS texts, count(*) FILTER (WHERE fact IS NULL) AS n_missing
      FROM j GROUP BY question_id)
SELECT qi.question_id, coalesce(g.texts, '') AS texts, coalesce(g.n_missing, 0) AS n_missing
FROM qi LEFT JOIN g USING (question_id)"""
ORACLE["block_clusters"] = """SELECT question_id, (count(*) OVER () - row_number() OVER (ORDER BY question_id)) // 4 AS cluster
FROM fx_questions"""
STRIP = "regexp_replace(@X@, '^" + PY_WS + "+|" + PY_WS + "+$', '', 'g')"
CLUSTERED = f"""{QIDS},
cl AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY question_id)) // 4 AS cluster FROM qi)"""
ORACLE["cluster_facts"] = f"""WITH {CLUSTERED},
cu AS (SELECT DISTINCT cluster, unnest(fact_ids) AS uid FROM cl),
g AS (SELECT cluster, count(f.fact) AS n_facts, count(*) - count(f.fact) AS n_missing,
 string_agg({STRIP.replace('@X@', 'f.fact')}, ' | ' ORDER BY uid) AS facts
 FROM cu LEFT JOIN fx_facts f USING (uid) GROUP BY cluster)
SELECT cluster, coalesce(n_facts, 0) AS n_facts, coalesce(n_missing, 0) AS n_missing, coalesce(facts, '') AS facts
FROM (SELECT DISTINCT cluster FROM cl) LEFT JOIN g USING (cluster)"""
ORACLE["micro_batches"] = "SELECT idx, (row_number() OVER (ORDER BY idx) - 1) // 8 AS batch_id FROM fx_samples"
ORACLE["running_cost"] = f"""WITH c AS (SELECT conv_id, turn, role, len({words('text')})::BIGINT AS tokens FROM conversations)
SELECT conv_id, turn, role, tokens, cast(sum(tokens) OVER (PARTITION BY role ORDER BY conv_id, turn) AS BIGINT) AS cum_tokens,
 round(sum(tokens) OVER (PARTITION BY role ORDER BY conv_id, turn) / 1000 * 0.02, 6) AS cum_cost FROM c"""
BAG = f"concat(logic, array_to_string(list_sort({words('premise')}), ' '))"
DEDUP = f"""dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {BAG} ORDER BY idx) AS rn FROM fx_nli)
 WHERE rn = 1 AND logic IS NOT NULL AND trim(logic) <> '')"""
ORACLE["bag_dedup"] = f"WITH {DEDUP} SELECT idx, logic, label FROM dd"
ORACLE["shuffled"] = "SELECT idx, cast(concat('0x', substr(md5(concat_ws('|', '7', idx)), 1, 12)) AS BIGINT) AS shuffle_key FROM fx_samples"
ORACLE["eval_cap"] = _demos_sql("fx_samples", "cluster-random").replace("HAVING count(*) = 3", "HAVING count(*) = 3 ORDER BY idx LIMIT 200") \
    .replace("SELECT idx, string_agg", "SELECT idx FROM (SELECT idx, string_agg").replace("ORDER BY idx LIMIT 200", ") ORDER BY idx LIMIT 200")
ORACLE["worldtree_samples"] = f"""WITH {FACT_TABLES}, {CLUSTERED},
cu AS (SELECT DISTINCT cluster, unnest(fact_ids) AS uid FROM cl),
cf AS (SELECT cluster, string_agg({STRIP.replace('@X@', 'tst.text')}, '. ' ORDER BY uid) AS ctx FROM cu JOIN tst USING (uid)
       GROUP BY cluster)
SELECT question_id AS idx, concat(coalesce(cf.ctx, ''), '. ', ' ', question) AS input,
 {ORACLE['answer_by_key'].split('SELECT question_id, ')[1].split(' AS answer')[0]} AS label,
 cast(cluster AS VARCHAR) AS category FROM cl LEFT JOIN cf USING (cluster)"""
ORACLE["nli_samples"] = f"""WITH {DEDUP}
SELECT idx, 'gpt3' AS template, concat(premise, chr(10) || 'Question: ', logic, ' True, False or Neither?') AS input,
 CASE WHEN label = 'entailment' THEN 'True' ELSE 'False' END AS label, logic AS category FROM dd
UNION ALL SELECT idx, 'plain', premise, label, logic FROM dd WHERE logic <> ''"""
ORACLE["multihop_samples"] = f"""WITH {REASONING}
SELECT d.doc_id AS idx, concat('Question: ', d.text, ' Context: ', '', ' Answer:') AS input, d.source AS label,
 array_to_string({TAILS}, '|') AS category FROM documents d JOIN fx_reasoning r ON r.idx = d.doc_id"""

# ---- concepts --------------------------------------------------------------------
MINDIST = """dc AS (SELECT DISTINCT array_to_string(program_modules, ' ') AS concept FROM fx_concepts),
md AS (SELECT a.concept, min(levenshtein(a.concept, b.concept)) AS min_dist
       FROM dc a LEFT JOIN dc b ON a.concept <> b.concept GROUP BY a.concept)"""
DRAWS = f"""{MINDIST},
ib AS (SELECT concept, min_dist AS band,
       row_number() OVER (PARTITION BY min_dist ORDER BY {draw_sql("'order', concept", '1').replace(' % 1', '')}, concept) - 1 AS pos,
       count(*) OVER (PARTITION BY min_dist) AS n FROM md WHERE min_dist IN (4, 6, 10)),
sz AS (SELECT DISTINCT band, n FROM ib),
pk AS (SELECT [4, 6, 10][r // 200 + 1] AS band, r % 200 AS j FROM range(600) t(r)),
dr AS (SELECT pk.band, pk.j, ib.concept FROM pk JOIN sz USING (band)
       JOIN ib ON ib.band = pk.band AND ib.pos = {draw_sql("'0', pk.band, pk.j", 'sz.n')})"""
SPLIT_SQL = f"""{DRAWS},
held AS (SELECT DISTINCT concept FROM dr),
sp AS (SELECT md.concept, md.min_dist, CASE WHEN held.concept IS NOT NULL THEN 'heldout' ELSE 'train' END AS split
       FROM md LEFT JOIN held USING (concept))"""
ORACLE["min_edit_distance"] = f"WITH {MINDIST} SELECT concept, min_dist FROM md"
ORACLE["draw_concepts"] = f"WITH {DRAWS} SELECT band, j, concept FROM dr"
ORACLE["concept_split"] = f"WITH {SPLIT_SQL} SELECT concept, min_dist, split FROM sp"
ORACLE["train_concepts"] = f"WITH {SPLIT_SQL} SELECT concept FROM sp WHERE split = 'train'"
ORACLE["concept_dataset"] = f"""WITH {SPLIT_SQL},
 raw AS (SELECT doc_id, text, lang, source, u.user_id, u.day, u.concept FROM documents
   JOIN (SELECT user_id, day, array_to_string(program_modules, ' ') AS concept FROM fx_concepts) u ON u.user_id = doc_id),
 rolled AS (SELECT *, CASE WHEN user_id % 5 = 0 THEN 'dev' ELSE 'train' END AS role FROM raw),
 tr AS (SELECT * FROM rolled WHERE role = 'train' AND length(text) < 1000),
 known AS (SELECT DISTINCT concept FROM tr WHERE concept NOT IN (SELECT concept FROM sp WHERE split = 'heldout')),
 both_roles AS (SELECT * FROM tr UNION ALL SELECT * FROM rolled WHERE role = 'dev' AND length(trim(source)) > 0)
SELECT user_id, day, role, concept, length(replace(text, ' -> ', '. '))::BIGINT AS context_chars, source AS answer,
 cast(concat('0x', substr(md5(concat_ws('|', '7', concat_ws('/', user_id, day))), 1, 12)) AS BIGINT) AS shuffle_key
FROM both_roles WHERE concept IN (SELECT concept FROM known)"""

# ---- training sets -----------------------------------------------------------------
N_DEMOS = "(2 + " + draw_sql("'0', 'n', idx", "4") + ")"
CI = """ci AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY idx) - 1 AS cat_pos,
 count(*) OVER (PARTITION BY category) AS cat_size FROM @SRC@)"""


def _sets_sql(kind: str, max_chars: int = 8000) -> str:
    if kind == "informative":
        base = CI.replace("@SRC@", "fx_samples") + f""",
st AS (SELECT idx, category, cat_pos AS p, cat_size AS n, {N_DEMOS} AS n_demos FROM ci WHERE cat_size > 1),
rows AS (SELECT idx, category, cat_pos AS p, input, label FROM ci)"""
        tag = "'informative'"
    else:
        base = """ci AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS p, count(*) OVER () AS n FROM fx_samples)""" + f""",
st AS (SELECT idx, 0 AS category, p, n, {N_DEMOS} AS n_demos FROM ci),
rows AS (SELECT idx, 0 AS category, p, input, label FROM ci)"""
        tag = "'random'"
    return f"""WITH {base},
sl AS (SELECT st.*, unnest(range(n_demos)) AS slot FROM st),
se AS (SELECT sl.*, 1 + {draw_sql("'0', " + tag + ", idx, slot", '(n - 1)')} AS sel0 FROM sl),
se2 AS (SELECT *, CASE WHEN sel0 = p THEN sel0 - 1 ELSE sel0 END AS sel FROM se),
pk AS (SELECT se2.idx, se2.n_demos, se2.slot, d.idx AS demo_idx, length(d.input) + length(d.label) + 2 AS demo_len
       FROM se2 JOIN rows d ON d.category = se2.category AND d.p = se2.sel),
g AS (SELECT idx, n_demos, list(demo_idx ORDER BY slot) AS ids, list(demo_len ORDER BY slot) AS lens
      FROM pk GROUP BY idx, n_demos)
SELECT idx, n_demos, array_to_string(ids, ' ') AS demo_idxs, list_sum(lens)::BIGINT AS demos_chars FROM g
WHERE len(ids) = n_demos AND coalesce(list_sum(lens[1:n_demos - 1]), 0) <= {max_chars}"""


ORACLE["demo_counts"] = f"SELECT idx, {N_DEMOS} AS n_demos FROM fx_samples"
ORACLE["train_informative"] = _sets_sql("informative")
ORACLE["train_random"] = _sets_sql("random")
ORACLE["train_length_guard"] = _sets_sql("informative", 3000)
ORACLE["train_hard"] = f"""WITH {CI.replace('@SRC@', 'fx_labelled')},
cw AS (SELECT idx, category, cat_pos, list_concat({words('input')}, {words('label')}) AS w FROM ci),
st AS (SELECT idx, category, cat_size, {N_DEMOS} AS n_demos, {words('input')} AS pw, {words('label')} AS tw
       FROM ci WHERE cat_size > 1),
dr AS (SELECT st.*, r, {draw_sql("'0', 'hard', idx, 0, r", 'cat_size')} AS cpos FROM st, range(20) t(r)),
pp AS (SELECT dr.idx, dr.n_demos, dr.r, c.idx AS cid, list_concat(c.w, dr.pw) AS pr, dr.tw
       FROM dr JOIN cw c ON c.category = dr.category AND c.cat_pos = dr.cpos),
sc AS (SELECT idx, n_demos, r, cid, list_sum(list_transform(tw, lambda w:
         ln((len(list_filter(pr, lambda x: x = w)) + 1) / (len(pr) + len(list_distinct(pr)) + 1)))) AS s FROM pp)
SELECT idx, n_demos, cid AS first_demo FROM (
 SELECT *, row_number() OVER (PARTITION BY idx ORDER BY s, r) AS rn FROM sc) WHERE rn = 1"""
ORACLE["train_hard_shared"] = ORACLE["train_hard"].replace("""list_sum(list_transform(tw, lambda w:
         ln((len(list_filter(pr, lambda x: x = w)) + 1) / (len(pr) + len(list_distinct(pr)) + 1))))""",
                                                           "len(list_filter(tw, lambda w: list_contains(pr, w)))")
assert "list_contains" in ORACLE["train_hard_shared"]
ORACLE["argmin_candidate"] = f"""SELECT task, idx, round(score, 6) AS score FROM (
 SELECT task, idx, {ROUGE} AS score, row_number() OVER (PARTITION BY task ORDER BY {ROUGE}, idx) AS rn FROM fx_predictions)
WHERE rn = 1"""
ORACLE["unigram_score"] = f"""SELECT idx, round(list_sum(list_transform({words('label')}, lambda w:
  ln((len(list_filter(pw, lambda x: x = w)) + 1) / (len(pw) + len(list_distinct(pw)) + 1)))), 6) AS log_score
FROM (SELECT *, {words('input')} AS pw FROM fx_labelled)"""
_MAJ = """WITH {pairs},
v AS (SELECT idx, label, count(*) AS c, max(last) AS m FROM pairs WHERE rn <= 3 GROUP BY idx, label),
k AS (SELECT idx FROM pairs WHERE rn <= 3 GROUP BY idx HAVING count(*) = 3)"""
ORACLE["predict_mock"] = _MAJ.format(pairs=demo_pairs("fx_labelled", "cluster-random")) + \
    "\nSELECT idx, 'mock text' AS predicted FROM k"
ORACLE["predict_majority"] = _MAJ.format(pairs=demo_pairs("fx_labelled", "cluster-random")) + """
SELECT idx, arg_max(label, c * 1000000000000 + m) AS predicted FROM v SEMI JOIN k USING (idx) GROUP BY idx"""

# ---- composed evaluation jobs -------------------------------------------------------


def _gap_sql(src: str, by: str, metric: str, max_words: int | None, boot: bool = False,
             model: str = "demo_majority") -> str:
    """Strategy gap per task ``by`` with the majority predictor; a sample is
    keyed by (task, idx)."""
    word_filter = ""
    if max_words is not None:
        word_filter = f"""
  pt AS (SELECT p.{by}, p.idx, concat(string_agg(concat('Input: ', x.input, ' Prediction: ', p.label), chr(10) ORDER BY p.rn),
         chr(10) || 'Input: ', any_value(s.input), ' Prediction:') AS prompt
         FROM pi p JOIN s x ON x.{by} = p.{by} AND x.idx = p.last JOIN s ON s.{by} = p.{by} AND s.idx = p.idx
         WHERE p.rn <= 3 GROUP BY p.{by}, p.idx),
  keptw AS (SELECT {by}, idx FROM pt WHERE len({words('prompt')}) <= {max_words}),"""
    kept_src = "keptw" if max_words is not None else "kept0"
    pi_col, pr_col = ("'mock text'", "'mock text'") if model == "mock" else ("j.pi", "j.pr")
    score_i = metric.replace("expected", "j.label").replace("predicted", pi_col)
    score_r = metric.replace("expected", "j.label").replace("predicted", pr_col)
    # the prompt holds the demonstrations in choice order
    at = {"first_label": 1, "last_label": 3}.get(model)
    pick = (f"SELECT {by}, idx, label AS pred FROM {{p}} WHERE rn = {at}" if at else
            f"SELECT {by}, idx, arg_max(label, c * 1000000000000 + m) AS pred FROM {{v}} GROUP BY {by}, idx")
    body = f"""WITH s AS (SELECT * FROM {src}),
t AS (SELECT {by}, input, label, category, max(idx) AS last FROM s GROUP BY {by}, input, label, category),
pi AS (SELECT s.{by}, s.idx, t.label, t.last, row_number() OVER (PARTITION BY s.{by}, s.idx ORDER BY t.last DESC) AS rn
       FROM s JOIN t ON t.{by} = s.{by} AND t.input <> s.input AND s.category IS NOT DISTINCT FROM t.category),
kept0 AS (SELECT {by}, idx FROM pi WHERE rn <= 3 GROUP BY {by}, idx HAVING count(*) = 3),{word_filter}
pr AS (SELECT s.{by}, s.idx, t.label, t.last, row_number() OVER (PARTITION BY s.{by}, s.idx ORDER BY t.last DESC) AS rn
       FROM s JOIN {kept_src} USING ({by}, idx) JOIN t ON t.{by} = s.{by} AND t.input <> s.input),
keptr AS (SELECT {by}, idx FROM pr WHERE rn <= 3 GROUP BY {by}, idx HAVING count(*) = 3),
vi AS (SELECT {by}, idx, label, count(*) AS c, max(last) AS m FROM pi WHERE rn <= 3 GROUP BY {by}, idx, label),
vr AS (SELECT {by}, idx, label, count(*) AS c, max(last) AS m FROM pr WHERE rn <= 3 GROUP BY {by}, idx, label),
mi AS ({pick.format(v='vi', p='pi')}),
mr AS ({pick.format(v='vr', p='pr')}),
j AS (SELECT s.{by}, s.idx, s.label, mi.pred AS pi, mr.pred AS pr FROM s JOIN {kept_src} USING ({by}, idx)
      JOIN keptr USING ({by}, idx) JOIN mi USING ({by}, idx) JOIN mr USING ({by}, idx)),
sc AS (SELECT j.{by}, j.idx, {score_r} AS s_rand, {score_i} AS s_info FROM j)"""
    if not boot:
        return body + f"""
SELECT {by}, '{model}' AS model, count(*) AS n_samples, round(avg(s_rand), 6) AS random_demos,
 round(avg(s_info), 6) AS informative_demos, (round(avg(s_info) - avg(s_rand), 6) + 0.0) AS difference FROM sc GROUP BY {by}"""
    return body + f""",
pos AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY {by}) AS n FROM sc),
sz AS (SELECT DISTINCT {by}, n FROM pos),
pk AS (SELECT sz.*, r // 100 AS round_id, r % 100 AS j FROM sz, range(20000) t(r)),
br AS (SELECT pk.{by}, pk.round_id, sum(pos.s_rand) / 100 AS s_rand FROM pk JOIN pos ON pos.{by} = pk.{by}
       AND pos.pos = {draw_sql(f"'0', concat_ws('/', pk.{by}, 'random'), pk.round_id, pk.j", 'pk.n')} GROUP BY ALL),
bi AS (SELECT pk.{by}, pk.round_id, sum(pos.s_info) / 100 AS s_info FROM pk JOIN pos ON pos.{by} = pk.{by}
       AND pos.pos = {draw_sql(f"'0', concat_ws('/', pk.{by}, 'informative'), pk.round_id, pk.j", 'pk.n')} GROUP BY ALL)
SELECT {by}, 'demo_majority' AS model, round_id, round(s_rand, 6) AS random_demos, round(s_info, 6) AS informative_demos,
 (round(s_info - s_rand, 6) + 0.0) AS difference FROM br JOIN bi USING ({by}, round_id)"""


NLI_SAMPLES = f"""nli AS (
 SELECT idx, 'gpt3' AS template, concat(premise, chr(10) || 'Question: ', logic, ' True, False or Neither?') AS input,
  CASE WHEN label = 'entailment' THEN 'True' ELSE 'False' END AS label, logic AS category FROM dd
 UNION ALL SELECT idx, 'plain', premise, label, logic FROM dd WHERE logic <> '')"""
_K1 = [_gap_sql("nli", "template", ROUGE, 2000, model=m) for m in ("demo_majority", "mock")]
ORACLE["concept_eval"] = (f"WITH {DEDUP}, {NLI_SAMPLES}, grid_a AS ({_K1[0]}), grid_b AS ({_K1[1]}) "
                          "SELECT * FROM grid_a UNION ALL SELECT * FROM grid_b")
_K1P = [_gap_sql("nli", "template", ROUGE, 2000, model=m) for m in ("first_label", "last_label")]
ORACLE["concept_eval_batch"] = (f"WITH {DEDUP}, {NLI_SAMPLES}, grid_a AS ({_K1P[0]}), grid_b AS ({_K1P[1]}) "
                                "SELECT * FROM grid_a UNION ALL SELECT * FROM grid_b")
ORACLE["rouge_informative"] = (f"WITH {DEDUP}, {NLI_SAMPLES}, grid_a AS ({_K1[0]}) SELECT template, model, "
                               "'cluster-random' AS strategy, n_samples, informative_demos AS score FROM grid_a")
_K1B = _gap_sql("nli", "template", ROUGE, 2000, boot=True)
ORACLE["concept_eval_bootstrap"] = f"WITH {DEDUP}, {NLI_SAMPLES}, " + _K1B[len("WITH "):]
#: micro F: each row's counts as a list [tp, fp, fn], pooled before the formula
_E_SET, _P_WORDS = f"list_distinct({words('lower(expected)')})", words("lower(predicted)")
MICRO_COUNTS = (f"[len(list_filter({_P_WORDS}, lambda w: list_contains({_E_SET}, w))), "
                f"len(list_filter({_P_WORDS}, lambda w: NOT list_contains({_E_SET}, w))), "
                f"len(list_filter({_E_SET}, lambda e: NOT list_contains({_P_WORDS}, e)))]")


def _pool(c: str) -> str:
    return f"(sum({c}[1]) / (sum({c}[1]) + 0.5 * (sum({c}[2]) + sum({c}[3]))))"


def _micro(sql: str) -> str:
    for c in ("s_rand", "s_info"):
        sql = sql.replace(f"avg({c})", _pool(c)).replace(f"sum(pos.{c}) / 100", _pool(f"pos.{c}"))
    return sql


_K1M = [_micro(_gap_sql("nli", "template", MICRO_COUNTS, 2000, model=m)) for m in ("demo_majority", "mock")]
ORACLE["gap_micro_f1"] = (f"WITH {DEDUP}, {NLI_SAMPLES}, grid_a AS ({_K1M[0]}), grid_b AS ({_K1M[1]}) "
                          "SELECT * FROM grid_a UNION ALL SELECT * FROM grid_b")
ORACLE["bootstrap_micro_f1"] = f"WITH {DEDUP}, {NLI_SAMPLES}, " + _micro(
    _gap_sql("nli", "template", MICRO_COUNTS, 2000, boot=True))[len("WITH "):]
ORACLE["bootstrap_list_function"] = ORACLE["bootstrap_micro_f1"]
SUITE = """suite AS (
 SELECT concat_ws('/', d.source, 'plain') AS task, d.doc_id AS idx, d.text AS input,
  concat(d.lang, '-', cast(l.quality AS VARCHAR)) AS label, d.lang AS category
 FROM documents d JOIN labels l USING (doc_id) WHERE strpos(d.source, 'src1') > 0
 UNION ALL
 SELECT concat_ws('/', d.source, 'context'), d.doc_id, concat('Context: ', d.text, ' Answer:'),
  concat(d.lang, '-', cast(l.quality AS VARCHAR)), d.lang
 FROM documents d JOIN labels l USING (doc_id) WHERE strpos(d.source, 'src1') > 0)"""
ORACLE["suite_eval"] = f"WITH {SUITE}, " + _gap_sql("suite", "task", EXACT, None)[len("WITH "):]
_WH = f"""CASE WHEN starts_with(text, 'To') THEN array_to_string({words('text')}[1:2], ' ') ELSE {words('text')}[1] END"""
ORACLE["instruction_eval"] = f"""WITH s AS (SELECT source AS task, doc_id AS idx, text AS input, {_WH} AS label FROM documents),
t AS (SELECT task, input, label, max(idx) AS last FROM s GROUP BY task, input, label),
p AS (SELECT s.idx, t.label, t.last, row_number() OVER (PARTITION BY s.idx ORDER BY t.last DESC) AS rn
      FROM s JOIN t ON t.task = s.task AND t.input <> s.input),
k AS (SELECT idx FROM p WHERE rn <= 3 GROUP BY idx HAVING count(*) = 3),
v AS (SELECT idx, label, count(*) AS c, max(last) AS m FROM p WHERE rn <= 3 GROUP BY idx, label),
mj AS (SELECT idx, arg_max(label, c * 1000000000000 + m) AS predicted FROM v SEMI JOIN k USING (idx) GROUP BY idx),
sc AS (SELECT s.task, s.label AS expected, mj.predicted FROM s JOIN mj USING (idx))
SELECT task, round(avg({ROUGE}), 6) AS demo_majority FROM sc GROUP BY task"""
ORACLE["result_report"] = f"""WITH b AS ({BEST}),
rows AS (SELECT r.* FROM fx_results r SEMI JOIN b USING (model, dataset, prompt)),
m0 AS (SELECT event_id, model, dataset, prompt, 'random' AS type, random_demos AS score FROM rows
       UNION ALL SELECT event_id, model, dataset, prompt, 'info' AS type, informative_demos AS score FROM rows),
mp AS (SELECT * FROM (VALUES ('model-view', 'View-1B', 0), ('model-click', 'Click-3B', 1), ('model-purchase', 'Buy-11B', 2))
       v(model, new, map_order)),
m1 AS (SELECT m0.dataset, m0.type, m0.score, mp.new AS model FROM m0 JOIN mp USING (model)),
m2 AS (SELECT dataset, type, score, CASE WHEN dataset IN ('d1', 'd2') AND strpos(model, 'Click') > 0
       THEN concat('$^*$', model) ELSE model END AS model FROM m1),
m AS (SELECT dataset, type, score, CASE WHEN dataset IN ('d1', 'd2') AND strpos(model, 'View') > 0
       THEN concat('$^*$', model) ELSE model END AS model FROM m2),
q AS (SELECT dataset, model, type, count(score) AS n, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median,
      quantile_cont(score, 0.75) AS q3 FROM m GROUP BY ALL),
f AS (SELECT m.dataset, m.model, m.type,
      least(any_value(q1), min(score) FILTER (WHERE score >= q1 - 1.5 * (q3 - q1))) AS whisker_lo,
      greatest(any_value(q3), max(score) FILTER (WHERE score <= q3 + 1.5 * (q3 - q1))) AS whisker_hi
      FROM m JOIN q USING (dataset, model, type) GROUP BY ALL)
SELECT dataset, model, type, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
 round(whisker_lo, 6) AS whisker_lo, round(whisker_hi, 6) AS whisker_hi FROM q JOIN f USING (dataset, model, type)"""
ORACLE["overlap_neighbours"] = f"""WITH {QIDS},
sets AS (SELECT question_id AS q, list_distinct(fact_ids) AS a FROM qi WHERE len(list_distinct(fact_ids)) > 0),
inc AS (SELECT q, unnest(a) AS f FROM sets),
pairs AS (SELECT x.q, y.q AS c, count(*) AS shared FROM inc x JOIN inc y ON x.f = y.f AND x.q <> y.q GROUP BY x.q, y.q),
sc AS (SELECT p.q, p.c, p.shared / greatest(len(s1.a), len(s2.a)) AS score FROM pairs p
       JOIN sets s1 ON s1.q = p.q JOIN sets s2 ON s2.q = p.c)
SELECT q AS question_id, rank, c AS other, round(score, 6) AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM sc) WHERE rank <= 3"""

_WH_T = ("CASE WHEN starts_with(text, 'To') THEN array_to_string(" + words("text") + "[1:2], ' ') ELSE "
         + words("text") + "[1] END")
ORACLE["training_table"] = f"""WITH s0 AS (
  SELECT doc_id AS idx, {_WH_T} AS category, concat('Question: ', text, ' Context: ', source, ' Answer:') AS prompt,
         source AS answer FROM documents WHERE length(text) < 2000),
ci AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY idx) - 1 AS p,
       count(*) OVER (PARTITION BY category) AS n FROM s0),
st AS (SELECT idx, category, p, n, {N_DEMOS} AS n_demos FROM ci WHERE n > 1),
sl AS (SELECT st.*, unnest(range(n_demos)) AS slot FROM st),
se AS (SELECT sl.*, 1 + {draw_sql("'0', 'informative', idx, slot", '(n - 1)')} AS sel0 FROM sl),
se2 AS (SELECT *, CASE WHEN sel0 = p THEN sel0 - 1 ELSE sel0 END AS sel FROM se),
pk AS (SELECT se2.idx, se2.n_demos, se2.slot, concat(d.prompt, ' ', d.answer, ' ') AS demo
       FROM se2 JOIN ci d ON d.category = se2.category AND d.p = se2.sel),
g AS (SELECT idx, n_demos, list(demo ORDER BY slot) AS demos FROM pk GROUP BY idx, n_demos),
kept AS (SELECT g.idx, g.n_demos, concat(array_to_string(g.demos, ' '), ' ', s0.prompt) AS primed
         FROM g JOIN s0 USING (idx)
         WHERE len(g.demos) = g.n_demos
           AND coalesce(list_sum(list_transform(g.demos[1:g.n_demos - 1], lambda x: length(x))), 0) <= 8000)
SELECT idx, (row_number() OVER (ORDER BY idx) - 1) // 8 AS batch_id, n_demos, length(primed) AS primed_chars,
       md5(primed) AS primed_md5 FROM kept"""


UNIGRAM_SCORE = ("list_sum(list_transform(tw, lambda w: ln((len(list_filter(p, lambda x: x = w)) + 1) / "
                 "(len(p) + len(list_distinct(p)) + 1))))")
SHARED_SCORE = "len(list_filter(tw, lambda w: list_contains(p, w)))"


def _hard_sets_sql(rounds: int = 5, cands: int = 20, max_chars: int = 8000, score: str = UNIGRAM_SCORE) -> str:
    """All hardest-demo rounds, unrolled: each round draws candidates, scores
    the prompt primed with the demos so far plus the candidate, keeps the
    lowest (draw number on ties)."""
    parts = [CI.replace("@SRC@", "fx_labelled") + ",",
             f"""cw AS (SELECT category, cat_pos, idx AS cid, list_concat({words('input')}, {words('label')}) AS w,
       length(input) + length(label) + 2 AS clen FROM ci),
st0 AS (SELECT idx, category, cat_size, {N_DEMOS} AS n_demos, {words('input')} AS pw, {words('label')} AS tw,
        []::VARCHAR[] AS dw, []::BIGINT[] AS ids, 0::BIGINT AS chars, true AS ok FROM ci WHERE cat_size > 1),"""]
    for s in range(rounds):
        parts.append(f"""dr{s} AS (SELECT st.idx, st.category, st.cat_size, st.dw, st.pw, st.tw, r,
        {draw_sql(f"'0', 'hard', st.idx, {s}, r", 'st.cat_size')} AS cpos
        FROM st{s} st, range({cands}) t(r) WHERE st.n_demos > {s} AND st.ok AND st.chars <= {max_chars}),
pp{s} AS (SELECT d.idx, d.r, c.cid, c.clen, c.w, list_concat(list_concat(d.dw, c.w), d.pw) AS p, d.tw
        FROM dr{s} d JOIN cw c ON c.category = d.category AND c.cat_pos = d.cpos),
b{s} AS (SELECT idx, cid, clen, w FROM (SELECT idx, r, cid, clen, w,
        row_number() OVER (PARTITION BY idx ORDER BY {score}, r) AS rn FROM pp{s}) WHERE rn = 1),
st{s + 1} AS (SELECT st.idx, st.category, st.cat_size, st.n_demos, st.pw, st.tw,
        CASE WHEN b.idx IS NOT NULL THEN list_concat(st.dw, b.w) ELSE st.dw END AS dw,
        CASE WHEN b.idx IS NOT NULL THEN list_append(st.ids, b.cid) ELSE st.ids END AS ids,
        st.chars + coalesce(b.clen, 0) AS chars,
        CASE WHEN st.n_demos > {s} AND st.ok THEN b.idx IS NOT NULL ELSE st.ok END AS ok
        FROM st{s} st LEFT JOIN b{s} b USING (idx)),""")
    body = "\n".join(parts).rstrip(",")
    return f"""WITH {body}
SELECT idx, n_demos, array_to_string(ids, ' ') AS demo_idxs, chars AS demos_chars FROM st{rounds}
WHERE ok AND len(ids) = least(n_demos, {rounds})"""


ORACLE["train_hard_sets"] = _hard_sets_sql()
ORACLE["train_hard_shared_sets"] = ORACLE["train_hard_model"] = _hard_sets_sql(score=SHARED_SCORE)
ORACLE["table_set_files"] = ORACLE["table_set_texts"]


def _training_sql(sets: str) -> str:
    """The training table of a sets query over ``tt`` (idx, category, input, label)."""
    return f"""WITH s0 AS (
  SELECT doc_id AS idx, {_WH_T} AS category, concat('Question: ', text, ' Context: ', source, ' Answer:') AS prompt,
         source AS answer FROM documents WHERE length(text) < 2000),
tt AS (SELECT idx, category, prompt AS input, answer AS label FROM s0),
sets AS ({sets}),
ex AS (SELECT idx, n_demos, unnest(string_split(demo_idxs, ' '))::BIGINT AS demo_idx,
       generate_subscripts(string_split(demo_idxs, ' '), 1) AS k FROM sets),
pr AS (SELECT ex.idx, ex.n_demos, string_agg(concat(t.input, ' ', t.label, ' '), ' ' ORDER BY k) AS demos
       FROM ex JOIN tt t ON t.idx = ex.demo_idx GROUP BY ex.idx, ex.n_demos),
kept AS (SELECT pr.idx, n_demos, concat(demos, ' ', tt.input) AS primed FROM pr JOIN tt USING (idx))
SELECT idx, (row_number() OVER (ORDER BY idx) - 1) // 8 AS batch_id, n_demos, length(primed) AS primed_chars,
       md5(primed) AS primed_md5 FROM kept"""


ORACLE["training_table_random"] = _training_sql(_sets_sql("random").replace("fx_samples", "tt"))
ORACLE["training_table_hard"] = _training_sql(_hard_sets_sql(score=SHARED_SCORE).replace("fx_labelled", "tt"))
#: the smallest source that contains each asked id; positions in id order
ORACLE["instruction_eval_tasks"] = f"""WITH ids AS (SELECT unnest(['src1', 'src4', 'src7']) AS i),
tk AS (SELECT DISTINCT name FROM (SELECT i, min(source) AS name FROM ids JOIN documents ON strpos(source, i) > 0 GROUP BY i)),
s AS (SELECT source AS task, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, text AS input, {_WH} AS label
      FROM documents WHERE source IN (SELECT name FROM tk)),
t AS (SELECT task, input, label, max(idx) AS last FROM s GROUP BY task, input, label),
p AS (SELECT s.task, s.idx, t.label, t.last, row_number() OVER (PARTITION BY s.task, s.idx ORDER BY t.last DESC) AS rn
      FROM s JOIN t ON t.task = s.task AND t.input <> s.input),
k AS (SELECT task, idx FROM p WHERE rn <= 3 GROUP BY task, idx HAVING count(*) = 3),
v AS (SELECT task, idx, label, count(*) AS c, max(last) AS m FROM p WHERE rn <= 3 GROUP BY task, idx, label),
mj AS (SELECT task, idx, arg_max(label, c * 1000000000000 + m) AS predicted FROM v SEMI JOIN k USING (task, idx) GROUP BY task, idx),
sa AS (SELECT s.task, s.label AS expected, mj.predicted FROM s JOIN mj USING (task, idx)),
sb AS (SELECT task, expected, 'mock text' AS predicted FROM sa),
ra AS (SELECT task, round(avg({ROUGE}), 6) AS demo_majority FROM sa GROUP BY task),
rb AS (SELECT task, round(avg({ROUGE}), 6) AS mock FROM sb GROUP BY task)
SELECT task, demo_majority, mock FROM ra JOIN rb USING (task)"""
MULTIHOP = f"""{REASONING},
mh AS (SELECT d.doc_id AS idx, d.text AS q, d.source AS x, d.lang AS label, {TAILS} AS category
       FROM documents d JOIN fx_reasoning r ON r.idx = d.doc_id),
mhs AS (SELECT 'qa' AS template, idx, concat('Question: ', q, ' Context: ', x, ' Answer:') AS input, label, category FROM mh
        UNION ALL SELECT 'plain', idx, concat(x, ' ', q), label, category FROM mh)"""
ORACLE["multihop_templates"] = f"""WITH {MULTIHOP}
SELECT template, idx, input, label, array_to_string(category, '|') AS category FROM mhs"""
ORACLE["multihop_gap"] = f"WITH {MULTIHOP}, " + _gap_sql("mhs", "template", EXACT, None)[len("WITH "):].replace(
    "s.category IS NOT DISTINCT FROM t.category", "len(list_intersect(s.category, t.category)) > 0")
ORACLE["training_batches"] = f"SELECT * FROM ({ORACLE['training_table']}) WHERE batch_id % 4 = 1 AND batch_id >= 8"
