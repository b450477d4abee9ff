"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver tables (through a fixture) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demoforge.operators import demos as D
from demoforge.operators import evaluate as EV
from demoforge.plans.fixtures import fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---- flagship -------------------------------------------------------------

@query
def strategy_gap(spark, sf):
    s = fixture(spark, sf, "fx_labelled")
    return EV.strategy_gap(s, k=3, predictor="demo_majority", metric="accuracy_exact")


# ---- demonstration selection ---------------------------------------------

def _demos_out(df):
    return df.select("idx", D.demo_idx_string("demos").alias("demo_idxs"))


@query
def demos_random(spark, sf):
    return _demos_out(D.select_demos(fixture(spark, sf, "fx_samples"), 3, "random"))


@query
def demos_category(spark, sf):
    return _demos_out(D.select_demos(fixture(spark, sf, "fx_samples"), 3, "cluster-random"))


@query
def demos_null_category(spark, sf):
    return _demos_out(D.select_demos(fixture(spark, sf, "fx_samples_null"), 3, "cluster-random"))


@query
def demos_overlap(spark, sf):
    # demos are shown by id: a selection without texts, its input written once
    return _demos_out(D.select_demos_overlap(D.slim(fixture(spark, sf, "fx_samples_multi")), 3))


# ---- filters and limits (2.B) ---------------------------------------------
from demoforge.functions import text as T  # noqa: E402
from demoforge.operators import filters as FL  # noqa: E402


@query
def first_n(spark, sf):
    return FL.first_n(fixture(spark, sf, "fx_samples"), 50).select("idx", "label")


@query
def max_chars(spark, sf):
    s = FL.max_chars(fixture(spark, sf, "fx_samples"), "input", 2000)
    return s.select("idx", F.char_length("input").cast("bigint").alias("n_chars"))


@query
def max_words(spark, sf):
    s = D.select_demos(fixture(spark, sf, "fx_samples"), 3, "cluster-random")
    s = s.withColumn("n_words", D.prompt_word_count("demos").cast("bigint"))
    return s.where(F.col("n_words") <= 2000).select("idx", "n_words")


@query
def filter_questions(spark, sf):
    q = FL.filter_questions(fixture(spark, sf, "fx_questions"), "Easy")
    return q.select("question_id")


@query
def non_blank_answers(spark, sf):
    a = fixture(spark, sf, "fx_answers").select("qid", T.flatten_answer("answers").alias("answer"))
    return FL.non_blank(a, "answer")


@query
def select_tasks(spark, sf):
    part = fixture_table(spark, sf, "part")
    return FL.select_tasks(part, "p_name", ["ring", "blue", "zzz"], first=True)


@query
def name_filter(spark, sf):
    r = fixture(spark, sf, "fx_results")
    r = FL.where_contains(r, "model", "click").where(F.col("dataset") == "d1")
    return r.select("event_id", "model", "dataset")


# ---- scalar, string, nested (2.C) ------------------------------------------

def fixture_table(spark, sf, name):
    from demoforge.session import read_table
    return read_table(spark, sf, name)


@query
def wh_category(spark, sf):
    return fixture(spark, sf, "fx_samples").select("idx", T.wh_category("input").alias("category"))


@query
def first_token(spark, sf):
    s = fixture(spark, sf, "fx_samples")
    return s.select("idx", T.first_token("input").alias("token"), T.first_token("input", True).alias("token_lower"))


@query
def overlap_bucket(spark, sf):
    c = fixture(spark, sf, "fx_choices")
    return c.select("conv_id", "turn", T.overlap_bucket("premise", ["choice1", "choice2"]).alias("bucket"))


@query
def bag_key(spark, sf):
    n = fixture(spark, sf, "fx_nli")
    return n.select("idx", T.bag_key("logic", "premise").alias("bag_key"))


@query
def parse_fact_ids(spark, sf):
    q = fixture(spark, sf, "fx_questions")
    return q.select("question_id", F.array_join(T.parse_fact_ids("explanation"), " ").alias("fact_ids"))


@query
def answer_by_key(spark, sf):
    q = fixture(spark, sf, "fx_questions")
    return q.select("question_id", T.answer_by_key("question", "answer_key").alias("answer"))


@query
def rewrite_text(spark, sf):
    s = fixture(spark, sf, "fx_samples")
    return s.select(
        "idx",
        T.rewrite("input", T.CONTEXT_REWRITES).alias("context"),
        T.rewrite("input", T.YESNO_REWRITES, prefix="Context: ").alias("yesno"),
    )


@query
def flatten_answer(spark, sf):
    return fixture(spark, sf, "fx_answers").select("qid", T.flatten_answer("answers").alias("answer"))


@query
def flatten_answer_skip(spark, sf):
    return fixture(spark, sf, "fx_answers").select("qid", T.flatten_answer("answers", "skip").alias("answer"))


@query
def concept_string(spark, sf):
    return fixture(spark, sf, "fx_concepts").select("user_id", "day", T.concept("program_modules").alias("concept"))


_REASONING_SQL = """
WITH l1 AS (
  SELECT l_orderkey, l_linestatus,
   transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_returnflag, l_linestatus))),
     x -> array(array(cast(x.l_linenumber AS STRING)),
                CASE WHEN x.l_linenumber % 4 = 0 THEN array(x.l_returnflag)
                     ELSE array(x.l_returnflag, x.l_linestatus, cast(x.l_partkey AS STRING)) END)) AS expl
  FROM {lineitem} GROUP BY l_orderkey, l_linestatus)
SELECT l_orderkey AS idx, transform(array_sort(collect_list(struct(l_linestatus, expl))), y -> y.expl) AS reasoning
FROM l1 GROUP BY l_orderkey
"""


def fx_reasoning(spark, sf):
    return spark.sql(_REASONING_SQL, lineitem=fixture_table(spark, sf, "lineitem"))


@query
def relation_tails(spark, sf):
    r = fx_reasoning(spark, sf)
    return r.select("idx", F.array_join(T.relation_tails("reasoning"), "|").alias("tails"))


@query
def first_answer(spark, sf):
    return fixture(spark, sf, "fx_samples_multi").select("idx", T.first_answer("category").alias("answer"))


@query
def label_code(spark, sf):
    return fixture(spark, sf, "fx_nli").select("idx", T.label_code("label").alias("code"))


@query
def default_category(spark, sf):
    s = fixture(spark, sf, "fx_samples_null")
    return s.select(
        "idx",
        T.default_category("category", "none_string").alias("cat_none"),
        T.default_category("category", "blank").alias("cat_blank"),
        T.default_category("category", "null").isNull().alias("is_null"),
    )


@query
def qa_prompt(spark, sf):
    s = fixture(spark, sf, "fx_samples")
    return s.select("idx", T.qa_prompt("category", "input").alias("prompt"))


@query
def fewshot_prompt(spark, sf):
    s = D.select_demos(fixture(spark, sf, "fx_samples"), 3, "cluster-random")
    return s.select("idx", D.fewshot_prompt("demos").alias("prompt"))


NLI_TEMPLATES = {
    "gpt3": ("concat(premise, '\\nQuestion: ', logic, ' True, False or Neither?')",
             "CASE WHEN label = 'entailment' THEN 'True' ELSE 'False' END"),
    "plain": ("CASE WHEN logic <> '' THEN premise END", "label"),
}


@query
def render_templates(spark, sf):
    n = fixture(spark, sf, "fx_nli")
    return T.render_templates(n, NLI_TEMPLATES, keep=["idx"])


@query
def cut_at_marker(spark, sf):
    from demoforge.operators.predict import cut_at
    s = D.select_demos(fixture(spark, sf, "fx_samples"), 3, "cluster-random")
    s = s.select("idx", D.fewshot_prompt("demos").alias("prompt"),
                 F.when(F.col("idx") % 2 == 0, "davinci").otherwise("text-davinci-003").alias("model"))
    return s.select("idx", "model", cut_at("prompt", "Input", "model", "davinci").alias("cut"))


@query
def run_key(spark, sf):
    p = fixture_table(spark, sf, "pages")
    return p.select("page_id", T.run_key("url", F.concat(F.lit("tasks/"), F.col("url")), F.lit("cluster-random"))
                    .alias("run_key"))


@query
def mark_seen(spark, sf):
    r = fixture(spark, sf, "fx_results")
    return r.select("event_id", T.mark_seen("model", "dataset", ["d1", "d2"], ["click", "ick", "view"]).alias("model"))


# ---- metrics (2.D) ------------------------------------------------------------
from demoforge.functions import scores as SC  # noqa: E402
from demoforge.operators import reports as R  # noqa: E402
from demoforge.operators import windows as W  # noqa: E402


def _per_task(spark, sf, metric):
    p = fixture(spark, sf, "fx_predictions")
    return EV.mean_score(p, metric, by=["task"])


@query
def accuracy_folded(spark, sf):
    return _per_task(spark, sf, "accuracy_folded")


@query
def accuracy_exact(spark, sf):
    return _per_task(spark, sf, "accuracy_exact")


def _per_row(spark, sf, metric):
    p = SC.with_score(fixture(spark, sf, "fx_predictions"), metric, "expected", "predicted", "s")
    return p.select("idx", F.round("s", 6).alias("score"))


@query
def char_f1(spark, sf):
    return _per_row(spark, sf, "char_f1")


@query
def token_f1(spark, sf):
    return _per_row(spark, sf, "token_f1")


@query
def rouge_l(spark, sf):
    return _per_row(spark, sf, "rouge_l")


@query
def bootstrap_scores(spark, sf):
    p = SC.with_score(fixture(spark, sf, "fx_predictions"), "rouge_l", "expected", "predicted", "score")
    return EV.bootstrap(p.select("idx", "score"), rounds=200, size=100, seed=0)


@query
def score_tasks(spark, sf):
    p = fixture(spark, sf, "fx_predictions")
    for m in SC.METRICS:
        p = SC.with_score(p, m, "expected", "predicted", m)
    return p.groupBy("task").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in SC.METRICS])


@query
def mean_scores(spark, sf):
    return R.mean_scores(fixture(spark, sf, "fx_results"))


@query
def best_prompt(spark, sf):
    return R.best_prompt(fixture(spark, sf, "fx_results"))


@query
def best_prompt_rows(spark, sf):
    r = fixture(spark, sf, "fx_results")
    return R.best_prompt_rows(r, R.best_prompt(r)).select("event_id")


@query
def value_counts(spark, sf):
    c = fixture(spark, sf, "fx_concepts").select(T.concept("program_modules").alias("concept"))
    return R.value_counts(c, "concept")


@query
def distinct_concepts(spark, sf):
    return fixture(spark, sf, "fx_concepts").select(T.concept("program_modules").alias("concept")).distinct()


@query
def category_index(spark, sf):
    s = fixture(spark, sf, "fx_samples").select("idx", "category")
    return W.category_index(s)


@query
def retained_share(spark, sf):
    s = fixture(spark, sf, "fx_samples")
    return FL.retained(s, F.char_length("input") < 1000)


@query
def skip_report(spark, sf):
    s = D.select_demos(fixture(spark, sf, "fx_samples"), 3, "cluster-random", drop_short=False)
    s = s.withColumn("n_words", F.when(F.size("demos") == 3, D.prompt_word_count("demos")))
    return R.skip_report(s, 3, 1500)


def _melted(spark, sf):
    return R.melt_strategies(fixture(spark, sf, "fx_results"))


@query
def box_stats(spark, sf):
    return R.box_stats(_melted(spark, sf), ["dataset", "model", "type"])


@query
def melt_strategies(spark, sf):
    return _melted(spark, sf)


MODEL_IDS = ["model-click", "model-error", "model-purchase", "model-signup", "model-view"]


@query
def wide_report(spark, sf):
    r = fixture(spark, sf, "fx_results")
    return R.wide_report(r, ["dataset", "prompt"], "model", MODEL_IDS, "informative_demos")


DISPLAY_NAMES = [("model-view", "View-1B"), ("model-click", "Click-3B"), ("model-purchase", "Buy-11B")]


@query
def rename_models(spark, sf):
    r = fixture(spark, sf, "fx_results").select("event_id", "model")
    return R.rename_models(r, DISPLAY_NAMES)


@query
def run_grid(spark, sf):
    tasks = fixture(spark, sf, "fx_results").select("dataset", "prompt").distinct()
    return R.run_grid(tasks, model=["m-small", "m-large"], strategy=["random", "cluster-random"])


@query
def tail_means(spark, sf):
    return R.tail(R.mean_scores(fixture(spark, sf, "fx_results")), ["model", "dataset", "prompt"], 10)


# ---- sources as queries (2.A) ---------------------------------------------------
from demoforge import sources as SRC  # noqa: E402
from demoforge.operators import lookups as L  # noqa: E402


def _scratch(spark, name):
    """A new folder under the shared checkpoint folder, for queries that write
    a source and read it back."""
    import uuid
    from demoforge.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sources/{name}-{uuid.uuid4().hex}"


@query
def scan_jsonl(spark, sf):
    """fx_answers written as JSON lines and read with a declared schema."""
    path = _scratch(spark, "answers")
    fixture(spark, sf, "fx_answers").write.json(path)
    back = SRC.read_jsonl(spark, path, "qid BIGINT, answers ARRAY<STRUCT<number: STRING, date: STRUCT<day: STRING, "
                                       "month: STRING, year: STRING>, spans: ARRAY<STRING>>>")
    return back.select("qid", T.flatten_answer("answers").alias("answer"),
                       F.size("answers").cast("bigint").alias("n_items"))


@query
def explode_map(spark, sf):
    """fx_concepts as one JSON object per user (user/day -> modules), written
    and read back as keyed JSON."""
    path = _scratch(spark, "keyed")
    c = fixture(spark, sf, "fx_concepts")
    key = F.concat_ws("/", F.col("user_id").cast("string"), "day")
    c.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, "program_modules")))).alias("value")) \
        .select("value").write.text(path)
    ex = SRC.read_keyed_json(spark, path, "ARRAY<STRING>", per_line=True)
    return ex.select(F.split_part("id", F.lit("/"), F.lit(1)).cast("bigint").alias("user_id"),
                     F.split_part("id", F.lit("/"), F.lit(2)).alias("day"), T.concept("value").alias("concept"))


def _fact_tables(spark, sf):
    part = fixture_table(spark, sf, "part").select(
        F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("[SKIP] UID"), "p_name", "p_brand", "p_type",
        "p_size")
    supp = fixture_table(spark, sf, "supplier").select(
        F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("[SKIP] UID"), "s_name", "s_nationkey")
    nat = fixture_table(spark, sf, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("[SKIP] UID"), "n_name",
        F.col("n_regionkey").alias("[SKIP] region"))
    return [part, supp, nat]


@query
def table_set_texts(spark, sf):
    return L.table_set_texts(_fact_tables(spark, sf))


def _written_tables(spark, sf):
    """The fact tables as tab-separated folders and an index of their names."""
    base = _scratch(spark, "tables")
    names = ["PART.tsv", "SUPPLIER.tsv", "NATION.tsv"]
    for name, t in zip(names, _fact_tables(spark, sf)):
        t.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in t.columns]).write.option("sep", "\t").option(
            "header", True).option("escape", '"').csv(f"{base}/tables/{name}")
    spark.range(len(names), numPartitions=1).select(
        F.get(F.array(*[F.lit(n) for n in names]), F.col("id").cast("int")).alias("value")).write.text(f"{base}/index")
    return f"{base}/index", f"{base}/tables"


@query
def table_set_files(spark, sf):
    """A table set written as files and read back in one scan."""
    return SRC.read_table_set(spark, *_written_tables(spark, sf))


def _split_col():
    m = F.col("doc_id") % 10
    return F.when(m < 8, "train").when(m == 8, "validation").otherwise("test")


def _stored_splits(spark, sf):
    """Documents written partitioned by split; returns the folder."""
    path = _scratch(spark, "splits")
    SRC.write_split(L.with_split(fixture_table(spark, sf, "documents").select("doc_id"), _split_col()), path)
    return path


@query
def read_split(spark, sf):
    return SRC.read_split(spark, _stored_splits(spark, sf), "train").select("doc_id", "split")


@query
def union_splits(spark, sf):
    return SRC.read_split(spark, _stored_splits(spark, sf), ["validation", "test"]).select("doc_id", "split")


@query
def cache_missing(spark, sf):
    """Predictions already stored (even rows) against all requested: the
    missing keys are what the predictor still has to run."""
    p = fixture(spark, sf, "fx_predictions").withColumn("strategy", F.lit("cluster-random"))
    path, key = _scratch(spark, "cache"), ["task", "strategy", "idx"]
    p.where(F.col("idx") % 2 == 0).write.parquet(path)
    return SRC.cache_misses(p.select(*key), spark.read.parquet(path), key)


# ---- joins, lookups, windows (2.E, 2.F, 2.G) ---------------------------------


@query
def annotated_only(spark, sf):
    d = fixture_table(spark, sf, "documents")
    return L.semi(d, fixture_table(spark, sf, "labels"), "doc_id").select("doc_id")


@query
def attach_labels(spark, sf):
    d = fixture_table(spark, sf, "documents").select("doc_id", "n_chars")
    return L.attach(d, fixture_table(spark, sf, "labels"), "doc_id")


def _questions_with_ids(spark, sf):
    """Questions with parsed fact ids, written once: the lookups, clusters
    and neighbours read them in several jobs."""
    from demoforge.session import cut_lineage
    q = FL.filter_questions(fixture(spark, sf, "fx_questions"))
    return cut_lineage(q.withColumn("fact_ids", T.parse_fact_ids("explanation")))


@query
def lookup_facts(spark, sf):
    q = _questions_with_ids(spark, sf)
    facts = fixture(spark, sf, "fx_facts")
    out = L.lookup_list(q, "question_id", "fact_ids", facts, "uid", "fact")
    return out.select("question_id", F.array_join("texts", " | ").alias("texts"), "n_missing")


@query
def block_clusters(spark, sf):
    q = fixture(spark, sf, "fx_questions").select("question_id")
    return W.block_clusters(q, 3, "question_id")


@query
def cluster_facts(spark, sf):
    q = W.block_clusters(_questions_with_ids(spark, sf).select("question_id", "fact_ids"), 3, "question_id")
    cf = L.cluster_facts(q, "fact_ids", fixture(spark, sf, "fx_facts"), "uid", "fact")
    return cf.select("cluster", F.size("facts").cast("bigint").alias("n_facts"), "n_missing",
                     F.array_join("facts", " | ").alias("facts"))


@query
def micro_batches(spark, sf):
    return W.micro_batches(fixture(spark, sf, "fx_samples").select("idx"), 8)


PRICE_PER_1K = 0.02


@query
def running_cost(spark, sf):
    c = fixture_table(spark, sf, "conversations").withColumn("tokens", F.size(T.py_words("text")).cast("bigint"))
    r = W.running_sum(c, "tokens", ["role"], ["conv_id", "turn"], out="cum_tokens")
    return r.select("conv_id", "turn", "role", "tokens", "cum_tokens",
                    F.round(F.col("cum_tokens") / 1000 * PRICE_PER_1K, 6).alias("cum_cost"))


@query
def bag_dedup(spark, sf):
    first = W.dedup_first(fixture(spark, sf, "fx_nli"), T.bag_key("logic", "premise"), "idx")
    return FL.non_blank(first, "logic").select("idx", "logic", "label")


@query
def shuffled(spark, sf):
    return L.shuffled(fixture(spark, sf, "fx_samples").select("idx"), 7)


@query
def eval_cap(spark, sf):
    s = D.select_demos(fixture(spark, sf, "fx_samples"), 3, "cluster-random")
    return FL.first_n(s.select("idx"), 200)


# ---- composed sample builders (2.K) ------------------------------------------


def worldtree_samples_df(spark, sf, k=3, difficulty=None):
    from demoforge.session import cut_lineage
    q = FL.filter_questions(fixture(spark, sf, "fx_questions"), difficulty)
    q = cut_lineage(q.withColumn("fact_ids", T.parse_fact_ids("explanation")))
    # clusters are numbered on ids alone; the texts join last
    ids = cut_lineage(W.block_clusters(q.select("question_id", "fact_ids"), k, "question_id"))
    facts = L.table_set_texts(_fact_tables(spark, sf))
    cf = L.cluster_facts(ids, "fact_ids", facts, "uid", "text")
    s = q.join(ids.select("question_id", "cluster"), "question_id").join(cf, "cluster")
    return s.select(
        F.col("question_id").alias("idx"),
        F.concat(T.context_text("facts"), F.lit(" "), F.col("question")).alias("input"),
        T.answer_by_key("question", "answer_key").alias("label"),
        F.col("cluster").cast("string").alias("category"),
    )


@query
def worldtree_samples(spark, sf):
    return worldtree_samples_df(spark, sf)


@query
def nli_samples(spark, sf):
    kept = FL.non_blank(W.dedup_first(fixture(spark, sf, "fx_nli"), T.bag_key("logic", "premise"), "idx"), "logic")
    r = T.render_templates(kept, NLI_TEMPLATES, keep=["idx", "logic"])
    return r.select("idx", "template", "input", "label", F.col("logic").alias("category"))


@query
def multihop_samples(spark, sf):
    ann = fx_reasoning(spark, sf).select(F.col("idx").cast("string").alias("id"), "reasoning")
    docs = fixture_table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question"), F.col("source").alias("answer"))
    annotated = L.semi(docs, ann, "id")
    tails = ann.select("id", T.relation_tails("reasoning").alias("category"))
    s = L.attach(annotated, tails, "id")
    s = s.select("id", T.qa_prompt("question", F.lit("")).alias("input"), F.col("answer").alias("label"), "category")
    return s.select(F.col("id").cast("bigint").alias("idx"), "input", "label",
                    F.array_join("category", "|").alias("category"))


# ---- concepts, distances, split (2.E8, 2.H1-H2, 2.G6, K8) ------------------
from demoforge.operators import concepts as CN  # noqa: E402

CONCEPT_BANDS = (4, 6, 10)
HELD_OUT_DRAWS = 200


def _concepts(spark, sf):
    return fixture(spark, sf, "fx_concepts").select("user_id", "day", T.concept("program_modules").alias("concept"))


@query
def min_edit_distance(spark, sf):
    return CN.min_edit_distance(_concepts(spark, sf), "concept")


@query
def draw_concepts(spark, sf):
    c = _concepts(spark, sf)
    return CN.draw_concepts(CN.min_edit_distance(c), CONCEPT_BANDS, HELD_OUT_DRAWS, seed=0)


@query
def concept_split(spark, sf):
    return CN.concept_split(_concepts(spark, sf), CONCEPT_BANDS, HELD_OUT_DRAWS, seed=0)


@query
def train_concepts(spark, sf):
    s = CN.concept_split(_concepts(spark, sf), CONCEPT_BANDS, HELD_OUT_DRAWS, seed=0)
    return s.where(F.col("split") == "train").select("concept")


@query
def concept_dataset(spark, sf):
    """Rows with a context, an answer and a concept: the length limit holds for
    train rows only, train concepts are those of the train rows left without
    the held-out draws, dev rows need a train concept and an answer."""
    from demoforge.session import cut_lineage
    c = cut_lineage(_concepts(spark, sf))
    held = CN.concept_split(c, CONCEPT_BANDS, HELD_OUT_DRAWS, seed=0).where(F.col("split") == "heldout").select("concept")
    d = fixture_table(spark, sf, "documents").select(
        F.col("doc_id").alias("user_id"), T.rewrite("text", T.CONTEXT_REWRITES).alias("context"), F.char_length("text").alias("_n"),
        F.array(F.struct(F.lit("").alias("number"), F.struct(F.lit("").alias("day"), F.lit("").alias("month"),
                F.lit("").alias("year")).alias("date"), F.array("source").alias("spans"))).alias("answers"))
    # never broadcast: the file of the days' repeated concepts is far smaller than their rows
    rows = c.hint("merge").join(d, "user_id").withColumn("answer", T.flatten_answer("answers", "skip"))
    rows = rows.withColumn("role", F.when(F.col("user_id") % 5 == 0, "dev").otherwise("train"))
    rows = cut_lineage(rows.where((F.col("role") == "dev") | (F.col("_n") < 1000)).drop("answers", "_n"))
    train = rows.where(F.col("role") == "train")
    known = train.select("concept").distinct().join(held, "concept", "left_anti")
    dev = FL.non_blank(rows.where(F.col("role") == "dev"), "answer")
    kept = L.semi(train.unionByName(dev), known, "concept").withColumn("_id", F.concat_ws("/", "user_id", "day"))
    return L.shuffled(kept, 7, order_col="_id").select(
        "user_id", "day", "role", "concept", F.char_length("context").cast("bigint").alias("context_chars"), "answer", "shuffle_key")


# ---- training sets (2.H), predictors and scorer (2.J) ------------------------
from demoforge.operators import list_metrics as LM  # noqa: E402
from demoforge.operators import predict as P  # noqa: E402
from demoforge.operators import scorer as SR  # noqa: E402
from demoforge.operators import training as TR  # noqa: E402


def _sets_out(df):
    return df.select("idx", "n_demos", F.array_join(F.transform("demo_idxs", lambda x: x.cast("string")), " ")
                     .alias("demo_idxs"), "demos_chars")


@query
def demo_counts(spark, sf):
    return TR.demo_counts(fixture(spark, sf, "fx_samples").select("idx")).select("idx", "n_demos")


@query
def train_informative(spark, sf):
    return _sets_out(TR.informative_sets(fixture(spark, sf, "fx_samples")))


@query
def train_random(spark, sf):
    return _sets_out(TR.random_sets(fixture(spark, sf, "fx_samples")))


@query
def train_length_guard(spark, sf):
    return _sets_out(TR.informative_sets(fixture(spark, sf, "fx_samples"), max_chars=3000))


@query
def train_hard(spark, sf):
    """Hardest single demonstration (20 candidates, as in the training runs)."""
    return TR.hardest_demo(fixture(spark, sf, "fx_labelled"), candidates=20)


@query
def train_hard_shared(spark, sf):
    """Hardest single demonstration under another scorer: fewest shared words."""
    return TR.hardest_demo(fixture(spark, sf, "fx_labelled"), candidates=20, scorer=TR.shared_word_score)


@query
def train_hard_sets(spark, sf):
    return _sets_out(TR.hard_sets(fixture(spark, sf, "fx_labelled"), candidates=20))


@query
def train_hard_shared_sets(spark, sf):
    """All slots under the scorer of fewest shared words."""
    return _sets_out(TR.hard_sets(fixture(spark, sf, "fx_labelled"), candidates=20, scorer=TR.shared_word_score))


def shared_words_model():
    """Stand-in model over texts: how many of the target's words the prompt holds."""
    def score(prompts, targets):
        held = [set(p.split()) for p in prompts]
        return [sum(w in h for w in t.split()) for h, t in zip(held, targets)]

    return score


@query
def train_hard_model(spark, sf):
    """All slots under a model that reads batches of (primed prompt, answer),
    its scores kept in a cache."""
    from demoforge.session import ensure_checkpoint_dir
    import uuid
    cache = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scores/{uuid.uuid4().hex}"
    scorer = SR.BatchScorer("shared_words", shared_words_model, batch_size=32, cache=cache)
    return _sets_out(TR.hard_sets(fixture(spark, sf, "fx_labelled"), candidates=20, scorer=scorer))


@query
def argmin_candidate(spark, sf):
    p = SC.with_score(fixture(spark, sf, "fx_predictions"), "rouge_l", "expected", "predicted", "score")
    return TR.argmin_candidate(p, "task", "idx", "score", "idx").select("task", "idx", F.round("score", 6)
                                                                        .alias("score"))


@query
def unigram_score(spark, sf):
    s = fixture(spark, sf, "fx_labelled")
    return s.select("idx", F.round(TR.unigram_log_score(T.py_words("input"), T.py_words("label")), 6)
                    .alias("log_score"))


def _predicted(spark, sf, predictor):
    s = D.select_demos(fixture(spark, sf, "fx_labelled"), 3, "cluster-random")
    s = s.withColumn("prompt", D.fewshot_prompt("demos"))
    return P.predict(s, predictor).select("idx", "predicted")


@query
def predict_mock(spark, sf):
    return _predicted(spark, sf, "mock")


@query
def predict_majority(spark, sf):
    return _predicted(spark, sf, "demo_majority")


def _training_table(spark, sf, chosen_sets):
    """Question-answer training table: length filter, question-word category,
    QA prompt, demonstrations of a strategy, character guard, primed prompt,
    micro-batches of 8."""
    d = fixture_table(spark, sf, "documents")
    s = FL.max_chars(d.select(F.col("doc_id").alias("idx"), "text", "source"), "text", 2000)
    s = s.select("idx", T.wh_category("text").alias("category"), T.qa_prompt("text", "source").alias("prompt"),
                 F.col("source").alias("answer"))
    from demoforge.session import cut_lineage
    sets = cut_lineage(chosen_sets(s, prompt="prompt", answer="answer"))
    # batches are numbered on ids, texts are attached after
    b = W.micro_batches(sets.select("idx"), 8)
    primed = TR.with_primed_prompt(sets, s, "prompt", "answer").join(b, "idx")
    return primed.select("idx", "batch_id", "n_demos", F.char_length("primed").cast("bigint").alias("primed_chars"),
                    F.md5("primed").alias("primed_md5"))


@query
def training_table(spark, sf):
    return _training_table(spark, sf, TR.informative_sets)


@query
def training_table_random(spark, sf):
    return _training_table(spark, sf, TR.random_sets)


@query
def training_table_hard(spark, sf):
    def hardest(samples, **columns):
        return TR.hard_sets(samples, candidates=20, scorer=TR.shared_word_score, **columns)

    return _training_table(spark, sf, hardest)


@query
def training_batches(spark, sf):
    """The training table written as ordered batch files; shard 1 of 4, resumed at batch 8."""
    path = _scratch(spark, "batches")
    SRC.write_batches(training_table(spark, sf), path)
    return SRC.batch_shard(spark, path, shard=1, of=4, start=8)


# ---- composed evaluation jobs (2.K) ------------------------------------------


def _nli_task_samples(spark, sf):
    """Derived samples (dedup + templates) are read several times by the
    demo selection: write them once to the checkpoint folder."""
    from demoforge.session import cut_lineage
    return cut_lineage(nli_samples(spark, sf))


EVAL_MODELS = ["demo_majority", "mock"]


@query
def concept_eval(spark, sf):
    """Run grid of models x templates: same-category against latest
    demonstrations, ROUGE-L, prompts over 2000 words dropped."""
    s = _nli_task_samples(spark, sf)
    return EV.strategy_gap(s, 3, EVAL_MODELS, "rouge_l", max_words=2000, by=["template"])


def first_label(prompts):
    """Deterministic stand-in model: the label of the first demonstration."""
    return prompts.map(lambda p: p.split(" Prediction: ", 1)[1].split("\n", 1)[0])


def last_label(prompts):
    """Deterministic stand-in model: the label of the last demonstration."""
    return prompts.map(lambda p: p.rsplit("\nInput: ", 1)[0].rsplit(" Prediction: ", 1)[1])


@query
def concept_eval_batch(spark, sf):
    """Two models that read prompts in batches, their answers kept in a cache."""
    from demoforge.session import ensure_checkpoint_dir
    import uuid
    cache = f"{ensure_checkpoint_dir(spark).rstrip('/')}/answers/{uuid.uuid4().hex}"
    return EV.strategy_gap(_nli_task_samples(spark, sf), 3, [first_label, last_label], "rouge_l", max_words=2000,
                           by=["template"], cache=cache, batch_size=16)


@query
def rouge_informative(spark, sf):
    """One strategy alone with its own word limit."""
    return EV.strategy_score(_nli_task_samples(spark, sf), 3, "cluster-random", max_words=2000, by=["template"])


@query
def concept_eval_bootstrap(spark, sf):
    s = _nli_task_samples(spark, sf)
    return EV.strategy_gap(s, 3, "demo_majority", "rouge_l", max_words=2000, by=["template"],
                           bootstrap_rounds=200, bootstrap_size=100, seed=0)


@query
def gap_micro_f1(spark, sf):
    """A corpus-level metric: F-score of token counts pooled over a whole task."""
    return EV.strategy_gap(_nli_task_samples(spark, sf), 3, EVAL_MODELS, LM.micro_f1(), max_words=2000, by=["template"])


@query
def bootstrap_micro_f1(spark, sf):
    """The same metric over the pooled counts of every bootstrap round."""
    return EV.strategy_gap(_nli_task_samples(spark, sf), 3, "demo_majority", LM.micro_f1(), max_words=2000, by=["template"],
                           bootstrap_rounds=200, bootstrap_size=100, seed=0)


def pooled_f1(expected, predicted):
    """Micro F as a plain function of two lists of texts."""
    tp = fp = fn = 0
    for e, p in zip(expected, predicted):
        e, p = set((e or "").lower().split()), (p or "").lower().split()
        hit = sum(w in e for w in p)
        tp, fp, fn = tp + hit, fp + len(p) - hit, fn + len(e - set(p))
    return tp / (tp + 0.5 * (fp + fn)) if tp + fp + fn else None


@query
def bootstrap_list_function(spark, sf):
    """Any Python function of (expected list, predicted list) in every bootstrap round."""
    return EV.strategy_gap(_nli_task_samples(spark, sf), 3, "demo_majority", LM.ListFunction(pooled_f1), max_words=2000,
                           by=["template"], bootstrap_rounds=200, bootstrap_size=100, seed=0)


SUITE_TEMPLATES = {
    "plain": ("text", "concat(lang, '-', cast(quality AS STRING))"),
    "context": ("concat('Context: ', text, ' Answer:')", "concat(lang, '-', cast(quality AS STRING))"),
}


def _suite(spark, sf):
    """Tasks selected by id substring, every template applied; a task is
    (source, template)."""
    d = fixture_table(spark, sf, "documents").join(fixture_table(spark, sf, "labels"), "doc_id")
    d = FL.select_tasks(d, "source", ["src1"])
    r = T.render_templates(d, SUITE_TEMPLATES, keep=["source", "doc_id", "lang"])
    return r.select(F.concat_ws("/", "source", "template").alias("task"), F.col("doc_id").alias("idx"), "input",
                    "label", F.col("lang").alias("category"))


@query
def suite_eval(spark, sf):
    return EV.strategy_gap(_suite(spark, sf), 3, "demo_majority", "accuracy_exact", by=["task"])


@query
def instruction_eval(spark, sf):
    """Instruction tasks: NULL category, latest demonstrations only, ROUGE-L
    per task, one column per model."""
    d = fixture_table(spark, sf, "documents")
    s = d.select(F.col("source").alias("task"), F.col("doc_id").alias("idx"), F.col("text").alias("input"),
                 T.wh_category("text").alias("label"), F.lit(None).cast("string").alias("category"))
    sel = D.select_demos(s, 3, "random", by=["task"])
    pred = P.predict(sel, "demo_majority")
    per = SC.with_score(pred, "rouge_l", "label", "predicted", "score").select(
        "task", F.lit("demo_majority").alias("model"), "score")
    return R.wide_report(per, ["task"], "model", ["demo_majority"], "score")


INSTRUCTION_TASKS = ["src1", "src4", "src7"]


def _written_tasks(spark, sf):
    """Documents as a folder of task files: one JSON object a source, its
    instances in id order with the answer and a second wording of it."""
    path = _scratch(spark, "tasks")
    d = fixture_table(spark, sf, "documents").select("source", "doc_id", F.struct(
        F.col("text").alias("input"), F.array(T.wh_category("text"), F.lit("other")).alias("output")).alias("i"))
    g = d.groupBy(F.col("source").alias("task")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "i"))).alias("l"))
    g.select("task", F.to_json(F.struct(F.transform("l", lambda x: x["i"]).alias("Instances"))).alias("value")) \
        .repartition("task").write.partitionBy("task").text(path)
    return path


@query
def instruction_eval_tasks(spark, sf):
    """Instruction tasks from a folder: the first task of each id, first
    answers, NULL category, latest demonstrations, ROUGE-L, a column a model."""
    from demoforge.session import cut_lineage
    t = SRC.read_tasks(spark, _written_tasks(spark, sf), INSTRUCTION_TASKS)
    s = cut_lineage(t.select("task", F.col("pos").cast("bigint").alias("idx"), "input", "label", F.lit(None).cast("string").alias("category")))
    sel = D.select_demos(s, 3, "random", by=["task"])
    models = ["demo_majority", "mock"]
    rows = [SC.with_score(P.predict(sel, m), "rouge_l", "label", "predicted", "score").select("task", F.lit(m).alias("model"), "score")
            for m in models]
    return R.wide_report(rows[0].unionByName(rows[1]), ["task"], "model", models, "score")


MULTIHOP_TEMPLATES = {
    "qa": ("concat('Question: ', question, ' Context: ', context, ' Answer:')", "answer"),
    "plain": ("concat(context, ' ', question)", "answer"),
}


def _multihop(spark, sf):
    """Multi-hop samples: annotations from keyed JSON, questions that have one,
    every template, the relation tails kept as a list category."""
    path = _scratch(spark, "reasoning")
    fx_reasoning(spark, sf).select(F.to_json(F.create_map(F.col("idx").cast("string"), "reasoning")).alias("value")).write.text(path)
    ann = SRC.read_keyed_json(spark, path, "ARRAY<ARRAY<ARRAY<ARRAY<STRING>>>>", per_line=True)
    docs = fixture_table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question"), F.col("source").alias("context"),
        F.col("lang").alias("answer"))
    s = L.attach(L.semi(docs, ann, "id"), ann.select("id", T.relation_tails("value").alias("category")), "id")
    r = T.render_templates(s, MULTIHOP_TEMPLATES, keep=["id", "category"])
    return r.select("template", F.col("id").cast("bigint").alias("idx"), "input", "label", "category")


@query
def multihop_templates(spark, sf):
    return _multihop(spark, sf).withColumn("category", F.array_join("category", "|"))


@query
def multihop_gap(spark, sf):
    """Demonstrations that share a relation tail against the latest ones."""
    from demoforge.session import cut_lineage
    return EV.strategy_gap(cut_lineage(_multihop(spark, sf)), 3, "demo_majority", "accuracy_exact", by=["template"], informative="overlap")


SEEN_DATASETS = ["d1", "d2"]
SEEN_FAMILIES = ["Click", "View"]


@query
def result_report(spark, sf):
    r = fixture(spark, sf, "fx_results")
    best = R.best_prompt(r)
    rows = R.best_prompt_rows(r, best)
    melted = R.melt_strategies(rows)
    named = R.rename_models(melted, DISPLAY_NAMES)
    named = named.withColumn("model", T.mark_seen("model", "dataset", SEEN_DATASETS, SEEN_FAMILIES))
    return R.box_stats(named, ["dataset", "model", "type"])


@query
def overlap_neighbours(spark, sf):
    from demoforge.operators.neighbours import overlap_neighbours as on
    q = _questions_with_ids(spark, sf)
    r = on(q, "question_id", "fact_ids", k=3)
    return r.select("question_id", "rank", "other", F.round("score", 6).alias("score"))
