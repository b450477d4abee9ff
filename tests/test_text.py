"""Text rules: pinned quirk cases."""

from pyspark.sql import functions as F

from demoforge.functions import text as T


def _one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_blank_date_as_written_gives_two_blanks(spark):
    schema = "a array<struct<number:string,date:struct<day:string,month:string,year:string>,spans:array<string>>>"
    df = spark.createDataFrame([([("", ("", "", ""), ["x", "y"])],)], schema)
    assert df.select(T.flatten_answer("a").alias("x")).first().x == "  "
    assert df.select(T.flatten_answer("a", "skip").alias("x")).first().x == "x y"


def test_label_code_is_substring(spark):
    assert _one(spark, T.label_code(F.lit("nothing"))) == 0
    assert _one(spark, T.label_code(F.lit("entailment"))) == 1


def test_wh_category_prefix_rule(spark):
    assert _one(spark, T.wh_category(F.lit("Today it rained"))) == "Today it"
    assert _one(spark, T.wh_category(F.lit("What is it"))) == "What"


def test_answer_by_key(spark):
    q = F.lit("Pick: (A) red ball (B) blue  (C) green")
    assert _one(spark, T.answer_by_key(q, F.lit("B"))) == "blue"
    assert _one(spark, T.answer_by_key(q, F.lit("C"))) == "green"
    assert _one(spark, T.answer_by_key(q, F.lit("D"))) is None


def test_parse_fact_ids_drops_roles(spark):
    assert _one(spark, T.parse_fact_ids(F.lit("x1|CENTRAL y2|GROUNDING"))) == ["x1", "y2"]


def test_relation_tails_short_last_field(spark):
    df = spark.createDataFrame([([[[["1"], ["only"]], [["2"], ["p", "q", "r"]]]],)],
                               "r array<array<array<array<string>>>>")
    assert df.select(T.relation_tails("r").alias("x")).first().x == ["only", "q r"]


def test_mark_seen_applies_each_family(spark):
    x = _one(spark, T.mark_seen(F.lit("mTk-instruct"), F.lit("d1"), ["d1"], ["Tk-instruct"]))
    assert x == "$^*$mTk-instruct"


def test_overlap_bucket(spark):
    x = _one(spark, T.overlap_bucket(F.lit("a b c"), [F.lit("A x"), F.lit("b c q")]))
    assert x == "0.6"


def test_python_whitespace(spark):
    assert _one(spark, F.size(T.py_words(F.lit("a b\tc  d ")))) == 4
    assert _one(spark, T.word_count(F.lit(" a b "))) == 2
