"""Text and nested-value rules of the task loaders, as JVM-side columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's -----------------------
# Answer option markers, in the order the science-question loader ranks them;
# the answer for key X runs from " (X) " to the marker that follows X here.
ANSWER_MARKERS = ["(A)", "(B)", "(C)", "(D)", "(E)", "(XX)", "(0)", "(1)", "(2)", "(3)", "(4)", "(5)", "(XX)"]
# Prompt formats.
QA_FORMAT = "Question: %s Context: %s Answer:"
DEMO_FORMAT = "%s %s "
# Yes/no question rewrite: (search, replacement) applied in this order,
# after prefixing "Context: ".
YESNO_REWRITES = [("\nAnswer", "? Yes, or No? \nAnswer"), ("\n", " ")]
# Concept-data context rewrite.
CONTEXT_REWRITES = [(" -> ", ". ")]
# Prefix of models marked as having seen a dataset in training.
SEEN_PREFIX = "$^*$"
# White space as Python's str.split() / str.isspace() see it.
PY_WS = r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# -------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_words(text) -> Column:
    """``str.split()``: runs of white space, ends trimmed, no empty word."""
    return F.filter(F.split(_c(text), PY_WS + "+"), lambda w: w != "")


def word_count(text) -> Column:
    """``len(str(x).split())``; splitting takes a quarter of the time of
    counting matches."""
    return F.size(py_words(py_str(text)))


def py_strip(text) -> Column:
    """``str.strip()``: white space (not only blanks) off both ends."""
    return F.regexp_replace(_c(text), f"^{PY_WS}+|{PY_WS}+$", "")


def py_str(col) -> Column:
    """``'%s' % x``: NULL prints as ``None``."""
    return F.coalesce(_c(col).cast("string"), F.lit("None"))


def wh_category(question) -> Column:
    """First word; the first two when the text starts with ``To``."""
    q = _c(question)
    w = py_words(q)
    return F.when(q.startswith("To"), F.array_join(F.slice(w, 1, 2), " ")).otherwise(F.get(w, 0))


def first_token(text, lower: bool = False) -> Column:
    t = F.get(py_words(text), 0)
    return F.lower(t) if lower else t


def overlap_bucket(premise, choices: Sequence, n: int = 10) -> Column:
    """max over choices of |choice words & premise words| / |premise words|
    (lower-cased word sets), truncated to 1/n steps, printed as a number."""
    prem = F.array_distinct(py_words(F.lower(_c(premise))))
    fracs = [
        F.size(F.array_intersect(F.array_distinct(py_words(F.lower(_c(ch)))), prem)) / F.size(prem)
        for ch in choices
    ]
    best = F.greatest(*fracs) if len(fracs) > 1 else fracs[0]
    # an empty premise has no ratio (the loader divides by zero): NULL
    return F.when(F.size(prem) > 0, (F.floor(best * F.lit(n)) / F.lit(n)).cast("double").cast("string"))


def bag_key(category, text) -> Column:
    """Category followed by the sorted words of the text (duplicate test)."""
    return F.concat(_c(category), F.array_join(F.array_sort(py_words(text)), " "))


def _is_upper(x: Column) -> Column:
    # str.isupper(): has a cased character and no lower-case one
    return (x == F.upper(x)) & (x != F.lower(x))


def parse_fact_ids(explanation) -> Column:
    """Split on ``|``, last word of each part, drop the all-upper-case ones."""
    lasts = F.transform(F.split(_c(explanation), r"\|"), lambda p: F.try_element_at(py_words(p), F.lit(-1)))
    return F.filter(lasts, lambda x: x.isNotNull() & (x != "") & ~_is_upper(x))


def answer_by_key(question, key) -> Column:
    """Text between `` (K) `` and the next marker, stripped; NULL if absent."""
    q, k = _c(question), _c(key)
    nxt = F.create_map(
        *[x for i, m in enumerate(ANSWER_MARKERS[:-1]) for x in (F.lit(m[1:-1]), F.lit(ANSWER_MARKERS[i + 1]))]
    )
    start = F.concat(F.lit(" ("), k, F.lit(") "))
    after = F.split_part(q, start, F.lit(2))
    body = F.split_part(after, F.try_element_at(nxt, k), F.lit(1))
    return F.when(F.instr(q, start) > 0, py_strip(body))


def context_text(texts) -> Column:
    """Texts joined by ``. `` plus a final ``. ``."""
    return F.concat(F.array_join(_c(texts), ". "), F.lit(". "))


def rewrite(col, pairs: Sequence[tuple[str, str]], prefix: str = "") -> Column:
    out = F.concat(F.lit(prefix), _c(col)) if prefix else _c(col)
    for a, b in pairs:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def flatten_answer(answers, blank_date: str = "as_written") -> Column:
    """Per item: its number, else its date parts joined, else its spans;
    items joined by a blank.  As written, a date of three empty strings joins
    to two blanks, which counts as present; ``skip`` tests it trimmed."""
    def item(a):
        date = F.concat_ws(" ", a["date"]["day"], a["date"]["month"], a["date"]["year"])
        has_date = date != "" if blank_date == "as_written" else F.trim(date) != ""
        if blank_date not in ("as_written", "skip"):
            raise ValueError(blank_date)
        return (
            F.when(F.coalesce(a["number"], F.lit("")) != "", a["number"])
            .when(a["date"].isNotNull() & has_date, date)
            .otherwise(F.array_join(F.coalesce(a["spans"], F.array().cast("array<string>")), " "))
        )

    return F.array_join(F.transform(_c(answers), item), " ")


def concept(modules) -> Column:
    return F.array_join(_c(modules), " ")


def relation_tails(reasoning) -> Column:
    """Flatten one level; of each reasoning take the last field and join its
    last two parts (or fewer, like Python's ``x[-2:]``) with a blank."""
    def tail(r):
        last = F.coalesce(F.try_element_at(r, F.lit(-1)), F.array().cast("array<string>"))
        return F.array_join(F.slice(last, F.greatest(F.size(last) - 1, F.lit(1)), 2), " ")

    return F.transform(F.flatten(_c(reasoning)), tail)


def first_answer(col) -> Column:
    return F.get(_c(col), 0)


def label_code(label) -> Column:
    """0 if the label contains ``not`` (substring), else 1."""
    return F.when(F.instr(_c(label), "not") > 0, F.lit(0)).otherwise(F.lit(1))


def default_category(col, kind: str) -> Column:
    if kind == "null":
        return _c(col)
    if kind == "none_string":
        return F.coalesce(_c(col), F.lit("None"))
    if kind == "blank":
        return F.coalesce(_c(col), F.lit(""))
    raise ValueError(kind)


def qa_prompt(question, context) -> Column:
    return F.format_string(QA_FORMAT, py_str(question), py_str(context))


def demo_text(prompt, answer) -> Column:
    return F.format_string(DEMO_FORMAT, py_str(prompt), py_str(answer))


def run_key(model, task, strategy) -> Column:
    """Last path segment of model and task, then the strategy."""
    return F.concat_ws(
        "-", F.substring_index(_c(model), "/", -1), F.substring_index(_c(task), "/", -1), _c(strategy)
    )


def mark_seen(model, dataset, datasets: Sequence[str], families: Sequence[str]) -> Column:
    """Prefix the model name where the dataset is listed and the name
    contains one of the families (each family applied in turn)."""
    out = _c(model)
    for fam in families:
        out = F.when(_c(dataset).isin(list(datasets)) & (F.instr(out, fam) > 0),
                     F.concat(F.lit(SEEN_PREFIX), out)).otherwise(out)
    return out


def render_templates(df, templates: dict[str, tuple[str, str]], keep: Sequence[str] = ()):
    """Apply every named template (input and label as Spark SQL expressions);
    rows whose template yields a NULL part are dropped.  All templates of a row
    come out of one pass: what ``df`` joins or groups runs once."""
    rows = F.array(*[F.struct(F.lit(name).alias("template"), F.expr(inp).alias("input"), F.expr(lab).alias("label"))
                     for name, (inp, lab) in templates.items()])
    out = df.select(*keep, F.explode(rows).alias("_t")).select(*keep, "_t.*")
    return out.where(F.col("input").isNotNull() & F.col("label").isNotNull())
