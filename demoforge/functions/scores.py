"""Per-row scores of (expected, predicted) text pairs, as JVM-side columns.

Every metric of the evaluation is a mean of one of these per-row values, so
a grouped ``avg`` gives it and a bootstrap only has to average picks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

MAX_FOLD_WORDS = 62  # bit-parallel LCS on one BIGINT: 62 positions, no overflow


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def exact_match(expected, predicted) -> Column:
    """1.0 when the texts are equal, else 0.0 (sensitivity accuracy)."""
    return _c(expected).eqNullSafe(_c(predicted)).cast("double")


def folded_match(expected, predicted) -> Column:
    """1.0 when equal after lower-casing both (evaluator accuracy)."""
    return F.lower(_c(expected)).eqNullSafe(F.lower(_c(predicted))).cast("double")


from demoforge.functions.text import PY_WS, py_words as words  # noqa: E402


def _f_from_sets(expected_set: Column, predicted_words: Column) -> Column:
    tp = F.size(F.filter(predicted_words, lambda w: F.array_contains(expected_set, w)))
    fp = F.size(predicted_words) - tp
    fn = F.size(F.filter(expected_set, lambda e: ~F.array_contains(predicted_words, e)))
    denom = tp + F.lit(0.5) * (fp + fn)
    return F.when(denom > 0, tp / denom)


def char_f1(expected, predicted, fold: bool = True) -> Column:
    """F-score as the evaluator computes it: the expected "tokens" are the
    distinct non-blank *characters* of the expected text (it iterates the
    string), the predicted tokens are its words, counted with repeats."""
    e, p = _c(expected), _c(predicted)
    if fold:
        e, p = F.lower(e), F.lower(p)
    chars = F.array_distinct(F.filter(F.split(e, ""), lambda ch: (ch != "") & ~ch.rlike(f"^{PY_WS}$")))
    return _f_from_sets(chars, words(p))


def token_f1(expected, predicted, fold: bool = True) -> Column:
    """The same F-score on expected *words* (what its comment intends)."""
    e, p = _c(expected), _c(predicted)
    if fold:
        e, p = F.lower(e), F.lower(p)
    return _f_from_sets(F.array_distinct(words(e)), words(p))


def rouge_tokens(text) -> Column:
    """ROUGE tokens: lower-cased runs of ``[a-z0-9]``."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+"), 0)


def _lcs_fold(exp_tokens: Column, pred_tokens: Column) -> Column:
    """LCS length by the bit-parallel recurrence on one BIGINT.

    V starts with the low m bits set; per predicted token with match mask M
    (bit i set where expected token i equals it):
    V = ((V + (V & M)) | (V & ~M)) & full.  LCS = m - popcount(V).
    """
    m = F.size(exp_tokens)
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    full = F.call_function("shiftleft", one, m) - 1

    def mask(w):
        bits = F.transform(exp_tokens, lambda x, i: F.when(x == w, F.call_function("shiftleft", one, i)).otherwise(zero))
        return F.aggregate(bits, zero, lambda a, b: a.bitwiseOR(b))

    def step(v, mk):
        return ((v + v.bitwiseAND(mk)).bitwiseOR(v.bitwiseAND(F.bitwise_not(mk)))).bitwiseAND(full)

    v = F.aggregate(F.transform(pred_tokens, mask), full, step)
    return m - F.bit_count(v)


@F.pandas_udf(LongType())
def _lcs_long(exp_tokens: pd.Series, pred_tokens: pd.Series) -> pd.Series:
    """Same recurrence with Python integers, for expected texts of any length."""
    out = []
    for e, p in zip(exp_tokens, pred_tokens):
        if e is None or p is None:
            out.append(None)
            continue
        e = list(e)
        m = len(e)
        masks: dict = {}
        for i, w in enumerate(e):
            masks[w] = masks.get(w, 0) | (1 << i)
        full = (1 << m) - 1
        v = full
        for w in p:
            mk = masks.get(w, 0)
            v = ((v + (v & mk)) | (v & ~mk)) & full
        out.append(m - bin(v).count("1"))
    return pd.Series(out, dtype="Int64")


def lcs_length(exp_tokens: Column, pred_tokens: Column) -> Column:
    """Longest common subsequence length of two token arrays.

    Expected sides up to 62 tokens run in the JVM; only longer rows are sent
    (as values, the rest as NULLs) to the Arrow-batched Python fallback.
    """
    short = F.size(exp_tokens) <= MAX_FOLD_WORDS
    long_e = F.when(~short, exp_tokens)
    long_p = F.when(~short, pred_tokens)
    return F.when(short, _lcs_fold(exp_tokens, pred_tokens)).otherwise(_lcs_long(long_e, long_p))


def rouge_l(expected, predicted) -> Column:
    """ROUGE-L F: 2PR/(P+R), P = lcs/|pred|, R = lcs/|exp|; 0 if either is empty.

    The reference takes ROUGE from an external package; this variant (LCS F on
    lower-cased alphanumeric tokens) is our stated definition.
    """
    e, p = rouge_tokens(expected), rouge_tokens(predicted)
    lcs = lcs_length(e, p)
    ne, np_ = F.size(e), F.size(p)
    return F.when((ne == 0) | (np_ == 0) | (lcs == 0), F.lit(0.0)).otherwise(
        F.lit(2.0) * lcs / (ne + np_)
    )


METRICS = {
    "accuracy_exact": exact_match,
    "accuracy_folded": folded_match,
    "char_f1": char_f1,
    "token_f1": token_f1,
    "rouge_l": rouge_l,
}


def metric_column(name: str, expected, predicted) -> Column:
    try:
        return METRICS[name](expected, predicted)
    except KeyError:
        raise ValueError(f"metric must be a function of two columns or one of {sorted(METRICS)}, not {name!r}") from None


def with_score(df, metric, expected, predicted, out: str = "score"):
    """Add ``out`` = per-row ``metric``, staging token arrays as columns first.

    Lambdas of higher-order functions are interpreted, and an expression
    that names the same token array several times would tokenise it again
    for each mention; a separate (non-cheap) projection is not inlined by
    the optimizer, so each array is built once per row."""
    e, p = _c(expected), _c(predicted)
    if callable(metric):
        return df.withColumn(out, metric(e, p))
    et, pt, lc = f"_et_{out}", f"_pt_{out}", f"_lcs_{out}"
    if metric == "rouge_l":
        df = df.withColumn(et, rouge_tokens(e)).withColumn(pt, rouge_tokens(p))
        df = df.withColumn(lc, lcs_length(F.col(et), F.col(pt)))
        ne, np_ = F.size(et), F.size(pt)
        val = F.when((ne == 0) | (np_ == 0) | (F.col(lc) == 0), F.lit(0.0)).otherwise(F.lit(2.0) * F.col(lc) / (ne + np_))
        return df.withColumn(out, val).drop(et, pt, lc)
    if metric in ("char_f1", "token_f1"):
        le, lp = F.lower(e), F.lower(p)
        if metric == "char_f1":
            eset = F.array_distinct(F.filter(F.split(le, ""), lambda ch: (ch != "") & ~ch.rlike(f"^{PY_WS}$")))
        else:
            eset = F.array_distinct(words(le))
        df = df.withColumn(et, eset).withColumn(pt, words(lp))
        return df.withColumn(out, _f_from_sets(F.col(et), F.col(pt))).drop(et, pt)
    return df.withColumn(out, metric_column(metric, e, p))
