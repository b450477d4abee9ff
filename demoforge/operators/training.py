"""Training-set construction: demonstration counts, informative / random /
hardest demonstrations, the character guard, primed prompts.

Positions replace list indices: ``cat_pos`` within a category (two-level
dense index, see ``windows``) or ``pos`` over all rows.  Demonstrations are
joined by (category, position); only ids and lengths travel through the
shuffles, the texts are attached once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demoforge.functions.draws import draw, draw_between
from demoforge.functions.text import demo_text, py_words
from demoforge.operators.scorer import BatchScorer, score_keyed
from demoforge.operators.windows import category_index, dense_index
from demoforge.session import cut_lineage

MIN_DEMOS, MAX_DEMOS = 2, 5
MAX_INPUT_CHARS = 8000
CANDIDATES = 64


def demo_counts(samples: DataFrame, lo: int = MIN_DEMOS, hi: int = MAX_DEMOS, seed=0) -> DataFrame:
    """Number of demonstrations per sample, uniform in [lo, hi]."""
    return samples.withColumn("n_demos", draw_between(lo, hi, F.lit(str(seed)), F.lit("n"), F.col("idx")).cast("bigint"))


def _slots(df: DataFrame) -> DataFrame:
    return df.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("n_demos") - 1)))


def _finish(picked: DataFrame, samples: DataFrame, max_chars: int, prompt: str, answer: str) -> DataFrame:
    """Group the picks per sample, apply the character guard (checked before
    each addition, so the last demo is never checked) and attach texts."""
    per = picked.groupBy("idx", "n_demos").agg(F.sort_array(F.collect_list(F.struct("slot", "demo_idx", "demo_len")))
                                               .alias("_d"))
    lens = F.transform("_d", lambda d: d["demo_len"])
    before_last = F.aggregate(F.slice(lens, 1, F.col("n_demos") - 1), F.lit(0).cast("bigint"),
                              lambda a, x: a + x)
    per = per.where((F.size("_d") == F.col("n_demos")) & (before_last <= max_chars))
    ids = per.select("idx", "n_demos", F.transform("_d", lambda d: d["demo_idx"]).alias("demo_idxs"),
                     F.aggregate(lens, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("demos_chars"))
    s = samples.select("idx", F.col(prompt).alias("_prompt"), F.col(answer).alias("_answer"))
    return ids.join(s, "idx")


def _demo_rows(ci: DataFrame, prompt: str, answer: str, pos_col: str) -> DataFrame:
    return ci.select("category", F.col(pos_col).alias("sel"), F.col("idx").alias("demo_idx"),
                     F.char_length(demo_text(prompt, answer)).cast("bigint").alias("demo_len"))


def informative_sets(samples: DataFrame, lo=MIN_DEMOS, hi=MAX_DEMOS, seed=0, max_chars=MAX_INPUT_CHARS,
                     prompt: str = "input", answer: str = "label") -> DataFrame:
    """Per slot a draw from positions 1..n-1 of the sample's category; the
    position before it when the draw hits the sample; categories of one row
    give no set (position 0 only ever comes from that fallback)."""
    ci = category_index(samples.select("idx", "category", prompt, answer))
    ci = cut_lineage(ci)
    s = demo_counts(ci.where(F.col("cat_size") > 1).select("idx", "category", "cat_pos", "cat_size"), lo, hi, seed)
    s = _slots(s)
    sel = F.lit(1) + draw(F.lit(str(seed)), F.lit("informative"), F.col("idx"), F.col("slot"), n=F.col("cat_size") - 1)
    s = s.withColumn("sel", F.when(sel == F.col("cat_pos"), sel - 1).otherwise(sel))
    picked = s.join(_demo_rows(ci, prompt, answer, "cat_pos"), ["category", "sel"])
    return _finish(picked, samples, max_chars, prompt, answer)


def random_sets(samples: DataFrame, lo=MIN_DEMOS, hi=MAX_DEMOS, seed=0, max_chars=MAX_INPUT_CHARS,
                prompt: str = "input", answer: str = "label") -> DataFrame:
    """Per slot a draw from positions 1..n-1 of all rows; the position
    before it when the draw hits the sample."""
    ix = dense_index(samples.select("idx", prompt, answer), "idx", out="pos", size_out="n")
    ix = cut_lineage(ix.withColumn("category", F.lit(0)))
    s = _slots(demo_counts(ix.select("idx", "category", "pos", "n").where(F.col("n") > 1), lo, hi, seed))
    sel = F.lit(1) + draw(F.lit(str(seed)), F.lit("random"), F.col("idx"), F.col("slot"), n=F.col("n") - 1)
    s = s.withColumn("sel", F.when(sel == F.col("pos"), sel - 1).otherwise(sel))
    picked = s.join(_demo_rows(ix, prompt, answer, "pos"), ["category", "sel"])
    return _finish(picked, samples, max_chars, prompt, answer)


def unigram_log_score(prompt_words: Column, target_words: Column) -> Column:
    """Stand-in log-likelihood of the target given the prompt:
    sum_w ln((count of w in prompt + 1) / (|prompt| + |distinct| + 1)).
    Counting uses ``array_remove`` (generated code), the lambda runs only
    over the few target words."""
    return _unigram_counted(F.size(prompt_words), F.size(F.array_distinct(prompt_words)), prompt_words, target_words)


def _unigram_counted(n: Column, v: Column, hits: Column, target_words: Column) -> Column:
    """``unigram_log_score`` of a prompt of ``n`` words, ``v`` different ones;
    ``hits`` are its words, at least those of the target."""
    return F.aggregate(
        target_words, F.lit(0.0),
        lambda acc, w: acc + F.log((F.size(hits) - F.size(F.array_remove(hits, w)) + 1) / (n + v + 1)),
    )


unigram_log_score.counted = _unigram_counted


def unigram_score(prompt_words: Column, target_words: Column) -> Column:
    return F.exp(unigram_log_score(prompt_words, target_words))


def argmin_candidate(cands: DataFrame, by: str, cand: str, score: str, draw_no: str) -> DataFrame:
    """Per ``by`` the candidate with the lowest score, lowest draw on ties."""
    return cands.groupBy(by).agg(F.min_by(cand, F.struct(score, draw_no)).alias(cand),
                                 F.min(score).alias(score))


class _WordPairs:
    """What a column scorer reads: the words of the prompt and of the target.

    A scorer with ``target_words_only`` looks for target words in the prompt and
    at nothing else of it: its prompts are cut to the words that are some
    sample's target word before they meet any candidate."""

    carried = {"_dw": "array<string>"}

    def __init__(self, scorer):
        self.scorer = scorer
        self.target_words_only = getattr(scorer, "target_words_only", False)

    def inputs(self, samples: DataFrame, prompt: str, answer: str) -> DataFrame:
        if self.target_words_only:
            return _target_word_inputs(samples, prompt, answer)
        return cut_lineage(category_index(samples.select("idx", "category", prompt, answer)).withColumn(
            "_w", F.concat(py_words(prompt), py_words(answer))).withColumn(
            "_len", F.char_length(demo_text(prompt, answer)).cast("bigint")).withColumn(
            "_own", py_words(prompt)).withColumn("_tw", py_words(answer)))

    def grown(self) -> dict[str, Column]:
        return {"_dw": F.concat("_dw", "_w")}

    def best(self, picks: DataFrame, active: DataFrame, ci: DataFrame) -> DataFrame:
        words = ci.select(F.col("idx").alias("_cid"), F.col("_w").alias("_cw"))
        asked = picks.join(words, "_cid").join(active.select("idx", "_dw", "_pw", "_tw"), "idx")
        scored = asked.select("idx", "_r", "_cid", self.scorer(F.concat("_dw", "_cw", "_pw"), F.col("_tw")).alias("_s"))
        return scored.groupBy("idx").agg(F.min_by("_cid", F.struct("_s", "_r")).alias("_cid"))


def _digest(text: Column) -> Column:
    """Stands for a text in a list of texts: its length and 128-bit digest."""
    return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), F.md5(text)), F.lit("none"))


class _TextPairs:
    """What a batch scorer reads: the primed prompt and the target as texts.

    Rounds hold digests; the texts of pairs that need a score are joined by id
    and digest on their way to the model.  A pair is the list of its texts."""

    carried = {"_dd": "array<string>"}

    def __init__(self, scorer: BatchScorer):
        self.scorer = scorer

    def inputs(self, samples: DataFrame, prompt: str, answer: str) -> DataFrame:
        self.demo, self.own, self.target = demo_text(prompt, answer), F.col(prompt), F.col(answer)
        self.texts = cut_lineage(samples.select("idx", "category", prompt, answer).withColumn(
            "_w", _digest(self.demo)).withColumn("_own", _digest(self.own)).withColumn("_tw", _digest(self.target)))
        return cut_lineage(category_index(self.texts.select("idx", "category", "_w", "_own", "_tw", F.char_length(self.demo)
                                                            .cast("bigint").alias("_len"))))

    def grown(self) -> dict[str, Column]:
        return {"_dd": F.concat("_dd", F.array("_w"))}

    def best(self, picks: DataFrame, active: DataFrame, ci: DataFrame) -> DataFrame:
        side = F.concat_ws("|", F.concat_ws(",", "_dd"), "_pw", "_tw")
        words = ci.select(F.col("idx").alias("_cid"), F.col("_w").alias("_cw"))
        asked = cut_lineage(picks.join(words, "_cid").join(
            active.select("idx", "_ids", "_dd", "_pw", "_tw", F.md5(side).alias("_side")), "idx").withColumn(
            "pair_id", F.md5(F.concat_ws("|", side, "_cw"))))
        todo = asked.groupBy("pair_id").agg(F.min(F.struct("idx", "_cid", "_cw", "_side", "_ids", "_dd", "_pw", "_tw")).alias("_a"))
        todo = todo.select("pair_id", "_a.*")
        got = score_keyed(asked.select("idx", "_r", "_cid", "pair_id"), todo, self.scorer, self._texts, "_s")
        got = got.withColumn("_s", F.coalesce("_s", F.lit(float("inf"))))
        return got.groupBy("idx").agg(F.min_by("_cid", F.struct("_s", "_r")).alias("_cid"))

    def _texts(self, missing: DataFrame) -> DataFrame:
        """Pairs with their texts: a sample's own and its demonstrations' meet
        once a sample, then every candidate's text moves once a pair."""
        missing = cut_lineage(missing)
        sides = cut_lineage(missing.select("_side", "idx", "_ids", "_dd", "_pw", "_tw").dropDuplicates(["_side"]))
        used = sides.select("_side", F.posexplode(F.arrays_zip("_ids", "_dd")).alias("_k", "_d")).select(
            "_side", "_k", F.col("_d._ids").alias("_cid"), F.col("_d._dd").alias("_cw"))

        def demos(of: DataFrame) -> DataFrame:
            return _only(self.texts, of.select(F.col("_cid").alias("idx"))).select(
                F.col("idx").alias("_cid"), F.col("_w").alias("_cw"), self.demo.alias("_text")).dropDuplicates(["_cid", "_cw"])

        own = _only(self.texts, sides.select("idx")).select("idx", F.col("_own").alias("_pw"), "_tw", self.own.alias("_prompt"), F.coalesce(
            self.target, F.lit("")).alias("target")).dropDuplicates(["idx", "_pw", "_tw"])
        primed = used.join(demos(used), ["_cid", "_cw"]).groupBy("_side").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_text"))), lambda x: x["_text"]), " ").alias("_demos"))
        sides = sides.select("_side", "idx", "_pw", "_tw").join(own, ["idx", "_pw", "_tw"]).join(primed, "_side", "left") \
            .select("_side", "_demos", "_prompt", "target")
        return missing.select("model", "pair_id", "_side", "_cid", "_cw").join(demos(missing), ["_cid", "_cw"]).select(
            "model", "pair_id", "_side", "_text").join(sides, "_side").select(
            "model", "pair_id", F.concat_ws(" ", "_demos", "_text", "_prompt").alias("prompt"), "target")


#: ids up to this number are broadcast to the scan that fetches their texts
BROADCAST_IDS = 500_000


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of some ids: few ids go to the scan, so that the texts of others do
    not move; with many, all move to the join that follows."""
    ids = cut_lineage(ids.distinct())
    return texts.join(F.broadcast(ids), "idx", "left_semi") if ids.count() <= BROADCAST_IDS else texts


class _CountPairs:
    """What a scorer of counts reads: the number of words, of different words
    and the target words among them (its attribute ``counted``, a column
    function of the three and the target that never grows with the second).

    All but the different words of a prompt add up over its parts; these lie
    between the most of a part and the sum.  A round scores both ends for every
    candidate and keeps those that may be the lowest; only where several are
    left, words are joined and counted."""

    carried: dict[str, str] = {}

    def __init__(self, scorer):
        self.scorer = scorer.counted

    def inputs(self, samples: DataFrame, prompt: str, answer: str) -> DataFrame:
        self.words = F.concat(py_words(prompt), py_words(answer))
        self.own_words, target = py_words(prompt), py_words(answer)
        self.texts = cut_lineage(samples.select("idx", "category", prompt, answer, F.monotonically_increasing_id().alias("_row")))
        held = self.texts.select("_row", F.explode(self.own_words).alias("_word")).join(
            _target_words(self.texts, answer), "_word", "left_semi").groupBy("_row").agg(F.collect_list("_word").alias("_held"))

        def counts(words: Column) -> list[Column]:
            v = F.size(F.array_distinct(words))
            return [F.size(words).alias("n"), v.alias("lo"), v.alias("hi")]

        slim = self.texts.select(
            "_row", "idx", "category", target.alias("_tw"), F.char_length(demo_text(prompt, answer)).cast("bigint").alias("_len"),
            F.struct(*counts(self.own_words)).alias("_own"), F.struct(*counts(self.words)).alias("_w")).join(held, "_row", "left")
        hits = F.coalesce("_held", F.array().cast("array<string>"))
        return cut_lineage(category_index(slim.withColumn("_own", F.struct("_own.*", hits.alias("hits"))).withColumn(
            "_w", F.struct("_w.*", F.concat(hits, "_tw").alias("hits"))).drop("_row", "_held")))

    @staticmethod
    def _sum(a: str, b: str) -> Column:
        """Counts of two parts together; a missing one leaves them missing."""
        return F.struct((F.col(f"{a}.n") + F.col(f"{b}.n")).alias("n"), F.greatest(f"{a}.lo", f"{b}.lo").alias("lo"),
                        (F.col(f"{a}.hi") + F.col(f"{b}.hi")).alias("hi"), F.concat(f"{a}.hits", f"{b}.hits").alias("hits"))

    def grown(self) -> dict[str, Column]:
        return {"_pw": self._sum("_pw", "_w")}

    def _score(self, counts: str, different: Column) -> Column:
        return self.scorer(F.col(f"{counts}.n"), different, F.col(f"{counts}.hits"), F.col("_tw"))

    def best(self, picks: DataFrame, active: DataFrame, ci: DataFrame) -> DataFrame:
        words = ci.select(F.col("idx").alias("_cid"), "_w")
        rows = picks.join(words, "_cid").join(active.select("idx", "_pw", "_tw"), "idx").withColumn("_n", self._sum("_pw", "_w"))
        ends = rows.select("idx", F.struct(self._score("_n", F.col("_n.hi")).alias("low"), self._score("_n", F.col("_n.lo")).alias("high"),
                                           "_r", "_cid").alias("_c"))
        lists = ends.groupBy("idx").agg(F.collect_set("_c").alias("_l"))
        # a missing score is the lowest of all
        missing = F.exists("_l", lambda c: c["low"].isNull())
        bar = F.array_min(F.transform("_l", lambda c: c["high"]))
        left = F.when(missing, F.filter("_l", lambda c: c["low"].isNull())).otherwise(
            F.filter(F.zip_with("_l", F.array_repeat(bar, F.size("_l")), lambda c, b: F.when(c["low"] <= b, c)), lambda c: c.isNotNull()))
        lists = cut_lineage(lists.select("idx", left.alias("_l")))
        known = (F.size("_l") == 1) | F.forall("_l", lambda c: c["low"].eqNullSafe(c["high"]))
        settled = lists.where(known).select("idx", F.array_min(F.transform("_l", lambda c: F.struct(
            c["low"].alias("_s"), c["_r"].alias("_r"), c["_cid"].alias("_cid")))).alias("_b"))
        rest = self._counted(cut_lineage(lists.where(~known)), active, ci)
        return settled.unionByName(rest).select("idx", F.col("_b._cid").alias("_cid"))

    def _counted(self, lists: DataFrame, active: DataFrame, ci: DataFrame) -> DataFrame:
        """The lowest of several candidates by their exact scores."""
        asked = lists.select("idx", F.explode("_l").alias("_c")).select("idx", "_c._cid", "_c._r")
        ids = lists.select("idx").join(active.select("idx", "_ids"), "idx").dropDuplicates(["idx"])
        used = ids.select("idx", F.explode("_ids").alias("_cid"))

        def words(of: DataFrame) -> DataFrame:
            return _only(self.texts, of.select(F.col("_cid").alias("idx"))).select(
                F.col("idx").alias("_cid"), F.array_distinct(self.words).alias("_words"))

        held = used.join(words(used), "_cid").groupBy("idx").agg(
            F.array_distinct(F.flatten(F.collect_list("_words"))).alias("_demo_words"))
        own = _only(self.texts, lists.select("idx")).select("idx", self.own_words.alias("_own_words")).dropDuplicates(["idx"])
        held = own.join(held, "idx", "left").select("idx", F.array_distinct(F.concat(
            "_own_words", F.coalesce("_demo_words", F.array().cast("array<string>")))).alias("_have"))
        # words of a candidate that the prompt does not hold are counted, and leave at once
        added = asked.join(words(asked), "_cid").join(held, "idx").select(
            "idx", "_cid", "_r", (F.size("_have") + F.size(F.array_except("_words", "_have"))).alias("_v"))
        rows = added.join(ci.select(F.col("idx").alias("_cid"), "_w"), "_cid").join(active.select("idx", "_pw", "_tw"), "idx") \
            .withColumn("_n", self._sum("_pw", "_w"))
        return rows.groupBy("idx").agg(F.min(F.struct(self._score("_n", F.col("_v")).alias("_s"), "_r", "_cid")).alias("_b"))


def _pairs_of(scorer):
    if isinstance(scorer, BatchScorer):
        return _TextPairs(scorer)
    return _CountPairs(scorer) if hasattr(scorer, "counted") else _WordPairs(scorer)


def _hard_inputs(samples: DataFrame, prompt: str, answer: str, kind) -> DataFrame:
    """Indexed samples with what a candidate adds to a prompt (``_w``), what the
    sample's own prompt (``_own``) and its target (``_tw``) stand for."""
    return kind.inputs(samples, prompt, answer)


#: distinct target words up to this number are broadcast to the scan of the texts
BROADCAST_WORDS = 200_000


def _target_words(ci: DataFrame, answer: str) -> DataFrame:
    words = cut_lineage(ci.select(F.explode(py_words(answer)).alias("_word")).distinct())
    return F.broadcast(words) if words.count() <= BROADCAST_WORDS else words


def _target_word_inputs(samples: DataFrame, prompt: str, answer: str) -> DataFrame:
    """``_hard_inputs`` whose words are target words only, each once.  Texts are
    read by one scan; a missing text stays a missing list."""
    ci = cut_lineage(category_index(samples.select("idx", "category", prompt, answer)))
    row = F.struct("category", "cat_pos").alias("_row")
    held = ci.select(row, F.explode(F.array_distinct(py_words(prompt))).alias("_word")).join(_target_words(ci, answer), "_word", "left_semi") \
        .groupBy("_row").agg(F.collect_list("_word").alias("_held"))
    slim = ci.select("idx", "category", "cat_pos", "cat_size", answer, row, F.col(prompt).isNull().alias("_none"),
                     F.char_length(demo_text(prompt, answer)).cast("bigint").alias("_len"))
    own = F.when(~F.col("_none"), F.coalesce("_held", F.array().cast("array<string>")))
    return cut_lineage(slim.join(held, "_row", "left").withColumn("_own", own).withColumn(
        "_w", F.concat("_own", py_words(answer))).withColumn("_tw", py_words(answer)).drop("_row", "_none", "_held"))


def _hard_state(ci: DataFrame, lo: int, hi: int, seed, kind) -> DataFrame:
    return demo_counts(ci.where(F.col("cat_size") > 1), lo, hi, seed).select(
        "idx", "category", "cat_size", "n_demos",
        F.col("_own").alias("_pw"), "_tw", *[F.array().cast(t).alias(name) for name, t in kind.carried.items()],
        F.array().cast("array<bigint>").alias("_ids"),
        F.lit(0).cast("bigint").alias("_chars"), F.lit(True).alias("_ok"))


def _hard_round(state: DataFrame, ci: DataFrame, slot: int, candidates: int, max_chars: int, seed, kind) -> DataFrame:
    """One more demonstration for every sample that still wants one.

    Candidates are drawn as positions and resolved to ids first; a candidate
    drawn again for a sample keeps its lowest draw number, and what is scored
    joins only the different (sample, candidate) pairs."""
    active = state.where((F.col("n_demos") > slot) & F.col("_ok"))
    done = state.where(~((F.col("n_demos") > slot) & F.col("_ok")))
    draws = active.where(F.col("_chars") <= max_chars).select("idx", "category", "cat_size").withColumn(
        "_r", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1)))).withColumn(
        "_cpos", draw(F.lit(str(seed)), F.lit("hard"), F.col("idx"), F.lit(slot), F.col("_r"), n=F.col("cat_size")))
    at = ci.select("category", F.col("cat_pos").alias("_cpos"), F.col("idx").alias("_cid"))
    picks = cut_lineage(draws.groupBy("idx", "category", "_cpos").agg(F.min("_r").alias("_r"))
                        .join(at, ["category", "_cpos"]).select("idx", "_cid", "_r"))
    # ids only through the aggregate, what the winner adds is fetched by one
    # join; a demo that is the hardest for very many samples is a skewed key
    # there, split at run time by adaptive execution's skew-join handling
    best = cut_lineage(kind.best(picks, active, ci))
    adds = ci.select(F.col("idx").alias("_cid"), "_w", F.col("_len").alias("_clen"))
    won, changed = F.col("_cid").isNotNull(), kind.grown()
    kept = [c for c in ("_pw", "_tw", *kind.carried) if c not in changed]
    grown = active.join(best.join(adds, "_cid"), "idx", "left").select(
        "idx", "category", "cat_size", "n_demos", *kept,
        *[F.when(won, c).otherwise(F.col(name)).alias(name) for name, c in changed.items()],
        F.when(won, F.concat("_ids", F.array(F.col("_cid")))).otherwise(F.col("_ids")).alias("_ids"),
        (F.col("_chars") + F.coalesce(F.col("_clen"), F.lit(0))).alias("_chars"),
        won.alias("_ok"))
    return cut_lineage(done.unionByName(grown))


def hard_sets(samples: DataFrame, lo=MIN_DEMOS, hi=MAX_DEMOS, seed=0, candidates=CANDIDATES,
              max_chars=MAX_INPUT_CHARS, prompt: str = "input", answer: str = "label",
              scorer=unigram_log_score) -> DataFrame:
    """Per slot draw ``candidates`` rows of the category (with replacement,
    the sample itself included), score the prompt primed with the demos so
    far plus each candidate, keep the least likely (lowest draw on ties).
    Slots are unrolled rounds, each written once.

    ``scorer`` is a column function of (prompt words, target words), with the
    attribute ``target_words_only`` if it reads no other word of a prompt or
    ``counted`` if counts are all it reads, or a ``BatchScorer``, a model over
    the primed prompt's text and the answer; lower means harder.  Returns ``(idx, n_demos, demo_idxs, demos_chars,
    _prompt, _answer)`` for samples whose demos all fit."""
    kind = _pairs_of(scorer)
    ci = _hard_inputs(samples, prompt, answer, kind)
    state = _hard_state(ci, lo, hi, seed, kind)
    for slot in range(hi):
        state = _hard_round(state, ci, slot, candidates, max_chars, seed, kind)
    out = state.where(F.col("_ok") & (F.size("_ids") == F.col("n_demos")))
    s = samples.select("idx", F.col(prompt).alias("_prompt"), F.col(answer).alias("_answer"))
    return out.select("idx", "n_demos", F.col("_ids").alias("demo_idxs"), F.col("_chars").alias("demos_chars")) \
        .join(s, "idx")


def hardest_demo(samples: DataFrame, lo=MIN_DEMOS, hi=MAX_DEMOS, seed=0, candidates=CANDIDATES, max_chars=MAX_INPUT_CHARS,
                 prompt: str = "input", answer: str = "label", scorer=unigram_log_score) -> DataFrame:
    """The hardest single demonstration of every sample: ``(idx, n_demos,
    first_demo)``."""
    kind = _pairs_of(scorer)
    ci = _hard_inputs(samples, prompt, answer, kind)
    one = _hard_round(_hard_state(ci, lo, hi, seed, kind), ci, 0, candidates, max_chars, seed, kind)
    return one.where("_ok").select("idx", "n_demos", F.get("_ids", 0).alias("first_demo"))


def shared_word_score(prompt_words: Column, target_words: Column) -> Column:
    """How many of the target's words the prompt holds."""
    return F.size(F.filter(target_words, lambda w: F.array_contains(prompt_words, w))).cast("double")


shared_word_score.target_words_only = True


def with_primed_prompt(sets: DataFrame, samples: DataFrame, prompt: str = "input", answer: str = "label",
                       out: str = "primed") -> DataFrame:
    """Attach the demonstration texts (once, by id) and build the prompt:
    demos joined by a blank, a blank, the sample's prompt."""
    ex = sets.select("idx", F.posexplode("demo_idxs").alias("_k", "demo_idx"))
    texts = samples.select(F.col("idx").alias("demo_idx"), demo_text(prompt, answer).alias("_t"))
    g = ex.join(texts, "demo_idx").groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("_k", "_t"))).alias("_l"))
    g = g.select("idx", F.array_join(F.transform("_l", lambda x: x["_t"]), " ").alias("_demos"))
    return sets.join(g, "idx").withColumn(out, F.concat("_demos", F.lit(" "), F.col("_prompt"))).drop("_demos")
