"""Overlap neighbours: per question the K others with the highest
|A & B| / max(|A|, |B|) (> 0), ties by the smaller id.

Pairs come from a self-join on shared facts, but only through *light*
facts (held by at most ``max_fanout`` questions), so no fact emits more than
``max_fanout``^2 pairs.  Heavy facts (at most incidences / max_fanout of
them, a bounded list) are handled without pairs: a candidate reached only
through heavy facts scores ``|Hq & Hc| / max(|A|, |C|)``, which depends on
the candidate only through its signature (heavy-fact set, size).  Members of
a signature group are ranked once (two-level dense index), and a question
takes from each relevant group just the first K members plus the ones it
must skip (itself and its light-pair partners, which carry their full score).

A question's K-th best light score is a threshold for the heavy side: a
candidate reached through heavy facts alone scores at most |Hq| / max(|A|, |C|),
so a question whose threshold is above |Hq| / |A| never meets a heavy fact, and
the others meet only groups of sets small enough to reach their threshold.

A question without heavy facts needs no list of all its pairs either.  A
partner that shares one fact scores 1 / max(|A|, |C|) and is beaten by whoever
stands before it in that fact's list by (max(|A|, |C|), id), so the first K of
each list are enough; partners that share more are found through pairs of
facts, and scored on the whole sets.  This is done where it makes fewer rows
than the pairs, which is counted first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demoforge.operators.windows import dense_index
from demoforge.session import cut_lineage

MAX_FANOUT = 1000


def overlap_neighbours(df: DataFrame, key: str, items: str, k: int = 3,
                       max_fanout: int | None = None) -> DataFrame:
    """``(key, rank, other, score)`` for the top ``k`` others of each row."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    sets = cut_lineage(df.select(F.col(key).alias("q"), F.array_distinct(items).alias("A")).where(F.size("A") > 0))
    inc = sets.select("q", F.size("A").alias("na"), F.explode("A").alias("f"))
    fanout = max_fanout or MAX_FANOUT
    # heavy facts stay a table: incidences are marked by a join salted on the
    # question id, so a fact held by a third of all questions is split over
    # the shuffle partitions instead of landing in one task
    heavy_tab = inc.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fanout) \
        .select("f", F.lit(True).alias("hv"))
    marked = inc.withColumn("_salt", F.pmod(F.xxhash64("q"), F.lit(parts))).join(
        heavy_tab.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["f", "_salt"], "left") \
        .select("q", "na", "f", F.coalesce("hv", F.lit(False)).alias("hv"))
    marked = cut_lineage(marked)
    has_heavy = not marked.where("hv").isEmpty()
    heavy_sets = marked.where("hv").groupBy("q").agg(F.array_sort(F.collect_list("f")).alias("H"))
    elem = sets.schema["A"].dataType.elementType.simpleString()
    sizes = sets.select("q", F.size("A").alias("na")).join(heavy_sets, "q", "left") \
        .select("q", "na", F.coalesce("H", F.array().cast(f"array<{elem}>")).alias("H"))

    # 1. pairs through light facts, scored with their full overlap
    light = marked.where(~F.col("hv") & F.col("f").isNotNull()).select("q", "na", "f")
    hq = marked.where("hv").select("q").distinct()
    members = light.join(hq.withColumn("plain", F.lit(False)), "q", "left").select(
        "q", "na", "f", F.coalesce("plain", F.lit(True)).alias("plain")) if has_heavy else light.withColumn("plain", F.lit(True))
    plain_cands = _plain_candidates(members, k)
    if plain_cands is not None and not has_heavy:
        return _top(plain_cands, key, k)
    asking_pairs = light if plain_cands is None else light.join(hq, "q", "left_semi")
    lp = asking_pairs.alias("x").join(light.alias("y"), "f").where(F.col("x.q") != F.col("y.q")) \
        .groupBy(F.col("x.q").alias("q"), F.col("y.q").alias("c")).agg(F.count(F.lit(1)).alias("sl"))
    lp = lp.join(sizes, "q").join(sizes.select(F.col("q").alias("c"), F.col("na").alias("nc"),
                                               F.col("H").alias("Hc")), "c")
    lp = lp.withColumn("shared", F.col("sl") + F.size(F.array_intersect("H", "Hc")))
    # read three times below
    lp = cut_lineage(lp.select("q", "c", "na", "nc", "Hc", "shared"))
    light_scored = lp.select("q", "c", (F.col("shared") / F.greatest("na", "nc")).alias("score"))
    cands = light_scored if plain_cands is None else light_scored.unionByName(plain_cands)
    if has_heavy:
        # 2. heavy-only candidates through signature groups
        sig = sizes.where(F.size("H") > 0).select(
            "q", "na", "H", F.concat_ws("|", F.col("na").cast("string"), F.array_join("H", ",")).alias("g"))
        # written, so that the join on a heavy fact has a plain exchange on both
        # sides, which adaptive execution can split
        sig = cut_lineage(sig)
        best = Window.partitionBy("q").orderBy(F.col("score").desc())
        least = light_scored.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).groupBy("q").agg(
            F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
        reach = F.size("H") / F.col("na")
        asking = sig.join(least, "q", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).where(reach >= F.col("least"))
        groups = cut_lineage(sig.select("g", "na", "H").distinct())
        ranked = dense_index(sig.select("g", "q"), "q", by=["g"], out="r")
        rel = asking.select(F.col("q"), F.col("na").alias("nq"), F.explode("H").alias("f"), F.col("H").alias("Hq"), "least") \
            .join(groups.select("g", F.col("na").alias("nb"), F.explode("H").alias("f")), "f") \
            .where(F.size("Hq") / F.greatest("nq", "nb") >= F.col("least")) \
            .select("q", "nq", "Hq", "g", "nb").distinct()
        rel = rel.join(groups.select("g", F.col("H").alias("S")), "g")
        # members to skip inside each group: light partners and the question itself
        skip = lp.select("q", F.concat_ws("|", F.col("nc").cast("string"), F.array_join("Hc", ",")).alias("g")) \
            .groupBy("q", "g").agg(F.count(F.lit(1)).alias("e"))
        own = sig.select("q", "g", F.lit(1).alias("own"))
        rel = rel.join(skip, ["q", "g"], "left").join(own, ["q", "g"], "left") \
            .withColumn("take", F.lit(k) + F.coalesce("e", F.lit(0)) + F.coalesce("own", F.lit(0)))
        rel = rel.withColumn("s", F.size(F.array_intersect("Hq", "S")) / F.greatest("nq", "nb"))
        picks = rel.select("q", "g", "s", F.explode(F.sequence(F.lit(0), F.col("take") - 1)).alias("r"))
        members = picks.join(ranked.select("g", "r", F.col("q").alias("c")), ["g", "r"]).select("q", "c", "s")
        heavy_only = members.where(F.col("q") != F.col("c")).join(lp.select("q", "c"), ["q", "c"], "left_anti") \
            .select("q", "c", F.col("s").alias("score"))
        cands = cands.unionByName(heavy_only)
    return _top(cands, key, k)


def _top(cands: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("c"))
    top = cands.where(F.col("score") > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("q").alias(key), F.col("rank").cast("bigint").alias("rank"), F.col("c").alias("other"),
                      "score")


def _plain_candidates(members: DataFrame, k: int) -> DataFrame | None:
    """``(q, c, score)`` with the top ``k`` others of every ``plain`` question
    among ``members`` (q, na, f, plain; light facts), or None where all pairs
    are fewer rows than pairs of facts."""
    facts = members.groupBy("q", "na", "plain").agg(F.array_sort(F.collect_set("f")).alias("L"))
    n = F.size("L").cast("double")
    of_sets = facts.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0.0
    pairs = members.groupBy("f").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0
    if of_sets > pairs:
        return None
    facts = cut_lineage(facts)
    # each pair of facts as a hash: who shares none of these shares one fact at
    # most; a chance collision only adds a candidate, scored on the sets below
    both = F.flatten(F.transform("L", lambda x, i: F.transform(
        F.slice("L", i + 2, F.size("L")), lambda y: F.xxhash64(x, y))))
    twice = cut_lineage(facts.select("q", F.explode(both).alias("h")).groupBy("h").agg(F.collect_list("q").alias("qs"))
                        .where(F.size("qs") > 1).select("qs"))
    m = F.size("qs").cast("double")
    if (twice.agg(F.sum(m * m)).first()[0] or 0.0) > pairs:
        return None
    met = twice.select("qs", F.explode("qs").alias("q")).select("q", F.explode("qs").alias("c")).where("q <> c").distinct()
    met = met.join(facts.where("plain").select("q", "na", "L"), "q").join(
        facts.select(F.col("q").alias("c"), F.col("na").alias("nc"), F.col("L").alias("Lc")), "c")
    more = met.select("q", "c", (F.size(F.array_intersect("L", "Lc")) / F.greatest("na", "nc")).alias("score"))

    def nearest(x, held):
        others = F.transform(F.filter(held, lambda y: y["q"] != x["q"]),
                             lambda y: F.struct(F.greatest(x["na"], y["na"]).alias("g"), y["q"].alias("c")))
        return F.struct(x["q"].alias("q"), F.slice(F.array_sort(others), 1, k).alias("near"))

    lists = members.groupBy("f").agg(F.collect_list(F.struct("na", "q", "plain")).alias("P")).where(F.size("P") > 1)
    near = lists.select(F.explode(F.transform(F.filter("P", lambda x: x["plain"]), lambda x: nearest(x, F.col("P")))).alias("x"))
    one = near.select("x.*").groupBy("q").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    one = one.select("q", F.explode("near").alias("x")).select("q", F.col("x.c").alias("c"), (F.lit(1) / F.col("x.g")).alias("score"))
    return one.unionByName(more).groupBy("q", "c").agg(F.max("score").alias("score"))
