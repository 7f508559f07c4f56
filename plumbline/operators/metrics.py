"""Metrics of cells: two-level hash aggregations; running totals of a cell are formed in blocks of its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.fixtures import BUILDS, CLASSES, duck, items, scores
from plumbline.functions import scoring as S
from plumbline.operators.ordered import running_ties
from plumbline.operators.outcomes import BUILD, CELL, clean_thresholds, conformal_threshold, outcomes, with_sets
from plumbline.shared import kept, written

BINS = 15


def r9(c: Column) -> Column:
    return F.round(c, 9)


def m_accuracy(df: DataFrame) -> DataFrame:
    top = S.label_rank(F.col("z"), F.col("label"))
    return df.withColumn("_r", top).groupBy(*CELL).agg(F.count("*").alias("n"), r9(F.avg((F.col("_r") == 1).cast("double"))).alias("top1"), r9(F.avg((F.col("_r") <= 5).cast("double"))).alias("top5"))


def m_tie_range(df: DataFrame) -> DataFrame:
    """Tied items, and the lowest and highest top-1 that any way of breaking ties could give."""
    z = F.col("z")
    own = df.select(*CELL, (S.tied(z) > 1).alias("t"), (F.element_at(z, F.col("label") + 1) == F.array_max(z)).alias("b"))
    return own.groupBy(*CELL).agg(F.count_if("t").alias("tied"), r9(F.avg((F.col("b") & ~F.col("t")).cast("double"))).alias("lowest"), r9(F.avg(F.col("b").cast("double"))).alias("highest"))


def bin_of(confidence: Column, bins: int = BINS) -> Column:
    """Right-closed bins: ceil(c * bins) - 1, within 0 and bins - 1."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil(confidence * bins) - 1)).cast("int")


def m_ece(df: DataFrame, bins: int = BINS) -> DataFrame:
    by_bin = df.groupBy(*CELL, bin_of(F.col("confidence"), bins).alias("bin")).agg(F.sum(F.col("confidence") - F.col("correct")).alias("gap"), F.count("*").alias("m"))
    return by_bin.groupBy(*CELL).agg(r9(F.sum(F.abs("gap")) / F.sum("m")).alias("ece"))


def m_reliability_bins(df: DataFrame, bins: int = BINS) -> DataFrame:
    """Every bin of every cell; empty bins stay, with nulls."""
    got = df.groupBy(*CELL, bin_of(F.col("confidence"), bins).alias("bin")).agg(F.count("*").alias("n"), r9(F.avg("confidence")).alias("mean_confidence"), r9(F.avg("correct")).alias("accuracy"))
    grid = got.select(*CELL).distinct().crossJoin(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")))
    full = grid.join(got, [*CELL, "bin"], "left")  # a row for each cell and bin
    return full.select(*CELL, "bin", r9(F.col("bin") / bins).alias("low"), r9((F.col("bin") + 1) / bins).alias("high"), F.coalesce("n", F.lit(0)).alias("n"), "mean_confidence", "accuracy")


def m_overconfidence(df: DataFrame) -> DataFrame:
    return df.groupBy(*CELL).agg(r9(F.avg("confidence") - F.avg("correct")).alias("overconfidence"))


def m_nll(df: DataFrame, t: float = 1.0) -> DataFrame:
    return df.groupBy(*CELL).agg(r9(F.avg(S.nll(F.col("z"), F.col("label"), t))).alias("nll"))


def m_temperature_fit(df: DataFrame, low: float = 0.1, high: float = 10.0, steps: int = 17, passes: int = 5) -> DataFrame:
    """The temperature with the least mean NLL, on a logarithmic grid that each pass narrows around its best point.

    A pass reads each row once and forms the sums of all grid points; five passes of 17 end at a step below 1e-4 in
    the logarithm. at_end marks a fit at the end of the range.
    """
    import math

    spark, (first, last) = df.sparkSession, (math.log(low), math.log(high))
    grids = written(spark, df.select(*BUILD).distinct(), "grids").withColumns({"_lo": F.lit(first), "_hi": F.lit(last)})
    width = (F.col("_hi") - F.col("_lo")) / (steps - 1)
    for _ in range(passes):
        means = F.array(*[F.struct(r9(F.avg(S.nll(F.col("z"), F.col("label"), F.exp(F.col("_lo") + width * i)))).alias("nll"), F.lit(i).alias("i")) for i in range(steps)])
        best = df.join(grids.select(*BUILD, "_lo", "_hi"), BUILD).groupBy(*BUILD, "_lo", "_hi").agg(F.array_min(means).alias("b"))
        centre = F.col("_lo") + width * F.col("b.i")
        ends = (F.greatest(F.lit(first), centre - width).alias("_lo"), F.least(F.lit(last), centre + width).alias("_hi"))
        grids = written(spark, best.select(*BUILD, F.exp(centre).alias("t"), F.col("b.nll").alias("nll"), *ends), "grids")
    return grids.select(*BUILD, F.round("t", 6).alias("temperature"), "nll", ((F.col("t") < low * 1.01) | (F.col("t") > high / 1.01)).alias("at_end"))


def m_conformal_threshold(df: DataFrame, coverage: float = 0.9) -> DataFrame:
    return conformal_threshold(df.filter("split = 'conformal_calibration'"), CELL, coverage).select(*CELL, F.round("q", 12).alias("q"))


def m_sets(df: DataFrame) -> DataFrame:
    size = F.col("size")
    return df.groupBy(*CELL).agg(r9(F.avg("covered")).alias("coverage"), r9(F.avg("size")).alias("mean_size"), F.median("size").alias("median_size"), r9(F.avg((size == 1).cast("double"))).alias("single"), r9(F.avg((size == 0).cast("double"))).alias("empty"))


def m_set_size_hist(df: DataFrame) -> DataFrame:
    return df.groupBy(*CELL, "size").agg(F.count("*").alias("n"))


def m_sets_many_thresholds(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Coverage and set size of the same scores under several thresholds (build, name, q), with the average over them."""
    own = df.join(written(thresholds.sparkSession, thresholds, "thresholds"), BUILD)
    own = with_sets_of(own)
    each = own.groupBy(*CELL, "name").agg(F.avg("covered").alias("coverage"), F.avg("size").alias("mean_size"))
    return each.rollup(*CELL, "name").agg(F.avg("coverage").alias("c"), F.avg("mean_size").alias("s"), F.grouping_id().alias("g")).filter("g in (0, 1)").select(
        *CELL, F.coalesce("name", F.lit("average")).alias("name"), r9(F.col("c")).alias("coverage"), r9(F.col("s")).alias("mean_size")
    )


def with_sets_of(own: DataFrame) -> DataFrame:
    return own.withColumns({"size": F.size(F.filter("p", lambda x: x >= 1 - F.col("q"))).cast("double"), "covered": (F.element_at("p", F.col("label") + 1) >= 1 - F.col("q")).cast("double")})


def m_robust_thresholds(df: DataFrame, coverage: float = 0.9) -> DataFrame:
    """For each kind of damage left out: the threshold on calibration items of all other conditions, and its coverage there."""
    kind = F.when(F.col("cond_id") == "clean", "clean").otherwise(F.split("cond_id", "/")[1])
    cal = df.filter("split = 'conformal_calibration'").withColumn("kind", kind)
    out = df.sparkSession.createDataFrame([("fade",), ("jitter",)], "held_out string")
    mixed = cal.crossJoin(F.broadcast(out)).filter("kind <> held_out")
    q = conformal_threshold(mixed, [*BUILD, "held_out"], coverage)
    return with_sets_of(mixed.join(written(df.sparkSession, q, "thresholds"), [*BUILD, "held_out"])).groupBy(*BUILD, "held_out").agg(F.round(F.first("q"), 12).alias("q"), r9(F.avg("covered")).alias("coverage"))


def tie_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Items (m) and errors (e) of each confidence, with the items (s) and errors (before) of higher confidence."""
    own = df.select(*keys, "confidence", F.lit(1).cast("long").alias("m"), (1 - F.col("correct")).alias("e"))
    return running_ties(own, keys, "confidence", {"m": "s", "e": "before"}, descending=True)


def m_risk_curve(df: DataFrame) -> DataFrame:
    """Expected error among the k most confident items, ties averaged inside their group, for every k."""
    groups = tie_groups(df, CELL).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("m"))))
    return groups.select(*CELL, (F.col("s") + F.col("j")).alias("k"), r9((F.col("before") + F.col("e") * F.col("j") / F.col("m")) / (F.col("s") + F.col("j"))).alias("risk"))


def m_risk_at(df: DataFrame, points: tuple[float, ...] = (1.0, 0.8, 0.5)) -> DataFrame:
    """Risk at coverages: points and every whole per cent; the index is max(1, half-even round of coverage * n)."""
    grid = F.array(*[F.lit(float(c)) for c in sorted({*points, *(i / 100 for i in range(1, 101))})])
    k = lambda c: F.greatest(F.lit(1), F.bround(c * F.col("n"), 0)).cast("long")
    wanted = df.groupBy(*CELL).agg(F.count("*").alias("n")).withColumn("_wanted", F.transform(grid, lambda c: F.struct(c.alias("coverage"), k(c).alias("k"))))
    ties = tie_groups(df, CELL).join(written(df.sparkSession, wanted, "wanted"), CELL)
    inside = F.filter("_wanted", lambda x: (F.col("s") < x["k"]) & (x["k"] <= F.col("s") + F.col("m")))
    hit = ties.withColumn("_hit", F.explode(inside)).select("*", "_hit.*")
    return hit.select(*CELL, "coverage", "k", r9((F.col("before") + F.col("e") * (F.col("k") - F.col("s")) / F.col("m")) / F.col("k")).alias("risk"))


def harmonic(n: Column) -> Column:
    """The harmonic number of a count: summed up to 40, beyond by its asymptotic series (error below 1e-15)."""
    x = n.cast("double")
    far = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    near = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(40), n)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i)
    return F.when(n <= 0, 0.0).when(n <= 40, near).otherwise(far)


def aurc_columns() -> tuple[Column, Column]:
    """Sums over tie groups: area under the risk curve, and the best possible one, both times n."""
    m, e, s, before = (F.col(c).cast("double") for c in ("m", "e", "s", "before"))
    r = e / m
    return m * r + (before - s * r) * (harmonic(F.col("s") + F.col("m")) - harmonic(F.col("s"))), e


def m_aurc_all(df: DataFrame) -> DataFrame:
    area, errors = aurc_columns()
    sums = tie_groups(df, CELL).groupBy(*CELL).agg(F.sum(area).alias("a"), F.sum("m").alias("n"), F.sum(errors).alias("e"))
    n, c = F.col("n").cast("double"), F.col("n") - F.col("e")
    best = (n - c) / n - (c / n) * (harmonic(F.col("n")) - harmonic(c.cast("long")))
    return sums.select(*CELL, r9(F.col("a") / n).alias("aurc"), r9(best).alias("optimal"), r9(F.col("a") / n - best).alias("e_aurc"))


def m_agreement(df: DataFrame) -> DataFrame:
    """Share of items for which the two builds give the same answer, in each condition."""
    answer = lambda build: F.max(F.when(F.col("build") == build, F.col("pred")))
    both = df.groupBy("model", "cond_id", "item").agg((answer(BUILDS[0]) == answer(BUILDS[1])).alias("same")).filter("same is not null")
    return both.groupBy("model", "cond_id").agg(r9(F.avg(F.col("same").cast("double"))).alias("agreement"))


def m_build_spread(df: DataFrame) -> DataFrame:
    """Range and sample deviation over rebuilt variants of top-1 and E-AURC, on clean items."""
    tops = df.filter("cond_id = 'clean'").groupBy(*CELL).agg(F.avg("correct").alias("top1")).join(m_aurc_all(df.filter("cond_id = 'clean'")), CELL)
    return tops.groupBy("build").agg(
        r9(F.max("top1") - F.min("top1")).alias("top1_range"), r9(F.stddev_samp("top1")).alias("top1_sd"), r9(F.max("e_aurc") - F.min("e_aurc")).alias("e_aurc_range"), F.round(F.stddev_samp("e_aurc"), 6).alias("e_aurc_sd")
    )


def m_choose_best(df: DataFrame) -> DataFrame:
    """The variant with the highest clean top-1 of each build, its margin over the next; an exact tie fails."""
    hits = df.filter("cond_id = 'clean'").groupBy("build", "model").agg(F.sum("correct").cast("long").alias("hits"), F.count("*").alias("n"))
    w = Window.partitionBy("build").orderBy(F.desc("hits"), "model")
    top = hits.withColumns({"rn": F.row_number().over(w), "next": F.lead("hits").over(w)}).filter("rn = 1")
    return top.select("build", F.col("model").alias("best"), "hits", (F.col("hits") - F.col("next")).alias("margin"), (F.col("hits") == F.col("next")).alias("tie"))


def m_sanity(df: DataFrame, published: DataFrame, most: float = 0.010) -> DataFrame:
    """The reference's clean top-1 against the published one."""
    got = df.filter("cond_id = 'clean' and build = 'ref'").groupBy("model").agg(F.avg("correct").alias("top1"))
    return got.join(published, "model").select("model", r9(F.col("top1")).alias("top1"), "published", r9(F.col("top1") - F.col("published")).alias("difference"), (F.abs(F.col("top1") - F.col("published")) <= most).alias("ok"))


def scored(spark: SparkSession, sf: str, models: int = 1, conds: list[str] | None = None) -> DataFrame:
    """The outcomes, formed from items that the application keeps bucketed: a metric forms the columns it needs, nothing as
    long as scores is written or shuffled, and pairing builds or conditions by item takes no exchange."""
    own = kept(spark, ("items", sf), lambda: items(spark, sf), "item")
    return outcomes(scores(spark, sf, models=models, conds=conds, own=own), CLASSES)


def set_rows(spark: SparkSession, sf: str) -> DataFrame:
    own = scored(spark, sf)
    return with_sets(own.filter("split <> 'conformal_calibration'"), clean_thresholds(own), BUILD, CLASSES)


def q_many(spark: SparkSession, sf: str) -> DataFrame:
    own = scored(spark, sf)
    clean = clean_thresholds(own).withColumn("name", F.lit("clean"))
    fade = conformal_threshold(own.filter("cond_id = 'demo/fade/3' and split = 'conformal_calibration'"), BUILD).withColumn("name", F.lit("fade"))
    return m_sets_many_thresholds(own.filter("split = 'test'"), clean.unionByName(fade))


_C = "model, build, cond_id"
_GROUPS = f"groups as (select {_C}, confidence, count(*) m, sum(1 - correct) e from outcomes group by all), ties as (select *, sum(m) over w - m s, sum(e) over w - e before from groups window w as (partition by {_C} order by confidence desc))"
_H = "harm as (select k, sum(case when k = 0 then 0 else 1.0::double / k end) over (order by k) h from range(0, (select max(s + m)::bigint + 1 from ties)) t(k))"
_AURC = f"{_GROUPS}, {_H}, area as (select {_C}, sum(t.e + (t.before - t.s * t.e / t.m) * (b.h - a.h)) a, sum(t.m)::double n, sum(t.e) e from ties t join harm a on a.k = t.s join harm b on b.k = t.s + t.m group by all), aurcs as (select {_C}, a / n aurc, (n - c) / n - (c / n) * (hn.h - hc.h) optimal from (select *, n - e c from area) x join harm hn on hn.k = x.n join harm hc on hc.k = x.c)"
_BIN = "greatest(0, least(14, ceil(confidence * 15) - 1))::int"


def _temperature_sql(passes: int = 5) -> str:
    nll = "round(avg(ln(list_sum(list_transform(z, lambda v: exp((v - zm) / t)))) + (zm - z[label + 1]) / t), 9)"
    ctes, source = "zs as materialized (select model, build, z, label, list_max(z) zm from scores where cond_id = 'clean' and split = 'tuning'), g0 as (select model, build, ln(0.1::double) lo, ln(10.0::double) hi, null::double t, null::double nll from zs group by 1, 2)", "g0"
    for i in range(1, passes + 1):
        ctes += f""", p{i} as (select model, build, lo, hi, i, exp(lo + (hi - lo) * i / 16) t from {source} cross join range(0, 17) r(i)),
a{i} as (select model, build, lo, hi, i, t, {nll} nll from zs join p{i} using (model, build) group by all),
g{i} as (select model, build, greatest(ln(0.1::double), lo + (hi - lo) / 16 * i - (hi - lo) / 16) lo, least(ln(10.0::double), lo + (hi - lo) / 16 * i + (hi - lo) / 16) hi, t, nll from (select *, row_number() over (partition by model, build order by nll, i) rn from a{i}) where rn = 1)"""
        source = f"g{i}"
    return duck(f"select model, build, round(t, 6) temperature, nll, t < 0.1::double * 1.01 or t > 10.0::double / 1.01 at_end from g{passes}", "scores", more=ctes)


QUERIES = {
    "m_accuracy": lambda s, d: m_accuracy(scores(s, d)),
    "m_tie_range": lambda s, d: m_tie_range(scores(s, d)),
    "m_ece": lambda s, d: m_ece(scored(s, d)),
    "m_reliability_bins": lambda s, d: m_reliability_bins(scored(s, d)),
    "m_overconfidence": lambda s, d: m_overconfidence(scored(s, d)),
    "m_nll": lambda s, d: m_nll(scores(s, d), 1.3),
    "m_temperature_fit": lambda s, d: m_temperature_fit(scores(s, d, conds=["clean"]).filter("split = 'tuning'")),
    "m_conformal_threshold": lambda s, d: m_conformal_threshold(scored(s, d)),
    "m_sets": lambda s, d: m_sets(set_rows(s, d)),
    "m_set_size_hist": lambda s, d: m_set_size_hist(set_rows(s, d)),
    "m_sets_many_thresholds": q_many,
    "m_robust_thresholds": lambda s, d: m_robust_thresholds(scored(s, d)),
    "m_risk_curve": lambda s, d: m_risk_curve(scored(s, d, conds=["clean", "demo/fade/5"])),
    "m_risk_at": lambda s, d: m_risk_at(scored(s, d)),
    "m_aurc": lambda s, d: m_aurc_all(scored(s, d)).select(*CELL, "aurc"),
    "m_aurc_optimal": lambda s, d: m_aurc_all(scored(s, d)).select(*CELL, "optimal"),
    "m_e_aurc": lambda s, d: m_aurc_all(scored(s, d)).select(*CELL, "e_aurc"),
    "m_agreement": lambda s, d: m_agreement(scored(s, d)),
    "m_build_spread": lambda s, d: m_build_spread(scored(s, d, models=4, conds=["clean"])),
    "m_choose_best": lambda s, d: m_choose_best(scored(s, d, models=4, conds=["clean"])),
    "m_sanity": lambda s, d: m_sanity(scored(s, d, models=3, conds=["clean"]), s.createDataFrame([("m0", 0.73), ("m1", 0.70), ("m2", 0.65)], "model string, published double")),
}
_SANITY = "published(model, published) as (values ('m0', 0.73::double), ('m1', 0.70::double), ('m2', 0.65::double))"
_MANY = """fade as (select model, build, 1 - p[label + 1] s, row_number() over (partition by model, build order by 1 - p[label + 1]) rn, count(*) over (partition by model, build) n from probs where cond_id = 'demo/fade/3' and split = 'conformal_calibration'),
qs as (select model, build, 'clean' as name, q from thresholds union all select model, build, 'fade', coalesce(max(s) filter (rn = ceil((n + 1) * 0.9::double)), 1.0::double) from fade group by 1, 2),
each as (select o.model, o.build, cond_id, name, avg(case when p[label + 1] >= 1 - q then 1.0::double else 0 end) c, avg(len(list_filter(p, lambda v: v >= 1 - q))) s from probs o join qs using (model, build) where split = 'test' group by all)"""
_ROBUST = """mixed as (select model, build, h held_out, p, label, 1 - p[label + 1] s from probs cross join (values ('fade'), ('jitter')) t(h) where split = 'conformal_calibration' and cond_id not like '%/' || h || '/%'),
ranked as (select *, row_number() over (partition by model, build, held_out order by s) rn, count(*) over (partition by model, build, held_out) n from mixed),
rq as (select model, build, held_out, coalesce(max(s) filter (rn = ceil((n + 1) * 0.9::double)), 1.0::double) q from ranked group by all)"""
_ONE = {"models": 4, "conds": ["clean"]}
ORACLE = {
    "m_accuracy": duck(f"select {_C}, count(*) n, round(avg((r = 1)::int), 9) top1, round(avg((r <= 5)::int), 9) top5 from (select *, 1 + len(list_filter(z, lambda x, i: x > z[label + 1] or (x = z[label + 1] and i - 1 < label))) r from scores) group by all", "scores"),
    "m_tie_range": duck(f"select {_C}, count(*) filter (t) tied, round(avg((b and not t)::int), 9) lowest, round(avg(b::int), 9) highest from (select {_C}, len(list_filter(z, lambda x: x = list_max(z))) > 1 t, z[label + 1] = list_max(z) b from scores) group by {_C}", "scores"),
    "m_ece": duck(f"select {_C}, round(sum(abs(g)) / sum(m), 9) ece from (select {_C}, {_BIN} bin, sum(confidence - correct) g, count(*) m from outcomes group by all) group by {_C}", "outcomes"),
    "m_reliability_bins": duck(f"select {_C}, c.bin::int bin, round(c.bin / 15.0::double, 9) low, round((c.bin + 1) / 15.0::double, 9) high, coalesce(n, 0) n, mean_confidence, accuracy from (select distinct {_C}, b bin from outcomes cross join range(0, 15) t(b)) c left join (select {_C}, {_BIN} bin, count(*) n, round(avg(confidence), 9) mean_confidence, round(avg(correct), 9) accuracy from outcomes group by all) using ({_C}, bin)", "outcomes"),
    "m_overconfidence": duck(f"select {_C}, round(avg(confidence) - avg(correct), 9) overconfidence from outcomes group by all", "outcomes"),
    "m_nll": duck(f"select {_C}, round(avg(ln(list_sum(list_transform(z, lambda v: exp((v - list_max(z)) / 1.3::double)))) + (list_max(z) - z[label + 1]) / 1.3::double), 9) nll from scores group by all", "scores"),
    "m_temperature_fit": _temperature_sql(),
    "m_conformal_threshold": duck(f"select {_C}, round(coalesce(max(s) filter (rn = ceil((n + 1) * 0.9::double)), 1.0::double), 12) q from (select {_C}, 1 - p[label + 1] s, row_number() over (partition by {_C} order by 1 - p[label + 1]) rn, count(*) over (partition by {_C}) n from probs where split = 'conformal_calibration') group by all", "probs"),
    "m_sets": duck(f"select {_C}, round(avg(covered), 9) coverage, round(avg(size), 9) mean_size, median(size) median_size, round(avg((size = 1)::int), 9) single, round(avg((size = 0)::int), 9) empty from sets group by all", "sets"),
    "m_set_size_hist": duck(f"select {_C}, size, count(*) n from sets group by all", "sets"),
    "m_sets_many_thresholds": duck(f"select {_C}, name, round(c, 9) coverage, round(s, 9) mean_size from each union all select {_C}, 'average', round(avg(c), 9), round(avg(s), 9) from each group by {_C}", "thresholds", more=_MANY),
    "m_robust_thresholds": duck("select model, build, held_out, round(any_value(q), 12) q, round(avg((p[label + 1] >= 1 - q)::int), 9) coverage from mixed join rq using (model, build, held_out) group by 1, 2, 3", "probs", more=_ROBUST),
    "m_risk_curve": duck(f"select {_C}, (s + j)::bigint k, round((before + e * j / m) / (s + j), 9) risk from (select *, unnest(range(1, m + 1)) j from ties)", "outcomes", more=_GROUPS, conds=["clean", "demo/fade/5"]),
    "m_risk_at": duck(f"select t.model, t.build, t.cond_id, coverage, k, round((before + e * (k - s) / m) / k, 9) risk from ties t join (select {_C}, c / 100.0::double coverage, greatest(1, round_even(c / 100.0::double * n, 0))::bigint k from (select {_C}, count(*) n from outcomes group by all) cross join range(1, 101) g(c)) w on t.model = w.model and t.build = w.build and t.cond_id = w.cond_id and t.s < k and k <= t.s + t.m", "outcomes", more=_GROUPS),
    **{n: duck(f"select {_C}, round({e}, 9) {c} from aurcs", "outcomes", more=_AURC) for n, c, e in (("m_aurc", "aurc", "aurc"), ("m_aurc_optimal", "optimal", "optimal"), ("m_e_aurc", "e_aurc", "aurc - optimal"))},
    "m_agreement": duck("select a.model, a.cond_id, round(avg((a.pred = b.pred)::int), 9) agreement from outcomes a join outcomes b using (model, cond_id, item) where a.build = 'ref' and b.build = 'small' group by all", "outcomes"),
    "m_build_spread": duck(f"select build, round(max(t) - min(t), 9) top1_range, round(stddev_samp(t), 9) top1_sd, round(max(e) - min(e), 9) e_aurc_range, round(stddev_samp(e), 6) e_aurc_sd from (select {_C}, avg(correct) t from outcomes group by all) join (select {_C}, round(aurc - optimal, 9) e from aurcs) using ({_C}) group by build", "outcomes", more=_AURC, **_ONE),
    "m_choose_best": duck("select build, model best, hits, hits - nxt margin, hits = nxt tie from (select *, row_number() over w rn, lead(hits) over w nxt from (select build, model, sum(correct)::bigint hits from outcomes group by all) window w as (partition by build order by hits desc, model)) where rn = 1", "outcomes", **_ONE),
    "m_sanity": duck("select model, round(t, 9) top1, published, round(t - published, 9) difference, abs(t - published) <= 0.010::double ok from (select model, avg(correct) t from outcomes where build = 'ref' group by 1) join published using (model)", "outcomes", more=_SANITY, models=3, conds=["clean"]),
}
