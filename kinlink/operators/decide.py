"""From scores to matches: one owner per record, threshold rules, tuning, and label-free calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import fraction
from ..storage import materialize
from .context import logit
from .stats import top_first

#: Threshold grids (fixed values): 0.500 to 0.950 by 0.025.
THRESHOLDS = tuple(round(0.5 + 0.025 * i, 3) for i in range(19))
UNKNOWN_GROUP, HIGHEST = 0.99, 0.995


def assign(pairs: DataFrame, col: str = "p") -> DataFrame:
    """Each record keeps its best entity; ties go to the smaller entity id."""
    return top_first(pairs, ["src", "rec"], [F.desc(col), F.asc("s1")], 1).drop("rank")


def by_threshold(assigned: DataFrame, threshold: Column | float, col: str = "p") -> DataFrame:
    return assigned.filter(F.col(col) >= threshold)


def group_threshold(group: Column, table: dict[int, float]) -> Column:
    """The group's threshold; groups without one get UNKNOWN_GROUP."""
    out = F.lit(UNKNOWN_GROUP)
    for g, t in sorted(table.items()):
        out = F.when(group == g, F.lit(t)).otherwise(out)
    return out


def expected_f(assigned: DataFrame, floor: float | Column = 0.3, extra: float | Column = 0.1, col: str = "p") -> DataFrame:
    """The prefix of each entity's matches, by falling score, that has the largest expected F0.5; nothing if none is likelier."""
    rows = assigned.filter(F.col(col) >= floor / 2)
    s = Window.partitionBy("s1")
    upto = s.orderBy(F.desc(col), "src", "rec").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("m", F.count(F.lit(1)).over(upto)).withColumn("c", F.sum(col).over(upto))
    rows = rows.withColumn("t", F.sum(col).over(s) + extra).withColumn("none", F.exp(F.sum(F.ln(F.greatest(1 - F.col(col), F.lit(1e-9)))).over(s)))
    rows = rows.withColumn("ef", F.round(1.25 * F.col("c") / (1.25 * F.col("c") + 0.25 * (F.col("t") - F.col("c")) + (F.col("m") - F.col("c"))), 9))
    rows = rows.withColumn("best", F.max("ef").over(s))
    rows = rows.withColumn("most", F.min(F.when(F.col("ef") == F.col("best"), F.col("m"))).over(s))
    return rows.filter((F.col("m") <= F.col("most")) & (F.col("best") > F.col("none")) & (F.col(col) >= floor)).select(*assigned.columns)


def f_half(tp: Column, predicted: Column, true: Column) -> Column:
    """F0.5 of one entity: 1 if nothing is true and nothing predicted, 0 if only one side is empty or nothing is right."""
    p, r = tp / predicted, tp / true
    return F.when((predicted == 0) & (true == 0), F.lit(1.0)).when((predicted == 0) | (true == 0) | (tp == 0), F.lit(0.0)).otherwise(1.25 * p * r / (0.25 * p + r))


def counts(entities: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1, tp, npred, ntrue) for every entity, those without a row included."""
    keys = ["s1", "src", "rec"]
    both = predicted.select(*keys, F.lit(1).alias("a")).join(truth.select(*keys, F.lit(1).alias("b")), keys, "full")
    n = both.groupBy("s1").agg(F.count(F.col("a") + F.col("b")).alias("tp"), F.count("a").alias("npred"), F.count("b").alias("ntrue"))
    return entities.select("s1").distinct().join(n, "s1", "left").na.fill(0)


def macro_f(entities: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: macro F0.5 over all entities, and how many there are."""
    return counts(entities, predicted, truth).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(f_half(F.col("tp"), F.col("npred"), F.col("ntrue"))), 6).alias("macro_f05"))


def macro_f_by(entities: DataFrame, predicted: DataFrame, truth: DataFrame, by: str) -> DataFrame:
    """(by, n, macro_f05): the same for each country, fold or other mask; ``entities`` has s1 and this column."""
    scored = counts(entities, predicted, truth).join(entities.select("s1", by).distinct(), "s1")
    return scored.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(f_half(F.col("tp"), F.col("npred"), F.col("ntrue"))), 6).alias("macro_f05"))


def grid_f(entities: DataFrame, rows: DataFrame, truth: DataFrame, grid: Sequence[float]) -> DataFrame:
    """(threshold, macro_f05) where ``rows`` has s1, src, rec and the grid points ``at`` at which each row is a match.

    One pass: rows are counted per entity and grid point, entities without a match are added in bulk.
    """
    true = truth.groupBy("s1").agg(F.count(F.lit(1)).alias("ntrue"))
    hits = rows.join(truth.select("s1", "src", "rec", F.lit(1).alias("_y")), ["s1", "src", "rec"], "left")
    n = hits.select("s1", "_y", F.explode("at").alias("threshold")).groupBy("s1", "threshold").agg(F.count("_y").alias("tp"), F.count(F.lit(1)).alias("npred"))
    base = entities.select("s1").distinct().join(true, "s1", "left").na.fill(0)
    scored = n.join(base, "s1").groupBy("threshold").agg(F.sum(f_half(F.col("tp"), F.col("npred"), F.col("ntrue"))).alias("f"), F.count_if(F.col("ntrue") == 0).alias("covered"))
    total = base.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ntrue") == 0).alias("empty"))  # one row
    points = entities.sparkSession.createDataFrame([(t,) for t in grid], "threshold double").crossJoin(F.broadcast(total))
    out = points.join(scored, "threshold", "left").na.fill(0)
    return out.select("threshold", F.round((F.col("f") + F.col("empty") - F.col("covered")) / F.col("n"), 6).alias("macro_f05"))


def _reached(grid: Sequence[float], col: str) -> Column:
    return F.filter(F.array(*(F.lit(t) for t in grid)), lambda t: t <= F.col(col))


def tune(entities: DataFrame, assigned: DataFrame, truth: DataFrame, grid: Sequence[float] = THRESHOLDS, col: str = "p") -> DataFrame:
    """(threshold, macro_f05) of one threshold for all rows."""
    return grid_f(entities, assigned.select("s1", "src", "rec", _reached(grid, col).alias("at")), truth, grid)


def best_threshold(curve: DataFrame) -> tuple[float, float]:
    """(macro_f05, threshold) of the best grid point; the higher threshold if several are."""
    return max((r["macro_f05"], r["threshold"]) for r in curve.collect())  # one row per grid point


def tune_groups(entities: DataFrame, assigned: DataFrame, truth: DataFrame, group: str, groups: Sequence[int], grid: Sequence[float] = THRESHOLDS, col: str = "p", passes: int = 2) -> tuple[dict[int, float], float]:
    """(threshold of each group, macro F0.5) by coordinate ascent from the best common threshold.

    A step tries all thresholds of one group in one pass over the rows and moves on gains above 1e-6.
    """
    assigned = materialize(assigned.select(*dict.fromkeys(("s1", "src", "rec", group, col))), "assigned")
    best, start = best_threshold(tune(entities, assigned, truth, grid, col))
    table = dict.fromkeys(groups, start)
    for g in list(groups) * passes:
        fixed = F.when(F.col(col) >= group_threshold(F.col(group), table), F.array(*(F.lit(t) for t in grid))).otherwise(F.array().cast("array<double>"))
        rows = assigned.select("s1", "src", "rec", F.when(F.col(group) == g, _reached(grid, col)).otherwise(fixed).alias("at"))
        for r in sorted(grid_f(entities, rows, truth, grid).collect()):  # one row per grid point
            if r["macro_f05"] > best + 1e-6:
                best, table = r["macro_f05"], {**table, g: r["threshold"]}
    return table, best


#: Grids of the expected-F rule (fixed values).
FLOORS, EXTRAS = (0.2, 0.3, 0.4, 0.5), (0.0, 0.1, 0.25)


def tune_expected_f(entities: DataFrame, assigned: DataFrame, truth: DataFrame, floors: Sequence[float] = FLOORS, extras: Sequence[float] = EXTRAS) -> DataFrame:
    """(floor, extra, macro_f05) of the expected-F rule at each grid point; points are rows' groups, so one plan does all."""
    points = F.explode(F.array(*(F.struct(F.lit(a).alias("floor"), F.lit(b).alias("extra")) for a in floors for b in extras))).alias("g")
    cross = lambda df: df.select("*", points).withColumn("s1", F.struct(F.col("g.floor").alias("floor"), F.col("g.extra").alias("extra"), F.col("s1").alias("s1")))
    kept = expected_f(cross(assigned), F.col("g.floor"), F.col("g.extra"))
    n = counts(cross(entities.select("s1")), kept, cross(truth))
    f = F.round(F.avg(f_half(F.col("tp"), F.col("npred"), F.col("ntrue"))), 6).alias("macro_f05")
    return n.groupBy(F.col("s1.floor").alias("floor"), F.col("s1.extra").alias("extra")).agg(f)


def shift_unseen(pairs: DataFrame, unseen: Column, delta: float, col: str = "p") -> DataFrame:
    """Scores of unseen groups lowered by ``delta``, which raises their thresholds by as much."""
    return pairs.withColumn(col, F.when(unseen, F.col(col) - delta).otherwise(F.col(col)))


def curve_by_country(entities: DataFrame, assigned: DataFrame, table: dict[int, float], group: Column, deltas: Sequence[float], col: str = "p") -> DataFrame:
    """(country, delta, mean_matches) over all entities of a country; ``entities``: s1, country."""
    threshold, p = group_threshold(group, table), F.col(col)
    hit = [F.count_if(p >= F.least(threshold + float(d), F.lit(HIGHEST))).alias(f"_{i}") for i, d in enumerate(deltas)]
    found = entities.select("s1", "country").distinct()
    n = found.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    kept = assigned.drop("country").join(found, "s1").groupBy("country").agg(*hit)
    points = F.array(*(F.struct(F.lit(float(d)).alias("delta"), F.coalesce(f"_{i}", F.lit(0)).alias("c")) for i, d in enumerate(deltas)))
    out = n.join(kept, "country", "left").select("country", "n", F.explode(points).alias("e"))
    return out.select("country", "e.delta", F.round(F.col("e.c") / F.col("n"), 6).alias("mean_matches"))


def choose_delta(curve: DataFrame, target: float, slack: float = 0.02, drop: float = 0.1) -> DataFrame:
    """One row, ``delta``: the largest of the countries' choices.

    A country's curve is read from its smallest delta up to the first mean at or below the target, and
    stops before a fall of more than ``drop``; of its points not below target - slack the nearest counts.
    """
    w = Window.partitionBy("country").orderBy("delta")
    fell = F.coalesce((F.lag("mean_matches").over(w) - F.col("mean_matches")) > drop, F.lit(False)).cast("int")
    met = (F.col("mean_matches") <= target).cast("int")
    read = curve.withColumn("_fell", fell).withColumn("_met", met)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    read = read.withColumn("_stop", F.sum("_fell").over(upto) + F.sum("_met").over(upto) - F.col("_met")).filter(F.col("_stop") == 0)
    near = read.filter(F.col("mean_matches") >= target - slack).groupBy("country").agg(F.min(F.struct(F.round(F.abs(F.col("mean_matches") - target), 6), F.col("delta").alias("delta"))).alias("b"))
    return near.agg(F.max("b.delta").alias("delta"))


def nearest_delta(curve: DataFrame, target: float) -> DataFrame:
    """One row, (delta, mean_matches): the point nearest to the target; the smaller delta if two are."""
    best = F.min(F.struct(F.round(F.abs(F.col("mean_matches") - target), 6), "delta", "mean_matches")).alias("b")
    return curve.agg(best).select("b.delta", "b.mean_matches")


def calibration_curve(assigned: DataFrame, n_entities: int, table: dict[int, float], group: Column, deltas: Sequence[float], col: str = "p") -> DataFrame:
    """(delta, mean_matches): mean matches per entity if every group's threshold is raised by delta, HIGHEST at most."""
    grid = F.explode(F.array(*(F.lit(float(d)) for d in deltas)))
    rows = assigned.select(F.col(col).alias("_p"), group_threshold(group, table).alias("_t"), grid.alias("delta"))
    kept = (F.col("_p") >= F.least(F.col("_t") + F.col("delta"), F.lit(HIGHEST))).cast("int")
    return rows.groupBy("delta").agg(F.round(F.sum(kept) / F.lit(float(max(1, n_entities))), 6).alias("mean_matches"))


def renormalise(pairs: DataFrame, col: str = "p", eps: float = 1e-6) -> DataFrame:
    """Adds ``share``: the pair's odds over one plus the odds of all candidates of the record."""
    p = F.least(F.greatest(F.col(col), F.lit(eps)), F.lit(1 - eps))
    out = pairs.withColumn("_o", p / (1 - p))
    return out.withColumn("share", F.col("_o") / (1 + F.sum("_o").over(Window.partitionBy("src", "rec")))).drop("_o")


def match_lists(entities: DataFrame, matches: DataFrame) -> DataFrame:
    """(s1, matched): every entity once, its records' keys in the order of list and number, joined by commas, empty if it has none."""
    key = F.concat(F.lit("S"), F.col("src").cast("string"), F.lit("-"), F.col("rec").cast("string")).alias("key")
    keys = F.transform(F.sort_array(F.collect_set(F.struct("src", "rec", key))), lambda x: x["key"])
    lists = matches.groupBy("s1").agg(F.array_join(keys, ",").alias("matched"))
    return entities.select("s1").distinct().join(lists, "s1", "left").select("s1", F.coalesce("matched", F.lit("")).alias("matched"))


def patch(base: DataFrame, new: DataFrame, unseen: Column) -> DataFrame:
    """The base lists, with those of unseen groups replaced by the new ones."""
    return base.join(new.select("s1", F.col("matched").alias("_new")), "s1", "left").withColumn("matched", F.when(unseen, F.coalesce("_new", F.lit(""))).otherwise(F.col("matched"))).drop("_new")


def error_kinds(pairs: DataFrame, matches: DataFrame, truth: DataFrame, threshold: float, col: str = "p") -> DataFrame:
    """(kind, n): missed pairs that are no candidates, score too low, or lost to another owner; wrong pairs of owned and of ownerless records."""
    keys = ["s1", "src", "rec"]
    missed = truth.join(matches, keys, "left_anti").join(pairs.select(*keys, F.col(col).alias("_p")), keys, "left")
    fn = missed.select(F.when(F.col("_p").isNull(), "fn_no_candidate").when(F.col("_p") < threshold, "fn_low_score").otherwise("fn_other_owner").alias("kind"))
    owned = truth.select("src", "rec").distinct().withColumn("_o", F.lit(1))
    fp = matches.join(truth, keys, "left_anti").join(owned, ["src", "rec"], "left").select(F.when(F.col("_o").isNull(), "fp_orphan").otherwise("fp_competition").alias("kind"))
    return fn.unionByName(fp).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def blend_features(pairs: DataFrame, a: str = "p", b: str = "q") -> DataFrame:
    """Adds the logits of two scores and their product."""
    return pairs.withColumn("la", logit(F.col(a), 1e-6)).withColumn("lb", logit(F.col(b), 1e-6)).withColumn("lab", F.col("la") * F.col("lb"))


def choose_rule(results: dict[str, dict[str, float]]) -> tuple[str, str]:
    """(stage, rule) with the largest F; ``results``: F by rule for each stage, in order. A later stage must be as good or better; of equal rules the first counts."""
    best = {stage: max(rules.values()) for stage, rules in results.items()}
    stage = max(reversed(list(best)), key=best.__getitem__)
    return stage, max(results[stage], key=results[stage].__getitem__)


def better_on_folds(entities: DataFrame, pairs: DataFrame, truth: DataFrame, one: str = "p", two: str = "q", fold: str = "fold") -> DataFrame:
    """(fold, one_threshold, one_f, two_threshold, two_f, use): two systems at the thresholds that are best over all folds.

    ``use`` is 1 in every row if the second is better on every fold, else 0. ``entities``: s1 and the fold.
    """
    out = None
    for name, col in (("one", one), ("two", two)):
        owned = materialize(assign(pairs, col).select("s1", "src", "rec", col), "assigned")
        _, at = best_threshold(tune(entities, owned, truth, col=col))
        f = macro_f_by(entities, by_threshold(owned, at, col), truth, fold)
        f = f.select(fold, F.lit(at).alias(f"{name}_threshold"), F.col("macro_f05").alias(f"{name}_f"))
        out = f if out is None else out.join(f, fold)
    every = F.min((F.col("two_f") > F.col("one_f")).cast("int")).over(Window.partitionBy(F.lit(0)))  # one row for each fold
    return out.withColumn("use", every)


def exported(pairs: DataFrame, col: str = "p") -> DataFrame:
    """Scores in the exchange form: source1_entity_id, candidate_entity_id, score."""
    return pairs.select(
        F.concat(F.lit("S1-"), F.col("s1").cast("string")).alias("source1_entity_id"),
        F.concat(F.lit("S"), F.col("src").cast("string"), F.lit("-"), F.col("rec").cast("string")).alias("candidate_entity_id"), F.col(col).alias("score"),
    )


def error_sample(pairs: DataFrame, matches: DataFrame, truth: DataFrame, n: int = 20, col: str = "p") -> DataFrame:
    """(kind, s1, src, rec, p): up to ``n`` missed and ``n`` wrong pairs, the first by hash (a report)."""
    keys = ["s1", "src", "rec"]
    missed = truth.select(*keys).join(matches.select(*keys), keys, "left_anti").withColumn("kind", F.lit("missed"))
    wrong = matches.select(*keys).join(truth.select(*keys), keys, "left_anti").withColumn("kind", F.lit("wrong"))
    u = fraction("errors", "rec", "s1")
    picked = [x.orderBy(u, "s1", "src", "rec").limit(n) for x in (missed, wrong)]
    return picked[0].unionByName(picked[1]).join(pairs.select(*keys, F.col(col).alias("p")), keys, "left").select("kind", *keys, "p")
