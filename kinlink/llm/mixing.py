"""Mixing sources to target weights by subset sums.

Each source gets a share of a total budget of words. Whole passes over the source cover most of its
target; the rest is a subset-sum problem over document lengths: a histogram of exact lengths, a
proportional share of each length from the longest down, what one length leaves over going to the
next, and a bounded-knapsack dynamic program for the remainder. The remainder is always below two of the
longest documents, so the program's size follows that and not the corpus. Which documents of a length are
taken follows a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .words import word_count

#: Rows of one length that are ranked together; longer groups are first cut by their hash.
RANKED = 512


def targets(sizes: Sequence[int], weights: Sequence[float], most: float, total: float | None = None) -> list[float]:
    """Shares of ``total`` (all sizes if None) by weight, none above ``most`` times its size.

    What a source cannot take goes to the others by weight, until none is above its limit. Sources of
    size zero get nothing. If all limits together are below the total, every source gets its limit.
    """
    left = float(sum(sizes)) if total is None else float(total)
    out = [0.0] * len(sizes)
    live = [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0]
    while live:
        unit = left / sum(weights[i] for i in live)
        over = [i for i in live if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in live:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        live = [i for i in live if i not in over]
    return out


def fit_counts(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come nearest below ``budget``.

    Takes the same share of every length, from the longest down, as far as the words up to there are due;
    one longest document is left out of account, so that the remainder, below two of them, has documents of
    every length to choose from; it is filled exactly as far as these can.
    """
    import numpy as np

    n = np.asarray(counts, dtype=np.int64)
    size = np.asarray(lengths, dtype=np.int64)
    whole = int((n * size).sum())
    if budget <= 0 or whole == 0:
        return [0] * len(n)
    if budget >= whole:
        return n.tolist()
    take = np.zeros(len(n), dtype=np.int64)
    due = max(0, int(budget) - int(size.max()))
    passed = taken = 0
    for i in np.argsort(-size, kind="stable").tolist():
        if size[i] > 0:
            passed += int(n[i] * size[i])
            take[i] = min(int(n[i]), (passed * due // whole - taken) // int(size[i]))
            taken += int(take[i] * size[i])
    left = int(budget) - taken
    first = np.full(left + 1, -1, dtype=np.int32)  # the piece by which a sum was first reached
    first[0] = 0
    pieces = [(0, 0, 0)]
    for i in np.argsort(size, kind="stable").tolist():
        weight, free, pack = int(size[i]), int(n[i] - take[i]), 1
        if weight == 0 or weight > left:
            continue
        free = min(free, left // weight)
        while free > 0 and first[left] < 0:
            pack = min(pack, free)
            step = pack * weight
            if step <= left:
                new = (first[:-step] >= 0) & (first[step:] < 0)
                if new.any():
                    first[step:][new] = len(pieces)
                    pieces.append((i, pack, step))
            free -= pack
            pack *= 2
        if first[left] >= 0:
            break
    at = int(np.flatnonzero(first >= 0)[-1])
    while at:
        i, pack, step = pieces[first[at]]
        take[i] += pack
        at -= step
    return take.tolist()


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    most: int = 3,
    share: float = 1.0,
    seed: int = 42,
    size: Column | None = None,
) -> DataFrame:
    """Adds to each document how many words of it the mix takes.

    Sources by code point, null last, get ``weights`` in turn. Returns ``id_col``, size, source_size,
    target, taken, copies (how often the document is taken) and the source.

    Null and empty texts have size 0 and are taken 0 times; a null source is a source; repeated rows
    count each; an empty table gives an empty result. Ids may be null or repeated: equal ids of equal
    size in one source are told apart by their text's hash, and wholly equal rows are interchangeable.
    """
    spark = docs.sparkSession
    size = word_count(F.col(text_col)) if size is None else size.cast("long")
    base = materialize(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).cast("string").alias("_source"),
            size.alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_h"),
        ),
        "sizes",
    )
    # (source, length) -> count; at most one row for each distinct length of a source
    hist = materialize(base.groupBy("_source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    per_source = hist.groupBy("_source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # one row per source: the list of sources, not of documents, comes to the driver
    rows = sorted(per_source.collect(), key=lambda r: (r["_source"] is None, r["_source"] or ""))
    sizes = [int(r["source_size"]) for r in rows]
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(rows))], most, share * sum(sizes))
    plan = spark.createDataFrame(
        [(r["_source"], s, t) for r, s, t in zip(rows, sizes, goal, strict=True)], "_source string, source_size long, target double"
    )
    joined = (
        hist.join(plan, hist["_source"].eqNullSafe(plan["_source"]))
        .select(hist["_source"], "size", "n", "source_size", "target")
    )

    def solve(pdf):
        import math

        import pandas as pd

        pdf = pdf.sort_values("size")
        total, aim = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = min(int(aim // total), most) if total else 0
        rest = math.floor(aim - passes * total + 0.5) if total else 0
        if passes >= most:
            rest = 0
        chosen = fit_counts(pdf["size"].tolist(), pdf["n"].tolist(), rest)
        return pd.DataFrame({"_source": pdf["_source"], "size": pdf["size"], "passes": passes, "extra": chosen})

    counts = materialize(
        joined.repartition(min(max(len(rows), 1), 1000), "_source").groupBy("_source").applyInPandas(solve, "_source string, size long, passes long, extra long"), "counts"
    )
    counts = counts.join(hist, hist["_source"].eqNullSafe(counts["_source"]) & (hist["size"] == counts["size"])).select(
        counts["_source"], counts["size"], "passes", "extra", "n"
    )
    out = base.join(counts, base["_source"].eqNullSafe(counts["_source"]) & (base["size"] == counts["size"])).select(
        base["*"], "passes", "extra", "n"
    )
    # Seeded choice of ``extra`` of ``n`` rows: wholly equal rows are counted, not ranked; groups longer than RANKED
    # are cut at hash ranges, whole ranges are taken or left by running counts of ranges, and inside a range the
    # quota goes to distinct rows by running counts of theirs.
    ranges = F.ceil(F.col("n") / RANKED)
    out = out.withColumn("_cut", F.when(F.col("n") <= RANKED, F.lit(0)).otherwise(F.pmod(F.col("_h"), ranges)).cast("long"))
    keys = ["_source", "size", "_cut"]
    part = out.filter((F.col("extra") > 0) & (F.col("extra") < F.col("n")))
    part = part.groupBy(*keys, "_id", "_h").agg(F.count(F.lit(1)).alias("_m"), F.first("extra").alias("extra"), F.first("passes").alias("passes"))
    cuts = part.groupBy(*keys).agg(F.sum("_m").alias("_m"), F.first("extra").alias("_extra"))
    upto = lambda w: F.coalesce(F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = F.col("_extra") - upto(Window.partitionBy("_source", "size").orderBy("_cut"))
    cuts = cuts.select(F.col("_source").alias("_s"), F.col("size").alias("_z"), F.col("_cut").alias("_c"), quota.alias("_quota"))
    part = part.withColumn("_before", upto(Window.partitionBy(*keys).orderBy("_h", "_id")))
    part = part.join(cuts, part["_source"].eqNullSafe(cuts["_s"]) & (part["size"] == cuts["_z"]) & (part["_cut"] == cuts["_c"]))
    copy = F.sequence(F.lit(1).cast("long"), F.col("_m"))
    part = part.select("_id", "_source", "size", "passes", "_before", "_quota", F.explode(copy).alias("_k")).select(
        "_id", "_source", "size", (F.col("passes") + (F.col("_before") + F.col("_k") <= F.col("_quota")).cast("long")).alias("copies")
    )
    rest = out.filter((F.col("extra") <= 0) | (F.col("extra") >= F.col("n"))).select(
        "_id", "_source", "size", (F.col("passes") + (F.col("extra") > 0).cast("long")).alias("copies")
    )
    done = part.unionByName(rest)
    return done.join(F.broadcast(plan) if len(rows) <= 10_000 else plan, done["_source"].eqNullSafe(plan["_source"])).select(
        F.col("_id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0)).cast("long").alias("copies"),
        done["_source"].alias(source_col),
    )


def with_copies(docs: DataFrame, *columns: str, id_col: str = "doc_id", **kwargs) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with these columns of ``mix``, by default ``copies``.

    Rows of one id are told apart by their order in it, so each row of ``docs`` meets one row of the mix;
    null ids are an id like any other. A column of ``docs`` of the same name is replaced.
    """
    columns = columns or ("copies",)
    text_col, source_col = kwargs.get("text_col", "text"), kwargs.get("source_col", "source")
    # one key of three, whose null parts are equal to each other; rows of a key meet by their number in it
    plain = [c for c, kind in docs.dtypes if not kind.startswith("map")]
    key = F.struct(F.col(id_col).alias("i"), F.col(source_col).cast("string").alias("s"), word_count(F.col(text_col)).alias("z"))
    left = docs.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*plain)))
    mixed = mix(docs, id_col=id_col, **kwargs)
    key = F.struct(F.col(id_col).alias("i"), F.col(source_col).alias("s"), F.col("size").alias("z"))
    mixed = mixed.select(key.alias("_of"), *(F.col(c).alias(f"_m_{c}") for c in columns), F.col("copies").alias("_copies"))
    mixed = mixed.withColumn("_k", F.row_number().over(Window.partitionBy("_of").orderBy(F.desc("_copies")))).filter(F.col("_copies") > 0)
    same = (left["_key"] == mixed["_of"]) & (left["_n"] - mixed["_k"] == 0)
    own = [c for c in docs.columns if c not in columns]
    return left.join(mixed, same).select(*(left[c] for c in own), *(F.col(f"_m_{c}").alias(c) for c in columns))


def sample_mix(docs: DataFrame, **kwargs) -> DataFrame:
    """The documents of a mix, each as often as the mix takes it; arguments as of ``mix``."""
    every = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    return with_copies(docs, "copies", **kwargs).withColumn("copy", F.explode(every)).drop("copies")
