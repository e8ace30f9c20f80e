"""Mixing sources to target token counts by entropy balancing.

Document rates r_d minimise the token-weighted relative entropy sum size_d * (r_d log r_d - r_d + 1) under token
constraints: for each constrained column (source, language, ...) the tokens of each of its values must come to that
value's target. The optimum is an exponential tilt, r_d = exp(sum of the multipliers of d's values). The dual is
convex and solved by distributed Newton steps: gradient and Hessian are Spark aggregations. With one constrained column
its Hessian is diagonal, and every document of a source has the same rate.

Rates are then rounded into whole copies: floor(rate) copies of every document and one more of some. Documents with
one source, rate and size are interchangeable, so from the largest size to the smallest each class takes the
number of extra copies that carries the least error on; the words taken miss the target by about one small document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Parts into which equal documents are dealt to be ranked; one hot class is then no single task.
PARTS = 256


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes with rank, from 0, of its source by code point, null last; sorted by ranges, never in one task."""
    spark = sizes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    parts = materialize(sizes.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = sorted((r["_p"], r["c"]) for r in parts.groupBy("_p").agg(F.count("*").alias("c")).collect())  # n at most
    before, offsets = 0, []
    for p, c in counts:
        offsets.append((p, before))
        before += c
    first = spark.createDataFrame(offsets, "_p int, _before long") if offsets else spark.createDataFrame([], "_p int, _before long")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_place", place).join(F.broadcast(first), "_p").withColumn("rank", F.col("_before") + F.col("_place") - 1).drop("_p", "_place", "_before")


def token_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: float = 2.0) -> DataFrame:
    """(source, source_size, target): shares of share * all tokens by weight, each at most most * its source's size.

    Weights go round the sources by code point, null last. What a source cannot take is reshared by weight among the
    others until none is above its bound: as long as the level, what is left over the weights that share it, fills a
    further source, that source is at its bound. Each round is one aggregation. One row per source; an empty table
    gives none.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    s = materialize(_ranked(sizes).select("source", "source_size", w.alias("w"), (F.col("source_size") * most).alias("bound")), "weights")
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, -1
    while True:
        at_bound = F.col("bound") <= F.lit(level) * F.col("w")
        n, capped, rest = s.agg(F.count_if(at_bound), F.coalesce(F.sum(F.when(at_bound, F.col("bound"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~at_bound, F.col("w"))), F.lit(0.0))).first()
        if n == full or not rest:
            break
        full, level = n, max(level, (total - capped) / rest)
    return s.select("source", "source_size", F.least("bound", F.lit(level) * F.col("w")).alias("target"))


#: Values of all constrained columns up to which a Newton step is of all multipliers at once.
JOINT = 400


def balance_rates(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-9, max_rounds: int = 60) -> DataFrame:
    """cells (key columns, tokens) -> cells with `rate`, by distributed Newton on the dual.

    targets maps a column of cells to a table (that column, target). Tokens of a value without a target, or whose
    target or tokens are not above 0, get rate 0. Each round aggregates the tilted tokens by value, the gradient, and by
    pairs of values of two columns, the Hessian. For up to JOINT values in all, the step of all multipliers solves that
    system, as small as the number of values whatever cells hold; the columns' totals are the same, so it is solved by
    least squares. Beyond that, and for one column, whose Hessian is diagonal, columns take their steps in turn, joined
    to cells as a table. Steps are kept within +-2. Rounds go on until every column's tokens are within `tolerance` of
    their targets, relatively, or max_rounds is reached (which contradictory targets of several columns bring about).
    """
    names = list(targets)
    cur = cells.withColumn("log_rate", F.lit(0.0))
    for c in names:
        known = targets[c].select(F.col(c).alias("_k"), F.col("target").alias("_t")).where("target > 0")
        cur = cur.join(known, cur[c].eqNullSafe(known["_k"]), "left").withColumn("log_rate", F.when(F.col("_t").isNotNull() & (F.col("tokens") > 0), F.col("log_rate"))).drop("_k").withColumnRenamed("_t", f"_t_{c}")
    cur = materialize(cur, "cells")
    live = cur.where("log_rate is not null")
    if len(names) > 1 and sum(live.select(c).distinct().limit(JOINT + 1).count() for c in names) <= JOINT:
        cur = _joint(cur, names, tolerance, max_rounds)
    else:
        cur = _in_turn(cur, names, tolerance, max_rounds)
    return cur.withColumn("rate", F.coalesce(F.exp("log_rate"), F.lit(0.0))).drop("log_rate", *(f"_t_{c}" for c in names))


def _joint(cur: DataFrame, names: list[str], tolerance: float, max_rounds: int) -> DataFrame:
    """cur with log_rate, by Newton steps of all values' multipliers at once."""
    live = cur.where("log_rate is not null")
    known = {(c, r[0]): float(r[1]) for c in names for r in live.groupBy(c).agg(F.first(f"_t_{c}")).collect()}  # JOINT at most
    place = {k: i for i, k in enumerate(known)}
    target, total = np.array(list(known.values())), np.zeros(len(known))

    def tilted(df: DataFrame) -> DataFrame:
        log_rate = F.lit(0.0)
        for c in names:
            mine = [(v, float(total[i])) for (col, v), i in place.items() if col == c]
            own = F.lit(0.0)
            for v, x in mine:
                own = F.when(F.col(c).eqNullSafe(F.lit(v)), F.lit(x)).otherwise(own)
            log_rate = log_rate + own
        return df.withColumn("log_rate", F.when(F.col("log_rate").isNotNull(), log_rate))

    for _ in range(max_rounds):
        mass = tilted(live).withColumn("_m", F.col("tokens") * F.exp("log_rate"))
        hessian = np.zeros((len(target), len(target)))
        for i, a in enumerate(names):
            for b in names[i:]:
                for r in mass.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.sum("_m").alias("m")).collect():
                    x, y = place[a, r["x"]], place[b, r["y"]]
                    hessian[x, y] = hessian[y, x] = r["m"]
        gap = target - np.diag(hessian)
        if np.abs(gap / target).max(initial=0.0) <= tolerance:
            break
        step = np.linalg.lstsq(hessian, gap, rcond=1e-12)[0]
        total = total + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
    return tilted(cur)


def _in_turn(cur: DataFrame, names: list[str], tolerance: float, max_rounds: int) -> DataFrame:
    """cur with log_rate, by Newton steps column by column; no multiplier is gathered."""
    for _ in range(max_rounds):
        worst = 0.0
        for c in names:
            live = cur.where("log_rate is not null")
            moments = live.groupBy(F.col(c).alias("_k")).agg(F.sum(F.col("tokens") * F.exp("log_rate")).alias("_m"), F.first(f"_t_{c}").alias("_t"))
            step = moments.select("_k", ((F.col("_t") - F.col("_m")) / F.col("_m")).alias("_g")).withColumn("_s", F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("_g"))))
            new = materialize(cur.join(step, cur[c].eqNullSafe(step["_k"]), "left").withColumn("log_rate", F.col("log_rate") + F.col("_s")).withColumn("_gap", F.abs("_g")).drop("_k", "_s", "_g"), "cells")
            discard(cur)
            cur = new.drop("_gap")
            cur._textloom_path = new._textloom_path
            worst = max(worst, new.agg(F.max("_gap")).first()[0] or 0.0)
        if worst <= tolerance:
            break
    return cur


def _carry(pdf: pd.DataFrame) -> pd.DataFrame:
    """Extra copies for each size class of one source, the error carried from large sizes to small."""
    pdf = pdf.sort_values("size", ascending=False)
    extra, error = [], 0.0
    for n, size, part in zip(pdf["n"], pdf["size"], pdf["part"], strict=True):
        want = n * part + error / size
        k = min(max(int(want + 0.5), 0), n if part > 0 else 0)
        extra.append(k)
        error = (want - k) * size
    return pdf.assign(extra=extra)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: float = 2.0) -> DataFrame:
    """(id, size, source_size, target, taken, copies), a row for each row of docs.

    size counts words of the text, 0 for null and wordless texts, which are never copied. A null source is a source.
    Repeated rows each return a row and are copied separately. Which of equal documents get the extra copy follows a
    hash of the id, so reruns agree. An empty table gives no rows. Other columns are not read.

    The only per-source state in one place is the table of distinct sizes of one source, which the longest document
    bounds, not the number of documents.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    src = materialize(src.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")), "sizes")
    # Equal documents are one line of the class table from here on.
    classes = materialize(src.groupBy("source", "size").agg(F.count("*").alias("n")), "classes")
    sizes = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = materialize(token_targets(sizes, share, weights, most), "targets")
    cells = balance_rates(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("tokens")), {"source": targets})
    rates = cells.select(F.col("source").alias("_s"), "rate")
    # A rate a rounding error away from a whole number is that number.
    near = F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-7, F.round("rate")).otherwise(F.col("rate"))
    plan = classes.where("size > 0").join(rates, classes["source"].eqNullSafe(rates["_s"])).drop("_s").withColumn("rate", near)
    plan = plan.select("source", "size", "n", F.floor("rate").cast("long").alias("base"), (F.col("rate") - F.floor("rate")).alias("part"))
    kind = "source string, size bigint, n bigint, base bigint, part double, extra bigint"
    plan = materialize(plan.groupBy("source").applyInPandas(_carry, kind).select(F.col("source").alias("_s"), F.col("size").alias("_z"), "base", "n", "extra"), "plan")

    # Of the n documents of a class, `extra` get one more copy: the first by part, then by hash of the id.
    same = lambda a, b: a["source"].eqNullSafe(b["_s"]) & (a["size"] == b["_z"])
    split = plan.where("extra > 0 and extra < n").select("_s", "_z", "extra")
    counts = src.groupBy("source", "size", "part").agg(F.count("*").alias("c"))
    counts = counts.join(split, same(counts, split))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("_s", "_z").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = counts.select("_s", "_z", F.col("part").alias("_p"), F.greatest(F.lit(0), F.least(F.col("c"), F.col("extra") - before)).alias("quota"), "c")
    whole = src.join(plan, same(src, plan), "left").drop("_s", "_z")
    placed = whole.join(quota, same(whole, quota) & (whole["part"] == quota["_p"]), "left")
    # Only parts that take some of their documents and not others need an order.
    some = F.col("quota").isNotNull() & (F.col("quota") > 0) & (F.col("quota") < F.col("c"))
    cols = ["id", "source", "size", "base"]
    sure = placed.where(~some | F.col("quota").isNull()).select(*cols, F.when(F.col("quota").isNotNull(), F.col("quota") > 0).otherwise(F.coalesce(F.col("extra") > 0, F.lit(False))).cast("long").alias("more"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("id", F.lit(7)), "id"))
    ranked = placed.where(some).withColumn("rank", rank).select(*cols, (F.col("rank") <= F.col("quota")).cast("long").alias("more"))
    copies = sure.unionByName(ranked).withColumn("copies", F.coalesce("base", F.lit(0)) + F.col("more"))
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    out = copies.join(t, copies["source"].eqNullSafe(t["_s"]), "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
