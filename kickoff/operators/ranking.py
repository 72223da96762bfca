"""Global ordinals and exact medians without a single-partition window.

A window with no PARTITION BY puts every row in one task. For a global order
we instead range-partition and sort (Spark's distributed sort), let every
partition number its own rows, and prefix-sum the per-partition counts, a
table with one row per partition, whose size is bounded by the partition count
and is therefore safe to broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import materialize

#: Of the sketches that enclose a quantile: ranks are off by no more than a row in so many.
ACCURACY = 10000
_LOCAL_BITS = 33  # monotonically_increasing_id = partition id << 33 | row number in partition


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _offsets(counts: DataFrame, weight: str) -> DataFrame:
    """(pid, total) -> (pid, offset) with offset = sum of totals of earlier partitions."""
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_pid", F.coalesce(F.sum(weight).over(w), F.lit(0)).cast("bigint").alias("_off"))


def global_index(df: DataFrame, order_cols: list, out: str, partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of the row in the global order of ``order_cols``.

    ``order_cols`` must be a total order (unique key), so that a recomputed
    partition numbers its rows the same way.
    """
    n = partitions or _parts(df)
    srt = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
             .withColumn("_mid", F.monotonically_increasing_id())
             .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
             .withColumn("_local", F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1)))
    # Partition ids are physical: store them once so the counts and the rows they
    # offset come from the same numbering (two reads of one shuffle may be split
    # differently by adaptive execution).
    srt = materialize(srt.drop("_mid"), "global-index")
    counts = srt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offs = F.broadcast(_offsets(counts, "_cnt"))
    return (srt.join(offs, "_pid")
               .withColumn(out, F.col("_off") + F.col("_local"))
               .drop("_pid", "_local", "_off"))


def weighted_position(df: DataFrame, order_cols: list, weight: str, out: str) -> DataFrame:
    """Add ``out`` = sum of ``weight`` over all rows before this one in the global order."""
    n = _parts(df)
    srt = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    schema = StructType(list(srt.schema.fields) + [StructField("_pid", LongType()), StructField("_local", LongType())])

    def number(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        run = 0
        for pdf in batches:
            w = pdf[weight].astype("int64")
            excl = w.cumsum() - w + run
            run += int(w.sum())
            yield pdf.assign(_pid=pid, _local=excl)

    numbered = materialize(srt.mapInPandas(number, schema), "weighted-position")
    counts = numbered.groupBy("_pid").agg(F.sum(weight).alias("_cnt"))
    offs = F.broadcast(_offsets(counts, "_cnt"))
    return (numbered.join(offs, "_pid")
                    .withColumn(out, F.col("_off") + F.col("_local"))
                    .drop("_pid", "_local", "_off"))


def _sorted_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """``exact_quantiles`` by a sort of all distinct values, for columns whose brackets missed.

    Values are unpivoted to (column, value), counted per distinct value (map-side
    combine), globally ordered by (column, value) with running counts, and the
    ranks needed are picked. Only len(cols) x len(probs) numbers reach the driver.
    """
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("kv")).select("kv.name", "kv.value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    counted = stacked.groupBy("name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    pos = weighted_position(counted, ["name", "value"], "cnt", "before")
    per_name = counted.groupBy("name").agg(F.sum("cnt").alias("n"))
    w = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_name.select("name", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))
    targets = starts.select("name", "start", F.explode(F.array(*[
        F.struct(F.lit(i).alias("qi"), ((F.col("n") - 1) * F.lit(float(p))).alias("h")) for i, p in enumerate(probs)
    ])).alias("q")).select("name", "start", "q.qi", "q.h")
    targets = F.broadcast(targets.select(  # len(cols) x len(probs) rows
        "name", "qi", (F.col("h") - F.floor("h")).alias("frac"),
        (F.col("start") + F.floor("h")).alias("lo"), (F.col("start") + F.ceil("h")).alias("hi")))
    covers = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("cnt"))
    hit = pos.join(targets, "name").where(covers(F.col("lo")) | covers(F.col("hi")))
    picked = hit.groupBy("name", "qi", "frac").agg(
        F.max(F.when(covers(F.col("lo")), F.col("value"))).alias("v_lo"),
        F.max(F.when(covers(F.col("hi")), F.col("value"))).alias("v_hi"))
    rows = picked.select("name", "qi", (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac"))
                         .alias("q")).collect()
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    for r in rows:
        out[r["name"]][r["qi"]] = r["q"]
    return out


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of every column (nulls/NaN ignored): the value
    at 0-based rank h = (n - 1) p is v[floor h] + (v[ceil h] - v[floor h]) (h - floor h), as
    numpy's default.

    Three reads of ``df``, none of which shuffles its rows: sketches give two values that
    enclose each rank; counts below and between them prove it; the distinct values between
    them (some 4 / ``ACCURACY`` of the rows) are counted and the ranks needed are picked.
    A column whose counts don't prove its brackets is sorted as a whole. A few numbers per
    column and probability reach the driver.
    """
    if not cols:
        return {}
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    around = [x for p in probs for x in (max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY))]
    found = df.agg(*[F.percentile_approx(value[c], around, ACCURACY).alias(f"_b{i}") for i, c in enumerate(cols)],
                   *[F.count(value[c]).alias(f"_n{i}") for i, c in enumerate(cols)]).first()
    n = {c: found[f"_n{i}"] for i, c in enumerate(cols)}
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    bracket = {(c, k): found[f"_b{i}"][2 * k:2 * k + 2] for i, c in enumerate(cols) if n[c] for k in range(len(probs))}
    if not bracket:
        return out
    spans = list(bracket)
    counted = df.agg(*[F.count(F.when(value[c] < bracket[c, k][0], 1)).alias(f"_l{i}") for i, (c, k) in enumerate(spans)],
                     *[F.count(F.when(value[c].between(*bracket[c, k]), 1)).alias(f"_m{i}") for i, (c, k) in enumerate(spans)]).first()
    picks, missed = [], set()
    for i, (c, k) in enumerate(spans):
        h = (n[c] - 1) * float(probs[k])
        first, last, below = math.floor(h), math.ceil(h), counted[f"_l{i}"]
        lo, hi = bracket[c, k]
        if not below <= first <= last < below + counted[f"_m{i}"]:
            missed.add(c)
        elif lo == hi:
            out[c][k] = lo
        else:
            picks.append((i, c, k, first - below, last - below, h - first))
    picks = [x for x in picks if x[1] not in missed]
    if picks:
        near = df.select(F.explode(F.array_compact(F.array(*[
            F.when(value[c].between(*bracket[c, k]), F.struct(F.lit(i).alias("i"), value[c].alias("value"))) for i, c, k, *_ in picks]))).alias("x")).select("x.*")
        running = Window.partitionBy("i").orderBy("value")
        ranked = near.groupBy("i", "value").agg(F.count(F.lit(1)).alias("cnt")).withColumn("upto", F.sum("cnt").over(running))
        at = lambda which: F.create_map(*[F.lit(x) for p in picks for x in (p[0], p[which])])[F.col("i")]
        covers = lambda r: (F.col("upto") - F.col("cnt") <= r) & (r < F.col("upto"))
        rows = ranked.groupBy("i").agg(F.max(F.when(covers(at(3)), F.col("value"))).alias("lo"), F.max(F.when(covers(at(4)), F.col("value"))).alias("hi")).collect()
        ends = {r["i"]: (r["lo"], r["hi"]) for r in rows}
        for i, c, k, _, _, part in picks:
            lo, hi = ends[i]
            out[c][k] = lo + (hi - lo) * part
    if missed:
        out |= _sorted_quantiles(df, [c for c in cols if c in missed], probs)
    return out


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact interpolated median of every column (see ``exact_quantiles``)."""
    return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items()}
