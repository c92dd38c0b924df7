"""Global and grouped statistics that are computed once and broadcast back.

``exact_quantiles`` is a distributed exact order-statistic selection: instead of
one task holding every distinct value (what the built-in exact ``percentile``
does for a global aggregate), each pass counts values per (target, bucket) with
a partial aggregate, the driver reads at most ``targets x buckets`` counts and
narrows every target to one bucket. When a bracket holds few enough rows the
next pass aggregates its exact distinct values. Memory per pass is bounded by
the number of buckets, not by the data, and hot values (many equal rows) cost
one aggregated row per map task.

Interpolation is linear between the two order statistics around
``(n - 1) * p``: the same definition as pandas ``quantile``, Spark
``percentile`` and DuckDB ``quantile_cont``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake import config
from churnlake.functions.tables import small_table


def broadcast_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach a one-row statistics frame to every row. ``stats`` is always a global
    ``agg`` (exactly one row by construction), so the broadcast side has a proven size."""
    return df.crossJoin(F.broadcast(stats))


def null_safe_join(df: DataFrame, small: DataFrame, keys: Sequence[str], broadcast: bool = False) -> DataFrame:
    """Left join a per-group frame back on ``keys`` (nulls match nulls). ``broadcast`` is for
    frames of a bounded number of groups; otherwise Spark decides by the size it sees."""
    if not keys:
        return broadcast_stats(df, small)
    renamed = small
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__k_{k}")
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(renamed[f"__k_{k}"])
        cond = c if cond is None else cond & c
    out = df.join(F.broadcast(renamed) if broadcast else renamed, cond, "left")
    return out.drop(*[f"__k_{k}" for k in keys])


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _no_nan(c: Column) -> Column:
    """As double, NaN treated as missing (pandas semantics; Spark would order NaN last)."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def exact_quantiles(
    df: DataFrame,
    targets: dict[str, tuple[str | Column, float]],
    by: Sequence[str] = (),
    buckets: int | None = None,
    exact_below: int | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles.

    ``targets`` maps an output name to ``(column, probability)``. Returns the ``by``
    columns (one row per group) plus one double column per target; null where a group
    has no non-null value. Up to ``config.DRIVER_STAT_GROUPS`` groups keep their
    brackets on the driver; with more, brackets are a table that every pass joins.
    """
    spark = df.sparkSession
    by = list(by)
    buckets = buckets or config.QUANTILE_BUCKETS
    exact_below = exact_below or config.QUANTILE_EXACT_BELOW

    col_keys: list[str] = []
    col_exprs: list[Column] = []
    for c, _p in targets.values():
        k = c if isinstance(c, str) else str(c)
        if k not in col_keys:
            col_keys.append(k)
            col_exprs.append(_as_col(c))
    qnames = [f"__q{i}" for i in range(len(col_keys))]
    proj = df.select(*[F.col(b) for b in by], *[_no_nan(e).alias(n) for e, n in zip(col_exprs, qnames)])
    proj = proj.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if by and proj.select(*by).distinct().limit(config.DRIVER_STAT_GROUPS + 1).count() > config.DRIVER_STAT_GROUPS:
            cols = {o: (col_keys.index(c if isinstance(c, str) else str(c)), p) for o, (c, p) in targets.items()}
            return _select_many(spark, proj, by, cols, qnames, buckets, exact_below)
        return _select(spark, proj, df.schema, by, targets, col_keys, qnames, buckets, exact_below)
    finally:
        proj.unpersist()


def _select(spark, proj, schema, by, targets, col_keys, qnames, buckets, exact_below):
    aggs = []
    for n in qnames:
        aggs += [F.count(n).alias(f"{n}_n"), F.min(n).alias(f"{n}_lo"), F.max(n).alias(f"{n}_hi")]
    g = proj.groupBy(*by).agg(*aggs) if by else proj.agg(*aggs)
    groups = g.collect()

    # One selection state per distinct (group, column, rank)
    states: dict[tuple, dict] = {}
    plan: list[tuple] = []  # (group index, out name, col index, lo rank, frac)
    for gi, row in enumerate(groups):
        for out, (c, p) in targets.items():
            ci = col_keys.index(c if isinstance(c, str) else str(c))
            n = row[f"{qnames[ci]}_n"]
            if n == 0:
                plan.append((gi, out, ci, None, None))
                continue
            h = (n - 1) * p
            lo_r = int(math.floor(h))
            frac = h - lo_r
            plan.append((gi, out, ci, lo_r, frac))
            needed = [lo_r] + ([lo_r + 1] if frac > 0 else [])
            for r in needed:
                key = (gi, ci, r)
                if key not in states:
                    a, b = row[f"{qnames[ci]}_lo"], row[f"{qnames[ci]}_hi"]
                    states[key] = {"a": a, "b": b, "below": 0, "cnt": n, "value": a if a == b else None}

    _narrow(spark, proj, schema, by, groups, states, qnames, buckets, exact_below)

    out_rows = []
    for gi, row in enumerate(groups):
        vals = {}
        for pgi, out, ci, lo_r, frac in plan:
            if pgi != gi:
                continue
            if lo_r is None:
                vals[out] = None
                continue
            lo = states[(gi, ci, lo_r)]["value"]
            if frac > 0:
                hi = states[(gi, ci, lo_r + 1)]["value"]
                vals[out] = lo + (hi - lo) * frac
            else:
                vals[out] = float(lo)
        out_rows.append((*[row[b] for b in by], *[vals[o] for o in targets]))
    oschema = T.StructType([schema[b] for b in by] + [T.StructField(o, T.DoubleType()) for o in targets])
    return small_table(spark, out_rows, oschema)


def _select_many(spark, proj, by, targets, qnames, buckets, exact_below):
    """The same selection for any number of groups: brackets are a checkpointed table, one
    row per open (group, column, rank); nothing but a count comes to the driver."""
    items = F.array(*[F.struct(F.lit(i).alias("ci"), F.col(n).alias("x")) for i, n in enumerate(qnames)])
    rows = proj.select(F.struct(*by).alias("g"), F.explode(items).alias("e")).select("g", "e.ci", "e.x").where(F.col("x").isNotNull())
    stats = rows.groupBy("g", "ci").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    wanted = small_table(spark, [(o, ci, float(p)) for o, (ci, p) in targets.items()], "out string, ci int, p double")
    h = (F.col("n") - 1) * F.col("p")
    plan = stats.join(F.broadcast(wanted), "ci").select(
        "g", "ci", "out", "n", "lo", "hi", F.floor(h).cast("long").alias("r"), (h - F.floor(h)).alias("frac")).checkpoint(eager=True)
    needed = F.explode(F.when(F.col("frac") > 0, F.array(F.col("r"), F.col("r") + 1)).otherwise(F.array("r")))
    value = F.when(F.col("a") == F.col("b"), F.col("a"))
    state = plan.select("g", "ci", needed.alias("r"), F.col("lo").alias("a"), F.col("hi").alias("b"), F.lit(0).cast("long").alias("below"),
                        F.col("n").alias("cnt")).distinct().withColumn("value", value).checkpoint(eager=True)
    while True:
        open_ = state.where(F.col("value").isNull())
        brackets = open_.select("g", "ci", "a", "b", (F.col("cnt") <= exact_below).alias("exact")).distinct()
        n_open = brackets.count()
        if not n_open:
            break
        side = F.broadcast(brackets) if n_open <= config.BROADCAST_ROW_LIMIT // 10 else brackets
        place = F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * buckets).cast("double")
        key = F.when(F.col("exact"), F.col("x")).otherwise(F.least(F.lit(float(buckets - 1)), F.greatest(F.lit(0.0), place)))
        counted = rows.join(side, ["g", "ci"]).where(F.col("x").between(F.col("a"), F.col("b"))) \
            .groupBy("g", "ci", "a", "b", key.alias("key")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("mn"), F.max("x").alias("mx"))
        # at most ``buckets`` (or ``exact_below``) rows of a bracket
        upto = Window.partitionBy("g", "ci", "a", "b").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = counted.withColumn("upto", F.sum("c").over(upto))
        hit = (F.col("r") - F.col("below") < F.col("upto")) & (F.col("r") - F.col("below") >= F.col("upto") - F.col("c"))
        moved = open_.select("g", "ci", "r", "a", "b", "below").join(counted, ["g", "ci", "a", "b"]).where(hit).select(
            "g", "ci", "r", F.col("mn").alias("a"), F.col("mx").alias("b"), (F.col("below") + F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("cnt"))
        state = state.where(F.col("value").isNotNull()).unionByName(moved.withColumn("value", value)).checkpoint(eager=True)
    low = state.select("g", "ci", "r", F.col("value").alias("v0"))
    high = state.select("g", "ci", (F.col("r") - 1).alias("r"), F.col("value").alias("v1"))
    got = plan.join(low, ["g", "ci", "r"]).join(high, ["g", "ci", "r"], "left")
    got = got.withColumn("v", F.when(F.col("frac") > 0, F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("frac")).otherwise(F.col("v0")))
    wide = got.groupBy("g").agg(*[F.max(F.when(F.col("out") == o, F.col("v"))).alias(o) for o in targets])
    every = proj.select(F.struct(*by).alias("g")).distinct()
    return every.join(wide, "g", "left").select(*[F.col(f"g.{b}").alias(b) for b in by], *targets).checkpoint(eager=True)


def _narrow(spark, proj, schema, by, groups, states, qnames, buckets, exact_below):
    """Resolve every open (group, column, rank) state by bucket narrowing passes."""
    while True:
        open_keys = [k for k, s in states.items() if s["value"] is None]
        if not open_keys:
            break
        # ranks of a column that are in the same bracket share it, so a row is counted once for all of them
        brackets: dict[tuple, int] = {}
        trows = []
        for k in open_keys:
            gi, ci, _r = k
            s = states[k]
            bracket = (gi, ci, float(s["a"]), float(s["b"]), 1 if s["cnt"] <= exact_below else 0)
            if bracket not in brackets:
                brackets[bracket] = len(brackets)
                trows.append((*[groups[gi][b] for b in by], brackets[bracket], *bracket[1:]))
            s["tid"] = brackets[bracket]
        tschema = T.StructType(
            [schema[b] for b in by]
            + [T.StructField("__tid", T.IntegerType()), T.StructField("__ci", T.IntegerType()),
               T.StructField("__a", T.DoubleType()), T.StructField("__b", T.DoubleType()),
               T.StructField("__exact", T.IntegerType())]
        )
        if by:
            joined = null_safe_join(proj, small_table(spark, trows, tschema), by, broadcast=True)
        else:  # no groups: every row meets every open target; explode a literal target list, no join
            tstructs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, tschema.fields)])
                        for r in trows]
            joined = proj.select("*", F.explode(F.array(*tstructs)).alias("__t")).select(
                *proj.columns, *[F.col(f"__t.{f.name}").alias(f.name) for f in tschema.fields])
        x = F.col(qnames[0])
        if len(qnames) > 1:
            x = F.when(F.col("__ci") == 0, F.col(qnames[0]))
            for i, n in enumerate(qnames[1:], start=1):
                x = x.when(F.col("__ci") == i, F.col(n))
        bucket = F.least(
            F.lit(buckets - 1),
            F.greatest(F.lit(0), F.floor((F.col("__x") - F.col("__a")) / (F.col("__b") - F.col("__a")) * buckets)),
        ).cast("double")
        counted = (
            joined.where(F.col("__tid").isNotNull())
            .withColumn("__x", x)
            .where(F.col("__x").between(F.col("__a"), F.col("__b")))
            .withColumn("__key", F.when(F.col("__exact") == 1, F.col("__x")).otherwise(bucket))
            .groupBy("__tid", "__key")
            .agg(F.count(F.lit(1)).alias("c"), F.min("__x").alias("mn"), F.max("__x").alias("mx"))
            .collect()
        )
        per_t: dict[int, list] = {}
        for r in counted:
            per_t.setdefault(r["__tid"], []).append((r["__key"], r["c"], r["mn"], r["mx"]))
        ordered = {t: sorted(v) for t, v in per_t.items()}
        for k in open_keys:
            s = states[k]
            want = k[2] - s["below"]
            cum = 0
            for _key, c, mn, mx in ordered.get(s["tid"], []):
                if cum + c > want:
                    s["a"], s["b"], s["below"], s["cnt"] = mn, mx, s["below"] + cum, c
                    if mn == mx:
                        s["value"] = mn
                    break
                cum += c
            else:  # pragma: no cover - counts always cover the bracket
                raise RuntimeError("quantile selection lost its rank")



def exact_ranks(df: DataFrame, col: str, ranks: dict, by: str) -> dict:
    """Values at several 0-based ranks of each group (ascending, nulls ignored): group value ->
    list of values, null where the rank is outside the group. All ranks share the passes."""
    spark = df.sparkSession
    proj = df.select(F.col(by), _no_nan(F.col(col)).alias("__q0")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        groups = proj.groupBy(by).agg(F.count("__q0").alias("n"), F.min("__q0").alias("lo"), F.max("__q0").alias("hi")).collect()
        states = {}
        for gi, row in enumerate(groups):
            for r in set(ranks.get(row[by], [])):
                if 0 <= r < row["n"]:
                    states[(gi, 0, r)] = {"a": row["lo"], "b": row["hi"], "below": 0, "cnt": row["n"],
                                          "value": row["lo"] if row["lo"] == row["hi"] else None}
        _narrow(spark, proj, df.schema, [by], groups, states, ["__q0"], config.QUANTILE_BUCKETS, config.QUANTILE_EXACT_BELOW)
        return {row[by]: [float(states[(gi, 0, r)]["value"]) if (gi, 0, r) in states else None for r in ranks.get(row[by], [])]
                for gi, row in enumerate(groups)}
    finally:
        proj.unpersist()


def exact_order_stats(
    df: DataFrame,
    col: str | Column,
    ranks: dict[tuple, int],
    by: Sequence[str] = (),
    buckets: int | None = None,
    exact_below: int | None = None,
) -> DataFrame:
    """Value at a given 0-based rank (ascending, nulls ignored) per group.

    ``ranks`` maps a tuple of group values (``()`` without ``by``) to a rank.
    Returns ``by`` columns + ``value`` (null if the rank is outside the group).
    """
    spark = df.sparkSession
    by = list(by)
    buckets = buckets or config.QUANTILE_BUCKETS
    exact_below = exact_below or config.QUANTILE_EXACT_BELOW
    proj = df.select(*[F.col(b) for b in by], _no_nan(_as_col(col)).alias("__q0")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        aggs = [F.count("__q0").alias("__q0_n"), F.min("__q0").alias("__q0_lo"), F.max("__q0").alias("__q0_hi")]
        g = proj.groupBy(*by).agg(*aggs) if by else proj.agg(*aggs)
        groups = g.collect()
        states = {}
        for gi, row in enumerate(groups):
            key = tuple(row[b] for b in by)
            r = ranks.get(key)
            n = row["__q0_n"]
            if r is None or r < 0 or r >= n:
                continue
            a, b_ = row["__q0_lo"], row["__q0_hi"]
            states[(gi, 0, r)] = {"a": a, "b": b_, "below": 0, "cnt": n, "value": a if a == b_ else None}
        _narrow(spark, proj, df.schema, by, groups, states, ["__q0"], buckets, exact_below)
        out = []
        for gi, row in enumerate(groups):
            key = tuple(row[b] for b in by)
            r = ranks.get(key)
            st = states.get((gi, 0, r)) if r is not None else None
            out.append((*key, float(st["value"]) if st else None))
        oschema = T.StructType([df.schema[b] for b in by] + [T.StructField("value", T.DoubleType())])
        return small_table(spark, out, oschema)
    finally:
        proj.unpersist()
