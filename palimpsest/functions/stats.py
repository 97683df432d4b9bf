"""Statistics of association as Column expressions, and agreement of partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def log_factorial(n: Column) -> Column:
    """log n!: exact up to 20, Stirling's series beyond."""
    x = n.cast("double")
    far = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(far)


def log_choose(n: Column, k: Column) -> Column:
    """log of n over k; null outside 0 <= k <= n."""
    return F.when((k >= 0) & (k <= n), log_factorial(n) - log_factorial(k) - log_factorial(n - k))


def fisher_right(a: Column, b: Column, c: Column, d: Column) -> Column:
    """P(count >= a) in a 2x2 table with the same margins.

    Terms fall on both sides of the distribution's mode. Beyond it the right tail is summed from a upwards; else the left tail from a - 1 downwards is taken
    from 1. So the first term is the largest of its sum, from log factorials, and the others follow by their ratio to the one before.
    They are negligible after ten standard deviations and 50 steps (by Bennett's bound what is left is below e^-35 of the sum), nor are there more than some 6 times the square root of the least margin.
    What a ratio is made of goes along from step to step: nothing else is computed anew for each.
    """
    row, column, n = a + b, a + c, a + b + c + d
    right = a.cast("double") * (n + 2) >= (row.cast("double") + 1) * (column + 1)
    start = F.when(right, a).otherwise(a - 1)
    first = F.exp(log_choose(row, start) + log_choose(n - row, column - start) - log_choose(n, column))
    count = F.when(right, F.least(row, column) - a).otherwise(a - 1 - F.greatest(F.lit(0), row + column - n))
    share = lambda x: F.try_divide(x.cast("double"), n)  # noqa: E731 (an empty table has no deviation)
    deviation = F.sqrt(row * share(column) * share(n - row) * share(n - column))
    steps = F.least(count, F.ceil(F.sqrt(32.0 * F.least(row, column, n - row, n - column))) + 2, F.ceil(10.0 * deviation) + 50)

    # A ratio is u * v / (w * z); a step further away from the mode, either way, makes u and v less by 1 and w and z more.
    x = start.cast("double")
    up, down = (row - x, column - x, x + 1, n - row - column + x + 1), (x, n - row - column + x, row - x + 1, column - x + 1)
    walk = F.struct(F.lit(0.0).alias("sum"), first.alias("term"), *(F.when(right, i).otherwise(j).alias(k) for k, i, j in zip("uvwz", up, down, strict=True)))

    def step(acc: Column, _: Column) -> Column:
        u, v, w, z = (acc[k] for k in "uvwz")
        return F.struct((acc["sum"] + acc["term"]).alias("sum"), (acc["term"] * (u * v / (w * z))).alias("term"), (u - 1).alias("u"), (v - 1).alias("v"), (w + 1).alias("w"), (z + 1).alias("z"))

    # The last term is added after the walk, so that no ratio beyond the end is asked for.
    done = F.aggregate(F.sequence(F.lit(0).cast("bigint"), steps - 1), walk, step, lambda x: x["sum"] + x["term"])
    total = F.when(steps > 0, done).otherwise(first)
    return F.when(a <= F.greatest(F.lit(0), row + column - n), F.lit(1.0)).when(right, F.least(F.lit(1.0), total)).otherwise(F.greatest(F.lit(0.0), 1 - total))


def jaccard(both: Column, na: Column, nb: Column) -> Column:
    return F.coalesce(F.try_divide(both, na + nb - both), F.lit(0.0))


def lift(both: Column, na: Column, nb: Column, n: Column) -> Column:
    """Observed over expected; infinite where nothing is expected."""
    return F.when((na > 0) & (nb > 0), both.cast("double") * n / (na.cast("double") * nb)).otherwise(F.lit(float("inf")))


def benjamini_hochberg(df: DataFrame, p: str = "p", out: str = "q", groups: int = 200, salts: int = 32) -> DataFrame:
    """Adds q: the least p * m / rank over equal and higher ranks, at most 1.

    No single task sorts all: distinct p-values go into ranges between quantiles, ranks and minima are taken within
    each range, and one row per range carries the counts below and the minimum above. A row then looks up its value's q. Values that many rows have (1 often is most of them) are counted before the shuffle, and
    there are fewer than ``10 * groups`` with more than that share of the rows: they are known to every task, and their rows, like those without p, are dealt over ``salts`` keys, so that none of them fills a task. Rows without p are no tests: they don't count, and have no q.
    """
    m = df.where(F.col(p).isNotNull()).count()
    if not m:
        return df.withColumn(out, F.lit(None).cast("double"))
    cuts = sorted(set(df.agg(F.percentile_approx(p, [i / groups for i in range(1, groups)], 10_000)).first()[0])) if m > 10_000 else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < F.col(p)))
    # Equal values are in one range, and the highest rank of equals gives the least quotient: so ranks count values up to and including p.
    values = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_n")).withColumn("_part", part)
    up_to = Window.partitionBy("_part").orderBy(p)
    values = values.withColumn("_rank", F.sum("_n").over(up_to))
    sizes = values.groupBy("_part").agg(F.sum("_n").alias("_size"))
    below = sizes.withColumn("_below", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).drop("_size")  # a row per range
    values = values.join(F.broadcast(below), "_part").withColumn("_q", F.col(p) * m / (F.col("_rank") + F.col("_below")))
    least = values.groupBy("_part").agg(F.min("_q").alias("_least"))
    above = least.withColumn("_above", F.min("_least").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))).drop("_least")
    down_to = Window.partitionBy("_part").orderBy(F.desc(p))
    values = values.join(F.broadcast(above), "_part").withColumn(out, F.least(F.lit(1.0), F.coalesce("_above", F.lit(1.0)), F.min("_q").over(down_to)))
    heavy = F.col("_n") > m // (10 * groups)
    common = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n")).where(heavy).select("_p", F.lit(True).alias("_heavy"))
    flagged = df.join(F.broadcast(common), F.col(p) == F.col("_p"), "left").drop("_p")
    salt = F.when(F.col("_heavy") | F.col(p).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(0)
    every = values.select(F.col(p).alias("_p"), out, F.explode(F.sequence(F.lit(0), F.when(heavy, salts - 1).otherwise(0))).alias("_salt"))
    dealt = flagged.withColumn("_salt_", salt)
    return dealt.join(every, (F.col(p) == F.col("_p")) & (F.col("_salt_") == F.col("_salt")), "left").select(*df.columns, out)


def adjusted_rand(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """One row per group: ari of two labellings; NaN where it isn't defined (fewer than two rows, or nothing to expect)."""
    by = by or []
    pairs = lambda n: n * (n - 1) / 2
    cells = df.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    both = cells.groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("nij"), F.sum("n").alias("total"))
    sides = []
    for column, name in ((a, "na"), (b, "nb")):
        sides.append(cells.groupBy(*by, column).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias(name)))
    if by:
        out = both.join(sides[0], by).join(sides[1], by)
    else:
        key = F.lit(1).alias("_one")
        out = both.select("*", key).join(sides[0].select("*", key), "_one").join(sides[1].select("*", key), "_one")
    expected = F.try_divide(F.col("na") * F.col("nb"), pairs(F.col("total")))
    mean = (F.col("na") + F.col("nb")) / 2
    ari = F.when((F.col("total") < 2) | (mean == expected), F.lit(float("nan"))).otherwise((F.col("nij") - expected) / (mean - expected))
    return out.select(*by, ari.alias("ari"))
