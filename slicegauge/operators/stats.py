"""Correlation, bootstrap and permutation operators, grouped by test.

Replicates are a grouping key, so a thousand resamples of every dataset are
one shuffle instead of a loop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import attach, gather, join_on, no_nan
from ..functions.hashing import draw_int, draw_key
from ..session import is_small, materialize
from .ranking import average_ranks, hash_ranked

MIN_PAIRS = 3
MIN_SLICES = 4
# Two R2 differences this close are equal: summation order must not decide a tie.
TIE = 1e-12
# A relative spread below this is a constant column after averaging.
NOISE = 1e-12


def varies(x: str) -> str:
    """SQL aggregate: whether a column spans more than rounding noise."""
    return f"(max({x}) - min({x}) > {NOISE!r}D * greatest(abs(max({x})), abs(min({x}))))"


def unit_interval(r: str) -> str:
    """SQL: clip to [-1, 1], keeping NULL (which `greatest` and `least` would skip)."""
    return f"IF({r} IS NULL, NULL, greatest(-1.0D, least(1.0D, {r})))"


def pearson_of(x: str, y: str) -> Column:
    """Aggregate: Pearson r; NULL below three pairs or without variance.

    Both columns must be missing together. Built from moments rather than
    `corr`, which fails on a constant under ANSI mode.
    """
    r = f"try_divide(covar_pop({x}, {y}), stddev_pop({x}) * stddev_pop({y}))"
    return F.expr(f"CASE WHEN count({x}) >= {MIN_PAIRS} AND {varies(x)} AND {varies(y)} "
                  f"THEN {unit_interval(r)} END")


def pairs_long(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(keys, x_name, y_name, x, y): complete pairs of every listed column pair."""
    cells = F.array(*[F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"),
                               no_nan(F.col(a).cast("double")).alias("x"),
                               no_nan(F.col(b).cast("double")).alias("y")) for a, b in pairs])
    return df.select(*keys, F.inline(cells)).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, pearson_r); n counts the complete pairs."""
    a, b = no_nan(F.col(x).cast("double")), no_nan(F.col(y).cast("double"))
    full = a.isNotNull() & b.isNotNull()
    return (df.select(*by, F.when(full, a).alias("__x"), F.when(full, b).alias("__y")).groupBy(*by)
            .agg(F.count("__x").alias("n"), pearson_of("__x", "__y").alias("pearson_r")))


def _spearman_parts(pairs: DataFrame, g: Sequence[str], small_bytes: int | None) -> DataFrame:
    """(g, n, spearman_rho) for a long frame with x and y.

    Pairs are counted first: equal pairs collapse map-side and the two rank
    joins meet one row per distinct pair. Beyond the small size the counts and
    ranks are written: few ranks are then known to be few and broadcast.
    """
    written = (lambda df: df) if is_small(pairs, small_bytes) else materialize
    joint = written(pairs.groupBy(*g, "x", "y").agg(F.count(F.lit(1)).alias("c")))
    rx = written(average_ranks(joint, g, "x", "c", small_bytes).withColumnRenamed("avg_rank", "rx"))
    ry = written(average_ranks(joint, g, "y", "c", small_bytes).withColumnRenamed("avg_rank", "ry"))
    both = join_on(join_on(joint, rx, [*g, "x"]), ry, [*g, "y"])
    # the mean rank is (n + 1) / 2 by definition
    n = F.sum("c")
    sums = both.groupBy(*g).agg(
        n.alias("n"),
        F.sum(F.col("c") * F.col("rx") * F.col("rx")).alias("sxx"),
        F.sum(F.col("c") * F.col("ry") * F.col("ry")).alias("syy"),
        F.sum(F.col("c") * F.col("rx") * F.col("ry")).alias("sxy"),
        F.expr(f"{varies('x')} AND {varies('y')}").alias("varies"))
    mean = (F.col("n") + 1) / F.lit(2.0)
    cov = F.col("sxy") / F.col("n") - mean * mean
    vx, vy = F.col("sxx") / F.col("n") - mean * mean, F.col("syy") / F.col("n") - mean * mean
    sums = sums.select(*g, "n", "varies", F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)).alias("rho"))
    return sums.select(*g, "n", F.when((F.col("n") >= MIN_PAIRS) & F.col("varies"),
                                       F.expr(unit_interval("rho"))).alias("spearman_rho"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), small_bytes: int | None = None) -> DataFrame:
    """(by, n, spearman_rho) with average ranks for ties."""
    out = _spearman_parts(pairs_long(df, by, [(x, y)]), [*by, "x_name", "y_name"], small_bytes)
    return out.drop("x_name", "y_name")


def bootstrap(pairs: DataFrame, g: Sequence[str], key: str, n_boot: int = 1000, seed: int = 42,
              min_slices: int = MIN_SLICES, small_bytes: int | None = None) -> DataFrame:
    """(g, status, n_slices, r_mean, ci_low, ci_high, n_resamples) of a long pair frame.

    Every row stands for one draw per replicate; the draw's hash names the
    position it copies, found by an equi-join. Draws depend on (seed,
    replicate, draw number) only.
    """
    keyed = pairs.withColumn("__k", draw_key(seed, "position", F.col(key)))
    pos = hash_ranked(keyed, g, "__k", [key], "__pos", small_bytes=small_bytes).select(*g, "x", "y", "__pos")
    size = pairs.groupBy(*g).agg(F.count(F.lit(1)).alias("__n"))
    base = join_on(pos, size, g).where(F.col("__n") >= min_slices)
    draws = base.select(*g, "__n", "__pos", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("__rep"))
    pick = draw_int(draw_key(seed, "draw", F.col("__rep"), F.col("__pos"))) % F.col("__n") + 1
    draws = draws.select(*g, "__rep", pick.alias("__pos"))
    reps = join_on(draws, pos, [*g, "__pos"]).groupBy(*g, "__rep").agg(pearson_of("x", "y").alias("__r"))
    # at most n_boot values per test
    ci = F.percentile("__r", F.array(F.lit(0.025), F.lit(0.975)))
    done = reps.groupBy(*g).agg(F.avg("__r").alias("r_mean"), ci.alias("__ci"), F.count("__r").alias("n_resamples"))
    out = gather([size, done], g)
    status = (F.when(F.col("__n") < min_slices, "underpowered")
               .when(F.coalesce("n_resamples", F.lit(0)) == 0, "all_resamples_invalid").otherwise("ok"))
    return out.select(*g, status.alias("status"), F.col("__n").alias("n_slices"), "r_mean",
                      F.get("__ci", F.lit(0)).alias("ci_low"), F.get("__ci", F.lit(1)).alias("ci_high"),
                      F.coalesce("n_resamples", F.lit(0)).alias("n_resamples"))


def bootstrap_blocks(pairs: DataFrame, g: Sequence[str], key: str, n_blocks: int = 200, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """(g, n_rows, n_blocks, pearson_r, r_mean, ci_low, ci_high, n_resamples) for tables of many rows.

    Rows are dealt by a hash of their key into `n_blocks` blocks, each kept as its six
    sums (n, x, y, xx, yy, xy). A replicate adds up as many blocks as there are, drawn
    with replacement, so its cost is blocks x replicates whatever the number of rows.
    Sums are taken about the group's means. Rows without x or y are left out. For few
    rows `bootstrap`, which draws single rows, is the better choice.
    """
    rows = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    centre = rows.groupBy(*g).agg(F.avg("x").alias("__mx"), F.avg("y").alias("__my"))
    at = attach(rows, centre, g).withColumns({"__x": F.col("x") - F.col("__mx"), "__y": F.col("y") - F.col("__my")})
    at = at.withColumn("__block", draw_int(draw_key(seed, "block", F.col(key))) % n_blocks)
    sums = {"__n": F.count(F.lit(1)), "__sx": F.sum("__x"), "__sy": F.sum("__y"), "__sxx": F.sum(F.col("__x") * F.col("__x")),
            "__syy": F.sum(F.col("__y") * F.col("__y")), "__sxy": F.sum(F.col("__x") * F.col("__y"))}
    # from here on at most n_blocks rows per group; written, as draws and point estimates both start from them
    blocks = materialize(at.groupBy(*g, "__block").agg(*[v.alias(k) for k, v in sums.items()]))
    w = Window.partitionBy(*g) if g else Window.partitionBy()
    blocks = blocks.withColumns({"__pos": F.row_number().over(w.orderBy("__block")), "__size": F.count(F.lit(1)).over(w)})
    draws = blocks.select(*g, "__size", "__pos", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("__rep"))
    pick = draw_int(draw_key(seed, "draw", F.col("__rep"), F.col("__pos"))) % F.col("__size") + 1
    draws = draws.select(*g, "__rep", pick.alias("__pos"))
    total = [F.sum(k).alias(k) for k in sums]
    cov, vx, vy = (f"(__n * {a} - {b})" for a, b in (("__sxy", "__sx * __sy"), ("__sxx", "__sx * __sx"), ("__syy", "__sy * __sy")))
    # shares of variance below rounding are a constant column
    r = F.expr(f"CASE WHEN __n >= {MIN_PAIRS} AND {vx} > 1e-12 * __n * __sxx AND {vy} > 1e-12 * __n * __syy "
               f"THEN {unit_interval(f'{cov} / sqrt({vx}) / sqrt({vy})')} END")
    reps = join_on(draws, blocks.drop("__size", "__block"), [*g, "__pos"]).groupBy(*g, "__rep").agg(*total).withColumn("__r", r)
    ci = F.percentile("__r", F.array(F.lit(0.025), F.lit(0.975)))
    done = reps.groupBy(*g).agg(F.avg("__r").alias("r_mean"), ci.alias("__ci"), F.count("__r").alias("n_resamples"))
    point = blocks.groupBy(*g).agg(*total, F.count(F.lit(1)).alias("n_blocks")).withColumn("pearson_r", r)
    out = gather([point.select(*g, F.col("__n").alias("n_rows"), "n_blocks", "pearson_r"), done], g)
    return out.select(*g, "n_rows", "n_blocks", "pearson_r", "r_mean", F.get("__ci", F.lit(0)).alias("ci_low"),
                      F.get("__ci", F.lit(1)).alias("ci_high"), "n_resamples")


def correlate(df: DataFrame, by: Sequence[str], key: str, pairs: Sequence[tuple[str, str]],
              n_boot: int = 1000, seed: int = 42, small_bytes: int | None = None) -> DataFrame:
    """Point estimates and bootstrap of every (by, x, y) test in one plan."""
    g = [*by, "x_name", "y_name"]
    long = pairs_long(df, [*by, key], pairs)
    point = long.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), pearson_of("x", "y").alias("pearson_r"))
    rank = _spearman_parts(long, g, small_bytes).drop("n")
    boot = bootstrap(long, g, key, n_boot, seed, small_bytes=small_bytes)
    return gather([point, rank, boot], g)


def group_means(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean per group of the listed columns that exist, missing values skipped."""
    cols = [c for c in columns if c in df.columns]
    return df.groupBy(*by).agg(*[F.avg(no_nan(F.col(c).cast("double"))).alias(c) for c in cols])


def r_squared(df: DataFrame, predictors: Sequence[str], outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, r2_<predictor>...) over rows complete in all columns."""
    cols = [*predictors, outcome]
    full = df.select(*by, *[no_nan(F.col(c).cast("double")).alias(c) for c in cols]).dropna(subset=cols)
    return full.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[
        F.pow(pearson_of(p, outcome), F.lit(2.0)).alias(f"r2_{p}") for p in predictors])


def delta_r2(df: DataFrame, conditional: str, uniform: str, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    out = r_squared(df, [conditional, uniform], outcome, by)
    a, b = F.col(f"r2_{conditional}"), F.col(f"r2_{uniform}")
    return out.select(*by, "n", a.alias("r2_conditional"), b.alias("r2_uniform"), (a - b).alias("delta_r2"))


def trend_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, slope, intercept) of the least-squares line; NULL when x is constant."""
    long = pairs_long(df, by, [(x, y)])
    ok = (F.count(F.lit(1)) >= 2) & F.expr(varies("x"))
    return long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                 F.when(ok, F.regr_slope("y", "x")).alias("slope"),
                                 F.when(ok, F.regr_intercept("y", "x")).alias("intercept"))


def with_enough_range(df: DataFrame, columns: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by, <column>_range...) of the groups in which every column spans its minimum."""
    out = df.groupBy(*by).agg(*[
        (F.max(no_nan(F.col(c).cast("double"))) - F.min(no_nan(F.col(c).cast("double")))).alias(f"{c}_range")
        for c in columns])
    for c, least in columns.items():
        out = out.where(F.col(f"{c}_range") >= least)
    return out


def permutation_delta_r2(df: DataFrame, by: Sequence[str], key: str, conditional: str, uniform: str,
                         outcome: str, n_perm: int = 1000, seed: int = 42,
                         small_bytes: int | None = None) -> DataFrame:
    """(by, n_permutations, permutation_p): two-sided p of the R2 difference.

    The outcome's order under permutation p is an md5 order of (p, key), so it
    pairs with the predictors by an equi-join on position.
    """
    cols = [conditional, uniform, outcome]
    full = df.select(*by, key, *[no_nan(F.col(c).cast("double")).alias(c) for c in cols]).dropna(subset=cols)
    pos = hash_ranked(full.withColumn("__k", draw_key(seed, "position", F.col(key))), by, "__k", [key],
                      "__pos", small_bytes=small_bytes).drop("__k")
    perms = F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("__perm")
    shuffled = full.select(*by, key, F.col(outcome).alias("__y"), perms)
    shuffled = hash_ranked(shuffled.withColumn("__k", draw_key(seed, "perm", F.col("__perm"), F.col(key))),
                           [*by, "__perm"], "__k", [key], "__pos", small_bytes=small_bytes)
    null = join_on(shuffled.select(*by, "__perm", "__y", "__pos"),
                   pos.select(*by, "__pos", conditional, uniform), [*by, "__pos"])
    diff = F.pow(pearson_of(conditional, "__y"), F.lit(2.0)) - F.pow(pearson_of(uniform, "__y"), F.lit(2.0))
    each = null.groupBy(*by, "__perm").agg(diff.alias("__d")).where(F.col("__d").isNotNull())
    real = delta_r2(full, conditional, uniform, outcome, by).select(*by, F.col("delta_r2").alias("__real"))
    return join_on(each, real, by).groupBy(*by).agg(
        F.count("__d").alias("n_permutations"),
        F.avg((F.abs("__d") >= F.abs("__real") - TIE).cast("int")).alias("permutation_p"))
