"""Mixing sources to target weights by Pareto order sampling (operator 1).

Every source gets a target; whole copies that fit into it are certain, and the
rest is a sample without replacement: documents are ranked by their random odds
U / (1 - U) divided by their inclusion odds, and taken in that order up to the
number of words left. As the ranking only needs odds up to a factor per source,
the cut alone fixes the sample's size. Up to three closing documents behind
the cut, each the one nearest to the words still missing (only the last may go beyond), bring the sum next to the target.

The ranking is never sorted as a whole: words per (source, rank range) find the
range that holds the cut, twice, and only that range is ordered.

Draws are hashes of the row, so reruns agree; rows equal in id and text share a
draw and are taken or left together. Null or empty texts have size 0 and are in
whole copies only. A null source is a source of its own. An empty table gives no
rows. Columns of the input are kept; those added start with `_mix_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .base import WORD, ranked

RANGES = 1024
BROADCAST_SOURCES = 10_000
CLOSINGS = 3


def words(text: str = "text") -> Column:
    return F.coalesce(F.size(F.expr(f"regexp_extract_all({text}, '{WORD.replace(chr(92), chr(92) * 2)}', 0)")), F.lit(0)).cast("long")


def draw(seed: int = 1) -> Column:
    """63 random bits of a row's id and text."""
    return F.xxhash64("doc_id", "text", F.lit(seed))


def targets(sizes: DataFrame, shares: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """source, source_size, target: shares repeat over the sources by code point, null last.

    Targets above `cap` times their source stop there; the excess is shared out
    again by weight until none is above. One row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = ranked(per, [F.col("source").isNull(), F.col("source")], "_at")
    weight = F.element_at(F.array(*[F.lit(s) for s in shares]), (F.col("_at") % len(shares) + 1).cast("int"))
    at = materialize(at.select("source", "source_size", weight.alias("weight")))
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    total, weights = at.agg(F.sum(exact("source_size")), F.sum("weight")).first()
    left, capped = total or 0, F.lit(False)
    while total:
        # above the cap: cap * size < left * weight / weights, in whole numbers
        capped = exact("source_size") * (cap * int(weights)) < exact("weight") * F.lit(left)
        got, rest = at.agg(F.sum(F.when(capped, exact("source_size") * cap)), F.sum(F.when(~capped, F.col("weight")))).first()
        now = total - (got or 0)
        if now == left and rest == weights:
            break
        left, weights = now, rest
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(weights or 1))
    return at.select("source", "source_size", F.when(capped, F.col("source_size") * float(cap)).otherwise(share).alias("target"))


def order_key(draw_bits: Column, size: Column, half: float = 256.0) -> Column:
    """Random odds over inclusion odds. Inclusion odds grow with the size and level off: size / (size + half)."""
    u = (F.shiftrightunsigned(draw_bits, 11).cast("double") + 0.5) / float(1 << 53)
    odds = (size + 0.001) / (size + half)
    return (u / (1 - u)) / odds


def cuts(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: whole copies, the last key of the sample and the closing row's draw.

    `sizes` has source, size, draw; `goals` is what `targets` gives.
    """
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)) + 1e-12)
    need = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    goals = goals.select(F.col("source").alias("_s"), "source_size", "target", whole.cast("int").alias("whole"), F.greatest(need, F.lit(0)).alias("need"))
    few = goals.count() <= BROADCAST_SOURCES
    side = (lambda d: F.broadcast(d)) if few else (lambda d: d)
    rows = sizes.filter("size > 0").select("source", "size", "draw", order_key(F.col("draw"), F.col("size")).alias("key"))
    place = F.col("key") / (1 + F.col("key"))
    base = goals.drop("source_size", "target").withColumn("before", F.lit(0).cast("long"))
    low = F.lit(0.0)
    width = 1.0
    rows = rows.withColumn("place", place)
    state = base.withColumn("low", low)
    for _ in range(2):
        width /= RANGES
        at = rows.join(side(state), rows["source"].eqNullSafe(state["_s"]))
        at = at.filter((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + width * RANGES))
        slot = F.least(F.floor((F.col("place") - F.col("low")) / width), F.lit(RANGES - 1))
        per = at.groupBy("_s", "whole", "need", "before", "low", slot.alias("slot")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("_s").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        per = per.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(run), F.lit(0)))
        # the range that crosses the need, or the last one if all fit
        hit = per.filter("before <= need").groupBy("_s").agg(F.max(F.struct("slot", "whole", "need", "before", "low")).alias("x"))
        state = materialize(hit.select("_s", "x.whole", "x.need", "x.before", (F.col("x.low") + F.col("x.slot") * width).alias("low")))
    at = rows.join(side(state), rows["source"].eqNullSafe(state["_s"]))
    inside = at.filter((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + width))
    inside = inside.withColumn("sum", F.col("before") + F.sum("size").over(Window.partitionBy("_s").orderBy("key", "draw")))
    fits = inside.filter("sum <= need").groupBy("_s").agg(F.max(F.struct("key", "draw", "sum")).alias("last"))
    cut = state.alias("g").join(fits.withColumnRenamed("_s", "_f"), F.col("g._s").eqNullSafe(F.col("_f")), "left").select(
        "_s", "whole", "need", F.coalesce("last.key", F.lit(-1.0)).alias("k_in"), F.coalesce("last.draw", F.lit(0)).alias("d_in"),
        F.coalesce("last.sum", "before").alias("have"), "low")
    cut = materialize(cut.withColumn("closing", F.array().cast("array<bigint>")))
    for turn in range(CLOSINGS):
        gap = F.col("need") - F.col("have")
        near = rows.join(side(cut), rows["source"].eqNullSafe(cut["_s"])).filter(
            ~_inside() & ~F.array_contains("closing", F.col("draw")) & (F.col("size") <= (gap if turn < CLOSINGS - 1 else 2 * gap - 1)))
        last = near.groupBy("_s").agg(F.min(F.struct(F.abs(gap - F.col("size")).alias("off"), "size", "draw")).alias("x"))
        last = last.withColumnRenamed("_s", "_c")
        cut = materialize(cut.join(last, F.col("_s").eqNullSafe(F.col("_c")), "left").select(
            "_s", "whole", "need", "k_in", "d_in", (F.col("have") + F.coalesce("x.size", F.lit(0))).alias("have"), "low",
            F.when(F.col("x").isNull(), F.col("closing")).otherwise(F.array_append("closing", F.col("x.draw"))).alias("closing")))
    out = goals.alias("g").join(cut.drop("whole", "need").withColumnRenamed("_s", "_k"), F.col("g._s").eqNullSafe(F.col("_k")), "left")
    return materialize(out.drop("_k"))


def _inside(key: str = "key", bits: str = "draw", mark: str = "") -> Column:
    """Rows up to the cut: those before the cut's range, and those of the range up to the last key."""
    place = F.col(key) / (1 + F.col(key))
    in_range = (F.col(key) < F.col(f"{mark}k_in")) | ((F.col(key) == F.col(f"{mark}k_in")) & (F.col(bits) <= F.col(f"{mark}d_in")))
    return F.coalesce((place < F.col(f"{mark}low")) | in_range, F.lit(False))


CUT = ("source_size", "target", "whole", "need", "k_in", "d_in", "have", "low", "closing")


def mix(rows: DataFrame, cut: DataFrame, source: str = "source", size: str = "_mix_size", bits: str = "_mix_draw") -> DataFrame:
    """`rows` with `_mix_copies`, the times the mix takes each row, and its source's `_mix_source_size` and `_mix_target`.

    A map-side join with one row per source, as long as those are few.
    """
    cut = cut.withColumnsRenamed({"_s": "_mix_source", **{c: f"_mix_{c}" for c in CUT}})
    side = F.broadcast(cut) if cut.count() <= BROADCAST_SOURCES else cut
    out = rows.withColumn("_mix_key", order_key(F.col(bits), F.col(size)))
    out = out.join(side, out[source].eqNullSafe(side["_mix_source"]), "left")
    extra = (_inside("_mix_key", bits, "_mix_") | F.coalesce(F.array_contains("_mix_closing", F.col(bits)), F.lit(False))) & (F.col(size) > 0)
    out = out.withColumn("_mix_copies", (F.coalesce("_mix_whole", F.lit(0)) + extra.cast("int")).cast("int"))
    return out.drop("_mix_key", "_mix_source", *[f"_mix_{c}" for c in CUT[2:]])


def measure(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, source, size, draw of every document, written once: later passes do not read the texts again."""
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words().alias("size"), draw(seed).alias("draw")))


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The rows of `docs`, with their columns, each as often as the mix takes it."""
    rows = measure(docs, seed)
    cut = cuts(rows, targets(rows))
    sized = docs.withColumns({"_mix_size": words(), "_mix_draw": draw(seed)})
    many = mix(sized, cut).filter("_mix_copies > 0")
    return many.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
