"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent and normalised. The exponent is found by bisection: the largest one
whose mixture reaches the target entropy, but not so small that a source would be repeated more than allowed.
Each source then gets its weight's share of the token budget: whole epochs of all its documents, and of one more
epoch the first documents of a permutation, block by block, until the rest of its budget is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import SPACE_CLASS, masked, quoted, stray_columns, write_table

#: Bisection: the bracket shrinks to 1/16 in a job (four halvings read off one pass), 12 jobs.
GRID, JOBS = 16, 12
PLACE_BITS, BLOCK_BITS = 60, 10


def n_words(text: Column) -> Column:
    """Words (runs without blanks) of a text; 0 for null."""
    plain = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, SPACE_CLASS + "+"))).cast("long")


def mixture(sources: DataFrame, exponent: Column) -> tuple[Column, Column, Column]:
    """Aggregates over ``sources`` (share): log of the normaliser, entropy, and the smallest share's log-weight ratio."""
    power = F.pow("share", exponent)
    total = F.sum(power)
    return total, F.log(total) - F.sum(power * exponent * F.log("share")) / total, F.max(power / F.col("share")) / total


def solve_exponent(sources: DataFrame, entropy_share: float, repeats: float) -> float:
    """The exponent in [0, 1] for ``sources`` (share: of all tokens, positive).

    Entropy falls and the largest repetition (weight / share) falls as the exponent grows from 0 (equal weights) to
    1 (natural weights). Searched is the largest exponent with entropy >= entropy_share * log(sources); if some
    source would then be repeated more than ``repeats`` times, the smallest exponent that respects the limit.
    Every step is an aggregation over the sources; the driver sees one row per grid point.
    """
    n = sources.count()
    if n < 2:
        return 1.0
    target = entropy_share * F.log(F.lit(float(n)))

    def bracket(good: Column, upwards: bool) -> float:
        # good holds on the side of 0 (upwards: the largest good one is wanted) or on the side of 1 (the smallest)
        low, high = 0.0, 1.0
        for _ in range(JOBS):
            step = (high - low) / GRID
            grid = F.explode(F.array(*[F.lit(low + step * i) for i in range(GRID + 1)])).alias("a")
            total, entropy, repeated = mixture(sources, F.col("a"))
            rows = sources.select("share", grid).groupBy("a").agg(total.alias("total"), entropy.alias("entropy"), repeated.alias("repeated"))
            fits = sorted((r.a, r.good) for r in rows.select("a", good.alias("good")).collect())
            if upwards:
                best = max((i for i, (_, ok) in enumerate(fits) if ok), default=-1)
                if best == GRID:
                    return high
                low, high = (fits[max(best, 0)][0], fits[max(best, 0) + 1][0])
            else:
                best = min((i for i, (_, ok) in enumerate(fits) if ok), default=GRID)
                if best == 0:
                    return low
                low, high = fits[best - 1][0], fits[best][0]
        return low if upwards else high

    tiny = 1e-12
    exponent = bracket(F.col("entropy") >= target - tiny, True)
    least = bracket(F.col("repeated") <= repeats + tiny, False)
    return max(exponent, least)


def source_weights(sizes: DataFrame, entropy_share: float, repeats: float, budget_share: float) -> DataFrame:
    """(source, tokens, weight, budget, epochs, rest) for ``sizes`` (source, tokens): the share of the budget in tokens,
    its whole epochs and what is left for a partial one. The budget is ``budget_share`` of all tokens."""
    total = sizes.agg(F.sum("tokens").alias("t")).first().t or 0
    real = sizes.where("tokens > 0").select("source", "tokens", (F.col("tokens") / F.lit(float(max(total, 1)))).alias("share"))
    exponent = solve_exponent(real, entropy_share, repeats / budget_share)
    norm = real.agg(F.sum(F.pow("share", F.lit(exponent))).alias("z")).first().z or 1.0
    weight = F.pow("share", F.lit(exponent)) / F.lit(norm)
    # rounding to a thousandth of a token keeps the floor off the last bits of the weights
    budget = F.floor(F.round(weight * F.lit(float(total) * budget_share), 3)).cast("long")
    out = real.select("source", "tokens", weight.alias("weight"), budget.alias("budget"))
    return out.select("*", F.expr("budget div tokens").alias("epochs"), F.expr("budget % tokens").alias("rest"))


def _ends(counted: DataFrame, plan: DataFrame, block_docs: int) -> DataFrame:
    """(source, end): the place in its permutation at which a source's partial epoch no longer fits.

    Blocks are ranges of the permutation. Each round cuts the block in which the budget ends into 1,024 smaller
    ones by their word sums, until such blocks hold at most ``block_docs`` documents; those are walked. So a source
    of any size shows 1,024 block sums a round and ``block_docs`` documents at the end to one task.
    """
    state = plan.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("before"))
    shift = PLACE_BITS
    while True:
        inside = counted.join(state, counted.source.eqNullSafe(F.col("s")) & (F.shiftright("place", shift) == F.col("block"))).select("source", "tokens", "place", "rest", "before")
        if shift < PLACE_BITS:
            most = inside.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
            if most <= block_docs or shift == 0:
                break
        shift -= BLOCK_BITS
        sums = inside.groupBy("source", F.shiftright("place", shift).alias("block")).agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"), F.first("before").alias("start"))
        ahead = F.sum("tokens").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.withColumn("before", F.col("start") + F.coalesce(ahead, F.lit(0)))
        state, _ = write_table(sums.where("before <= rest and before + tokens > rest").select(F.col("source").alias("s"), "rest", "block", "before"), "mix-blocks")
    # documents of one place (repeated ids) go in or stay out together
    so_far = F.sum("tokens").over(Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("upto", F.col("before") + so_far).where("upto > rest").groupBy("source").agg(F.min("place").alias("end"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", entropy_share: float = 0.98,
        repeats: float = 4.0, budget_share: float = 1.0, seed: int = 17, block_docs: int = 1_000) -> DataFrame:
    """Documents drawn to target source weights.

    The budget is ``budget_share`` of all words. A source's weight is its word share to the solved exponent,
    normalised; its budget is spent on whole epochs and on the first documents, in the order of a keyed hash of the
    id, of a partial epoch whose words still fit. Sums over blocks of that order tell which blocks fit whole; only the
    one block of about ``block_docs`` documents in which the budget ends is walked.

    Returns every row of ``docs`` with n_words, weight (of its source) and n_copies (how often it is drawn, possibly
    0); input columns of those names are replaced, others pass through. A null source is a source of its own. Null and
    empty texts have no words and are drawn as their place falls; a source without any words is not drawn (weight
    0). Rows that repeat an id and a source are drawn alike, and each counts its words. Very long texts are counted whole. A null id hashes as the word
    null. An empty table gives an empty result.
    """
    through = stray_columns(docs, {"n_words", "weight", "n_copies"})
    # 60 bits of a keyed digest: the order of the partial epoch
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")
    counted = docs.select(F.col(quoted(source_col)).cast("string").alias("source"), n_words(F.col(quoted(text_col))).alias("tokens"), place.alias("place"))
    counted, _ = write_table(counted, "mix-counts")
    plan, _ = write_table(source_weights(counted.groupBy("source").agg(F.sum("tokens").alias("tokens")), entropy_share, repeats, budget_share), "mix-plan")
    drawn, _ = write_table(plan.select("source", "weight", "epochs").join(
        _ends(counted, plan, block_docs).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("__source"), F.col("weight").alias("__weight"), "epochs", F.coalesce("end", F.lit(0)).alias("end")), "mix-drawn")

    # one narrow pass over the documents; the plan has a row per source and is broadcast only below Spark's size limit
    inside, outside = masked(docs, through)
    rows = docs.select(*inside, F.col(quoted(source_col)).cast("string").alias("__key"), place.alias("__place"),
                       n_words(F.col(quoted(text_col))).alias("n_words"))
    joined = rows.join(drawn, F.col("__key").eqNullSafe(F.col("__source")), "left")
    copies = F.coalesce(F.col("epochs") + (F.col("__place") < F.col("end")).cast("long"), F.lit(0))
    return joined.select(*outside, "n_words", F.coalesce("__weight", F.lit(0.0)).alias("weight"), copies.cast("long").alias("n_copies"))


def repeated(drawn: DataFrame) -> DataFrame:
    """Each drawn row n_copies times; an array of copies is made of the row's own columns, so no name can clash."""
    return drawn.where("n_copies > 0").select(F.explode(F.array_repeat(F.struct(*[quoted(c) for c in drawn.columns]), F.col("n_copies").cast("int"))).alias("row")).select("row.*")
