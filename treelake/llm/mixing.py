"""Mixing sources to target weights: temperature mixing, in SQL functions only.

A source with the share p of all tokens gets the weight p**a / sum(p**a). The
exponent a in [0, 1] is bisected: the largest for which the weights' entropy is
at least ``entropy`` times that of equal weights, but never below the least for
which no source is repeated more than ``repeats`` times within the budget.

The weights become quotas of the token budget. A source's documents are laid out
in passes; a pass is a pseudo-random permutation (by MD5 of seed, pass and id) cut
into blocks at fixed places of the hash range. A quota takes whole passes, then
whole blocks of one more pass, then documents of one block in order, as long as
they fit. Only one block of each source is ever ordered in one task; the
sources' and blocks' sums come from partial aggregates, so a source that holds a
third of all rows costs no more than others.

Bisection evaluates a grid of exponents in one aggregate over sources and sends
its few sums to the driver, not the sources.

Defined cases: a null source is a source of its own; a null or empty text has no
tokens, adds nothing to its source and is taken in whole passes only, or where
it stands before the quota's end; repeated rows count as rows (equal ids are
ordered by their MD5 of text); an empty table or a budget of 0 gives an empty result;
a single source has weight 1.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treelake.llm._arrow import col
from treelake.llm._spark import written

ENTROPY = 0.98
REPEATS = 4.0
SEED = 20
#: Blocks of a permutation: its hash's first BLOCK_DIGITS hexadecimal digits.
BLOCK_DIGITS = 3
GRID, ROUNDS = 33, 6


def token_count(text):
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def bisect_exponent(sources: DataFrame, budget: float, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """sources: (source, tokens > 0). Rounded to six digits."""
    whole = sources.agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.min("tokens").alias("least")).first()
    n, total = whole["n"], whole["t"] or 0
    if n < 2 or not total:
        return 1.0
    p = F.col("tokens") / F.lit(float(total))

    def sums(grid: list[float]) -> list[tuple[float, float]]:
        row = sources.agg(*(F.sum(F.pow(p, F.lit(a))).alias(f"z{k}") for k, a in enumerate(grid)), *(F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{k}") for k, a in enumerate(grid))).first()
        return [(row[f"z{k}"], row[f"l{k}"]) for k in range(len(grid))]

    def last_true(holds) -> float:
        """The largest exponent for which holds(a, z, l), true at 0 and monotone; 0 if it's false there."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * k / (GRID - 1) for k in range(GRID)]
            ok = [holds(a, *zl) for a, zl in zip(grid, sums(grid))]
            if all(ok):
                return high
            k = ok.index(False)
            low, high = grid[max(0, k - 1)], grid[k]
            if high - low < 1e-9:
                break
        return low

    flat = last_true(lambda a, z, l: math.log(z) - a * l / z >= entropy * math.log(n) - 1e-12)
    least = whole["least"] / total
    too_often = last_true(lambda a, z, l: budget / total * least ** (a - 1) / z > repeats)
    return round(max(flat, too_often), 6)


def weights(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """docs: (source, tokens). (source, tokens, exponent, weight, quota): quota in tokens."""
    sources = written(docs.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "mix-sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    a = bisect_exponent(sources, budget, entropy, repeats)
    raised = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a))
    z = sources.agg(F.sum(raised)).first()[0] or 1.0
    weight = raised / F.lit(z)
    return sources.select("source", "tokens", F.lit(a).alias("exponent"), weight.alias("weight"), F.floor(F.round(weight * F.lit(float(budget)), 3)).alias("quota"))


def _order(seed: int, pass_, i, m):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), pass_.cast("string"), i.cast("string"), m))


def cuts(docs: DataFrame, budget: int | None, entropy: float, repeats: float, seed: int) -> DataFrame:
    """docs: (i, source, tokens, m). Of each source: weight, whole passes, and where its last pass ends (block and key)."""
    quotas = weights(docs.select("source", "tokens"), budget, entropy, repeats)
    quotas = quotas.withColumn("whole", F.floor(F.col("quota") / F.col("tokens")).cast("int"))
    quotas = written(quotas.select(F.col("source").alias("qs"), "weight", "whole", (F.col("quota") - F.col("whole") * F.col("tokens")).alias("rest")), "mix-quotas")
    # Sources can be many: the join is left to Spark, which broadcasts a small side and splits a hot source's rows.
    laid = docs.join(quotas, F.col("source").eqNullSafe(F.col("qs"))).drop("qs").withColumn("order", _order(seed, F.col("whole"), F.col("i"), F.col("m")))
    laid = laid.withColumn("block", F.substring("order", 1, BLOCK_DIGITS))
    blocks = laid.groupBy("source", "block").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    sums = Window.partitionBy("source").orderBy("block")
    blocks = blocks.withColumn("until", F.sum("n").over(sums)).withColumn("before", F.col("until") - F.col("n"))
    ends = blocks.where("rest > 0 AND before <= rest AND until > rest").select(F.col("source").alias("es"), F.col("block").alias("end"), (F.col("rest") - F.col("before")).alias("left"))
    ends = written(ends, "mix-ends")
    ordered = Window.partitionBy("source").orderBy("order", "i", "m").rowsBetween(Window.unboundedPreceding, 0)
    inside = laid.join(ends, F.col("source").eqNullSafe(F.col("es")) & (F.col("block") == F.col("end")))
    inside = inside.withColumn("sum", F.sum("tokens").over(ordered)).where("sum <= left")
    last = inside.groupBy("source").agg(F.max(F.struct("order", "i", "m")).alias("last")).select(F.col("source").alias("ls"), "last")
    out = quotas.join(ends.drop("left"), F.col("qs").eqNullSafe(F.col("es")), "left").join(last, F.col("qs").eqNullSafe(F.col("ls")), "left")
    return written(out.select("qs", "weight", "whole", "rest", "end", "last"), "mix-cuts")


def _passes(rows: DataFrame, found: DataFrame, seed: int) -> DataFrame:
    """rows: with columns i, source, m. A row for each pass that takes it."""
    out = rows.join(found, F.col("source").eqNullSafe(F.col("qs"))).drop("qs")
    out = out.withColumn("order", _order(seed, F.col("whole"), F.col("i"), F.col("m")))
    begun = (F.substring("order", 1, BLOCK_DIGITS) < F.col("end")) | (F.col("last").isNotNull() & (F.struct("order", "i", "m") <= F.col("last")))
    count = F.col("whole") + F.when((F.col("rest") > 0) & F.coalesce(begun, F.lit(False)), 1).otherwise(0)
    return out.where(count > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), count - 1)))


def _slim(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    key = F.md5(F.coalesce(col(text_col), F.lit("")))
    docs = df.select(col(id_col).alias("i"), col(source_col).cast("string").alias("source"), token_count(col(text_col)).alias("tokens"), key.alias("m"))
    return written(docs, "mix-docs")  # texts are read once; what follows reads ids and counts


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: int | None = None,
    entropy: float = ENTROPY,
    repeats: float = REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """(id, source, tokens, weight, pass, order): a row for each time a document is taken.

    Training order is by ``order`` within each pass; budget: tokens, those of df
    by default.
    """
    docs = _slim(df, id_col, text_col, source_col)
    out = _passes(docs, cuts(docs, budget, entropy, repeats, seed), seed)
    return out.select(F.col("i").alias(id_col), "source", "tokens", "weight", "pass", _order(seed, F.col("pass"), F.col("i"), F.col("m")).alias("order"))


def mixed_rows(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: int | None = None,
    entropy: float = ENTROPY,
    repeats: float = REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """Rows of df, all columns, each as often as it is taken."""
    docs = _slim(df, id_col, text_col, source_col)
    names = [f"c{k}" for k in range(len(df.columns))]
    rows = df.toDF(*names)
    at = dict(zip(df.columns, names))
    rows = rows.withColumns({"i": F.col(at[id_col]), "source": F.col(at[source_col]).cast("string"), "m": F.md5(F.coalesce(F.col(at[text_col]), F.lit("")))})
    return _passes(rows, cuts(docs, budget, entropy, repeats, seed), seed).select(names).toDF(*df.columns)
