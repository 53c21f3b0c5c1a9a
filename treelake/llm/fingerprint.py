"""Document fingerprints: threshold-scaled sketches of word shingles, in SQL functions only.

A text's sketch keeps every shingle hash in the lowest FRACTION of the 64-bit
range, whatever the text's length, so sketches of any two texts are samples of
the same part of hash space and intersection over size estimates Jaccard likeness
and containment also between very unequal texts. Beside these, a sketch keeps the
LEAST least hashes of its set (all of a smaller set), so that a text of few
shingles has a sample too. So each sketch is complete up to a bound of its own,
the fraction's or its LEAST-th hash, whichever is larger; two are compared up to
the lesser bound, and the union of two sketches holds the sketch of the united
texts.

Shingles are SHINGLE consecutive words (text between ASCII white space, A-Z in
lower case); a text of fewer words has its whole word sequence as one shingle.

Defined cases: a null text is the empty text; a text without words has the
fingerprint ``f:``; two empty sketches are alike (1.0), and an empty and a filled
one are not (0.0); very long texts are
sketched whole; equal texts have equal sketches; an empty table gives an empty
result; other columns are dropped.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelake.llm._arrow import col

SHINGLE = 5
#: One in so many hashes is kept.
SCALE = 4
LEAST = 64
#: Rows of a block of neighbouring ids, and most blocks.
BLOCK_ROWS, BLOCKS = 200, 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _limit(scale: int) -> int:
    return -(1 << 63) + (1 << 64) // scale


def word_hashes(text: Column) -> Column:
    """Array of a 64-bit hash for each word."""
    words = F.split(F.translate(text, _UPPER, _LOWER), r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def with_sketch(df: DataFrame, text: Column, name: str, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """df with the column ``name``: array<long>, the kept hashes of a text column, ascending.

    The word hashes are a column of their own below, so that they are computed
    once for a row and not once for each shingle.
    """
    words, all_ = f"__{name}_w", f"__{name}_h"
    w = F.col(words)
    rolled = F.transform(F.sequence(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(shingle))))
    hashes = F.when(F.size(w) >= shingle, rolled).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w.cast("array<string>"), ",")))).otherwise(F.array().cast("array<bigint>"))
    out = df.withColumn(words, word_hashes(F.coalesce(text, F.lit("")))).withColumn(all_, hashes)
    low = F.array_sort(F.array_distinct(F.filter(F.col(all_), lambda h: h < _limit(scale))))
    # The least hashes of all are needed only where the fraction holds too few.
    out = out.withColumn(name, low)
    return out.withColumn(name, F.when(F.size(name) >= LEAST, F.col(name)).otherwise(F.slice(F.array_sort(F.array_distinct(F.col(all_))), F.lit(1), F.lit(LEAST)))).drop(words, all_)


def as_text(sketch: Column) -> Column:
    """``f:`` and the kept hashes in hexadecimal."""
    return F.concat(F.lit("f:"), F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def _bound(sketch: Column, scale: int) -> Column:
    """Up to which hash the sketch holds all of its set."""
    return F.when(F.size(sketch) < LEAST, F.lit((1 << 63) - 1)).otherwise(F.greatest(F.get(sketch, F.lit(LEAST - 1)), F.lit(_limit(scale) - 1)))


def _common(a: Column, b: Column, scale: int) -> tuple[Column, Column, Column]:
    bound = F.least(_bound(a, scale), _bound(b, scale))
    up_to = lambda s: F.filter(s, lambda h: h <= bound)
    x, y = up_to(a), up_to(b)
    return F.size(F.array_intersect(x, y)), F.size(x), F.size(y)


def jaccard(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated Jaccard likeness of two sketched texts, 0 to 1."""
    both, x, y = _common(a, b, scale)
    return F.when(x + y == 0, F.lit(1.0)).otherwise(both / F.greatest(x + y - both, F.lit(1)))


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of a's shingles that b has too; null where a's part of the sketch is empty."""
    both, x, _ = _common(a, b, scale)
    return F.when(x > 0, both / x)


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the union of two sketched sets."""
    every = F.array_sort(F.array_union(a, b))
    return F.concat(F.slice(every, F.lit(1), F.lit(LEAST)), F.filter(F.slice(every, F.lit(LEAST + 1), F.greatest(F.size(every), F.lit(0))), lambda h: h < _limit(scale)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sketch, fingerprint) of every text."""
    out = with_sketch(df.select(col(id_col).alias("i"), col(text_col).alias("t")), F.col("t"), "sketch")
    return out.select(F.col("i").alias(id_col), "sketch", as_text(F.col("sketch")).alias("fingerprint"))


def with_next(df: DataFrame, key: str, tie: str, values: list[str]) -> DataFrame:
    """df (no nulls in its long columns ``key`` and ``tie``) with ``next_<v>`` of the row that is next by key and tie; after the last comes the first.

    No task sees all rows: keys are cut into blocks at approximate quantiles. A key that is several
    quantiles has as many blocks, by its ties, which should be hashes. The first rows of a block
    also go to the block before, as guests, and those of the first block to the last one.
    """
    n = df.count()
    parts = max(1, min(BLOCKS, n // BLOCK_ROWS))
    share = ", ".join(str(k / parts) for k in range(parts))
    found = df.selectExpr(f"percentile_approx(`{key}`, array({share}), {min(10 * parts + 100, 1 << 20)}) AS c", f"min(`{key}`) AS least").first()
    times = Counter(found["c"] or [])
    cuts = sorted({found["least"], *times}) if n else [0]
    own = [max(1, times[c]) for c in cuts]  # blocks of each cut
    before = [0, *accumulate(own)]
    step = max(1, int(len(cuts) ** 0.5))
    constant = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")
    k = F.col(key)
    coarse = F.size(F.filter(constant(cuts[::step]), lambda c: c <= k)) - 1
    out = df.withColumn("__cut", coarse * step + F.size(F.filter(F.slice(constant(cuts), coarse * step + 1, F.lit(step)), lambda c: c <= k)) - 1)
    at_cut = F.array_contains(F.slice(constant(cuts), F.col("__cut") + 1, F.lit(1)), k)
    if max(own) == 1:
        out = out.withColumn("__block", F.col("__cut")).withColumn("__first", at_cut)
        previous = F.when(F.col("__block") == 0, F.lit(len(cuts) - 1)).otherwise(F.col("__block") - 1)
    else:
        many, offset = F.get(constant(own), F.col("__cut")), F.get(constant(before), F.col("__cut"))
        by_tie = F.least(F.floor((F.col(tie) / 2.0**64 + 0.5) * many), many - 1)
        out = out.withColumn("__block", (offset + F.when(at_cut, by_tie).otherwise(many - 1)).cast("int"))
        firsts = sorted(out.groupBy("__block").agg(F.min(F.struct(k.alias("k"), F.col(tie).alias("t"))).alias("f")).collect())  # at most BLOCKS and a few
        rows = [(r["__block"], r["f"]["k"], r["f"]["t"], firsts[j - 1]["__block"]) for j, r in enumerate(firsts)]
        heads = df.sparkSession.createDataFrame(rows, "__b int, __k long, __t long, __previous int")
        out = out.join(F.broadcast(heads), F.col("__block") == F.col("__b")).withColumn("__first", (k == F.col("__k")) & (F.col(tie) == F.col("__t"))).drop("__b", "__k", "__t")
        previous = F.col("__previous")
    own_row = F.struct(F.lit(0).alias("guest"), F.col("__block").alias("at"))
    guest = F.struct(F.lit(1).alias("guest"), previous.cast("int").alias("at"))
    out = out.withColumn("__to", F.explode(F.when(F.col("__first"), F.array(own_row, guest)).otherwise(F.array(own_row))))
    out = out.select(*df.columns, F.col("__to.guest").alias("__guest"), F.col("__to.at").alias("__at"))
    ordered = Window.partitionBy("__at").orderBy("__guest", key, tie, *values)
    out = out.select("*", *(F.lead(v).over(ordered).alias(f"next_{v}") for v in values))
    return out.where("__guest = 0").drop("__guest", "__at")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, with their likeness.

    The edit replaces the last half of the code points by as many of the start
    of the next text in ascending id. Null ids count as the least id; rows with
    equal ids are ordered by their texts' hashes, then by text.
    """
    base = df.select(F.col(f"`{id_col}`").alias("i"), F.coalesce(col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.coalesce(col(text_col), F.lit("")).alias("t"))
    base = with_next(with_sketch(base, F.col("t"), "s").withColumn("tie", F.xxhash64("t")), "k", "tie", ["t", "s"])
    half = (F.length("t") / 2).cast("long").cast("int")
    base = base.withColumn("e", F.concat(F.substring("t", F.lit(1), F.length("t") - half), F.substring("next_t", F.lit(1), half)))
    base = with_sketch(base.select("i", F.length("t").cast("long").alias("n_chars"), "s", "next_s", "e"), F.col("e"), "es")
    return base.select(
        F.col("i").alias(id_col),
        "n_chars",
        F.sha2("e", 256).alias("edited_sha256"),
        as_text(F.col("s")).alias("fingerprint"),
        as_text(F.col("es")).alias("edited_fingerprint"),
        jaccard(F.col("s"), F.col("es")).alias("near_edited"),
        jaccard(F.col("s"), F.col("next_s")).alias("near_next"),
    )
