"""Stratified train/test splits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprep.functions.names import unused
from tabprep.rules import SPLIT_FRACTIONS, SPLIT_SEED


def stratified_split(df: DataFrame, label: str, classes: Iterable[str] | None = None, fractions=SPLIT_FRACTIONS,
                     seed: int = SPLIT_SEED, trim: bool = False) -> tuple[DataFrame, DataFrame]:
    """A seeded uniform draw for every row of the classes (default: all labelled rows).

    Every class keeps its share in expectation, without a shuffle, a sort or a
    scan for each class. The draw depends on how the input is laid out, so use the
    hashed split when the result must not.
    """
    keep = F.col(label).isNotNull()
    if classes is not None:
        value = F.lower(F.trim(F.col(label)) if trim else F.col(label))
        keep = value.isin(*[c.lower() for c in classes])
    drawn = df.withColumn("__draw", F.rand(seed)).filter(keep)
    share = F.lit(fractions[0] / sum(fractions))
    return drawn.filter(F.col("__draw") < share).drop("__draw"), drawn.filter(F.col("__draw") >= share).drop("__draw")


#: Buckets of the hashed split: fractions are honoured to one millionth.
SPLIT_BUCKETS = 1_000_000


def hash_bucket(id_col: str, seed: int = SPLIT_SEED) -> Column:
    """0 .. SPLIT_BUCKETS - 1 from the first 32 bits of md5("<id>:<seed>"), whatever the layout; a NULL id
    counts as the empty text."""
    h = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % SPLIT_BUCKETS


def in_train(id_col: str, fraction: float = SPLIT_FRACTIONS[0], seed: int = SPLIT_SEED) -> Column:
    return hash_bucket(id_col, seed) < F.lit(int(round(fraction * SPLIT_BUCKETS)))


def stratified_split_hashed(df: DataFrame, id_col: str, fraction: float = SPLIT_FRACTIONS[0],
                            seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """Reproducible split: a keyed hash of the row id against the fraction.

    Each row's side depends only on its id and the seed, so every class keeps
    its share in expectation and the result is the same on any layout.
    """
    t = in_train(id_col, fraction, seed)
    return df.filter(t), df.filter(~t)


def split_report(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Class distribution before the split (half ``all``) and of each half: one aggregate over grouping sets. The shares come
    from its rows, which are as many as there are classes, three times."""
    half, whole = unused([label], "half"), unused([label], "__whole")
    both = train.select(F.col(label), F.lit("train").alias(half)).unionByName(test.select(F.col(label), F.lit("test").alias(half)))
    counts = both.groupingSets([[half, label], [label]], half, label).agg(F.grouping(half).alias(whole), F.count(F.lit(1)).alias("count"))
    named = counts.withColumn(half, F.when(F.col(whole) == 1, "all").otherwise(F.col(half)))
    total = F.sum("count").over(Window.partitionBy(half))
    return named.withColumn("pct", F.round(F.col("count") * 100.0 / total, 2)).select(label, "count", "pct", half)
