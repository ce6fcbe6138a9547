"""Top-k and samples. Samples order rows by a hash, so they are repeatable and need no seed in the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def hash_order(*columns: Column) -> Column:
    """A repeatable shuffle: MD5 of the columns as text."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))


def capped_sample(df: DataFrame, keys: list[str], ident: list[str], k: int) -> DataFrame:
    """At most k rows per key, by hash."""
    return top_k(df, keys, [hash_order(*[F.col(c) for c in ident]), *ident], k).drop("rank")


def round_robin(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first k rows when the keys take turns."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("turn", turn).orderBy("turn", key).limit(k)


def train_test(df: DataFrame, key: str, order: list, share: float) -> DataFrame:
    """The leading share of each key's rows is for training."""
    w = Window.partitionBy(key)
    place = F.row_number().over(w.orderBy(*order))
    return df.withColumn("is_train", place <= F.ceil(F.count("*").over(w) * share))
