"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y): the documents of at most ``most`` labelled ids, those first in hashed order, where usable holds.

    An id with several labels counts with the largest; null labels and null ids aren't used. As the sample has a fixed
    bound it goes to all tasks, and the documents aren't shuffled.
    """
    picked = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & usable).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64(id_col), id_col).limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(picked.select(F.col(id_col).alias("id"), "y")), "id")
