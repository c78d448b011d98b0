"""Bounded samples of labelled rows, on which the classifiers are fitted. Their texts are read whole, whatever their length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More classes than this are taken for a wrong column.
MOST_CLASSES = 1000
_PARTS = 1 << 30


def class_share(rows: DataFrame, target: str, per_class: int, salt: str) -> tuple[DataFrame, dict]:
    """A sample of about per_class rows of each class of `target`, and the size of each class.

    A row is in by a hash of all its columns, so the choice is the same at every
    run and takes no sort; rows that are equal in all columns count once. Null
    classes are left out.
    """
    rows = rows.where(F.col(target).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(target).count().limit(MOST_CLASSES + 1).collect()}
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"{target} has more than {MOST_CLASSES} classes")
    share: Column = F.lit(0)
    for value, count in counts.items():
        share = F.when(F.col(target) == F.lit(value), F.lit(int(_PARTS * min(1.0, per_class / count)))).otherwise(share)
    place = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns], F.lit(salt)), F.lit(_PARTS))
    return rows.where(place < share).distinct(), counts


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, salt: str) -> tuple[DataFrame, dict]:
    """doc_id, text and label (0 or 1) of a sample of the labelled documents, and how many labels of each class there are.

    Of several labels of a document the least counts, and of several texts the
    first; labels above 0 are 1. The sample is drawn from the small label table;
    its size is bounded, so it is broadcast and only its own texts are shuffled.
    """
    one = labels.where(F.col(target).isNotNull()).groupBy("doc_id").agg(F.min((F.col(target) > 0).cast("int")).alias("label"))
    chosen, counts = class_share(one, "label", per_class, salt)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return found.select("doc_id", "text", "label"), counts
