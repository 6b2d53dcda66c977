"""What the two text classifiers share: labelled samples and score columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, small_batches, tidied


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` labelled rows, drawn by hash, as a saved table.

    ``labels`` holds doc_id and ``label`` (0 or 1); null labels are left out, and of
    several labels of a doc_id the largest counts. The drawn ids are few by
    ``rows`` and so are broadcast.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["label"]) for r in drawn], "doc_id long, label int")
    return save(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label"), "labelled")


def score_column(make: Callable[[], Callable[[str], float]], text: str = "text") -> Column:
    """A column of scores; ``make`` is called once in each task and gives the function of one text (null: empty)."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = make()
        for batch in tidied(batches):
            yield pd.Series([of(x or "") for x in batch], dtype="float64")

    return scored(F.col(text).cast("string"))
