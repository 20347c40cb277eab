"""Functions in Python, by Arrow batches: for what Spark's own functions can't say."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType


@F.pandas_udf(StringType())
def size_code(brand: pd.Series, size: pd.Series) -> pd.Series:
    """Brand, size class and size."""
    letter = np.select([size < 10, size < 30], ["S", "M"], "L")
    return brand + "-" + letter + size.astype("Int64").astype("string")


@F.pandas_udf(DoubleType())
def revenue_by_flag(price: pd.Series, discount: pd.Series) -> float:
    return float((price * (1 - discount)).sum())


def share_of_group(items: pd.DataFrame) -> pd.DataFrame:
    """Each item's share of its order's quantity, for many whole orders."""
    share = items["l_quantity"] / items.groupby("l_orderkey")["l_quantity"].transform("sum")
    return items.assign(share=share.round(9))[["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "share"]]


@F.udtf(returnType=StructType().add("word", StringType()).add("place", IntegerType()))
class words_of:  # noqa: N801  a function to those who call it
    """A row for each word of a text, numbered from 1; none for a null."""

    def eval(self, text: str) -> Iterator[tuple[str, int]]:
        if text is not None:
            yield from ((w, i) for i, w in enumerate(text.split(" "), 1))
