"""User functions: registration for SQL, and a few vectorised ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf


@pandas_udf(T.StringType())
def initials(names: pd.Series) -> pd.Series:
    """First letters of the words of a name."""
    return names.map(lambda x: None if x is None else "".join(w[0] for w in x.split()))


@pandas_udf(T.DoubleType())
def geomean(values: pd.Series) -> float:
    """Geometric mean of positive values."""
    return float(np.exp(np.log(values.astype(float)).mean()))


@udtf(returnType=T.StructType([T.StructField("word", T.StringType()), T.StructField("position", T.IntegerType())]))
class SplitWords:
    """Rows of (word, position) of a text."""

    def eval(self, text: str):
        for i, w in enumerate((text or "").split()):
            yield w, i


def register_functions(spark: SparkSession) -> None:
    spark.udf.register("tw_initials", initials)
    spark.udf.register("tw_geomean", geomean)
    spark.udtf.register("tw_words", SplitWords)


def register_query(registry: dict[str, Callable], name: str, fn: Callable) -> None:
    """Make ``fn(spark, values) -> DataFrame`` the builder of the template ``name``."""
    registry[name] = fn
