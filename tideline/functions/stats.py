"""Two functions of aggregated rows that Spark has no expression for.

Both bodies are closures, so that they travel to the executors by value.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def two_sided_p(z: Column | str) -> Column:
    """P(|N(0,1)| >= |z|) = erfc(|z| / sqrt 2); NULL for NULL.

    ``erfc`` keeps its precision in the tail, where one minus the distribution
    function cancels.
    """

    @F.pandas_udf("double")
    def tail(scores: pd.Series) -> pd.Series:
        import math

        return scores.map(
            lambda s: None if s is None or s != s else math.erfc(abs(s) / math.sqrt(2.0))
        ).astype("float64")

    return tail(z)


def formatted(pattern: Column, **values: Column) -> Column:
    """Fill a pattern such as ``%(z).2f`` with named numbers; NULL for NULL.

    Rounds the exact binary number, ties to even, where ``format_string`` rounds
    its shortest decimal form upwards: 8.125 becomes 8.12.
    """

    @F.pandas_udf("string")
    def fill(patterns: pd.Series, rows: pd.DataFrame) -> pd.Series:
        filled = [
            None if text is None else text % row
            for text, row in zip(patterns, rows.to_dict("records"))
        ]
        return pd.Series(filled, dtype=object)

    return fill(pattern, F.struct(*[value.alias(name) for name, value in values.items()]))
