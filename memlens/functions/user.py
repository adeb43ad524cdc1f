"""Functions of the caller on columns, in Arrow batches."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def user_features(df: DataFrame, text: str, functions: dict[str, Callable[[str], str | None]]) -> DataFrame:
    """Columns ``custom`` (map of what the caller's functions find, lower case) and ``custom_errors`` (map of what they raised).

    Functions get whole texts in Arrow batches.  One that raises for a row leaves its name and the error's type and words in
    ``custom_errors`` of that row; other functions and rows go on.  A null text, and an empty or null answer, is no feature.
    """
    names = sorted(functions)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found, failed = [], []
            for value in texts:
                good: dict[str, str] = {}
                bad: dict[str, str] = {}
                for name in names if value is not None else ():
                    try:
                        answer = functions[name](value)
                    except Exception as error:  # the caller's code: report it beside the row
                        bad[name] = f"{type(error).__name__}: {error}"
                    else:
                        if answer:
                            good[name] = str(answer).lower()
                found.append(good)
                failed.append(bad)
            yield pd.DataFrame({"custom": found, "custom_errors": failed})

    apply = F.pandas_udf(run, "custom map<string,string>, custom_errors map<string,string>")
    return df.withColumn("_user", apply(F.col(text))).select("*", "_user.custom", "_user.custom_errors").drop("_user")
