"""Category dictionaries (J1) and encoding with an unseen fallback.

The dictionary is the sorted distinct values plus ``__UNSEEN__`` placed in
sort order (D16), numbered with the distributed ``ordered_index`` — no
single-partition window even for very large vocabularies.  Encoding is a left
join on the dictionary, whatever its size; Catalyst picks the strategy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast import constants as K
from revcast.operators.splits import ordered_index


def fit_dictionary(df: DataFrame, cols=K.CATEGORICAL_COLS) -> DataFrame:
    """(column_name, value, idx) for every categorical column present, in one indexing pass:
    rows are numbered over (column_name, value) and each column's numbering starts at 0."""
    present = [c for c in cols if c in df.columns]
    vals = None
    for c in present:
        v = df.select(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        vals = v if vals is None else vals.unionByName(v)
    unseen = df.sparkSession.createDataFrame([(c, K.UNSEEN) for c in present], "column_name string, value string")
    distinct = vals.where(F.col("value").isNotNull()).unionByName(unseen).distinct()
    from revcast.plans.daily import materialize
    ix = ordered_index(distinct, ["column_name", "value"], "_g")
    start = ix.groupBy("column_name").agg(F.min("_g").alias("_s"))
    d = (ix.join(F.broadcast(start), "column_name")              # one row per categorical column
           .select("column_name", "value", (F.col("_g") - F.col("_s")).alias("idx")))
    return materialize(d, "dictionary")                          # read by every encode subquery


def encode(df: DataFrame, dictionary: DataFrame, cols=K.CATEGORICAL_COLS) -> DataFrame:
    """Replace each categorical column by its index; unseen values -> index of __UNSEEN__."""
    present = [c for c in cols if c in df.columns]
    for c in present:
        d = dictionary.where(F.col("column_name") == c).select(F.col("value").alias(f"_v_{c}"),
                                                               F.col("idx").alias(f"_i_{c}"))
        unseen = d.where(F.col(f"_v_{c}") == K.UNSEEN).select(F.max(f"_i_{c}")).scalar()
        df = (df.join(d, df[c].cast("string") == d[f"_v_{c}"], "left")
                .withColumn(c, F.coalesce(F.col(f"_i_{c}"), unseen))
                .drop(f"_v_{c}", f"_i_{c}"))
    return df
