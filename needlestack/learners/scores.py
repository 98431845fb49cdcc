"""One way to read the positive-class score of any fitted model."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F


def score(model, df: DataFrame, out: str = "p") -> DataFrame:
    """Adds the positive-class probability, or the margin where a model has none.

    Preparation steps work in place, so the input columns travel beside them in a
    struct and come back untouched: any number of models can score one frame in turn.
    """
    made = model.transform(df.withColumn("__row", F.struct(*df.columns)))
    source = "probability" if "probability" in made.columns else "rawPrediction"
    p = vector_to_array(source)[1] if source in made.columns else F.col("prediction").cast("double")
    kept = [F.col("__row")[c].alias(c) for c in df.columns if c != out]
    return made.select(*kept, p.alias(out))
