"""An append-only log of trials that a search can resume from."""

from __future__ import annotations

import json
from collections.abc import Mapping
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, functions as F

DONE, FAILED = "done", "failed"
LOG_SCHEMA = ("params string, loss double, numbers map<string,double>, texts map<string,string>, "
              "status string, error string, logged_at timestamp, trial string")


def trial_key(params: Mapping) -> str:
    """The same for the same parameters, in any order."""
    return sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:32]


class TrialLog:
    """Finished trials as Parquet under `path`, a folder each, so that trials in flight never write to one place.

    A trial is there once its write is committed; what a killed search left half written is not seen. Attachments
    keep their kind: numbers stay numbers. A failed trial is a row with its error, and is run again on a restart
    only with `retry_failed`. The driver holds one small row a trial.
    """

    def __init__(self, spark: SparkSession, path: str, retry_failed: bool = False):
        self.spark, self.path, self.retry_failed = spark, path.rstrip("/"), retry_failed
        self._known = {r["trial"]: r for r in self.table().orderBy("logged_at").collect()}

    def table(self) -> DataFrame:
        """All logged trials: params as JSON, loss, typed attachments, status and error."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.path)

    def find(self, params: Mapping) -> dict | None:
        """The logged trial of these parameters, if it needn't run again."""
        row = self._known.get(trial_key(params))
        if row is None or row["status"] == FAILED and self.retry_failed:
            return None
        return {"loss": row["loss"], "attachments": {**row["texts"], **{k: _whole(v) for k, v in row["numbers"].items()}},
                "status": row["status"], "error": row["error"]}

    def add(self, trial: Mapping) -> None:
        attached = trial["attachments"]
        numbers = {k: float(v) for k, v in attached.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
        texts = {k: str(v) for k, v in attached.items() if k not in numbers}
        row = (json.dumps(trial["params"], sort_keys=True, default=str), trial["loss"], numbers, texts, trial["status"],
               trial["error"])
        frame = self.spark.createDataFrame([row], LOG_SCHEMA.split(", logged_at")[0])
        frame.withColumn("logged_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(
            f"{self.path}/trial={trial_key(trial['params'])}")


def _whole(v: float) -> float | int:
    return int(v) if float(v).is_integer() else v
