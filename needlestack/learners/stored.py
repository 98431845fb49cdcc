"""Models that hold other models or tables, written beside their parameters and read back, in pipelines too.

A folder holds `metadata` (the class and its plain settings), a folder for each part, and Parquet tables for what
isn't a plain setting. Reading a model opens its tables where they lie; nothing of the fit runs again.
"""

from __future__ import annotations

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter

SETTINGS = "settings"


class StoredModel(MLWritable, MLReadable):
    """Base of such models: `_settings` gives what JSON can hold, `_store` writes the rest, `_restore` makes the model."""

    def _settings(self) -> dict:
        return {}

    def _store(self, spark, path: str) -> None:
        raise NotImplementedError

    @classmethod
    def _restore(cls, spark, path: str, settings: dict):
        raise NotImplementedError

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: StoredModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {SETTINGS: self.model._settings()})
        self.model._store(self.sparkSession, path)


class _Reader(MLReader):
    def __init__(self, cls: type[StoredModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls._restore(self.sparkSession, path, metadata[SETTINGS])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def write_part(spark, model, path: str) -> None:
    """Writes a part of a model; a part that can't be written says which class it is."""
    if not isinstance(model, MLWritable):
        raise TypeError(f"{type(model).__name__} can't be written")
    model.write().session(spark).save(path)


def read_part(spark, path: str):
    """A part of whatever class it was written from."""
    return DefaultParamsReader.loadParamsInstance(path, spark)
