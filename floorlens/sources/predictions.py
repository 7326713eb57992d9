"""Prediction files: pickled lists of instances with a mask over a drawing's primitives, a label and a score.

Pickles can run code, so only plain containers, numbers and numpy arrays are let in; anything else is an error that
names it. Files are read through Spark, on any store.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INSTANCE = "drawing string, instance_id int, masks array<boolean>, label_id int, score double"

#: What pickled numpy arrays and scalars are made of, in old and new versions of numpy.
_LET_IN = {(m, n) for m in ("numpy.core.multiarray", "numpy._core.multiarray") for n in ("_reconstruct", "scalar")}
_LET_IN |= {("numpy.core.numeric", "_frombuffer"), ("numpy._core.numeric", "_frombuffer"), ("numpy", "ndarray"), ("numpy", "dtype"), ("_codecs", "encode"), ("numpy.dtypes", "*")}


class Plain(pickle.Unpickler):
    """An unpickler of arrays, numbers, texts and plain containers."""

    def find_class(self, module: str, name: str) -> Any:
        if (module, name) in _LET_IN or module == "numpy.dtypes" and name.endswith("DType"):
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not let in")

    def persistent_load(self, pid: Any) -> Any:
        raise pickle.UnpicklingError("references to outside are not let in")


def instances_of(content: bytes) -> list[tuple[int, list[bool], int | None, float | None]]:
    """(number, mask, label, score) of each instance of a file, in order."""
    out = []
    for i, instance in enumerate(Plain(io.BytesIO(content)).load()):
        mask = np.asarray(instance["masks"])
        if mask.dtype == object:
            raise pickle.UnpicklingError("a mask of other than numbers is not let in")
        label, score = instance.get("labels"), instance.get("scores")
        out.append((i, (mask.ravel() != 0).tolist(), None if label is None else int(label), None if score is None else float(score)))
    return out


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """drawing, instance_id, masks, label_id, score of all .pkl files under the path; a drawing is named by its file."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.pkl$", "")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pkl").load(path).select(name.alias("drawing"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, *instance) for d, content in zip(frame["drawing"], frame["content"], strict=True) for instance in instances_of(bytes(content))]
            yield pd.DataFrame(rows, columns=["drawing", "instance_id", "masks", "label_id", "score"]).astype({"label_id": "Int32", "score": "Float64"})

    return raw.mapInPandas(run, INSTANCE)


def prediction_files(instances: DataFrame) -> DataFrame:
    """drawing, value (a pickle) of instances (drawing, instance_id, masks, label_id, score), numbered in their order."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("instance_id")
        found = [{"masks": np.array(m, bool), "labels": int(label), "scores": None if pd.isna(s) else float(s)} for m, label, s in zip(group["masks"], group["label_id"], group["score"], strict=True)]
        return pd.DataFrame({"drawing": [group["drawing"].iloc[0]], "value": [pickle.dumps(found)]})

    return instances.groupBy("drawing").applyInPandas(run, "drawing string, value binary")
