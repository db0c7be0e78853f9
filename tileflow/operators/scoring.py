"""Scoring with a model the user supplies, in Arrow batches."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMBEDDING = "struct<cls_token: array<{0}>, logits: array<{0}>>"

Predict = Callable[[np.ndarray], dict[str, np.ndarray]]


def linear_scorer(model_path: str, model_name: str) -> Predict:
    """A linear head: the input is the class token, ``input @ weights`` the logits.

    ``model_path``: a ``.npy`` file all executors can read, or the matrix itself as JSON text.
    """
    if model_path.lstrip().startswith("["):
        weights = np.asarray(json.loads(model_path), dtype=np.float64)
    else:
        weights = np.load(model_path).astype(np.float64)

    def predict(batch: np.ndarray) -> dict[str, np.ndarray]:
        inputs = np.asarray(batch, dtype=np.float64)
        return {"cls_token": inputs, "logits": inputs @ weights}

    return predict


def colour_scorer(model_path: str, model_name: str) -> Predict:
    """Mean of each of the channels of raw pixels as class token and logits (three channels)."""

    def predict(batch: np.ndarray) -> dict[str, np.ndarray]:
        means = np.stack([np.frombuffer(b, np.uint8).reshape(-1, 3).mean(0) for b in batch])
        return {"cls_token": means, "logits": means}

    return predict


def _load(scorer: str) -> Callable[[str, str], Predict]:
    module, name = scorer.split(":")
    return getattr(importlib.import_module(module), name)


class BatchScorer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``struct<cls_token, logits>`` for a column of vectors or binaries.

    ``scorer`` names a factory as ``module:function``; the factory gets ``modelPath`` and ``modelName``,
    is called once per Python worker and returns ``f(batch) -> {"cls_token": ..., "logits": ...}``.
    ``outputType`` is the type of their numbers: ``double``, or ``float``, which takes half the bytes.
    """

    scorer = Param(Params._dummy(), "scorer", "factory as module:function", TypeConverters.toString)
    modelPath = Param(Params._dummy(), "modelPath", "where the model is", TypeConverters.toString)
    modelName = Param(Params._dummy(), "modelName", "which model it is", TypeConverters.toString)
    batchSize = Param(Params._dummy(), "batchSize", "rows per model call", TypeConverters.toInt)
    inputWidth = Param(Params._dummy(), "inputWidth", "length of input vectors, 0 for binaries", TypeConverters.toInt)
    outputType = Param(Params._dummy(), "outputType", "float or double", TypeConverters.toString)

    @keyword_only
    def __init__(
        self, *, inputCol=None, outputCol=None, scorer=None, modelPath=None, modelName=None, batchSize=None,
        inputWidth=None, outputType=None,
    ):
        super().__init__()
        self._setDefault(
            inputCol="input", outputCol="output", scorer="tileflow.operators.scoring:linear_scorer",
            modelPath="", modelName="", batchSize=32, inputWidth=0, outputType="double",
        )
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        column = self.getInputCol()
        factory = _load(self.getOrDefault(self.scorer))
        path, name = self.getOrDefault(self.modelPath), self.getOrDefault(self.modelName)
        width, kind = self.getOrDefault(self.inputWidth), self.getOrDefault(self.outputType)
        if kind not in ("float", "double"):
            raise ValueError(f"outputType is float or double, not {kind!r}")
        score = predict_batch_udf(
            lambda: factory(path, name),
            return_type=T._parse_datatype_string(EMBEDDING.format(kind)),
            batch_size=self.getOrDefault(self.batchSize),
            input_tensor_shapes=[[width]] if width else None,
        )
        return df.withColumn(self.getOutputCol(), score(F.col(column)))


def safe_scores(
    df: DataFrame, input_col: str, make_predict: Callable[[], Callable], result: str = "array<double>",
    out: str = "output",
) -> DataFrame:
    """Score row by row; a row that fails gets nulls and the text of its ``error``, the job goes on.

    ``make_predict()`` is called once per task, before its first batch.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(result)),
                           T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predict()

        def one(value):
            try:
                return predict(value), None
            except Exception as e:  # the point of this operator: keep the row, record why
                return None, f"{type(e).__name__}: {e}"

        for pdf in batches:
            results = [one(value) for value in pdf[input_col]]
            yield pdf.assign(**{out: [r[0] for r in results], "error": [r[1] for r in results]})

    return df.mapInPandas(run, schema)
