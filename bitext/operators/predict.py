"""Batch prediction and greedy decoding with a caller-supplied model (UDF3, UDF4).

The model is opaque Python (Keras, ONNX, ...), so this is the one place
rows cross into Python: ``mapInPandas`` hands Arrow batches of
``batch_size`` rows to the predictor, which runs once per executor
process per batch, never per row.

A model that is dear to build or to send comes as a factory: ``predict_with`` and
``decode_loop`` call it in the worker, once per worker process.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def predict_batches(
    df: DataFrame,
    key: list[str],
    input_col: str,
    predictor: Callable[[np.ndarray], np.ndarray],
    out: str = "pred_ids",
    batch_size: int = 1024,
) -> DataFrame:
    """Run ``predictor`` on fixed-length id arrays, batch by batch.

    ``predictor`` maps an int matrix [batch, length] to an int matrix
    [batch, length_out] (e.g. the argmax of a model's scores)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start : start + batch_size]
                if chunk.empty:
                    continue
                x = np.stack([np.asarray(v, dtype=np.int64) for v in chunk[input_col]])
                y = predictor(x)
                res = chunk[key].copy()
                res[out] = [row.astype(np.int32).tolist() for row in np.asarray(y)]
                yield res

    schema = ", ".join(f"`{k}` {t}" for k, t in df.select(*key).dtypes) + f", `{out}` array<int>"
    return df.select(*key, input_col).mapInPandas(run, schema)


def predict_with(
    df: DataFrame,
    key: list[str],
    input_col: str,
    make_predictor: Callable[[], Callable[[np.ndarray], np.ndarray]],
    length: int,
    out: str = "pred_ids",
    batch_size: int = 1024,
) -> DataFrame:
    """``predict_batches`` with a factory: Spark builds the model once per Python worker
    and calls it with int matrices [batch, length]."""
    predict = predict_batch_udf(
        make_predictor, return_type=T.ArrayType(T.IntegerType()), batch_size=batch_size, input_tensor_shapes=[[length]]
    )
    return df.select(*key, predict(input_col).alias(out))


_models: dict[str, Callable] = {}  # of the worker: the last one built


def _built(name: str, make: Callable[[], Callable]) -> Callable:
    if name not in _models:
        _models.clear()
        _models[name] = make()
    return _models[name]


def decode_loop(
    df: DataFrame,
    key: list[str],
    input_col: str,
    make_step: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]],
    start_id: int,
    end_id: int,
    max_len: int,
    out: str = "ids",
    batch_size: int = 1024,
) -> DataFrame:
    """UDF4: greedy decoding, batch by batch, with a model in the loop.

    ``make_step()`` is called once per worker and gives ``step(inputs, prefix) -> next
    ids``: ``inputs`` are the rows' id arrays (padded with 0 to the longest of the batch),
    ``prefix`` what was decoded so far, beginning with ``start_id``.  A step sees
    only rows that are not finished; a row ends at ``end_id`` or after ``max_len``
    tokens.  Output: ``key`` and the ids, without start and end.  A null input counts as
    empty; no rows give no rows."""
    name = uuid.uuid4().hex

    def decoded(inputs: np.ndarray) -> list[np.ndarray]:
        step = _built(name, make_step)
        n = len(inputs)
        ids = np.zeros((n, max_len + 1), np.int64)
        ids[:, 0] = start_id
        size, open_rows = np.zeros(n, np.int64), np.arange(n)
        for t in range(max_len):
            if not len(open_rows):
                break
            following = np.asarray(step(inputs[open_rows], ids[open_rows, : t + 1]))
            going = following != end_id
            open_rows = open_rows[going]
            ids[open_rows, t + 1] = following[going]
            size[open_rows] += 1
        return [ids[i, 1 : size[i] + 1] for i in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch_size):
                part = b.slice(at, batch_size)
                rows = [r or [] for r in part.column(len(key)).to_pylist()]
                inputs = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
                for i, r in enumerate(rows):
                    inputs[i, : len(r)] = r
                found = pa.array([x.tolist() for x in decoded(inputs)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(key)], found], names=[*key, out])

    schema = T.StructType([*df.select(*key).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return df.select(*key, input_col).mapInArrow(run, schema)


class BigramStep:
    """A step predictor that knows only the last token: the id that follows it in
    ``table``, ``default`` for others.  After the start it goes by the first input id."""

    def __init__(self, table: dict[int, int], default: int):
        self.lookup = LookupPredictor(table, default)

    def __call__(self, inputs: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        first = inputs[:, 0] if inputs.shape[1] else np.zeros(len(prefix), np.int64)
        return self.lookup(first if prefix.shape[1] == 1 else prefix[:, -1])


class LookupPredictor:
    """A word-lookup model: each input id is replaced by ``table[id]``
    (ids outside the table map to ``default``).  Deterministic, so SQL can
    mirror it; real models plug in the same way."""

    def __init__(self, table: dict[int, int], default: int = 1):
        size = max(table) + 1 if table else 1
        self.lut = np.full(size, default, dtype=np.int64)
        for k, v in table.items():
            self.lut[k] = v
        self.default = default

    def __call__(self, x: np.ndarray) -> np.ndarray:
        inside = (x >= 0) & (x < len(self.lut))
        return np.where(inside, self.lut[np.clip(x, 0, len(self.lut) - 1)], self.default)
