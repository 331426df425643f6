"""Models as pluggable feature providers: loaded once in each Python worker, run over Arrow batches.

A provider that can't be loaded leaves its columns null; one marked as required raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Provider:
    """``load`` gives a function from a record batch to a dict of columns, in the types of ``schema``."""

    name: str
    schema: str
    load: Callable[[], Callable[[pa.RecordBatch], dict]]
    required: bool = False


def features(rows: DataFrame, provider: Provider, due: Column | None = None) -> DataFrame:
    """``rows`` with the provider's columns, null where ``due`` is not true.

    The model is loaded when a task meets its first due row. A task whose model can't be loaded gives nulls, unless the
    provider is required; what a loaded model raises fails the task.
    """
    added = rows.sparkSession.createDataFrame([], provider.schema).schema
    names = added.names
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    schema = StructType([*rows.schema.fields, *added.fields])
    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    mark = "_due"
    while mark in rows.columns:
        mark = "_" + mark
    marked = rows.withColumn(mark, F.coalesce(due, F.lit(False)) if due is not None else F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, loaded = None, False
        for b in batches:
            own, which = b.select(b.schema.names[:-1]), np.flatnonzero(np.asarray(b.column(b.num_columns - 1)))
            if len(which) and not loaded:
                loaded = True
                try:
                    model = provider.load()
                except Exception:
                    if provider.required:
                        raise
            got = model(own.take(pa.array(which))) if model and len(which) else {n: [None] * len(which) for n in names}
            place = np.full(b.num_rows, -1)
            place[which] = np.arange(len(which))
            at = pa.array(place, mask=place < 0)  # null for rows that aren't due
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(got[n], kind).take(at) for n, kind in zip(names, kinds))], [*own.schema.names, *names])

    return marked.mapInArrow(run, schema)


def _unit_norm():
    def run(batch: pa.RecordBatch) -> dict:
        v = batch.column(batch.schema.get_field_index("embedding"))
        sizes = np.asarray(v.value_lengths())
        flat = np.asarray(v.flatten(), np.float64)
        sums = np.add.reduceat(flat * flat, np.cumsum(sizes) - sizes) if len(flat) else np.zeros(len(sizes))
        return {"length": np.round(np.sqrt(sums), 3)}

    return run


def _library(module: str, function: str) -> Callable[[], Callable[[pa.RecordBatch], dict]]:
    """Loads ``function`` of a module that the user's cluster has: a function from a record batch to a dict of columns."""

    def load() -> Callable[[pa.RecordBatch], dict]:
        from importlib import import_module

        return getattr(import_module(module), function)

    return load


#: What each kind of model gives. The modules are the user's: without them the columns are null.
_BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
BOUNDARIES = {
    "faces": f"faces array<struct<box:{_BOX},pose:double,nose_x:double,left_eye_x:double,right_eye_x:double>>, face_embedding array<float>",
    "image_encoder": "image_embedding array<float>",
    "tagger": "scored_tags array<struct<tag:string,category:int,p:double>>",
    "ai_classifier": "predictions array<struct<label:string,score:double>>",
    "captioner": "caption string",
    "mask": "height int, width int, mask array<float>",
    "sound": "wave array<double>, sample_rate int",
}


def boundary(kind: str, module: str = "quarry_models", required: bool = False) -> Provider:
    """The provider of a kind of model: the function of that name in the user's ``module``."""
    return Provider(kind, BOUNDARIES[kind], _library(module, kind), required)


def two_phase(rows: DataFrame, pending: Column, provider: Provider) -> DataFrame:
    """``rows`` with the provider's columns, which only ``pending`` rows cost; the others have nulls. One pass over ``rows``."""
    return features(rows, provider, pending)


REGISTRY = {"unit_norm": Provider("unit_norm", "length double", _unit_norm)}


def register(provider: Provider) -> None:
    REGISTRY[provider.name] = provider
