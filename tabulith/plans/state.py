"""Fitted models as JSON text beside parquet tables and library models; loading runs no stored code.

Plain values are written as they are, all others as objects that name their kind.  Only
record classes of this library, subclasses of ``Fitted`` that are imported, and library
models through Spark's own reader can come back.
"""

from __future__ import annotations

import datetime
import json
from dataclasses import fields, is_dataclass
from decimal import Decimal
from typing import Any

import numpy as np
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession

from ..models.base import Fitted
from ..models.boosting import BoostTree
from ..models.library import KernelMap
from ..models.trees import Node

KIND = "~"
#: Records inside a fitted model; fitted models themselves are found by their class.
PARTS: list[type] = [Node, BoostTree, KernelMap]
_TEXT = {"date": datetime.date, "timestamp": datetime.datetime}


def record_classes() -> dict[str, type]:
    """Classes that may be read back, by name."""
    found, todo = {c.__name__: c for c in PARTS}, [Fitted]
    while todo:
        c = todo.pop()
        if found.setdefault(c.__name__, c) is not c:
            raise ValueError(f"Two fitted classes are called {c.__name__}.")
        todo += c.__subclasses__()
    return found


def _writable(value: Any) -> bool:
    return hasattr(value, "write") and hasattr(value, "uid")


class Writer:
    """Turns values into JSON; tables and library models go to numbered folders under ``base``."""

    def __init__(self, base: str, prefix: str):
        self.base, self.prefix, self.parts = base, prefix, 0

    def _folder(self) -> str:
        self.parts += 1
        return f"parts/{self.prefix}-{self.parts}"

    def encode(self, value: Any) -> Any:
        if value is None or isinstance(value, (bool, int, float, str)) and not isinstance(value, np.generic):
            return value
        if isinstance(value, np.generic):
            return self.encode(value.item())
        if isinstance(value, np.ndarray):
            return {KIND: "array", "dtype": value.dtype.str, "shape": list(value.shape), "items": [self.encode(v) for v in value.ravel().tolist()]}
        if isinstance(value, list):
            return [self.encode(v) for v in value]
        if isinstance(value, (tuple, set, frozenset)):
            name = "tuple" if isinstance(value, tuple) else type(value).__name__
            items = value if name == "tuple" else sorted(value, key=repr)
            return {KIND: name, "items": [self.encode(v) for v in items]}
        if isinstance(value, dict):
            return {KIND: "dict", "items": [[self.encode(k), self.encode(v)] for k, v in value.items()]}
        if isinstance(value, datetime.datetime):
            return {KIND: "timestamp", "text": value.isoformat()}
        if isinstance(value, datetime.date):
            return {KIND: "date", "text": value.isoformat()}
        if isinstance(value, Decimal):
            return {KIND: "decimal", "text": str(value)}
        if isinstance(value, DataFrame):
            where = self._folder()
            value.write.parquet(f"{self.base}/{where}")
            return {KIND: "table", "path": where}
        if _writable(value):
            where = self._folder()
            value.write().save(f"{self.base}/{where}")
            return {KIND: "model", "path": where}
        if is_dataclass(value) and type(value).__name__ in record_classes():
            return {KIND: "record", "class": type(value).__name__, "fields": {f.name: self.encode(getattr(value, f.name)) for f in fields(value)}}
        raise TypeError(f"A fitted model cannot keep a {type(value).__name__}.")

    def text(self, value: Any) -> str:
        return json.dumps(self.encode(value))


class Reader:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.classes = spark, base, record_classes()

    def decode(self, value: Any) -> Any:
        if isinstance(value, list):
            return [self.decode(v) for v in value]
        if not isinstance(value, dict):
            return value
        kind = value[KIND]
        if kind == "array":
            items = [self.decode(v) for v in value["items"]]
            out = np.empty(len(items), np.dtype(value["dtype"]))
            out[:] = items
            return out.reshape(value["shape"])
        if kind in ("tuple", "set", "frozenset"):
            return {"tuple": tuple, "set": set, "frozenset": frozenset}[kind](self.decode(v) for v in value["items"])
        if kind == "dict":
            return {self.decode(k): self.decode(v) for k, v in value["items"]}
        if kind in _TEXT:
            return _TEXT[kind].fromisoformat(value["text"])
        if kind == "decimal":
            return Decimal(value["text"])
        if kind == "table":
            return self.spark.read.parquet(f"{self.base}/{value['path']}")
        if kind == "model":
            return DefaultParamsReader.loadParamsInstance(f"{self.base}/{value['path']}", self.spark.sparkContext)
        if kind == "record":
            if value["class"] not in self.classes:
                raise ValueError(f"The run holds a {value['class']}; import its class before loading.")
            return self.classes[value["class"]](**{k: self.decode(v) for k, v in value["fields"].items()})
        raise ValueError(f"Unknown kind {kind!r}.")

    def value(self, text: str) -> Any:
        return self.decode(json.loads(text))
