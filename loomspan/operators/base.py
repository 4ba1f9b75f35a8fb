"""What a node type is, and the registry of them."""

from __future__ import annotations

import importlib
import importlib.util
import logging
import os
import pkgutil
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsons

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Value:
    """A port's column and what it holds: text, number, flag, json (VARIANT), messages or other. Of a number read from
    text, ``whole`` says whether it is an int; of JSON read from text, ``raw`` is that text."""

    col: Column
    kind: str = "text"
    whole: Column | None = None
    raw: Column | None = None

    def text(self) -> Column:
        """``str()`` of the value."""
        if self.kind == "json":
            return jsons.rendered(self.col, self.raw)
        if self.kind == "flag":
            return F.initcap(self.col.cast("string"))
        if self.kind == "number" and self.whole is not None:
            return F.when(self.whole, self.col.cast("bigint").cast("string")).otherwise(self.col.cast("string"))
        return self.col.cast("string")

    def json(self) -> Column:
        """JSON text of the value; text stands for itself, as JSON that is carried as text does."""
        if self.kind != "json":
            return self.col.cast("string") if self.kind in ("text", "number", "flag") else F.to_json(self.col)
        return F.to_json(self.col) if self.raw is None else F.coalesce(self.raw, F.to_json(self.col))

    def plain_text(self, what: str) -> tuple[Column, Column | None]:
        """The value where it has to be text (null and other falsy values are empty), and an error where it isn't."""
        if self.kind == "text":
            return F.coalesce(self.col, F.lit("")), None
        if self.kind == "json":
            is_text = F.schema_of_variant(self.col) == "STRING"
            text = F.when(is_text, F.try_variant_get(self.col, "$", "string"))
            empty = F.to_json(self.col).isin("null", "false", "0", "0.0", "{}", "[]")
            return F.coalesce(text, F.lit("")), F.when(self.col.isNotNull() & ~is_text & ~empty, F.lit(f"{what} needs text"))
        falsy = self.col.cast("string").isin("0", "0.0", "false")
        return F.lit(""), F.when(self.col.isNotNull() & ~falsy, F.lit(f"{what} needs text"))


@dataclass
class Built:
    """Output ports of a node; a column that says why it fails (null: it doesn't); the frame if the node changed it."""

    ports: dict[str, Value]
    error: Column | None = None
    frame: DataFrame | None = None


@dataclass
class Call:
    """One node of one graph, as its type sees it while the graph is compiled."""

    frame: DataFrame
    node_id: str
    inputs: dict[str, Value]
    params: dict[str, Any]
    env: dict[str, Any] = field(default_factory=dict)

    def get(self, port: str) -> Value:
        return self.inputs.get(port) or Value(F.lit(None).cast("string"))

    @property
    def spark(self) -> SparkSession:
        return self.frame.sparkSession


@dataclass(frozen=True)
class NodeType:
    """``inputs``: port -> whether it is required. ``outputs``: ports. ``params``: their defaults. ``streams``: whether its
    reply is told in chunks. ``defaults``: what a required port has where nothing is connected."""

    name: str
    category: str
    inputs: dict[str, bool]
    outputs: tuple[str, ...]
    build: Callable[[Call], Built]
    params: dict[str, Any] = field(default_factory=dict)
    streams: bool = False
    defaults: dict[str, str] = field(default_factory=dict)


class NodeClass:
    """A node type written as a class, for plugins: its attributes are those of ``NodeType``, its name is NODE_TYPE or else
    the class's name in lower case without "node"."""

    category = "Custom"
    inputs: dict[str, bool] = {}
    outputs: tuple[str, ...] = ()
    params: dict[str, Any] = {}
    streams = False
    defaults: dict[str, str] = {}

    @staticmethod
    def build(call: Call) -> Built:
        raise NotImplementedError

    @classmethod
    def as_type(cls) -> NodeType:
        name = getattr(cls, "NODE_TYPE", None) or cls.__name__.lower().replace("node", "")
        return NodeType(name, cls.category, cls.inputs, cls.outputs, cls.build, cls.params, cls.streams, cls.defaults)


def _types_in(module: Any) -> list[NodeType]:
    """The node types that a module defines, as values or as classes."""
    found = []
    for v in vars(module).values():
        if isinstance(v, NodeType):
            found.append(v)
        elif isinstance(v, type) and issubclass(v, NodeClass) and v is not NodeClass and v.__module__ == module.__name__:
            found.append(v.as_type())
    return found


class Registry(dict):
    """Node types by name. A later type of the same name replaces a built-in one, and of two plugins the first wins."""

    def __init__(self, types: Iterable[NodeType] = ()):
        super().__init__({t.name: t for t in types})
        self.plugins: set[str] = set()

    def register(self, node: NodeType) -> bool:
        if node.name in self.plugins:
            log.warning("node type %s is there already; this one is skipped", node.name)
            return False
        if node.name in self:
            log.warning("node type %s replaces a built-in one", node.name)
        self[node.name] = node
        self.plugins.add(node.name)
        return True

    def discover(self, package: str) -> list[str]:
        """Registers every node type found in the modules of a package and of packages inside it; modules that start with
        ``_`` are left out."""
        found = []
        root = importlib.import_module(package)
        for info in pkgutil.walk_packages(root.__path__, f"{package}."):
            if any(part.startswith("_") for part in info.name.split(".")):
                continue
            found += [t.name for t in _types_in(importlib.import_module(info.name)) if self.register(t)]
        return found

    def load_manifest(self, path: str) -> list[str]:
        """Registers the node types of a plugin folder's manifest: lines ``name``, ``version`` and ``entry_point`` (a
        Python file beside it), all required."""
        with open(path, encoding="utf-8") as lines:
            told = {k.strip(): v.strip().strip("\"'") for k, _, v in (x.partition(":") for x in lines) if v.strip()}
        if missing := [k for k in ("name", "version", "entry_point") if k not in told]:
            raise ValueError(f"plugin manifest lacks {', '.join(missing)}")
        spec = importlib.util.spec_from_file_location(f"plugin_{told['name'].replace('-', '_')}", os.path.join(os.path.dirname(path), told["entry_point"]))
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        return [t.name for t in _types_in(module) if self.register(t)]

    def specs(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name, t.category, sorted(t.inputs), sorted(p for p, r in t.inputs.items() if r), list(t.outputs), {k: str(v) for k, v in t.params.items()}) for t in self.values()]
        return spark.createDataFrame(rows, "node_type string, category string, inputs array<string>, required array<string>, outputs array<string>, params map<string,string>")
