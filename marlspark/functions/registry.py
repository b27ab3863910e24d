"""Functions by name, with arguments described by a JSON Schema: the types that Spark needs come from the schema."""

from __future__ import annotations

import importlib.util
import json
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

#: The types of JSON Schema. Lists without item types and other objects stay JSON text.
TYPES: dict[str, DataType] = {"string": StringType(), "integer": LongType(), "number": DoubleType(), "boolean": BooleanType()}


def spark_type(schema: dict) -> DataType:
    kind = schema.get("type")
    if kind == "object" and isinstance(schema.get("properties"), dict):
        return struct_of(schema)
    if kind == "array" and isinstance(schema.get("items"), dict):
        return ArrayType(spark_type(schema["items"]))
    return TYPES.get(kind, StringType())


def struct_of(schema: dict) -> StructType:
    """The struct of an object's properties; those that aren't required may be null."""
    properties = schema.get("properties")
    required = schema.get("required")
    names = set(required) if isinstance(required, list) else set()
    known = properties if isinstance(properties, dict) else {}
    return StructType([StructField(k, spark_type(v if isinstance(v, dict) else {}), k not in names) for k, v in known.items()])


def tool_name(server: str, tool: str) -> str:
    """The name of a server's tool, from letters, digits, _ and -, each part beginning with a letter."""

    def clean(s: str) -> str:
        s = re.sub(r"[^A-Za-z0-9_-]", "_", s)
        return s if s[:1].isalpha() else f"mcp_{s}" if s else "tool"

    return f"mcp__{clean(server)}__{clean(tool)}"


class Functions:
    """Functions by name; of several with one name the last counts. `call` applies one to a column of JSON arguments."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known = spark, {}

    def register(self, name: str, f: Callable[..., object], arguments: dict, returns: str = "string") -> None:
        """f takes the schema's properties as keyword arguments; it's there in SQL too, for arguments as JSON."""
        names, required = [c.name for c in struct_of(arguments)], [c.name for c in struct_of(arguments) if not c.nullable]

        def run(text: str | None) -> object:
            try:
                given = json.loads(text or "")
            except ValueError:
                return None
            if not isinstance(given, dict) or any(given.get(k) is None for k in required):
                return None
            return f(**{k: given[k] for k in names if k in given})

        f_ = F.udf(run, returns, useArrow=True)
        self.known[name] = (f_, struct_of(arguments))
        self.spark.udf.register(name, f_)

    def call(self, name: str, arguments: Column) -> Column:
        """The result, null where the arguments aren't JSON or lack a required one."""
        return self.known[name][0](arguments)

    def arguments(self, name: str, text: Column) -> Column:
        """Arguments as a struct of the schema's types."""
        return F.from_json(text, StructType([StructField(c.name, c.dataType, True) for c in self.known[name][1]]))

    def names(self) -> DataFrame:
        return self.spark.createDataFrame([(k, v[1].simpleString()) for k, v in sorted(self.known.items())], "name string, arguments string")

    def load(self, folder: str) -> list[str]:
        """Registers what the Python files of a plugin folder list as TOOLS: (name, function, schema, type); a file that
        fails is left out. Returns the files that were taken."""
        taken = []
        for path in sorted(Path(folder).glob("*.py")):
            spec = importlib.util.spec_from_file_location(f"plugin_{path.stem}", path)
            module = importlib.util.module_from_spec(spec)
            try:
                spec.loader.exec_module(module)
                tools = list(module.TOOLS)
            except Exception:  # noqa: BLE001  a plugin may fail in any way
                continue
            for tool in tools:
                self.register(*tool)
            taken.append(path.name)
        return taken
