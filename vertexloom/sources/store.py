"""Sources and sinks: graphs as Parquet folders, and settings from a YAML file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import Graph
from ..plans.catalog import Catalog
from ..plans.snapshot import Snapshot


def save(snapshot: Snapshot, path: str) -> None:
    """The catalog as JSON text and a Parquet table for each group, in a new folder."""
    spark = snapshot.spark
    ends = {k: [sorted(a), sorted(b)] for k, (a, b) in snapshot.ends.items()}
    head = spark.createDataFrame([(snapshot.catalog.to_json(), json.dumps(ends))], "catalog string, ends string")
    for kind, frames in (("vertices", snapshot.vertices), ("edges", snapshot.edges)):
        for name, df in frames.items():
            _storable(df).write.parquet(f"{path}/{kind}/{snapshot.catalog.need(name).id}")
    head.coalesce(1).write.parquet(f"{path}/catalog")  # last: a folder without it is not a graph


def _storable(df: DataFrame) -> DataFrame:
    """Keys of a group without edges have no type yet, which Parquet can't hold."""
    return df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "void"})


def load(spark: SparkSession, path: str) -> Snapshot:
    head = spark.read.parquet(f"{path}/catalog").first()
    catalog, ends = Catalog.from_json(head["catalog"]), json.loads(head["ends"])
    out = Snapshot(spark, catalog)
    for g in catalog.groups:
        if g.edge:
            a, b = ends.get(g.name, [[], []])
            out = out.with_edges(g.name, spark.read.parquet(f"{path}/edges/{g.id}"), frozenset(a), frozenset(b))
        else:
            out = out.with_vertices(g.name, spark.read.parquet(f"{path}/vertices/{g.id}"))
    return out


def options_from_text(text: str) -> dict:
    """Settings from flat or nested ``name: value`` YAML; ``memory`` in MB becomes bytes."""
    out: dict = {}
    stack: list[tuple[int, dict]] = [(-1, out)]
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "---":
            continue
        indent = len(line) - len(line.lstrip())
        name, colon, value = line.strip().partition(":")
        if not colon:
            raise ValueError(f"not a setting: {line}")
        while stack[-1][0] >= indent:
            stack.pop()
        value = value.strip().strip("'\"")
        if not value:
            stack[-1][1][name] = inner = {}
            stack.append((indent, inner))
            continue
        stack[-1][1][name] = {"true": True, "false": False, "null": None, "~": None}.get(value.lower(), int(value) if value.lstrip("-").isdigit() else value)
    _bytes(out)
    return out


def _bytes(options: dict) -> None:
    for k, v in options.items():
        if isinstance(v, dict):
            _bytes(v)
        elif k in ("memory", "memory_size", "total_memory") and isinstance(v, int):
            options[k] = v * 1024 * 1024


def open_graph(spark: SparkSession, options: dict) -> Graph:
    """A graph as settings describe it: ``storage`` is the folder of a saved graph, if there is one.

    ``spark`` holds settings of the session (``sql.shuffle.partitions: 200``), put in place
    first. Without ``storage``, or where that folder has no graph yet, the graph is empty.
    """
    for name, value in (options.get("spark") or {}).items():
        spark.conf.set(f"spark.{name}", str(value).lower() if isinstance(value, bool) else value)
    path = options.get("storage")
    if path:
        head = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/catalog")
        if head.getFileSystem(spark._jsc.hadoopConfiguration()).exists(head):
            return Graph(spark, load(spark, path))
    return Graph(spark)


def options_from_file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return options_from_text(f.read())
