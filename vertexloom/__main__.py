"""``python -m vertexloom settings.yaml [statements]``: open a graph as settings say and work on it.

Statements come from the second argument, or else from standard input; the last one's result is
shown. With ``save: path`` in the settings the graph is saved there, in a new folder, at the end.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from .functions.symbols import execute
from .sources.store import open_graph, options_from_file, save


def main(args: list[str]) -> int:
    if not 1 <= len(args) <= 2:
        print(__doc__, file=sys.stderr)
        return 2
    options = options_from_file(args[0])
    graph = open_graph(SparkSession.builder.appName("vertexloom").getOrCreate(), options)
    out = execute(graph, args[1] if len(args) == 2 else sys.stdin.read())
    if isinstance(out, DataFrame):
        out.show(truncate=False)
    elif out is not None:
        print(out)
    if options.get("save"):
        save(graph.snapshot, options["save"])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
