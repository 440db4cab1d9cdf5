"""python -m weftgraph CONFIG FACTS COMMAND [ARGUMENT]: answers from a folder of Parquet fact tables (edges, methods, accesses, fields).

Commands: status, check (the patterns of the configuration), find KEY, callers KEY, callees KEY, export KEY FOLDER.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from weftgraph.config import read_config
from weftgraph.session import Engine


def main(argv: list[str]) -> int:
    if len(argv) < 3:
        print(__doc__)
        return 2
    config, facts, command, *rest = read_config(argv[0]), *argv[1:]
    if command == "check":
        for name, pattern, problem in config.problems():
            print(f"{name}: {pattern}: {problem}")
        return 1 if config.problems() else 0
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    tables = [spark.read.parquet(f"{facts}/{name}") for name in ("edges", "methods", "accesses", "fields")]
    engine = Engine(spark, *tables)
    if command == "status":
        print(*(f"{k}={v}" for k, v in engine.status().items()))
    elif command == "find" and rest:
        got = engine.find(rest[0])
        print("not found" if got is None else f"{got[1]} {got[0]}")
        return got is None
    elif command in ("callers", "callees") and rest:
        for row in engine.tree(rest[0], min(config.max_depth, 5), up=command == "callers").orderBy("path").limit(20_000).toLocalIterator():
            print("  " * row.depth + row.node + (" (recursive)" if row.recursive else " ..." if row.truncated else ""))
    elif command == "export" and len(rest) > 1:
        engine.export(rest[0], rest[1])
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
