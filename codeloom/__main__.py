"""The command line: index a source tree, then answer a query if one is given.

    python -m codeloom --repo src --db /shared/index
    python -m codeloom --repo src --db /shared/index get_callers svc.helper
"""

from __future__ import annotations

import argparse
import os
import sys

VERSION = "0.1"


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("codeloom", description=__doc__.split("\n")[0])
    out.add_argument("--repo", default=".", help="source tree to index")
    out.add_argument("--db", default="./rag-data", help="folder of the index; shared by all executors on a cluster")
    out.add_argument("--full", action="store_true", help="index all files again, not only changed ones")
    out.add_argument("--pruning", default="soft", help="off, soft or hard")
    out.add_argument("--version", action="version", version=f"codeloom {VERSION}")
    out.add_argument("kind", nargs="?", help="query kind, such as search_code or get_callers")
    out.add_argument("text", nargs="?", default="", help="what to ask")
    return out


def located(path: str) -> str:
    """A folder as Spark reads it: names with a scheme stay, others are local."""
    return path if "://" in path else "file://" + os.path.abspath(path)


def main(argv: list[str] | None = None) -> int:
    asked = arguments().parse_args(argv)

    from pyspark.sql import SparkSession

    from codeloom.plans.engine import KINDS, Engine
    from codeloom.sources.store import Store

    if asked.kind and asked.kind not in KINDS:
        print(f"unknown query type {asked.kind!r}; known: {', '.join(sorted(KINDS))}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    engine = Engine(Store(spark, located(asked.db)), asked.pruning)
    counts = engine.sync(located(asked.repo), full=asked.full)
    print(" ".join(f"{k}={v}" for k, v in counts.items()), file=sys.stderr)
    if asked.kind:
        print(engine.text(asked.kind, asked.text))
    return 0


if __name__ == "__main__":
    sys.exit(main())
