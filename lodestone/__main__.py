"""Command line: index a folder, ask, export the graph.

python -m lodestone demo STORE FOLDER [QUERY] | export STORE FILE
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from . import api
from .operators import embeddings, graph
from .plans import ingest
from .sources.store import Store


def main(args: list[str]) -> int:
    if len(args) < 3 or args[0] not in ("demo", "export"):
        print(__doc__)
        return 2
    api.configure_logging()
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    store = Store(spark, args[1])
    if args[0] == "export":
        with open(args[2], "w", encoding="utf-8") as f:
            f.write(graph.export_text(store.nodes(), store.edges()))
        return 0
    store.migrate()
    provider = embeddings.create_provider("hashing")
    print(ingest.index_repository(store, "demo", args[2], model=api.create_model(), provider=provider))
    print(
        api.Engine(store, provider=provider).query_repositories(
            args[3] if len(args) > 3 else "what is this", attendant=api.NONE
        )
    )
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
