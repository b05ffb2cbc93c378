"""Command line: searches, exports, audits and refreshes over a store.

    python -m tessera --root DIR search --query "q=python&status=open" [--sort date] [--page 2]
    python -m tessera --root DIR facets --query "status=open" --dimension city
    python -m tessera --root DIR export --out FOLDER
    python -m tessera --root DIR audit
    python -m tessera --root DIR worklist open|closed
    python -m tessera --root DIR refresh"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import export, reads
from tessera.plans import index
from tessera.plans import search as S
from tessera.sources.store import Store


WORKLISTS = {"open": reads.open_with_url, "closed": reads.closed_with_url}


def engine(store: Store) -> S.Search:
    """Search over a store's tables; kept tables are used where there are any."""

    def maybe(table: str) -> DataFrame | None:
        try:
            return store.read(table)
        except KeyError:
            return None

    return S.Search(store.read("jobs"), store.read("companies"), maybe("job_state"), maybe("job_scores"), maybe("best_scores"), maybe("search_index"))


def refresh(store: Store) -> dict[str, int]:
    """Make the kept tables anew; the version of each."""
    made = {"search_index": store.write("search_index", index.build(store.read("jobs")))}
    try:
        made["best_scores"] = store.write("best_scores", S.best_scores(store.read("job_scores")))
    except KeyError:
        pass
    return made


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--root", required=True, help="where the store is")
    do = parser.add_subparsers(dest="command", required=True)
    p = do.add_parser("search")
    p.add_argument("--query", default="", help="filters as a URL query")
    p.add_argument("--sort", default="score")
    p.add_argument("--page", type=int, default=1)
    p.add_argument("--size", type=int, default=50)
    p = do.add_parser("facets")
    p.add_argument("--query", default="")
    p.add_argument("--dimension", required=True, choices=[d[0] for d in S.DIMENSIONS])
    p = do.add_parser("export")
    p.add_argument("--query", default="")
    p.add_argument("--out", required=True)
    do.add_parser("audit")
    p = do.add_parser("worklist")
    p.add_argument("which", choices=["open", "closed"])
    do.add_parser("refresh")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    store = Store(spark, given.root)
    if given.command == "refresh":
        print(refresh(store))
        return 0
    if given.command == "worklist":
        WORKLISTS[given.which](store.read("jobs")).show(100, truncate=False)
        return 0
    if given.command == "audit":
        export.suspicions(store.read("jobs")).show(100, truncate=False)
        return 0
    own, filters = engine(store), S.Filters.decode(given.query)
    if given.command == "search":
        page, total = own.search(filters, given.sort, given.page, given.size)
        page.show(given.size, truncate=60)
        print(total.first()["total"], "in all")
    elif given.command == "facets":
        own.facet(filters, given.dimension).show(S.MOST_PER_DIMENSION, truncate=False)
    else:
        rows, report = export.export(own.rows(filters))
        rows.write.mode("overwrite").json(given.out)
        print(report.first().asDict())
    return 0


if __name__ == "__main__":
    sys.exit(main())
