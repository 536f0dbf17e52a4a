"""Command line: keyed tables and jobs.

    python -m brindle get TABLE ROW COLUMN | put TABLE ROW COLUMN VALUE | row TABLE ROW | scan TABLE [FROM [TO]]
    python -m brindle count TABLE | page TABLE [FROM] | rename TABLE NEW | delete TABLE | tables | jobs | run JOB [ARGUMENT...]
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from brindle.operators.keyed import KeyedTable, summary
from brindle.plans.jobs import job_names, run_job


def _lines(spark: SparkSession, verb: str, rest: Sequence[str]) -> list[str]:
    if verb == "tables":
        return [f"{name}\t{n}\t{'persistent' if kept else ''}" for name, n, kept in summary(spark)]
    if verb == "jobs":
        return job_names()
    if verb == "run":
        return [run_job(spark, rest[0], rest[1:])]
    t, own = KeyedTable(spark, rest[0]), list(rest[1:])
    row = lambda cells: " ".join(f"{k}={v}" for k, v in sorted((cells or {}).items()))
    verbs: dict[str, Callable[[], list[str]]] = {
        "get": lambda: [v for v in [t.get(*own)] if v is not None],
        "put": lambda: ["OK" if t.put(*own) else "FAIL"],
        "row": lambda: [row(t.get_row(*own))],
        "scan": lambda: [f"{r['row_key']} {row(r['cells'])}" for r in t.scan(*own).orderBy("row_key").toLocalIterator()],
        "count": lambda: [str(t.count())],
        "page": lambda: ["\t".join("" if v is None else v for v in r) for r in t.page(*own).collect()],
        "rename": lambda: [t.rename(*own) or "OK"],
        "delete": lambda: [t.delete() or "OK"],
    }
    return verbs[verb]()


def main(arguments: Sequence[str], spark: SparkSession | None = None) -> int:
    verbs = {"tables": 0, "jobs": 0, "run": 1, "get": 3, "put": 4, "row": 2, "scan": 1, "count": 1, "page": 1, "rename": 2, "delete": 1}
    if not arguments or len(arguments) - 1 < verbs.get(arguments[0], 1 << 30):
        print(__doc__, file=sys.stderr)
        return 2
    for line in _lines(spark or SparkSession.builder.getOrCreate(), arguments[0], arguments[1:]):
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
