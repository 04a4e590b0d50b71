"""Command line: ``python -m tesseral FOLDER ADDRESS...`` prints the lines that answer an address."""

from __future__ import annotations

import sys

from tesseral.plans.ask import ask
from tesseral.plans.reports import QueryError
from tesseral.session import local_session


def main(argv: list[str]) -> int:
    if len(argv) < 2:
        print(__doc__, file=sys.stderr)
        return 2
    spark = local_session()
    try:
        for r in ask(spark, argv[0], " ".join(argv[1:])).orderBy("place").toLocalIterator():
            print(r["line"])
    except QueryError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
