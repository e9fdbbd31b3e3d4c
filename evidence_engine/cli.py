"""python -m evidence_engine.cli QUERY DIR [--json FILE] [--rows N]: run a query over the tables in a folder.

Exit code 0: it ran and has rows; 1: it failed; 2: wrong use; 3: it ran and found nothing.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import queries


def main(argv: list[str] | None = None) -> int:
    known = queries.queries()
    parser = argparse.ArgumentParser(prog="evidence_engine", description=__doc__)
    parser.add_argument("query", choices=sorted(known))
    parser.add_argument("folder")
    parser.add_argument("--json", help="write all rows there as JSON lines; else some are shown")
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    spark = SparkSession.builder.appName("evidence_engine").getOrCreate()
    try:
        df = known[args.query](spark, args.folder)
        if args.json:
            df.write.mode("overwrite").json(args.json)
            empty = spark.read.schema(df.schema).json(args.json).isEmpty()
        else:
            df.show(args.rows, truncate=80)
            empty = df.isEmpty()
    except Exception as e:
        print(f"{args.query}: {e}", file=sys.stderr)
        return 1
    return 3 if empty else 0


if __name__ == "__main__":
    sys.exit(main())
