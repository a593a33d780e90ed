"""Command line: list the query library, run a named query, or run SQL.

    python -m basketry list
    python -m basketry run revenue_by_category --sf /root/testdata/sf0.01
    python -m basketry sql "SELECT status, COUNT(*) AS n FROM orders GROUP BY status" --sf ...

Like the reference's page: the result's row count, then the rows; a failed
ad-hoc statement prints its error instead of raising.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="basketry")
    sub = parser.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="query library by category")
    run = sub.add_parser("run", help="run a named query")
    run.add_argument("key")
    sql = sub.add_parser("sql", help="run an ad-hoc read statement")
    sql.add_argument("text")
    for p in (run, sql):
        p.add_argument("--sf", default="/root/testdata/sf0.01", help="driver parquet folder")
        p.add_argument("--show", type=int, default=50, help="rows to print")
        p.add_argument("--cores", default="*")
    args = parser.parse_args(argv)

    from basketry.plans import registry  # noqa: F401
    from basketry.plans.catalog import ENTRIES, by_category, lookup

    if args.cmd == "list":
        for category, keys in by_category().items():
            print(category)
            for key in keys:
                e = lookup(key)
                print(f"  {key:30s} [{e.difficulty}] {e.title}  ({', '.join(e.tags)})")
        print(f"{len(ENTRIES)} queries")
        return 0

    from basketry.plans.adhoc import counted, prepare, run_sql
    from basketry.session import local_session
    from basketry.sources.fixture import load

    spark = local_session(args.cores)
    shop = load(spark, args.sf)
    if args.cmd == "run":
        df = lookup(args.key).build(shop)
    else:
        prepare(shop)
        df, err = run_sql(spark, args.text)
        if err:
            print(f"Query error: {err}")
            return 1
    try:
        df, n = counted(df)
    except PySparkException as e:
        if args.cmd == "run":
            raise
        print(f"Query error: {e}")
        return 1
    print(f"{n:,} rows returned")
    df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
