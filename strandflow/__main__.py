"""python -m strandflow --table NAME=PATH:ENTITY:TIME:EVENT[:SEQ] ... [--now TIME] [--out PATH] SCRIPT

Registers Parquet folders as tables, runs a script (``-`` reads it from the standard input) and
prints its first 1000 rows, or writes all of them as Parquet.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from strandflow.errors import QueryError
from strandflow.session import Engine


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strandflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--table", action="append", default=[], metavar="NAME=PATH:ENTITY:TIME:EVENT[:SEQ]")
    parser.add_argument("--now", help="the end of LAST ranges")
    parser.add_argument("--out", help="a folder for all rows")
    parser.add_argument("script")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("strandflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        engine = Engine(spark, now=given.now)
        for spec in given.table:
            name, _, rest = spec.partition("=")
            scheme, mark, rest = rest.partition("://") if "://" in rest else ("", "", rest)
            path, *roles = rest.split(":")
            if not 3 <= len(roles) <= 4:
                parser.error(f"{spec}: name the entity, time and event columns, and one that orders events of equal time if there is one")
            path = scheme + mark + path
            engine.register(name, spark.read.parquet(path), *roles)
        script = sys.stdin.read() if given.script == "-" else given.script
        if given.out:
            engine.query(script).write.mode("errorifexists").parquet(given.out)
        else:
            print(engine.show(script))
    except QueryError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
