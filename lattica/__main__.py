"""Command line: ``python -m lattica run SCRIPT TABLE`` | ``dump TABLE`` | ``new TABLE SCHEMA``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from lattica.plans.script import run_script


def main(args: list[str]) -> int:
    spark = SparkSession.builder.appName("lattica").getOrCreate()
    match args:
        case ["run", script, table]:
            report, own = run_script(spark.read.parquet(table), open(script).read())
            for df in own.results:
                df.show(truncate=40)
            print(report)
        case ["dump", table]:
            spark.read.parquet(table).show(truncate=40)
        case ["new", table, schema]:
            spark.createDataFrame([], schema).write.parquet(table)
        case _:
            print(__doc__)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
