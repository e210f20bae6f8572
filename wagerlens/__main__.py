"""Jobs over a store.

    python -m wagerlens load RAW_DIR STORE_DIR [--tolerant]
    python -m wagerlens ingest TABLE LANDING_DIR STORE_DIR [--tolerant]
    python -m wagerlens report STORE_DIR OUT_DIR [name ...]

With spark-submit, pass this file and the package as ``--py-files``. Session settings
(master, memory, shuffle partitions) come from the submit command or spark-defaults.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from wagerlens.plans.export import export_reports
from wagerlens.model import SCHEMAS
from wagerlens.sources.store import bad_rows, load, prepare
from wagerlens.streaming.ingest import ingest_new_files


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="wagerlens")
    jobs = parser.add_subparsers(dest="job", required=True)
    loading = jobs.add_parser("load", help="clean raw text files into a Parquet store")
    loading.add_argument("raw_dir")
    loading.add_argument("store_dir")
    ingesting = jobs.add_parser("ingest", help="clean files not seen before into a stored table")
    ingesting.add_argument("table", choices=list(SCHEMAS))
    ingesting.add_argument("landing_dir")
    ingesting.add_argument("store_dir")
    for job in (loading, ingesting):
        job.add_argument("--tolerant", action="store_true", help="set aside rows that do not parse and report their number")
    reporting = jobs.add_parser("report", help="run reports over a store and write them as files")
    reporting.add_argument("store_dir")
    reporting.add_argument("out_dir")
    reporting.add_argument("names", nargs="*")
    reporting.add_argument("--format", default="csv", choices=["csv", "parquet", "json", "orc"])
    chosen = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("wagerlens").getOrCreate()
    if chosen.job == "load":
        prepare(spark, chosen.raw_dir, chosen.store_dir, chosen.tolerant)
    elif chosen.job == "ingest":
        ingest_new_files(spark, chosen.table, chosen.landing_dir, chosen.store_dir, chosen.tolerant).awaitTermination()
    else:
        export_reports(load(spark, chosen.store_dir), chosen.out_dir, chosen.names, chosen.format)
    if chosen.job != "report" and chosen.tolerant:
        for table in [chosen.table] if chosen.job == "ingest" else SCHEMAS:
            print(f"{table}: {bad_rows(spark, chosen.store_dir, table).count()} rows set aside in the store")


if __name__ == "__main__":
    main()
