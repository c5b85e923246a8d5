"""python -m proseline FILE [--language sr|en] [--json]: the report of one file. Exit status 1 after a hard failure, 2 for wrong use or a file that can't be read, else 0."""

from __future__ import annotations

import argparse
import json
import os
import sys


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="proseline")
    parser.add_argument("file")
    parser.add_argument("--language", choices=("sr", "en"))
    parser.add_argument("--json", action="store_true")
    given = parser.parse_args(arguments)
    if not os.path.isfile(given.file):
        print(f"proseline: cannot read {given.file}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    import proseline
    from proseline.sources.documents import read_text

    spark = SparkSession.builder.getOrCreate()
    docs = read_text(spark, os.path.abspath(given.file)).withColumn("name", F.lit(os.path.basename(given.file)))
    docs = docs.withColumn("language", F.lit(given.language)).withColumn("basis", F.lit(None).cast("string")) if given.language else proseline.detect(docs)
    done = proseline.checked(docs, language="language")
    out = proseline.json_reports(done, "name") if given.json else proseline.markdown(done, "name", basis=None if given.language else "basis")
    text = out.first()[1]
    print(json.dumps(json.loads(text), ensure_ascii=False, indent=2) if given.json else text)
    return proseline.reports(done, "name").first().status


if __name__ == "__main__":
    sys.exit(main())
