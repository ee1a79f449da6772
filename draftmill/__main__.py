"""Jobs: python -m draftmill batch|stream|receipts|list ...

batch SF_DIR OUT        routes all submissions of the tables and stores them
stream INBOX OUT AT     polls a folder of submissions; AT holds the stream's progress
receipts SF_DIR OUT     makes the receipts of all processed submissions
list SF_DIR             active entities by type
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from draftmill.operators import routing
from draftmill.plans import fixtures, queries
from draftmill.plans.settings import Settings
from draftmill.streaming import intake


def main(args: list[str]) -> int:
    spark = SparkSession.builder.appName("draftmill").getOrCreate()
    if args[:1] == ["batch"] and len(args) == 3:
        routing.judge(fixtures.checks_raw(spark, args[1]), fixtures.AS_OF).write.partitionBy("route").parquet(args[2])
    elif args[:1] == ["stream"] and len(args) == 4:
        schema = spark.read.parquet(args[1]).schema
        intake.poll(intake.landing(spark, args[1], schema), intake.intake(args[2], fixtures.AS_OF), args[3], Settings()).awaitTermination()
    elif args[:1] == ["receipts"] and len(args) == 3:
        queries.queries()["c15_c17_receipt"](spark, args[1]).write.parquet(args[2])
    elif args[:1] == ["list"] and len(args) == 2:
        queries.queries()["f14_a07_active_entities"](spark, args[1]).show(1000, truncate=False)
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
