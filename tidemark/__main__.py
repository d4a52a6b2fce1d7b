"""python -m tidemark --input BATCH.json --now SECONDS [--profile NAME] [--rules FILE]: prints each batch's record;
python -m tidemark --worker: works off the queue that the environment names."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidemark.functions.domains import common_rules, load_rules
from tidemark.operators import boundary
from tidemark.plans.evaluation import evaluate
from tidemark.profiles import PROFILES
from tidemark.sources import config
from tidemark.sources.json_io import batch_names, pretty, read_batches
from tidemark.streaming import jobs


def main() -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--input", help="a JSON batch file or a pattern")
    a.add_argument("--now", type=int, help="epoch seconds")
    a.add_argument("--profile", default="BASE", choices=sorted(PROFILES))
    a.add_argument("--rules", default="", help="a file of public-suffix rules")
    a.add_argument("--worker", action="store_true")
    args = a.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    settings = config.load()
    path = args.rules or settings.suffix_rules
    rules = load_rules(spark, path) if path else common_rules(spark)
    if args.worker:
        jobs.run(spark, settings.queue, rules, once=False, seconds=settings.poll_seconds).awaitTermination()
        return
    if not args.input or args.now is None:
        a.error("--input and --now are needed")
    judged = boundary.judge(read_batches(spark, args.input), rules, args.now)
    records = evaluate(boundary.accepted(judged), ["batch"], args.now, PROFILES[args.profile], batch_names(spark, args.input))
    for r in records.orderBy("batch").toLocalIterator():
        print(pretty(r))


if __name__ == "__main__":
    main()
