"""python -m convoweave run|validate|stats ..."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="convoweave", description="Turns exported conversations into a linked vault.")
    parser.add_argument("-v", "--verbose", action="store_true")
    parser.add_argument("--log-file")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("run", help="exports to a vault")
    p.add_argument("input")
    p.add_argument("-o", "--output", default="vault")
    p.add_argument("-c", "--config")
    p.add_argument("-t", "--taxonomy")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--resume", action="store_true")
    p = commands.add_parser("validate", help="checks export files")
    p.add_argument("input")
    p = commands.add_parser("stats", help="counts of a vault")
    p.add_argument("vault")
    p.add_argument("--json", action="store_true")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO if given.verbose else logging.WARNING, filename=given.log_file, format="%(asctime)s %(levelname)s %(message)s")

    from convoweave import runner
    from convoweave.sources import config

    spark = SparkSession.builder.appName("convoweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    uri = lambda path: path if "://" in path else __import__("pathlib").Path(path).absolute().as_uri()
    if given.command == "run":
        found = runner.run(spark, uri(given.input), uri(given.output), config.settings(given.config), config.taxonomy(spark, given.taxonomy) if given.taxonomy else None, given.resume, given.dry_run)
        print(json.dumps(found, default=str))
        return 0
    if given.command == "validate":
        bad = 0
        for r in runner.validate(spark, uri(given.input)).orderBy("file").toLocalIterator():
            bad += not r["valid"]
            print(f"{r['file']}: " + (f"valid, {r['conversations']} conversations" if r["valid"] else "; ".join(r["errors"])))
        return 1 if bad else 0
    found = runner.stats(spark, uri(given.vault))
    print(json.dumps(found, default=str) if given.json else "\n".join(f"{k}: {v}" for k, v in found.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
