"""``python -m folioscope index|search|status``."""

from __future__ import annotations

import argparse
import datetime


def main() -> None:
    p = argparse.ArgumentParser(prog="folioscope")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("index")
    sub.add_parser("status")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--top", type=int, default=0)
    s.add_argument("--folder")
    args = p.parse_args()

    from pyspark.sql import SparkSession

    from folioscope.config import load
    from folioscope.engine import Engine

    spark = SparkSession.builder.appName("folioscope").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, load(args.config))
    if args.what == "index":
        print(", ".join(f"{k}: {n}" for k, n in sorted(engine.index().items())))
    elif args.what == "status":
        engine.status().show(100, truncate=False)
    else:
        now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%d %H:%M:%S")
        for x in engine.search([args.query], now, args.top, args.folder).collect():
            print(f"{x.place}. {x.label} ({x.score:.4f})\n{x.evidence[:500]}\n")


if __name__ == "__main__":
    main()
