"""python -m tremolith.plans.cli run|list|init|compare"""

from __future__ import annotations

import argparse
import json
import sys

from . import catalog, config, pipeline, report


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="tremolith")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("run", "compare"):
        p = sub.add_parser(name)
        p.add_argument("--config")
        p.add_argument("--input")
        p.add_argument("--category", action="append")
        p.add_argument("--ids", nargs="*", default=[])
        p.add_argument("--method")
        p.add_argument("--report")
        p.add_argument("--top", type=int)
    p = sub.add_parser("list")
    p.add_argument("--category")
    p.add_argument("--search")
    sub.add_parser("init").add_argument("path")
    given = top.parse_args(args)
    if given.command == "init":
        import yaml

        with open(given.path, "w") as f:
            yaml.safe_dump(config.DEFAULTS, f)
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tremolith").getOrCreate()
    if given.command == "list":
        found = catalog.filtered(catalog.catalog(spark), given.category)
        found = catalog.search(found, given.search) if given.search else found
        for r in catalog.tree(found).select("category", "algorithm_id", "complexity").collect():
            print(*r, sep="\t")
        return 0
    over: dict = {"input": {"path": given.input}, "output": {"top_n": given.top or 3}}
    if given.ids:
        over["operators"] = {"mode": "selected", "ids": given.ids}
    elif given.category:
        over["operators"] = {"mode": "category", "categories": given.category}
    if given.method:
        over["scoring"] = {"method": given.method}
    found = pipeline.run(spark, config.load(given.config, over))
    if given.command == "compare":
        for r in pipeline.compare(found.rankings, *given.ids).orderBy("signal_id", "channel", "overall_rank").toJSON().collect():
            print(json.loads(r))
        return 0
    text = report.markdown(found.rankings)
    if given.report:
        report.write_markdown(found.rankings, given.report)
    print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
