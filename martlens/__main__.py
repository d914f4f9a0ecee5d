"""Command line: python -m martlens STAGE FOLDER."""

from __future__ import annotations

import argparse
import json
import sys

from martlens.session import session

STAGES = {"generate": ["generate"], "etl": ["etl"], "analytics": ["customer_analytics"], "clv": ["clv"], "anomaly": ["anomaly"],
          "churn": ["churn"], "forecast": ["forecast"]}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="martlens", description="Retail analytics on Spark")
    p.add_argument("stage", choices=[*STAGES, "all"])
    p.add_argument("folder", help="where raw tables and outputs are; any path that Spark can write")
    p.add_argument("--skip-generate", action="store_true", help="with all: use the raw tables that are there")
    p.add_argument("--customers", type=int, default=None, help="with generate: the size of the synthetic world")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--master", default=None)
    return p


def main(argv: list[str] | None = None) -> int:
    from martlens.plans.pipeline import Pipeline
    from martlens.sources.synthetic import World

    a = parser().parse_args(argv)
    run = Pipeline(session(master=a.master), a.folder, World(customers=a.customers) if a.customers else World())
    names = STAGES.get(a.stage) or [s for s in Pipeline.STAGES if not (a.skip_generate and s == "generate")]
    summary = run.run(*names)
    if not a.quiet:
        print(json.dumps({"seconds": summary.seconds, "metrics": summary.metrics}, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
