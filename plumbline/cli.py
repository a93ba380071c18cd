"""Command line: ``python -m plumbline.cli -a app.conf -j job.conf [-d 2024-01-31] [-e NAME=VALUE] [--stream]``."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime

from pyspark.sql import SparkSession

from .plans import hocon
from .plans.job import TOLERANCE, Engine


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Run a data-quality job.")
    p.add_argument("-a", "--application", help="application settings (HOCON)")
    p.add_argument("-j", "--jobs", action="append", required=True, help="job description (HOCON); several are joined")
    p.add_argument("-d", "--date", help="reference date, ISO format")
    p.add_argument("-e", "--extra", action="append", default=[], help="NAME=VALUE for substitutions")
    p.add_argument("-l", "--local", action="store_true", help="run on a local master")
    p.add_argument("-t", "--tolerance", choices=TOLERANCE, default="none", help="which failed checks make the exit code 1")
    p.add_argument("--stream", action="store_true", help="the job has streams")
    a = p.parse_args(args)
    variables = dict(x.split("=", 1) for x in a.extra)
    app = hocon.load(a.application, variables=variables) if a.application else {}
    app = app.get("appConfig", app)
    settings = {**app, **app.get("enablers", {})}
    builder = SparkSession.builder.appName(app.get("applicationName", "plumbline"))
    for x in app.get("defaultSparkOptions", []):
        builder = builder.config(*x.split("=", 1))
    if a.local:
        builder = builder.master("local[*]")
    engine = Engine(builder.getOrCreate(), settings)
    if a.stream:
        from .streaming.windows import StreamJob, StreamSettings

        s = app.get("streaming", {})
        job = StreamJob.build(engine, hocon.load(*a.jobs, variables=variables), StreamSettings(
            s.get("trigger", "10 seconds"), s.get("window", "10 minutes"), s.get("watermark", "5 minutes"), s.get("allowEmptyWindows", True), s.get("checkpointDir")))
        job.start().awaitTermination()
        return 0
    rs = engine.run_files(*a.jobs, variables=variables, reference=datetime.fromisoformat(a.date) if a.date else None)
    for fault in rs.faults:
        print(fault, file=sys.stderr)
    return rs.exit_code(a.tolerance)


if __name__ == "__main__":
    sys.exit(main())
