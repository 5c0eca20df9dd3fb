"""Per-stage task balance of one catalogue query, from Spark's event log.

Usage: python tools/stage_report.py QUERY [--sf DIR]
Runs the query with the no-op sink and event logging into a fresh scratch
folder, then prints, per stage: tasks, max/median task time and max/median
shuffle records read.  A stage whose max is far above its median points at
a skewed key.
"""

from __future__ import annotations

import argparse
import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablewright.plans.registry import load_all  # noqa: E402
from tablewright.session import get_spark  # noqa: E402


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("query")
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--partitions", type=int, default=16)
    a = ap.parse_args()
    logdir = tempfile.mkdtemp(prefix="tw-eventlog-", dir="/tmp")
    spark = get_spark(shuffle_partitions=a.partitions,
                      extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{logdir}",
                             "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
    load_all()[a.query].fn(spark, a.sf).write.format("noop").mode("overwrite").save()
    spark.stop()
    stages = {}
    names = {}
    for path in [p for p in glob.glob(f"{logdir}/**/*", recursive=True) if os.path.isfile(p)]:
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    names[(info["Stage ID"], info["Stage Attempt ID"])] = info["Stage Name"].split(" at ")[0]
                if kind != "SparkListenerTaskEnd" or "Task Metrics" not in ev:
                    continue
                key = (ev["Stage ID"], ev["Stage Attempt ID"])
                m = ev["Task Metrics"]
                rec = m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0)
                dur = ev["Task Info"]["Finish Time"] - ev["Task Info"]["Launch Time"]
                stages.setdefault(key, []).append((dur, rec))
    print(f"{'stage':>8} {'tasks':>5} {'max ms':>7} {'med ms':>7} {'max rec':>9} {'med rec':>9}  name")
    for key in sorted(stages):
        t = stages[key]
        durs, recs = [d for d, _ in t], [r for _, r in t]
        print(f"{key[0]:>8} {len(t):>5} {max(durs):>7} {int(statistics.median(durs)):>7} {max(recs):>9} "
              f"{int(statistics.median(recs)):>9}  {names.get(key, '')}")


if __name__ == "__main__":
    main()
