"""Per-stage wall and task times of one registered query, from Spark's event log.

The event log goes to a fresh scratch folder (no UI, no server).

usage: python scripts/stage_times.py <query> [sf_dir] [fixture]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    name = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    fixture = sys.argv[3] if len(sys.argv) > 3 else None
    from cumulus.plans import registry as R
    from cumulus.session import build_session
    log_dir = tempfile.mkdtemp(prefix="cumulus-eventlog-")
    spark = build_session("local[8]", shuffle_partitions=16,
                          conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
    R.run(name, spark, sf_dir, fixture=fixture).write.format("noop").mode("overwrite").save()  # warm-up
    import time
    t0 = int(time.time() * 1000)
    R.run(name, spark, sf_dir, fixture=fixture).write.format("noop").mode("overwrite").save()
    total = int(time.time() * 1000) - t0
    spark.stop()
    stages = {}
    for path in [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p)]:
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    s = stages.setdefault(info["Stage ID"], {"task_ms": 0})
                    s.update(name=info["Stage Name"].split(" at ")[0], tasks=info["Number of Tasks"],
                             submitted=info.get("Submission Time", 0),
                             wall_ms=info.get("Completion Time", 0) - info.get("Submission Time", 0))
                elif kind == "SparkListenerTaskEnd":
                    sid = ev["Stage ID"]
                    m = ev.get("Task Metrics") or {}
                    stages.setdefault(sid, {"task_ms": 0})
                    stages[sid]["task_ms"] += m.get("Executor Run Time", 0)
    print(f"{name}: {total} ms end to end (second run); its stages:")
    for sid in sorted(stages):
        s = stages[sid]
        if s.get("submitted", 0) < t0:
            continue
        print(f"stage {sid:4d} tasks {s['tasks']:4d} wall {s['wall_ms']:6d} ms  task-sum {s['task_ms']:6d} ms  {s['name']}")


if __name__ == "__main__":
    main()
