"""Exchange counts of each registered query's final (post-AQE) plan above the

usage: python scripts/plan_stats.py [sf_dir] [fixture override for B2 queries]
"""

from __future__ import annotations

import json
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

EXCH = re.compile(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)")


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    big = sys.argv[2] if len(sys.argv) > 2 else "B3"
    from cumulus.plans import registry as R
    from cumulus.session import build_session
    spark = build_session("local[8]", shuffle_partitions=16)
    out = {}
    for name, (fx, _) in R.REGISTRY.items():
        df = R.run(name, spark, sf_dir, fixture=big if fx == "B2" else fx)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan()
        final = plan.executedPlan().toString() if plan.nodeName() == "AdaptiveSparkPlan" else plan.toString()
        out[name] = {"exchanges": len(EXCH.findall(final)), "broadcasts": final.count("BroadcastExchange"),
                     "window_group_limit": "WindowGroupLimit" in final}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
