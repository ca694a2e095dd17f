"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the no-op sink (every row computed, nothing
collected to the driver). Prints one JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import glob
import json
import os
import re
import subprocess
import sys
import time
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vulnsift.queries import QUERIES  # noqa: E402
from vulnsift.session import get_session  # noqa: E402

HEADLINE = [
    "eval_metrics",
    "findings_parse",
    "per_class_recall",
    "macro_f1",
    "reward_total",
    "rollout_scores",
    "pass_rate",
    "pass_at_k",
    "sft_build",
    "dpo_build",
    "rl_prompts",
    "cpt_budget",
    "split_shuffle",
    "delta_pairs",
    "decontaminate",
    "repetition",
    "trace_quality",
    "chat_render",
    "run_compare",
    "source_counts",
]


def shuffle_bytes(log_dir: str) -> dict[str, int]:
    """Shuffle bytes written per job group, from Spark's event log (first timed run only)."""
    stage_group: dict[int, str] = {}
    written: dict[int, int] = defaultdict(int)
    for path in sorted(glob.glob(f"{log_dir}/**/*", recursive=True)):
        if os.path.isdir(path) or "appstatus" in path:
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        if group:
                            stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    m = (ev.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                    written[ev.get("Stage ID")] += int(m.get("Shuffle Bytes Written", 0))
    out: dict[str, int] = defaultdict(int)
    for sid, b in written.items():
        g = stage_group.get(sid, "")
        if g.endswith("#0"):
            out[g[:-2]] += b
    return dict(out)


def measure_shuffle(sf_dir: str, cpus: str, names: list[str]) -> None:
    """`--shuffle`: each query once with an (uncompressed) event log in a fresh scratch folder;
    prints shuffle bytes written per query. Kept apart from timing: logging slows the runs."""
    log_dir = subprocess.check_output(["mktemp", "-d", "/tmp/run-XXXXXX"]).decode().strip()
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                        conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log_dir}",
                              "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
    for name in names:
        spark.sparkContext.setJobGroup(f"{name}#0", name)
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()
    print(json.dumps({"metric": "shuffle_bytes_written", "unit": "bytes", "queries": shuffle_bytes(log_dir)}))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    names = [n for n in (args or HEADLINE) if n in QUERIES]
    if "--shuffle" in sys.argv:
        measure_shuffle(sf_dir, cpus, names)
        return
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    # Warm-up: JVM start, class loading, codegen of common paths.
    QUERIES["split_shuffle"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(2):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
