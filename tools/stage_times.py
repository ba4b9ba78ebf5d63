"""Summarise a Spark event log: per SQL execution, jobs, stages, tasks and stage time.

Usage: python tools/stage_times.py <event-log-file-or-folder>
"""

from __future__ import annotations

import json
import sys
from collections import defaultdict
from pathlib import Path


def _read(p: Path) -> str:
    if p.suffix == ".zstd":
        import io

        import zstandard

        with p.open("rb") as fh, zstandard.ZstdDecompressor().stream_reader(fh, read_across_frames=True) as r:
            return io.TextIOWrapper(r, encoding="utf-8").read()
    return p.read_text()


def main() -> None:
    target = Path(sys.argv[1])
    files = sorted(target.iterdir()) if target.is_dir() else [target]
    for f in files:
        # Spark 4 writes rolling logs: a folder of events_N_* files per application.
        parts = sorted((p for p in f.iterdir() if p.name.startswith("events_")),
                       key=lambda p: int(p.name.split("_")[1])) if f.is_dir() else [f]
        lines = [ln for p in parts for ln in _read(p).splitlines()]
        desc, job_exec, stage_job = {}, {}, {}
        stage_ms, stage_tasks = {}, {}
        for line in lines:
            e = json.loads(line)
            kind = e.get("Event", "")
            if kind.endswith("SQLExecutionStart"):
                desc[e["executionId"]] = (e.get("description") or "").splitlines()[0][:60]
            elif kind == "SparkListenerJobStart":
                ex = (e.get("Properties") or {}).get("spark.sql.execution.id")
                job_exec[e["Job ID"]] = int(ex) if ex is not None else None
                for s in e.get("Stage IDs", []):
                    stage_job[s] = e["Job ID"]
            elif kind == "SparkListenerStageCompleted":
                info = e["Stage Info"]
                if "Completion Time" in info and "Submission Time" in info:
                    stage_ms[info["Stage ID"]] = info["Completion Time"] - info["Submission Time"]
                    stage_tasks[info["Stage ID"]] = info["Number of Tasks"]
        per = defaultdict(lambda: [set(), 0, 0, 0])
        for sid, ms in stage_ms.items():
            ex = job_exec.get(stage_job.get(sid))
            row = per[ex]
            row[0].add(stage_job.get(sid))
            row[1] += 1
            row[2] += stage_tasks[sid]
            row[3] += ms
        print(f"# {f.name}")
        print(f"{'exec':>5} {'jobs':>4} {'stages':>6} {'tasks':>6} {'stage_ms':>9}  description")
        for ex in sorted(per, key=lambda x: (x is None, x or 0)):
            jobs, n_st, n_t, ms = per[ex]
            print(f"{str(ex):>5} {len(jobs):>4} {n_st:>6} {n_t:>6} {ms:>9}  {desc.get(ex, '')}")


if __name__ == "__main__":
    main()
