"""Stage times from a Spark event log folder (written by bench.py with BENCH_EVENT_LOG).

Usage: python tools/stage_times.py <event-log-folder> [top_n]
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def events(folder: str):
    for f in sorted(glob.glob(os.path.join(folder, "**", "events_*"), recursive=True)):
        if f.endswith(".zstd"):
            import zstandard
            with open(f, "rb") as fh:
                text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
                yield from (json.loads(line) for line in text)
        else:
            with open(f) as fh:
                yield from (json.loads(line) for line in fh)


def main():
    folder = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 10
    stages = []
    for e in events(folder):
        if e.get("Event") == "SparkListenerStageCompleted":
            i = e["Stage Info"]
            ms = i.get("Completion Time", 0) - i.get("Submission Time", 0)
            stages.append((ms, i.get("Number of Tasks", 0), i.get("Stage Name", "")[:70]))
    print(json.dumps({"stages": len(stages), "total_stage_ms": sum(s[0] for s in stages),
                      "longest": [{"ms": m, "tasks": t, "name": n} for m, t, n in sorted(stages, reverse=True)[:top]]},
                     indent=1))


if __name__ == "__main__":
    main()
