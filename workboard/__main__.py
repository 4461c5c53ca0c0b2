"""Command line: write the admin overview or the audits as JSON documents.

    python -m workboard overview --data DIR --out OUT [--as-of 1998-08-02T00:00:00] [--snapshot ROOT]
    python -m workboard audit    --data DIR --out OUT

``--data`` is a folder of driver tables (customer, supplier, orders, lineitem
parquet); ``--snapshot`` reads a committed workspace snapshot instead.
"""

from __future__ import annotations

import argparse
import datetime as dt

from workboard.operators import audit
from workboard.plans.overview import overview
from workboard.session import build_session
from workboard.sources.snapshot import read_snapshot, write_json
from workboard.sources.workspace import derive_workspace


def main(argv=None, spark=None) -> dict:
    p = argparse.ArgumentParser(prog="workboard")
    p.add_argument("command", choices=["overview", "audit"])
    p.add_argument("--data")
    p.add_argument("--snapshot")
    p.add_argument("--out", required=True)
    p.add_argument("--as-of", default=None, help="reporting instant (default: now, UTC wall clock)")
    a = p.parse_args(argv)
    if not (a.data or a.snapshot):
        p.error("give --data or --snapshot")
    spark = spark or build_session()
    ws = read_snapshot(spark, a.snapshot) if a.snapshot else derive_workspace(spark, a.data)
    out = a.out.rstrip("/")
    if a.command == "overview":
        as_of = dt.datetime.fromisoformat(a.as_of) if a.as_of else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
        parts = overview(ws, as_of)
    else:
        parts = {"orphans": audit.orphan_audit(ws), "constraints": audit.constraint_audit(ws)}
    return {name: write_json(df, f"{out}/{name}") for name, df in parts.items()}


if __name__ == "__main__":
    main()
