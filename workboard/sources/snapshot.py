"""Snapshots of the four tables (A5) and JSON documents (A4).

Spark has no multi-table transaction. A snapshot's tables are written to folders of
their own, ``<root>/data/<random name>/<table>``; only then is its commit record put at
``<root>/_commits/<version>.json``, which names the folder of every table. The record is
written in full under another name and renamed if there is none yet: of two writers of one
version one fails, and nothing that was committed is ever written again. A record that
can't be read was left by a writer that died and gives way to the next one. Tables that a
writer leaves out are carried forward from the version before. Readers take the highest
version, so a failed or half-written job is never visible; ``vacuum`` removes what such
jobs, and versions no longer kept, leave behind.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.sources.files import FileExists, delete, names_in, read_record, write_record
from workboard.sources.workspace import TABLES, Workspace, key_type_of, schemas_for

_COMMIT = "version long, committed_at string, key_type string, tables map<string,string>, mark string"


class SnapshotConflict(RuntimeError):
    """Another writer has committed the version."""


def to_json_docs(df: DataFrame, column: str = "doc") -> DataFrame:
    """A4: one JSON document per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))


def _commits(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(_COMMIT).json(f"{root}/_commits")
    except AnalysisException as e:  # no commit yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest_version(spark: SparkSession, root: str) -> int | None:
    commits = _commits(spark, root)
    return None if commits is None else commits.agg(F.max("version")).first()[0]


def _commit_of(spark: SparkSession, root: str, version: int):
    commits = _commits(spark, root)
    return None if commits is None else commits.where(F.col("version") == version).first()


def _put(spark: SparkSession, root: str, version: int, record: dict) -> None:
    """Put a commit record; SnapshotConflict if the version has one."""
    path = f"{root}/_commits/{version:012d}.json"
    try:
        write_record(spark, path, json.dumps(record))
    except FileExists as e:
        if _readable(read_record(spark, path)):
            raise SnapshotConflict(f"version {version} is committed") from e
        write_record(spark, path, json.dumps(record), replace=True)


def _readable(text: str | None) -> bool:
    try:
        return "tables" in json.loads(text or "")
    except ValueError:
        return False


# Physical layout per table, standing in for the reference's B-tree indexes:
# rows are range-partitioned and sorted on the main access path (so min/max
# statistics prune row groups for equality and range filters on it), and the
# other equality lookups get parquet bloom filters.
LAYOUT = {
    "users": {"sort": ["id"], "bloom": ["email"]},
    "projects": {"sort": ["id"], "bloom": ["created_by"]},
    "project_members": {"sort": ["project_id", "user_id"], "bloom": ["user_id"]},
    "tasks": {"sort": ["project_id", "created_at", "id"], "bloom": ["assigned_to", "id"]},
}


def _laid_out(df: DataFrame, name: str, partitions: int | None):
    spec = LAYOUT.get(name)
    if not spec:
        return df.write
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = df.repartitionByRange(n, *spec["sort"]).sortWithinPartitions(*spec["sort"]).write
    for c in spec["bloom"]:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return w


def write_snapshot(ws: Workspace, root: str, version: int | None = None,
                   mode_tables=TABLES, partitions: int | None = None, mark: dict | None = None) -> int:
    """Write ``mode_tables`` and commit them as ``version`` (default: the next one), with
    the other tables as they are in the version before. ``mark`` says up to where a stream's
    changes are in these tables (``snapshot_mark`` returns it)."""
    spark = ws.users.sparkSession
    last = latest_version(spark, root)
    version = (0 if last is None else last + 1) if version is None else version
    kind = key_type_of(ws).simpleString()
    where = {}
    if set(mode_tables) != set(TABLES):
        before = _commit_of(spark, root, version - 1)
        if before is None or before["key_type"] != kind:
            raise ValueError(f"no version {version - 1} with {kind} keys to carry tables forward from")
        where = dict(before["tables"])
    if _commit_of(spark, root, version) is not None:
        raise SnapshotConflict(f"version {version} is committed")
    data = f"{root}/data/{uuid.uuid4().hex}"
    for name in mode_tables:
        where[name] = f"{data}/{name}"
        _laid_out(ws[name], name, partitions).parquet(where[name])
    _put(spark, root, version, {
        "version": version, "committed_at": dt.datetime.now(dt.timezone.utc).isoformat(), "key_type": kind, "tables": where,
        "mark": None if mark is None else json.dumps(mark)})
    return version


def snapshot_mark(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """The mark of a committed version (default: the latest); None if it has none."""
    version = latest_version(spark, root) if version is None else version
    commit = None if version is None else _commit_of(spark, root, version)
    return None if commit is None or commit["mark"] is None else json.loads(commit["mark"])


def vacuum(spark: SparkSession, root: str, keep: int | None = None, older_than: float = 86_400.0) -> list[str]:
    """Remove the commit records before the last ``keep`` versions (default: none), then every table
    folder that no record names. What was changed in the last ``older_than`` seconds stays: a
    writer may be at work on it, a reader may still list it. Returns what was removed."""
    commits = _commits(spark, root)
    versions = [] if commits is None else sorted(r["version"] for r in commits.select("version").collect() if r["version"] is not None)
    limit, gone = (time.time() - older_than) * 1000, []
    old = set() if keep is None else set(versions[:max(0, len(versions) - max(1, keep))])
    for name, changed in names_in(spark, f"{root}/_commits").items():
        if changed <= limit and name.removesuffix(".json").isdigit() and int(name.removesuffix(".json")) in old:
            delete(spark, f"{root}/_commits/{name}")
            gone.append(f"_commits/{name}")
    left = _commits(spark, root)
    named = set() if left is None else {p.rstrip("/").split("/data/")[-1] for r in left.select("tables").collect()
                                        if r["tables"] for p in r["tables"].values()}
    for folder in names_in(spark, f"{root}/data"):
        tables = names_in(spark, f"{root}/data/{folder}")
        dead = [t for t, changed in tables.items() if f"{folder}/{t}" not in named and changed <= limit]
        for t in dead:
            delete(spark, f"{root}/data/{folder}/{t}")
        if len(dead) == len(tables) and (tables or names_in(spark, f"{root}/data")[folder] <= limit):
            delete(spark, f"{root}/data/{folder}")
        gone += [f"data/{folder}/{t}" for t in dead]
    return gone


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> Workspace:
    """The workspace at ``version`` (default: the latest committed one)."""
    version = latest_version(spark, root) if version is None else version
    commit = None if version is None else _commit_of(spark, root, version)
    if commit is None:
        raise FileNotFoundError(f"no committed snapshot {'' if version is None else version} under {root}")
    schemas = schemas_for(T.StringType() if commit["key_type"] == "string" else T.LongType())
    return Workspace(**{n: spark.read.schema(schemas[n]).parquet(commit["tables"][n]) for n in TABLES})


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A4 as a sink: the rows as JSON lines under ``path`` (one file per partition)."""
    df.write.mode(mode).json(path)
    return path
