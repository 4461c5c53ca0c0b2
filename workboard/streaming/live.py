"""Live dashboard over a stream of status changes.

The reference polls its counters every 2 s; here one Structured Streaming query keeps
them, with its state in Spark's own state store. The state is filled from ``tasks`` once,
when the stream starts, and lies in buckets of about ``TASKS_PER_BUCKET`` tasks by a hash
of the task id: a micro-batch reads the buckets of its own tasks, writes what has changed in
them since the start, and nothing else, whatever the size of the tables. A request carries
its requester's role, as the reference's token does (``with_roles``), so that no table is
looked up.

Each change gives one row of the log: the checks of the batch job I5, the status before,
the browser's counter arithmetic (J3) and the exact change of the counters. A micro-batch
writes its rows once, adds their sums to the counters of the batch before, and puts the
result into a small record. Readers go by records:

* J1 ``counters``: the last record. No table is read, and what has been committed to the
  tables meanwhile makes no difference. ``commit_changes`` writes the state's statuses to a
  snapshot with a mark of the last batch it has; a stream that starts from that snapshot
  leaves out the requests up to the mark (and, as the batch job I5, takes the others as
  newer than what is in the tables).
* J2 ``latest``: the state, as of the last record.
* J3 ``transitions`` and J4 ``rejected``: the log. Its folders are merged in tiers of
  ``MERGE`` and named by a manifest; replaced folders go after ``retain`` seconds.
* ``status_transitions`` and ``member_counters_literal`` are J3 over a batch table.

Tasks that other jobs create, edit or delete come as rows of kind ``put`` (status,
assigned_to, due_date) and ``delete``. Within a micro-batch changes are taken by (ts, seq),
null first; one that is older than the task's last change leaves the task as it is.
A batch that is retried writes the same folder and the same record again.
"""

from __future__ import annotations

import datetime as dt
import json
import pickle
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from workboard.functions.status import is_overdue_browser
from workboard.operators.joins import left_lookup
from workboard.operators.ordered import number_within_groups
from workboard.operators.rollups import stats_columns, task_stats
from workboard.session import arrow_batches, scratch_path
from workboard.sources.files import delete, names_in, read_record, set_times, write_record
from workboard.sources.snapshot import write_snapshot
from workboard.streaming import task_state
from workboard.streaming.task_state import GAINS, TaskChanges

COUNTERS = ("total_tasks", "completed_tasks", "in_progress_tasks", "overdue_tasks")
#: Tasks of a state bucket when the stream starts.
TASKS_PER_BUCKET = 256
#: The same of a replay, whose micro-batches have rows for most buckets; at least so many buckets per core.
REPLAY_TASKS_PER_BUCKET, BUCKETS_PER_CORE = 8192, 64
#: Buckets of a state partition when the stream starts, where that makes at least one partition per core.
BUCKETS_PER_PARTITION = 256
#: A replay's micro-batch takes files of so many bytes per core of the session (some 350,000 requests): each reads
#: the buckets of its tasks, so that few and large ones cost least.
BYTES_PER_CORE = 1 << 22
#: So many log folders of a tier become one of the next.
MERGE = 16
#: Records of the last so many micro-batches are kept.
RECORDS = 256
#: The layout of the state (see ``TaskChanges``); a stream goes on with its own only.
LAYOUT = "first, changed"


def with_roles(reqs: DataFrame, users: DataFrame) -> DataFrame:
    """Requests with the requester's role at the time they were sent (the token's)."""
    roles = users.select(F.col("id").alias("requester_id"), F.col("role").alias("requester_role"))
    return left_lookup(reqs, roles, "requester_id").select(*reqs.columns, "requester_role")


def replay_to_files(df: DataFrame, landing: str, files: int, order: tuple[str, ...] = ("ts", "seq")) -> str:
    """Write a batch table as ``files`` files in the order of ``order``: the replay source. A file
    stream takes files by their time, so they get times in that order."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(landing)
    set_times(df.sparkSession, landing, sorted(n for n in names_in(df.sparkSession, landing) if n.endswith(".parquet")))
    return landing


def file_stream(spark: SparkSession, landing: str, schema: T.StructType, files_per_trigger: int = 4,
                bytes_per_trigger: int | None = None) -> DataFrame:
    """A micro-batch takes ``bytes_per_trigger`` bytes of files (one file at least) if given, else ``files_per_trigger`` files."""
    reader = spark.readStream.schema(schema)
    if bytes_per_trigger is not None:
        return reader.option("maxBytesPerTrigger", bytes_per_trigger).parquet(landing)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(landing)


# ---- the stateful operator --------------------------------------------------

def _instant(as_of) -> dt.datetime:
    return dt.datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of


def _log_schema(changes: T.StructType) -> T.StructType:
    def field(name, kind):
        return T.StructField(name, kind)

    return T.StructType([field("seq", changes["seq"].dataType), field("ts", changes["ts"].dataType),
                         field("task_id", changes["task_id"].dataType), field("kind", T.StringType()),
                         field("status", T.StringType()), field("requester_id", changes["requester_id"].dataType),
                         field("outcome", T.StringType()), field("http_status", T.IntegerType()),
                         field("prev_status", T.StringType()),
                         *[field(c, T.IntegerType()) for c in ("d_in_progress", "d_completed", "d_overdue", *GAINS)]])


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")


@contextmanager
def _state_partitions(spark: SparkSession, buckets: int):
    """A stream that starts in here has its state in as many partitions as its buckets and the session's cores
    ask for, and not more than the session's shuffles have: each costs a Python worker's start and a commit in
    every micro-batch, however few rows it gets. A stream that goes on keeps the number in its checkpoint."""
    key = "spark.sql.shuffle.partitions"
    before = int(spark.conf.get(key))
    wanted = max(spark.sparkContext.defaultParallelism, -(-buckets // BUCKETS_PER_PARTITION))
    spark.conf.set(key, min(before, wanted))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def task_changes(changes: DataFrame, tasks: DataFrame, buckets: int, as_of, rule: str = "reference") -> DataFrame:
    """The stream ``changes`` (seq, ts, task_id, status, requester_id, requester_role; optionally kind,
    assigned_to, due_date) as log rows, one per change."""
    spark, given = changes.sparkSession, changes.columns
    absent = {"kind": F.lit("status"), "requester_role": F.lit(None).cast("string"),
              "assigned_to": F.lit(None).cast(tasks.schema["assigned_to"].dataType),
              "due_date": F.lit(None).cast(tasks.schema["due_date"].dataType)}
    rows = changes.withColumns({c: x for c, x in absent.items() if c not in given})
    rows = rows.withColumn("kind", F.coalesce("kind", F.lit("status"))).select(
        _bucket(F.col("task_id"), buckets), "seq", "ts", "task_id", "status", "requester_id", *absent)
    kind, held = rows.schema["task_id"].dataType, ["id", "status", "assigned_to", "due_date"]
    known = tasks.select(*held).withColumn("id", F.col("id").cast(kind)).select(_bucket(F.col("id"), buckets), *held)
    cloudpickle.register_pickle_by_value(task_state)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log = _log_schema(rows.schema)
    schemas = [to_arrow_schema(s) for s in (rows.drop("bucket").schema, known.drop("bucket").schema, log)]

    def packed(df: DataFrame, schema) -> DataFrame:
        return df.mapInArrow(task_state.pack(schema), "bucket long, rows binary")

    first = packed(known, schemas[1]).groupBy("bucket").agg(F.collect_list("rows").alias("tasks"))  # a bucket is small by construction
    out = packed(rows, schemas[0]).groupBy("bucket").transformWithState(
        TaskChanges(_instant(as_of), rule, *schemas), "rows binary", "Append", "None", first.groupBy("bucket"))
    return out.mapInArrow(task_state.unpack(schemas[2]), log)


# ---- what a stream leaves in its folder --------------------------------------

class LiveBoard:
    """The folder of one stream: checkpoint/, log/ with a folder per micro-batch or merged ones,
    records/ and manifests/."""

    def __init__(self, spark: SparkSession, root: str, changes: T.StructType, retain: float = 3600.0):
        self.spark, self.root, self.retain = spark, root.rstrip("/"), retain
        self.changes, self.schema = changes, _log_schema(changes)

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.root}/{kind}") if n.endswith(".json"))

    def _record(self, kind: str, number: int) -> dict | None:
        text = read_record(self.spark, f"{self.root}/{kind}/{number:012d}.json")
        return None if text is None else json.loads(text)

    def _put(self, kind: str, number: int, record: dict) -> None:
        write_record(self.spark, f"{self.root}/{kind}/{number:012d}.json", json.dumps(record), replace=True)

    def begin(self, tasks: DataFrame, as_of, rule: str, tasks_per_bucket: int) -> dict:
        """The stream's settings; at its first start also the counters it starts from (record 0)."""
        text = read_record(self.spark, f"{self.root}/stream.json")
        if text is not None:
            settings = json.loads(text)
            if settings.get("layout") != LAYOUT:
                raise ValueError(f"{self.root} has its state in another layout ({settings.get('layout')}): start a new stream from a "
                                 "snapshot that has its changes (commit_changes, after_seq)")
            return settings
        counts = task_stats(tasks, as_of).first().asDict()
        self._put("records", 0, {"batch": -1, "seq": None, **{c: counts[c] for c in COUNTERS}})
        total = counts["total_tasks"]
        least = min(total // TASKS_PER_BUCKET, BUCKETS_PER_CORE * self.spark.sparkContext.defaultParallelism)
        settings = {"buckets": max(total // tasks_per_bucket, least) + 1, "as_of": _instant(as_of).isoformat(), "rule": rule,
                    "layout": LAYOUT}
        write_record(self.spark, f"{self.root}/stream.json", json.dumps(settings))
        return settings

    def last(self) -> dict:
        """The record of the last finished micro-batch: batch, seq (the greatest so far), the counters."""
        return self._record("records", self._numbers("records")[-1])

    def counters(self) -> DataFrame:
        """The counters after the last micro-batch."""
        last = self.last()
        return self.spark.createDataFrame([tuple(last[c] for c in COUNTERS)], T.StructType(
            [T.StructField(c, T.LongType()) for c in COUNTERS]))

    def latest(self) -> DataFrame:
        """task_id and status of the latest applied change by (ts, seq), from the state."""
        kinds = T.StructType([self.changes["task_id"], T.StructField("status", T.StringType())])
        batch = self.last()["batch"]
        if batch < 0:
            return self.spark.createDataFrame([], kinds)
        state = (self.spark.read.format("statestore").option("stateVarName", "changed").option("batchId", batch)
                 .load(f"{self.root}/checkpoint").select(F.col("value.tasks").alias("tasks")))

        def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in stream:
                rows = [(k, t[0]) for blob in frame["tasks"] for k, t in pickle.loads(blob).items()
                        if t is not None and t[3] is not None]
                yield pd.DataFrame(rows, columns=["task_id", "status"], dtype=object)

        return state.mapInPandas(run, kinds)

    def log(self) -> DataFrame:
        """All log rows of finished micro-batches."""
        batch = self.last()["batch"]
        manifest = self._manifest(batch)
        paths = [p["path"] for p in manifest["parts"]] + [f"batch={i}" for i in range(manifest["through"] + 1, batch + 1)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/log/{p}" for p in paths])

    def rejected(self) -> DataFrame:
        """The requests that failed a check."""
        return self.log().where(F.col("outcome") != "applied").select(
            "seq", "task_id", "status", "requester_id", "outcome", "http_status")

    def transitions(self) -> DataFrame:
        """The browser's arithmetic per applied change, as it came in."""
        return self.log().where((F.col("outcome") == "applied") & (F.col("kind") == "status")).select(
            "seq", "task_id", "prev_status", "status", "d_in_progress", "d_completed", "d_overdue")

    def _manifest(self, batch: int) -> dict:
        """The newest manifest that covers no batch after ``batch``."""
        for number in reversed(self._numbers("manifests")):
            if number <= batch:
                found = self._record("manifests", number)
                if found is not None:
                    return found
        return {"through": -1, "parts": [], "dropped": []}

    def process(self, rows: DataFrame, batch: int) -> None:
        """A micro-batch: its rows, then its record, then perhaps a merge of the log."""
        folder = f"{self.root}/log/batch={batch}"
        rows.write.mode("overwrite").parquet(folder)
        sums = self.spark.read.schema(self.schema).parquet(folder).agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in GAINS], F.max("seq").alias("seq")).first()
        before = self._record("records", batch)
        seq = max((x for x in (before["seq"], sums["seq"]) if x is not None), default=None)
        self._put("records", batch + 1, {"batch": batch, "seq": seq, **{c: before[c] + sums[g] for c, g in zip(COUNTERS, GAINS)}})
        if (batch + 1) % MERGE == 0:
            self.merge(batch)

    def merge(self, batch: int) -> None:
        """Put up a manifest of the log through ``batch`` in which at most ``MERGE - 1`` folders
        of a tier are left, and remove what earlier manifests replaced ``retain`` seconds ago."""
        old, now = self._manifest(batch - 1), time.time()
        parts = old["parts"] + [{"path": f"batch={i}", "tier": 0} for i in range(old["through"] + 1, batch + 1)]
        dropped, tier = list(old["dropped"]), 0
        while any(p["tier"] >= tier for p in parts):
            same = [p for p in parts if p["tier"] == tier]
            while len(same) >= MERGE:
                group, same = same[:MERGE], same[MERGE:]
                path = f"merged={uuid.uuid4().hex}"
                rows = self.spark.read.schema(self.schema).parquet(*[f"{self.root}/log/{p['path']}" for p in group])
                rows.coalesce(max(1, len(rows.inputFiles()) // MERGE)).write.parquet(f"{self.root}/log/{path}")
                at = parts.index(group[0])
                parts = [p for p in parts[:at] if p not in group] + [{"path": path, "tier": tier + 1}] + [
                    p for p in parts[at:] if p not in group]
                dropped += [{"path": p["path"], "at": now} for p in group]
            tier += 1
        gone = [d for d in dropped if d["at"] <= now - self.retain]
        for d in gone:
            delete(self.spark, f"{self.root}/log/{d['path']}")
        self._put("manifests", batch, {"through": batch, "parts": parts, "dropped": [d for d in dropped if d not in gone]})
        for kind, keep in (("records", RECORDS), ("manifests", 2)):
            for number in self._numbers(kind)[:-keep]:
                delete(self.spark, f"{self.root}/{kind}/{number:012d}.json")

    def mark(self) -> dict:
        """What a snapshot that has this stream's changes is marked with."""
        last = self.last()
        return {"stream": self.root, "batch": last["batch"], "seq": last["seq"]}


def start_live_board(spark: SparkSession, changes: DataFrame, tasks: DataFrame, as_of, root: str, rule: str = "reference",
                     trigger: dict | None = None, after_seq=None, tasks_per_bucket: int = TASKS_PER_BUCKET, retain: float = 3600.0):
    """Start (or go on with) the stream that keeps its state under ``root``: the running query and
    its LiveBoard. ``tasks`` fills the state at the first start; if it is a snapshot that has an
    earlier stream's changes, ``after_seq`` is the ``seq`` of its mark."""
    board = LiveBoard(spark, root, changes.schema, retain)
    settings = board.begin(tasks, as_of, rule, tasks_per_bucket)
    rows = changes if after_seq is None else changes.where(F.col("seq").isNull() | (F.col("seq") > F.lit(after_seq)))
    out = task_changes(rows, tasks, settings["buckets"], settings["as_of"], settings["rule"])
    writer = (out.writeStream.outputMode("append").foreachBatch(board.process)
              .option("checkpointLocation", f"{board.root}/checkpoint").trigger(**(trigger or {"processingTime": "2 seconds"})))
    with _state_partitions(spark, settings["buckets"]), arrow_batches(spark, task_state.PACK_BYTES):  # the stream keeps both
        query = writer.start()
    return query, board


def commit_changes(board: LiveBoard, ws, root: str) -> int:
    """Commit the stream's statuses into the snapshots under ``root`` as a new version of ``ws``,
    marked with the stream's last batch. The stream need not stop."""
    mark = board.mark()
    changed = board.latest().select(F.col("task_id").alias("id"), F.col("status").alias("_new"))
    tasks = left_lookup(ws.tasks, changed, "id").withColumn("status", F.coalesce("_new", "status")).select(*ws.tasks.columns)
    return write_snapshot(ws.replace(tasks=tasks), root, mark=mark)


def replay(spark: SparkSession, reqs: DataFrame, tasks: DataFrame, users: DataFrame, as_of, rule: str = "reference",
           root: str | None = None, files: int | None = None, files_per_trigger: int | None = None) -> LiveBoard:
    """Run status requests (seq, ts, task_id, status, requester_id) through the stream until all are
    processed. They are landed as ``files`` files in their order (default: the session's number of
    shuffle partitions, so that as many tasks write them), of which a micro-batch takes
    ``files_per_trigger`` (default: ``BYTES_PER_CORE`` bytes of them for each of the session's cores, so
    that the number of micro-batches goes by the requests and not by the number of files). Ask for more
    files where a table is so large that one of them would make too large a micro-batch."""
    root = root or scratch_path(spark, "live")
    landed = with_roles(reqs, users)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = {"bytes_per_trigger": BYTES_PER_CORE * spark.sparkContext.defaultParallelism}
    if files_per_trigger:
        size = {"files_per_trigger": files_per_trigger}
    landing = replay_to_files(landed, f"{root}/landing", files)
    query, board = start_live_board(spark, file_stream(spark, landing, landed.schema, **size), tasks, as_of,
                                    f"{root}/board", rule, {"availableNow": True}, tasks_per_bucket=REPLAY_TASKS_PER_BUCKET)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return board


def run_live_counters(spark: SparkSession, reqs: DataFrame, tasks: DataFrame, users: DataFrame,
                      as_of, rule: str = "reference", root: str | None = None) -> DataFrame:
    """J1 over a replay."""
    return replay(spark, reqs, tasks, users, as_of, rule, root).counters()


def run_latest_status(spark: SparkSession, reqs: DataFrame, tasks: DataFrame, users: DataFrame, as_of,
                      rule: str = "reference") -> DataFrame:
    """J2 over a replay."""
    return replay(spark, reqs, tasks, users, as_of, rule).latest()


def run_rejected_events(spark: SparkSession, reqs: DataFrame, tasks: DataFrame, users: DataFrame, as_of,
                        rule: str = "reference") -> DataFrame:
    """J4 over a replay."""
    return replay(spark, reqs, tasks, users, as_of, rule).rejected()


def run_transitions(spark: SparkSession, reqs: DataFrame, tasks: DataFrame, users: DataFrame, as_of,
                    rule: str = "reference") -> DataFrame:
    """J3 over a replay, as a stream."""
    return replay(spark, reqs, tasks, users, as_of, rule).transitions()


# ---- J3 over a batch table ---------------------------------------------------

def _transitions(changes: DataFrame, tasks: DataFrame, as_of) -> DataFrame:
    base = tasks.select(F.col("id").alias("task_id"), F.col("status").alias("_base"), "due_date")
    c = changes.select("seq", "ts", "task_id", "status")
    numbered = number_within_groups(c, ["task_id"], [F.col("ts").asc(), F.col("seq").asc()],
                                    pos_col="_pos", lag_cols=("status",))
    j = numbered.join(base, "task_id", "left")
    prev = F.when(F.col("_pos") == 1, F.col("_base")).otherwise(F.col("prev_status"))
    j = j.withColumn("prev_status", prev)
    same = F.col("prev_status").eqNullSafe(F.col("status"))

    def d(cond_leave, cond_enter):
        v = F.coalesce(cond_enter, F.lit(False)).cast("int") - F.coalesce(cond_leave, F.lit(False)).cast("int")
        return F.when(same, F.lit(0)).otherwise(v)

    overdue_before = is_overdue_browser(as_of, "prev_status", "due_date")
    return j.select(
        "seq", "ts", "task_id", "prev_status", "status",
        d(F.col("prev_status") == "in_progress", F.col("status") == "in_progress").alias("d_in_progress"),
        d(F.col("prev_status") == "completed", F.col("status") == "completed").alias("d_completed"),
        F.when(same, F.lit(0)).when(overdue_before & (F.col("status") == "completed"), F.lit(-1))
         .otherwise(F.lit(0)).alias("d_overdue"))


def status_transitions(changes: DataFrame, tasks: DataFrame, as_of) -> DataFrame:
    """The browser's counter arithmetic per applied change, in (ts, seq) order per task.

    ``prev_status`` is the task's status before the change (the stored status
    for its first change). Same status -> no change; leaving / entering
    in_progress or completed -> -1 / +1; completing an overdue task (browser
    rule) -> overdue -1; reopening never adds overdue back (R14).
    """
    return _transitions(changes, tasks, as_of).drop("ts")


COUNTER_DELTAS = {"completed_tasks": "d_completed", "in_progress_tasks": "d_in_progress",
                  "overdue_tasks": "d_overdue"}


def member_counters_literal(changes: DataFrame, tasks: DataFrame, as_of) -> DataFrame:
    """J3 applied: the counters each assignee's dashboard ends with after replaying
    the changes of their tasks one by one with the browser's arithmetic, where
    every decrement floors at 0 (``Math.max(0, x - 1)``).

    A counter that starts at ``b`` and takes deltas ``x1..xn`` with a floor at 0
    ends at ``b + S - min(0, b + min_k S_k)`` (``S_k`` the prefix sums), so only
    the running sums per assignee are needed: computed with the skew-safe
    numbering (a hot assignee is split across partitions), then folded by a
    partial aggregation. ``total_tasks`` is untouched by status changes.
    """
    owner = tasks.select(F.col("id").alias("task_id"), F.col("assigned_to").alias("user_id"))
    t = _transitions(changes, tasks, as_of).join(owner, "task_id").where(F.col("user_id").isNotNull())
    deltas = tuple(COUNTER_DELTAS.values())
    run = number_within_groups(t, ["user_id"], [F.col("ts").asc(), F.col("seq").asc()],
                               pos_col="_pos", sum_cols=deltas)
    folded = run.groupBy("user_id").agg(
        *[F.sum(c).alias(f"s_{c}") for c in deltas], *[F.min(f"cum_{c}").alias(f"m_{c}") for c in deltas])
    base = (tasks.where(F.col("assigned_to").isNotNull())
                 .groupBy(F.col("assigned_to").alias("user_id")).agg(*stats_columns(as_of)))
    j = folded.join(base, "user_id")
    out = [F.col("user_id"), F.col("total_tasks")]
    for counter, dcol in COUNTER_DELTAS.items():
        b = F.col(counter)
        out.append((b + F.col(f"s_{dcol}") - F.least(F.lit(0), b + F.col(f"m_{dcol}"))).alias(counter))
    return j.select(*out)
