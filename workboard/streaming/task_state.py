"""The stateful operator of the live board: tasks by bucket, one row out for each change.

Rows go in and out of the operator packed, as Arrow batches in a binary column: taken one by one,
their way through Python costs many times what is done with them. ``pack`` puts the rows
of a bucket together, ``unpack`` gives the rows back.

Spark starts a Python process of its own on the driver to ask a processor for its state's
schema. That process may not have this package on its path, so the module is pickled by
value (``live.task_changes`` sees to it) and refers to nothing else of the package but
constants.
"""

from __future__ import annotations

import datetime as dt
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from workboard.functions.status import STATUSES

GAINS = ("g_total", "g_completed", "g_in_progress", "g_overdue")
HTTP = {"applied": 200, "invalid_status": 400, "not_found": 404, "forbidden": 403}
#: Bytes of rows that a task packs at a time, and changes of a bucket that are worked off at a time.
PACK_BYTES, STEP_ROWS = 1 << 24, 1 << 16


def pack(schema: pa.Schema) -> Callable:
    """For mapInArrow: rows of ``bucket`` and the columns of ``schema`` as (bucket, rows), of each bucket
    one batch per ``PACK_BYTES`` of a task's rows, in their order."""
    def cut(held: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        keys = table.column("bucket").to_numpy()
        order = np.argsort(keys, kind="stable")
        rows = table.select(schema.names).take(pa.array(order)).cast(schema).combine_chunks()
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        rows = pa.RecordBatch.from_arrays([c.chunk(0) for c in rows.columns], schema=schema)
        blobs = [rows.slice(a, b - a).serialize().to_pybytes() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)])]
        return pa.RecordBatch.from_arrays([pa.array(keys[starts], pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PACK_BYTES:
                yield cut(held)
                held, size = [], 0
        if held:
            yield cut(held)

    return run


def unpack(schema: pa.Schema) -> Callable:
    """For mapInArrow: the rows in the batches of the column ``rows``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("rows"):
                yield pa.ipc.read_record_batch(blob.as_buffer(), schema)

    return run


def _table(blobs: list, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(b), schema) for b in blobs], schema)


def _plain(column) -> list:
    """Python values; timestamps as whole numbers. Arrow's own way takes a scalar object for each."""
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.int64())
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_string(column.type):
        coded = pc.dictionary_encode(column)
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        values = [*coded.dictionary.to_pylist(), None]
        return [values[i] for i in coded.indices.fill_null(-1).to_numpy().tolist()]
    if pa.types.is_integer(column.type):
        values = pc.fill_null(column, 0).to_numpy().tolist()
        return values if not column.null_count else [v if ok else None for v, ok in zip(values, column.is_valid().to_pylist())]
    return column.to_pylist()


def _place(ts, seq, status) -> tuple:
    """Order of changes, null first."""
    return (ts is not None, ts or 0, seq is not None, 0 if seq is None else seq, status or "")


class TaskChanges(StatefulProcessor):
    """Per bucket the tasks (id: status, assignee, due date, place of the last change), and one
    row out for each row in. The tasks that the state was filled with are kept as one batch that is never
    written again; those that changed since are kept apart (None: deleted), and only they are written."""

    def __init__(self, as_of: dt.datetime, rule: str, changes: pa.Schema, tasks: pa.Schema, log: pa.Schema):
        self.as_of = (as_of - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        self.rule, self.changes, self.tasks, self.log = rule, changes, tasks, log

    def init(self, handle) -> None:
        self.first = handle.getValueState("first", "tasks binary")
        self.changed = handle.getValueState("changed", "tasks binary")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        tasks = _table(initialState["tasks"], self.tasks)
        # of tasks with one id the last counts: a search finds the first
        rows = tasks.take(pa.array(np.arange(tasks.num_rows)[::-1])).combine_chunks()
        self.first.update((pa.RecordBatch.from_arrays([c.chunk(0) for c in rows.columns], schema=self.tasks).serialize().to_pybytes(),))

    def _known(self, ids: pa.Array) -> dict:
        """The tasks of ``ids`` that the state was filled with."""
        held = self.first.get()
        if not held:
            return {}
        tasks = pa.ipc.read_record_batch(pa.py_buffer(held[0]), self.tasks)
        at = pc.index_in(ids, value_set=tasks.column("id")).drop_null()
        found = tasks.take(at)
        return {i: (status, assignee, due, None)
                for i, status, assignee, due in zip(*(_plain(found.column(c)) for c in ("id", "status", "assigned_to", "due_date")))}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        changes = _table([r["rows"] for r in rows], self.changes)
        order = pc.sort_indices(changes, sort_keys=[(c, "ascending") for c in ("ts", "seq", "status")], null_placement="at_start")
        known = self._known(pc.unique(changes.column("task_id")))
        held = self.changed.get()
        changed = pickle.loads(held[0]) if held else {}
        moved: dict = {}
        for low in range(0, len(order), STEP_ROWS):
            part = changes.take(order.slice(low, STEP_ROWS)).combine_chunks()
            yield Row(rows=self._steps(part, known, changed, moved))
        if moved:
            changed.update(moved)
            for i, task in moved.items():
                if task is None and i not in known:
                    del changed[i]  # the state was not filled with it, so there is nothing to hide
            self.changed.update((pickle.dumps(changed),))

    def _steps(self, part: pa.Table, known: dict, changed: dict, moved: dict) -> bytes:
        """The log rows of changes in their order. ``moved`` gets the tasks that change."""
        out = []
        for i, ts, seq, *r in zip(*(_plain(part.column(c)) for c in ("task_id", "ts", "seq", "kind", "status", "requester_id",
                                                                     "requester_role", "assigned_to", "due_date"))):
            task = moved[i] if i in moved else changed[i] if i in changed else known.get(i)
            new, row = self._step(task, _place(ts, seq, r[1]), *r)
            if new is not task:
                moved[i] = new
            out.append(row)
        names = ("outcome", "http_status", "prev_status", "d_in_progress", "d_completed", "d_overdue", *GAINS)
        made = dict(zip(names, zip(*out)))
        columns = [pa.array(made[f.name], f.type) if f.name in made else part.column(f.name).chunk(0) for f in self.log]
        return pa.RecordBatch.from_arrays(columns, schema=self.log).serialize().to_pybytes()

    def _counts(self, task) -> tuple[int, int, int, int]:
        """total, completed, in progress and overdue (by the SQL rule) of a task or of none."""
        if task is None:
            return 0, 0, 0, 0
        status, _, due, _ = task
        late = status is not None and status != "completed" and due is not None and due < self.as_of
        return 1, int(status == "completed"), int(status == "in_progress"), int(late)

    def _outcome(self, task, kind, status, requester, role) -> str:
        if kind != "status":
            return "applied"
        if status not in STATUSES:
            return "invalid_status"
        if task is None:
            return "not_found"
        restricted = role == "member" if self.rule == "reference" else role != "admin"
        return "forbidden" if restricted and task[1] != requester else "applied"

    def _step(self, task, place, kind, status, requester, role, assignee, due) -> tuple:
        """The task after a change, and what the log has of it besides the change itself."""
        outcome = self._outcome(task, kind, status, requester, role)
        new, literal, gains = task, (0, 0, 0), (0, 0, 0, 0)
        if outcome == "applied" and kind == "delete":
            new = None
        elif outcome == "applied" and kind == "put":
            new = (status, assignee, due, task[3] if task else None)
        elif outcome == "applied" and (task[3] is None or task[3] < place):
            new = (status, task[1], task[2], place)
            literal = self._literal(task, status)
        if new is not task:
            gains = tuple(b - a for a, b in zip(self._counts(task), self._counts(new)))
        return new, (outcome, HTTP[outcome], task[0] if task else None, *literal, *gains)

    def _literal(self, task, status) -> tuple[int, int, int]:
        """The browser's arithmetic for one change."""
        old, due = task[0], task[2]
        if old == status:
            return 0, 0, 0
        late = old != "completed" and due is not None and due < self.as_of
        return (int(status == "in_progress") - int(old == "in_progress"), int(status == "completed") - int(old == "completed"),
                -int(late and status == "completed"))

    def close(self) -> None:
        pass
