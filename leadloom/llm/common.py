"""What the operators of this subpackage share: table access, shared folders, state of a worker process, labelled folds."""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from leadloom.session import ensure_checkpoint_dir


BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table below ``spark.checkpoint.dir``: lineage ends, columns are read one by one and the size is known."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *labels: str) -> list[str]:
    """A column name for each label that ``df`` does not have."""
    taken, found = {c.lower() for c in df.columns}, []
    for label in labels:
        name = f"__{label}"
        while name in taken:
            name = f"_{name}"
        found.append(name)
    return found


def worker_state(key, build):
    """A value built once in a Python worker process and kept there for its later tasks.

    Functions of this package travel by value, so their module globals live for one task only. A process
    keeps one value, the last; ``key`` must name everything the value depends on.
    """
    holder = sys.modules.setdefault("_worker_state_of_tasks", types.ModuleType("_worker_state_of_tasks")).__dict__
    kept = holder.setdefault("kept", {})
    if key not in kept:
        kept.clear()
        kept[key] = build()
    return kept[key]


def small_batches(spark: SparkSession) -> None:
    """Rows with whole texts travel to Python at most a thousand at a time; a session that asks for less keeps it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def with_columns(df: DataFrame, added: list[tuple[str, T.DataType]]) -> T.StructType:
    """The schema of ``df`` plus columns; a column of the same name is replaced, as ``withColumn`` does."""
    names = {name.lower() for name, _ in added}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    return T.StructType(kept + [T.StructField(name, kind, True) for name, kind in added])


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])


def replace_columns(batch: pa.RecordBatch, added: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    names = {name.lower() for name, _ in added}
    kept = [i for i, name in enumerate(batch.schema.names) if name.lower() not in names]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [values for _, values in added],
                                      names=[batch.schema.names[i] for i in kept] + [name for name, _ in added])


def map_text(df: DataFrame, text: str, added: list[tuple[str, T.DataType]], per_batch, rows: int = 256) -> DataFrame:
    """Add columns computed from a text column in Arrow batches, all other columns passing through.

    ``per_batch`` gets a list of texts (NULL as None), at most ``rows`` at a time, and returns one
    Arrow array or list for each added column.
    """
    small_batches(df.sparkSession)
    schema = with_columns(df, added)
    kinds = [(name, to_arrow_type(kind)) for name, kind in added]

    def run(batches):
        for batch in batches:
            at = next(i for i, name in enumerate(batch.schema.names) if name.lower() == text.lower())
            for start in range(0, batch.num_rows, rows):
                piece = batch.slice(start, rows)
                found = per_batch(piece.column(at).to_pylist())
                yield replace_columns(piece, [(name, v if isinstance(v, pa.Array) else pa.array(v, kind))
                                              for (name, kind), v in zip(kinds, found)])
        pa.default_memory_pool().release_unused()  # the process waits for other tasks now

    return df.mapInArrow(run, schema)


def whole_groups(batches, keys: list[str]):
    """Record batches of whole groups with the groups' borders, from batches that are sorted by the keys (whole numbers)."""
    held, waiting = None, []

    def borders(rows):
        new = np.zeros(rows.num_rows - 1, bool)
        for name in keys:
            values = rows.column(name).to_numpy(zero_copy_only=False)
            new |= values[1:] != values[:-1]
        return np.concatenate([[0], 1 + np.flatnonzero(new), [rows.num_rows]])

    def together(parts):
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        edges = borders(batch)
        same = held is not None and all(held.column(name)[0] == batch.column(name)[0] for name in keys)
        if waiting and not (same and len(edges) == 2):
            if not same:
                rows = together(waiting)
                yield rows, np.array([0, rows.num_rows])
                waiting = []
            else:  # the open group ends in this batch
                rows = together([*waiting, batch.slice(0, edges[1])])
                yield rows, np.array([0, rows.num_rows])
                batch, edges, waiting = batch.slice(edges[1]), edges[1:] - edges[1], []
        if len(edges) > 2:
            yield batch.slice(0, edges[-2]), edges[:-1]
            batch = batch.slice(edges[-2])
        waiting.append(batch)
        held = batch
    if waiting:
        rows = together(waiting)
        yield rows, np.array([0, rows.num_rows])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; a NULL id counts as fold 0 (held out)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5, F.lit(0))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0
