"""Records of CSV files whose quoted fields may hold line breaks, read by many tasks a file.

Files are read as lines, so Spark cuts them into splits wherever it likes; a line break inside quotes is not a record's end, and whether
a split begins inside quotes depends on everything before it. Each split therefore first says what it does to either state: outside or
inside quotes at its start, which one at its end. These pairs, one per split, are put together file by file in the order of splits;
then every split knows its own start and joins its lines to records. A record that crosses a split's edge leaves a piece on either side, and
the few pieces are put together by file. Lines themselves are never shuffled.

A quote opens a field only where the field begins, doubled quotes inside are text, and a quote elsewhere in an unquoted field is an
ordinary character, as in the parser that cuts the records into fields.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_INSIDE = re.compile(r'(?:[^"]++|"")*+"')
# splits that begin inside quotes and are sent to all tasks; more of them are met by a shuffle of the lines
SENT = 100_000


def state_after(line: str, state: int, delimiter: str) -> int:
    """Whether a line ends inside quotes (1) or not (0), from the same at its start."""
    at = 0
    if not state and line.startswith('"'):
        at = state = 1
    while True:
        if state:
            found = _INSIDE.match(line, at)
            if not found:
                return 1
            at = found.end()
        at = line.find(delimiter + '"', at)
        if at < 0:
            return 0
        at, state = at + len(delimiter) + 1, 1


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Consecutive rows of one split."""
    paths, starts = batch.column("path"), batch.column("start").to_numpy(zero_copy_only=False)
    low = 0
    while low < len(batch):
        key = (paths[low].as_py(), int(starts[low]))
        same = pc.and_(pc.equal(paths, paths[low]), pc.equal(batch.column("start"), batch.column("start")[low]))
        after = pc.index(same.slice(low), pa.scalar(False)).as_py()
        high = len(batch) if after < 0 else low + after
        yield key, batch.slice(low, high - low)
        low = high


def _lines(run: pa.RecordBatch, first: bool) -> tuple[list[str] | None, pa.Array]:
    """The run's lines where any has a quote, else None; a byte order mark before the file's first line is taken off."""
    values = run.column("value")
    if first and len(values) and values[0].as_py().startswith("﻿"):
        values = pa.concat_arrays([pa.array([values[0].as_py()[1:]], values.type), values.slice(1)])
    quoted = pc.sum(pc.match_substring(values, '"')).as_py()
    return (values.to_pylist() if quoted else None), values


def _effects(delimiter: str):
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64())])

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends = None, [0, 1]
        for batch in batches:
            for own, run in _runs(batch):
                if own != key:
                    if key is not None:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, *ends)))], schema)
                    key, ends, new = own, [0, 1], True
                else:
                    new = False
                for line in _lines(run, new and own[1] == 0)[0] or ():
                    if '"' in line:
                        ends = [state_after(line, ends[0], delimiter)] * 2 if ends[0] == ends[1] else [state_after(line, s, delimiter) for s in ends]
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, *ends)))], schema)

    return effects


def _started(frame: pd.DataFrame) -> pd.DataFrame:
    """Splits of one file that begin inside quotes."""
    state, found = 0, []
    for path, start, outside, inside in frame.sort_values("start").itertuples(index=False):
        if state:
            found.append((path, start))
        state = inside if state else outside
    return pd.DataFrame(found, columns=["path", "start"])


RECORD, HEAD, TAIL = 0, 1, 2
_PIECES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("kind", pa.int64()), ("at", pa.int64()), ("record", pa.string())])


def _joined(delimiter: str):
    """Whole records of each split, and the pieces at its edges; the file's first record with text is its header and left out."""

    def row(key: tuple[str, int], kind: int, at: int, text: str) -> tuple:
        # a record is a byte long at least, so the split's offset and the record's number in it give a place in the file
        return (*key, kind, key[1] + at, text)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(_PIECES)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, parts, head, header, count = None, 0, [], False, False, 0
        for batch in batches:
            rows: list[tuple] = []
            for own, run in _runs(batch):
                new = own != key
                if new:
                    if parts:
                        rows.append(row(key, HEAD if head else TAIL, count, "\n".join(parts)))
                    key, parts, count = own, [], 0
                    state = int(run.column("inside")[0].as_py())
                    head, header = bool(state), own[1] == 0
                lines, values = _lines(run, new and own[1] == 0)
                if lines is None and not state and not header:
                    if rows:
                        yield out(rows)
                        rows = []
                    n = len(values)
                    yield pa.RecordBatch.from_arrays(
                        [run.column("path").cast(pa.string()), run.column("start").cast(pa.int64()), pa.array([RECORD] * n, pa.int64()), pa.array(range(own[1] + count, own[1] + count + n), pa.int64()), values.cast(pa.string())], schema=_PIECES
                    )
                    count += n
                    continue
                for line in lines if lines is not None else values.to_pylist():
                    parts.append(line)
                    if '"' in line:
                        state = state_after(line, state, delimiter)
                    if state:
                        continue
                    text = "\n".join(parts)
                    parts = []
                    if head:
                        rows.append(row(key, HEAD, count, text))
                        head = False
                    elif header and text.strip():
                        header = False
                    elif not header:
                        rows.append(row(key, RECORD, count, text))
                    count += 1
            if rows:
                yield out(rows)
        if parts:
            yield out([row(key, HEAD if head else TAIL, count, "\n".join(parts))])

    return records


def read_records(spark: SparkSession, files: list[str], delimiter: str) -> DataFrame:
    """``record``, ``path`` and ``at``: a row per record below each file's header, without the line end; quoted line breaks stay in it.

    ``at`` orders the records of a file and is different for each.
    """
    lines = spark.read.option("lineSep", "\n").text(files).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    )
    # a row per split, kept, since it is read twice and all lines stand behind it
    effects = lines.mapInArrow(_effects(delimiter), "path string, start bigint, outside bigint, inside bigint").persist()
    # only files in which some split can end inside quotes have anything to put together
    odd = effects.where("outside = 1 or inside = 0").select("path").distinct()
    opened = effects.join(odd, "path", "left_semi").groupBy("path").applyInPandas(_started, "path string, start bigint").persist()
    try:
        many = opened.count()
        rows = [tuple(r) for r in opened.collect()] if many <= SENT else None
    finally:
        opened.unpersist()
        effects.unpersist()
    if rows is not None:
        sent = F.broadcast(spark.createDataFrame(rows, "path string, start bigint").withColumn("inside", F.lit(1)))
        placed = lines.join(sent, ["path", "start"], "left")
    else:
        numbered = lines.withColumn("_at", F.monotonically_increasing_id())
        placed = numbered.join(opened.withColumn("inside", F.lit(1)), ["path", "start"], "left").sortWithinPartitions("path", "start", "_at")
    placed = placed.select("value", "path", "start", F.coalesce("inside", F.lit(0)).alias("inside"))
    pieces = placed.mapInArrow(_joined(delimiter), "path string, start bigint, kind bigint, at bigint, record string")
    whole = pieces.where(F.col("kind") == RECORD).select("path", "at", "record")
    along = Window.partitionBy("path").orderBy("start", "kind")
    edge = pieces.where(F.col("kind") != RECORD).withColumn("_of", F.sum((F.col("kind") == TAIL).cast("int")).over(along))
    ordered = F.sort_array(F.collect_list(F.struct("start", "kind", "record")))
    joined = F.array_join(F.transform(ordered, lambda p: p["record"]), "\n").alias("record")
    crossed = edge.groupBy("path", "_of").agg(F.min("at").alias("at"), joined).drop("_of")
    return whole.unionByName(crossed).withColumn("record", F.regexp_replace("record", r"\r$", ""))
