"""Writers: one file a pack, JSON lines, manifests, attachment files.

Pack and attachment files are written by the executors into a folder that all of them see.  A pack's text is bounded
by its limits.
"""

from __future__ import annotations

import csv
import itertools
import json
import shutil
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.operators.exports import MANIFEST
from postmill.operators.packs import GROUP
from postmill.session import small_batches


def pack_texts(records: DataFrame, packs: DataFrame, headers: DataFrame) -> DataFrame:
    """source_path and text of each pack of ``headers``: its head, then the chunks in order, joined by line breaks."""
    keys = ["_source", "id", "category_path", *GROUP]
    order = F.struct("_source", "category_path", F.col("date_utc").isNull().alias("undated"), "date_utc", "id", "chunk")
    bodies = records.select(*keys, "date_utc", "chunk").join(packs.select(*keys, "pack"), keys).groupBy(*GROUP, "pack").agg(
        F.transform(F.array_sort(F.collect_list(order)), lambda x: x["chunk"]).alias("_chunks"))
    return headers.join(bodies, [*GROUP, "pack"]).select(
        "source_path", F.concat("header", F.array_join("_chunks", "\n")).alias("text"))


def _write_all(rows: Iterable, name: str, content: str) -> None:
    for row in rows:
        target = Path(row[name])
        target.parent.mkdir(parents=True, exist_ok=True)
        data = row[content]
        partial = target.with_name(f".{target.name}.part")  # a retried task replaces what it began
        partial.write_bytes(data if isinstance(data, (bytes, bytearray)) else data.encode("utf-8"))
        partial.replace(target)


def _each_partition(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], None]) -> None:
    """Call ``run`` with the rows of each partition in small batches.

    Rows handed over by ``foreachPartition`` are pickled many at a time, by the size of those before: long texts after short
    ones would come by the thousand.
    """
    small_batches(rows.sparkSession)

    def consume(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run(batches)
        return iter(())

    rows.mapInArrow(consume, "done boolean").collect()


def write_files(rows: DataFrame, name: str, content: str) -> None:
    """One file a row: path in ``name``, text or bytes in ``content``."""
    def save(batches: Iterator[pa.RecordBatch]) -> None:
        for batch in batches:
            _write_all(batch.to_pylist(), name, content)

    _each_partition(rows.select(name, F.col(content).cast("binary").alias(content)), save)


def write_lines(rows: DataFrame, line: str, order: list[Column], path: str) -> int:
    """One file with the lines in ``order``; returns the bytes written.

    Executors write the sorted partitions as parts beside the file; the driver only puts the bytes of the parts
    together.  A retried task replaces its part.
    """
    target = Path(path)
    parts = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    parts.mkdir(parents=True)

    def save(batches: Iterator[pa.RecordBatch]) -> None:
        place = TaskContext.get().partitionId()
        partial = parts / f".{place:08d}.{TaskContext.get().taskAttemptId()}"
        with partial.open("wb") as out:
            for batch in batches:
                for data in batch.column(0):
                    out.write(data.as_buffer())
                    out.write(b"\n")
        partial.replace(parts / f"{place:08d}")

    try:
        _each_partition(rows.orderBy(*order).select(F.col(line).cast("binary")), save)
        whole = target.with_name(f".{target.name}.part")
        with whole.open("wb") as out:
            for part in sorted(p for p in parts.iterdir() if not p.name.startswith(".")):
                with part.open("rb") as data:
                    shutil.copyfileobj(data, out, 1 << 20)
        whole.replace(target)
    finally:
        shutil.rmtree(parts, ignore_errors=True)
    return target.stat().st_size


def write_manifest(rows: list[dict], folder: str) -> tuple[str, str]:
    """manifest.csv and manifest.json of a few rows, columns in the fixed order."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    with (target / "manifest.csv").open("w", newline="", encoding="utf-8") as out:
        writer = csv.DictWriter(out, MANIFEST, extrasaction="ignore")
        writer.writeheader()
        writer.writerows(rows)
    (target / "manifest.json").write_text(json.dumps(rows, indent=2, ensure_ascii=False), encoding="utf-8")
    return str(target / "manifest.csv"), str(target / "manifest.json")


def jsonl_manifest_path(path: str) -> str:
    """<stem>.manifest.json beside the lines."""
    return str(Path(path).with_suffix("").with_suffix(".manifest.json"))


def stored_names(attachments: DataFrame, folder: str, name: str) -> Column:
    """Path of each attachment; a repeated name in a folder gets -1, -2, ... before its extension."""
    n = F.row_number().over(Window.partitionBy(folder, name).orderBy("message_db_id", "idx")) - 1
    stem = F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"^(.*)\.([^.]*)$", 1)).otherwise(F.col(name))
    extension = F.regexp_extract(name, r"^.*\.([^.]+)$", 1)
    numbered = F.concat(stem, F.lit("-"), n.cast("string"), F.when(extension != "", F.concat(F.lit("."), extension)).otherwise(""))
    return F.concat_ws("/", folder, F.when(n == 0, F.col(name)).otherwise(numbered))


def _free_path(folder: str, name: str, data: bytes, taken: set[str]) -> tuple[Path, bool]:
    """The first of name, name-1, ... that no other attachment has, and whether its bytes are there already.

    A file with the same bytes that this run has not given out is what an earlier attempt wrote.
    """
    stem, dot, extension = name.rpartition(".")
    stem, ending = (stem, dot + extension) if stem and extension else (name, "")
    for n in itertools.count():
        path = Path(folder) / (f"{stem}-{n}{ending}" if n else name)
        if str(path) in taken:
            continue
        if not path.exists():
            return path, False
        if path.stat().st_size == len(data) and path.read_bytes() == data:
            return path, True


def store_attachments(parts: DataFrame, folder: str, name: str, keep: list[str]) -> DataFrame:
    """Write the payloads; columns ``keep`` with storage_path, extraction_status and error_message.

    Executors write into a folder that all of them see.  Names in a folder are given in order of message and place;
    one that is taken on disk is numbered.  A part that cannot be written has status ``error`` and its message, one
    without bytes is ``empty``.  A folder belongs to one message, so its parts are few.
    """
    given = parts.select(
        *keep, F.col("message_db_id").alias("message_"), F.col("idx").alias("idx_"), F.col(folder).alias("folder_"),
        F.col(name).alias("name_"), F.col("payload").alias("payload_"))

    def run(frames):
        held, taken = None, set()
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.folder_ != held:
                    held, taken = row.folder_, set()
                data = bytes(row.payload_ or b"")
                found = [None, "empty", None]
                if data:
                    try:
                        path, there = _free_path(held, row.name_, data, taken)
                        taken.add(str(path))
                        if not there:
                            _write_all([{"path": str(path), "data": data}], "path", "data")
                        found = [str(path), "extracted", None]
                    except Exception as error:  # whatever the file system says belongs into the row
                        found = [None, "error", str(error)[:500]]
                out.append(found)
            result = frame[keep].copy()
            result[["storage_path", "extraction_status", "error_message"]] = pd.DataFrame(out, index=frame.index, dtype=object)
            yield result

    kinds = dict(given.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    ready = given.repartition("folder_").sortWithinPartitions("folder_", "message_", "idx_")
    return ready.mapInPandas(run, f"{schema}, storage_path string, extraction_status string, error_message string")
