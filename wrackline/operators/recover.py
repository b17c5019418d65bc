"""Bytes of files, from runs by ranged reads of the image; wiping only as a plan."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrackline.functions import codecs
from wrackline.functions.ntfs import CLUSTER

#: Compression exponent of a record to its unit in bytes.
MAX_EXPONENT = 8
#: Contents are handed on once they have so many bytes together.
BATCH_BYTES = 4 << 20


def read_runs(f, runs: list[dict], size: int, cluster: int, part_start: int, unit: int) -> tuple[bytes, str | None]:
    """File bytes and the first thing wrong; runs past ``size`` are not read."""
    parts: list[tuple[bytes | None, int]] = []
    need = size if unit <= 0 else None
    for r in runs:
        n = r["len"] * cluster
        if need is not None:
            if need <= 0:
                break
            take = min(n, need)
            need -= take
        else:
            take = n
        if r["sparse"]:
            parts.append((None, take))
        else:
            f.seek(part_start + r["lcn"] * cluster)
            data = f.read(take)
            parts.append((data.ljust(take, b"\0"), take))
            if len(data) < take:
                whole, _ = codecs.reassemble(parts, size, unit)
                return whole, "run lies outside the image"
    return codecs.reassemble(parts, size, unit)


def restored(files: DataFrame, image: str, cluster: int = CLUSTER, part_start: int = 0) -> DataFrame:
    """path, size, mtime, content, error of files with a run list (path, size, mtime, runs, compression).

    A task opens the image once and reads only its own files' runs; image
    bytes never go through a shuffle.  Compressed files are put together unit
    by unit.
    """
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from wrackline.sources.rawblocks import open_image

        f, _ = open_image(image)
        out, held = [], 0
        with f:
            for b in batches:
                for r in b.to_pylist():
                    unit = cluster << min(r["compression"] or 0, MAX_EXPONENT) if r["compression"] else 0
                    data, wrong = read_runs(f, r["runs"] or [], r["size"] or 0, cluster, part_start, unit)
                    out.append({"path": r["path"], "size": r["size"], "mtime": r["mtime"], "content": data, "error": wrong})
                    held += 100 + len(data)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    compression = F.col("compression") if "compression" in files.columns else F.lit(0)
    rows = files.select("path", "size", "mtime", "runs", compression.alias("compression"))
    return rows.mapInArrow(run, "path string, size bigint, mtime bigint, content binary, error string")


def write_files(recovered: DataFrame, folder: str) -> DataFrame:
    """Write contents below an output folder that all executors share; returns path, written, error.

    Paths never leave the folder.  Writing is repeated whole if a task is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        from pathlib import Path

        top = Path(folder).resolve()
        for b in batches:
            out = []
            for path, mtime, content in zip(*(c.to_pylist() for c in b.columns)):
                parts = [p for p in path.split("/") if p not in ("", ".", "..")]
                try:
                    target = top.joinpath(*parts)
                    target.parent.mkdir(parents=True, exist_ok=True)
                    part = target.with_name(f".{target.name}.{os.getpid()}.part")
                    part.write_bytes(content or b"")
                    if mtime is not None:
                        os.utime(part, (mtime, mtime))
                    part.replace(target)
                    out.append((path, len(content or b""), None))
                except (OSError, ValueError) as e:
                    out.append((path, 0, str(e)))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["path", "written", "error"])

    return recovered.select("path", "mtime", "content").mapInArrow(run, "path string, written bigint, error string")


def wipe_plan(files: DataFrame, cluster: int = CLUSTER, part_start: int = 0) -> DataFrame:
    """action, path, start, length of the bytes a wipe would zero; sparse runs have none.  Never carried out."""
    runs = files.select("path", F.inline("runs")).filter("NOT sparse")
    return runs.select(F.lit("zero").alias("action"), "path", (F.col("lcn") * cluster + part_start).alias("start"), (F.col("len") * cluster).alias("length"))


def totals(recovered: DataFrame) -> DataFrame:
    """files, wanted and copied bytes, and how many files have an error."""
    return recovered.agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes_wanted"), F.sum(F.octet_length("content")).alias("bytes_copied"), F.count_if(F.col("error").isNotNull()).alias("errors")
    )


def tree_totals(recovered: DataFrame, depth: int = 1) -> DataFrame:
    """The totals of each tree: of the folders at ``depth`` below the top, and of ``.`` for files above that."""
    parts = F.filter(F.split("path", "/"), lambda p: (p != "") & (p != "."))
    tree = F.when(F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/")).otherwise(F.lit("."))
    return recovered.groupBy(tree.alias("tree")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes_wanted"), F.sum(F.octet_length("content")).alias("bytes_copied"), F.count_if(F.col("error").isNotNull()).alias("errors")
    )
