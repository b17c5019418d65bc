"""Raw images as a table of fixed-size blocks: ``spark.read.format("rawblocks")``.

Rows are (image, fpos, data).  An image is planned as byte ranges, each a
partition that reads its own part in large pieces, so that images of any size
spread over the cluster and their bytes never pass through a shuffle.  The
source opens files for reading only.

Options: ``path`` (one, or several separated by commas), ``blocksize`` (512),
``overlap`` (bytes of the following block that come with each, 0), ``start``
and ``end`` (byte range, the whole image), ``partitionbytes`` (64 MiB),
``magic`` (hex; only blocks that start with it are returned).  A block that
the image cuts short is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "image string, fpos bigint, data binary"
_PIECE = 8 << 20


def open_image(path: str):
    """(file, size) of a local path or of a URI that Arrow's file systems know."""
    import os

    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner), system.get_file_info(inner).size
    path = path.removeprefix("file://").removeprefix("file:")
    f = open(path, "rb")
    return f, f.seek(0, os.SEEK_END)


@dataclass
class Range(InputPartition):
    image: str
    start: int
    end: int

    def __init__(self, image: str, start: int, end: int) -> None:
        self.image, self.start, self.end = image, start, end


class RawBlocks(DataSource):
    """Fixed-size blocks of raw images."""

    @classmethod
    def name(cls) -> str:
        return "rawblocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "RawBlockReader":
        return RawBlockReader(self.options)


class RawBlockReader(DataSourceReader):
    def __init__(self, options) -> None:
        get = {k.lower(): v for k, v in options.items()}.get
        self.paths = [p.strip() for p in get("path", "").split(",") if p.strip()]
        self.block = int(get("blocksize", 512))
        self.overlap = int(get("overlap", 0))
        self.first, self.last = int(get("start", 0)), get("end")
        self.each = int(get("partitionbytes", 64 << 20))
        self.magic = bytes.fromhex(get("magic", ""))
        if not self.paths or self.block <= 0 or self.overlap < 0 or self.each <= 0 or self.first < 0:
            raise ValueError("rawblocks takes a path, and sizes above zero")

    def partitions(self) -> list[Range]:
        step = max(1, self.each // self.block) * self.block
        out = []
        for path in self.paths:
            f, size = open_image(path)
            f.close()
            end = min(size, int(self.last)) if self.last else size
            end = self.first + max(0, end - self.first) // self.block * self.block
            out += [Range(path, at, min(at + step, end)) for at in range(self.first, end, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("image", pa.string()), ("fpos", pa.int64()), ("data", pa.binary())])
        f, _ = open_image(partition.image)
        step = max(1, _PIECE // self.block) * self.block
        with f:
            for at in range(partition.start, partition.end, step):
                f.seek(at)
                n = min(step, partition.end - at)
                piece = f.read(n + self.overlap)
                spots = [i for i in range(0, n, self.block) if piece.startswith(self.magic, i)]
                if spots:
                    data = [piece[i : i + self.block + self.overlap] for i in spots]
                    yield pa.RecordBatch.from_arrays([pa.array([partition.image] * len(spots)), pa.array([at + i for i in spots], pa.int64()), pa.array(data, pa.binary())], schema=schema)


def register(spark) -> None:
    """Make ``format("rawblocks")`` known to a session."""
    spark.dataSource.register(RawBlocks)


def blocks(spark, path: str, blocksize: int = 512, **options):
    """The block table of an image."""
    register(spark)
    reader = spark.read.format("rawblocks").option("path", path).option("blocksize", blocksize)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
