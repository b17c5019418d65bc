"""NTFS records as tables: native tests of the header first, the walk over attributes in Arrow batches.

Block bytes are decoded where they are read; only decoded rows leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrackline.functions import ntfs
from wrackline.functions.bytesql import has, le

RUN = "struct<idx:int,vcn:bigint,lcn:bigint,len:bigint,sparse:boolean>"
RECORDS = (
    "image string, fpos bigint, ref bigint, seq int, links int, flags int, used int, total int, name string, namespace int, parent bigint, mtime bigint, size bigint,"
    f" allocated bigint, first_vcn bigint, last_vcn bigint, compression int, runs array<{RUN}>, run_total bigint, run_error string, run_bytes binary, index_at bigint, children array<bigint>, streams int"
)
ENTRIES = "image string, fpos bigint, idx int, ref bigint, parent bigint, mtime bigint, size bigint, flags bigint, namespace int, name string, is_dir boolean"


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def decoded(blocks: DataFrame, decode: Callable[[bytes], list[dict]], ddl: str) -> DataFrame:
    """Rows that ``decode`` makes of each block's bytes, under image and fpos."""
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"image": i, "fpos": p, **r} for i, p, d in zip(*(c.to_pylist() for c in b.columns)) for r in decode(d or b"")]
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], schema=schema)

    return blocks.select("image", "fpos", "data").mapInArrow(run, ddl)


def run_structs(runs: list[tuple[int, int, bool]]) -> list[dict]:
    out, vcn = [], 0
    for i, (lcn, n, sparse) in enumerate(runs):
        out.append({"idx": i, "vcn": vcn, "lcn": lcn, "len": n, "sparse": sparse})
        vcn += n
    return out


# ---- headers, native ------------------------------------------------------------------------


def record_header(data: Column) -> Column:
    """Struct of a file record's header."""
    fields = {"ref": (44, 4), "seq": (16, 2), "links": (18, 2), "first": (20, 2), "flags": (22, 2), "used": (24, 4), "total": (28, 4)}
    return F.struct(*[le(data, at, n).alias(k) for k, (at, n) in fields.items()])


def sane_record(data: Column, strict: bool = True) -> Column:
    """Whether sizes and magic are those of a record."""
    h, size = record_header(data), F.octet_length(data)
    whole = h["total"] == ntfs.RECORD if strict else h["total"] >= ntfs.RECORD
    return has(data, 0, b"FILE") & whole & (h["used"] >= 32) & (h["used"] <= h["total"]) & (h["total"] <= size)


def plausible_record(data: Column) -> Column:
    """The looser test of block scans: attribute offset and size within a block."""
    h = record_header(data)
    return has(data, 0, b"FILE") & (h["first"] < 4096) & h["used"].between(512, 4096) & (h["first"] < h["used"])


def in_use(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(1)) != 0


def is_directory(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(2)) != 0


# ---- records ------------------------------------------------------------------------------------


def file_records(blocks: DataFrame, mode: str = "strict") -> DataFrame:
    """A row for each file record among blocks of 1024 bytes or more.

    ``strict`` wants exact sizes and every sector's update number, ``lenient``
    takes larger records and leaves one with a wrong number as it is.
    """

    def one(data: bytes) -> list[dict]:
        got = ntfs.parse_record(data, mode)
        return [got | {"runs": run_structs(got["runs"])}] if got else []

    return decoded(blocks.filter(sane_record(F.col("data"), mode == "strict")), one, RECORDS)


def resynced(blocks: DataFrame, record: int = ntfs.RECORD) -> DataFrame:
    """Blocks of an extracted record file, read with 512 bytes of overlap, brought back into step.

    Columns besides image and fpos: data, state (``ok``, ``shifted``,
    ``truncated`` or ``garbage``) and number, the record's place in the file.
    A shifted record that another one cuts short gets zeros in place of its
    second sector, but for the last two bytes, which come from the other.
    """
    data = F.col("data")
    moved = F.substring(data, F.lit(513), F.lit(record))
    cut = has(data, 512, b"FILE") & has(data, 1024, b"FILE")
    padded = F.concat(F.substring(moved, 1, 512), F.lit(bytes(510)), F.substring(moved, 511, 2))
    state = F.when(has(data, 0, b"FILE"), "ok").when(cut, "truncated").when(has(data, 512, b"FILE"), "shifted").otherwise("garbage")
    rows = blocks.select("image", "fpos", "data", state.alias("state"))
    taken = F.when(F.col("state") == "ok", F.substring(data, 1, record)).when(F.col("state") == "truncated", padded).when(F.col("state") == "shifted", moved).otherwise(F.substring(data, 1, record))
    return rows.select("image", "fpos", taken.alias("data"), "state", F.call_function("div", F.col("fpos"), F.lit(record)).alias("number"))


def index_rows(blocks: DataFrame, mode: str = "strict") -> DataFrame:
    """A row for each named entry of the index blocks; ``off`` does without the update sequence."""
    return decoded(blocks.filter(has(F.col("data"), 0, b"INDX")), lambda d: ntfs.index_entries(d, mode), ENTRIES)


def scan_image(spark, path: str, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Records and index entries of an image: two scans that return only blocks of either magic."""
    from wrackline.sources.rawblocks import blocks

    records = blocks(spark, path, ntfs.RECORD, magic=b"FILE".hex())
    index = blocks(spark, path, ntfs.INDEX_BLOCK, magic=b"INDX".hex())
    return file_records(records, mode), index_rows(index, mode)


# ---- run lists -------------------------------------------------------------------------------------

RUN_RESULT = f"struct<runs:array<{RUN}>,total:bigint,error:string,error_at:int,status:string,repaired:boolean>"


def decode_run_lists(rows: DataFrame, column: str, unit: Column | int = 0, total: Column | None = None, repair: bool = False, out: str = "decoded") -> DataFrame:
    """``rows`` with a struct of the decoded run list.

    ``unit`` is the compression unit in clusters and ``total`` the clusters
    that the list should have.  With ``repair`` a list that one change makes
    sound is changed; ``status`` is GOOD, BadSIZE, FIXED or CantFIX.
    """
    unit = F.lit(unit) if isinstance(unit, int) else unit
    total = F.lit(None).cast("bigint") if total is None else total

    # Built column by column; a dictionary for each run costs several times the decoding.
    whole = _arrow(f"r {RUN_RESULT}").field(0).type

    @F.arrow_udf(RUN_RESULT)
    def decode(data, units, totals):
        ends, runs, rest = [0], [[] for _ in range(5)], [[] for _ in range(5)]
        idx, vcn, lcn, size, sparse = runs
        for d, n, want in zip(*(c.to_pylist() for c in (data, units, totals))):
            d, n = d or b"", int(n or 0)
            if repair and want is not None:
                got, status = ntfs.sanitised_runs(d, n, want)
            else:
                got = ntfs.decode_runs(d, n)
                status = "CantFIX" if got.error else "GOOD" if want is None or got.total == want else "BadSIZE"
            at = 0
            for i, (where, length, hole) in enumerate(got.runs):
                idx.append(i)
                vcn.append(at)
                lcn.append(where)
                size.append(length)
                sparse.append(hole)
                at += length
            ends.append(len(idx))
            for column, value in zip(rest, (got.total, got.error, got.error_at, status, got.repaired)):
                column.append(value)
        fields = list(whole.field("runs").type.value_type)
        flat = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(runs, fields)], fields=fields)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=whole.field("runs").type)
        return pa.StructArray.from_arrays([lists, *[pa.array(v, f.type) for v, f in zip(rest, list(whole)[1:])]], fields=list(whole))

    return rows.withColumn(out, decode(F.col(column), unit.cast("int"), total.cast("bigint")))


def runs_table(records: DataFrame) -> DataFrame:
    """ref, idx, vcn, lcn, len, sparse: one row per run."""
    return records.select("ref", F.inline("runs"))


def fragmented(records: DataFrame) -> DataFrame:
    """Records with data, and whether their first run is shorter than all of it."""
    has_runs = F.size("runs") > 0
    return records.filter(has_runs & F.col("last_vcn").isNotNull()).withColumn("fragmented", F.col("runs")[0]["len"] != F.col("last_vcn") - F.col("first_vcn") + 1)


def geometry(records: DataFrame) -> DataFrame:
    """Cluster size and partition start, from records of the master table itself.

    ``fpos`` of such a record and the first cluster of its data fix both.
    """
    master = records.filter((F.col("name") == "$MFT") & (F.col("first_vcn") == 0) & (F.col("last_vcn") > 100) & (F.size("runs") > 0))
    cluster = F.call_function("div", F.col("allocated"), F.col("last_vcn") + 1)
    return master.select("image", "fpos", cluster.alias("cluster"), (F.col("fpos") - F.col("runs")[0]["lcn"] * cluster).alias("part_start"), F.col("last_vcn").alias("last_vcn"))


def dd_commands(records: DataFrame, cluster: int = ntfs.CLUSTER, part_start: int = 0) -> DataFrame:
    """image, fpos, idx, command: how to copy each run of the master table out of the image."""
    runs = records.filter(F.col("name") == "$MFT").select("image", "fpos", F.inline("runs")).filter("NOT sparse")
    skip = F.col("lcn") + F.lit(part_start // cluster)
    return runs.select("image", "fpos", "idx", F.concat(F.lit("dd if="), "image", F.lit(f" bs={cluster} skip="), skip.cast("string"), F.lit(" count="), F.col("len").cast("string")).alias("command"))
