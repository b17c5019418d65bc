"""Repairs of content, as new columns; files themselves are never changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrackline.functions import jpeg


def repaired_jpegs(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, action, start, eoi, repaired of JPEG files that may have lost their beginning, and the columns of ``keep``."""

    @F.pandas_udf("action string, start bigint, eoi bigint, repaired binary")
    def run(content):
        import pandas as pd

        rows = [jpeg.repair_jpeg(c or b"") for c in content]
        return pd.DataFrame(rows, columns=["action", "start", "eoi", "repaired"]).astype({"start": "Int64", "eoi": "Int64"})

    return files.select("path", *keep, run("content").alias("r")).select("path", *keep, "r.*")


def previews(files: DataFrame, columns: int = 64, color: bool = False) -> DataFrame:
    """path and a text preview of the JPEG's blocks, null where there is none."""

    @F.pandas_udf("string")
    def run(content):
        import pandas as pd

        def one(c):
            try:
                return jpeg.preview(c or b"", columns, color)
            except Exception:  # a preview is worth no failure
                return None

        return pd.Series([one(c) for c in content])

    return files.select("path", run("content").alias("preview"))


def scan_health(files: DataFrame) -> DataFrame:
    """path, units and expected: coded units of all scans that decode, and those there should be."""

    @F.pandas_udf("units bigint, expected bigint")
    def run(content):
        import pandas as pd

        rows = []
        for c in content:
            try:
                _, scans = jpeg.decode(c or b"")
                rows.append((sum(a for a, _ in scans), sum(max(b, 0) for _, b in scans)))
            except Exception:
                rows.append((0, 0))
        return pd.DataFrame(rows, columns=["units", "expected"])

    return files.select("path", run("content").alias("s")).select("path", "s.*")


def scans(files: DataFrame, columns: int = 64, color: bool = False) -> DataFrame:
    """path, units, expected and preview: what :func:`scan_health` and :func:`previews` tell, of one decoding."""

    @F.pandas_udf("units bigint, expected bigint, preview string")
    def run(content):
        import pandas as pd

        rows = []
        for c in content:
            units, expected, seen = 0, 0, None
            try:
                d, found = jpeg.decode(c or b"")
                units, expected = sum(a for a, _ in found), sum(max(b, 0) for _, b in found)
                seen = jpeg.shown(d, columns, color)
            except Exception:  # a preview is worth no failure
                pass
            rows.append((units, expected, seen))
        return pd.DataFrame(rows, columns=["units", "expected", "preview"])

    return files.select("path", run("content").alias("s")).select("path", "s.*")


def rename_originals(repaired: DataFrame, suffix: str = ".damaged") -> DataFrame:
    """Plan rows that put a repaired file's original aside."""
    return repaired.filter("action = 'repaired'").select(F.lit("rename").alias("action"), F.col("path").alias("source"), F.concat("path", F.lit(suffix)).alias("target"))
