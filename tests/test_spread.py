"""Work that a small table stands for is dealt out, and done once for each row."""

from __future__ import annotations

import pyarrow as pa
import pytest

from wrackline.functions import ansi, codecs, jpeg, ole, pdf
from wrackline.functions.memo import Memo
from wrackline.operators import validate
from wrackline.plans import content, damage


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory) -> str:
    """5,000 customers in one small file."""
    folder = str(tmp_path_factory.mktemp("customers"))
    spark.range(1, 5001).selectExpr("id AS c_custkey", "concat('c', id) AS c_name").coalesce(1).write.parquet(f"{folder}/customer.parquet")
    return folder


def plan(found) -> str:
    return found._jdf.queryExecution().optimizedPlan().toString()


def test_files_of_a_small_table_go_to_several_tasks(spark, customers):
    files = damage._files(spark, customers, lambda i, k: b"%d %d" % (i, k), 7)
    assert files.rdd.getNumPartitions() >= 4
    assert {(int(r.path), bytes(r.content)) for r in files.collect()} == {(i, b"%d %d" % (i, i % 7)) for i in range(1, 5001)}


def test_scans_and_previews_are_of_one_decoding(spark, customers):
    assert "Join" not in plan(damage.jpeg_scan_units(spark, customers))


def test_codes_of_more_than_eight_bits():
    counts = bytes([0] * 6 + [1, 1, 1, 1, 0, 0, 0, 0, 0, 2])
    code = jpeg.Huffman(counts, bytes([3, 0, 5, 2, 9, 20]))
    for value, (bits, length) in code.codes.items():
        for extra in (0, 1):
            data = (bits << (40 - length) | extra << (39 - length)).to_bytes(5, "big")
            one, two = jpeg.Bits(data), jpeg.Bits(data)
            assert code.read(one) == value and one.at == length
            if value <= 16:
                two.at = 0
                assert jpeg.Bits(data).signed(0) == 0 and two.difference(code) == one.signed(value) and two.at == one.at


def test_memo_is_bounded_and_goes_without_what_it_keeps():
    from pyspark import cloudpickle

    asked = []
    m = Memo(lambda a, b: asked.append((a, b)) or (a, b), 2)
    assert [m(1, 2), m(1, 2), m(3, 4), m(5, 6), m(1, 2)] == [(1, 2), (1, 2), (3, 4), (5, 6), (1, 2)]
    assert asked == [(1, 2), (3, 4), (5, 6), (1, 2)] and len(m.kept) <= 2
    assert not cloudpickle.loads(cloudpickle.dumps(m)).kept


def test_files_of_equal_bytes_are_made_once():
    made = []
    turn = damage._cycle(10)(lambda i, k: made.append((i, k)) or b"%d %d" % (i, k))
    assert [turn(3, 1), turn(13, 1), turn(3, 2)] == [b"3 1", b"3 1", b"3 2"] and made == [(3, 1), (3, 2)]


def test_repeated_blocks_of_a_progressive_image():
    blocks = [[y * 40 - 300, 5, -3, 0, 2, *[0] * 11] for y in range(24)]
    whole = jpeg.make_progressive(48, 32, blocks)
    d, scans = jpeg.decode(whole)
    assert scans == [(24, 24)] * 4 and len(set(d.set_ac.values())) == 1 and d.dc[1][0, 1] == -260


def test_cells_of_equal_levels_are_mixed_once(monkeypatch):
    asked = []
    whole = ansi.cell
    monkeypatch.setattr(ansi, "cell", lambda rgb: asked.append(rgb) or whole(rgb))
    jpeg._cell.kept.clear()
    seen = jpeg.preview(jpeg.make_jpeg(96, 64, [-200, 300] * 48), color=True)
    assert seen.count("m\x1b[") == 96 and len(asked) == 2


class Held:
    """In place of a table: keeps what is to run over its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, ddl):  # noqa: N802
        self.run = run
        return self


def test_inner_rows_of_many_files_come_in_one_batch():
    found = Held()
    validate.inner(found, "ole_streams")
    files = [ole.make_compound({"Workbook": bytes([i]) * 5000}) for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(20)]), pa.array(files, pa.binary())], names=["path", "content"])
    out = list(found.run(iter([batch])))
    assert len(out) == 1 and out[0].column("content").to_pylist() == [bytes([i]) * 5000 for i in range(20)]


def test_empty_records_of_a_workbook_are_passed_at_once(monkeypatch):
    looks = []
    monkeypatch.setattr(ole, "u", lambda d, at, n: looks.append(at) or int.from_bytes(d[at : at + n], "little"))
    sheet = b"\x85\0\x0b\0" + bytes([9, 0, 0, 0, 0, 2, 3, 0]) + b"abc"
    for zeros in (0, 3, 4, 5, 400, 4000):
        found, _ = ole.workbook_sheets(bytes(zeros // 4 * 4) + sheet + bytes(zeros) + sheet[: 4 if zeros % 4 else 99])
        assert [r["name"] for r in found] == ["abc"] * (1 if zeros % 4 else 2)
    assert len(looks) < 100


def test_noise_is_made_once_for_each_of_its_ids():
    assert content._noise(5, 3000) is content._noise(5 + content.NOISE, 3000)
    assert content._noise(261, 40) == bytes((261 * 7919 + j * j * 31 + (j >> 3) * 261) & 255 for j in range(40))


def test_plain_pdf_tokens_are_read_at_once(monkeypatch):
    skips = []
    whole = pdf.Tokens._skip
    monkeypatch.setattr(pdf.Tokens, "_skip", lambda self: skips.append(self.at) or whole(self))
    data = b" 12 -3 +4 1.5 /Name/Next obj%c\n(a)<41>5"
    reader, seen = pdf.Tokens(data, 0, len(data)), []
    while (t := reader.next()) is not None:
        seen.append(t)
    assert seen == [12, -3, 4, b"1.5", b"/Name", b"/Next", b"obj", b"a", b"A", 5]
    assert [type(t) for t in seen[-3:]] == [pdf.Text, pdf.Text, int] and len(skips) == 3


def test_png_files_of_equal_noise_are_made_once():
    assert damage._png(7, 4) is damage._png(7 + 5 * content.NOISE, 4) and damage._png(7, 4) != damage._png(7, 0)


def test_png_chunks_of_a_small_table_go_to_several_tasks(spark, customers):
    assert damage.png_chunks(spark, customers).rdd.getNumPartitions() >= 4


def test_pdf_files_of_customers_go_to_several_tasks(spark, customers):
    assert damage.QUERIES["pdf_damage"](spark, customers).rdd.getNumPartitions() >= 4


def test_tables_of_a_compound_file_are_read_at_once(monkeypatch):
    looks = []
    monkeypatch.setattr(ole, "u", lambda d, at, n: looks.append(at) or int.from_bytes(d[at : at + n], "little"))
    data = ole.make_compound({"Workbook": b"x" * 70_000, "Other": b"y" * 5_000})
    assert validate.check_ole(data) == (0, "xls") and len(looks) < 50
    with pytest.raises(ole.OleError):
        ole.CompoundFile(data[:600])


def test_thumbnail_repair_makes_each_file_once(spark, customers):
    shown = plan(damage.jpeg_thumbnail_repair(spark, customers))
    assert "Join" not in shown and shown.count("MapInArrow") == 1


def test_document_times_are_asked_once(spark, customers):
    shown = damage.document_time_plan(spark, customers)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in shown and shown.count("ArrowEvalPython") == 1


def test_gif_codes_that_grow_past_twelve_bits():
    pixels = bytes((j * j * 31 + (j >> 5)) & 255 for j in range(9_000))
    packed = codecs.gif_lzw_encode(pixels, 8)
    assert codecs.gif_lzw_decode(packed, 8) == pixels and codecs.gif_lzw_decode(packed[:-700], 8) == pixels[: len(codecs.gif_lzw_decode(packed[:-700], 8))]
    assert damage._gif(3, 0) is damage._gif(3 + content.NOISE, 0)


def test_gif_files_of_customers_go_to_several_tasks(spark, customers):
    assert damage.QUERIES["gif_damage"](spark, customers).rdd.getNumPartitions() >= 4


def test_folder_counts_make_files_in_several_tasks(spark, customers):
    shown = plan(damage.folder_counts(spark, customers))
    assert "Repartition" in shown and {(r.folder, r.files, r.ok) for r in damage.folder_counts(spark, customers).collect()} == {("even", 2500, 833), ("odd", 2500, 0)}


def test_text_batches_are_bounded_in_bytes():
    from wrackline.plans import common

    texts = [b"some words %d " % i * 30_000 for i in range(40)]
    found = TextTable()
    common.turned(found, lambda i, d: (d,), "d binary")
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    out = list(found.run(iter([batch])))
    assert [v for b in out for v in b.column("d").to_pylist()] == texts
    assert len(out) >= 4 and max(b.nbytes for b in out) < 6 << 20


def test_lznt1_is_packed_as_by_single_steps():
    def slow(part: bytes) -> bytes:
        packed, at = bytearray(), 0
        while at < len(part):
            mark = len(packed)
            packed.append(0)
            for bit in range(8):
                if at >= len(part):
                    break
                width = max(4, (at - 1).bit_length()) if at else 4
                spot, n = part.rfind(part[at : at + 3], 0, at + 2) if at + 3 <= len(part) else -1, 0
                while spot >= 0 and n < (0xFFFF >> width) + 3 and at + n < len(part) and part[spot + n] == part[at + n]:
                    n += 1
                if n >= 3:
                    packed[mark] |= 1 << bit
                    packed += ((at - spot - 1) << (16 - width) | (n - 3)).to_bytes(2, "little")
                else:
                    packed.append(part[at])
                at += max(1, n if n >= 3 else 1)
        body = bytes(packed) if len(packed) < len(part) else part
        return ((len(body) - 1) | (0xB000 if len(packed) < len(part) else 0x3000)).to_bytes(2, "little") + body

    noise = content._noise(3, 5000)
    for data in (b"", b"a", b"aaa", b"abcabcabc", b"a" * 9000, b"ab" * 3000 + b"c", noise, noise[:100] * 60, b"the same line again and again\n" * 300, b"x" * (1 << 18) + b"y" * 5000):
        assert codecs.lznt1_compress(data) == b"".join(slow(data[i : i + 4096]) for i in range(0, len(data), 4096))
        assert codecs.lznt1_decompress(codecs.lznt1_compress(data)) == data


class TextTable:
    """In place of the table of documents, see ``Held``."""

    def __init__(self) -> None:
        self.sparkSession = self.sparkContext = self.conf = self.rdd = self
        self.defaultParallelism = 1

    def get(self, *key):
        return "1"

    def getNumPartitions(self):  # noqa: N802
        return 1

    def select(self, *columns):
        return self

    def mapInArrow(self, run, ddl):  # noqa: N802
        self.run = run
        return self


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory) -> str:
    """Documents in one small file."""
    folder = str(tmp_path_factory.mktemp("documents"))
    spark.range(1, 61).selectExpr("id AS doc_id", "repeat(concat('text ', id, ' '), 40) AS text", "'en' AS lang").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_units_of_a_small_table_are_walked_by_several_tasks(spark, documents):
    found = damage.unit_walk(spark, documents)
    assert found.rdd.getNumPartitions() >= 8 and found.filter("zeros AND used_of_broken = -1").count() == 60


def test_units_of_a_small_table_are_put_together_by_several_tasks(spark, documents):
    found = damage.unit_reassembly(spark, documents)
    assert found.rdd.getNumPartitions() >= 8 and {r.error for r in found.collect()} == {None, "not enough data", "missing pad"}


def test_lzw_codes_of_all_widths():
    data = bytes((j * j * 31 + (j >> 5)) & 255 for j in range(9_000)) + b"ab" * 4_000
    packed = codecs.lzw_encode(data)
    assert codecs.lzw_decode(packed) == data and codecs.lzw_decode(codecs.lzw_encode(b"")) == b""
    with pytest.raises(codecs.CodecError):
        codecs.lzw_decode(packed + bytes(4))
    with pytest.raises(codecs.CodecError):
        codecs.lzw_decode(packed[:-3])


def test_lzw_texts_of_a_small_table_go_to_several_tasks(spark, documents):
    from wrackline.plans import content as queries

    assert queries.QUERIES["lzw_msb_roundtrip"](spark, documents).rdd.getNumPartitions() >= 8


def test_contents_are_restored_in_batches(tmp_path):
    from wrackline.operators import recover

    image = tmp_path / "image"
    image.write_bytes(b"".join(bytes([65 + i]) * 4096 for i in range(20)))
    found = TextTable()
    found.columns = ["path"]
    recover.restored(found, str(image))
    run = [{"lcn": i, "len": 1, "sparse": False} for i in range(20)]
    batch = pa.RecordBatch.from_pylist([{"path": str(i), "size": 4000, "mtime": 1, "runs": [run[i]], "compression": 0} for i in range(20)])
    out = list(found.run(iter([batch])))
    assert len(out) == 1 and out[0].column("content").to_pylist() == [bytes([65 + i]) * 4000 for i in range(20)]


def test_image_rows_are_written_one_by_one(spark, tmp_path):
    from wrackline.plans import disk

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(6).selectExpr("id", "cast(repeat('x', 10) AS binary) AS b")
    disk._written(rows, str(tmp_path / "image"), 60, lambda r: [(10 * r["id"], r["b"])])
    assert (tmp_path / "image").read_bytes() == b"x" * 60
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_tree_totals_of_documents_of_one_file(spark, documents):
    from wrackline.plans import disk

    (row,) = disk.disk_tree_totals(spark, documents).collect()
    assert (row.tree, row.errors) == ("en", 0) and row.bytes_wanted == row.bytes_copied


def test_few_files_are_dealt_out(spark, documents):
    from wrackline.plans import common

    few = spark.read.parquet(f"{documents}/documents.parquet")
    assert few.rdd.getNumPartitions() == 1 and common.dealt(few).rdd.getNumPartitions() >= 8
    many = few.repartition(40)
    assert common.dealt(many) is many


def test_run_lists_of_sorted_lines(spark, tmp_path):
    from wrackline.plans import catalogue

    lines = spark.range(20_000).selectExpr("id % 3 * 7 AS l_orderkey", "cast(id AS int) AS l_linenumber", "id % 2 AS l_partkey", "id AS l_suppkey", "1.0D AS l_extendedprice", "2.0D AS l_quantity")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = catalogue.runlist_roundtrip(spark, str(tmp_path))
    assert "collect_list" not in plan(found)
    assert found.groupBy("ref").count().orderBy("ref").collect() == [(0, 6667), (7, 6667), (14, 6666)]
    assert found.filter("ref = 7 AND idx = 3").select("vcn", "lcn", "len", "sparse").collect() == [(6, 10, 2, False)]
