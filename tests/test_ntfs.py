"""Records, index blocks, run lists and the catalogue of a synthetic image."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from synth import T0, image

from wrackline.functions import ntfs
from wrackline.operators import catalogue, match, recover
from wrackline.operators import ntfs as table
from wrackline.sources.rawblocks import blocks

GOLDEN_BAD, GOLDEN = (bytes.fromhex(x) for x in ("2129330a01070600 29010b00".replace(" ", ""), "2129330a0107110529010b00"))


def test_golden_repair():
    want = [(2611, 41, False), (0, 7, True), (2652, 5, False), (0, 11, True)]
    assert ntfs.decode_runs(GOLDEN, 16).runs == want
    bad = ntfs.decode_runs(GOLDEN_BAD, 16)
    assert (bad.error, bad.error_at) == ("bad ssize", 6)
    got = ntfs.repair_runs(GOLDEN_BAD, 16, 64)
    assert got.repaired and got.runs == want and got.total == 64
    assert ntfs.sanitised_runs(GOLDEN[:-1] + b"\xff\xff\xff\xff", 16, 64)[1] == "GOOD"
    assert ntfs.sanitised_runs(GOLDEN, 16, 65)[1] == "BadSIZE"
    assert ntfs.sanitised_runs(GOLDEN_BAD, 16, 64)[1] == "FIXED"
    assert ntfs.sanitised_runs(b"\x06" * 9, 16, 64)[1] == "CantFIX"


@pytest.mark.parametrize(
    "raw,unit,error",
    [("15", 0, "bad ssize"), ("9101", 0, "bad csize"), ("2105", 0, "overflow"), ("110005", 0, "wrong size"), ("11800500", 0, "wrong size"), ("110705110907", 16, "pad nonzero"), ("0105", 16, "pad zero"), ("1107050108", 16, "pad mismatch"), ("11100500", 16, None)],
)
def test_run_errors(raw, unit, error):
    assert ntfs.decode_runs(bytes.fromhex(raw), unit).error == error


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(1, 1 << 40)), st.integers(1, 1 << 30)), max_size=12))
def test_runs_round_trip(runs):
    got, before = ntfs.decode_runs(ntfs.encode_runs(runs)), None
    want = []
    for lcn, n in runs:
        same = lcn is not None and lcn == before
        want.append((0, n, True) if lcn is None or same else (lcn, n, False))
        before = lcn if lcn is not None else before
    assert got.error is None and got.runs == want


def test_record_variants():
    good = ntfs.make_record(9, [ntfs.resident(ntfs.NAME, ntfs.name_key(5, T0, 10, "n\ud800me"))])
    assert ntfs.parse_record(good)["name"] == "nme"
    damaged = bytearray(good)
    damaged[1022] ^= 1
    assert ntfs.parse_record(bytes(damaged)) is None and ntfs.parse_record(bytes(damaged), "lenient")["ref"] == 9
    damaged[510] ^= 1
    assert ntfs.parse_record(bytes(damaged), "lenient")["ref"] == 9
    for n in range(0, 1024, 7):
        ntfs.parse_record(good[:n] + b"\xff" * (1024 - n)), ntfs.parse_record(good[:n]), ntfs.index_entries(b"INDX" + good[4:n], "off")
    listed = b"".join(ntfs.DATA.to_bytes(4, "little") + (32).to_bytes(2, "little") + b"\0\0" + bytes(8) + r.to_bytes(8, "little") + bytes(8) for r in (7, 8)) + bytes(32)
    assert ntfs.children(listed) == [7, 8]


@pytest.fixture(scope="module")
def disk(tmp_path_factory):
    data, want = image()
    path = tmp_path_factory.mktemp("disk") / "raw.img"
    path.write_bytes(data + b"tail")
    return str(path), want


def test_block_source(spark, disk):
    path, _ = disk
    data = open(path, "rb").read()
    rows = blocks(spark, path, 4096, partitionbytes=65536).collect()
    assert sorted(r.fpos for r in rows) == list(range(0, 1 << 20, 4096)) and all(bytes(r.data) == data[r.fpos : r.fpos + 4096] for r in rows)
    over = blocks(spark, path, 512, overlap=512, start=1024, end=4096).orderBy("fpos").collect()
    assert [len(r.data) for r in over] == [1024] * 6 and over[0].fpos == 1024
    assert blocks(spark, path, 1024, magic="46494C45").count() == 11
    with pytest.raises(Exception):
        blocks(spark, "", 512).count()


def test_catalogue_of_image(spark, disk):
    path, want = disk
    records, index = table.scan_image(spark, path)
    records, index = records.cache(), index.cache()
    got = {r.ref: r for r in records.collect()}
    assert set(got) == {5, 40, 41, 42, 43, 44, 45, 46, 60, 61}
    assert got[40].name == "Documents" and got[41].size == len(want["plain"]) and got[41].mtime == T0 + 5
    assert table.file_records(blocks(spark, path, 1024, magic="46494C45"), "lenient").count() == 11
    assert index.count() == 5 and table.index_rows(blocks(spark, path, 4096), "off").count() == 5

    entries = catalogue.entries(records, index)
    assert sorted((r.origin, r.name) for r in entries.collect()) == sorted([("MFT", n) for n in ("plain.bin", "packed.txt", "orphan.doc", "small.txt", "sparse.bin")] + [("INDX", n) for n in ("plain.bin", "orphan.doc", "inüside.PPS")])
    dirs = catalogue.directories(records, index)
    assert {r.ref: (r.name, r.origin) for r in dirs.collect()} == {5: (".", "MFT"), 40: ("Documents", "MFT"), 60: ("loop-a", "MFT"), 61: ("loop-b", "MFT"), 70: ("LOSTDI~1", "INDX")}
    paths = catalogue.paths(dirs, 16)
    found = {r.ref: (r.path, r.orphan) for r in paths.collect()}
    assert found[5] == (".", False) and found[40] == ("./Documents", False) and found[70] == ("./Documents/LOSTDI~1", False)
    assert found[60][1] and found[61][1] and found[60][0].startswith("dir__")
    named = catalogue.with_paths(entries, paths).cache()
    assert {r.path for r in named.filter("origin='MFT'").collect()} >= {"./Documents/plain.bin", "dir__77/orphan.doc"}
    assert {r.ref: list(r.children) for r in catalogue.child_lists(records).collect()} == {5: [40], 40: [41, 42, 44, 45, 46], 60: [61], 61: [60]}
    assert {r.size: r.n for r in catalogue.by_size(entries).collect()}[2000] == 2
    assert catalogue.listing(entries).filter("size < 1024").count() == 0
    assert [(r.ref, r.known_name, r.index_name) for r in catalogue.directory_conflicts(records, index).collect()] == [(70, "LOSTDI~1", "Lost directory")]

    files = catalogue.with_paths(catalogue.recoverable(records), paths)
    assert {r.name for r in files.collect()} == {"plain.bin", "orphan.doc", "sparse.bin"}
    out = {r.path: r for r in recover.restored(files, path).collect()}
    assert bytes(out["./Documents/plain.bin"].content) == want["plain"] and bytes(out["./Documents/sparse.bin"].content) == want["sparse"]
    assert all(r.error is None for r in out.values())
    packed = recover.restored(records.filter("ref = 42").select(records.name.alias("path"), "size", "mtime", "runs", "compression"), path).first()
    assert bytes(packed.content) == want["packed"] and packed.error is None
    assert recover.wipe_plan(files).filter("path like '%sparse%'").count() == 2
    assert recover.totals(recover.restored(files, path)).first().files == 3
    before = open(path, "rb").read()
    target = disk[0] + ".out"
    assert recover.write_files(recover.restored(files, path), target).filter("error is not null").count() == 0
    assert open(target + "/Documents/plain.bin", "rb").read() == want["plain"] and open(path, "rb").read() == before
    assert catalogue.with_extensions(records).count() == records.count()
    assert table.fragmented(records).filter("fragmented").count() >= 2
    assert table.runs_table(records.filter("ref=46")).count() == 3


def test_geometry_and_dd(spark):
    master = ntfs.make_record(0, [ntfs.resident(ntfs.NAME, ntfs.name_key(5, T0, 0, "$MFT")), ntfs.nonresident(ntfs.DATA, [(4, 120), (300, 80)], 200 * 4096)])
    rows = spark.createDataFrame([("i", 63 * 512 + 4 * 4096, bytearray(master))], "image string, fpos bigint, data binary")
    records = table.file_records(rows)
    assert [tuple(r) for r in table.geometry(records).select("cluster", "part_start").collect()] == [(4096, 63 * 512)]
    assert [r.command for r in table.dd_commands(records).orderBy("idx").collect()] == ["dd if=i bs=4096 skip=4 count=120", "dd if=i bs=4096 skip=300 count=80"]
    heads = rows.select(table.record_header(rows.data).alias("h"), table.plausible_record(rows.data).alias("p")).first()
    assert heads.h.ref == 0 and not heads.p


def test_numbers_from_any_bytes(spark):
    from wrackline.functions.bytesql import be, le, le_signed

    rows = [(bytearray(x),) for x in (b"\xd8\0\0\0", b"\xff\x80\x34\xc3", b"\xe2\x82\xac\x7f", b"\0\0\0\x80", b"\xf0\x9f\x98\x80")]
    got = spark.createDataFrame(rows, "d binary").select("d", le(F.col("d"), 0, 4).alias("u"), le_signed(F.col("d"), 0, 4).alias("s"), be(F.col("d"), 0, 4).alias("b")).collect()
    for r in got:
        d = bytes(r.d)
        assert (r.u, r.s, r.b) == (int.from_bytes(d, "little"), int.from_bytes(d, "little", signed=True), int.from_bytes(d, "big"))


def test_resync(spark, tmp_path):
    r = [ntfs.make_record(i, [ntfs.resident(ntfs.NAME, ntfs.name_key(5, T0, 0, f"f{i}"))]) for i in range(3)]
    data = r[0] + bytes(512) + r[1][:512] + r[2] + bytes(512)
    (tmp_path / "MFT").write_bytes(data + bytes(512))
    got = table.resynced(blocks(spark, str(tmp_path / "MFT"), 1024, overlap=512)).orderBy("fpos").collect()
    assert [(g.state, g.number) for g in got] == [("ok", 0), ("truncated", 1), ("ok", 2), ("garbage", 3)]
    assert len(got[1].data) == 1024 and bytes(got[1].data[:512]) == r[1][:512]


def test_run_list_udf(spark):
    rows = spark.createDataFrame([(bytearray(GOLDEN_BAD), 64), (bytearray(GOLDEN), 64), (bytearray(GOLDEN), 1), (None, 3), (bytearray(b"\x06"), None)], "raw binary, total bigint")
    got = table.decode_run_lists(rows, "raw", 16, rows.total, repair=True).collect()
    assert [g.decoded.status for g in got] == ["FIXED", "GOOD", "BadSIZE", "BadSIZE", "CantFIX"]
    assert [tuple(x) for x in got[1].decoded.runs][2] == (2, 48, 2652, 5, False)


def brute_match(files, named, existing):
    out = {}
    for path, size, mtime, ext in files:
        same = [e for e in named if e[0] == size]
        fit = [(t, m, o) for s, n, t, m, o in same if not n.startswith("~") and t not in existing]
        right = [(abs(m - mtime), o, t) for s, n, t, m, o in same if not n.startswith("~") and t not in existing and {"pps": "ppt"}.get(n.rsplit(".", 1)[-1].lower(), n.rsplit(".", 1)[-1].lower()) == ext]
        best = min(right, default=None)
        out[path] = ("UNKNOWN" if not same else "BAD" if not best else "OK", best and best[2], best and best[0], len({t for *_, t in right}), len(fit), len(same))
    return out


def test_matching(spark):
    import random

    rng = random.Random(3)
    exts = ["doc", "pps", "PPT", "txt"]
    named = [(rng.randint(1, 6), ("~" if rng.random() < 0.1 else "") + f"n{i % 25}.{rng.choice(exts)}", None, rng.randint(0, 40), i) for i in range(120)]
    named = [(s, n, f"./d/{n}", m, i) for s, n, _, m, i in named]
    files = [(f"f{i}", rng.randint(1, 8), rng.randint(-5, 45), rng.choice(["doc", "ppt", "txt", "xls"])) for i in range(80)]
    existing = {"./d/n3.doc", "./d/n7.PPT"}
    table_n = spark.createDataFrame([(s, n, t, m, (1, i, 0)) for s, n, t, m, i in named], "size bigint, name string, path string, mtime bigint, ord struct<pass:int,fpos:bigint,idx:int>")
    table_f = spark.createDataFrame(files, "path string, size bigint, mtime bigint, ext string")
    table_e = spark.createDataFrame([(e,) for e in existing], "path string")
    for limit in (1, 3, 7):
        whole, parts = (sorted(map(str, match.match_nearest(table_f, table_n, table_e, window_times=n).collect())) for n in (10**6, limit))
        assert whole == parts
    got = match.match_nearest(table_f, table_n, table_e).collect()
    assert {r.path: (r.status, r.best, r.dist, r.n_names, r.n_absent, r.n_total) for r in got} == brute_match(files, named, existing)
    claims = [r.best for r in got if r.best]
    assert all(r.conflict == (claims.count(r.best) > 1) for r in got if r.best)
    pos = table_f.selectExpr("*", "cast(substring(path, 2) as bigint) as pos")
    greedy = {r.path: r.best for r in match.match_greedy(pos, table_n, table_e).collect()}
    taken, want = set(existing), {}
    for f in files:
        best = brute_match([f], named, taken)[f[0]][1]
        if best:
            want[f[0]] = best
            taken.add(best)
    assert greedy == want
    assert match.rename_plan(match.match_nearest(table_f, table_n)).count() > 0


def test_name_rules(spark):
    rows = spark.createDataFrame([("a.b.PPS",), ("none",), ("GR~1.DOC",), ("UPPER",), ("café",), ("x~y",)], "n string")
    got = rows.select(match.extension(rows.n, True).alias("e"), catalogue.name_score(rows.n).alias("s")).collect()
    assert [(r.e, r.s) for r in got] == [("ppt", 0), ("none", 0), ("doc", -10), ("upper", -3), ("café", 10), ("x~y", -5)]
    runs = spark.createDataFrame([(1, 0, 10, 2), (1, 1, -4, 3), (1, 2, 7, 1)], "ref bigint, idx int, delta bigint, len bigint")
    assert [(r.lcn, r.vcn) for r in catalogue.lcn_from_deltas(runs).orderBy("idx").collect()] == [(10, 0), (6, 2), (13, 5)]


def test_last_data_and_first_size_above_zero_count():
    name = lambda size, text: ntfs.resident(ntfs.NAME, ntfs.name_key(5, T0, size, text))
    got = ntfs.parse_record(ntfs.make_record(1, [name(0, "a"), name(777, "b"), name(888, "c")]))
    assert got["size"] == 777 and got["name"] == "c"
    got = ntfs.parse_record(ntfs.make_record(1, [name(9, "a"), ntfs.nonresident(ntfs.DATA, [(10, 2)], 5000), ntfs.nonresident(ntfs.DATA, [(20, 1)], 4000)]))
    assert got["size"] == 4000 and got["runs"] == [(20, 1, False)] and got["streams"] == 2


def test_index_that_leaves_its_block_has_no_entries():
    block = ntfs.make_index([(7, ntfs.name_key(5, T0, 1, "x"))])
    assert len(ntfs.index_entries(block)) == 1
    assert ntfs.index_entries(block[:28] + (5000).to_bytes(4, "little") + block[32:]) == []


def test_deleted_directories_are_no_conflict(spark):
    name = lambda text: ntfs.resident(ntfs.NAME, ntfs.name_key(5, T0, 0, text, 1, ntfs.DIRECTORY_KEY))
    data = lambda at: ntfs.nonresident(ntfs.INDEX_ALLOCATION, [(at, 1)], 4096)
    made = [("i", 0, ntfs.make_record(30, [name("old"), data(3)], flags=2)), ("i", 1024, ntfs.make_record(31, [name("kept"), data(4)], flags=3)), ("i", 2048, ntfs.make_record(32, [name("same")], flags=3))]
    index = [("i", 4096, ntfs.make_index([(r, ntfs.name_key(p, T0, 0, t, 1, ntfs.DIRECTORY_KEY)) for r, p, t in ((30, 31, "new"), (31, 30, "kept"), (32, 5, "same"))]))]
    rows = lambda x: spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in x], "image string, fpos bigint, data binary")
    records, entries = table.file_records(rows(made)), table.index_rows(rows(index))
    assert [(r.ref, r.known_parent, r.index_parent) for r in catalogue.directory_conflicts(records, entries).collect()] == [(31, 5, 30)]
    assert [(r.ref, r.delta) for r in catalogue.index_offsets(records, entries).collect()] == [(31, 4096 - 4 * 4096)]
