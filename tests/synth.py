"""A small image with a file system, built by the package's own encoders."""

from __future__ import annotations

from wrackline.functions import codecs, ntfs

T0 = 1_600_000_000


def image() -> tuple[bytes, dict]:
    """Boot sector, five index and record areas, and file data; with what should come back."""
    size = 1 << 20
    disk = bytearray(size)
    disk[3:7], disk[510:512] = b"NTFS", b"\x55\xaa"
    disk[11:13], disk[13] = (512).to_bytes(2, "little"), 8
    disk[0x30:0x38] = (4).to_bytes(8, "little")
    plain = bytes(range(256)) * 40
    packed_source = (b"the same line again and again\n" * 3000)[:65536]
    packed = codecs.lznt1_compress(packed_source)
    clusters = -(-len(packed) // 4096)
    disk[100 * 4096 : 100 * 4096 + 8192], disk[120 * 4096 : 120 * 4096 + 4096] = plain[:8192], plain[8192:].ljust(4096, b"\0")
    disk[140 * 4096 : 140 * 4096 + len(packed)] = packed
    name = lambda parent, text, n, ns=1, fl=0, t=T0: ntfs.resident(ntfs.NAME, ntfs.name_key(parent, t, n, text, ns, fl))
    records = [
        ntfs.make_record(5, [name(5, ".", 0, 3, ntfs.DIRECTORY_KEY)], flags=3),
        ntfs.make_record(40, [name(5, "DOCS~1", 0, 2), name(5, "Documents", 0)], flags=3),
        ntfs.make_record(41, [name(40, "plain.bin", 1, t=T0 + 5), ntfs.nonresident(ntfs.DATA, [(100, 2), (120, 1)], len(plain))]),
        ntfs.make_record(42, [name(40, "packed.txt", 0), ntfs.nonresident(ntfs.DATA, [(140, clusters), (None, 16 - clusters)], 65536, compression=4)]),
        ntfs.make_record(43, [name(77, "orphan.doc", 2000, t=T0 + 9), ntfs.nonresident(ntfs.DATA, [(100, 1)], 2000)]),
        ntfs.make_record(44, [name(40, "deleted.doc", 3000), ntfs.nonresident(ntfs.DATA, [(100, 1)], 3000)], flags=0),
        ntfs.make_record(45, [name(40, "small.txt", 12), ntfs.resident(ntfs.DATA, b"resident bit")]),
        ntfs.make_record(46, [name(40, "sparse.bin", 0), ntfs.nonresident(ntfs.DATA, [(100, 1), (None, 1), (120, 1)], 12288)]),
        ntfs.make_record(60, [name(61, "loop-a", 0)], flags=3),
        ntfs.make_record(61, [name(60, "loop-b", 0)], flags=3),
    ]
    broken = bytearray(ntfs.make_record(47, [name(40, "broken.doc", 5000)]))
    broken[510] ^= 1
    for i, r in enumerate([*records, bytes(broken)]):
        disk[4 * 4096 + 1024 * i : 4 * 4096 + 1024 * (i + 1)] = r
    index = ntfs.make_index([
        (41, ntfs.name_key(40, T0 + 5, len(plain), "plain.bin")),
        (43, ntfs.name_key(77, T0 + 9, 2000, "orphan.doc")),
        (70, ntfs.name_key(40, T0, 0, "LOSTDI~1", 2, ntfs.DIRECTORY_KEY)),
        (70, ntfs.name_key(40, T0, 0, "Lost directory", 1, ntfs.DIRECTORY_KEY)),
        (71, ntfs.name_key(70, T0 + 60, 4321, "inüside.PPS")),
    ])
    disk[64 * 4096 : 65 * 4096] = index
    return bytes(disk), {"plain": plain, "packed": packed_source, "sparse": plain[:4096] + bytes(4096) + disk[120 * 4096 : 121 * 4096]}
