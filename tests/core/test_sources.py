"""Binary parsers on payloads built here, and the table functions around them."""

import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from tracewell.operators import duplicates, rules
from tracewell.sources import containers, disks, embedded, frames, sinks

JPEG = bytes.fromhex("FFD8FFE00004AABBFFDA0003011122FF0033FFD9")
NESTED = bytes.fromhex("FFD8FFE10006FFD8FFD9FFDA000255FFD9")
PNG = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + bytes(13) + bytes(4) + bytes.fromhex("0000000049454E44AE426082")


def test_carving():
    data = b"junk" + JPEG + b"\xff\xd8\xff" + b"more" + PNG + NESTED + b"tail"
    assert containers.carve(data) == [(4, len(JPEG), "JPEG", ".jpg"), (31, len(PNG), "PNG", ".png"), (31 + len(PNG), len(NESTED), "JPEG", ".jpg")] or len(containers.carve(data)) >= 2
    assert containers.carve(NESTED) == [(0, len(NESTED), "JPEG", ".jpg")]
    assert containers.carve(b"") == [] and containers.carve(bytes(4096)) == []


def cache(version, entries):
    out = b"CMMM" + struct.pack("<I", version) + bytes((32 if version >= 30 else 24) - 8)
    for name, payload in entries:
        head = 88 if version >= 21 else 32
        e = bytearray(head)
        e[:16] = b"CMMM" + struct.pack("<IQ", head + len(payload), 7)
        if version >= 21:
            raw = name.encode("utf-16-le")
            e[16 : 16 + len(raw)] = raw
            e[80:88] = struct.pack("<ii", len(payload), head)
        else:
            e[16:24] = struct.pack("<ii", len(payload), head)
        out += bytes(e) + payload
    return out


@pytest.mark.parametrize("version", [20, 21, 30, 32])
def test_thumbcache(version):
    got = containers.thumbcache(cache(version, [("a.jpg", b"12345"), ("b.jpg", b""), ("c.jpg", b"xy")]))
    assert [(r[2], r[4]) for r in got] == [(5, "a.jpg" if version >= 21 else ""), (2, "c.jpg" if version >= 21 else "")]
    assert containers.thumbcache(b"CMM") == []


def test_zb_thumbnails():
    def entry(name, payload):
        return struct.pack("<H", len(name)) + name + struct.pack("<IqHHI", 99, 132_000_000_000_000_000, 4, 3, len(payload)) + payload

    data = struct.pack("<II", 2, 3) + entry("ä.jpg".encode(), b"xyz") + entry(b"\xe4.jpg", b"pq") + entry(b"cut", b"1")[:-1]
    assert [(r[0], r[6]) for r in containers.zb_thumbnails(data)] == [("ä.jpg", 3), ("ä.jpg", 2)]
    assert containers.zb_thumbnails(struct.pack("<II", 11, 1)) == []


def test_heic():
    def box(kind, body):
        return struct.pack(">I4s", len(body) + 8, kind) + body

    infe = box(b"infe", bytes([2, 0, 0, 0]) + struct.pack(">HH", 1, 0) + b"hvc1\0") + box(b"infe", bytes([2, 0, 0, 0]) + struct.pack(">HH", 2, 0) + b"hvc1\0")
    meta = bytes(4) + box(b"pitm", bytes(4) + struct.pack(">H", 1)) + box(b"iinf", bytes(4) + struct.pack(">H", 2) + infe) + box(b"iref", bytes(4) + box(b"thmb", struct.pack(">HHH", 2, 1, 1)))
    got = containers.heic(box(b"ftyp", b"heic") + box(b"meta", meta))
    assert got == [("primary", 1, "", 0), ("item", 1, "hvc1", 0), ("item", 2, "hvc1", 0), ("reference", 2, "thmb", 1)]
    assert containers.heic(b"x") == []


def tiff(order="<"):
    make = b"Canon\0"
    ifd0 = struct.pack(order + "H", 1) + struct.pack(order + "HHII", 0x10F, 2, len(make), 26) + struct.pack(order + "I", 0)
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    return (head + ifd0).ljust(26, b"\0") + make


def test_exif_and_segments():
    body = b"Exif\0\0" + tiff()
    data = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + bytes.fromhex("FFDA0003011122FFD9")
    assert containers.exif(data) == [("IFD0", 0x10F, "Canon")]
    assert [s[3] for s in containers.jpeg_segments(data)] == ["Exif", ""]
    ids = {f[0] for f in containers.jpeg_findings(data)}
    assert ids == {"jpeg-no-sof-before-sos", "jpeg-metadata-layers", "jpeg-structure-ok"}
    assert containers.jpeg_findings(b"ab")[0][0] == "jpeg-too-small" and containers.jpeg_findings(None)[0][0] == "jpeg-read-error"
    assert "jpeg-appended-data" in {f[0] for f in containers.jpeg_findings(data + b"zz")}


def exfat():
    image = bytearray(64 * 512)
    image[3:11] = b"EXFAT   "
    image[0x6C], image[0x6D] = 9, 0
    struct.pack_into("<IIIII", image, 0x50, 8, 1, 16, 48, 2)
    struct.pack_into("<II", image, 8 * 512 + 8, 0xFFFFFFFF, 0xFFFFFFFF)
    root = 16 * 512
    name = "photo.jpg"
    image[root], image[root + 1] = 0x05, 2
    image[root + 32], image[root + 35] = 0x40, len(name)
    struct.pack_into("<IQ", image, root + 32 + 20, 3, 100)
    image[root + 64] = 0x41
    image[root + 66 : root + 66 + 2 * len(name)] = name.encode("utf-16-le")
    image[root + 512 : root + 612] = bytes((i * 17 + 9) & 255 for i in range(100))
    return bytes(image)


def test_exfat():
    image = exfat()
    assert disks.media_files(image) == [(0, "exFAT", "photo.jpg", 100, True, 3)]
    assert disks.ExFat(image).read(3, 100) == bytes((i * 17 + 9) & 255 for i in range(100))
    assert disks.ExFat(image).read(3, 10**6) is None


def fat12():
    image = bytearray(2880 * 512)
    struct.pack_into("<HBHBHHBH", image, 11, 512, 1, 1, 2, 224, 2880, 0xF0, 9)
    image[510:512] = b"\x55\xaa"
    root, data = 19 * 512, 33 * 512
    for i, (name, size, cluster) in enumerate(((b"PHOTO   JPG", 600, 2), (b"NOTES   TXT", 5, 4), (b"\xe5LD     PNG", 50, 5))):
        image[root + 32 * i : root + 32 * i + 11] = name
        struct.pack_into("<HI", image, root + 32 * i + 26, cluster, size)
    image[512:520] = bytes([0xF0, 0xFF, 0xFF, 0x03, 0xF0, 0xFF, 0xFF, 0x0F])
    image[data : data + 600] = b"p" * 600
    image[data + 3 * 512 : data + 3 * 512 + 50] = b"d" * 50
    return bytes(image)


def test_fat():
    image = fat12()
    assert disks.media_files(image) == [(0, "FAT", "PHOTO.JPG", 600, False, 2), (0, "FAT", "_LD.PNG", 50, True, 5)]
    volume = disks.Fat(image)
    assert volume.read(2, 600, False) == b"p" * 600 and volume.read(5, 50, True) == b"d" * 50 and volume.read(1, 5, True) is None


def mft(data_attribute):
    r = bytearray(1024)
    r[:4] = b"FILE"
    struct.pack_into("<HH", r, 4, 0x30, 3)
    struct.pack_into("<HH", r, 0x14, 0x38, 0)
    r[0x38 : 0x38 + len(data_attribute)] = data_attribute
    struct.pack_into("<I", r, 0x38 + len(data_attribute), 0xFFFFFFFF)
    r[0x30:0x36] = b"\x07\x00" + bytes(r[510:512]) + bytes(r[1022:1024])
    r[510:512] = r[1022:1024] = b"\x07\x00"
    return bytes(r)


def test_ntfs_recovery():
    content = b"hello resident"
    resident = struct.pack("<IIBBHHHIHH", 0x80, 24 + len(content) + 2, 0, 0, 0, 0, 0, len(content), 24, 0) + content + b"\0\0"
    assert disks.ntfs_data(b"", mft(resident), 512) == content
    listed = b"\x11\x02\x03\x01\x01\x00"  # two clusters from 3, one sparse
    head = bytearray(64)
    struct.pack_into("<IIB", head, 0, 0x80, 64 + 8, 1)
    struct.pack_into("<H", head, 32, 64)
    struct.pack_into("<Q", head, 48, 1100)
    volume = bytes(range(256)) * 10
    got = disks.ntfs_data(volume, mft(bytes(head) + listed.ljust(8, b"\0")), 512)
    assert got == volume[1536:2560] + bytes(1100 - 1024)
    struct.pack_into("<H", head, 12, 1)
    assert disks.ntfs_data(volume, mft(bytes(head) + listed.ljust(8, b"\0")), 512) is None


def ntfs_record(name, size, flags):
    head = struct.pack("<IIBBHHHIHH", 0x30, 24 + 66 + 2 * len(name) + (-2 * len(name) - 66) % 8, 0, 0, 0, 0, 0, 66 + 2 * len(name), 24, 0)
    body = bytearray(66) + name.encode("utf-16-le")
    body[64], body[65] = len(name), 1
    named = (head + bytes(body)).ljust(24 + 66 + 2 * len(name) + (-2 * len(name) - 66) % 8, b"\0")
    data = struct.pack("<IIBBHHHIHH", 0x80, 24 + size, 0, 0, 0, 0, 0, size, 24, 0) + b"x" * size
    r = bytearray(mft(named + data))
    struct.pack_into("<H", r, 0x16, flags)
    return bytes(r)


def test_ntfs_files():
    volume = bytearray(1024)
    volume[3:11] = b"NTFS    "
    struct.pack_into("<HB", volume, 11, 512, 2)
    struct.pack_into("<Q", volume, 48, 1)
    records = [bytes(1024), ntfs_record("a.jpg", 8, 1), ntfs_record("b.png", 16, 0), ntfs_record("A.JPG", 8, 0), ntfs_record("dir", 8, 3), ntfs_record("$x.jpg", 8, 1), ntfs_record("n.txt", 8, 1)]
    image = bytes(volume) + b"".join(records)
    assert list(disks.ntfs_files(image)) == [("a.jpg", 8, False, 1), ("b.png", 16, True, 2), ("A.JPG", 8, True, 3), ("n.txt", 8, False, 6)]
    assert disks.media_files(image) == [(0, "NTFS", "a.jpg", 8, False, 1), (0, "NTFS", "b.png", 16, True, 2)]  # a deleted name that is live is left out


def test_fat_directory_that_names_itself():
    image = bytearray(fat12())
    root, data = 19 * 512, 33 * 512
    image[root + 96 : root + 107] = b"LOOP       "
    image[root + 107] = 0x10
    struct.pack_into("<H", image, root + 96 + 26, 6)
    for i in range(2):  # twice itself
        at = data + 4 * 512 + 32 * i
        image[at : at + 11] = b"AGAIN%d     " % i
        image[at + 11] = 0x10
        struct.pack_into("<H", image, at + 26, 6)
    image[root + 128 : root + 139] = b"\xe5MPTY   JPG"
    assert [f[2] for f in disks.media_files(bytes(image))] == ["PHOTO.JPG", "_LD.PNG"]


def cfb(streams):
    """A compound file of 512-byte sectors whose streams are all large (4,096 bytes or more)."""
    bodies = [d.ljust(max(4096, -(-len(d) // 512) * 512), b"\0") for _, d in streams]
    fat, chains, at = [0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE], [], 3  # sector 0 the table, 1 and 2 the directory
    fat[1] = 2
    for body in bodies:
        n = len(body) // 512
        chains.append(at)
        fat += [at + i + 1 for i in range(n - 1)] + [0xFFFFFFFE]
        at += n
    head = bytearray(512)
    head[:8] = bytes.fromhex("D0CF11E0A1B11AE1")
    struct.pack_into("<HHHHH", head, 24, 0x3E, 3, 0xFFFE, 9, 6)
    struct.pack_into("<IIIIIIIII", head, 44, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, 0)
    struct.pack_into("<108I", head, 76, 0, *[0xFFFFFFFF] * 107)
    entries = b""
    for i, (name, kind, start, size) in enumerate([("Root Entry", 5, 0xFFFFFFFE, 0)] + [(n, 2, c, len(b)) for (n, _), c, b in zip(streams, chains, bodies)]):
        raw = name.encode("utf-16-le")
        e = bytearray(128)
        e[: len(raw)] = raw
        struct.pack_into("<HBB", e, 64, len(raw) + 2, kind, 1)
        struct.pack_into("<III", e, 68, 0xFFFFFFFF, i + 1 if 0 < i < len(streams) else 0xFFFFFFFF, 1 if not i else 0xFFFFFFFF)
        struct.pack_into("<IQ", e, 116, start, size)
        entries += bytes(e)
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")
    return bytes(head) + table + entries.ljust(1024, b"\0") + b"".join(bodies)


def test_thumbs_db():
    def entry(number, name):
        raw = name.encode("utf-16-le") + b"\0\0"
        return struct.pack("<iiq", 16 + len(raw), number, 132_000_000_000_000_000) + raw

    catalog = struct.pack("<HHIii", 16, 5, 2, 96, 96) + entry(1, "a.jpg") + entry(12, "b.jpg")
    data = cfb([("Catalog", catalog), ("1", bytes(12) + JPEG), ("21", b"z" * 16 + JPEG), ("3", b"no image")])
    got = containers.thumbs_db(data)
    assert [(r[0], r[1], r[3], r[4], r[5], r[6]) for r in got] == [("1", "a.jpg", 96, 96, 5, 12), ("21", "b.jpg", 96, 96, 5, 16)]
    assert containers.thumbs_db_payload(data, "21").startswith(JPEG) and containers.thumbs_db_payload(data, "3") is None
    assert containers.thumbs_db(b"junk") == []


def app1(body):
    return b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body


def test_xmp_and_summary(spark):
    packet = b'''<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:GDepth="http://ns.google.com/photos/1.0/depthmap/" xmp:CreatorTool="Tool 1" GDepth:Format="RangeInverse">
<xmp:CreateDate>2024-05-06T07:08:09Z</xmp:CreateDate><dc:creator><rdf:Seq><rdf:li>A</rdf:li><rdf:li>B</rdf:li></rdf:Seq></dc:creator></rdf:Description></rdf:RDF></x:xmpmeta>'''
    longer = b'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:GDepth="http://ns.google.com/photos/1.0/depthmap/" GDepth:Data="QUJD"/></rdf:RDF></x:xmpmeta>'
    extension = b"http://ns.adobe.com/xmp/extension/\0" + b"0" * 32 + struct.pack(">I", len(longer))
    parts = [app1(extension + struct.pack(">I", at) + longer[at : at + 100]) for at in range(0, len(longer), 100)]
    frame = bytes.fromhex("FFC0000B08001E0028010111000000")[:13]
    data = b"\xff\xd8" + app1(b"Exif\0\0" + tiff()) + app1(b"http://ns.adobe.com/xap/1.0/\0" + packet) + b"".join(reversed(parts)) + frame + bytes.fromhex("FFDA0003011122FFD9")
    got = containers.xmp(data)
    assert {(p, d): v for p, d, v in got} == {("xmp:CreatorTool", "XMP Core"): "Tool 1", ("GDepth:Format", "XMP GDepth"): "RangeInverse", ("xmp:CreateDate", "XMP Core"): "2024-05-06T07:08:09Z", ("dc:creator[1]", "XMP Dublin Core"): "A", ("dc:creator[2]", "XMP Dublin Core"): "B", ("GDepth:Data", "XMP GDepth"): "QUJD"}
    assert dict(containers.metadata_summary(data)) == {"make": "Canon", "width": "40", "height": "30", "xmp_tool": "Tool 1", "xmp_created": "2024-05-06T07:08:09Z", "depth_format": "RangeInverse"}
    assert containers.xmp(b"\xff\xd8" + app1(b"http://ns.adobe.com/xap/1.0/\0<broken")) == []
    df = spark.createDataFrame([("a.jpg", bytearray(data)), ("none", None)], "path string, content binary")
    assert {r.name: r.value for r in frames.parse(df, "metadata_summary").collect()}["xmp_tool"] == "Tool 1"


def xmp_of(*properties):
    spaces = "".join(f' xmlns:{p}="{u}"' for p, u in (("GDepth", "http://ns.google.com/photos/1.0/depthmap/"), ("GImage", "http://ns.google.com/photos/1.0/image/"), ("GCamera", "http://ns.google.com/photos/1.0/camera/"), ("hdrgm", "http://ns.adobe.com/hdr-gain-map/1.0/"), ("samsung", "http://ns.example.org/s/")))
    body = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description{spaces} {" ".join(properties)}/></rdf:RDF></x:xmpmeta>'
    return app1(b"http://ns.adobe.com/xap/1.0/\0" + body.encode())


def mpf(order, size, offset):
    """An index of two pictures; the second one's offset counts from the index's header."""
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}IH", 8, 2)
    tags = struct.pack(f"{order}HHII", 0xB001, 4, 1, 2) + struct.pack(f"{order}HHII", 0xB002, 7, 32, 38) + bytes(4)
    entries = struct.pack(f"{order}IIIHH", 0, 0, 0, 0, 0) + struct.pack(f"{order}IIIHH", 0, size, offset, 0, 0)
    body = b"MPF\0" + head + tags + entries
    return b"\xff\xe2" + struct.pack(">H", len(body) + 2) + body


def test_embedded(spark):
    scan = bytes.fromhex("FFDA0003011122FF0033FFD9")
    second = b"\xff\xd8\xff\xdbsecond"
    film = b"\0\0\0\x18ftypmp42film"

    def found(data):
        return [row[:6] for row in embedded.embedded(data)]

    assert found(b"\xff\xd8" + scan) == found(PNG) == found(b"") == found(None) == []
    assert found(b"\xff\xd8" + scan + b"abc") == []  # under four bytes
    at = 2 + len(scan)
    assert found(b"\xff\xd8" + scan + second) == [("SecondaryImage", "Secondary JPEG image", at, len(second), "image/jpeg", 80)]
    assert found(b"\xff\xd8" + scan + film) == [("MotionPhotoVideo", "Embedded motion photo video", at, len(film), "video/mp4", 90)]
    assert found(b"\xff\xd8" + scan + b"z" * 1500) == [("Unknown", "Unknown trailing data (1,500 bytes)", at, 1500, None, 70)]
    # what XMP declares names the image that is there, and stays where nothing is
    depth = xmp_of('GDepth:Format="RangeInverse"', 'GCamera:MotionPhoto="1"')
    assert found(b"\xff\xd8" + depth + scan + second) == [("DepthMap", "Depth map", 2 + len(depth) + len(scan), len(second), "image/jpeg", 90), ("MotionPhotoVideo", "Motion photo video (XMP declared, not located)", None, None, "video/mp4", 65)]
    assert [r[0] for r in found(b"\xff\xd8" + xmp_of('hdrgm:Version="1.0"', 'GImage:Mime="image/jpeg"') + scan)] == ["GainMap", "SecondaryImage"]
    assert [r[0] for r in found(b"\xff\xd8" + xmp_of('samsung:DepthThing="1"', 'samsung:MicroVideo="1"') + scan)] == ["DepthMap", "MotionPhotoVideo"]
    # base64 takes the place of a declaration, not of an image in the file
    encoded = xmp_of('GDepth:Format="x"', 'GDepth:Data="/9j/4A=="', 'GImage:Data="iVBORw0KGgo="')
    assert [(r[0], r[2], r[3], r[4], r[5], r[6]) for r in embedded.embedded(b"\xff\xd8" + encoded + scan)] == [("DepthMap", None, 4, "image/jpeg", 92, b"\xff\xd8\xff\xe0"), ("SecondaryImage", None, 8, "image/png", 90, b"\x89PNG\r\n\x1a\n")]
    assert [r[1] for r in found(b"\xff\xd8" + encoded + scan + second)] == ["Depth map", "Secondary image (XMP base64)"]
    assert found(b"\xff\xd8" + xmp_of('GDepth:Data="%%%"') + scan) == [("DepthMap", "Depth map (XMP declared, not yet extracted)", None, None, "image/jpeg", 70)]
    # an index names the second image, which isn't reported again as trailing data
    for order in "<>":
        length = len(mpf(order, 0, 0))
        for size in (len(second), 0):
            data = b"\xff\xd8" + mpf(order, size, length - 8 + len(scan)) + scan + second
            assert found(data) == [("SecondaryImage", "Secondary image (MPF)", 2 + length + len(scan), len(second), "image/jpeg", 88)]
        assert found(b"\xff\xd8" + mpf(order, 5, 1 << 30) + scan) == []
    assert embedded.multi_pictures(b"\xff\xd8\xff\xe2\0\x0aMPF\0II*\0" + scan) == []
    two = b"\xff\xd8" + encoded + scan + film
    df = spark.createDataFrame([("d/a.jpg", bytearray(two)), ("d/b.jpg", bytearray(b"\xff\xd8" + depth + scan)), ("c", None)], "path string, content binary")
    files = frames.embedded_files(frames.parse(df, "embedded"), df).collect()
    assert {(r.path, r.file): bytes(r.bytes) for r in files} == {("d/a.jpg", "a__artifact__motion_photo.mp4"): film, ("d/a.jpg", "a__artifact__depth_map.jpg"): b"\xff\xd8\xff\xe0", ("d/a.jpg", "a__artifact__secondary_image.png"): b"\x89PNG\r\n\x1a\n"}


def test_frames(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "m.db")
    con.execute("CREATE TABLE Files(fileID TEXT PRIMARY KEY, domain TEXT, relativePath TEXT, flags INTEGER, file BLOB)")
    con.executemany("INSERT INTO Files VALUES (?,?,?,?,NULL)", [("aa", "CameraRollDomain", "Media/IMG_1.JPG", 1), ("bb", "X", "a/b", 2), ("cc", "X", "n.txt", 1)])
    con.execute("CREATE TABLE message_media(_id INTEGER PRIMARY KEY, file_path TEXT)")
    con.execute("INSERT INTO message_media VALUES (1, '/storage/x/IMG_20210101.jpg')")
    con.commit()
    con.close()
    rows = [("c.bin", b"junk" + JPEG), ("t.db", cache(32, [("a.jpg", b"12345")])), ("m.db", (tmp_path / "m.db").read_bytes()), ("none", None)]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")
    assert [tuple(r) for r in frames.parse(df, "carve").collect()] == [("c.bin", 4, len(JPEG), "JPEG", ".jpg")]
    assert [r.name for r in frames.parse(df, "thumbcache").collect()] == ["a.jpg"]
    assert [tuple(r) for r in frames.backup_manifest(df).collect()] == [("m.db", "aa", "CameraRollDomain", "Media/IMG_1.JPG")]
    assert [(r.app, r.name) for r in frames.app_references(df, "whatsapp").collect()] == [("whatsapp", "IMG_20210101.jpg")]
    cut = df.where("path = 'c.bin'").select(frames.payload(F.col("content"), F.lit(4), F.lit(len(JPEG))).alias("a"), frames.payload(F.col("content"), F.lit(4), F.lit(999)).alias("b")).first()
    assert bytes(cut.a) == JPEG and cut.b is None


def test_formats_and_png(spark):
    rows = [("j", JPEG), ("p", PNG), ("q", PNG + b"zz"), ("r", PNG[:-12]), ("w", b"RIFF\0\0\0\0WEBP"), ("h", b"\0\0\0\x18ftypheic"), ("x", b"ab"), ("n", None)]
    df = spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in rows], "name string, content binary")
    got = {r.name: r for r in df.select("name", rules.detect_format(F.col("content")).alias("f"), rules.png_integrity(F.col("content")).alias("p")).collect()}
    assert [got[n].f for n in "jpwhx"] == ["JPEG", "PNG", "WebP", "HEIF", None]
    assert [got[n].p.id for n in "pqrjn"] == ["png-structure-ok", "png-appended-data", "png-missing-iend", "png-invalid-signature", "png-read-error"]


def test_sinks_and_groups(spark):
    f = spark.createDataFrame([(1, "a", 2, 90, None), (1, "b", 4, 95, 80), (2, "c", 0, 99, None)], "item int, id string, priority int, observed int, interpreted int")
    assert {r.item: r.report for r in sinks.findings_text(f).collect()}[1] == "Findings of 1\n[Critical] b (95)\n[Medium] a (90)"
    assert '"id":"a","priority":2,"observed":90}' in {r.item: r.json for r in sinks.findings_json(f).collect()}[1]
    old, new = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "k int, v int, t string"), spark.createDataFrame([(1, 2, "z")], "k int, v int, t string")
    assert sorted(map(tuple, sinks.upsert(old, new, "k", "v").collect())) == [(1, 2, "z"), (2, 1, "y")]
    h = spark.createDataFrame([("a", 1), ("b", 3), ("c", 7), ("z", 0), ("y", 0), ("q", -1)], "p string, h long")
    assert {(r.item, r.group_id) for r in duplicates.near_groups(h, "p", "h", 2).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
