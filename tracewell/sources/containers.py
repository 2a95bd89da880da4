"""Parsers of thumbnail caches, images and carved bytes: one binary payload to its records.

Each parser takes bytes and returns a list of tuples. Damaged input ends the list; it never raises.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Callable, Iterator

CARVE_CAP = 64 << 20
JPEG_HEADER_CAP = 64 << 10


def safely(parser: Callable[..., list[tuple]]) -> Callable[..., list[tuple]]:
    def run(content: bytes | None, **options) -> list[tuple]:
        try:
            return parser(content or b"", **options)
        except (struct.error, IndexError, ValueError, OverflowError):
            return []

    return run


#: An entry's header: mark, entry size, hash, then (from version 21 on, after the name) payload size and header size.
_ENTRY = {False: "<4sIqii", True: "<4sIq64sii"}


@safely
def thumbcache(data: bytes) -> list[tuple]:
    """(offset, hash, data_size, header_size, name) of the filled entries of a CMMM cache: entries follow each other by their sizes."""
    magic, version = struct.unpack_from("<4sI", data)
    layout, out = _ENTRY[version >= 21], []
    place = 32 if version >= 30 else 24
    room, least = len(data) - place if magic == b"CMMM" else 0, struct.calcsize(layout)
    while room >= least:
        mark, size, key, *name, payload, header = struct.unpack_from(layout, data, place)
        if mark != magic or not least <= size <= room:
            break
        if min(payload, header) > 0:
            out.append((place, key, payload, header, name[0].decode("utf-16-le", "replace").partition("\0")[0] if name else ""))
        place, room = place + size, room - size
    return out


@safely
def zb_thumbnails(data: bytes) -> list[tuple]:
    """(name, width, height, original_size, filetime, offset, size) of a length-prefixed thumbnail list."""
    version, count = struct.unpack_from("<II", data)
    if not 1 <= version <= 10 or count > 100_000:
        return []
    out, at = [], 8
    while len(out) < count and at + 4 < len(data):
        (n,) = struct.unpack_from("<H", data, at)
        fixed = at + 2 + n
        if not 0 < n <= 512 or fixed + 20 > len(data):
            break
        raw = data[at + 2 : fixed]
        name = raw.decode("utf-8", "replace")
        if "�" in name:
            name = raw.decode("latin-1")
        original, time, width, height, size = struct.unpack_from("<IqHHI", data, fixed)
        at = fixed + 20 + size
        if size == 0 or at > len(data):
            break
        out.append((name, width, height, original, time, fixed + 20, size))
    return out


def _cfb_streams(data: bytes) -> dict[str, bytes]:
    """Streams of an OLE compound file by name."""
    if data[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
        return {}
    sector, mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    n_fat, root, _, cutoff, mini_fat, _, difat, _ = struct.unpack_from("<IIIIIIII", data, 44)
    place = lambda s: (s + 1) * sector
    table = [s for s in struct.unpack_from("<109I", data, 76) if s < 0xFFFFFFFC]
    while difat < 0xFFFFFFFC and len(table) < n_fat:
        part = struct.unpack_from(f"<{sector // 4}I", data, place(difat))
        table += [s for s in part[:-1] if s < 0xFFFFFFFC]
        difat = part[-1]
    fat = [x for s in table[:n_fat] for x in struct.unpack_from(f"<{sector // 4}I", data, place(s))]

    def chain(start: int, links: list[int]) -> Iterator[int]:
        seen = set()
        while start < len(links) and start not in seen:
            seen.add(start)
            yield start
            start = links[start]

    read = lambda start: b"".join(data[place(s) : place(s) + sector] for s in chain(start, fat))
    directory = read(root)
    links = [x for (x,) in struct.iter_unpack("<I", read(mini_fat))] if mini_fat < 0xFFFFFFFC else []
    entries = []
    for at in range(0, len(directory) - 127, 128):
        length, kind = struct.unpack_from("<HB", directory, at + 64)
        start, size = struct.unpack_from("<II", directory, at + 116)
        entries.append((directory[at : at + max(0, length - 2)].decode("utf-16-le", "replace"), kind, start, size))
    pool = next((read(s) for _, kind, s, _ in entries if kind == 5), b"")
    out = {}
    for name, kind, start, size in entries:
        if kind == 2:
            out[name] = (b"".join(pool[s * mini : (s + 1) * mini] for s in chain(start, links)) if size < cutoff else read(start))[:size]
    return out


@safely
def thumbs_db(data: bytes) -> list[tuple]:
    """(stream, name, filetime, width, height, version, payload offset, size) of numbered streams, named by the catalog."""
    streams = _cfb_streams(data)
    catalog = streams.get("Catalog", b"")
    names: dict[int, tuple[str, int]] = {}
    width = height = version = 0
    if len(catalog) >= 16:
        head, version, _, width, height = struct.unpack_from("<HHIii", catalog)
        at = head if head >= 16 else len(catalog)
        while at + 16 < len(catalog):
            size, number, time = struct.unpack_from("<iiq", catalog, at)
            if size < 16 or at + size > len(catalog):
                break
            names[number] = (catalog[at + 16 : at + size].decode("utf-16-le", "replace").split("\0", 1)[0], time)
            at += size
    out = []
    for stream, payload in streams.items():
        if not stream[::-1].isdigit():
            continue
        number = int(stream[::-1])  # streams are named by their number backwards
        start = payload[:258].find(b"\xff\xd8")
        if start >= 0:
            name, time = names.get(number, (f"#{number}", 0))
            out.append((stream, name, time, width, height, version, start, len(payload) - start))
    return sorted(out)


def thumbs_db_payload(data: bytes, stream: str) -> bytes | None:
    """A thumbnail's bytes from its JPEG start."""
    payload = _cfb_streams(data).get(stream, b"")
    start = payload[:258].find(b"\xff\xd8")
    return payload[start:] if start >= 0 else None


#: A marker that isn't stuffing, a restart or temporary mark: the end of the image, or the start of a segment with a length.
_MARKER = re.compile(rb"\xff+([\x02-\xcf\xd8-\xfe])")


def jpeg_end(data: bytes, start: int, cap: int = CARVE_CAP) -> int | None:
    """Where the JPEG that begins at ``start`` ends, by its marker structure; None if it has no end."""
    limit, place = min(len(data), start + cap), start + 2
    while mark := _MARKER.search(data, place, limit):
        if mark[1] == b"\xd9":
            return mark.end()
        length = int.from_bytes(data[mark.end() : min(mark.end() + 2, limit)])  # scan data follow a segment up to the next marker
        if length < 2:
            return None
        place = mark.end() + length
    return None


def png_end(data: bytes, start: int) -> int | None:
    limit, at = min(len(data), start + CARVE_CAP), start + 8
    while at + 12 <= limit:
        length = int.from_bytes(data[at : at + 4])
        end = at + 12 + length
        if end > limit:
            return None
        if data[at + 4 : at + 8] == b"IEND":
            return end
        at = end
    return None


_STARTS = re.compile(rb"\xff\xd8\xff|\x89PNG\r\n\x1a\n")


@safely
def carve(data: bytes) -> list[tuple]:
    """(offset, length, format, extension) of JPEG and PNG files in raw bytes, from left to right, without overlap."""
    out, at = [], 0
    while found := _STARTS.search(data, at):
        start = found.start()
        jpeg = data[start] == 0xFF
        end = jpeg_end(data, start) if jpeg else png_end(data, start)
        if end:
            out.append((start, end - start, "JPEG" if jpeg else "PNG", ".jpg" if jpeg else ".png"))
        at = end or start + 1
    return out


@safely
def jpeg_segments(data: bytes, cap: int = JPEG_HEADER_CAP) -> list[tuple]:
    """(offset, marker, length, app name) from the start to the scan, within the first ``cap`` bytes; length -1 where it breaks off, 0 where it is malformed."""
    if data[:2] != b"\xff\xd8":
        return []
    out, at = [], 2
    while at + 1 < min(len(data), cap):
        if data[at] != 0xFF:
            break
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0x01, 0xD8) or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        if at + 4 > len(data):
            out.append((at, marker, -1, ""))
            break
        length = int.from_bytes(data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + length]
        name = ""
        if 0xE0 <= marker <= 0xEF:
            name = next((n for n, p in (("Exif", b"Exif\0\0"), ("XMP", b"http://ns.adobe.com/xap/1.0/\0"), ("XMP extension", b"http://ns.adobe.com/xmp/extension/\0"), ("JFIF", b"JFIF\0"), ("ICC", b"ICC_PROFILE\0"), ("MPF", b"MPF\0"), ("Photoshop", b"Photoshop 3.0\0"), ("Adobe", b"Adobe")) if body.startswith(p)), f"APP{marker - 0xE0}")
        if length < 2:
            out.append((at, marker, 0, name))
            break
        if at + 2 + length > len(data):
            out.append((at, marker, -1, name))
            break
        out.append((at, marker, length, name))
        if marker == 0xDA:
            break
        at += 2 + length
    return out


SOF = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}


def jpeg_findings(data: bytes | None) -> list[tuple]:
    """(id, priority, observed, interpreted) about a JPEG's structure."""
    if data is None:
        return [("jpeg-read-error", 3, 90, -1)]
    if len(data) < 4:
        return [("jpeg-too-small", 4, 95, 80)]
    if data[:2] != b"\xff\xd8":
        return [("jpeg-missing-soi", 3, 99, 75)]
    out, segments = [], jpeg_segments(data)
    if any(n == -1 for _, _, n, _ in segments):
        out.append(("jpeg-truncated-segment", 3, 99, 85))
    if any(n == 0 for _, _, n, _ in segments):
        out.append(("jpeg-malformed-segment-length", 3, 95, 80))
    kinds = [m for _, m, _, _ in segments]
    if 0xDA in kinds and not SOF & set(kinds):
        out.append(("jpeg-no-sof-before-sos", 2, 95, 70))
    apps = [n for _, m, _, n in segments if 0xE0 <= m <= 0xEF]
    if apps.count("Exif") > 1:
        out.append(("jpeg-duplicate-exif", 2, 99, 70))
    out.append(("jpeg-metadata-layers", 0, 90, -1) if apps else ("jpeg-no-app-metadata", 1, 90, 65))
    end = data[-256:].rfind(b"\xff\xd9")
    after = len(data[-256:]) - end - 2
    out.append(("jpeg-missing-eoi", 2, 95, 65) if end < 0 else ("jpeg-appended-data", 2, 90, 60) if after else ("jpeg-structure-ok", 0, 99, -1))
    return out


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or end - at
        if size < head or at + size > end:
            return
        yield kind.decode("latin-1"), at + head, at + size
        at += size


@safely
def heic(data: bytes) -> list[tuple]:
    """(kind, item, type, target): items, typed references and the primary item of a HEIC file's meta box."""
    meta = next(((a, b) for k, a, b in _boxes(data, 0, len(data)) if k == "meta"), None)
    if not meta:
        return []
    out = []
    for kind, at, end in _boxes(data, meta[0] + 4, meta[1]):
        version = data[at]
        if kind == "pitm":
            out.append(("primary", int.from_bytes(data[at + 4 : at + (8 if version else 6)]), "", 0))
        elif kind == "iinf":
            for k, a, _ in _boxes(data, at + (8 if version else 6), end):
                if k == "infe" and data[a] >= 2:
                    wide = 4 if data[a] >= 3 else 2
                    out.append(("item", int.from_bytes(data[a + 4 : a + 4 + wide]), data[a + 6 + wide : a + 10 + wide].decode("latin-1"), data[a + 3] & 1))
        elif kind == "iref":
            wide = 4 if version else 2
            for k, a, b in _boxes(data, at + 4, end):
                source, n = int.from_bytes(data[a : a + wide]), int.from_bytes(data[a + wide : a + wide + 2])
                for i in range(n):
                    p = a + wide + 2 + i * wide
                    if p + wide <= b:
                        out.append(("reference", source, k, int.from_bytes(data[p : p + wide])))
    return out


@safely
def exif(data: bytes) -> list[tuple]:
    """(directory, tag, value text) of the TIFF directories in a JPEG's Exif segment."""
    at = next((o + 10 for o, m, n, name in jpeg_segments(data) if name == "Exif"), None)
    if at is None:
        return []
    tiff = data[at:]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        return []
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 9: 4, 10: 8}
    out, todo, seen = [], [("IFD0", struct.unpack_from(order + "I", tiff, 4)[0])], set()
    while todo:
        name, place = todo.pop(0)
        if not place or place in seen or place + 2 > len(tiff):
            continue
        seen.add(place)
        (n,) = struct.unpack_from(order + "H", tiff, place)
        for i in range(n):
            p = place + 2 + 12 * i
            if p + 12 > len(tiff):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", tiff, p)
            size = sizes.get(kind, 0) * count
            start = p + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, p + 8)[0]
            raw = tiff[start : start + size]
            if not size or len(raw) < size:
                continue
            if kind == 2:
                value = raw.split(b"\0", 1)[0].decode("utf-8", "replace")
            elif kind in (5, 10):
                pairs = struct.iter_unpack(order + ("II" if kind == 5 else "ii"), raw)
                value = " ".join(f"{a}/{b}" for a, b in pairs)
            elif kind in (3, 4, 9):
                value = " ".join(str(x) for (x,) in struct.iter_unpack(order + {3: "H", 4: "I", 9: "i"}[kind], raw))
            else:
                value = raw.hex()
            if tag in (0x8769, 0x8825, 0xA005):
                todo.append(({0x8769: "Exif", 0x8825: "GPS", 0xA005: "Interop"}[tag], int(value.split()[0])))
            out.append((name, tag, value))
        if name == "IFD0" and place + 6 + 12 * n <= len(tiff):
            todo.append(("IFD1", struct.unpack_from(order + "I", tiff, place + 2 + 12 * n)[0]))
    return out


def exif_thumbnail(data: bytes) -> bytes | None:
    """The JPEG thumbnail that the second directory points to."""
    at = next((o + 10 for o, m, n, name in jpeg_segments(data) if name == "Exif"), None)
    tags = {t: v for d, t, v in exif(data) if d == "IFD1"}
    if at is None or 0x201 not in tags or 0x202 not in tags:
        return None
    start, size = int(tags[0x201]), int(tags[0x202])
    found = data[at + start : at + start + size]
    return found if len(found) == size > 0 else None


def _rational(text: str) -> float:
    top, _, under = text.partition("/")
    return int(top) / int(under) if under and int(under) else float(top if not under else 0)


#: Directory, tag and name of what a summary holds as text (fixed values).
SUMMARY = (
    ("IFD0", 0x10F, "make"), ("IFD0", 0x110, "model"), ("IFD0", 0x131, "software"), ("IFD0", 0x132, "header_time"), ("IFD0", 0x10E, "description"), ("IFD0", 0x8298, "copyright"), ("IFD0", 0x13B, "artist"), ("IFD0", 0x112, "orientation"),
    ("Exif", 0x9003, "original_time"), ("Exif", 0x9004, "digitized_time"), ("Exif", 0xA002, "width"), ("Exif", 0xA003, "height"), ("Exif", 0x829A, "exposure"), ("Exif", 0x829D, "aperture"), ("Exif", 0x8827, "iso"), ("Exif", 0x920A, "focal_length"), ("Exif", 0xA434, "lens"), ("Exif", 0xA001, "color_space"),
)


def _degrees(tags: dict, value: int, reference: int, negative: str) -> str | None:
    parts = [_rational(x) for x in tags.get(("GPS", value), "").split()]
    if len(parts) != 3:
        return None
    found = parts[0] + parts[1] / 60 + parts[2] / 3600
    return repr(-found if tags.get(("GPS", reference), "").upper().startswith(negative) else found)


@safely
def metadata_summary(data: bytes) -> list[tuple]:
    """(name, value) of the summary of a JPEG: Exif fields, the place in degrees, the frame's size where Exif has none, and what the XMP declares."""
    tags = {}
    for directory, tag, value in exif(data):
        tags.setdefault((directory, tag), value)
    found = {name: tags[d, t].strip() for d, t, name in SUMMARY if tags.get((d, t), "").strip()}
    latitude, longitude = _degrees(tags, 2, 1, "S"), _degrees(tags, 4, 3, "W")
    if latitude and longitude and (float(latitude) or float(longitude)):
        found |= {"latitude": latitude, "longitude": longitude}
    stamp, time = tags.get(("GPS", 0x1D), ""), [int(_rational(x)) for x in tags.get(("GPS", 7), "").split()]
    if stamp and len(time) == 3:
        found["gps_time"] = f"{stamp} {time[0]:02}:{time[1]:02}:{time[2]:02}"
    frame = next((o for o, m, n, _ in jpeg_segments(data) if m in SOF and n >= 7), None)
    if "width" not in found and frame is not None:
        height, width = struct.unpack_from(">HH", data, frame + 5)
        found |= {"width": str(width), "height": str(height)}
    declared = {p: v for p, _, v in xmp(data)}
    for name, path in (("xmp_tool", "xmp:CreatorTool"), ("xmp_created", "xmp:CreateDate"), ("xmp_modified", "xmp:ModifyDate"), ("depth_format", "GDepth:Format"), ("depth_mime", "GDepth:Mime"), ("gain_map_version", "hdrgm:Version"), ("motion_photo", "GCamera:MotionPhoto"), ("motion_photo_version", "GCamera:MotionPhotoVersion")):
        if declared.get(path):
            found[name] = declared[path]
    return sorted(found.items())


#: Part of a namespace to the name of its directory; the first that fits counts (fixed values).
XMP_DIRECTORIES = (
    ("depthmap", "XMP GDepth"), ("google.com/photos/1.0/image", "XMP GImage"), ("google.com/photos/1.0/camera", "XMP GCamera"), ("hdr-gain-map", "XMP HDR Gain Map"), ("xap/1.0", "XMP Core"),
    ("dc/elements", "XMP Dublin Core"), ("photoshop", "XMP Photoshop"), ("tiff", "XMP TIFF"), ("exif", "XMP EXIF"),
)
_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"


def xmp_packets(data: bytes) -> tuple[bytes, bytes]:
    """The XMP packet of a JPEG and its extension, put together from chunks in the order of their offsets."""
    main, chunks = b"", {}
    for place, _, length, name in jpeg_segments(data, cap=len(data)):  # extensions are often longer than the header's limit
        body = data[place + 4 : place + 2 + length]
        if name == "XMP" and not main:
            main = body[29:]
        elif name == "XMP extension" and len(body) >= 75:
            chunks[int.from_bytes(body[71:75])] = body[75:]  # the last of an offset counts
    return main, b"".join(chunks[k] for k in sorted(chunks))


@safely
def xmp(data: bytes) -> list[tuple]:
    """(path, directory, value) of the properties in a JPEG's XMP packet and its extension; nested ones have a path."""
    from xml.etree import ElementTree

    out: list[tuple] = []
    for packet in xmp_packets(data):
        start, stop = packet.find(b"<"), packet.rfind(b">") + 1
        if start < 0 or b"<!DOCTYPE" in packet:
            continue
        names: dict[str, str] = {}
        try:
            for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(packet[start:stop]), ("start-ns",)):
                names.setdefault(uri, prefix)
            root = ElementTree.fromstring(packet[start:stop])
        except ElementTree.ParseError:
            continue

        def told(qualified: str, names=names) -> tuple[str, str]:
            uri, _, local = qualified[1:].partition("}")
            low = uri.lower()
            return f"{names.get(uri, 'ns')}:{local}", next((d for k, d in XMP_DIRECTORIES if k in low), "XMP")

        todo = [(d, "") for rdf in root.iter(f"{_RDF}RDF") for d in rdf.findall(f"{_RDF}Description")]
        while todo:
            node, path = todo.pop(0)
            for key, value in node.attrib.items():
                if key.startswith("{") and not key.startswith((_RDF, "{http://www.w3.org/XML")):
                    name, directory = told(key)
                    out.append((path + name, directory, value))
            for child in node:
                if child.tag.startswith(_RDF):
                    todo.append((child, path))
                    continue
                name, directory = told(child.tag)
                text = (child.text or "").strip()
                items = [(x.text or "").strip() for x in child.iter(f"{_RDF}li")]
                if text:
                    out.append((path + name, directory, text))
                elif any(items):
                    out += [(f"{path}{name}[{i}]", directory, x) for i, x in enumerate(items, 1) if x]
                todo += [(child, f"{path}{name}/")] if child.attrib or any(True for _ in child.iter(f"{_RDF}Description")) else []
    return out
