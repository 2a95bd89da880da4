"""Images and videos embedded in JPEG files: by multi-picture index, after the end, or in XMP."""

from __future__ import annotations

import base64
import binascii
import struct

from . import containers

#: Type of an artifact to the end of its file's name, and media type to extension (fixed values).
SUFFIXES = {"MotionPhotoVideo": "motion_photo", "DepthMap": "depth_map", "GainMap": "gain_map", "SecondaryImage": "secondary_image", "ExifThumbnail": "exif_thumbnail"}
EXTENSIONS = {"video/mp4": ".mp4", "image/jpeg": ".jpg", "image/png": ".png"}
#: What a property declares, by directory and name; else by a part of its path, where nothing was declared so (fixed values).
DECLARED = {("XMP GDepth", "Format"): "DepthMap", ("XMP GImage", "Mime"): "SecondaryImage", ("XMP HDR Gain Map", "Version"): "GainMap", ("XMP GCamera", "MotionPhoto"): "MotionPhotoVideo"}
HINTS = (("depth", "DepthMap"), ("gimage", "SecondaryImage"), ("gainmap", "GainMap"), ("hdrgm", "GainMap"), ("motionphoto", "MotionPhotoVideo"), ("microvideo", "MotionPhotoVideo"))
#: Name, media type and confidence of what is only declared (fixed values).
ONLY_DECLARED = {
    "DepthMap": ("Depth map (XMP declared, not yet extracted)", "image/jpeg", 70),
    "GainMap": ("HDR gain map (XMP declared, not yet extracted)", "image/jpeg", 70),
    "SecondaryImage": ("Secondary image (XMP declared)", "image/jpeg", 65),
    "MotionPhotoVideo": ("Motion photo video (XMP declared, not located)", "video/mp4", 65),
}
#: Name of a located image by type: in the index, and after the end (fixed values).
LOCATED = {"DepthMap": ("Depth map (MPF)", "Depth map"), "GainMap": ("HDR gain map (MPF)", "HDR gain map"), "SecondaryImage": ("Secondary image (MPF)", "Secondary JPEG image")}
#: Directory of a property Data to type, name and confidence of what it holds in base64 (fixed values).
ENCODED = {"XMP GDepth": ("DepthMap", "Depth map (XMP base64)", 92), "XMP GImage": ("SecondaryImage", "Secondary image (XMP base64)", 90)}


def multi_pictures(data: bytes) -> list[tuple[int, int]]:
    """(offset in the file, size) of the pictures but the first that a multi-picture index names; a size of 0 is unknown.

    As the public format has it, offsets count from the index's own header.
    """
    out: list[tuple[int, int]] = []
    for place, _, _, name in containers.jpeg_segments(data, cap=len(data)):
        if name != "MPF":
            continue
        base = place + 8
        order = "<" if data[base : base + 2] == b"II" else ">"
        try:
            (at,) = struct.unpack_from(f"{order}I", data, base + 4)
            (n,) = struct.unpack_from(f"{order}H", data, base + at)
            tags = {t: (c, v) for t, _, c, v in (struct.unpack_from(f"{order}HHII", data, base + at + 2 + 12 * i) for i in range(n))}
            count, table = tags[0xB001][1], base + tags[0xB002][1]
            for i in range(1, count):
                _, size, offset = struct.unpack_from(f"{order}III", data, table + 16 * i)
                if offset:
                    out.append((base + offset, size))
        except (struct.error, KeyError):
            continue  # what stood before the damage counts
    return out


def declared_types(properties: list[tuple]) -> set[str]:
    """Types of artifacts that XMP properties declare."""
    found = {DECLARED[key] for path, directory, _ in properties if (key := (directory, path.rpartition(":")[2])) in DECLARED}
    return found or {kind for path, _, _ in properties if (kind := next((k for h, k in HINTS if h in path.lower()), None))}


def _image_type(declared: set[str]) -> str:
    return next((k for k in ("DepthMap", "GainMap") if k in declared), "SecondaryImage")


def _media_type(data: bytes) -> str:
    return "image/jpeg" if data[:3] == b"\xff\xd8\xff" else "image/png" if data[:4] == b"\x89PNG" and len(data) >= 8 else "application/octet-stream"


@containers.safely
def embedded(data: bytes) -> list[tuple]:
    """(type, name, offset, length, media type, confidence, payload) of what a JPEG holds besides its image.

    What stands in the file has an offset, what XMP holds in base64 a payload, and what is only
    declared neither; a declared type goes where one of that type is at hand.
    """
    if data[:3] != b"\xff\xd8\xff" or len(data) < 4:
        return []
    properties = containers.xmp(data)
    declared = declared_types(properties)
    out: list[tuple] = []
    pictures = multi_pictures(data)
    for offset, size in pictures:
        if offset < len(data):
            kind = _image_type(declared)
            out.append((kind, LOCATED[kind][0], offset, size or len(data) - offset, "image/jpeg", 88, None))
            declared.discard(kind)
    end = containers.jpeg_end(data, 0, cap=len(data))
    rest = len(data) - end if end else 0
    if rest >= 4 and all(offset != end for offset, _ in pictures):
        if data.startswith(b"\xff\xd8\xff", end):
            kind = _image_type(declared)
            out.append((kind, LOCATED[kind][1], end, rest, "image/jpeg", 80 if kind == "SecondaryImage" else 90, None))
        elif data[end + 4 : end + 8] == b"ftyp":
            kind = "MotionPhotoVideo"
            out.append((kind, "Embedded motion photo video", end, rest, "video/mp4", 90, None))
        else:
            kind = "Unknown"
            out.append((kind, f"Unknown trailing data ({rest:,} bytes)", end, rest, None, 70, None))
        declared.discard(kind)
    at_hand = {row[0] for row in out}
    for directory, (kind, name, confidence) in ENCODED.items():
        text = next((v for p, d, v in properties if d == directory and p.rpartition(":")[2] == "Data"), "")
        try:
            payload = base64.b64decode("".join(text.split()), validate=True)
        except (binascii.Error, ValueError):
            continue
        if payload and kind not in at_hand:
            out.append((kind, name, None, len(payload), _media_type(payload), confidence, payload))
            at_hand.add(kind)
    return out + [(kind, name, None, None, media, confidence, None) for kind, (name, media, confidence) in ONLY_DECLARED.items() if kind in declared - at_hand]
