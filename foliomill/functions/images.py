"""Image headers, read by the structure their formats define.

PNG is a list of chunks of which the first is the header, GIF begins with a screen
descriptor, JPEG is a list of marked segments, WebP a RIFF container of chunks. Nothing
is read beyond the end of the data; what doesn't follow its format has no dimensions.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: JPEG markers without a length, those that begin a frame, and the scan.
_BARE = frozenset((0x01, *range(0xD0, 0xD9)))
_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
_SCAN, _END = 0xDA, 0xD9
_PNG = b"\x89PNG\r\n\x1a\n"


def jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, content) of the segments before the first scan. Bytes between segments
    are skipped up to the next marker."""
    mark = data.find(b"\xff", 2)
    while 0 <= mark < len(data) - 3:
        kind = data[mark + 1]
        if kind in (0x00, 0xFF) or kind in _BARE:
            mark = data.find(b"\xff", mark + (1 if kind == 0xFF else 2))
            continue
        if kind in (_SCAN, _END):
            return
        (size,) = struct.unpack_from(">H", data, mark + 2)
        yield kind, data[mark + 4 : mark + 2 + size]
        mark = data.find(b"\xff", mark + 2 + max(size, 2))


def jpeg_frame(data: bytes) -> tuple[int, int, int]:
    """(width, height, components) of a JPEG file; zeros without a whole frame header."""
    for kind, content in jpeg_segments(data):
        if kind in _FRAMES and len(content) >= 6:
            _, height, width, parts = struct.unpack_from(">BHHB", content)
            return width, height, parts
    return 0, 0, 0


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, content) of the whole chunks of a PNG file."""
    at = len(_PNG) if data.startswith(_PNG) else len(data)
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 8 + size > len(data):
            return
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _png(data: bytes) -> tuple[int, int]:
    kind, content = next(png_chunks(data), (b"", b""))
    return struct.unpack_from(">II", content) if kind == b"IHDR" and len(content) >= 8 else (0, 0)


def _gif(data: bytes) -> tuple[int, int]:
    return struct.unpack_from("<HH", data, 6) if data.startswith(b"GIF8") and len(data) > 10 else (0, 0)


def _webp(data: bytes) -> tuple[int, int]:
    """The first chunk that tells: extended canvas, lossy key frame or lossless header."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        return 0, 0
    at = 12
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        body = data[at + 8 : at + 8 + max(size, 10)]  # a header stands there whatever size is said
        if kind == b"VP8X" and len(body) >= 10:
            sides = body[4:7], body[7:10]
            return tuple(int.from_bytes(x, "little") + 1 for x in sides)
        if kind == b"VP8 " and len(body) >= 10:
            return tuple(x % (1 << 14) for x in struct.unpack_from("<HH", body, 6))
        if kind == b"VP8L" and len(body) >= 5:
            (bits,) = struct.unpack_from("<I", body, 1)
            return bits % (1 << 14) + 1, (bits >> 14) % (1 << 14) + 1
        at += 8 + size + size % 2
    return 0, 0


_READERS = {"image/png": _png, "image/gif": _gif, "image/jpeg": lambda data: jpeg_frame(data)[:2], "image/webp": _webp}


def dimensions(data: bytes | None, mime: str | None) -> tuple[int, int]:
    """(width, height) by the header; zeros for unknown, short and broken data."""
    read = _READERS.get(mime or "")
    return read(data) if read and data else (0, 0)


def png_pixels(data: bytes) -> tuple[dict, list[bytes]] | None:
    """What a page description needs of a PNG file: its header fields with the palette, and
    its compressed rows, followed by the alpha rows where it has any. None for
    interlaced, broken and unusual files."""
    header, rows, palette = b"", [], b""
    for kind, content in png_chunks(data):
        if kind == b"IHDR":
            header = content
        elif kind == b"PLTE":
            palette = content
        elif kind == b"IDAT":
            rows.append(content)
    if len(header) < 13 or not rows:
        return None
    width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", header[:13])
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if interlaced or not samples or not width or not height or (colour == 3 and not palette):
        return None
    try:
        raw = zlib.decompress(b"".join(rows))
    except zlib.error:
        return None
    if len(raw) != height * (1 + (width * samples * bits + 7) // 8):
        return None
    facts = {"width": width, "height": height, "bits": bits, "samples": samples, "palette": palette}
    if samples in (1, 3):
        return facts, [b"".join(rows)]
    if bits != 8:
        return None
    pixels = _unfiltered(raw, width * samples, height, samples).reshape(height, width, samples)
    parts = pixels[:, :, : samples - 1], pixels[:, :, samples - 1 :]
    return facts | {"samples": samples - 1}, [zlib.compress(np.ascontiguousarray(x).tobytes(), 6) for x in parts]


def _unfiltered(raw: bytes, stride: int, height: int, step: int) -> np.ndarray:
    """The rows of a PNG image without their line filters."""
    lines = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)
    for k in range(height):
        kind, line, above = lines[k, 0], lines[k, 1:], out[k]
        if kind == 0:
            out[k + 1] = line
        elif kind == 1:  # each sample adds the one of the pixel before
            out[k + 1] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            out[k + 1] = line + above
        else:
            row, up = out[k + 1], above.astype(int)
            for x in range(stride):
                left = int(row[x - step]) if x >= step else 0
                corner = int(up[x - step]) if x >= step else 0
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    options = ((abs(up[x] - corner), left), (abs(left - corner), int(up[x])), (abs(left + up[x] - 2 * corner), corner))
                    guess = min(options, key=lambda o: o[0])[1]
                row[x] = (int(line[x]) + guess) & 0xFF
    return out[1:]
