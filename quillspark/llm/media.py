"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, written as NPY tiles with difference hashes.

Decoders take bytes and return arrays of height x width x channels; they raise ValueError on bytes that are no such image.
`tiles` keeps such rows with null results and the reason in `error`. Null or empty text is one row of blanks in `text_media`.
Repeated rows give repeated results, and a null id stays null.
"""

from __future__ import annotations

import binascii
import hashlib
import io
import re
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import map_texts, table, texts_of

#: Bytes in a pixel row of a text's image: 64 pixels of three samples.
ROW_BYTES = 192
#: A stated size beyond this is taken for damage.
MOST_PIXELS = 1 << 28


def encode_ppm(pixels: np.ndarray) -> bytes:
    """Binary Netpbm: P5 for one channel, P6 for three."""
    h, w, c = pixels.shape
    return b"P%d\n%d %d\n255\n" % ({1: 5, 3: 6}[c], w, h) + pixels.astype(np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP without compression: rows from the bottom, blue first, rows padded to four bytes."""
    h, w, _ = pixels.shape
    rows = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, -1)
    body = rows.tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6; samples are scaled to 8 bits where the file's largest value is not 255."""
    head = re.match(rb"P([1-6])", data)
    if not head:
        raise ValueError("no Netpbm magic")
    kind, at, numbers = int(head[1]), 2, []
    while len(numbers) < (2 if kind in (1, 4) else 3):
        m = re.compile(rb"(?:\s+|#[^\n\r]*)*(\d+)").match(data, at)
        if not m:
            raise ValueError("Netpbm header is cut off")
        numbers.append(int(m[1]))
        at = m.end()
    w, h, top = numbers[0], numbers[1], numbers[2] if len(numbers) > 2 else 1
    channels = 3 if kind in (3, 6) else 1
    if not (w and h and 0 < top < 65536 and w * h <= MOST_PIXELS):
        raise ValueError("Netpbm size or largest value is out of range")
    if kind == 1:
        values = np.frombuffer(re.sub(rb"#[^\n\r]*|\s", b"", data[at:]), np.uint8)[: w * h] - 48
    elif kind in (2, 3):
        samples = re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[: w * h * channels]
        if not all(x.isdigit() and len(x) <= 9 for x in samples):
            raise ValueError("Netpbm samples are no numbers")
        values = np.array(samples, np.int64)
    elif kind == 4:
        stride = (w + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=at + 1)[: stride * h]
        if raw.size < stride * h:
            raise ValueError("Netpbm samples are cut off")
        values = np.unpackbits(raw.reshape(h, stride), axis=1)[:, :w].ravel()
    else:
        values = np.frombuffer(data[at + 1 : at + 1 + w * h * channels * (1 + (top > 255))], ">u2" if top > 255 else np.uint8)
    if values.size < w * h * channels:
        raise ValueError("Netpbm samples are cut off")
    if values.size and int(values.max()) > top:
        raise ValueError("Netpbm samples are above the largest value")
    if kind in (1, 4):
        values = 1 - values
    if top != 255:
        values = (values.astype(np.int64) * 255 + top // 2) // top
    return values.astype(np.uint8).reshape(h, w, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (with palette), 24 or 32 bits, rows from the bottom or the top."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("no BMP magic")
    start, size, w, h, _, bits, packed = struct.unpack("<I", data[10:14]) + struct.unpack("<IiiHHI", data[14:34])
    if packed or bits not in (8, 24, 32) or w <= 0 or not h or w * abs(h) > MOST_PIXELS or start > len(data):
        raise ValueError("BMP kind is not supported")
    stride = (bits * w // 8 + 3) // 4 * 4
    raw = np.frombuffer(data, np.uint8, offset=start)
    if raw.size < stride * abs(h):
        raise ValueError("BMP samples are cut off")
    rows = raw[: stride * abs(h)].reshape(abs(h), stride)[:, : bits * w // 8]
    if bits == 8:
        palette = np.frombuffer(data[14 + size : start], np.uint8).reshape(-1, 4)[:, 2::-1]
        pixels = palette[rows]
    else:
        pixels = rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(pixels[::-1] if h > 0 else pixels)


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target pixel's area, fractions of border pixels included, from sums over rectangles."""
    h, w, c = pixels.shape
    sums = np.zeros((h + 1, w + 1, c))
    np.cumsum(np.cumsum(pixels, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])

    def at(edges, axis):
        low = np.minimum(edges.astype(np.int64), sums.shape[axis] - 2)
        share = (edges - low).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
        return low, share

    y, dy = at(np.arange(height + 1) * h / height, 0)
    x, dx = at(np.arange(width + 1) * w / width, 1)
    tall = sums[y] * (1 - dy) + sums[y + 1] * dy
    both = tall[:, x] * (1 - dx) + tall[:, x + 1] * dx
    return (both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]) * (height * width / (h * w))


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits: whether brightness rises from each of 8 x 9 areas to its right neighbour."""
    small = np.round(area_resize(pixels.mean(axis=2, keepdims=True), 8, 9)[:, :, 0], 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(pixels: np.ndarray, size: int) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(pixels, size, size)), 0, 255).astype(np.uint8))
    return out.getvalue()


def tiles(media: DataFrame, size: int = 16) -> DataFrame:
    """media_id, media (binary) to media_id, height, width, channels, dhash, tile (NPY bytes), error."""

    def start():
        def one(data):
            try:
                p = decode(data if data is not None else b"")
                return *p.shape, difference_hash(p), npy_tile(p, size), None
            except (ValueError, IndexError, OverflowError, struct.error) as e:
                return None, None, None, None, None, str(e)

        def work(media_id, media):
            cols = list(zip(*map(one, media), strict=True))
            return dict(zip(("media_id", "height", "width", "channels", "dhash", "tile", "error"), (media_id, *map(list, cols)), strict=True))

        return work

    return map_texts(media.select(media["media_id"].cast("long").alias("media_id"), media["media"].cast("binary").alias("media")), start, "media_id long, height int, width int, channels int, dhash string, tile binary, error string")


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b" " * (max(ROW_BYTES, -(-len(raw) // ROW_BYTES) * ROW_BYTES) - len(raw))


def text_media(docs: DataFrame, form: str = "ppm", tile: int = 16) -> DataFrame:
    """Store each whole text as an image, read the stored bytes back, and return what was read with its features.

    doc_id, n_bytes, payload (read back), media (stored form), dhash, tile. form: ppm or bmp.
    """
    store = {"ppm": encode_ppm, "bmp": encode_bmp}[form]

    def start():
        def work(doc_id, text):
            out = {"doc_id": doc_id, "n_bytes": [], "payload": [], "media": [], "dhash": [], "tile": []}
            for x in text:
                n, payload = payload_of(x)
                media = store(np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3))
                pixels = decode(media)
                for k, v in (("n_bytes", n), ("payload", pixels.tobytes()), ("media", media), ("dhash", difference_hash(pixels)), ("tile", npy_tile(pixels, tile))):
                    out[k].append(v)
            return out

        return work

    return map_texts(texts_of(docs), start, "doc_id long, n_bytes long, payload binary, media binary, dhash string, tile binary")


def media_digests(docs: DataFrame, form: str = "ppm", tile: int = 16) -> DataFrame:
    """text_media with digests in place of bytes, made within the task so that no image leaves it.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, tile_sha256.
    """
    store = {"ppm": encode_ppm, "bmp": encode_bmp}[form]
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256")

    def start():
        def one(x):
            n, payload = payload_of(x)
            media = store(np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3))
            pixels = decode(media)
            back = pixels.tobytes()
            sha = lambda b: hashlib.sha256(b).hexdigest()
            return n, len(back), sha(back), binascii.crc32(back[-16:]), len(media), sha(media), difference_hash(pixels), sha(npy_tile(pixels, tile))

        def work(doc_id, text):
            return {"doc_id": doc_id} | dict(zip(names, map(list, zip(*map(one, text), strict=True)), strict=True))

        return work

    return map_texts(texts_of(docs), start, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
