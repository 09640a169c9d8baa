"""Media columns: payloads as PNG in binary columns, read through checked zlib chunks and numpy unfiltering, with a low-frequency cosine-transform hash."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, with_struct

SIGNATURE = bytes([137, 80, 78, 71, 13, 10, 26, 10])
#: Bytes of a row of the image, and its samples: one channel of eight bits.
ROW = 192
PAD = 32
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: Bytes of images that are filtered or unfiltered at a time.
SLICE = 1 << 21


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows: np.ndarray, unit: int = 1, kind: int | None = None) -> np.ndarray:
    """Rows of samples as PNG filters them, each after its type: that of the least sum of absolute residuals, if not given."""
    x = rows.astype(np.int16)
    left, above, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, unit:], above[1:], corner[1:, unit:] = x[:, :-unit], x[:-1], x[:-1, :-unit]
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    least = np.full(len(rows), np.iinfo(np.int64).max)
    for k in range(5) if kind is None else (kind,):
        residual = (x - _guess(k, left, above, corner)).astype(np.uint8)
        cost = np.abs(residual.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
        better = cost < least
        least[better] = cost[better]
        out[better, 0], out[better, 1:] = k, residual[better]
    return out


def _guess(kind: int, left: np.ndarray, above: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What a filter type (none, sub, up, average, paeth) expects of samples with these neighbours (int16)."""
    if kind == 0:
        return np.zeros_like(left)
    if kind in (1, 2):
        return left if kind == 1 else above
    if kind == 3:
        return (left + above) >> 1
    if kind == 4:
        by_left, by_above = np.abs(above - corner), np.abs(left - corner)
        by_corner = np.abs(left + above - 2 * corner)
        return np.where((by_left <= by_above) & (by_left <= by_corner), left, np.where(by_above <= by_corner, above, corner))
    raise ValueError(f"unknown filter {kind}")


def encode_png(payload: bytes, row: int = ROW, filter_type: int | None = None, level: int = 6) -> bytes:
    """An 8-bit grey PNG whose rows are the payload's; its length must be a positive multiple of row.

    Each row takes the filter whose residuals are least, of all five types, unless one is given. Data goes out in several
    IDAT chunks, so none exceeds PNG's limit.
    """
    if not payload or len(payload) % row:
        raise ValueError("the payload must be whole rows")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, row)
    step, data, deflate = SLICE // row, [], zlib.compressobj(level)
    for at in range(0, len(rows), step):  # each slice sees the row above it
        data.append(deflate.compress(filtered(rows[max(at - 1, 0) : at + step], 1, filter_type)[1 if at else 0 :].tobytes()))
    data.append(deflate.flush())
    whole = b"".join(data)
    idat = b"".join(_chunk(b"IDAT", whole[i : i + (1 << 24)]) for i in range(0, len(whole), 1 << 24))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", row, len(rows), 8, 0, 0, 0, 0)) + idat + _chunk(b"IEND", b"")


def chunks(png: bytes):
    """(kind, body) of each chunk; a wrong signature, a cut file or a wrong checksum is an error."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("cut off in a chunk's head")
        n = int.from_bytes(png[at : at + 4], "big")
        kind, body, check = png[at + 4 : at + 8], png[at + 8 : at + 8 + n], png[at + 8 + n : at + 12 + n]
        if len(check) < 4:
            raise ValueError("cut off in a chunk")
        if zlib.crc32(png[at + 4 : at + 8 + n]) != int.from_bytes(check, "big"):
            raise ValueError(f"wrong checksum of {kind!r}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n
    raise ValueError("no end chunk")


def unfilter(raw: np.ndarray, unit: int) -> np.ndarray:
    """Undo PNG's filters: raw is rows of a filter type and samples; unit is the bytes of a pixel."""
    return unfilter_all([raw], unit)[0]


def unfilter_all(images: list[np.ndarray], unit: int) -> list[np.ndarray]:
    """unfilter of several images of one width at a time.

    A pixel needs those to its left, above it and above to the left, so the pixels of one anti-diagonal are undone
    together, for all images. Rows lie in the order of their height in their image; those that a diagonal crosses are a
    slice.
    """
    width = images[0].shape[1] - 1
    height = np.concatenate([np.arange(len(x)) for x in images])
    order = np.argsort(height, kind="stable")
    raw = np.concatenate(images)[order]
    kinds, height = raw[:, 0], height[order]
    if len(kinds) and kinds.max() > 4:
        raise ValueError(f"unknown filter {kinds.max()}")
    # the row above each row: one of zeros, in front, for the first ones; and each row has a pixel of zeros in front
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    begin = np.cumsum([0] + [len(x) for x in images])
    above = np.where(height == 0, 0, place[np.maximum(order - 1, 0)])
    span = width + unit
    flat = np.zeros(((len(order) + 1), span), np.uint8)
    flat[1:, unit:] = raw[:, 1:]
    flat = flat.ravel()
    tall = np.searchsorted(height, np.arange(int(height[-1]) + 2 if len(height) else 1))  # where each height begins
    here = np.arange(1, len(order) + 1) * span - height * unit  # the pixel in front of a row's, less the diagonals before it
    up = above * span - height * unit
    step = np.arange(unit)
    for d in range(width // unit + (int(height[-1]) if len(height) else 0)):
        lo, hi = tall[max(0, d - width // unit + 1)], tall[min(d + 1, len(tall) - 1)]
        if lo == hi:
            continue
        at = here[lo:hi] + d * unit
        over = up[lo:hi] + d * unit
        if unit > 1:
            at, over, kind = (at[:, None] + step).ravel(), (over[:, None] + step).ravel(), np.repeat(kinds[lo:hi], unit)
        else:
            kind = kinds[lo:hi]
        left, corner, top = flat[at].astype(np.int16), flat[over].astype(np.int16), flat[over + unit].astype(np.int16)
        guess = np.where(kind == 4, _guess(4, left, top, corner), np.where(kind == 3, (left + top) >> 1, np.where(kind == 1, left, np.where(kind == 2, top, np.int16(0)))))
        flat[at + unit] += guess.astype(np.uint8)
    rows = flat.reshape(-1, span)[place, unit:]
    return [rows[s:e] for s, e in zip(begin[:-1], begin[1:], strict=True)]


def _read(png: bytes) -> tuple[int, int, np.ndarray]:
    """Width and bytes of a pixel, and the filtered rows of an 8-bit PNG that isn't interlaced or paletted."""
    head, data, inflate = None, [], zlib.decompressobj()
    for kind, body in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(inflate.decompress(body))
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[4:] != (0, 0, 0):
        raise ValueError("unsupported PNG")
    data.append(inflate.flush())
    if not inflate.eof:
        raise ValueError("the image data ends early")
    width, height, unit = head[0], head[1], CHANNELS[head[3]]
    raw = np.frombuffer(b"".join(data), np.uint8)
    if len(raw) != height * (width * unit + 1):
        raise ValueError("the image data has another size")
    return width, unit, raw.reshape(height, -1)


def decode_png(png: bytes) -> np.ndarray:
    """Samples (height, width, channels) of an 8-bit PNG that isn't interlaced or paletted."""
    return decode_all([png])[0]


def decode_all(pngs: list[bytes]) -> list[np.ndarray]:
    """decode_png of several images; those of one shape of rows are unfiltered together, about SLICE bytes at a time."""
    read = [_read(p) for p in pngs]
    out: list = [None] * len(pngs)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (width, unit, _) in enumerate(read):
        groups.setdefault((width, unit), []).append(i)
    for (width, unit), members in groups.items():
        members.sort(key=lambda i: len(read[i][2]))  # alike in height, so diagonals are full
        at = 0
        while at < len(members):
            to, size = at, 0
            while to < len(members) and (to == at or size + read[members[to]][2].size <= SLICE):
                size += read[members[to]][2].size
                to += 1
            for i, rows in zip(members[at:to], unfilter_all([read[i][2] for i in members[at:to]], unit), strict=True):
                out[i] = rows.reshape(len(rows), width, unit)
            at = to
    return out


def filter_counts(png: bytes) -> list[int]:
    """How many rows of a PNG have each filter type."""
    return np.bincount(_read(png)[2][:, 0], minlength=5).tolist()


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5) * np.arange(k)[:, None])


COSINES = _cosines(32, 8)


def cosine_hash(image: np.ndarray) -> str:
    """64 bits in hex: which of the 8 x 8 lowest cosine coefficients of the image, averaged to 32 x 32, exceed their median.

    The median leaves out the constant term. Any size will do; short sides repeat rows or columns.
    """
    grey = image.mean(axis=2) if image.shape[2] > 1 else image[:, :, 0]

    def shrink(x: np.ndarray) -> np.ndarray:
        n = len(x)
        if n < 32:
            return x[np.arange(32) * n // 32].astype(np.float64)
        at = np.arange(32) * n // 32
        return np.add.reduceat(x, at, axis=0, dtype=np.float64) / np.diff(np.append(at, n))[:, None]

    low = COSINES @ shrink(shrink(grey).T).T @ COSINES.T
    flat = low.ravel().round(6)
    return np.packbits(flat > np.median(flat[1:])).tobytes().hex()


def payload_of(text: str | None, row: int = ROW) -> bytes:
    """UTF-8 bytes of the text (null: empty), filled with PAD to a positive multiple of row."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(row, -(-len(raw) // row) * row), bytes([PAD]))


def with_media(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with a struct column __media: n_bytes of the text and media, a PNG of it."""

    def make():
        def of(texts: list) -> list[list]:
            return [[len((t or "").encode("utf-8", "surrogatepass")) for t in texts], [encode_png(payload_of(t)) for t in texts]]

        return of

    return with_struct(docs, "__media", "n_bytes long, media binary", [F.col(column)], make)


def with_features(docs: DataFrame, column: str = "__media.media") -> DataFrame:
    """docs with a struct column __feature, computed from the stored bytes in a binary column.

    payload_bytes, payload_sha256 and tail_crc32 (of the last 16 bytes) describe the samples as read back, media_bytes
    and media_sha256 the stored form, feature is the cosine hash. Null media give nulls; broken media an error.
    """

    def one(png: bytes, image: np.ndarray) -> tuple:
        payload = image.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(image)

    def make():
        def of(media: list) -> list[list]:
            images = iter(decode_all([m for m in media if m is not None]))
            return [list(c) for c in zip(*[(None,) * 6 if m is None else one(m, next(images)) for m in media], strict=True)] or [[]] * 6

        return of

    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return with_struct(docs, "__feature", fields, [F.col(column)], make)


def media_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) a row of docs.

    The media are written to a table and read again; all but n_bytes comes from the stored bytes.
    """
    media = with_media(docs.select("doc_id", "text")).select("doc_id", F.col("__media.n_bytes").alias("n_bytes"), F.col("__media.media").alias("media"))
    return with_features(staged(media, "media", compression="none"), "media").select("doc_id", "n_bytes", "__feature.*")
