"""Baseline JPEG: parsing, Huffman decoding and DC-only luminance thumbnails in numpy, and a
writer that keeps any bytes without loss as the flat 8x8 blocks of a grey image."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import slices, texts, widened

#: Blocks in a row of a payload image, and between two restart markers.
ROW_BLOCKS = 64
#: Payload bytes, and blocks, that are coded at once: a long text takes more rounds, not more memory.
CHUNK = 1 << 20
MAX_SIDE_BLOCKS = 65535 // 8
# Code lengths and symbols of the usual luminance DC table of baseline JPEG.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))


def huffman_codes(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a table as JPEG stores it: counts by length, then symbols."""
    out, code, k = {}, 0, 0
    for size, count in enumerate(lengths, 1):
        for _ in range(count):
            out[symbols[k]] = (code, size)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def huffman_lookup(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """For every 16-bit window: symbol << 5 | code length; 0 where no code starts."""
    out = np.zeros(65536, np.int32)
    for symbol, (code, size) in huffman_codes(lengths, symbols).items():
        out[code << (16 - size) : (code + 1) << (16 - size)] = symbol << 5 | size
    return out


@dataclass
class Image:
    """What the markers of one baseline JPEG say, and its entropy-coded segments."""

    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # (h, v, quantiser of DC, DC table, AC table)
    restart: int = 0
    segments: list = field(default_factory=list)


def parse(data: bytes) -> Image:
    """Markers of a baseline JPEG with one scan over all components (others raise ValueError)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    out, i, quant, tables, frame = Image(), 2, {}, {}, {}
    while i + 4 <= len(data):
        if data[i] != 0xFF:
            raise ValueError("marker expected")
        marker = data[i + 1]
        if marker == 0xFF:
            i += 1
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[i + 2 : i + 4], "big")
        body, i = data[i + 4 : i + 2 + size], i + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                lengths = tuple(body[1:17])
                tables[body[0]] = (lengths, tuple(body[17 : 17 + sum(lengths)]))
                body = body[17 + sum(lengths) :]
        elif marker == 0xC0:
            out.height, out.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])}
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not baseline")
        elif marker == 0xDD:
            out.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if body[0] != len(frame):
                raise ValueError("more than one scan")
            for k in range(body[0]):
                h, v, q = frame[body[1 + 2 * k]]
                use = body[2 + 2 * k]
                out.components.append((h, v, quant[q], tables[use >> 4], tables[16 | use & 15]))
            if len(out.components) == 1:
                out.components[0] = (1, 1, *out.components[0][2:])
            end = data.rfind(b"\xff\xd9")
            scan = data[i : end if end >= i else len(data)]
            out.segments = [x.replace(b"\xff\x00", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", scan)]
            return out
    raise ValueError("no scan")


def _blocks(img: Image) -> tuple[int, int, list[int]]:
    """MCUs across and down, and the component of each block of an MCU."""
    h, v = max(c[0] for c in img.components), max(c[1] for c in img.components)
    order = [k for k, c in enumerate(img.components) for _ in range(c[0] * c[1])]
    return -(-img.width // (8 * h)), -(-img.height // (8 * v)), order


def dc_planes(images: list[Image]) -> list[np.ndarray]:
    """DC-only luminance thumbnail of each image: a sample for each block, 0 to 255.

    All restart segments of all images are decoded side by side. A step takes, in every segment
    that is not at its end, the DC difference of a block that begins, and one AC run to skip.
    """
    lookups: dict[tuple, int] = {}
    stack: list[np.ndarray] = []

    def lookup(table: tuple) -> int:
        if table not in lookups:
            lookups[table] = len(stack)
            stack.append(huffman_lookup(*table))
        return lookups[table]

    layouts: dict[tuple, int] = {}
    dc_of, ac_of, comp_of, sizes = [], [], [], []
    lanes_layout, lanes_blocks, lanes_out, data, firsts, at = [], [], [], [], [], 0
    for img in images:
        across, down, order = _blocks(img)
        key = tuple((lookup(img.components[k][3]), lookup(img.components[k][4]), k) for k in order)
        if key not in layouts:
            layouts[key] = len(sizes)
            sizes.append(len(order))
            dc_of.append([x[0] for x in key]), ac_of.append([x[1] for x in key]), comp_of.append([x[2] for x in key])
        total, step = across * down, img.restart or across * down
        firsts.append(at)
        for k, seg in enumerate(img.segments[: -(-total // step)]):
            n = min(step, total - k * step) * len(order)
            lanes_layout.append(layouts[key]), lanes_blocks.append(n), lanes_out.append(at + k * step * len(order)), data.append(seg)
        at += total * len(order)
    width = max(map(len, dc_of))
    pad = lambda rows: np.array([r + [0] * (width - len(r)) for r in rows])
    codes = pad(dc_of) << 16, pad(ac_of) << 16, pad(comp_of), np.array(sizes), np.concatenate(stack).astype(np.int64)
    out = np.zeros(at, np.int32)
    for lanes in _runs(lanes_blocks):
        _decode(data[lanes], lanes_layout[lanes], lanes_blocks[lanes], lanes_out[lanes], codes, out)
    return [_thumbnail(img, out[first:]) for img, first in zip(images, firsts)]


def _decode(data: list[bytes], lanes_layout: list[int], lanes_blocks: list[int], lanes_out: list[int], codes: tuple, out: np.ndarray) -> None:
    """DC values of the blocks of some restart segments, put where they belong in out."""
    dc_of, ac_of, comp_of, per, tables = codes
    width = dc_of.shape[1]
    lengths = np.array([len(x) + 8 for x in data])
    raw = np.frombuffer(b"".join(x + b"\xff" * 8 for x in data) + b"\xff" * 8, np.uint8).astype(np.uint32)
    words = (raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]).astype(np.int64)
    broken = False
    pos = 8 * (np.cumsum(lengths) - lengths)
    end = pos + 8 * (lengths - 4)
    layout, left, put = np.array(lanes_layout), np.array(lanes_blocks), np.array(lanes_out)
    j, k = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)  # block of the MCU, coefficient
    pred = np.zeros((len(pos), comp_of.max() + 1), np.int64)
    while len(pos):
        d = np.flatnonzero(k == 0)
        if len(d):
            own = slice(None) if len(d) == len(pos) else d
            at_bit, kind, part = pos[own], layout[own], j[own]
            entry = tables[dc_of[kind, part] | words[at_bit >> 3] >> (16 - (at_bit & 7)) & 0xFFFF]
            broken = (entry == 0).any()
            at_bit += entry & 31
            bits = entry >> 5
            v = words[at_bit >> 3] << (at_bit & 7) >> (32 - bits) & ((1 << bits) - 1)
            v -= ((v << 1 >> bits) == 0) * ((1 << bits) - 1)  # a first bit of 0 means below zero
            pos[own] = at_bit + bits
            c = comp_of[kind, part]
            pred[d, c] += v
            out[put[own]] = pred[d, c]
            k[own] = 1
        entry = tables[ac_of[layout, j] | words[pos >> 3] >> (16 - (pos & 7)) & 0xFFFF]
        size, symbol = entry & 31, entry >> 5
        pos += size + (symbol & 15)
        k += np.where(symbol, (symbol >> 4) + 1, 64)
        done = k >= 64
        put += done
        left -= done
        if width > 1:
            j = np.where(done, (j + 1) % per[layout], j)
        k *= ~done
        if broken or (size == 0).any() or (pos > end).any():
            raise ValueError("broken scan")
        if not left.all():
            live = left > 0
            pos, end, layout, left, put, j, k, pred = (x[live] for x in (pos, end, layout, left, put, j, k, pred))


def _thumbnail(img: Image, values: np.ndarray) -> np.ndarray:
    """Samples of the luminance blocks of an image, from the DC values of all its blocks in order."""
    across, down, order = _blocks(img)
    h, v, q = img.components[0][:3]
    wide, high = -(-img.width // 8), -(-img.height // 8)
    if len(img.components) > 1:  # luminance may have less than one block for eight pixels
        most_h, most_v = max(c[0] for c in img.components), max(c[1] for c in img.components)
        wide, high = -(-img.width * h // (8 * most_h)), -(-img.height * v // (8 * most_v))
    out = np.empty((high, wide), np.uint8)
    step = max(1, CHUNK // (across * len(order)))
    for row in range(0, down, step):
        rows = min(step, down - row)
        own = values[row * across * len(order) : (row + rows) * across * len(order)].reshape(rows, across, len(order))[:, :, : h * v]
        plane = own.reshape(rows, across, v, h).transpose(0, 2, 1, 3).reshape(rows * v, across * h)[: max(0, high - row * v), :wide]
        out[row * v : row * v + len(plane)] = np.clip((plane.astype(np.int64) * q + 4) // 8 + 128, 0, 255)
    return out


def thumbnail_hash(plane: np.ndarray) -> str:
    """64 bits, as 16 hex digits: which cells of an 8x8 grid are over the mean of all cells."""
    rows = np.arange(9) * plane.shape[0] / 8
    cols = np.arange(9) * plane.shape[1] / 8
    total = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1), np.int64)
    total[1:, 1:] = plane.astype(np.int64).cumsum(0).cumsum(1)
    lo, hi = np.floor(rows[:-1]).astype(int), np.maximum(np.ceil(rows[1:]), 1).astype(int)
    le, ri = np.floor(cols[:-1]).astype(int), np.maximum(np.ceil(cols[1:]), 1).astype(int)
    cells = (total[np.ix_(hi, ri)] - total[np.ix_(lo, ri)] - total[np.ix_(hi, le)] + total[np.ix_(lo, le)]) / ((hi - lo)[:, None] * (ri - le)[None, :])
    return np.packbits((cells > cells.mean()).ravel()).tobytes().hex()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


#: Each DC difference from -255 to 255, with the one-bit code that ends the block: bits, length.
_DC = huffman_codes(DC_LENGTHS, DC_SYMBOLS)
_SIZES = [abs(d).bit_length() for d in range(-255, 256)]
_BITS = np.array([(_DC[s][0] << s | (d if d > 0 else d + (1 << s) - 1 if d else 0)) << 1 for d, s in zip(range(-255, 256), _SIZES)], np.int64)
_LENGTHS = np.array([_DC[s][1] + s + 1 for s in _SIZES], np.int64)


def _layout(n: int) -> tuple[int, int, int]:
    """Groups of 64 blocks in a row of an image, and rows, that hold n groups; images back to back.

    Sides that divide evenly come first. Where none within the limits do, the last rows are filled
    up: a reader that knows the payload's length cuts them off. What exceeds one image goes to
    several of the full width.
    """
    most = MAX_SIDE_BLOCKS // ROW_BLOCKS
    if n > most * MAX_SIDE_BLOCKS:
        rows = -(-n // most)
        return most, rows, -(-rows // MAX_SIDE_BLOCKS)
    least = -(-n // MAX_SIDE_BLOCKS)
    across = next((a for a in range(least, most + 1) if n % a == 0), least)
    return across, -(-n // across), 1


def _encoded(payload: np.ndarray) -> list[bytes]:
    """Restart segments of a payload, each of 64 bytes."""
    data = payload.astype(np.int64)
    prev = np.concatenate(([128], data[:-1]))
    prev[::64] = 128
    diff = data - prev + 255
    size, code = _LENGTHS[diff].reshape(-1, 64), _BITS[diff].reshape(-1, 64)
    begin = np.cumsum(size, axis=1) - size
    bits = begin[:, -1] + size[:, -1]
    whole = (bits + 7) // 8
    starts = np.cumsum(whole) - whole
    offset = (8 * starts)[:, None] + begin
    shifted = code << (32 - size - (offset & 7))
    first = offset >> 3
    buffer = np.zeros(int(whole.sum()) + 4, np.int64)
    for k in range(4):
        part = shifted >> (24 - 8 * k) & 0xFF
        buffer += np.bincount((first + k).ravel(), weights=part.ravel(), minlength=len(buffer))[: len(buffer)].astype(np.int64)
    spare = 8 * whole - bits
    buffer[starts + whole - 1] |= (1 << spare) - 1
    scan = buffer.astype(np.uint8).tobytes()
    return [scan[a : a + n].replace(b"\xff", b"\xff\x00") for a, n in zip(starts.tolist(), whole.tolist())]


def write_payloads(payloads: list[bytes]) -> list[bytes]:
    """Grey baseline JPEG of each payload (its length a positive multiple of 64), or several back
    to back if it does not fit one; see _layout for the zero bytes that may follow it there. Each
    byte is the level of a flat 8x8 block: with a DC quantiser of 8 its one coefficient is the byte
    less 128, so nothing is lost. A restart marker ends every 64."""
    layouts = [_layout(len(p) // 64) for p in payloads]
    payloads = [p + bytes(64 * across * rows - len(p)) for p, (across, rows, _) in zip(payloads, layouts)]
    joined = b"".join(payloads)
    stuffed = [x for at in range(0, len(joined), CHUNK) for x in _encoded(np.frombuffer(joined, np.uint8, min(CHUNK, len(joined) - at), at))]
    out, k = [], 0
    for across, rows, images in layouts:
        media = b""
        for first in range(0, images * MAX_SIDE_BLOCKS, MAX_SIDE_BLOCKS):
            high = min(rows - first, MAX_SIDE_BLOCKS)
            n = across * high
            segments = stuffed[k : k + n]
            k += n
            frame = bytes([8]) + (8 * high).to_bytes(2, "big") + (8 * ROW_BLOCKS * across).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
            body = bytearray()
            for i, s in enumerate(segments):
                body += s if i == n - 1 else s + bytes([0xFF, 0xD0 + i % 8])
            media += b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([8]) + bytes([1] * 63)) + _segment(0xC0, frame) + _segment(0xC4, bytes([0, *DC_LENGTHS, *DC_SYMBOLS])) + _segment(0xC4, bytes([0x10, 1] + [0] * 15 + [0])) + _segment(0xDD, (64).to_bytes(2, "big")) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + bytes(body) + b"\xff\xd9"
        out.append(media)
    return out


def images_of(media: bytes) -> list[bytes]:
    """The JPEGs that lie back to back in media: an end marker and a start marker divide them."""
    parts = media.split(b"\xff\xd9\xff\xd8")
    return [(b"\xff\xd8" if i else b"") + p + (b"\xff\xd9" if i < len(parts) - 1 else b"") for i, p in enumerate(parts)]


def _runs(sizes: list[int], most: int = 1 << 20) -> Iterator[slice]:
    """Runs of rows of about so many bytes."""
    a, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most or i == len(sizes) - 1:
            yield slice(a, i + 1)
            a, held = i + 1, 0


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every whole text, padded with zero bytes to a positive multiple
    of 64, as a JPEG. Null and empty texts are 64 zero bytes. n_bytes says where the text ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts(b.column(1))]
            padded = [r + bytes(-len(r) % 64 if r else 64) for r in raw]
            media = [m for s in _runs([len(p) for p in padded]) for m in write_payloads(padded[s])]
            yield pa.record_batch([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def thumbnails(df: DataFrame, column: str = "media") -> DataFrame:
    """All columns of df with width, height, thumbnail (DC-only luminance samples, row by row) and
    thumbnail_hash. Null media and what is no baseline JPEG of one whole scan give nulls there.
    Grey JPEGs of one width back to back are one image, each below the one before. Columns of these
    names are replaced."""
    new = ["width", "height", "thumbnail", "thumbnail_hash"]
    kept = df.drop(*(c for c in new if c != column))
    at = kept.columns.index(column)

    def one_by_one(images: list[Image | None]) -> list[np.ndarray | None]:
        try:
            good = [i for i in images if i is not None]
            planes = iter(dc_planes(good) if good else [])
            return [None if i is None else next(planes) for i in images]
        except (ValueError, IndexError):
            if len(images) == 1:
                return [None]
            return [x for i in images for x in one_by_one([i])]

    def read(data: bytes | None) -> Image | None:
        try:
            img = parse(data or b"")
            return img if img.width and img.height else None
        except (ValueError, KeyError, IndexError):
            return None

    def read_all(data: bytes | None) -> list[Image | None]:
        parts = [read(x) for x in images_of(data or b"")]
        stacked = len(parts) == 1 or None not in parts and len({p.width for p in parts}) == 1 and all(len(p.components) == 1 for p in parts)
        return parts if stacked else [read(data)]

    def joined(images: list[Image | None], planes: list[np.ndarray | None]) -> tuple:
        if any(p is None for p in planes):
            return (None,) * 4
        plane = np.concatenate(planes)
        return images[0].width, sum(i.height for i in images), plane.tobytes(), thumbnail_hash(plane)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data = b.column(at).to_pylist()
            rows = []
            for s in _runs([len(x or b"") for x in data]):
                groups = [read_all(x) for x in data[s]]
                planes = iter(one_by_one([i for g in groups for i in g]))
                rows += [joined(g, [next(planes) for _ in g]) for g in groups]
            w, h, t, d = zip(*rows) if rows else ((),) * 4
            yield pa.record_batch([*b.columns, pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(t, pa.binary()), pa.array(d, pa.string())], names=[*b.schema.names, *new])

    return kept.mapInArrow(run, widened(kept, "width int, height int, thumbnail binary, thumbnail_hash string"))


def report(docs: DataFrame) -> DataFrame:
    """Digests of stored texts: the payload is the thumbnail read back from the stored JPEG."""
    t = thumbnails(store(docs))

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sizes, media = b.column(1).to_pylist(), b.column(3).to_pylist()
            payload = [p[: n + -n % 64 if n else 64] for n, p in zip(sizes, b.column(2).to_pylist())]
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array([len(p) for p in payload], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payload]), pa.array([zlib.crc32(p[-64:]) for p in payload], pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), b.column(4)],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    feature = F.format_string("%dx%d:%s", "width", "height", "thumbnail_hash").alias("feature")
    return t.select("doc_id", "n_bytes", F.col("thumbnail").alias("payload"), "media", feature).mapInArrow(tail, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
