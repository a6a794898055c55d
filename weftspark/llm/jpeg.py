"""Media columns as baseline JPEG, and their luminance thumbnails without an inverse DCT.

``encode`` stores any bytes losslessly in a valid greyscale baseline JPEG: each byte is the DC value of one 8x8 block
(quantiser 8, all AC zero), so the block is flat and has the byte as its luminance.  ``thumbnails`` reads baseline
JPEGs: it parses the markers, Huffman-decodes the scan with the file's own tables, keeps the DC values and gives one
luminance sample per block.  Both work on whole batches in numpy: every restart interval of every image is a lane, and
all lanes decode their next block in one step.

The reader takes any one-component 8-bit baseline image with any tables and AC coefficients.  Without restart markers
an image is one lane, which is right but slow.

A payload of more than ``IMAGE`` bytes becomes several images, one after another, which are written and read one at a
time, so that a long text needs no more memory than a batch of short ones beside the text itself.

Defined cases: a null text is empty; the payload is padded with spaces to a positive multiple of 192 bytes; equal texts
give equal results, so repeated rows do; a null doc_id stays null; an empty table gives an empty one; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ship

#: Blocks in a restart interval, and the largest image side in blocks (65,535 samples; a multiple of the interval).
INTERVAL, SIDE = 24, 8184
#: Payload bytes encoded or decoded at once, and of the images that a longer payload is cut into (a multiple of PAD).
CHUNK, IMAGE = 1 << 20, 5184 * 192
PAD = 192

# The zigzag-ordered quantiser (8 for DC, 1 else) and Huffman tables whose DC codes plus extra bits are all 9 bits long.
_QUANT = bytes([8] + [1] * 63)
_DC_SYMBOLS = [8, 7, 6, 5, 4, 3, 2, 1, 0]
_DC_COUNTS = bytes([1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
_AC_COUNTS = bytes([1] + [0] * 15)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _head(width: int, height: int) -> bytes:
    frame = bytes([8]) + (8 * height).to_bytes(2, "big") + (8 * width).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, b"\0" + _QUANT),
            _segment(0xC0, frame),
            _segment(0xC4, b"\0" + _DC_COUNTS + bytes(_DC_SYMBOLS)),
            _segment(0xC4, b"\x10" + _AC_COUNTS + b"\0"),
            _segment(0xDD, INTERVAL.to_bytes(2, "big")),
            _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        ]
    )


def _sides(n: int) -> list[tuple[int, int]]:
    """Width and height in blocks of the images that hold ``n`` payload bytes, a multiple of the interval."""
    out = []
    while n:
        most = min(n, IMAGE)
        width = INTERVAL
        while width * SIDE < most and 2 * width <= SIDE:
            width *= 2
        height = min(SIDE, max(1, most // width))
        out.append((width, height))
        n -= width * height
    return out


def _block_words() -> np.ndarray:
    """The 10 bits of a block by its DC difference plus 255: category s has 8 - s ones and a zero, s extra bits follow,
    then one bit that ends the block."""
    diff = np.arange(-255, 256)
    size = np.array([int(abs(d)).bit_length() for d in diff])
    extra = np.where(diff >= 0, diff, diff + (1 << size) - 1)
    return (((((1 << (9 - size)) - 2) << size) | extra) << 1).astype(np.uint64)


_BLOCK = _block_words()


def _scan(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of restart intervals (a row of ``samples`` each), stuffed, and each interval's length."""
    diff = samples.astype(np.int16)
    diff[:, 1:] -= samples[:, :-1]
    diff[:, 0] -= 128
    # every block has 10 bits, so four fill five bytes
    word = _BLOCK[diff + 255].reshape(-1, 4)
    five = (word[:, 0] << 30) | (word[:, 1] << 20) | (word[:, 2] << 10) | word[:, 3]
    flat = np.ascontiguousarray(five.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).ravel()
    each = INTERVAL * 10 // 8
    full = flat == 0xFF
    lengths = each + full.reshape(-1, each).sum(axis=1)
    return np.insert(flat, np.flatnonzero(full) + 1, 0) if full.any() else flat, lengths


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stored form for each payload (a positive multiple of 192 bytes)."""
    whole = np.frombuffer(b"".join(payloads), np.uint8)
    coded, lengths = _scan(whole.reshape(-1, INTERVAL))
    ends = np.cumsum(lengths)
    # room for a marker after each interval: RST0-7 within an image, EOI after its last
    images = [[(w, h) for w, h in _sides(len(p))] for p in payloads]
    marks = np.concatenate([np.r_[(np.arange(w * h // INTERVAL - 1) % 8) + 0xD0, 0xD9] for sides in images for w, h in sides]).astype(np.uint8)
    pairs = np.empty(2 * len(marks), np.uint8)
    pairs[0::2], pairs[1::2] = 0xFF, marks
    marked = np.insert(coded, np.repeat(ends, 2), pairs).tobytes()
    out, at, interval = [], 0, 0
    for sides in images:
        parts = []
        for w, h in sides:
            n = w * h // INTERVAL
            end = int(ends[interval + n - 1]) + 2 * (interval + n)
            parts += [_head(w, h), marked[at:end]]
            at, interval = end, interval + n
        out.append(b"".join(parts))
    return out


class BadJpeg(ValueError):
    pass


def _table(counts: bytes, symbols: bytes) -> np.ndarray:
    """For every 16-bit window the length of its code and its symbol: 256 * length + symbol, 0 where there is no code."""
    out = np.zeros(1 << 16, np.int32)
    code, at = 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = 256 * length + symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(64)
def _tables(dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both tables, and for windows that hold a whole block without AC coefficients 64 * its DC difference + its bits."""
    first, rest = _table(*dc), _table(*ac)
    window = np.arange(1 << 16)
    code, size = first >> 8, first & 255
    extra = (((window << code) & 0xFFFF) >> (16 - np.minimum(size, 16))).astype(np.int64)
    diff = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << np.minimum(size, 30)) + 1, extra)
    then = rest[(window << np.minimum(code + size, 16)) & 0xFFFF]
    bits = code + size + (then >> 8)
    whole = (code > 0) & (then > 0) & (then & 255 == 0) & (bits <= 16)
    return first, rest, np.where(whole, diff * 64 + bits, 0).astype(np.int32)


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """Header of the image that starts at ``at``, and where its scan begins."""
    if data[at : at + 2] != b"\xff\xd8":
        raise BadJpeg("no start of image")
    head: dict = {"quant": {}, "huff": {}, "interval": 0}
    at += 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise BadJpeg("a marker is missing")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xFF:
            at += 1
            continue
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                head["quant"][body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                head["huff"][body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xC0:
            if body[0] != 8 or body[5] != 1:
                raise BadJpeg("only one component of 8 bits is read")
            head |= {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "q": body[8]}
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise BadJpeg("the image isn't baseline")
        elif marker == 0xDD:
            head["interval"] = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if "width" not in head:
                raise BadJpeg("a scan without a frame")
            head["dc"], head["ac"] = head["huff"][body[2] >> 4], head["huff"][16 + (body[2] & 15)]
            return head, at


def _lanes(coded: np.ndarray, starts: np.ndarray, blocks: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """DC values, lane by lane: lane i begins at byte ``starts[i]`` of unstuffed bytes and has ``blocks[i]`` blocks."""
    dc, ac, block = tables
    padded = np.concatenate((coded, np.full(8, 0xFF, np.uint8))).astype(np.uint32)
    three = (padded[:-3] << 16) | (padded[1:-2] << 8) | padded[2:-1]
    most = int(blocks.max())
    order = np.argsort(-blocks, kind="stable")
    ends = np.concatenate(([0], np.cumsum(blocks)))
    out = np.zeros(int(ends[-1]), np.int32)
    position = starts[order].astype(np.int64) * 8
    first, left = ends[:-1][order], blocks[order]
    before = np.zeros(len(order), np.int32)
    limit = len(coded) * 8 + 32

    def window(p: np.ndarray) -> np.ndarray:
        return (three[p >> 3] >> (8 - (p & 7)).astype(np.uint32)) & 0xFFFF

    for b in range(most):
        live = int(np.searchsorted(-left, -b, "left"))  # lanes with more than b blocks come first
        p = position[:live]
        seen = window(p)
        entry = block[seen]
        if entry.all():
            before[:live] += entry >> 6
            out[first[:live] + b] = before[:live]
            position[:live] = p + (entry & 63)
            continue
        entry = dc[seen]
        if not entry.all():
            raise BadJpeg("a code isn't in the table")
        size = entry & 255
        p = p + (entry >> 8)
        extra = (window(p) >> (16 - size).astype(np.uint32)).astype(np.int32)
        extra = np.where(size > 0, extra, 0)
        p = p + size
        diff = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
        before[:live] += diff
        out[first[:live] + b] = before[:live]
        # AC coefficients are skipped: run and size say how far
        going, k = np.arange(live), np.ones(live, np.int32)
        while len(going):
            q = p[going]
            entry = ac[window(q)]
            if not entry.all() or (q > limit).any():
                raise BadJpeg("a code isn't in the table")
            size = entry & 15
            run = (entry & 255) >> 4
            p[going] = q + (entry >> 8) + size
            k[going] = np.where(size > 0, k[going] + run + 1, np.where(run == 15, k[going] + 16, 64))
            going = going[k[going] < 64]
        position[:live] = p
    return out


def thumbnails(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each stored form its images: width, height and one luminance sample per block (uint8), row by row."""
    data = b"".join(media)
    raw = np.frombuffer(data, np.uint8)
    # markers inside scans: an FF byte that neither stuffing nor another FF follows
    high = np.flatnonzero(raw[:-1] == 0xFF)
    marks = high[(raw[high + 1] != 0) & (raw[high + 1] != 0xFF)]
    heads, base = [], 0
    for i, one in enumerate(media):
        at, end = base, base + len(one)
        while at < end:
            head, scan = parse(data, at)
            m = int(np.searchsorted(marks, scan))
            n = m
            while n < len(marks) and 0xD0 <= raw[marks[n] + 1] <= 0xD7:
                n += 1
            if n == len(marks) or raw[marks[n] + 1] != 0xD9:
                raise BadJpeg("no end of image")
            heads.append((i, head, scan, marks[m : n + 1]))
            at = int(marks[n]) + 2
        base = end
    out: list[list[tuple[int, int, np.ndarray]]] = [[] for _ in media]
    groups: dict[tuple, list[int]] = {}
    for j, (_, head, _, _) in enumerate(heads):
        groups.setdefault((head["dc"], head["ac"]), []).append(j)
    found: dict[int, np.ndarray] = {}
    stuffed = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw[1:] == 0) & (raw[:-1] == 0xFF), out=stuffed[2:])
    keep = np.ones(len(raw), bool)
    keep[1:] = ~((raw[1:] == 0) & (raw[:-1] == 0xFF))
    clean = raw[keep]
    for (dc, ac), members in groups.items():
        starts, blocks = [], []
        for j in members:
            _, head, scan, ends = heads[j]
            total = -(-head["width"] // 8) * -(-head["height"] // 8)
            step = head["interval"] or total
            begin = np.concatenate(([scan], ends[:-1] + 2))
            if len(begin) != -(-total // step):
                raise BadJpeg("a restart interval is missing")
            starts.append(begin - stuffed[begin])
            blocks.append(np.minimum(step, total - step * np.arange(len(begin))))
        values = _lanes(clean, np.concatenate(starts), np.concatenate(blocks), _tables(dc, ac))
        at = 0
        for j, b in zip(members, blocks, strict=True):
            n = int(b.sum())
            found[j] = values[at : at + n]
            at += n
    for j, (i, head, _, _) in enumerate(heads):
        mean = found[j].astype(np.int64) * head["quant"][head["q"]]
        out[i].append((head["width"], head["height"], np.clip((mean + 4) // 8 + 128, 0, 255).astype(np.uint8)))
    return out


def thumbnail_hash(images: list[tuple[int, int, np.ndarray]]) -> str:
    """Dimensions and a 64-bit average hash of each image: whether each of 64 equal runs of samples is above the mean."""
    parts = []
    for width, height, samples in images:
        edges = (np.arange(64) * len(samples)) // 64
        sums = np.add.reduceat(samples.astype(np.int64), np.minimum(edges, len(samples) - 1))
        counts = np.maximum(np.diff(np.append(edges, len(samples))), 1)
        bits = sums * len(samples) > int(samples.astype(np.int64).sum()) * counts
        parts.append(f"{width}x{height}:{int(np.packbits(bits).view('>u8')[0]):016x}")
    return "+".join(parts)


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % PAD if text else PAD)


def _pieces(n: int) -> Iterator[tuple[int, int]]:
    """First and last byte of the payload of each image."""
    at = 0
    for w, h in _sides(n):
        yield at, at + w * h
        at += w * h


def _long_features(text: bytes) -> tuple:
    """What ``_features`` says of a long text, image after image."""
    n = len(text) + (-len(text) % PAD if text else PAD)
    payload, media, size, tail, parts = hashlib.sha256(), hashlib.sha256(), 0, b"", []
    for first, last in _pieces(n):
        piece = text[first:last]
        (stored,) = encode([piece + b" " * (last - first - len(piece))])
        ((image,),) = thumbnails([stored])
        samples = image[2].tobytes()
        payload.update(samples)
        media.update(stored)
        size, tail = size + len(stored), (tail + samples)[-16:]
        parts.append(thumbnail_hash([image]))
    return len(text), n, payload.hexdigest(), zlib.crc32(tail), size, media.hexdigest(), "+".join(parts)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, column = batch.column(0), batch.column(1).cast(pa.large_binary())
        row = 0
        while row < batch.num_rows:
            texts, held = [], 0
            while row + len(texts) < batch.num_rows and (not texts or held < CHUNK):
                text = column[row + len(texts)].as_py() or b""
                if texts and len(text) > IMAGE - PAD:
                    break
                texts.append(text)
                held += len(text)
                if held > IMAGE - PAD and len(texts) == 1:
                    break
            if len(texts[0]) > IMAGE - PAD:
                out = [_long_features(texts[0])]
            else:
                media = encode([pad(t) for t in texts])
                out = []
                for text, stored, images in zip(texts, media, thumbnails(media), strict=True):
                    payload = b"".join(s.tobytes() for _, _, s in images)
                    out.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), thumbnail_hash(images)))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([ids.slice(row, len(texts)), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], _NAMES)
            row += len(texts)


_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def media_features(docs: DataFrame) -> DataFrame:
    """Store each text as JPEG, read the stored bytes back and describe them; a projection without a shuffle."""
    ship(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(_features, schema)


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            text = batch.column(1)[row].as_py() or b""
            payload = pad(text)
            media = b"".join(encode([payload[first:last]])[0] for first, last in _pieces(len(payload)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([len(text)], pa.int64()), pa.array([media], pa.binary())], ["doc_id", "n_bytes", "media"])


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the JPEG itself as a binary column."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(_media, "doc_id long, n_bytes long, media binary")
