"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of the square frames that carry a payload, and the delay of each in hundredths of a second.
SIDE, DELAY = 24, 10
FRAME = SIDE * SIDE
PAD = b"\xff"
#: Greatest number of LZW codes, given by the format's 12 bits.
MOST_CODES = 1 << 12
#: Bins of the histogram of each colour channel.
BINS = 8
#: From so many streams of one size on, they are decoded together; and at most so many at once.
TOGETHER, AT_ONCE = 32, 2048
#: Bytes of media decoded before their rows are handed on.
BLOCK = 4_000_000


# --- LZW ---------------------------------------------------------------------------------------------------------


def _widths(n: int, bits: int) -> np.ndarray:
    """Widths of the n codes after a clear code, the first of which adds no entry."""
    held = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.maximum(bits + 1, np.ceil(np.log2(held + 1)).astype(np.int64)), 12)


def _codes(pixels: bytes, bits: int) -> list[list[int]]:
    """The codes of a stream, in stretches that each follow a clear code."""
    clear, end = 1 << bits, (1 << bits) + 1
    chunks, codes, table, free = [], [], {}, end + 1
    if pixels:
        prefix, get = pixels[0], table.get
        for pixel in pixels[1:]:
            pair = prefix << 8 | pixel
            code = get(pair)
            if code is not None:
                prefix = code
                continue
            codes.append(prefix)
            table[pair] = free
            free += 1
            prefix = pixel
            if free == MOST_CODES:
                codes.append(clear)
                chunks.append(codes)
                codes, table, free = [], {}, end + 1
                get = table.get
        codes.append(prefix)
    codes.append(end)
    chunks.append(codes)
    return chunks


def lzw_encode_many(streams: list[bytes], bits: int = 8) -> list[bytes]:
    """Pixels of ``bits`` bits as GIF code streams, lowest bit first. Bits are packed for all streams at once."""
    if not streams:
        return []
    codes, lengths, last = [], [], []
    for pixels in streams:
        codes.append(1 << bits)
        lengths.append(1)
        for chunk in _codes(pixels, bits):
            codes += chunk
            lengths.append(len(chunk))
        last.append(len(codes) - 1)
    by_length = {n: _widths(n, bits) for n in set(lengths)} | {1: np.array([bits + 1])}
    widths = np.concatenate([by_length[n] for n in lengths])
    ends = np.cumsum(widths)
    closed = ends[last]  # each stream begins with a byte of its own
    pad = np.cumsum(-np.diff(closed, prepend=0) % 8)
    at = ends - widths
    at[last[0] + 1 :] += np.repeat(pad[:-1], np.diff(last))
    value = np.array(codes, np.int64) << (at & 7)  # 19 bits at most, over three bytes
    place, size = at >> 3, int(closed[-1] + pad[-1]) >> 3
    data = sum(np.bincount(place + k, value >> 8 * k & 255, size + 3) for k in range(3))[:size].astype(np.uint8).tobytes()
    stops = ((closed + pad) >> 3).tolist()
    return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]


def lzw_encode(pixels: bytes, bits: int = 8) -> bytes:
    """Pixels of ``bits`` bits as one GIF code stream."""
    return lzw_encode_many([pixels], bits)[0]


def lzw_decode(data: bytes, bits: int, pixels: int) -> bytes:
    """Up to ``pixels`` pixels of a GIF code stream; a broken stream gives those before the break."""
    clear, end = 1 << bits, (1 << bits) + 1
    stream = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, previous, at, out, made = roots.copy(), None, 0, [], 0
    while made < pixels:
        # the table's size says how many codes come before the next width
        width = min(12, len(table).bit_length())
        run = (1 << width) - len(table) + (previous is None) if width < 12 else MOST_CODES
        run = min(max(1, run), (len(stream) - at) // width)
        if run < 1:
            break
        codes = stream[at : at + run * width].reshape(run, width) @ (1 << np.arange(width))
        for n, code in enumerate(codes.tolist(), 1):
            if code == clear:
                table, previous = roots.copy(), None
                break
            if code == end or code > len(table) or previous is None and code >= clear:
                return b"".join(out)[:pixels]
            entry = table[code] if code < len(table) else previous + previous[:1]
            if previous is not None and len(table) < MOST_CODES:
                table.append(previous + entry[:1])
            out.append(entry)
            made += len(entry)
            previous = entry
        at += n * width
    return b"".join(out)[:pixels]


def lzw_decode_many(streams: list[bytes], bits: int, pixels: int) -> list[bytes]:
    """``lzw_decode`` of many streams of one size at once, a code of each at a time.

    An entry of the table is a stretch of what the stream has given so far: the
    previous stretch and the pixel after it. So entries are (start, length).
    """
    n, clear, end = len(streams), 1 << bits, (1 << bits) + 1
    size, wide = min(MOST_CODES, end + 2 + pixels), pixels + MOST_CODES
    longest = max(map(len, streams)) + 4
    data = np.frombuffer(b"".join(x.ljust(longest, b"\0") for x in streams) + b"\0\0", np.uint8).astype(np.int32)
    data = data[:-2] | data[1:-1] << 8 | data[2:] << 16  # three bytes from each place on
    at = np.arange(n) * longest * 8
    last = at + 8 * np.array([len(x) for x in streams])
    out = np.zeros(n * wide, np.uint8)
    first = np.arange(n) * wide
    table, rows = np.zeros(n * size, np.int64), np.arange(n) * size  # start << 16 | length
    held, made, old = np.full(n, end + 1), first.copy(), np.zeros(n, np.int64)
    width_of = np.minimum(12, np.array([k.bit_length() for k in range(MOST_CODES + 1)]))
    live = np.arange(n)
    while len(live):
        width, where = width_of[held[live]], at[live]
        code = data[where >> 3] >> (where & 7) & ((1 << width) - 1)
        where += width
        at[live] = where
        fine = (code != end) & (where <= last[live])
        cleared = fine & (code == clear)
        f, c, waiting = live, code, live[:0]
        if cleared.any():
            waiting = live[cleared]
            held[waiting], old[waiting] = end + 1, 0
            fine &= ~cleared
        if not fine.all():
            f, c = f[fine], c[fine]
        grow = (old[f] > 0) & (held[f] < size)
        g = f if grow.all() else f[grow]
        table[rows[g] + held[g]] = old[g] + 1
        held[g] += 1
        entry = c >= clear
        to = made[f]
        if entry.any():
            whole = (c < held[f]) & (~entry | (held[f] > end + 1))
            f, c, to, entry = f[whole], c[whole], to[whole], entry[whole]
            out[to[~entry]] = c[~entry]
            found = table[rows[f[entry]] + c[entry]]
            source, target, span = (found >> 16) + first[f[entry]], to[entry], found & 0xFFFF
            for k in range(span.max(initial=0)):
                more = span > k
                out[target[more] + k] = out[source[more] + k]
            length = np.ones(len(f), np.int64)
            length[entry] = span
        else:
            out[to] = c
            length = 1
        old[f] = (to - first[f]) << 16 | length
        to = to + length
        made[f] = to
        going = f[to - first[f] < pixels]
        live = np.union1d(going, waiting) if len(waiting) else going
    made -= first
    return [out[i : i + min(m, pixels)].tobytes() for i, m in zip(first.tolist(), made.tolist(), strict=True)]


# --- container ---------------------------------------------------------------------------------------------------


@dataclass
class Frame:
    """One composited picture: delay in hundredths of a second and RGBA samples (height, width, 4)."""

    delay: int
    rgba: np.ndarray


def write_gif(frames: np.ndarray, palette: np.ndarray, delay: int = DELAY, disposal: int = 1) -> bytes:
    """Frames of 8-bit indices (frame, row, column) and a palette of 256 colours as a GIF."""
    n, height, width = frames.shape
    head = b"GIF89a" + width.to_bytes(2, "little") + height.to_bytes(2, "little") + b"\xf7\0\0" + palette.astype(np.uint8).tobytes()
    control = b"\x21\xf9\x04" + bytes([disposal << 2]) + delay.to_bytes(2, "little") + b"\0\0"
    place = b"\x2c\0\0\0\0" + width.to_bytes(2, "little") + height.to_bytes(2, "little") + b"\0"
    before, parts = control + place + b"\x08", []
    for stream in lzw_encode_many([x.tobytes() for x in frames.astype(np.uint8)]):
        parts.append(before)
        for at in range(0, len(stream), 255):
            parts += [bytes([min(255, len(stream) - at)]), stream[at : at + 255]]
        parts.append(b"\0")
    return head + b"".join(parts) + b"\x3b"


def _colours(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 3 << (flags & 7) + 1
    return np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n


@dataclass
class Picture:
    """A picture as it is stored: its place, colours, rules and code stream."""

    left: int
    top: int
    width: int
    height: int
    colours: np.ndarray
    interlaced: bool
    delay: int
    disposal: int
    transparent: int | None
    bits: int
    stream: bytes


def parse_gif(data: bytes) -> tuple[int, int, list[Picture]]:
    """Width, height and pictures of a GIF; a ValueError if it is broken."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    number = lambda at: int.from_bytes(data[at : at + 2], "little")
    shared, at = _colours(data, 13, data[10])
    pictures, delay, disposal, transparent = [], 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                disposal, delay = data[at + 3] >> 2 & 7, number(at + 4)
                transparent = data[at + 6] if data[at + 3] & 1 else None
            _, at = _joined(data, at + 2)
        elif data[at] == 0x2C:
            box, flags = [number(at + k) for k in (1, 3, 5, 7)], data[at + 9]
            own, at = _colours(data, at + 10, flags)
            stream, after = _joined(data, at + 1)
            pictures.append(Picture(*box, shared if own is None else own, bool(flags & 0x40), delay, disposal, transparent, data[at], stream))
            at, delay, disposal, transparent = after, 0, 0, None
        else:
            raise ValueError(f"unknown block {data[at]:#x}")
    return number(6), number(8), pictures


def decode_streams(pictures: list[Picture]) -> list[bytes]:
    """The pixels of each picture, like ones decoded together."""
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(pictures):
        groups.setdefault((p.bits, p.width * p.height), []).append(i)
    out = [b""] * len(pictures)
    for (bits, pixels), places in groups.items():
        for k in range(0, len(places), AT_ONCE):
            part = places[k : k + AT_ONCE]
            streams = [pictures[i].stream for i in part]
            found = lzw_decode_many(streams, bits, pixels) if len(part) >= TOGETHER else [lzw_decode(x, bits, pixels) for x in streams]
            for i, x in zip(part, found, strict=True):
                out[i] = x
    return out


def composite(width: int, height: int, pictures: list[Picture], pixels: list[bytes]) -> list[Frame]:
    """The frames that a viewer sees: pictures laid on one another by their rules."""
    if all((p.width, p.height, p.left, p.top, p.transparent, p.interlaced) == (width, height, 0, 0, None, False) for p in pictures) and all(len(x) == width * height for x in pixels):
        # every picture hides those before it
        opaque = {id(p.colours): np.insert(p.colours, 3, 255, axis=1) for p in pictures}
        return [Frame(p.delay, opaque[id(p.colours)][np.frombuffer(x, np.uint8)].reshape(height, width, 4)) for p, x in zip(pictures, pixels, strict=True)]
    frames, canvas = [], np.zeros((height, width, 4), np.uint8)
    for p, data in zip(pictures, pixels, strict=True):
        if len(data) < p.width * p.height:
            raise ValueError("the picture ends early")
        drawn = np.frombuffer(data, np.uint8).reshape(p.height, p.width)
        if p.interlaced:
            rows = np.concatenate([np.arange(start, p.height, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
            drawn = drawn[np.argsort(rows)]
        before = canvas.copy() if p.disposal == 3 else None
        area = canvas[p.top : p.top + p.height, p.left : p.left + p.width]
        drawn = drawn[: area.shape[0], : area.shape[1]]
        if p.transparent is None:
            area[..., :3], area[..., 3] = p.colours[drawn], 255
        else:
            kept = drawn != p.transparent
            area[kept] = np.insert(p.colours[drawn[kept]], 3, 255, axis=1)
        frames.append(Frame(p.delay, canvas.copy()))
        if p.disposal == 2:
            area[:] = 0
        elif p.disposal == 3:
            canvas = before
    return frames


def read_gif(data: bytes) -> list[Frame]:
    """The composited frames of a GIF, by its palettes, transparency and disposal rules."""
    width, height, pictures = parse_gif(data)
    return composite(width, height, pictures, decode_streams(pictures))


def _joined(data: bytes, at: int) -> tuple[bytes, int]:
    """The sub-blocks from ``at`` as one, and the place after them."""
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


# --- columns -----------------------------------------------------------------------------------------------------

_GREYS = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text, padded to a positive multiple of a frame, and its length before that."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    return data + PAD * (-n % FRAME if n else FRAME), n


def histogram(frames: list[Frame]) -> np.ndarray:
    """(frame, channel, bin): how many samples of red, green and blue are in each of BINS equal ranges."""
    samples = np.stack([f.rgba[..., :3].reshape(-1, 3) for f in frames])
    cell = (samples >> 5).astype(np.int64) + BINS * (np.arange(3) + 3 * np.arange(len(frames))[:, None, None])
    return np.bincount(cell.ravel(), minlength=3 * BINS * len(frames)).reshape(-1, 3, BINS)


STORED = "doc_id long, n_bytes long, media binary"
DECODED = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, n_frames int, delays array<int>, histograms array<array<int>>, feature string, payload binary"


def store_texts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``: each text of ``docs`` as an animation of grey frames.

    A byte of the payload is a palette index, SIDE x SIDE of them a frame shown
    for DELAY hundredths of a second. Null texts are empty; an empty text is one
    white frame. Repeated rows and equal texts give equal media.
    """

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                data, n = payload(text if isinstance(text, str) else None)
                rows.append((doc, n, write_gif(np.frombuffer(data, np.uint8).reshape(-1, SIDE, SIDE), _GREYS)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "media"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(encode, STORED)


def decode_media(stored: DataFrame) -> DataFrame:
    """Stored media decoded into timed frames and features.

    Adds the media's length and digest, delays and colour histograms by frame,
    the pooled histogram as ``feature`` and the samples of the red channel, in
    order, as ``payload``. Null or broken media give nulls in all of them but
    ``media_bytes`` and ``media_sha256``, which are null for null media only.
    """

    def features(media: bytes, decoded: tuple | None) -> tuple:
        facts = (len(media), hashlib.sha256(media).hexdigest())
        try:
            shown = composite(*decoded)
            counts = histogram(shown)
        except (ValueError, IndexError, TypeError):
            return (*facts, *[None] * 5)
        pooled = ";".join(f"{c}:" + ",".join(map(str, row)) for c, row in zip("rgb", counts.sum(0).tolist(), strict=True))
        return (*facts, len(shown), [f.delay for f in shown], counts.reshape(len(shown), -1).tolist(), pooled, b"".join(f.rgba[..., 0].tobytes() for f in shown))

    def block(part: pd.DataFrame) -> pd.DataFrame:
        parsed = []
        for media in part["media"]:
            try:
                parsed.append(parse_gif(media))
            except (ValueError, IndexError, TypeError):
                parsed.append(None)
        pixels = iter(decode_streams([p for x in parsed if x for p in x[2]]))
        rows = []
        for doc, n, media, x in zip(part["doc_id"], part["n_bytes"], part["media"], parsed, strict=True):
            decoded = x and (*x, [next(pixels) for _ in x[2]])
            rows.append((doc, n, *([None] * 7 if media is None else features(media, decoded))))
        names = [x.split()[0] for x in DECODED.split(", ")]
        return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("doc_id", "n_bytes", "media_bytes", "n_frames")})

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = frame["media"].map(len, na_action="ignore").fillna(0)
            for _, part in frame.groupby((sizes.cumsum() // BLOCK).astype(int), sort=False):
                yield block(part)

    return stored.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media").mapInPandas(decode, DECODED)


def tail_crc32(data: bytes) -> int:
    """Unsigned CRC-32 of the last 32 bytes."""
    return zlib.crc32(data[-32:])
