"""Operator 3, media columns: GIF.

Decodes GIF87a/89a files from their bytes: sub-blocks, LZW code streams, global and local palettes,
interlacing, transparency and disposal (keep, background, previous), and gives timed frames with
a colour histogram each. The encoder stores a payload as square frames of palette indices; the
palette is the identity grey ramp, so each decoded pixel's level is the payload byte.

``doc_id`` is an integer, or text that reads as one. Equal texts give equal values, so there are no ties.
Null texts are empty; a null or broken file gives its good frames and a reason: so do a code size that
the format doesn't know and a screen of more than ``MOST_PIXELS``. Repeated rows stay, with equal
values. An empty table gives an empty result; other columns are ignored. A text is one value in a
task, however long: its file takes up to 1.2 times its bytes, frames are decoded some at a time.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

SIDE = 24
UNIT = SIDE * SIDE
DELAY_CS = 4
BINS = 16
#: Frames that are coded together, and pixels of the largest screen that is decoded.
TOGETHER, MOST_PIXELS = 2048, 1 << 26
GREY = bytes(v for i in range(256) for v in (i, i, i))


# ---------------------------------------------------------------- LZW


def _layout(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of each code after a clear code, and the bits before it; the table fills at 4096."""
    end = (1 << bits) + 1
    entries = np.arange(4096 - end + 1) + end  # known codes, when code k is read, end at entries[k]
    width = np.minimum(12, np.maximum(bits + 1, np.ceil(np.log2(entries + 1)).astype(np.int64)))
    return width, np.concatenate([[0], np.cumsum(width)[:-1]])


_LAYOUT = {8: _layout(8)}


def _codes(data: bytes, bits: int) -> list[list[int]]:
    """Codes of ``data``, a list for each stretch between clear codes."""
    first = (1 << bits) + 2
    known: dict[int, int] = {}
    get = known.get
    out: list[int] = []
    done = [out]
    if not data:
        return done
    put = out.append
    nxt, prefix = first, data[0]
    for c in data[1:]:
        key = prefix << 8 | c
        code = get(key)
        if code is None:
            put(prefix)
            known[key] = nxt
            nxt += 1
            prefix = c
            if nxt == 4096:
                out = []
                done.append(out)
                put = out.append
                known.clear()
                nxt = first
        else:
            prefix = code
    put(prefix)
    return done


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes written one after another, lowest bit first."""
    at = np.cumsum(widths)
    start = at - widths
    v = codes << (start & 7)
    byte, n = start >> 3, int(at[-1] + 7) // 8
    out = np.zeros(n + 3, np.int64)
    for i in range(3):
        out[: n + 3] += np.bincount(byte + i, (v >> 8 * i) & 255, n + 3).astype(np.int64)
    return out[:n].astype(np.uint8).tobytes()


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """GIF's variable-width LZW code stream of ``data`` (samples of ``bits`` bits)."""
    width, _ = _LAYOUT.get(bits) or _LAYOUT.setdefault(bits, _layout(bits))
    codes, widths, ahead = [], [], bits + 1
    for part in _codes(data, bits):  # a clear code before each, written at the width in force
        codes += [1 << bits, *part]
        widths += [ahead, *width[: len(part)].tolist()]
        ahead = int(width[min(len(part), len(width) - 1)])
    codes.append((1 << bits) + 1)
    widths.append(ahead)
    return _pack(np.array(codes), np.array(widths))


def lzw_encode_many(frames: np.ndarray, bits: int = 8) -> list[bytes]:
    """:func:`lzw_encode` of each row of ``frames``, all rows step by step together.

    Rows are too short to fill the code table (under 3800 samples). Each has a hash table of the
    strings that it knows, with linear probing.
    """
    n, wide = frames.shape
    first, slots = (1 << bits) + 2, 1 << max(8, int(wide * 4).bit_length())
    width, place = _LAYOUT.get(bits) or _LAYOUT.setdefault(bits, _layout(bits))
    known, code = np.full(n * slots, -1, np.int32), np.zeros(n * slots, np.int32)
    codes = np.zeros((n, wide), np.int32)
    size, base, columns = np.zeros(n, np.int64), np.arange(n) * slots, np.ascontiguousarray(frames.T).astype(np.int32)
    prefix = columns[0]
    for c in columns[1:]:
        key = prefix << 8 | c
        slot = base + (key * 40503 >> 4 & slots - 1)
        got = known[slot]
        met = got == key
        astray = np.flatnonzero(~met & (got >= 0))
        while len(astray):
            slot[astray] = base[astray] + (slot[astray] + 1 & slots - 1)
            got = known[slot[astray]]
            met[astray] = got == key[astray]
            astray = astray[(got >= 0) & (got != key[astray])]
        new = np.flatnonzero(~met)
        codes[new, size[new]] = prefix[new]
        at = slot[new]
        known[at] = key[new]
        code[at] = first + size[new]
        size[new] += 1
        following = code[slot]
        following[new] = c[new]
        prefix = following
    codes[np.arange(n), size] = prefix
    size += 1
    # a clear code, the codes at their fixed places, an end code
    most = int(size.max())
    cells = np.arange(most + 1)[None]
    value = np.where(cells < size[:, None], np.pad(codes[:, :most], ((0, 0), (0, 1))), np.where(cells == size[:, None], (1 << bits) + 1, 0))
    start = place[: most + 1] + bits + 1
    stop = place[size] + width[size] + bits + 1
    room = int(stop.max() + 7) // 8 + 3
    out = np.zeros(n * room)
    shifted = value << (start & 7)
    rows = (np.arange(n) * room)[:, None] + (start >> 3)
    for i in range(3):
        out += np.bincount((rows + i).ravel(), (shifted >> 8 * i & 255).ravel(), n * room)
    raw = out.astype(np.uint8).reshape(n, room)
    head = (1 << bits, (1 << bits) >> 8)  # the clear code fills the first bits + 1
    raw[:, 0] += head[0] & 255
    raw[:, 1] += head[1]
    return [r[: (e + 7) // 8].tobytes() for r, e in zip(raw, stop.tolist())]


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """The samples of a code stream, ``most`` at most; the end code or the stream's end stops it."""
    return lzw_decode_many([stream], bits, [most])[0]


def _one_by_one(stream: bytes, bits: int, most: int) -> bytes:
    """Any code stream, code by code; used for those that clear the table midway."""
    clear, end = 1 << bits, (1 << bits) + 1
    base = [bytes((i,)) for i in range(clear)] + [b"", b""]
    words, width, last, parts, size = list(base), bits + 1, None, [], 0
    acc = held = at = 0
    while size < most:
        while held < width and at < len(stream):
            piece = stream[at : at + 8]
            acc |= int.from_bytes(piece, "little") << held
            held += 8 * len(piece)
            at += 8
        if held < width:
            break
        code = acc & ((1 << width) - 1)
        acc >>= width
        held -= width
        if code == clear:
            words, width, last = list(base), bits + 1, None
            continue
        if code == end:
            break
        if code > len(words) or (last is None and code >= len(words)):
            raise ValueError("LZW code out of range")
        word = words[code] if code < len(words) else last + last[:1]
        if last is not None and len(words) < 4096:
            words.append(last + word[:1])
        if len(words) == 1 << width and width < 12:
            width += 1
        parts.append(word)
        size += len(word)
        last = word
    return b"".join(parts)[:most]


def lzw_decode_many(streams: list[bytes], bits: int, most: list[int]) -> list[bytes]:
    """:func:`lzw_decode` of many streams together.

    After a clear code, code k has a fixed width and place, so codes are cut out as arrays. Code
    k >= first names what code k - first wrote plus one sample, which the output already holds:
    each output sample points to an earlier one, and pointers are doubled until all meet literals.
    """
    clear, end = 1 << bits, (1 << bits) + 1
    width, place = _LAYOUT.get(bits) or _LAYOUT.setdefault(bits, _layout(bits))
    size = np.array([len(s) for s in streams])
    out: list[bytes] = [b""] * len(streams)
    if not len(streams):
        return out
    room = int(size.max()) + 4
    raw = np.zeros((len(streams), room), np.uint8)
    for i, s in enumerate(streams):
        raw[i, : len(s)] = np.frombuffer(s, np.uint8)
    raw = raw.astype(np.uint32)
    k = int(np.searchsorted(place + width + bits + 1, 8 * (room - 4), "right"))
    start = place[:k] + bits + 1
    first = raw[:, 0] | raw[:, 1] << 8
    at = start >> 3
    codes = (raw[:, at] | raw[:, at + 1] << 8 | raw[:, at + 2] << 16) >> (start & 7).astype(np.uint32) & ((1 << width[:k]) - 1).astype(np.uint32)
    codes = codes.astype(np.int64)
    codes[start + width[:k] > 8 * size[:, None]] = end
    stop = (codes == clear) | (codes == end)
    length = np.where(stop.any(1), stop.argmax(1), k)
    ok = (first & ((1 << (bits + 1)) - 1)) == clear
    last = np.take_along_axis(codes, np.minimum(length, max(k - 1, 0))[:, None], 1)[:, 0] if k else np.full(len(streams), end)
    ok &= (length < k) & (last == end) if k else True
    rows = np.flatnonzero(ok)
    for i in np.flatnonzero(~ok):
        out[i] = _one_by_one(streams[i], bits, most[i])
    if not len(rows) or not k:
        return out
    length = length[rows]
    keep = np.arange(k)[None] < length[:, None]
    flat = codes[rows][keep]
    own = np.repeat(np.cumsum(length) - length, length)
    order = np.arange(len(flat)) - own
    entry = flat - (end + 1)
    refers = entry >= 0
    if (entry >= order).any() or (flat[~refers] >= clear).any():
        raise ValueError("LZW code out of range")
    parent = np.where(refers, own + entry, np.arange(len(flat)))
    long, up = refers.astype(np.int64), parent
    while True:  # length less one: how many steps until a literal
        more = long[up]
        if not more.any():
            break
        long, up = long + more, up[up]
    long += 1
    begin = np.cumsum(long) - long
    owner = np.repeat(np.arange(len(flat)), long)
    within = np.arange(int(long.sum())) - begin[owner]
    source = np.where(refers[owner], begin[parent[owner]] + within, np.arange(len(owner)))
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    samples = flat[owner[source]].astype(np.uint8).tobytes()
    ends = np.cumsum(np.bincount(np.repeat(np.arange(len(rows)), length), long, len(rows)).astype(np.int64))
    begin_row = 0
    for i, e in zip(rows, ends.tolist()):
        out[i] = samples[begin_row : min(e, begin_row + most[i])]
        begin_row = e
    return out


# ---------------------------------------------------------------- files


_HEAD = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + GREY
_FRAME = b"\x21\xf9\x04\x04" + struct.pack("<H", DELAY_CS) + b"\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"


def encode_gifs(payloads: list[bytes]) -> list[bytes]:
    """Payloads (multiples of 576 bytes) as animated GIFs of 24 x 24 frames."""
    all_frames = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    codes = (x for i in range(0, len(all_frames), TOGETHER) for x in lzw_encode_many(all_frames[i : i + TOGETHER]))
    files = []
    for payload in payloads:
        out = [_HEAD]
        for code in itertools.islice(codes, len(payload) // UNIT):
            out.append(_FRAME)
            for i in range(0, len(code), 255):
                piece = code[i : i + 255]
                out += (bytes((len(piece),)), piece)
            out.append(b"\0")
        out.append(b"\x3b")
        files.append(b"".join(out))
    return files


def encode_gif(payload: bytes) -> bytes:
    """``payload`` (a multiple of 576 bytes) as an animated GIF of 24 x 24 frames."""
    return encode_gifs([payload])[0]


def parse_gif(data: bytes) -> tuple[tuple, list[dict], str | None]:
    """The screen, the images with their code streams still packed, and what broke the file off."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        return (0, 0, np.zeros(3, np.uint8)), [], "not a GIF"
    images: list[dict] = []
    screen = (0, 0, np.zeros(3, np.uint8))
    try:
        wide, high, flags, back, _ = struct.unpack_from("<HHBBB", data, 6)
        at, palette = 13, None

        def colours(at: int, flags: int):
            n = 3 * (2 << (flags & 7))
            return np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n

        def blocks(at: int):
            got = []
            while n := data[at]:
                got.append(data[at + 1 : at + 1 + n])
                at += n + 1
            return b"".join(got), at + 1

        if flags & 0x80:
            palette, at = colours(at, flags)
        ground = palette[back] if palette is not None and back < len(palette) else np.zeros(3, np.uint8)
        screen = (wide, high, ground)
        if wide * high > MOST_PIXELS:
            return (0, 0, ground), [], "screen too large"
        delay, disposal, see_through = 0, 0, None
        while (kind := data[at]) != 0x3B:
            if kind == 0x21:
                label = data[at + 1]
                body, at = blocks(at + 2)
                if label == 0xF9:
                    delay, disposal = struct.unpack_from("<H", body, 1)[0] * 10, body[0] >> 2 & 7
                    see_through = body[3] if body[0] & 1 else None
                continue
            if kind != 0x2C:
                return screen, images, "unknown GIF block"
            x, y, w, h, f = struct.unpack_from("<HHHHB", data, at + 1)
            at, own = at + 10, palette
            if f & 0x80:
                own, at = colours(at, f)
            if own is None:
                return screen, images, "no palette"
            bits = data[at]
            if not 2 <= bits <= 8:
                return screen, images, "LZW code size out of range"
            code, at = blocks(at + 1)
            images.append({"box": (x, y, w, h), "laced": bool(f & 0x40), "palette": own, "bits": bits, "code": code, "delay": delay, "disposal": disposal, "clear": see_through})
            delay, disposal, see_through = 0, 0, None
    except (IndexError, struct.error, ValueError):
        return screen, images, "file ends early"
    return screen, images, None


def unpack(files: list[list[dict]]) -> None:
    """Decode the code streams of many files' images together, into their ``samples``."""
    by_bits: dict[int, list[dict]] = {}
    for images in files:
        for x in images:
            by_bits.setdefault(x["bits"], []).append(x)
    for bits, same in by_bits.items():
        for i in range(0, len(same), 512):
            part = same[i : i + 512]
            try:
                got = lzw_decode_many([x["code"] for x in part], bits, [x["box"][2] * x["box"][3] for x in part])
            except (ValueError, IndexError):  # one of them is broken: find out which
                got = []
                for x in part:
                    try:
                        got += lzw_decode_many([x["code"]], bits, [x["box"][2] * x["box"][3]])
                    except (ValueError, IndexError):
                        got.append(b"")
            for x, samples in zip(part, got):
                x["samples"] = samples


def unpacked(images: list[dict]) -> Iterator[dict]:
    """Images with their samples, decoded some at a time and dropped after use."""
    for i in range(0, len(images), 64):
        part = images[i : i + 64]
        unpack([part])
        for x in part:
            yield x
            del x["samples"]


def compose(screen: tuple, images: Iterable[dict]) -> Iterator[dict]:
    """Frames as shown, by palette, interlacing, transparency and disposal.

    Pixels that no frame has drawn, and those that disposal cleared, are the background: palette
    entry of the screen's background index, black without a global palette.
    """
    wide, high, ground = screen
    canvas = np.empty((high, wide, 3), np.uint8)
    canvas[:] = ground
    start = 0
    for no, i in enumerate(images):
        x, y, w, h = i["box"]
        if len(i["samples"]) < w * h:
            raise ValueError("frame ends early")
        index = np.frombuffer(i["samples"], np.uint8).reshape(h, w)
        if i["laced"]:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            straight = np.empty_like(index)
            straight[order] = index
            index = straight
        own = i["palette"]
        before = canvas.copy() if i["disposal"] == 3 else None
        part = canvas[y : y + h, x : x + w]
        index = index[: part.shape[0], : part.shape[1]]
        drawn = own[index if len(own) == 256 else np.minimum(index, len(own) - 1)]
        if i["clear"] is None:
            part[:] = drawn
        else:
            part[:] = np.where((index == i["clear"])[..., None], part, drawn)
        yield {"no": no, "start_ms": start, "delay_ms": i["delay"], "rgb": canvas.copy()}
        start += i["delay"]
        if i["disposal"] == 2:
            part[:] = ground
        elif i["disposal"] == 3:
            canvas = before


def decode_gif(data: bytes) -> Iterator[dict]:
    """Frames of one file: ``no``, ``start_ms``, ``delay_ms`` and ``rgb``, a (height, width, 3) array."""
    screen, images, broken = parse_gif(data)
    yield from compose(screen, unpacked(images))
    if broken:
        raise ValueError(broken)


_CHANNEL = np.arange(3, dtype=np.uint8) * BINS


def histogram(rgb: np.ndarray) -> np.ndarray:
    """Counts of a frame's pixels in equal bins of each channel: red, then green, then blue."""
    return np.bincount(((rgb >> 4) + _CHANNEL).ravel(), minlength=3 * BINS)


# ---------------------------------------------------------------- DataFrame operators

FRAMES = "media_id long, frame_no int, start_ms long, delay_ms int, width int, height int, histogram array<int>, pixels binary, error string"


def frames(media: DataFrame) -> DataFrame:
    """Timed frames of ``media`` (media_id, media): a row for each frame, histogram and RGB pixels.

    A null or broken file gives one row with the reason in ``error`` after its good frames.
    """

    def each(batches):
        for b in batches:
            for key, data in zip(b.column("media_id").to_pylist(), b.column("media").to_pylist()):
                rows, error = [], None
                try:
                    for f in decode_gif(data or b""):
                        h, w, _ = f["rgb"].shape
                        rows.append((key, f["no"], f["start_ms"], f["delay_ms"], w, h, histogram(f["rgb"]).tolist(), f["rgb"].tobytes(), None))
                        if len(rows) * h * w > 1 << 21:
                            yield _frame_rows(rows)
                            rows = []
                except (ValueError, IndexError, struct.error) as e:
                    error = str(e) or type(e).__name__
                if error:
                    rows.append((key, None, None, None, None, None, None, None, error))
                if rows:
                    yield _frame_rows(rows)

    return media.select("media_id", "media").mapInArrow(tidy(each), FRAMES)


def _frame_rows(rows):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.string()]
    names = [x.split()[0] for x in FRAMES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of ``docs`` (doc_id, text): the padded UTF-8 bytes as a GIF."""

    def each(batches):
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("raw")
            for i in range(0, b.num_rows, 256):
                held = texts.slice(i, 256).to_pylist()
                sizes = [len(raw) for raw in held]
                media = encode_gifs([raw + b"\xff" * (-len(raw) % UNIT) if raw else b"\xff" * UNIT for raw in held])
                yield pa.RecordBatch.from_arrays([ids.slice(i, 256), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw")).mapInArrow(tidy(each), "doc_id long, n_bytes long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_ms long"


def digest(media: DataFrame) -> DataFrame:
    """Payload read back from the stored bytes of :func:`encode`, its sums, and the file's histogram.

    ``feature`` is the summed red-channel histogram of all frames, comma-joined (the ramp is grey,
    so the channels agree).
    """

    def each(batches):
        for b in batches:
            cols = [[] for _ in range(10)]
            ids, sizes, media = (b.column(x).to_pylist() for x in ("doc_id", "n_bytes", "media"))
            for i in range(0, b.num_rows, 64):
                parsed = [parse_gif(data) for data in media[i : i + 64]]
                unpack([images for _, images, _ in parsed])
                for key, size, data, (screen, images, broken) in zip(ids[i : i + 64], sizes[i : i + 64], media[i : i + 64], parsed):
                    if broken:
                        raise ValueError(broken)
                    sha, total, n, ms, tail = hashlib.sha256(), 0, 0, 0, b""
                    colours = np.zeros(3 * BINS, np.int64)
                    for f in compose(screen, images):
                        level = f["rgb"][..., 0].tobytes()
                        sha.update(level)
                        tail = level[-32:]
                        colours += histogram(f["rgb"])
                        total, n, ms = total + len(level), n + 1, f["start_ms"] + f["delay_ms"]
                    row = (key, size, total, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), ",".join(map(str, colours[:BINS])), n, ms)
                    for c, v in zip(cols, row):
                        c.append(v)
            i, s = pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (i, i, i, s, i, i, s, s, i, i))], names=[x.split()[0] for x in DIGEST.split(", ")])

    return media.mapInArrow(tidy(each), DIGEST)


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` stored as a GIF, read back and summed up."""
    return digest(encode(table(spark, sf_dir, "documents")))
