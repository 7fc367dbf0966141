"""Media columns: AVI files of motion-JPEG frames, written, parsed, decoded and cut into shots.

Storing: every 192 payload bytes are one frame, a grid of 16 by 12 blocks of 8 by 8 equal samples. Such blocks have a DC
coefficient only, which a quantiser of 8 keeps exactly, so baseline JPEG stores them without loss. The frames carry their
own Huffman table: a difference of category c has a code of 9 - c bits before its c extra bits, 9 bits for every block.
Any JPEG decoder reads it; ``decode_frames`` does so for all frames of a batch at once, and ``decode_frame`` decodes any
greyscale baseline frame.

Reading: the RIFF chunks give the frame index; shots end where the change of the frames' histograms stands out against
its neighbourhood. Each shot is a clip row with times.

Null and empty texts are 192 spaces: one frame, one clip. Equal texts give equal files and features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import batch_of, map_arrow, slices, table, texts, utf8

UNIT, COLUMNS, ROWS, RATE = 192, 16, 12, 25
#: Shots: histogram bins, frames on either side that a change is held against, deviations, and the least change.
BINS, AROUND, DEVIATIONS, LEAST = 16, 12, 2.5, 0.25
#: The order in which a JPEG block's coefficients are stored, as row * 8 + column.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head() -> bytes:
    """Everything of a frame before its entropy-coded data."""
    dc_lengths = bytes([1] * 9 + [0] * 7)  # one code of each length 1..9, for categories 8..0
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, bytes([0, 8]) + bytes([1] * 63)),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, ROWS * 8, COLUMNS * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + dc_lengths + bytes(range(8, -1, -1))),
        _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00"),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


HEAD = _head()


def _words() -> np.ndarray:
    """The 10 bits of a block for each DC difference, -255 first: code, extra bits, and the end-of-block code 0."""
    out = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code = (1 << (9 - c)) - 2  # ones and a final zero, 9 - c bits
        out[d + 255] = ((code << c) | (d if d >= 0 else d + (1 << c) - 1)) << 1
    return out


WORDS = _words()


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All frames' AVI chunks (n x 192 samples) one after another, and the n + 1 offsets of these chunks."""
    n = len(samples)
    level = samples.astype(np.int16) - 128
    diff = np.diff(level, axis=1, prepend=np.int16(0))
    four = WORDS[diff + 255].reshape(n, UNIT // 4, 4)
    bits = (four[:, :, 0] << np.uint64(30)) | (four[:, :, 1] << np.uint64(20)) | (four[:, :, 2] << np.uint64(10)) | four[:, :, 3]
    coded = (bits[:, :, None] >> np.array([32, 24, 16, 8, 0], np.uint64)).astype(np.uint8).reshape(n, -1)
    full = coded == 0xFF
    stuffed = full.sum(axis=1)
    width = coded.shape[1]
    jpeg = len(HEAD) + width + stuffed + 2
    starts = np.concatenate([[0], np.cumsum(8 + jpeg + (jpeg & 1))])
    out = np.zeros(starts[-1], np.uint8)
    base = starts[:-1, None]
    out[base + np.arange(4)] = np.frombuffer(b"00dc", np.uint8)
    out[base + 4 + np.arange(4)] = jpeg.astype("<u4")[:, None].view(np.uint8)
    out[base + 8 + np.arange(len(HEAD))] = np.frombuffer(HEAD, np.uint8)
    shift = np.cumsum(full, axis=1) - full  # a zero byte follows every 0xFF
    out[base + 8 + len(HEAD) + np.arange(width) + shift] = coded
    end = starts[:-1] + 8 + jpeg - 2
    out[end], out[end + 1] = 0xFF, 0xD9
    return out, starts


def container(chunks: bytes, offsets: np.ndarray) -> bytes:
    """The AVI file around the frame chunks of one text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets) - 8
    avih = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 0x10, n, 0, 1, int(sizes.max(initial=0)), COLUMNS * 8, ROWS * 8, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, RATE, 0, n, int(sizes.max(initial=0)), 0xFFFFFFFF, 0, 0, 0, COLUMNS * 8, ROWS * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, COLUMNS * 8, ROWS * 8, 1, 24, b"MJPG", COLUMNS * ROWS * 64 * 3, 0, 0, 0, 0)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1] = int.from_bytes(b"00dc", "little"), 0x10
    index[:, 2] = 4 + offsets[:-1] - offsets[0]
    index[:, 3] = np.frombuffer(chunks, np.uint8)[(offsets[:-1] - offsets[0])[:, None] + 4 + np.arange(4)].copy().view("<u4")[:, 0] if n else 0
    body = b"AVI " + header + b"LIST" + struct.pack("<I", 4 + len(chunks)) + b"movi" + chunks + chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def frame_index(media: bytes) -> tuple[np.ndarray, float]:
    """Offset and size of every video frame in an AVI file, and the frames a second. Index offsets may count from the
    movi list or from the file's start; without an index the movi list is walked."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    movi, index, rate = None, None, float(RATE)
    todo = [(12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
                movi = at + 8, min(at + 8 + size, end)
            elif name == b"LIST":
                todo.append((at + 12, min(at + 8 + size, end)))
            elif name == b"strh" and media[at + 8 : at + 12] == b"vids":
                scale, per = struct.unpack_from("<II", media, at + 28)
                rate = per / scale if scale else rate
            elif name == b"idx1":
                index = np.frombuffer(media, "<u4", count=min(size, end - at - 8) // 16 * 4, offset=at + 8).reshape(-1, 4)
            at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no movi list")
    if index is not None:
        kind = index[:, 0] >> 16
        index = index[(kind == int.from_bytes(b"dc", "little")) | (kind == int.from_bytes(b"db", "little"))]
        at = index[:, 2].astype(np.int64)
        first = movi[0] + (at[0] if len(at) else 0)
        at += movi[0] if media[first + 2 : first + 4] in (b"dc", b"db") else 0
        return np.column_stack([at + 8, index[:, 3]]), rate
    found, at = [], movi[0] + 4
    while at + 8 <= movi[1]:
        size = struct.unpack_from("<I", media, at + 4)[0]
        if media[at + 2 : at + 4] in (b"dc", b"db"):
            found.append((at + 8, size))
        at += 8 + size + (size & 1)
    return np.array(found, np.int64).reshape(-1, 2), rate


class Tables:
    """What a frame's segments before its scan say."""

    def __init__(self, head: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[int, dict[tuple[int, int], int]] = {}
        self.restart, at = 0, 2
        while True:
            marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
            body = head[at + 4 : at + 2 + size]
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    lengths, code, at_symbol, codes = body[1:17], 0, 17, {}
                    for n, count in enumerate(lengths, 1):
                        for _ in range(count):
                            codes[n, code] = body[at_symbol]
                            code, at_symbol = code + 1, at_symbol + 1
                        code <<= 1
                    self.codes[body[0]] = codes
                    body = body[at_symbol:]
            elif marker == 0xC0:
                bits, self.height, self.width, parts = struct.unpack_from(">BHHB", body)
                if bits != 8 or parts != 1:
                    raise ValueError("only greyscale frames of 8 bits")
                self.use = body[8]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.dc, self.ac = self.codes[body[2] >> 4], self.codes[16 + (body[2] & 15)]
                self.end = at + 2 + size
                return
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline frames")
            at += 2 + size

    def fixed(self) -> tuple[int, np.ndarray] | None:
        """Bits of a block, and the DC difference of each word of so many bits, if blocks hold a DC coefficient only and
        code and extra bits always have one length together."""
        total = {n + c for (n, _), c in self.dc.items()}
        if self.restart or len(total) != 1 or set(self.ac.values()) != {0}:
            return None
        (n_end, end), bits = next(iter(self.ac)), total.pop()
        out = np.full(1 << (bits + n_end), np.iinfo(np.int32).min, np.int64)
        for (_, code), c in self.dc.items():
            for extra in range(1 << c):
                value = extra if not c or extra >> (c - 1) else extra - (1 << c) + 1
                out[(((code << c) | extra) << n_end) | end] = value
        return bits + n_end, out


@lru_cache(maxsize=64)
def tables(head: bytes) -> tuple[Tables, tuple[int, np.ndarray] | None]:
    own = Tables(head)
    return own, own.fixed()


def _head_end(frame: bytes) -> int:
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    return at + 2 + struct.unpack_from(">H", frame, at + 2)[0]


def decode_frame(frame: bytes) -> np.ndarray:
    """The samples of any greyscale baseline frame, height by width."""
    own, _ = tables(frame[: _head_end(frame)])
    data, at, bit = frame, own.end, 0

    def bits(n: int) -> int:
        nonlocal at, bit
        value = 0
        for _ in range(n):
            value = value << 1 | (data[at] >> (7 - bit) & 1)
            bit += 1
            if bit == 8:
                at, bit = at + (2 if data[at] == 0xFF and data[at + 1] == 0 else 1), 0
        return value

    def symbol(codes: dict) -> int:
        code = n = 0
        while True:
            code, n = code << 1 | bits(1), n + 1
            if (n, code) in codes:
                return codes[n, code]
            if n > 16:
                raise ValueError("bad code")

    def signed(c: int) -> int:
        v = bits(c)
        return v if not c or v >> (c - 1) else v - (1 << c) + 1

    across, down = -(-own.width // 8), -(-own.height // 8)
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    out, dc = np.zeros((down * 8, across * 8)), 0
    for block in range(across * down):
        if own.restart and block and block % own.restart == 0:
            at, bit, dc = at + (1 if bit else 0) + 2, 0, 0
        dc += signed(symbol(own.dc))
        coefficient = np.zeros(64)
        coefficient[0], place = dc, 1
        while place < 64:
            run, c = divmod(symbol(own.ac), 16)
            if c == 0 and run != 15:
                break
            place += run
            if c:
                coefficient[place] = signed(c)
            place += 1
        square = np.zeros(64)
        square[ZIGZAG] = coefficient * own.quant[own.use]
        r, c = divmod(block, across)
        out[r * 8 : r * 8 + 8, c * 8 : c * 8 + 8] = basis.T @ square.reshape(8, 8) @ basis + 128
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)[: own.height, : own.width]


def decode_frames(media: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One sample of each block of every frame: frames by blocks. Frames with the common head and blocks of one length
    are decoded together, others one by one."""
    n = len(at)
    if not n:
        return np.zeros((0, UNIT), np.uint8)
    head_n = _head_end(media[at[0] : at[0] + size[0]].tobytes())
    head = media[at[0] : at[0] + head_n]
    own, fixed = tables(head.tobytes())
    blocks = -(-own.width // 8) * -(-own.height // 8)
    alike = (size >= head_n) & (media[np.minimum(at[:, None] + np.arange(head_n), len(media) - 1)] == head).all(axis=1)
    if fixed is None or blocks * fixed[0] % 40 or not alike.all():
        return np.stack([decode_frame(media[a : a + s].tobytes())[::8, ::8].ravel() for a, s in zip(at, size, strict=True)])
    coded = size - head_n - 2
    base = np.repeat(at + head_n - np.concatenate([[0], np.cumsum(coded)[:-1]]), coded)
    place = base + np.arange(coded.sum())
    data = media[place]
    keep = ~((data == 0) & (media[place - 1] == 0xFF))
    wide = blocks * fixed[0] // 8
    data = data[keep]
    if len(data) != n * wide:
        raise ValueError("frames of another length than their blocks have")
    five = data.reshape(n, -1, 5).astype(np.uint64)
    forty = (five[:, :, 0] << np.uint64(32)) | (five[:, :, 1] << np.uint64(24)) | (five[:, :, 2] << np.uint64(16)) | (five[:, :, 3] << np.uint64(8)) | five[:, :, 4]
    per = 40 // fixed[0]
    shifts = np.arange(per - 1, -1, -1).astype(np.uint64) * np.uint64(fixed[0])
    words = (forty[:, :, None] >> shifts) & np.uint64((1 << fixed[0]) - 1)
    level = np.cumsum(fixed[1][words.reshape(n, blocks).astype(np.int64)], axis=1)
    return np.clip(np.rint(level * own.quant[own.use][0] / 8) + 128, 0, 255).astype(np.uint8)


def shots(frames: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each frame begins a shot, and the change of histogram before it. doc: the text of each frame, ascending.

    A change begins a shot if it is LEAST at least and more than the mean of the changes within AROUND frames of the same
    text by DEVIATIONS standard deviations."""
    n = len(frames)
    cell = (frames >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    hist = np.bincount(cell.ravel(), minlength=n * BINS).reshape(n, BINS) / max(1, frames.shape[1])
    first = np.r_[True, doc[1:] != doc[:-1]] if n else np.zeros(0, bool)
    change = np.zeros(n)
    change[1:] = np.abs(hist[1:] - hist[:-1]).sum(axis=1) / 2
    change[first] = 0
    start = np.flatnonzero(first)
    own = np.cumsum(first) - 1
    end = np.r_[start[1:], n]
    low = np.maximum(np.arange(n) - AROUND, start[own] + 1 if n else 0)
    high = np.minimum(np.arange(n) + AROUND + 1, end[own] if n else 0)
    low = np.minimum(low, high)
    one, two = (np.concatenate([[0], np.cumsum(np.rint(x * 2**20).astype(np.int64))]) for x in (change, change**2))  # whole numbers: no trace of other texts
    count = np.maximum(high - low, 1)
    mean = (one[high] - one[low]) / 2**20 / count
    sd = np.sqrt(np.maximum(0, (two[high] - two[low]) / 2**20 / count - mean**2))
    return first | ((change >= LEAST) & (change > mean + DEVIATIONS * sd)), change


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' payloads one after another: spaces fill each up to a positive multiple of UNIT."""
    size = np.diff(offsets)
    start = np.concatenate([[0], np.cumsum(np.maximum(1, -(-size // UNIT)) * UNIT)])
    out = np.full(start[-1], 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(start[:-1] - offsets[:-1], size)] = data
    return out, start


def stored(column: pa.Array) -> list[bytes]:
    """Each text's AVI file."""
    payload, start = padded(*utf8(column))
    chunks, at = encode_frames(payload.reshape(-1, UNIT))
    chunks = chunks.tobytes()
    return [container(chunks[at[a] : at[b]], at[a : b + 1]) for a, b in zip(start[:-1] // UNIT, start[1:] // UNIT, strict=True)]


def read(files: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """All frames of the files, the file of each, and the files' frames a second."""
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in files])]).astype(np.int64)
    found = [frame_index(f) for f in files]
    doc = np.repeat(np.arange(len(files)), [len(x) for x, _ in found])
    places = np.concatenate([x for x, _ in found]) if found else np.zeros((0, 2), np.int64)
    media = np.frombuffer(b"".join(files), np.uint8)
    return decode_frames(media, places[:, 0] + offsets[doc], places[:, 1].astype(np.int64)), doc, [r for _, r in found]


def digest(docs: DataFrame) -> DataFrame:
    """Per text: sizes and digests of payload and file, and features of what was read back."""

    def step(batches):
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                _, offsets = utf8(part.column("text"))
                files = stored(part.column("text"))
                frames, doc, rates = read(files)
                begins, change = shots(frames, doc)
                edge = np.searchsorted(doc, np.arange(len(files) + 1))
                back = frames.tobytes()
                rows: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
                cuts, level = np.concatenate([[0], np.cumsum(begins)]), np.concatenate([[0], np.cumsum(frames.sum(axis=1, dtype=np.int64))])
                for i, f in enumerate(files):
                    a, b = edge[i], edge[i + 1]
                    payload = back[a * UNIT : b * UNIT]
                    rows["payload_bytes"].append(len(payload))
                    rows["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                    rows["tail_crc32"].append(zlib.crc32(payload[-16:]))
                    rows["media_bytes"].append(len(f))
                    rows["media_sha256"].append(hashlib.sha256(f).hexdigest())
                    mean, most = (level[b] - level[a]) / max(1, (b - a) * UNIT), change[a:b].max(initial=0)
                    rows["feature"].append(f"{b - a} frames, {cuts[b] - cuts[a]} clips, {(b - a) / rates[i]:.2f} s, mean {mean:.3f}, change {most:.3f}")
                kinds = {"payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64()}
                yield batch_of(doc_id=part.column("doc_id"), n_bytes=pa.array(np.diff(offsets)), **{k: pa.array(v, kinds.get(k, pa.string())) for k, v in rows.items()})

    return map_arrow(texts(docs), step, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store(docs: DataFrame) -> DataFrame:
    """doc_id and its text's AVI file."""

    def step(batches):
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                yield batch_of(doc_id=part.column("doc_id"), media=pa.array(stored(part.column("text")), pa.binary()))

    return map_arrow(texts(docs), step, "doc_id long, media binary")


def clips(files: DataFrame, column: str = "media") -> DataFrame:
    """doc_id, clip, first_frame, n_frames, start_s, end_s for AVI files of greyscale baseline frames; null media have
    no clips, unreadable ones one row with a null clip and what is wrong."""

    def step(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                media = batch.column(column)[i].as_py()
                if media is None:
                    continue
                ids = batch.column("doc_id").slice(i, 1)
                try:
                    frames, doc, rates = read([media])
                    first = np.flatnonzero(shots(frames, doc)[0])
                    n = np.diff(np.r_[first, len(frames)])
                    said = pa.nulls(len(first), pa.string())
                    clip = pa.array(np.arange(len(first)), pa.int32())
                    times = [pa.array(x / rates[0]) for x in (first, first + n)]
                    ids = pa.array([ids[0].as_py()] * len(first), pa.int64())
                    yield batch_of(doc_id=ids, clip=clip, first_frame=pa.array(first, pa.int64()), n_frames=pa.array(n, pa.int64()), start_s=times[0], end_s=times[1], error=said)
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    none = {k: pa.nulls(1, t) for k, t in (("clip", pa.int32()), ("first_frame", pa.int64()), ("n_frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()))}
                    yield batch_of(doc_id=ids, **none, error=pa.array([str(e) or type(e).__name__]))

    return map_arrow(files.select("doc_id", column), step, "doc_id long, clip int, first_frame long, n_frames long, start_s double, end_s double, error string")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
