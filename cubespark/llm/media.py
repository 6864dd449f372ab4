"""Media columns: magic bytes by Aho-Corasick, validators for structure and length, carving of embedded media."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, spread

#: Magic bytes, the offset at which they stand in a file, and its type (fixed values of the formats).
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"RIFF", 0, "audio/wav"),
    (b"WEBP", 8, "image/webp"),
    (b"ftyp", 4, "video/mp4"),
    (b"ID3", 0, "audio/mpeg"),
    (b"\xff\xfb", 0, "audio/mpeg"),
    (b"\xff\xf3", 0, "audio/mpeg"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
]


#: Boxes at the top of an MP4 file (fixed values of the format).
BOXES = {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"sidx", b"styp", b"meta", b"uuid", b"pdin", b"emsg"}
#: Bits a second of MPEG audio layer III, in thousands, by version 1 and 2, and samples a second (fixed values of the format).
MP3_RATES = ([0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160])
MP3_SAMPLES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


class Bytes(bytes):
    """Bytes that remember where a mark was found last: many signatures before one mark search for it once."""

    def next(self, mark: bytes, at: int) -> int:
        """The place of the next ``mark`` from ``at`` on, or -1."""
        seen = self.__dict__.setdefault(mark, [0, -2])
        if not (seen[0] <= at and (seen[1] == -1 or at <= seen[1])):
            seen[:] = at, self.find(mark, at)
        return seen[1]


# ---- validators: the end of a sound file that starts at ``at``, or None ----


def _png(b: Bytes, at: int) -> int | None:
    i, first = at + 8, True
    while i + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, i)
        end = i + 12 + size
        if end > len(b) or (first and (kind != b"IHDR" or size != 13)) or zlib.crc32(memoryview(b)[i + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end
        i, first = end, False
    return None


def _jpeg(b: Bytes, at: int) -> int | None:
    i = at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind, size = b[i + 1], struct.unpack_from(">H", b, i + 2)[0]
        if kind < 0xC0 or size < 2 or i + 2 + size > len(b):
            return None
        i += 2 + size
        if kind == 0xDA:
            end = b.next(b"\xff\xd9", i)
            return end + 2 if end >= 0 else None
    return None


def _gif(b: Bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    i = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)

    def after_blocks(i: int) -> int:
        while i < len(b) and b[i]:
            i += b[i] + 1
        return i + 1

    while i < len(b):
        if b[i] == 0x3B:
            return i + 1
        if b[i] == 0x21:
            i = after_blocks(i + 2)
        elif b[i] == 0x2C and i + 10 < len(b):
            i = after_blocks(i + 10 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 0x80 else 0) + 1)
        else:
            return None
    return None


def _bmp(b: Bytes, at: int) -> int | None:
    if at + 26 > len(b):
        return None
    size, reserved, start, header = struct.unpack_from("<IIII", b, at + 2)
    sound = not reserved and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size and at + size <= len(b)
    return at + size if sound else None


def _wav(b: Bytes, at: int) -> int | None:
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return None
    end, i, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, set()
    if end > len(b):
        return None
    while i + 8 <= end:
        kind, size = struct.unpack_from("<4sI", b, i)
        if i + 8 + size > end or (kind == b"data" and b"fmt " not in seen):
            return None
        seen.add(kind)
        i += 8 + size + size % 2
    return end if i in (end, end + 1) and b"data" in seen else None


def _table(bits: int, poly: int) -> list[int]:
    """The check sums of single bytes, highest bit first."""
    out, top = [], 1 << bits - 1
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ poly if x & top else x << 1) & (1 << bits) - 1
        out.append(x)
    return out


CRC8, CRC16 = _table(8, 0x07), _table(16, 0x8005)


def _flac_frame(b: Bytes, i: int) -> tuple[int, int] | None:
    """(header's end, samples) of a frame's header whose check sum holds."""
    if i + 6 > len(b) or b[i] != 0xFF or b[i + 1] & 0xFE != 0xF8 or b[i + 3] & 1:
        return None
    size, rate = b[i + 2] >> 4, b[i + 2] & 15
    first = b[i + 4]
    more = 0 if first < 0x80 else 8 - (first ^ 0xFF).bit_length() - 1
    j = i + 5 + more
    if size == 0 or rate == 15 or more == 0 and first >= 0x80 or j + 4 > len(b):
        return None
    if size in (6, 7):
        n = int.from_bytes(b[j : j + size - 5], "big") + 1
        j += size - 5
    else:
        n = 192 if size == 1 else 144 << size if size < 6 else 1 << size
    j += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for x in b[i:j]:
        crc = CRC8[crc ^ x]
    return (j + 1, n) if j < len(b) and b[j] == crc else None


def _flac(b: Bytes, at: int) -> int | None:
    """Frames are walked by their check sums until the samples that the file promises are there; a file that
    promises none ends with its last sound frame."""
    i, last = at + 4, 0
    if b[i : i + 4] not in (b"\0\0\0\x22", b"\x80\0\0\x22") or i + 38 > len(b):
        return None
    wanted = int.from_bytes(b[i + 17 : i + 22], "big") & (1 << 36) - 1
    while not last:
        if i + 4 > len(b):
            return None
        last, size = b[i] & 0x80, int.from_bytes(b[i + 1 : i + 4], "big")
        i += 4 + size
    done = 0
    while (head := _flac_frame(b, i)) is not None:
        crc, end = 0, None
        for j in range(i, len(b)):
            crc = (crc << 8 & 0xFFFF) ^ CRC16[crc >> 8 ^ b[j]]
            if crc == 0 and j > head[0] and (done + head[1] >= wanted > 0 or j + 1 == len(b) or not wanted or _flac_frame(b, j + 1)):
                end = j + 1
                break
        if end is None:
            return None
        i, done = end, done + head[1]
        if done >= wanted > 0:
            return i
    return i if done and not wanted else None


def _webp(b: Bytes, at: int) -> int | None:
    if b[at : at + 4] != b"RIFF" or at + 20 > len(b) or b[at + 12 : at + 15] != b"VP8":
        return None
    end, i = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12
    while i + 8 <= end <= len(b):
        size = struct.unpack_from("<I", b, i + 4)[0]
        i += 8 + size + size % 2
    return end if i == end <= len(b) else None


def _mp4(b: Bytes, at: int) -> int | None:
    i, seen = at, set()
    while i + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, i)
        if size == 1 and i + 16 <= len(b):
            size = struct.unpack_from(">Q", b, i + 8)[0]
        if kind not in BOXES or kind == b"ftyp" and seen or size < 8 or i + size > len(b):
            break
        seen.add(kind)
        i += size
    return i if seen & {b"moov", b"moof"} and b"mdat" in seen else None


def _mp3(b: Bytes, at: int) -> int | None:
    """An ID3 tag, if any, and three frames or more, each where the one before ends."""
    i, frames = at, 0
    if b[at : at + 3] == b"ID3":
        if at + 10 > len(b) or max(b[at + 6 : at + 10]) > 127:
            return None
        i += 10 + sum(x << 7 * (3 - k) for k, x in enumerate(b[at + 6 : at + 10]))
    while i + 4 <= len(b) and b[i] == 0xFF and b[i + 1] & 0xE6 == 0xE2:
        version, rate, samples = b[i + 1] >> 3 & 3, b[i + 2] >> 4, b[i + 2] >> 2 & 3
        if version == 1 or rate in (0, 15) or samples == 3:
            break
        end = i + (144 if version == 3 else 72) * MP3_RATES[version != 3][rate] * 1000 // MP3_SAMPLES[version][samples] + (b[i + 2] >> 1 & 1)
        if end > len(b):
            break
        i, frames = end, frames + 1
    return i if frames >= 3 else None


def _ogg(b: Bytes, at: int) -> int | None:
    i = at
    while b[i : i + 5] == b"OggS\0" and i + 27 <= len(b):
        n = b[i + 26]
        end = i + 27 + n + sum(b[i + 27 : i + 27 + n])
        if end > len(b):
            return None
        if b[i + 5] & 4:
            return end
        i = end
    return None


def _pdf(b: Bytes, at: int) -> int | None:
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return None
    end = b.next(b"%%EOF", at)
    return end + 5 if end >= 0 and -1 < b.next(b"startxref", at) < end else None


def _zip(b: Bytes, at: int) -> int | None:
    end = b.next(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, start, comment = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + comment if at + start + size == end and end + 22 + comment <= len(b) else None


def _gzip(b: Bytes, at: int) -> int | None:
    flow, i = zlib.decompressobj(31), at
    try:
        while i < len(b) and not flow.eof:
            flow.decompress(b[i : i + 65536], 1 << 20)
            while flow.unconsumed_tail:
                flow.decompress(flow.unconsumed_tail, 1 << 20)
            i += 65536
    except zlib.error:
        return None
    return min(i, len(b)) - len(flow.unused_data) if flow.eof else None


VALID = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": _wav, "audio/flac": _flac, "audio/ogg": _ogg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "image/webp": _webp, "video/mp4": _mp4, "audio/mpeg": _mp3}


@lru_cache(maxsize=1)
def _signatures() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, offset, kind in MAGIC:
        found.add_word(magic.decode("latin-1"), (offset + len(magic), kind))
    found.make_automaton()
    return found


def scan(blob: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of the sound files in ``blob``, in order; what lies within another one isn't told apart.

    A gzip file must be unpacked to find its end: in pieces, at most some 1,000 times its bytes. A PDF ends with its
    first end mark.
    """
    out, free, held = [], 0, Bytes(blob)
    for last, (size, kind) in _signatures().iter(blob.decode("latin-1")):
        start = last + 1 - size
        if start >= free and (end := VALID[kind](held, start)) is not None:
            out.append((kind, start, end - start))
            free = end
    return out


_FOUND = "array<struct<type:string,start:bigint,length:bigint>>"


def sniff(df: DataFrame, blob: str, declared: str, out: str = "found", actual: str = "actual_type") -> DataFrame:
    """``df`` with the media ``found`` in ``blob`` and its ``actual_type``.

    A signature counts only if its format's validator confirms the structure up to an end. A blob that is one such
    file from its first byte on is of that type, whatever ``declared`` says; otherwise the declared type stays.
    Null and empty blobs hold nothing. Equal blobs get equal values; columns named like the new ones are replaced.
    """

    def found(blobs: pa.Array) -> pa.Array:
        rows = [[{"type": k, "start": s, "length": n} for k, s, n in scan(x)] for x in as_bytes(blobs)]
        return pa.array(rows, pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))

    at_start = F.when(F.get(out, 0)["start"] == 0, F.get(out, 0)["type"])
    return df.withColumn(out, F.arrow_udf(found, _FOUND)(F.col(blob))).withColumn(actual, F.coalesce(at_start, F.col(declared)))


def carve(df: DataFrame, blob: str, found: str = "found", out: str = "carved") -> DataFrame:
    """``df`` with ``out``: the bytes of each medium ``found`` in ``blob``, in order."""
    return df.withColumn(out, F.transform(found, lambda x: F.substring(F.col(blob), (x["start"] + 1).cast("int"), x["length"].cast("int"))))


# ---- payloads as media ----


def as_wav(payload: bytes, rate: int = 8000) -> bytes:
    """One channel of unsigned 8-bit samples."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def as_png(payload: bytes, width: int) -> bytes:
    """Rows of 8-bit grey; the length of ``payload`` must be a multiple of ``width``."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join([b"\0" + payload[i : i + width] for i in range(0, len(payload), width)])
    return MAGIC[0][0] + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(payload) // width, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 1)) + chunk(b"IEND", b"")


def samples(medium: bytes) -> bytes:
    """The 8-bit samples of a file that as_wav or as_png wrote."""
    if medium[:4] == b"RIFF":
        return medium[44 : 44 + struct.unpack_from("<I", medium, 40)[0]]
    width = struct.unpack_from(">I", medium, 16)[0]
    packed, i = [], 8
    while i < len(medium):
        size, kind = struct.unpack_from(">I4s", medium, i)
        if kind == b"IDAT":
            packed.append(medium[i + 8 : i + 8 + size])
        i += 12 + size
    rows = zlib.decompress(b"".join(packed))
    return b"".join([rows[i + 1 : i + 1 + width] for i in range(0, len(rows), width + 1)])


def padded(raw: bytes, unit: int = 576) -> bytes:
    return raw + b"\xff" * (unit - len(raw) % unit if not raw or len(raw) % unit else 0)


#: What stands between the media of one payload.
BETWEEN = b"\r\n--\r\n"


def as_media(payload: bytes, unit: int = 576) -> bytes:
    """The first half of the units (the larger one) as WAV, the rest as PNG of ``unit`` pixels a row behind a border."""
    half = (len(payload) // unit + 1) // 2 * unit
    return as_wav(payload[:half]) + (BETWEEN + as_png(payload[half:], unit) if half < len(payload) else b"")


def store(df: DataFrame, text: str = "text", out: str = "media", unit: int = 576) -> DataFrame:
    """``df`` with ``out``: the UTF-8 of ``text`` (null: empty), padded by bytes 255 to a positive multiple of ``unit``
    and stored without loss as 8-bit samples: one medium for a single unit, two in one blob for more.

    Equal texts get equal bytes; an empty table gives an empty table; a column named ``out`` is replaced.
    """

    def stored(texts: pa.Array) -> pa.Array:
        return pa.array((as_media(padded(x, unit), unit) for x in as_bytes(texts)), pa.binary(), size=len(texts))

    return spread(df).withColumn(out, F.arrow_udf(stored, "binary")(F.col(text)))


def read_back(df: DataFrame, media: str, out: str = "payload") -> DataFrame:
    """``df`` with ``out``: the samples of all ``media`` (an array of files that store() wrote, as carve() gives them),
    one after the other; null for null."""

    def back(column: pa.Array) -> pa.Array:
        return pa.array((None if x is None else b"".join(map(samples, x)) for x in (y.as_py() for y in column)), pa.binary(), size=len(column))

    return df.withColumn(out, F.arrow_udf(back, "binary")(F.col(media)))
