"""Media columns: signature sniffing, structure checks, carving, and lossless storage of bytes as sound samples."""

from __future__ import annotations

import bisect
import functools
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Payloads are padded with FILL to a positive multiple of FRAME bytes.
FRAME, FILL = 576, 255
WAV_RATE = 8000
#: Bytes that are inflated at a time.
PIECE = 1 << 16


class Blob:
    """Bytes in which the places of a mark are looked up once, however many media may end there."""

    def __init__(self, b: bytes):
        self.b = b
        self.known: dict[bytes, list[int]] = {}
        self.walks: dict[str, dict[int, object]] = {}

    def walked(self, name: str, at: int, step: Callable[[bytes, int], tuple[int, object]]) -> object:
        """Where a walk from ``at`` leads. ``step`` gives (next place, None), or (-1, result); walks that meet share the rest, so a blob is walked once for each kind of walk."""
        known, path = self.walks.setdefault(name, {}), []
        result = known.get(at)
        while result is None:
            path.append(at)
            at, result = step(self.b, at)
            if result is None:
                result = known.get(at)
        known.update(dict.fromkeys(path, result))
        return result

    @functools.cached_property
    def gif_ends(self) -> np.ndarray:
        """For each place that some walk over a GIF's blocks has passed, one more than where it ends (1: nowhere, 0: not passed)."""
        return np.zeros(len(self.b) + 1, np.int64)

    @functools.cached_property
    def gif_stops(self) -> np.ndarray:
        """The same for walks over sub-blocks: one more than the place of the empty one."""
        return np.zeros(len(self.b) + 1, np.int64)

    def places(self, mark: bytes) -> list[int]:
        if mark not in self.known:
            found, at = [], self.b.find(mark)
            while at >= 0:
                found.append(at)
                at = self.b.find(mark, at + 1)
            self.known[mark] = found
        return self.known[mark]

    def first(self, mark: bytes, at: int) -> int:
        """The first place from ``at`` on, -1 if there is none."""
        found = self.places(mark)
        i = bisect.bisect_left(found, at)
        return found[i] if i < len(found) else -1

    def last(self, mark: bytes, start: int, stop: int) -> int:
        """The last place in [start, stop), -1 if there is none."""
        found = self.places(mark)
        i = bisect.bisect_left(found, stop) - 1
        return found[i] if i >= 0 and found[i] >= start else -1

    @functools.cached_property
    def zips(self) -> dict[int, int]:
        """Start of each zip archive, as its end-of-directory record states it, and its end; the last record of a start counts."""
        out = {}
        for p in self.places(b"PK\x05\x06"):
            if p + 22 <= len(self.b):
                n, start = struct.unpack_from("<II", self.b, p + 12)
                end = p + 22 + struct.unpack_from("<H", self.b, p + 20)[0]
                if end <= len(self.b):
                    out[p - n - start] = end
        return out


def _png_step(b: bytes, p: int) -> tuple[int, int | None]:
    if p + 12 > len(b):
        return -1, 0
    n, kind = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
    if p + 12 + n > len(b) or zlib.crc32(memoryview(b)[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
        return -1, 0
    return (-1, p + 12 + n) if kind == b"IEND" else (p + 12 + n, None)


def png_length(blob: Blob, at: int) -> int:
    """Walks chunks, checking each one's CRC, until IEND."""
    b = blob.b
    if b[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return 0
    end = blob.walked("png", at + 8, _png_step)
    return end - at if end else 0


def _gif_stop(blob: Blob, p: int) -> int:
    """The place of the empty sub-block that ends a list of sub-blocks; the length of the bytes or more if there is none."""
    b, stops, path, size = blob.b, blob.gif_stops, [], len(blob.b)
    while p < size and b[p] and not stops[p]:
        path.append(p)
        p += 1 + b[p]
    end = int(stops[p]) - 1 if p < size and stops[p] else p
    if path:
        stops[path] = end + 1
    return end


def gif_length(blob: Blob, at: int) -> int:
    """Walks blocks and their sub-blocks until the trailer."""
    b, size = blob.b, len(blob.b)
    if at + 13 > size:
        return 0
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    ends, path, end = blob.gif_ends, [], 0
    while p < size:
        if ends[p]:
            end = int(ends[p]) - 1
            break
        path.append(p)
        kind = b[p]
        if kind == 0x3B:
            end = p + 1
            break
        if kind == 0x21:
            p += 2
        elif kind == 0x2C and p + 10 <= size:
            p += 10 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0) + 1
        else:
            break
        p = _gif_stop(blob, p) + 1
    if path:
        ends[path] = end + 1
    return end - at if end else 0


def jpeg_length(blob: Blob, at: int) -> int:
    """Walks marker segments to the scan, then looks for the end marker."""
    b, p = blob.b, at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xDA:
            end = blob.first(b"\xff\xd9", p)
            return end + 2 - at if end > 0 else 0
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2:
            return 0
        p += 2 + n
    return 0


def riff_chunks(b: bytes, at: int) -> Iterator[tuple[bytes, int, int]]:
    """(id, start, length) of each chunk; stops where one leaves its container."""
    end, p = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12
    while p + 8 <= end <= len(b):
        n = struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + n > end:
            return
        yield b[p : p + 4], p + 8, n
        p += 8 + n + (n & 1)


def _first_chunk(wanted: bytes) -> Callable[[bytes, int], tuple[int, int | None]]:
    """A step to where the first chunk whose id begins with ``wanted`` ends; 0 if none comes."""

    def step(b: bytes, p: int) -> tuple[int, int | None]:
        if p + 8 > len(b):
            return -1, 0
        n = struct.unpack_from("<I", b, p + 4)[0]
        if b.startswith(wanted, p):
            return -1, p + 8 + n
        return p + 8 + n + (n & 1), None

    return step


def riff_length(blob: Blob, at: int, form: bytes, needed: tuple[bytes, ...]) -> int:
    """The length that the header states, if the chunks needed lie inside."""
    b = blob.b
    if at + 12 > len(b) or b[at + 8 : at + 12] != form:
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    ends = [blob.walked(f"riff {name!r}", at + 12, _first_chunk(name)) for name in needed]
    return end - at if end <= len(b) and all(0 < e <= end for e in ends) else 0


def bmp_length(blob: Blob, at: int) -> int:
    b = blob.b
    if at + 26 > len(b) or b[at + 6 : at + 10] != bytes(4):
        return 0
    n, start, header = struct.unpack_from("<I", b, at + 2)[0], struct.unpack_from("<I", b, at + 10)[0], struct.unpack_from("<I", b, at + 14)[0]
    return n if header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= n and at + n <= len(b) else 0


def pdf_length(blob: Blob, at: int) -> int:
    """Up to the last end mark before the next header: linearised and updated files have several."""
    nxt = blob.first(b"%PDF-", at + 1)
    end = blob.last(b"%%EOF", at, nxt if nxt >= 0 else len(blob.b))
    return end + 5 - at if end > 0 and blob.last(b"startxref", at, end) >= 0 else 0


def zip_length(blob: Blob, at: int) -> int:
    """Up to an end-of-directory record whose offsets agree with this start; archives stored inside have their own."""
    return blob.zips.get(at, at) - at


def gzip_length(blob: Blob, at: int) -> int:
    """Inflates piece by piece, keeping nothing, until the stream ends."""
    b = blob.b
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    d, p = zlib.decompressobj(31), at
    try:
        while p < len(b) and not d.eof:
            d.decompress(b[p : p + PIECE], PIECE)
            while d.unconsumed_tail and not d.eof:
                d.decompress(d.unconsumed_tail, PIECE)
            p += PIECE
    except zlib.error:
        return 0
    return min(p, len(b)) - len(d.unused_data) - at if d.eof else 0


def _flac_step(b: bytes, p: int) -> tuple[int, int | None]:
    if p + 4 > len(b):
        return -1, 0
    end = p + 4 + int.from_bytes(b[p + 1 : p + 4], "big")
    return (-1, end) if b[p] & 0x80 else (end, None)


def flac_length(blob: Blob, at: int) -> int:
    """Metadata blocks only: frames carry no total length, so the rest of the bytes belongs to it."""
    b, p = blob.b, at + 4
    if p + 4 > len(b) or b[p] & 0x7F or int.from_bytes(b[p + 1 : p + 4], "big") != 34:
        return 0
    end = blob.walked("flac", p, _flac_step)
    return len(b) - at if 0 < end <= len(b) else 0


def _ogg_step(b: bytes, p: int) -> tuple[int, int | None]:
    if p + 27 > len(b) or b[p : p + 4] != b"OggS" or p + 27 + b[p + 26] > len(b):
        return -1, 0
    n = b[p + 26]
    end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
    return (-1, end if end <= len(b) else 0) if b[p + 5] & 4 else (end, None)


def ogg_length(blob: Blob, at: int) -> int:
    """Walks pages until the one that ends the stream."""
    end = blob.walked("ogg", at, _ogg_step)
    return end - at if end else 0


#: Magic bytes, the type they announce, and the check of structure and length (0: not valid).
FORMATS: list[tuple[bytes, str, Callable[[Blob, int], int]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", png_length),
    (b"GIF87a", "image/gif", gif_length),
    (b"GIF89a", "image/gif", gif_length),
    (b"\xff\xd8\xff", "image/jpeg", jpeg_length),
    (b"RIFF", "audio/wav", lambda b, at: riff_length(b, at, b"WAVE", (b"fmt ", b"data"))),
    (b"RIFF", "image/webp", lambda b, at: riff_length(b, at, b"WEBP", (b"VP8",))),
    (b"BM", "image/bmp", bmp_length),
    (b"%PDF-", "application/pdf", pdf_length),
    (b"PK\x03\x04", "application/zip", zip_length),
    (b"\x1f\x8b\x08", "application/gzip", gzip_length),
    (b"fLaC", "audio/flac", flac_length),
    (b"OggS", "audio/ogg", ogg_length),
]


@functools.lru_cache(maxsize=1)
def magic_automaton() -> ahocorasick.Automaton:
    """All magics in one automaton over bytes read as Latin-1 characters."""
    made = ahocorasick.Automaton()
    for magic in dict.fromkeys(m for m, _, _ in FORMATS):
        made.add_word(magic.decode("latin-1"), (len(magic), [(kind, check) for m, kind, check in FORMATS if m == magic]))
    made.make_automaton()
    return made


def sniff(b: bytes) -> list[tuple[str, int, int]]:
    """Valid media in ``b``: (type, offset, length), by offset; the longer first at one offset."""
    found, blob = [], Blob(b)
    for end, (n, kinds) in magic_automaton().iter(b.decode("latin-1")):
        at = end - n + 1
        for kind, check in kinds:
            if length := check(blob, at):
                found.append((kind, at, length))
    return sorted(found, key=lambda x: (x[1], -x[2]))


def map_media(df: DataFrame, media_col: str, work: Callable[[list[bytes | None], list], list[list]], columns: str, also: str | None = None) -> DataFrame:
    """``df`` with ``columns`` that ``work`` makes from batches of media (and one more column)."""
    schema = T.StructType(list(df.schema) + list(T._parse_datatype_string(columns)))
    arrow, names = to_arrow_schema(schema), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = batch.column(names.index(also)).to_pylist() if also else []
            made = work(batch.column(names.index(media_col)).to_pylist(), more)
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), *(pa.array(x, f.type) for x, f in zip(made, list(arrow)[len(names):], strict=True))], schema=arrow)

    return df.mapInArrow(run, schema)


def sniff_media(df: DataFrame, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """``df`` with what its media really are.

    Adds detected_type (of the valid media that starts at offset 0; the declared type stays where
    none does), media_length (its length by its own structure, null if none), type_corrected, and
    embedded: array<struct<type, offset, length>> of valid media inside, found at other offsets
    and not inside one another. ``carve`` cuts them out. Null media: nothing detected, no embedded
    ones, the declared type kept. Rows are independent: no shuffle. Columns that have these names are replaced.
    """
    df = df.drop("detected_type", "media_length", "type_corrected", "embedded")

    def work(media: list[bytes | None], declared: list) -> list[list]:
        kinds, lengths, corrected, inside = [], [], [], []
        for b, said in zip(media, declared, strict=True):
            found = sniff(b or b"")
            own = next((x for x in found if x[1] == 0), None)
            kinds.append(own[0] if own else said)
            lengths.append(own[2] if own else None)
            corrected.append(own is not None and own[0] != said)
            kept, end = [], 0
            for kind, at, n in found:
                if at >= max(end, 1):
                    kept.append({"type": kind, "offset": at, "length": n})
                    end = at + n
            inside.append(kept)
        return [kinds, lengths, corrected, inside]

    return map_media(df, media_col, work, "detected_type string, media_length long, type_corrected boolean, embedded array<struct<type:string,offset:long,length:long>>", declared_col)


def carve(sniffed: DataFrame, media_col: str = "media") -> DataFrame:
    """A row for each embedded medium: its type, offset, length and bytes beside the row's other columns."""
    rest = [c for c in sniffed.columns if c not in (media_col, "embedded")]
    return sniffed.select(*rest, media_col, F.explode("embedded").alias("_e")).select(*rest, F.col("_e.type").alias("carved_type"), F.col("_e.offset").alias("carved_offset"), F.col("_e.length").alias("carved_length"), F.expr(f"substring(`{media_col}`, cast(_e.offset as int) + 1, cast(_e.length as int))").alias("carved"))


def wav(samples: bytes) -> bytes:
    """One channel of 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, WAV_RATE, WAV_RATE, 1, 8, b"data", len(samples)) + samples


def wav_samples(b: bytes, at: int = 0) -> bytes:
    return next(b[p : p + n] for kind, p, n in riff_chunks(b, at) if kind == b"data")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """Every whole text's UTF-8 bytes as a sound: id, n_bytes, declared, media. Null counts as empty."""
    slim = docs.select(F.col(id_col), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"), F.lit(declared).alias("declared"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_raw"))

    def work(raw: list[bytes | None], _: list) -> list[list]:
        return [[wav(t + bytes([FILL]) * (-len(t) % FRAME if t else FRAME)) for t in raw]]

    return map_media(slim, "_raw", work, "media binary").drop("_raw")


def media_features(sniffed: DataFrame, media_col: str = "media") -> DataFrame:
    """``sniffed`` sounds without their bytes: payload digests from the samples read back, and a feature string.

    The feature holds detected type, sample rate, seconds, mean and deviation of the samples, zero
    crossings about the mean, and the embedded media. A row whose media is no valid sound has nulls.
    """

    def work(media: list[bytes | None], kinds: list) -> list[list]:
        out: list[list] = [[], [], [], [], [], []]
        for b, kind in zip(media, kinds, strict=True):
            row: list = [None] * 6
            if b is not None and kind == "audio/wav":
                samples = wav_samples(b)
                x = np.frombuffer(samples, np.uint8)
                mean = float(x.mean()) if len(x) else 0.0
                above = x > mean
                feature = f"{kind};rate={WAV_RATE};frames={len(x) // FRAME};mean={mean:.4f};dev={float(x.std()) if len(x) else 0.0:.4f};crossings={int(np.count_nonzero(above[1:] != above[:-1]))}"
                row = [len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(b), hashlib.sha256(b).hexdigest(), feature]
            for column, v in zip(out, row, strict=True):
                column.append(v)
        return out

    return map_media(sniffed, media_col, work, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", "detected_type").drop(media_col)
