"""Arrow-batched work on the texts of a table."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A-Z to a-z in UTF-8; all other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    """Runs of bytes outside ASCII white space, A-Z lower-cased."""
    return text.translate(LOWER).split()


def text_groups(texts: list[bytes | None], most: int = 1 << 20) -> Iterator[list[bytes | None]]:
    """Runs of texts of about ``most`` bytes, so that arrays stay small."""
    group, n = [], 0
    for t in texts:
        group.append(t)
        n += len(t or b"") + 1
        if n >= most:
            yield group
            group, n = [], 0
    if group:
        yield group


def let_go() -> None:
    """Gives memory that a task has freed back to the system, where workers would keep it from one task to the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def map_texts(docs: DataFrame, id_col: str, text_col: str, work: Callable[[list[bytes | None]], list[list]], columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs``' id (and ``keep``) beside ``columns``, which ``work`` makes from a batch of texts in UTF-8, null as None. A kept text travels once."""
    kept = keep.index(text_col) + 1 if text_col in keep else None
    text = [F.col(text_col).cast("string").cast("binary").alias("_text")] if kept is None else []
    slim = docs.select(F.col(id_col).alias(id_col), *keep, *text)
    schema = T.StructType([f for f in slim.schema if f.name != "_text"] + list(T._parse_datatype_string(columns)))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.columns[:-1] if kept is None else batch.columns
            made = work(batch.columns[-1].to_pylist() if kept is None else batch.columns[kept].cast(pa.binary()).to_pylist())
            made = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, list(arrow)[len(own):], strict=True)]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(own, arrow, strict=False)), *made], schema=arrow)

    return slim.mapInArrow(run, schema)


_U = np.uint64
#: A random 64-bit value for each byte, A-Z as a-z, and the odd base of the polynomial that makes a word's hash.
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)[np.frombuffer(LOWER, np.uint8)]
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: Bytes whose hashes are summed at a time; a longer word is summed piece by piece.
_PIECE = 1 << 20
#: Bytes whose words are hashed from one running sum.
_STRETCH = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    return np.cumprod(np.full(n, base, np.uint64))


def _long_word(raw: np.ndarray) -> np.uint64:
    """The polynomial of one word of any length, in pieces."""
    total, scale = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    powers = _powers(_PIECE)
    for i in range(0, len(raw), _PIECE):
        piece = _BYTE[raw[i : i + _PIECE]]
        total += scale * np.sum(piece * powers[: len(piece)], dtype=np.uint64)
        scale = scale * powers[-1:]
    return total[0]


def spans_of_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes of some texts, where their words start and stop in them, the words' hashes, and how many words each text has."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = ~_SPACE[raw]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    del edge, inside
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return raw, starts, stops, np.zeros(0, np.uint64), counts
    lengths = stops - starts
    sums = np.empty(len(starts), np.uint64)
    powers = _powers(max(_STRETCH, min(int(lengths.max()), _PIECE)))
    back = _powers(_STRETCH, _INVERSE)
    upto = np.zeros(len(powers) + 1, np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(stops, low + _STRETCH, "right")))
        if lengths[at] > _PIECE:
            sums[at] = _long_word(raw[low : stops[at]])
        else:
            # A word's polynomial is a difference of running sums, divided by the power where it starts.
            n = int(stops[stop - 1]) - low
            np.cumsum(_BYTE[raw[low : low + n]] * powers[:n], out=upto[1 : n + 1])
            first = starts[at:stop] - low
            sums[at:stop] = (upto[stops[at:stop] - low] - upto[first]) * back[first] * _BASE
        at = stop
    return raw, starts, stops, mixed(sums + lengths.astype(np.uint64)), counts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and how many words each text has."""
    return spans_of_words(texts)[3:]


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of whole numbers, byte by byte, so that compression finds the small ones."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplaned(blob: bytes, at: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel()


def pack(columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Columns of whole numbers of any lengths, each in its own number of bytes, compressed."""
    raw = b"".join(planes(c, w) for c, w in columns)
    return np.array([len(c) for c, _ in columns], "<u8").tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    lengths = np.frombuffer(blob, "<u8", len(widths)).tolist()
    raw = pa.decompress(blob[8 * len(widths) :], sum(n * w for n, w in zip(lengths, widths, strict=True)), "zstd", asbytes=True)
    at, out = 0, []
    for n, w in zip(lengths, widths, strict=True):
        out.append(unplaned(raw, at, n, w))
        at += n * w
    return out
