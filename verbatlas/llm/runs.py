"""Periodic runs of words: stretches that repeat a phrase three times or more, found by multi-scale minimizers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.batches import map_texts, mixed, text_groups

#: Periods up to this one are found by comparing every word with the one ``period`` words on; longer ones by minimizers.
DIRECT = 16
RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string, n_words bigint"
_C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _over_windows(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """``op`` over every ``width`` neighbours, by doubling."""
    have, y = 1, x
    while 2 * have <= width:
        y = op(y[:-have], y[have:])
        have *= 2
    rest = width - have
    return op(y[: len(y) - rest], y[rest:]) if rest else y


def _scales(longest: int) -> list[tuple[int, int]]:
    """(from, to): a scale finds the periods above ``from`` up to ``to``; steps of a half and a third in turn."""
    found, low = [], DIRECT
    while low < longest:
        high = low * 3 // 2 if low & (low - 1) == 0 else low * 4 // 3
        found.append((low, high))
        low = high
    return found


def _same_from(seq: np.ndarray, at: int, lag: int) -> int:
    """How many words from ``at`` on equal the word ``lag`` further on."""
    n, step = 0, 64
    while at + lag + n < len(seq):
        a, b = seq[at + n : at + n + step], seq[at + lag + n : at + lag + n + step]
        a = a[: len(b)]
        differ = a != b
        if differ.any():
            return n + int(differ.argmax())
        n += len(b)
        step *= 2
    return n


def _same_before(seq: np.ndarray, at: int, lag: int) -> int:
    """How many words just before ``at`` equal the word ``lag`` further on."""
    n, step = 0, 64
    while n < at:
        step = min(step, at - n)
        differ = seq[at - n - step : at - n] != seq[at - n - step + lag : at - n + lag]
        if differ.any():
            return n + int(differ[::-1].argmax())
        n += step
        step *= 2
    return n


def _by_direct_lags(seq: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal stretch of a short period."""
    found = []
    for lag in range(1, min(DIRECT, len(seq) - 1) + 1):
        breaks = np.flatnonzero(seq[:-lag] != seq[lag:])
        edges = np.concatenate([[-1], breaks, [len(seq) - lag]])
        gaps = np.diff(edges) - 1
        for i in np.flatnonzero(gaps + lag >= max(least, exponent * lag)).tolist():
            found.append((int(edges[i]) + 1, int(gaps[i]) + lag, lag))
    return found


def _by_minimizers(seq: np.ndarray, lengths: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """The same for longer periods. ``seq``: texts one after the other, the longest first, a word of its own behind each.

    Inside a run of period q, runs of K >= q words repeat at distance q and at no smaller one. For q above ``low`` a window of ``2 * low - K + 3`` places and
    the same window q further on both lie in a run of length 3q, so the least hash of the first window stands in the second again, and the
    two are neighbours among equal minimizers. Such a pair is itself a square of period q, so extending pairs costs no more than the squares are long.
    """
    found = []
    ends = np.cumsum(lengths + 1)
    level, size = mixed(seq.astype(np.uint64)), 1
    for low, high in _scales(int(lengths[0]) // exponent):
        texts = int(np.count_nonzero(lengths >= exponent * (low + 1)))
        if not texts:
            break
        upto = int(ends[texts - 1])
        while 2 * size <= high:
            level = mixed(level[:-size] * _C + level[size:])
            size *= 2
        own = level[: max(0, upto - size + 1)]
        keys = own if size == high else mixed(own[: len(own) - (high - size)] * _D + own[high - size :])
        width = 2 * low - high + 3
        if len(keys) < width:
            continue
        least_of = _over_windows(keys, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        places = np.flatnonzero(_over_windows(np.concatenate([edge, least_of, edge]), width, np.maximum) == keys)
        order = places[np.argsort(keys[places], kind="stable")]
        value, lag = keys[order], np.diff(order)
        pair = (value[:-1] == value[1:]) & (lag > low) & (lag <= high)
        at, lag = order[:-1][pair], lag[pair]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        groups = np.concatenate([[0], np.flatnonzero(np.diff(lag)) + 1, [len(lag)]]) if len(lag) else np.zeros(1, int)
        for a, b in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
            period, i = int(lag[a]), a
            while i < b:
                p = int(at[i])
                right = _same_from(seq, p, period)
                left = _same_before(seq, p, period) if right else 0
                length = left + right + period
                if right and length >= max(least, exponent * period):
                    found.append((p - left, length, period))
                i = max(i + 1, a + int(np.searchsorted(at[a:b], p + right)))
    return found


def find_runs(texts: list[list[bytes]], least: int = 24, exponent: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text's words, by start and then period.

    A run has its smallest period, at least ``least`` words and ``exponent`` periods, and no neighbouring word extends it. Work is a constant number of array
    passes for each scale that a text is long enough for.
    """
    if exponent < 3:
        raise ValueError("minimizers are sure to meet a run only from three periods on")
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((i for i, t in enumerate(texts) if len(t) >= max(least, exponent)), key=lambda i: -len(texts[i]))
    if not order:
        return runs
    names: dict[bytes, int] = {}
    lengths = np.array([len(texts[i]) for i in order])
    seq = np.empty(int(lengths.sum()) + len(order), np.int64)
    at = 0
    for k, i in enumerate(order):
        n = len(texts[i])
        seq[at : at + n] = [names.setdefault(w, len(names)) for w in texts[i]]
        seq[at + n] = -1 - k
        at += n + 1
    starts = np.cumsum(lengths + 1) - lengths - 1
    smallest: dict[tuple[int, int], int] = {}
    for start, length, period in [*_by_direct_lags(seq, least, exponent), *_by_minimizers(seq, lengths, least, exponent)]:
        smallest[start, length] = min(period, smallest.get((start, length), period))
    for (start, length), period in smallest.items():
        k = int(np.searchsorted(starts, start, "right")) - 1
        runs[order[k]].append((start - int(starts[k]), length, period))
    for found in runs:
        found.sort(key=lambda r: (r[0], r[2]))
    return runs


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds beyond its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, least: int = 24, exponent: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, runs (array of start, length, period in words from 0), collapsed (the text with each run's first period only), n_words.

    Words are runs outside ASCII white space, compared byte by byte. Every row is taken by itself, so repeated rows have equal results; a null, empty or blank text
    has no run and collapses to ''; a null id stays null; an empty table gives none.
    """

    def work(batch: list[bytes | None]) -> list[list]:
        runs, collapsed, counts = [], [], []
        for group in text_groups(batch, 4 << 20):
            words = [(t or b"").split() for t in group]
            for own, found in zip(words, find_runs(words, least, exponent), strict=True):
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                collapsed.append(b" ".join(kept_words(own, found)).decode("utf-8", "replace"))
                counts.append(len(own))
        return [runs, collapsed, counts]

    return map_texts(docs, id_col, text_col, work, RUNS)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` where a tenth of the texts, chosen by crc32 of the id, repeat one of their own phrases to the end.

    With h the crc32 of the id in decimals and g = h div 10: where h mod 10 is 0, word i from a = g mod n on becomes word a + (i - a) mod p with
    p = 1 + (n - a) div (3 + g mod 8). Texts without words and rows without id stay.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def of(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        index = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.array_join(F.transform(index, lambda i: F.get(w, i.cast("int"))), " ")

    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, of(w)))[0]
    return docs.withColumn(text_col, F.when(F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False)), F.coalesce(planted, F.col(text_col))).otherwise(F.col(text_col)))


def run_digest(found: DataFrame) -> DataFrame:
    """One row for each of ``periodic_runs``: the count, the run with the greatest exponent (then the smallest start, then period), and digests of runs and text."""
    run = F.struct(*[F.lit(None).cast("bigint").alias(c) for c in ("start", "length", "period")])
    best = F.aggregate("runs", run, lambda a, b: F.when(a["period"].isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    chosen = found.withColumn("_best", best)
    return chosen.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
