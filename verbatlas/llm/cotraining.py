"""Document quality by co-training: a text view and a page-metadata view teach each other."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.batches import map_texts, split_words
from verbatlas.sources.shared import stash

#: Hashed features of the text view and of the metadata view.
TEXT, META = 1 << 16, 1 << 12
PULL = 2.0
#: Raw scores are counted in so many bins over [-RANGE, RANGE] for calibration.
BINS, RANGE = 2000, 20.0
#: Cells a side in which pairs of both views' log odds are counted for their weights.
GRID = 200
_EDGES = bytes(b for b in range(128) if not chr(b).isalnum())


def text_features(text: bytes | None) -> bytes:
    """Hashes of the distinct words, two bytes each; marks around a word are layout and belong to the other view."""
    words = {w.strip(_EDGES) for w in set(split_words(text or b""))} - {b""}
    found = {zlib.crc32(w) % TEXT for w in words}
    return np.sort(np.fromiter(found, np.uint16, len(found))).tobytes()


_UPPER, _DIGITS, _MARKS = (bytes(range(a, b)) for a, b in ((65, 91), (48, 58), (33, 48)))
_SYMBOLS = bytes(set(b"#$%&*|!<>=@^~_\\/[]{}+`"))


def layout_features(text: bytes | None) -> list[int]:
    """How a page is laid out, not what it says: shares of letters in capitals, digits, symbols, repeated words, word and line lengths, in bins."""
    text = text or b""
    words, n = text.split(), max(1, len(text))
    without = lambda drop: (len(text) - len(text.translate(None, drop))) / n
    k = max(1, len(words))
    shares = {
        "upper": without(_UPPER) * 2, "digits": without(_DIGITS) * 4, "symbols": without(_SYMBOLS) * 4, "distinct": len(set(words)) / k, "follows": sum(a == b for a, b in zip(words, words[1:])) / k,
        "short": sum(len(w) < 2 for w in words) / k * 2, "ends": sum(w[-1:] in b".!?" for w in words) / k * 4, "lines": (text.count(b"\n") + 1) / k * 4, "length": (n / k) / 16,
    }
    return [zlib.crc32(f"{name}={min(7, int(x * 8)) if x else -1}".encode()) % META for name, x in shares.items()]


class View(NamedTuple):
    """Naive Bayes over the presence of features, and a calibration of its damped sum: logit = slope * raw + shift.

    ``counts``: documents by class and feature; ``sizes``: by class. A feature's rates are drawn towards its rate in
    both classes together (PULL documents' worth), so that one that tells nothing weighs nothing.
    """

    counts: np.ndarray
    sizes: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, features: list[np.ndarray], own: np.ndarray | None = None) -> np.ndarray:
        """Sums of log odds over the root of the number of features; ``own``: classes of documents that are in the counts and must not count for themselves."""
        lengths = np.array([len(f) for f in features])
        flat = np.concatenate(features) if features else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(features)), lengths)
        c, n = self.counts[:, flat], np.repeat(self.sizes[:, None], len(flat), 1)
        if own is not None:
            itself = own[owner] == np.arange(2)[:, None]
            c, n = c - itself, n - itself
        c, n = np.maximum(c, 0), np.maximum(n, 0)
        pooled = (c.sum(0) + 0.5) / (n.sum(0) + 1)
        rates = (c + PULL * pooled) / (n + PULL)
        return np.clip(np.bincount(owner, np.log(rates[1] / rates[0]), len(features)) / np.sqrt(np.maximum(lengths, 1)), -RANGE, RANGE)

    def logit(self, features: list[np.ndarray], own: np.ndarray | None = None) -> np.ndarray:
        return self.slope * self.raw(features, own) + self.shift


def curve_loss(hist: np.ndarray, slope: float, shift: float) -> float:
    """Log loss, in nats, of a logistic curve over counts of classes by score."""
    z = slope * ((np.arange(BINS) + 0.5) / BINS * 2 * RANGE - RANGE) + shift
    return float((hist.sum(axis=0) * np.logaddexp(0, z) - hist[1] * z).sum())


def curve(hist: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic curve through counts of classes (2) by score (BINS), by damped Newton steps with a weak prior."""
    x = (np.arange(BINS) + 0.5) / BINS * 2 * RANGE - RANGE
    n, pos = hist.sum(axis=0), hist[1]
    start = np.array([1.0, math.log((pos.sum() + 1) / (n.sum() - pos.sum() + 1))])
    design = np.stack([x, np.ones(BINS)], 1)

    def loss(w: np.ndarray) -> float:
        return curve_loss(hist, w[0], w[1]) + 0.05 * float(((w - start) ** 2).sum())

    w = start
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (n * p - pos) + 0.1 * (w - start)
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), grad)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return max(0.0, float(w[0])), float(w[1]) if w[0] > 0 else float(start[1])


def batch_arrays(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """Feature numbers of each row of a batch, from bytes or from lists."""
    return [np.frombuffer(x, np.uint16).astype(np.int64) if isinstance(x, bytes) else np.array(x, np.int64) for x in batch.column(name).to_pylist()]


def summed(rows: DataFrame, width: int) -> np.ndarray:
    """(at, n) rows added up; ``width`` rows at most reach the driver."""
    out = np.zeros(width)
    for r in rows.groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def class_counts(data: DataFrame, views: tuple[View, View] | None, cuts: tuple[tuple[float, float], ...] = ()) -> list[tuple[np.ndarray, np.ndarray]]:
    """Documents by class and feature, and by class, for both views.

    Without ``views`` the labelled ones. With them, unlabelled ones, each in a view with
    the class that the *other* view gives it, if its raw score there lies beyond that view's cuts (low, high).
    """
    shared = data.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * (TEXT + META + 2), np.int64)
        for batch in batches:
            text, meta = batch_arrays(batch, "text"), batch_arrays(batch, "meta")
            if shared.value:
                given = [np.where(raw >= high, 1, np.where(raw <= low, 0, -1)) for (low, high), raw in zip(cuts, (shared.value[0].raw(text), shared.value[1].raw(meta)), strict=True)]
                labels = [given[1], given[0]]
            else:
                labels = [np.array(batch.column("y").to_pylist(), np.int64)] * 2
            start = 0
            for width, rows, label in ((TEXT, text, labels[0]), (META, meta, labels[1])):
                for c in (0, 1):
                    if chosen := [f for f, k in zip(rows, label, strict=True) if k == c]:
                        total[start : start + width] += np.bincount(np.concatenate(chosen), minlength=width)
                        total[start + width] += len(chosen)
                    start += width + 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at, "n": total[at]})

    rows = data.where(F.col("y").isNull() if views else F.col("y").isNotNull())
    found = summed(rows.select("text", "meta", "y").mapInArrow(run, "at long, n long"), 2 * (TEXT + META + 2))
    parts = found[: 2 * TEXT + 2].reshape(2, -1), found[2 * TEXT + 2 :].reshape(2, -1)
    return [(x[:, :-1], x[:, -1]) for x in parts]


def raw_scores(data: DataFrame, views: tuple[View, View]) -> np.ndarray:
    """Documents by view, kind (class 0, class 1, unlabelled) and bin of the raw score; a labelled one does not count for itself."""
    shared = data.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(6 * BINS, np.int64)
        for batch in batches:
            y = np.array([2 if v is None else v for v in batch.column("y").to_pylist()], np.int64)
            for i, (v, name) in enumerate(zip(shared.value, ("text", "meta"), strict=True)):
                bins = np.clip(((v.raw(batch_arrays(batch, name), y) + RANGE) / (2 * RANGE) * BINS).astype(int), 0, BINS - 1)
                total += np.bincount((3 * i + y) * BINS + bins, minlength=6 * BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at, "n": total[at]})

    return summed(data.select("text", "meta", "y").mapInArrow(run, "at long, n long"), 6 * BINS).reshape(2, 3, BINS)


def joint_scores(data: DataFrame, views: tuple[View, View], prior: float) -> np.ndarray:
    """Labelled documents by class and by both views' log odds above the prior (GRID cells each); none counts for itself."""
    shared = data.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * GRID * GRID, np.int64)
        for batch in batches:
            at = y = np.array(batch.column("y").to_pylist(), np.int64)
            for v, name in zip(shared.value, ("text", "meta"), strict=True):
                z = v.logit(batch_arrays(batch, name), y) - prior
                at = at * GRID + np.clip(((z + RANGE) / (2 * RANGE) * GRID).astype(int), 0, GRID - 1)
            total += np.bincount(at, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at, "n": total[at]})

    rows = data.where(F.col("y").isNotNull()).select("text", "meta", "y")
    return summed(rows.mapInArrow(run, "at long, n long"), 2 * GRID * GRID).reshape(2, GRID, GRID)


def view_weights(joint: np.ndarray, prior: float) -> np.ndarray:
    """Weights (not negative) of both views' log odds above the prior and a shift, by damped Newton steps.

    Views that were independent would add up with weights of one and the prior as shift; a weak pull leads there, labelled
    documents lead away. A view that would weigh less than nothing weighs nothing.
    """
    n = joint.sum(axis=0)
    rows, columns = np.nonzero(n)
    n, pos = n[rows, columns], joint[1][rows, columns]
    centre = lambda i: (i + 0.5) / GRID * 2 * RANGE - RANGE
    design = np.stack([centre(rows), centre(columns), np.ones(len(n))], 1)
    start = np.array([1.0, 1.0, prior])

    def fit(free: np.ndarray) -> np.ndarray:
        w, base = np.where(free, start, 0.0), np.where(free, start, 0.0)
        x = design * free

        def loss(w: np.ndarray) -> float:
            z = x @ w
            return float((n * np.logaddexp(0, z) - pos * z).sum()) + 0.05 * float(((w - base) ** 2).sum())

        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (n * p - pos) + 0.1 * (w - base))
            size = 1.0
            while size > 1e-4 and loss(w - size * step) > loss(w):
                size /= 2
            w = w - size * step
        return w

    found = fit(np.ones(3, bool))
    return fit(np.append(found[:2] >= 0, True)) if (found[:2] < 0).any() else found


def own_errors(hist: np.ndarray, view: View) -> tuple[float, float]:
    """How often a view errs on the labelled documents that it takes for class 0 and for class 1, (e + 1) / (n + 2)."""
    taken = view.slope * ((np.arange(BINS) + 0.5) / BINS * 2 * RANGE - RANGE) + view.shift >= 0
    return tuple(float((hist[1 - k, own].sum() + 1) / (hist[:2, own].sum() + 2)) for k, own in enumerate((~taken, taken)))


def exchange_cuts(hist: np.ndarray, share: float, prior: float, sure: float, pupil: tuple[float, float] = (1.0, 1.0)) -> tuple[float, float]:
    """Raw scores (low, high) beyond which a view hands out pseudo-labels; ``hist``: class 0, class 1 and unlabelled documents by score.

    Each class gets its part by the prior of ``share`` of the unlabelled documents, the most confident ones, so that the
    exchange keeps the classes' balance; and only where the labelled documents beyond the cut, none of which counted for itself, show at most 1 - ``sure``
    of the other class's own rate (of n with e of the other class, (e + 1) / (n + 2)), and no more than ``pupil``, what the other view errs itself when it takes documents for class 0 and for class 1:
    a view teaches only what it knows better. A view that cannot be so sure of both classes hands out none.
    """
    edges = np.arange(BINS + 1) / BINS * 2 * RANGE - RANGE

    def cut(wrong: np.ndarray, right: np.ndarray, free: np.ndarray, quota: float, most: float) -> int:
        """Bins from the confident end that may be handed out."""
        e, n, given = np.cumsum(wrong), np.cumsum(wrong + right), np.cumsum(free)
        good = ((e + 1) / (n + 2) <= most) & (given <= max(quota, given[np.argmax(given > 0)]))
        return int(np.flatnonzero(good).max(initial=-1)) + 1

    quota = share * hist[2].sum()
    low = cut(hist[1], hist[0], hist[2], quota * (1 - prior), min((1 - sure) * prior, pupil[0]))
    high = cut(hist[0][::-1], hist[1][::-1], hist[2][::-1], quota * prior, min((1 - sure) * (1 - prior), pupil[1]))
    return (edges[low], edges[BINS - high]) if low and high else (-math.inf, math.inf)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang"), size_col: str = "n_chars", label_col: str = "quality", rounds: int = 3, share: float = 0.2, sure: float = 0.5) -> DataFrame:
    """Quality of every document from two views that teach each other.

    Text view: the words of the whole text, without marks, order or number. Metadata view: ``meta_cols``, their pair, the
    magnitude of ``size_col``, and how the page is laid out (``layout_features``), but no word. Both start from the labelled documents; in each round the documents of
    which a view is surest (``share`` of the unlabelled ones more each round, of each class its part by the prior, none under ``sure`` and none of which the other view is as sure) teach the other view,
    together with no more weight than the labelled ones. After the last round labelled documents, each without its own part in the counts, calibrate the
    views and weigh their log odds (``view_weights``). Models have fixed size and are broadcast.

    Returns id, text_score, meta_score, score (probabilities of class 1), label_pred (score at
    least one half). Null or empty texts have no words and score by metadata; null metadata is a
    value of its own. An id with several labels has their rounded mean; labels of unknown ids are
    ignored; a null id has no label. Without labels every score is one half. Repeated rows stay.
    """
    size = F.when(F.col(size_col).isNull(), F.lit("none")).otherwise(F.floor(F.log2(F.greatest(F.col(size_col), F.lit(1)) * 4)).cast("string"))
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\x00"))) for c in meta_cols]
    meta = F.array(*parts, F.concat_ws("|", *parts), F.concat(F.lit("size="), size))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw"), F.transform(meta, lambda x: (F.crc32(x) % META).cast("int")).alias("meta"))
    made = map_texts(slim, "id", "raw", lambda texts: [[text_features(t) for t in texts], [layout_features(t) for t in texts]], "text binary, layout array<int>", ("meta",))
    made = made.withColumn("meta", F.array_distinct(F.concat("meta", "layout"))).drop("layout")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.round(F.avg(label_col)).cast("int").alias("y"))
    # Labels grow with the documents, so they are never broadcast, at any size.
    data = stash(made.join(known.hint("merge"), F.col("id") == F.col("_id"), "left").drop("_id"), "quality-features")
    positive, labelled = data.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("y")).first()
    rate = (positive + 1) / (labelled + 2)
    prior = math.log(rate / (1 - rate))
    first = class_counts(data, None)
    views = tuple(View(c, n) for c, n in first)
    for i in range(rounds + 1):
        hist = raw_scores(data, views)
        views = tuple(v._replace(slope=x[0], shift=x[1]) for v, x in zip(views, (curve(h[:2]) for h in hist), strict=True))
        if i < rounds:
            errors = [own_errors(h, v) for h, v in zip(hist, views, strict=True)]
            cuts = tuple(exchange_cuts(h, min(1.0, share * (i + 1)), rate, sure, pupil) for h, pupil in zip(hist, reversed(errors), strict=True))
            given = class_counts(data, views, cuts)
            weight = [min(1.0, n.sum() / max(1.0, m.sum())) for (_, n), (_, m) in zip(first, given, strict=True)]
            views = tuple(View(c + w * d, n + w * m) for (c, n), (d, m), w in zip(first, given, weight, strict=True))
    weights = view_weights(joint_scores(data, views, prior), prior)
    shared = docs.sparkSession.sparkContext.broadcast(views)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.array([2 if v is None else v for v in batch.column("y").to_pylist()], np.int64)
            by_text, by_meta = (v.logit(batch_arrays(batch, name), y) for v, name in zip(shared.value, ("text", "meta"), strict=True))
            p = [1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (by_text, by_meta, weights[0] * (by_text - prior) + weights[1] * (by_meta - prior) + weights[2])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, p), pa.array((p[2] >= 0.5).astype(np.int32))], names=["id", "text_score", "meta_score", "score", "label_pred"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return data.select("id", "text", "meta", "y").mapInArrow(score, f"id {id_type}, text_score double, meta_score double, score double, label_pred int").withColumnRenamed("id", id_col)
