"""Language identification by nearest of several centroids for each language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.batches import LOWER, map_texts

#: Hashed n-gram dimensions, and the n-gram lengths in bytes.
DIMENSIONS, LENGTHS = 1 << 14, (2, 3)
#: Documents turned into one dense block at a time.
BLOCK = 256
_LETTERS = bytes(LOWER[b] if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def letters(text: bytes | None) -> bytes:
    """Words of letters with single spaces around them; empty if the text has no letter."""
    joined = b" ".join((text or b"").translate(_LETTERS).split())
    if not joined or (joined.translate(None, bytes(range(128, 256)) + b" ") == b"" and not any(c.isalpha() for c in joined.decode(errors="ignore"))):
        return b""
    return b" " + joined + b" "


def gram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed n-grams of the letters."""
    a = np.frombuffer(text, np.uint8).astype(np.uint32)
    codes = []
    for n in LENGTHS:
        code = np.full(max(len(a) - n + 1, 0), n, np.uint32)
        for i in range(n):
            code = code * np.uint32(257) + a[i : len(a) - n + 1 + i]
        codes.append((code * np.uint32(2654435761)) >> np.uint32(32 - 14))
    return np.bincount(np.concatenate(codes), minlength=DIMENSIONS)


def tfidf(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows; a text without n-grams is a zero row."""
    rows = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(rows, texts, strict=True):
        if text:
            row[:] = np.log1p(gram_counts(text)) * idf
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=rows, where=norms > 0)


def cluster(rows: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: unit centroids, and each row's cosine to its own."""
    seeds = [rows.mean(axis=0)]
    while len(seeds) < min(k, len(rows)):
        seeds.append(rows[np.argmin((rows @ np.array(seeds).T).max(axis=1))])
    centroids = np.array(seeds)
    for _ in range(rounds):
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
        own = np.argmax(rows @ centroids.T, axis=1)
        centroids = np.array([rows[own == j].mean(axis=0) if (own == j).any() else c for j, c in enumerate(centroids)])
    centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids, (rows @ centroids.T).max(axis=1)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Documents with each hashed n-gram, over all of ``docs``; each task sends one count for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if text := letters(raw):
                    df += gram_counts(text) > 0
                    n += 1
        yield pa.RecordBatch.from_pydict({"at": np.arange(DIMENSIONS + 1), "n": np.append(df, n)})

    rows = docs.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(DIMENSIONS + 1, np.int64)
    for r in rows:
        found[r["at"]] = r["n"]
    return found[:-1], int(found[-1])


class Centroids:
    """Languages, unit centroids, and the cosine under which a text is too far from its centroid's own."""

    def __init__(self, langs: list[str], vectors: np.ndarray, floors: np.ndarray, idf: np.ndarray):
        self.langs, self.vectors, self.floors, self.idf = langs, vectors, floors, idf

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float], list[bool]]:
        kept = [letters(t) for t in texts]
        names, scores, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        for start in range(0, len(kept) if self.langs else 0, BLOCK):
            block = kept[start : start + BLOCK]
            cosines = tfidf(block, self.idf) @ self.vectors.T
            best = cosines.argmax(axis=1)
            for i, text in enumerate(block):
                if text:
                    j, c = int(best[i]), float(min(1.0, max(0.0, cosines[i, best[i]])))
                    names[start + i], scores[start + i], rejected[start + i] = self.langs[j], c, bool(c < self.floors[j])
        return names, scores, rejected


def fit_centroids(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, per_centroid: int = 3, slack: float = 0.5) -> Centroids:
    """Centroids of each language that occurs in ``labelled``.

    N-gram document frequencies come from all labelled rows. Clustering uses a sample of about
    ``per_language`` rows a language, drawn by a hash of the id (never over ``2 * per_language``),
    one task for each language. A centroid's floor is ``slack`` times the 1st percentile of its
    sample's cosines. Rows without language or letters teach nothing.
    """
    labelled = labelled.where(F.col(lang_col).isNotNull())
    df, n = document_frequencies(labelled, text_col)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    shares = labelled.groupBy(F.col(lang_col).alias("_lang")).agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("_share"))
    key = F.xxhash64(F.lit("lang"), F.col(id_col))
    sample = labelled.select(F.col(lang_col).alias("_lang"), key.alias("key"), F.col(text_col).cast("string").cast("binary").alias("text")).join(F.broadcast(shares), "_lang")
    sample = sample.where(F.pmod("key", F.lit(1 << 30)) < F.col("_share") * (1 << 30))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key").head(2 * per_language)
        texts = [x for x in map(letters, group["text"]) if x]
        if not texts:
            return pd.DataFrame({"lang": [], "vector": [], "floor": []})
        rows = tfidf(texts, idf)
        vectors, cosines = cluster(rows, per_centroid)
        floor = slack * float(np.quantile(cosines, 0.01))
        return pd.DataFrame({"lang": group["_lang"].iloc[0], "vector": list(vectors.astype(np.float32)), "floor": floor})

    found = sample.groupBy("_lang").applyInPandas(fit, "lang string, vector array<float>, floor double").collect()
    found.sort(key=lambda r: (r["lang"], r["vector"]))
    return Centroids([r["lang"] for r in found], np.array([r["vector"] for r in found], np.float32).reshape(len(found), DIMENSIONS), np.array([r["floor"] for r in found]), idf)


def identify(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Language of every whole text: id, ``keep``, lang_pred, score (cosine to the nearest centroid), rejected.

    ``rejected``: farther from the centroid than its floor allows, or without letters; the latter
    (null and empty texts too) are ``und`` with score 0. The model (languages times centroids times
    DIMENSIONS floats) is broadcast; no shuffle. Rows stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, id_col, text_col, lambda texts: list(shared.value.predict(texts)), "lang_pred string, score double, rejected boolean", keep)


def crc_of_id(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string"))


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """Languages of all ``docs`` (beside id, held_out and ``keep``), learnt from those whose CRC-32 of the id is no multiple of 5; a null id is held out."""
    held = F.coalesce(crc_of_id(id_col) % 5 == 0, F.lit(True))
    docs = docs.withColumn("held_out", held)
    return identify(docs, fit_centroids(docs.where(~F.col("held_out")), id_col, text_col), id_col, text_col, ("held_out", *keep))
