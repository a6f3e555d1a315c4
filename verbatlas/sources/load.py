"""Loaders over landed files, licence gate, provenance, and table upkeep."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbatlas.functions import text as X
from verbatlas.operators.joins import lookup
from verbatlas.sources.shared import stash

EDITION = "quran array<struct<chapter:int,verse:int,text:string>>"
STRUCTURE = "chapters array<struct<chapter:int,name:string,arabicname:string,englishname:string,revelation:string,verses:array<struct<verse:int,juz:int,ruku:int,page:int,hizb:int,manzil:int,sajda:boolean>>>>"
EXTERNAL = "metadata struct<name:string>, chapters array<struct<id:long,english:string,arabic:string>>, hadiths array<struct<idInBook:long,id:long,chapterId:long,arabic:string,english:struct<narrator:string,text:string>,grade:string>>"
LEXICON = "root string, headword string, text string, ref string"
GOLDEN = "id string, tier string, kind string, question string, source_of_truth string, tool string, args string, expect string"
# Fixed tag values of the annotation format.
PERSON_GENDER_NUMBER = "^[123]?[MF]?[SDP]$"
ASPECTS, CASES, STATES = ("PERF", "IMPF", "IMPV"), ("NOM", "ACC", "GEN"), ("DEF", "INDEF")
DERIVATIONS = ("ACT_PCPL", "PASS_PCPL", "VN", "ADJ", "SUP")
TAGS = (
    "P", "PN", "DET", "CONJ", "REL", "PRON", "NEG", "DEM", "COND", "INTG", "LOC", "SUB", "RES", "VOC", "PRO", "PRP", "CIRC", "RSLT", "CERT", "EMPH", "AMD", "ANS",
    "INC", "EXH", "SUR", "AVR", "EXL", "EXP", "RET", "PREV", "FUT", "T", "FAM", "ADDR", "ATT", "CAUS", "DIST", "INL", "INT", "REM", "EQ", "ACC_PART", "IMPV_PART",
)


def read_edition(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """section_id, unit_num, text of a JSON edition: a document a file, or (in parts, for large ones) a line."""
    return spark.read.schema(EDITION).option("multiLine", one_document).json(path).select(F.explode("quran").alias("q")).select(F.col("q.chapter").alias("section_id"), F.col("q.verse").alias("unit_num"), F.col("q.text").alias("text"))


def read_structure(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """A row for each unit with its section's names and cohort; a document a file, or a line."""
    chapters = spark.read.schema(STRUCTURE).option("multiLine", one_document).json(path).select(F.explode("chapters").alias("c"))
    return chapters.select(F.col("c.chapter").alias("section_id"), F.col("c.englishname").alias("section_name"), F.lower("c.revelation").alias("cohort"), F.explode("c.verses").alias("v")).select("section_id", "section_name", "cohort", F.col("v.verse").alias("unit_num"), F.col("v.juz").alias("juz"), F.col("v.ruku").alias("block_id"), F.col("v.page").alias("page"))


def build_units(primary: DataFrame, alternative: DataFrame, structure: DataFrame, ordinals: DataFrame) -> DataFrame:
    """Units with alternative text (primary where missing), twins, counts, cohort and ordinal; ids in section order."""
    keys = ["section_id", "unit_num"]
    joined = primary.join(alternative.withColumnRenamed("text", "alt"), keys, "left").join(structure, keys, "left").join(ordinals, "section_id", "left")
    text = X.nfc(F.col("text"))
    # unit_id is section times 1e5 plus number: unique while sections have under 1e5 units, without a global sort.
    return joined.select(
        (F.col("section_id").cast("long") * 100_000 + F.col("unit_num")).alias("unit_id"), *keys, "text", F.coalesce("alt", "text").alias("alt_text"), X.search_form(text).alias("text_search"), X.loose_form(text).alias("text_loose"),
        F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("n_words"), X.letter_count(F.col("text")).alias("n_letters"), *[c for c in structure.columns if c not in keys], "ordinal",
    )


def strip_heading(units: DataFrame, heading: Sequence[str], not_in: Sequence[int] = (), text: str = "text") -> DataFrame:
    """First units without a heading of whole words, where more words follow; excluded sections keep it."""
    words = F.split(F.col(text), r"\s+")
    n = len(heading)
    head = F.array(*[F.lit(w) for w in heading])
    hit = (F.col("unit_num") == 1) & ~F.col("section_id").isin(list(not_in)) & (F.size(words) > n) & (F.transform(F.slice(words, 1, n), X.search_form) == F.transform(head, X.search_form))
    return units.withColumn(text, F.when(hit, F.array_join(F.slice(words, n + 1, 1_000_000), " ")).otherwise(F.col(text)))


def ordinal_report(ordinals: DataFrame, sections: DataFrame) -> DataFrame:
    """One row: whether the ordinals are a permutation of 1..N for N sections."""
    n = sections.agg(F.countDistinct("section_id").alias("sections"))
    o = ordinals.agg(F.count("*").alias("rows"), F.min("ordinal").alias("lowest"), F.max("ordinal").alias("highest"), F.countDistinct("ordinal").alias("distinct"))
    return o.join(F.broadcast(n)).withColumn("valid", (F.col("rows") == F.col("sections")) & (F.col("lowest") == 1) & (F.col("highest") == F.col("sections")) & (F.col("distinct") == F.col("sections")))


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` with rows of equal keys replaced; of repeated incoming keys the last in column order stays."""
    rest = [c for c in incoming.columns if c not in keys]
    one = incoming.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else incoming.distinct()
    return existing.join(one, list(keys), "left_anti").unionByName(one)


def parse_annotation(lines: DataFrame, col: str = "value") -> DataFrame:
    """section_id, unit_num, position, seg, form, coarse, features of tab-separated lines; comments, short lines and bad places are left out."""
    parts = F.split(F.col(col), "\t")
    place = F.split(parts[0], ":")
    good = lines.where((F.col(col) != "") & ~F.col(col).startswith("#") & (F.size(parts) >= 3) & parts[0].rlike(r"^\d+:\d+:\d+:\d+$"))
    return good.select(*[place[i].cast("int").alias(n) for i, n in enumerate(("section_id", "unit_num", "position", "seg"))], parts[1].alias("form"), parts[2].alias("coarse"), F.coalesce(F.get(parts, F.lit(3)), F.lit("")).alias("features"))


def parse_features(bundle: Column) -> Column:
    """A struct of promoted features and the rest of a ``|``-separated bundle.

    Later values of a keyed or listed feature win, the first known tag is the headline tag, person,
    gender and number come from marks such as 3MS, and an aspect without voice means ACT.
    """
    items = F.filter(F.split(F.coalesce(bundle, F.lit("")), r"\|"), lambda x: x != "")
    keyed, plain = F.filter(items, lambda x: F.contains(x, F.lit(":"))), F.filter(items, lambda x: ~F.contains(x, F.lit(":")))

    def value(key: str) -> Column:
        return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(keyed, lambda x: F.startswith(x, F.lit(key + ":"))), lambda x: F.substring(x, len(key) + 2, 100_000))), -1)

    def last_of(values: Sequence[str]) -> Column:
        return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(plain, lambda x: x.isin(*values))), -1)

    marks = F.filter(plain, lambda x: x.rlike(PERSON_GENDER_NUMBER) & ~x.isin(*TAGS))

    def mark(pattern: str, more: Sequence[str] = ()) -> Column:
        source = F.filter(plain, lambda x: (x.rlike(PERSON_GENDER_NUMBER) & ~x.isin(*TAGS)) | x.isin(*more)) if more else marks
        found = F.filter(F.transform(source, lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != "")
        return F.element_at(F.concat(F.array(F.lit(None).cast("string")), found), -1)

    promoted = ("ROOT", "LEM", "VF", "MOOD")
    known = (*ASPECTS, *CASES, *STATES, *DERIVATIONS, "PREF", "SUFF", "PASS", "M", "F")
    others = F.filter(plain, lambda x: ~x.isin(*known) & ~(x.rlike(PERSON_GENDER_NUMBER) & ~x.isin(*TAGS)))
    tags = F.filter(others, lambda x: x.isin(*TAGS))
    rest = F.filter(keyed, lambda x: ~F.substring_index(x, ":", 1).isin(*promoted))
    aspect = last_of(ASPECTS)
    voice = F.when(F.array_contains(plain, "PASS"), "PASS").when(aspect.isNotNull(), "ACT")
    extra = F.map_from_entries(F.transform(F.array_distinct(F.transform(rest, lambda x: F.substring_index(x, ":", 1))), lambda k: F.struct(k, F.element_at(F.transform(F.filter(rest, lambda x: F.substring_index(x, ":", 1) == k), lambda x: F.regexp_replace(x, "^[^:]*:", "")), -1))))
    return F.struct(
        value("ROOT").alias("term"), value("LEM").alias("lemma"), F.get(tags, F.lit(0)).alias("tag"), aspect.alias("aspect"), value("VF").alias("verb_form"), value("MOOD").alias("mood"), voice.alias("voice"), last_of(CASES).alias("case"), last_of(STATES).alias("state"),
        mark("^([123])").alias("person"), mark("^[123]?([MF])", ("M", "F")).alias("gender"), mark("([SDP])$").alias("number"), last_of(DERIVATIONS).alias("derivation"), F.array_contains(plain, "PREF").alias("is_prefix"), F.array_contains(plain, "SUFF").alias("is_suffix"), extra.alias("features"), others.alias("tags"),
    )


def dictionaries(occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms (key, first-seen display) and lemmas (lemma, term); ``line_no`` orders what was seen first."""
    live = occurrences.where(F.col("term").isNotNull()).withColumn("key", X.term_key(F.col("term")))
    terms = live.groupBy("key").agg(F.min_by("term", "line_no").alias("display"), F.count("*").alias("occurrences"))
    lemmas = live.where(F.col("lemma").isNotNull()).groupBy("lemma", F.col("key").alias("term")).agg(F.min("line_no").alias("first_line"))
    return terms, lemmas


def lift_stems(occurrences: DataFrame) -> DataFrame:
    """One analysis for each word: the first segment with a term, else the first that is no affix, else the first."""
    priority = F.when(F.col("term").isNotNull(), 0).when(~F.coalesce("is_prefix", F.lit(False)) & ~F.coalesce("is_suffix", F.lit(False)), 1).otherwise(2)
    return occurrences.groupBy("unit_id", "position").agg(F.min_by(F.struct("term", "lemma", "coarse"), F.struct(priority, "seg")).alias("s")).select("unit_id", "position", "s.*")


def align_words(words: DataFrame, tokens: DataFrame, most: int = 4) -> DataFrame:
    """unit_id, position, display: annotation words on the display tokens that spell them.

    ``words``: unit_id, words (array of folded forms in order). ``tokens``: unit_id, tokens (display),
    folded (their folded forms). Up to ``most`` tokens are merged until they spell the word; where
    none fit, one token is passed over. Sequential within a unit, so one row holds a unit; units are independent.
    """
    schema = T.StructType([T.StructField("unit_id", words.schema["unit_id"].dataType), T.StructField("position", T.IntegerType()), T.StructField("display", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for unit, forms, shown, folded in zip(*(batch.column(c).to_pylist() for c in ("unit_id", "words", "tokens", "folded")), strict=True):
                at = 0
                for position, form in enumerate(forms or [], 1):
                    if not form:
                        continue
                    fit = next((n for n in range(1, most + 1) if at + n <= len(folded) and "".join(folded[at : at + n]) == form), 0)
                    if fit:
                        for column, v in zip(out, (unit, position, "".join(shown[at : at + fit])), strict=True):
                            column.append(v)
                    at += fit or 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column("unit_id").type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=["unit_id", "position", "display"])

    return words.join(tokens, "unit_id").select("unit_id", "words", "tokens", "folded").mapInArrow(run, schema)


def load_texts(rows: DataFrame, units: DataFrame, edition: str) -> DataFrame:
    """Unit-keyed texts of one edition: trimmed, empty ones dropped, unknown units dropped."""
    return rows.withColumn("text", F.trim("text")).where(F.col("text") != "").join(units.select("unit_id", "section_id", "unit_num"), ["section_id", "unit_num"]).select("unit_id", F.lit(edition).alias("edition"), "text")


def write_partition(df: DataFrame, path: str, key: str) -> None:
    """Replaces only the partitions of ``key`` that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def collapse_runs(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """group, start, end, text, chunk_index: runs of equal consecutive texts; empty runs are dropped, chunks count kept runs."""
    w = Window.partitionBy(group).orderBy(order)
    value = F.coalesce(F.trim(F.col(text)), F.lit(""))
    marked = rows.withColumn("_v", value).withColumn("_new", F.coalesce((F.col("_v") != F.lag("_v").over(w)).cast("int"), F.lit(1)))
    runs = marked.withColumn("_run", F.sum("_new").over(w)).groupBy(group, "_run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.first("_v").alias("text"), F.count("*").alias("length")).where(F.col("text") != "")
    return runs.withColumn("chunk_index", F.row_number().over(Window.partitionBy(group).orderBy("_run")) - 1).drop("_run")


def first_records(rows: DataFrame, key: Column | str, order: str) -> DataFrame:
    """The first row of each key: an aggregate, so a frequent key does not gather in a task."""
    rest = [c for c in rows.columns if c != order]
    key_col = key if isinstance(key, Column) else F.col(key)
    return rows.groupBy(key_col.alias("_key")).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"), F.min(order).alias(order)).select("_key", order, "_r.*")


def external_documents(spark: SparkSession, path: str, edition: str, default_grading: str | None = None) -> DataFrame:
    """External documents: the first record of a number wins; narrator and text join; grading falls back to the collection's, then unknown."""
    rows = spark.read.schema(EXTERNAL).option("multiLine", True).json(path).select(F.posexplode("hadiths").alias("_pos", "h"))
    flat = rows.select("_pos", F.coalesce("h.idInBook", "h.id").cast("string").alias("number"), F.col("h.arabic").alias("text"), F.trim(F.concat_ws(" ", "h.english.narrator", "h.english.text")).alias("translation"), F.coalesce(F.when(F.trim("h.grade") != "", F.trim("h.grade")), F.lit(default_grading), F.lit("unknown")).alias("grading"))
    return first_records(flat, "number", "_pos").drop("_key", "_pos").withColumns({"edition": F.lit(edition), "text_search": X.search_form(F.col("text"))})


def load_lexicon(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """Lexicon entries with their term where the dictionary has it; unmatched ones stay with a null term."""
    entries = spark.read.schema(LEXICON).json(path).where(F.trim("text") != "").withColumn("key", X.term_key(F.col("root")))
    return lookup(entries, terms.select("key", F.col("display").alias("term")), "key", "left")


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden items from JSON lines; absent fields are null, repeated items stay."""
    return spark.read.schema(GOLDEN).json(path)


def licence_gate(rows: DataFrame, editions: DataFrame, allowed: Sequence[str], key: str = "edition") -> tuple[DataFrame, DataFrame]:
    """(admitted, withheld) rows by their edition's licence status and availability; an unknown edition is withheld."""
    good = editions.where(F.col("status").isin(list(allowed)) & F.coalesce("available", F.lit(True))).select(F.col("slug").alias(key))
    return rows.join(good, key, "left_semi"), rows.join(good, key, "left_anti")


def audit_editions(rows: DataFrame, editions: DataFrame, allowed: Sequence[str], key: str = "edition") -> DataFrame:
    """slug, status, rows, shipped of every edition."""
    counts = rows.groupBy(F.col(key).alias("slug")).agg(F.count("*").alias("rows"))
    return editions.join(counts, "slug", "left").select("slug", "status", F.coalesce("rows", F.lit(0)).alias("rows"), (F.coalesce(F.col("status").isin(list(allowed)), F.lit(False)) & F.coalesce("available", F.lit(True))).alias("shipped"))


#: Files that Spark's line reader would unpack, and the size of the pieces in which others travel.
PACKED_FILES, PIECE = "*.{gz,gzip,bz2,deflate,lz4,snappy,zst,zstd,xz}", 16 << 10
BOM = b"\xef\xbb\xbf"


class Digest:
    """SHA-256 of a file that comes as its lines, each with a line feed behind it.

    Whether the file ends in one, and whether a mark that the reader leaves out stood at its head, is seen from its size.
    """

    def __init__(self, size: int):
        self.size, self.seen, self.last = size, 0, b""
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(BOM)

    def update(self, data: bytes) -> None:
        for h in (self.plain, self.marked):
            h.update(self.last)
            h.update(memoryview(data)[:-1])
        self.seen, self.last = self.seen + len(data), bytes(memoryview(data)[-1:])

    def hexdigest(self, name: str) -> str:
        more = self.seen - self.size
        if more not in (0, 1, -3, -2):
            raise ValueError(f"{name}: {self.seen} bytes read of {self.size}")
        h = self.plain if more >= 0 else self.marked
        if more in (0, -3):
            h.update(self.last)
        return h.hexdigest()


def digests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, sha256 of files of any size, but those without a line: no file is held whole.

    Files are read as lines. A split that is a whole file is hashed where it is read; pieces of larger files go to a task for each file, in order, which takes them
    one by one, since a digest goes from the first byte to the last. Files named as compressed ones, which Spark reads as lines only unpacked, are taken whole (2 GB at most).
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(place: tuple, number: int, data: bytes | None, sha256: str | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((place[0], place[1], place[2], number, data, sha256), kinds, strict=True)], names=names)

        kinds, names = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), ["file", "size", "start", "number", "data", "sha256"]
        place, digest, held, number = None, None, bytearray(), 0
        for batch in batches:
            lines = batch.column(4).cast(pa.large_binary())
            data, ends = lines.buffers()[2], np.frombuffer(lines.buffers()[1], np.int64, len(lines) + 1, lines.offset * 8)
            file = batch.column(0).dictionary_encode()
            cut = np.flatnonzero((np.diff(file.indices.to_numpy(), prepend=-1) != 0) | (np.diff(batch.column(2).to_numpy(), prepend=-1) != 0)).tolist()
            for a, b in zip(cut, [*cut[1:], len(lines)], strict=True):
                now = tuple(batch.column(i)[a].as_py() for i in range(4))
                if now != place:
                    if digest:
                        yield row(place, 0, None, digest.hexdigest(place[0]))
                    elif held:
                        yield row(place, number, bytes(held), None)
                    place, digest, held, number = now, Digest(now[1]) if now[1] == now[3] else None, bytearray(), 0
                some = memoryview(data)[ends[a] : ends[b]]
                if digest:
                    digest.update(some)
                    continue
                held += some
                for i in range(0, len(held) - PIECE + 1, PIECE):
                    yield row(place, number, bytes(held[i : i + PIECE]), None)
                    number += 1
                del held[: len(held) // PIECE * PIECE]
        if digest:
            yield row(place, 0, None, digest.hexdigest(place[0]))
        elif held:
            yield row(place, number, bytes(held), None)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(batch.column(j)[i].as_py() for j in range(3)) for batch in batches for i in range(batch.num_rows))
        for file, members in groupby(rows, key=itemgetter(0)):
            digest = None
            for _, size, data in members:
                digest = digest or Digest(size)
                digest.update(data)
            yield pa.RecordBatch.from_pydict({"file": [file], "sha256": [digest.hexdigest(file)]})

    unpacked = F.col("_metadata.file_path").rlike(r"\.(" + PACKED_FILES[3:-1].replace(",", "|") + ")$")
    line = F.concat(F.col("value").cast("binary"), F.lit(b"\n"))
    lines = spark.read.option("lineSep", "\n").text(list(dict.fromkeys(paths))).where(~unpacked)
    split = lines.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_block_start", "_metadata.file_block_length", line)
    read = stash(split.mapInArrow(pieces, "file string, size long, start long, number long, data binary, sha256 string"), "file-pieces")
    larger = read.where("data IS NOT NULL").repartition("file").sortWithinPartitions("file", "start", "number").select("file", "size", "data").mapInArrow(whole, "file string, sha256 string")
    packed = spark.read.format("binaryFile").option("pathGlobFilter", PACKED_FILES).load(list(dict.fromkeys(paths))).select(F.col("_metadata.file_path").alias("file"), F.sha2("content", 256).alias("sha256"))
    return read.where("data IS NULL").select("file", "sha256").unionByName(larger).unionByName(packed)


def provenance(spark: SparkSession, step: str, paths: Sequence[str], rows: DataFrame) -> DataFrame:
    """step, source, sha256, bytes, rows: one log row for each source file of a step, of any size."""
    files = spark.read.format("binaryFile").load(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("path").alias("source"), F.col("length").alias("bytes"))
    # A file without any line is a mark alone; Spark lists no empty files.
    found = files.join(digests(spark, paths), "file", "left").withColumn("sha256", F.coalesce("sha256", F.when(F.col("bytes") == len(BOM), F.sha2(F.lit(BOM), 256))))
    count = rows.agg(F.count("*").alias("rows"))
    return found.select("source", "sha256", "bytes").join(F.broadcast(count)).withColumn("step", F.lit(step))
