"""Text folding, tokenising, shingles and small text reports as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Marks to drop, letters to fold, transliteration, and letters that mark own prose.
MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{08D3}-\x{08FF}\x{0640}]"
FOLD_FROM, FOLD_TO = "آأإٱىةؤئکیھ", "اااايهويكيه"
HAMZA, ALEF = "ء", "ا"
NOT_LETTERS = r"[^\x{0621}-\x{064A}\x{066E}-\x{06D5}\s]"
LATIN_FROM = "'|>&<}AbptvjHxd*rzs$SDTZEg_fqklmnhwYy{"
LATIN_TO = "ءآأؤإئابةتثجحخدذرزسشصضطظعغـفقكلمنهوىيٱ"
SEPARATORS = r"[\s\-\x{2010}-\x{2015}_.,/]+"
PROSE_LETTERS = r"[ٹڈڑژچگکپھےہںۓۃی]"
QUOTE_MARKS = r"[\x{0671}\x{0670}\x{06D6}\x{06D7}\x{06D8}\x{06D9}\x{06DA}\x{06DB}\x{06DC}\x{06DE}\x{06E0}\x{06E1}\x{06E2}\x{06E4}\x{06EC}]"
SCRIPT_WORD = r"[\x{0621}-\x{06FF}\x{08A0}-\x{08FF}]+"

WORD_BREAK = r"[^\p{L}\p{N}]+"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC, for which Spark has no function; apply once at load where sources are not composed."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often ``body`` names it (also inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def strip_marks(text: Column) -> Column:
    """Without combining marks and the elongation sign. Null stays null, as in every function here unless it says otherwise."""
    return F.regexp_replace(text, MARKS, "")


def fold_letters(text: Column, hamza: bool = False) -> Column:
    """Variant letters on one carrier; with ``hamza`` the bare hamza too."""
    return F.translate(text, FOLD_FROM + HAMZA * hamza, FOLD_TO + ALEF * hamza)


def search_form(text: Column) -> Column:
    """The key under which marked and plain spellings of the (composed) text are equal."""
    letters = F.regexp_replace(fold_letters(strip_marks(text)), NOT_LETTERS, " ")
    return F.trim(F.regexp_replace(letters, r"\s+", " "))


def align_form(text: Column) -> Column:
    """``search_form`` with hamza as alef and runs of alef as one, under which two spellings of a word align."""
    return F.regexp_replace(fold_letters(search_form(text), True), ALEF + "{2,}", ALEF)


def loose_form(text: Column) -> Column:
    """Without any alef: merges too much, so only for a labelled fallback."""
    return F.replace(align_form(text), F.lit(ALEF), F.lit(""))


def term_key(value: Column) -> Column:
    """One key for dashed, spaced, plain and transliterated spellings; null and blank give ''."""
    value = F.trim(F.coalesce(value, F.lit("")))
    latin = F.regexp_replace(F.translate(value, LATIN_FROM, LATIN_TO), r"[^\x{0600}-\x{06FF}]", "")
    script = F.when(value.rlike(r"[\x{0600}-\x{06FF}]"), value).otherwise(latin)
    return fold_letters(strip_marks(F.regexp_replace(script, SEPARATORS, "")), True)


def term_letters(value: Column) -> Column:
    """The letters of a term's key, in order; none for null and blank."""
    return F.filter(F.split(term_key(value), ""), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Words of the search form; none for null."""
    return F.filter(F.split(F.coalesce(search_form(text), F.lit("")), " "), lambda x: x != "")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda x: x != "")


def folded_words(text: Column) -> Column:
    """``words`` after folding; single characters are kept only in the folded script."""
    folded = F.transform(F.split(F.coalesce(strip_marks(text), F.lit("")), r"[^\p{L}\p{N}_]+"), lambda x: fold_letters(F.lower(x)))
    return F.filter(folded, lambda x: (F.length(x) > 1) | x.rlike(r"^[\x{0600}-\x{06FF}]"))


def shingles(items: Column, n: int) -> Column:
    """Distinct runs of n items; a shorter array gives itself as one, an empty one nothing."""

    def of(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, F.array_distinct(runs)).when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))

    return bound(items, of)


def run_hashes(tokens: Column, lengths: Sequence[int]) -> Column:
    """The distinct 64-bit hashes of all runs of so many words, of each of ``lengths``, within the row."""

    def of(h: Column) -> Column:
        def runs(n: int) -> Column:
            starts = F.when(F.size(h) >= n, F.sequence(F.lit(0), F.size(h) - n)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: run_hash(*[F.get(h, i + j) for j in range(n)]))

        return F.flatten(F.array(*map(runs, lengths)))

    return F.array_distinct(bound(F.transform(tokens, lambda t: F.xxhash64(t)), of))


def run_hash(*word_hashes: Column) -> Column:
    return F.xxhash64(F.lit(len(word_hashes)), *word_hashes)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), union))


def letter_count(text: Column) -> Column:
    """Letters without combining marks; null for null."""
    return F.regexp_count(strip_marks(text), F.lit(r"\p{L}"))


def occurrences_of(text: Column, needle: Column) -> Column:
    """Non-overlapping places of ``needle``; 0 for an empty one."""
    left = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (left / F.length(needle)).cast("int")).otherwise(F.lit(0))


def positions_of(items: Column, run: Column) -> Column:
    """1-based positions of every item inside a place where ``run`` stands in ``items``."""

    def of(t: Column) -> Column:
        last = F.size(t) - F.size(run) + 1
        starts = F.when((F.size(run) > 0) & (last > 0), F.filter(F.sequence(F.lit(1), last), lambda i: F.slice(t, i, F.size(run)) == run)).otherwise(F.array().cast("array<int>"))
        return F.array_sort(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + F.size(run) - 1)))))

    return bound(items, of)


def quoted_runs(text: Column, least: int = 3) -> Column:
    """Runs of script words that quote rather than write.

    In each line: a word with marks of quoted text is a run alone; a word with letters of own prose
    ends a run; single letters are passed over; ``least`` or more plain words in a row are a run.
    """

    def of_line(line: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit("(" + SCRIPT_WORD + ")"), 1)
        start = F.struct(F.array().cast("array<string>").alias("now"), F.array().cast("array<string>").alias("runs"))

        def closed(state: Column) -> Column:
            return F.when(F.size(state["now"]) >= least, F.concat(state["runs"], F.array(F.array_join(state["now"], " ")))).otherwise(state["runs"])

        def step(state: Column, word: Column) -> Column:
            empty = F.array().cast("array<string>")
            marked = F.struct(empty.alias("now"), F.concat(state["runs"], F.array(word)).alias("runs"))
            prose = F.struct(empty.alias("now"), closed(state).alias("runs"))
            longer = F.struct(F.concat(state["now"], F.array(word)).alias("now"), state["runs"].alias("runs"))
            return F.when(word.rlike(QUOTE_MARKS), marked).when(word.rlike(PROSE_LETTERS), prose).when(F.length(word) < 2, state).otherwise(longer)

        return F.aggregate(found, start, step, closed)

    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), of_line))


def slug(text: Column, most: int = 120) -> Column:
    """The whole text as lower-case words with dashes, cut to ``most`` characters; a text without words gives ''."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "-"), "^-+|-+$", ""), 1, most)


# Formats of references and placeholders (fixed values).
UNIT_ANCHOR, TERM_ANCHOR = r"\[\[(\d+:\d+)\]\]", r"\[\[root:([^\]]+)\]\]"
PLACEHOLDER = r"\{\{([a-z_]+):([^}|]+)(?:\|([^}]+))?\}\}"


def anchors(text: Column, pattern: str) -> Column:
    """References in double brackets (see the two patterns above); none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), 1), F.array().cast("array<string>"))


def placeholders(text: Column) -> Column:
    """array<struct<kind, ref, arg>> of the placeholders in a text, in order; arg is '' where absent."""
    parts = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PLACEHOLDER), i) for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("kind", "ref", "arg"), strict=True)]), lambda x: F.struct(x["kind"].alias("kind"), F.trim(x["ref"]).alias("ref"), F.trim(x["arg"]).alias("arg")))


def payload_summary(text: Column, most: int = 120) -> Column:
    """The first characters, with an ellipsis where more follow."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def redacted(text: Column) -> Column:
    """Only the length; null for null."""
    return F.concat(F.lit("["), F.length(text).cast("string"), F.lit(" chars]"))
