"""Token counts by a finite-state transducer that is compiled from a BPE vocabulary as texts need it."""

from __future__ import annotations

import functools
import json
import re
from collections import deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from verbatlas.llm.batches import map_texts, spans_of_words, text_groups

#: Endings that the tokenizer's pattern takes as pieces of their own (fixed values).
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Characters of a word that make one chunk; words and pairs of tokens that are remembered (twice as many at most); transitions.
CHUNK, MOST_KNOWN, MOST_MOVES = 1 << 16, 300_000, 1_000_000
#: Kinds of characters: white space, letters, digits, others.
SPACE, LETTER, DIGIT, OTHER = range(4)
#: A byte that ends its piece is a symbol of its own.
FINAL = 256
START = 0


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def character_kinds(splitter: object) -> bytes:
    """The kind of every code point, as the tokenizer's own pre-tokenizer treats it (its Unicode tables, not Python's)."""
    kinds = bytearray([OTHER]) * 0x110000
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4096):
        own = points[i : i + 4096]
        # Each stands twice between two letters: one piece, then, if it is a letter; four if a digit; two if white space.
        pieces = splitter.pre_tokenize_str(" ".join(f"a{chr(c)}{chr(c)}a" for c in own))
        count = np.bincount([start // 5 for _, (start, _) in pieces], minlength=len(own))
        for c, n in zip(own, count.tolist(), strict=True):
            kinds[c] = {1: LETTER, 2: SPACE, 4: DIGIT}.get(n, OTHER)
    return bytes(kinds)


class ChunkMap(NamedTuple):
    """What a chunk of symbols does to the transducer, whatever state it is entered in.

    ``head``: the symbols up to the first that leads to START from every state (all of them if there is none: not ``closed``), which only the
    entry state can tell; then ``count`` tokens and the state ``exit``, which do not depend on it.
    """

    head: tuple[np.ndarray, ...]
    closed: bool
    count: int
    exit: int


class Memo(dict):
    """A dictionary that forgets what was not asked for lately, so that it stays small and keeps what is frequent."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict = {}

    def __missing__(self, key: object) -> object:
        found = self.old.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key: object, value: object) -> None:
        if len(self) >= MOST_KNOWN:
            self.old = dict(self)
            self.clear()
        self[key] = value


class CountingTransducer:
    """A deterministic transducer over bytes; each transition carries the change in the number of tokens.

    Greedy merging has a finite memory: the tokens of a piece read so far end in a token t such that the piece without t
    ends in a token that stays apart from t. So a state knows the longest part of the input that may still grow into a vocabulary entry (a node of
    an Aho-Corasick automaton over all entries) and, for each place in it where an entry may have begun, the last token before that place
    and how many tokens fewer there were. A transition finds the one entry that ends at the new byte and keeps to
    its left neighbour; a byte that ends its piece emits the last change and leads back to START. Transitions
    are compiled when first needed; states that the same future awaits are one.
    """

    def __init__(self, spec: str, kinds: bytes):
        found = json.loads(spec)
        model = found["model"]
        names = [x["type"] for x in found["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or names != ["NFC", "Replace", "Lowercase"] or model["end_of_word_suffix"] is None:
            raise ValueError("not a lower-casing word-level BPE vocabulary")
        self.kinds = kinds
        self.normal = Tokenizer.from_str(spec).normalizer.normalize_str
        added = sorted((x["content"] for x in found["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.marks = [x.encode() for x in added]
        suffix, byte_of = model["end_of_word_suffix"], {c: b for b, c in enumerate(byte_symbols())}

        def entry(text: str) -> tuple[int, ...]:
            last = text.endswith(suffix)
            symbols = [byte_of[c] for c in text.removesuffix(suffix)]
            return (*symbols[:-1], symbols[-1] + FINAL) if last else tuple(symbols)

        #: Rank of each merge of two entries.
        self.rank = {(entry(a), entry(b)): i for i, (a, b) in enumerate(model["merges"])}
        entries = {(x,) for x in range(2 * FINAL)} | {a + b for a, b in self.rank}
        self.go: list[dict[int, int]] = [{}]
        self.entries = [(), *sorted(entries)]
        self.ends: list[list[int]] = [[]]
        depth = [0]
        for number, e in enumerate(self.entries[1:], 1):
            at = 0
            for x in e:
                if x not in self.go[at]:
                    self.go[at][x] = len(self.go)
                    self.go.append({})
                    self.ends.append([])
                    depth.append(depth[at] + 1)
                at = self.go[at][x]
            self.ends[at].append(number)
        self.fail, self.chain = [0] * len(self.go), [()] * len(self.go)
        todo = deque([0])
        while todo:
            at = todo.popleft()
            self.chain[at] = (depth[at], *(self.chain[self.fail[at]] if at else ()))
            for x, child in self.go[at].items():
                self.fail[child] = self.step(self.fail[at], x) if at else 0
                self.ends[child] += self.ends[self.fail[child]]
                todo.append(child)
        self.apart: Memo = Memo()
        self.words: Memo = Memo()
        self.reset()

    def reset(self) -> None:
        """Forget all states but START. A state is its node and, for each place, one number of length, last token and tokens fewer."""
        start = (0, self.place(0, 0, 0))
        self.states, self.number, self.moves = [start], {start: START}, {}

    @staticmethod
    def place(length: int, last: int, fewer: int) -> int:
        return length << 32 | last << 12 | fewer + 2048

    def step(self, node: int, x: int) -> int:
        while x not in self.go[node] and node:
            node = self.fail[node]
        return self.go[node].get(x, 0)

    def merged(self, symbols: tuple[int, ...]) -> list[tuple[int, ...]]:
        """Greedy merging of a few symbols by rank, as the vocabulary defines it; used to compile, not to count."""
        parts = [(x,) for x in symbols]
        while len(parts) > 1:
            best, at = min((self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def keep_apart(self, a: int, b: int) -> bool:
        known = self.apart[a << 20 | b]
        if known is None:
            left, right = self.entries[a], self.entries[b]
            known = self.merged(left + right) == [left, right]
            self.apart.put(a << 20 | b, known)
        return known

    def compile(self, state: int, x: int) -> tuple[int, int]:
        """Next state and change in the number of tokens."""
        node, *places = self.states[state]
        before = {p >> 32: (p >> 12 & 0xFFFFF, (p & 0xFFF) - 2048) for p in places}
        node = self.step(node, x)
        for token in self.ends[node]:
            last, fewer = before[len(self.entries[token]) - 1]
            if not last or self.keep_apart(last, token):
                break
        change = fewer + 1
        new = START
        if x < FINAL:
            key = (node, *(self.place(n, before[n - 1][0], before[n - 1][1] - change) if n else self.place(0, token, 0) for n in self.chain[node]))
            new = self.number.setdefault(key, len(self.states))
            if new == len(self.states):
                self.states.append(key)
        self.moves[state << 9 | x] = new << 8 | change + 64
        return new, change

    def run(self, state: int, symbols: Iterable[int]) -> tuple[int, int]:
        """The state after ``symbols`` and the tokens that they add."""
        count, moves = 0, self.moves
        for x in symbols:
            move = moves.get(state << 9 | x)
            if move is None:
                state, change = self.compile(state, x)
                count += change
            else:
                state = move >> 8
                count += (move & 255) - 64
        return state, count

    def symbols(self, text: str) -> Iterator[np.ndarray]:
        """Symbols of normalised text, for CHUNK characters at a time: the automaton of the tokenizer's pattern cuts it into pieces."""
        kinds, skip, current = self.kinds, 0, -1
        for start in range(0, len(text), CHUNK):
            out: list[int] = []
            for i in range(start, min(start + CHUNK, len(text))):
                if skip:
                    skip -= 1
                    continue
                c = text[i]
                kind = kinds[ord(c)]
                if c == "'" and current != kind and (ending := next((e for e in ENDINGS if text.startswith(e, i)), "")):
                    out += [*ending.encode()[:-1], FINAL + ord(ending[-1])]
                    skip, current = len(ending) - 1, -1
                    continue
                current = kind
                if kind == SPACE:
                    continue
                own = c.encode()
                if kind == DIGIT or i + 1 == len(text) or kinds[ord(text[i + 1])] != kind:
                    out += [*own[:-1], FINAL + own[-1]]
                    current = -1
                else:
                    out += own
            yield np.array(out, np.uint16)

    def chunk(self, symbols: np.ndarray) -> ChunkMap:
        final = np.flatnonzero(symbols >= FINAL)
        if not len(final):
            return ChunkMap((symbols,), False, 0, START)
        cut = int(final[0]) + 1
        state, count = self.run(START, symbols[cut:].tolist())
        return ChunkMap((symbols[:cut],), True, count, state)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of chunk ``a`` followed by chunk ``b``; associative."""
        if not a.closed:
            return b._replace(head=a.head + b.head)
        state, count = a.exit, a.count
        for part in b.head:
            state, more = self.run(state, part.tolist())
            count += more
        return ChunkMap(a.head, True, count + b.count, b.exit if b.closed else state)

    def total(self, maps: Iterable[ChunkMap]) -> int:
        """Tokens of all chunks: pairs of neighbours are composed level by level, as in a parallel prefix scan; at most one map a level waits."""
        levels: list[ChunkMap | None] = []
        for m in maps:
            at = 0
            while at < len(levels) and levels[at] is not None:
                m, levels[at] = self.compose(levels[at], m), None
                at += 1
            if at == len(levels):
                levels.append(None)
            levels[at] = m
        whole = functools.reduce(lambda right, left: self.compose(left, right), [m for m in levels if m is not None])
        state, count = START, whole.count
        for part in whole.head:
            state, more = self.run(state, part.tolist())
            count += more
        return count

    def word(self, raw: bytes) -> int:
        """Tokens of a word: bytes without ASCII white space."""
        text, count = raw.decode(errors="replace"), 0
        parts = [text]
        if any(m in raw for m in self.marks):
            count = len(self.special.findall(text))
            parts = self.special.split(text)
        for part in parts:
            part = part.lower() if part.isascii() else self.normal(part)
            if len(part) <= CHUNK:
                for own in self.symbols(part):
                    count += self.run(START, own.tolist())[1]
            else:
                count += self.total(map(self.chunk, self.symbols(part)))
        if len(self.moves) > MOST_MOVES:
            self.reset()
        return count

    def counts(self, texts: list[bytes | None]) -> list[int]:
        """Tokens of each text; each distinct word of a group of texts is looked up once."""
        out: list[int] = []
        for group in text_groups(texts):
            raw, starts, stops, hashes, sizes = spans_of_words([t or b"" for t in group])
            # Hashes fold A-Z, special tokens do not.
            exact = any(m in t for t in group if t for m in self.marks)
            if exact:
                out += [sum(map(self.word, (t or b"").split())) for t in group]
                continue
            words, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            known = [self.words[h] for h in words.tolist()]
            for i, n in enumerate(known):
                if n is None:
                    at = first[i]
                    known[i] = self.word(raw[starts[at] : stops[at]].tobytes())
                    self.words.put(int(words[i]), known[i])
            upto = np.concatenate([[0], np.cumsum(np.array(known, np.int64)[back])])
            ends = np.cumsum(sizes)
            out += (upto[ends] - upto[ends - sizes]).tolist()
        return out

    def count(self, text: str) -> int:
        return self.counts([text.encode()])[0]


@functools.lru_cache(maxsize=2)
def compiled(spec: str, kinds: bytes) -> CountingTransducer:
    return CountingTransducer(spec, kinds)


@functools.lru_cache(maxsize=2)
def kinds_of(spec: str) -> bytes:
    return character_kinds(Tokenizer.from_str(spec).pre_tokenizer)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, as the library for the vocabulary at ``tokenizer_path`` counts them.

    The vocabulary (a file of fixed size, read on the driver) is broadcast with a table of character kinds, which the library's own
    pre-tokenizer gives once on the driver; each Python worker compiles the transducer's transitions as its texts need them. Words with other than ASCII
    characters are normalised by the library's normaliser. A word longer than CHUNK is cut into chunks, whose maps are composed. No shuffle. Begin and end
    tokens are not added; special strings inside a text are one token each.

    Returns id, n_bytes, n_tokens, over_limit. Null texts count as empty: 0 tokens. Bytes that are no UTF-8 count as U+FFFD. Rows stay as
    they are, repeated or without id; extra columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((spec, kinds_of(spec)))

    def work(texts: list[bytes | None]) -> list[list]:
        n = compiled(*shared.value).counts(texts)
        return [[len(t or b"") for t in texts], n, [x > limit for x in n]]

    return map_texts(docs, id_col, text_col, work, "n_bytes long, n_tokens long, over_limit boolean")
