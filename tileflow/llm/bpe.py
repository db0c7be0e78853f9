"""Byte-pair encoding and decoding with a tokenizer file's vocabulary and merges.

Texts are cut at special tokens and white space; each piece is put into NFC and lower case, cut by the pattern into
words of byte symbols, the last of which carries the word end. The merges of one word work on a contiguous array of
its parts with the rank of each neighbouring pair: find the least rank, delete the boundary, refresh the ranks
beside it, until no pair is left. Pieces and words that come again are taken from bounded tables of the task.

Characters count as letters or numbers as the installed ``regex`` package knows them.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tileflow.llm.words import parts, ranges

WORD_END = "</w>"
# The pattern of the tokenizer file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ODD_SPACES = "\x1c\x1d\x1e\x1f"  # white space for str.split only
_SHORT = 64  # parts; longer words keep their pairs in a heap
_REMEMBERED = 800_000


def byte_symbols() -> dict[int, str]:
    """A printable character for each byte: printable Latin-1 ones stand for themselves, the rest follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """What a tokenizer file says: ids of tokens, ranks of pairs, special tokens. Its size is that of the file."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    specials: dict[str, int]

    @staticmethod
    def read(path: str) -> Vocabulary:
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        model = file["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or file["decoder"]:
            raise ValueError("a BPE file with word ends and without a decoder is needed")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        specials = {t["content"]: t["id"] for t in file["added_tokens"] if t["special"]}
        return Vocabulary(model["vocab"], {m: i for i, m in enumerate(merges)}, specials)


class Merges:
    """Pairs of token ids by rank. A word is a list of the ids of its parts, from single byte symbols on."""

    def __init__(self, vocabulary: Vocabulary):
        ids, symbols = vocabulary.ids, byte_symbols()
        self.size = len(ids)
        self.inner = [ids[symbols[b]] for b in range(256)]
        self.last = [ids[symbols[b] + WORD_END] for b in range(256)]
        self.ranks = {ids[a] * self.size + ids[b]: r for (a, b), r in vocabulary.ranks.items()}
        self.made = [ids[a + b] for a, b in vocabulary.ranks]

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs in order, their ranks, and the id that each rank makes."""
        keys = np.fromiter(self.ranks.keys(), np.int64, len(self.ranks))
        order = np.argsort(keys)
        return keys[order], np.fromiter(self.ranks.values(), np.int64, len(keys))[order], np.array(self.made)

    def word(self, word: str) -> list[int]:
        """Ids of a word's tokens."""
        data = word.encode("utf-8")
        parts = [self.inner[b] for b in data[:-1]]
        parts.append(self.last[data[-1]])
        return self.short(parts) if len(parts) <= _SHORT else self.long(parts)

    def short(self, parts: list[int]) -> list[int]:
        """Array scan: the ranks of neighbouring parts stand beside the parts; quadratic in the word's length.

        Deleting an entry of both arrays deletes the boundary between two parts.
        """
        size, get, none = self.size, self.ranks.get, len(self.made)
        rank = [get(a * size + b, none) for a, b in zip(parts, parts[1:])]
        while rank:
            least = min(rank)
            if least == none:
                break
            i = rank.index(least)
            parts[i] = part = self.made[least]
            del parts[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(part * size + parts[i + 1], none)
            if i:
                rank[i - 1] = get(parts[i - 1] * size + part, none)
        return parts

    def many(self, words: list[str]) -> list[list[int]]:
        """``word`` for many words: those of one length are scanned together, a row of the arrays for each."""
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        coded = [w.encode("utf-8") for w in words]
        for i, data in enumerate(coded):
            by_length.setdefault(len(data), []).append(i)
        for length, at in by_length.items():
            if length > _SHORT:
                found = [self.word(words[i]) for i in at]
            else:
                data = np.frombuffer(b"".join([coded[i] for i in at]), np.uint8).reshape(len(at), length)
                parts = np.array(self.inner)[data]
                parts[:, -1] = np.array(self.last)[data[:, -1]]
                rows, left = self._scan(parts)
                found = [row[:n] for row, n in zip(rows.tolist(), left.tolist())]
            for i, ids in zip(at, found):
                out[i] = ids
        return out

    def _scan(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least rank first in every row; a row's parts move up when a boundary goes. Also how many parts are left."""
        n, width = parts.shape
        left, none = np.full(n, width), len(self.made)
        if width < 2:
            return parts, left
        keys, values, made = self.table

        def rank_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            pair = a * self.size + b
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            return np.where((keys[at] == pair) & (b >= 0), values[at], none)

        rank = rank_of(parts[:, :-1], parts[:, 1:])
        open_ = np.arange(n)
        columns = np.arange(width)[None, :]
        while True:
            place = rank[open_].argmin(1)
            live = rank[open_, place] < none
            open_, i = open_[live], place[live]
            if not len(open_):
                return parts, left
            p, r = parts[open_], rank[open_]
            every = np.arange(len(open_))
            p[every, i] = made[r[every, i]]
            p = np.take_along_axis(p, np.minimum(columns + (columns > i[:, None]), width - 1), 1)
            r = np.take_along_axis(r, np.minimum(columns[:, :-1] + (columns[:, :-1] >= i[:, None]), width - 2), 1)
            p[:, -1], r[:, -1] = -1, none
            before = np.flatnonzero(i > 0)
            r[before, i[before] - 1] = rank_of(p[before, i[before] - 1], p[before, i[before]])
            after = np.flatnonzero(i < width - 1)
            r[after, i[after]] = rank_of(p[after, i[after]], p[after, i[after] + 1])
            parts[open_], rank[open_] = p, r
            left[open_] -= 1

    def long(self, parts: list[int]) -> list[int]:
        """The same for a word of any length: pairs wait in a heap by rank and place."""
        ranks, size, n = self.ranks, self.size, len(parts)
        part: list[int] = list(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        keys = (a * size + b for a, b in zip(parts, parts[1:]))
        heap = [(ranks[k], i, k) for i, k in enumerate(keys) if k in ranks]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if j < n and (k := part[i] * size + part[j]) in ranks:
                heapq.heappush(heap, (ranks[k], i, k))

        while heap:
            rank, i, key = heapq.heappop(heap)
            j = after[i]
            if part[i] < 0 or j >= n or part[i] * size + part[j] != key:
                continue
            part[i], part[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [p for p in part if p >= 0]


class Remembered(dict):
    """A table of what ``make`` says of a string; it forgets all when it is full, and long strings at once."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make = make

    def __missing__(self, text: str):
        if len(self) >= _REMEMBERED:
            self.clear()
        out = self.make(text)
        if len(text) <= 100:
            self[text] = out
        return out


def lower(text: str) -> str:
    """Lower case character by character: a sigma at a word's end is like any other."""
    return text.replace("Σ", "σ").lower()


@dataclass
class Splitter:
    """Texts to pieces, pieces to words of byte symbols, as the tokenizer file's first steps do."""

    vocabulary: Vocabulary
    pattern: regex.Pattern = field(init=False)
    special: regex.Pattern = field(init=False)

    def __post_init__(self) -> None:
        self.pattern = regex.compile(PATTERN)
        names = sorted(self.vocabulary.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")")

    def pieces(self, text: str) -> list[str]:
        if any(c in text for c in _ODD_SPACES):
            return [p for p in regex.split(r"\s+", text) if p]
        return text.split()

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is a special token, string) from left to right."""
        if not any(name in text for name in self.vocabulary.specials):
            yield False, text
            return
        for i, s in enumerate(self.special.split(text)):
            if s:
                yield i % 2 == 1, s

    def words(self, piece: str) -> list[str]:
        """The words of a piece without white space."""
        if piece.isascii():
            piece = piece.lower()
            return [piece] if piece.isalpha() else self.pattern.findall(piece)
        return self.pattern.findall(lower(unicodedata.normalize("NFC", piece)))


class Encoder:
    """Texts to a sequence of values, one for each piece and special token; ``make`` turns ids into a value."""

    def __init__(self, vocabulary: Vocabulary, make: Callable[[list[int]], object]):
        self.splitter = splitter = Splitter(vocabulary)
        self.specials = {t: make([i]) for t, i in vocabulary.specials.items()}
        words = Remembered(Merges(vocabulary).word)
        self.known = Remembered(lambda piece: make([i for w in splitter.words(piece) for i in words[w]]))

    def values(self, text: str | None) -> list:
        out: list = []
        for special, part in self.splitter.segments(text or ""):
            out += [self.specials[part]] if special else map(self.known.__getitem__, self.splitter.pieces(part))
        return out


_WIDE_SPACES = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"  # fixed values: white space beyond ASCII


class IdRuns:
    """Token ids of all texts of an array in one buffer: text i has ids[ends[i]:ends[i + 1]].

    Pieces are found and told apart by Arrow, and each distinct one of an array is encoded once; texts that hold special
    tokens or white space beyond ASCII go through the ``Encoder`` one by one, with the same result.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.encoder = Encoder(vocabulary, tuple)
        self.odd = "|".join([_WIDE_SPACES, *map(regex.escape, vocabulary.specials)])
        self.splitter, self.merges = Splitter(vocabulary), Merges(vocabulary)
        self.words: dict[str, list[int]] = {}
        self.pieces: dict[str, list[int]] = {}

    def _values(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece; new words are encoded together. Forgets all when it has met very many."""
        if len(self.pieces) + len(pieces) > _REMEMBERED:
            self.pieces, self.words = {}, {}
        known, words = self.pieces, self.words
        new = [p for p in pieces if p not in known]
        split = [self.splitter.words(p) for p in new]
        fresh = list({w for ws in split for w in ws if w not in words})
        words.update(zip(fresh, self.merges.many(fresh)))
        for piece, ws in zip(new, split):
            known[piece] = words[ws[0]] if len(ws) == 1 else [i for w in ws for i in words[w]]
        return [known[p] for p in pieces]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(column, "").cast(pa.large_string())
        odd = pc.match_substring_regex(texts, self.odd)
        lists = pc.ascii_split_whitespace(pc.if_else(odd, "", texts))
        coded = lists.flatten().dictionary_encode()
        values = self._values(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        table = np.fromiter(chain.from_iterable(values), np.uint32, int(sizes.sum()))
        at = coded.indices.to_numpy()
        counts = sizes[at]
        ids = table[ranges((np.cumsum(sizes) - sizes)[at], counts)]
        places = np.concatenate([[0], np.cumsum(counts)])
        cuts = lists.offsets.to_numpy()
        ends = places[cuts - cuts[0]]
        alone = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(alone):
            return ids, ends
        runs = np.split(ids, ends[1:-1]) if len(texts) > 1 else [ids]
        for i in alone:
            runs[i] = np.array([t for v in self.encoder.values(texts[i].as_py()) for t in v], np.uint32)
        return np.concatenate(runs), np.concatenate([[0], np.cumsum([len(r) for r in runs])])


def encode(text: str | None, vocabulary: Vocabulary) -> list[int]:
    """Token ids of one text."""
    return [i for v in Encoder(vocabulary, tuple).values(text) for i in v]


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """Tokens with a space between them; special ones are kept, unknown ids are skipped."""
    names = {i: t for t, i in (vocabulary.ids | vocabulary.specials).items()}
    return " ".join(names[i] for i in ids if i in names)


def _round_trip(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        names = {i: t for t, i in (vocab.ids | vocab.specials).items()}

        def make(ids: list[int]) -> tuple[str, str]:
            return " ".join(map(str, ids)), " ".join([names[i] for i in ids])

        encoder = Encoder(vocab, make)
        for batch in parts(batches, "text"):
            n, encoded, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                values = list(encoder.values(text)) if text else []
                lines, tokens = zip(*values) if values else ((), ())
                line = " ".join(lines)
                n.append(line.count(" ") + 1 if line else 0)
                encoded.append(line)
                decoded.append(" ".join(tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                names=["row", "n_tokens", "ids", "decoded"],
            )

    return run


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens (long), ids (string of decimal ids, one space apart), decoded (string) of every text.

    Encoded without added tokens; special tokens that stand in a text are found. Decoding joins the tokens of the
    ids as the file's missing decoder does: with one space, word ends and special tokens included.
    ``path`` is read by the driver only; the vocabulary, as large as that file, is sent to the tasks.
    Defined cases: a null text is the empty text with no ids; null or repeated ids are carried along; other columns
    are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.read(path))
    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias("row"), F.col(text_col).alias("text"))
    out = StructType([rows.schema["row"]]).add("n_tokens", "long").add("ids", "string").add("decoded", "string")
    made = rows.mapInArrow(_round_trip(vocabulary), out)
    return made.select(F.col("row.id").alias(id_col), "n_tokens", "ids", "decoded")

