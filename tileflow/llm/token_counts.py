"""Greedy word-piece counts by a linear longest-match automaton, without building the pieces.

The vocabulary is a trie with failure links: leaving a node on a mismatch pops the longest pieces of what was read
so far, and how many those are is stored with the node. Each symbol is read once, so a word takes time linear in
its length. A word's last symbol carries the word end, as in the vocabulary; every single symbol is a piece, so a
word can always be cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tileflow.llm.bpe import WORD_END, Remembered, Splitter, Vocabulary, byte_symbols
from tileflow.llm.words import parts


class LongestMatch:
    """Trie over symbol sequences; ``fail`` is where matching goes on, ``popped`` how many pieces that takes off."""

    def __init__(self, vocabulary: Iterable[Sequence[str]]):
        self.next: list[dict[str, int]] = [{}]
        piece = [False]
        for symbols in vocabulary:
            v = 0
            for s in symbols:
                if s not in self.next[v]:
                    self.next[v][s] = len(self.next)
                    self.next.append({})
                    piece.append(False)
                v = self.next[v][s]
            piece[v] = v > 0
        self.fail = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        level = [0]
        while level:
            below = []
            for u in level:
                for s, v in self.next[u].items():
                    below.append(v)
                    if piece[v]:
                        self.fail[v], self.popped[v] = 0, 1
                        continue
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and s not in self.next[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][s], n
            level = below

    def count(self, symbols: Iterable[str]) -> int:
        """Number of greedy pieces; a symbol that no piece begins with counts as one."""
        u = n = 0
        for s in symbols:
            while s not in self.next[u]:
                if self.fail[u] < 0:
                    break
                n += self.popped[u]
                u = self.fail[u]
            if s in self.next[u]:
                u = self.next[u][s]
            else:
                n += 1
        while u:
            n += self.popped[u]
            u = self.fail[u]
        return n


def symbols_of(token: str) -> list[str]:
    """A vocabulary entry as symbols: characters, the last with the word end if it has one."""
    if token.endswith(WORD_END) and len(token) > len(WORD_END):
        body = list(token[: -len(WORD_END)])
        return [*body[:-1], body[-1] + WORD_END]
    return list(token)


def word_symbols(word: str, table: dict[int, str]) -> list[str]:
    """A word as byte symbols, the last with the word end."""
    symbols = [table[b] for b in word.encode("utf-8")]
    symbols[-1] += WORD_END
    return symbols


def automaton(vocabulary: Vocabulary) -> LongestMatch:
    """The automaton of a vocabulary with every single byte symbol in both its forms."""
    entries = [symbols_of(t) for t in vocabulary.ids if t not in vocabulary.specials]
    singles = {e[0] for e in entries if len(e) == 1}
    if missing := {s for e in entries for s in e} - singles:
        raise ValueError(f"{len(missing)} symbols are no entries of their own")
    return LongestMatch(entries)


def _count(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        splitter, match, table = Splitter(vocab), automaton(vocab), byte_symbols()
        counts = Remembered(lambda word: match.count(word_symbols(word, table)))

        def measure(piece: str) -> tuple[int, int]:
            words = splitter.words(piece)
            return len(words), sum([counts[w] for w in words])

        known = Remembered(measure)
        for batch in parts(batches, "text"):
            n_words, n_pieces = [], []
            for text in batch.column(1).to_pylist():
                words = pieces = 0
                for special, part in splitter.segments(text or ""):
                    if special:
                        words, pieces = words + 1, pieces + 1
                        continue
                    for a, b in map(known.__getitem__, splitter.pieces(part)):
                        words += a
                        pieces += b
                n_words.append(words)
                n_pieces.append(pieces)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_pieces, pa.int64())],
                names=["row", "n_words", "n_pieces"],
            )

    return run


def piece_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words and n_pieces (long) of every text: words of the tokenizer file, cut greedily into its longest entries.

    Special tokens that stand in a text count as one word and one piece. Defined cases: a null text counts 0 and 0;
    null or repeated ids are carried along; other columns are not read; an empty table gives an empty result.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias("row"), F.col(text_col).alias("text"))
    out = StructType([rows.schema["row"]]).add("n_words", "long").add("n_pieces", "long")
    made = rows.mapInArrow(_count(vocabulary), out)
    return made.select(F.col("row.id").alias(id_col), "n_words", "n_pieces")
