"""Language identification by a linear-chain conditional random field over words.

A word is a run of letters' bytes (A-Z, a-z and all above 127), ASCII-lower-cased. Its features are affixes, byte
n-grams, the word itself and the lexicons that hold it; learned weights and transitions label the words of a text,
also of one that switches between languages, by forward-backward. A text's language has the largest mean posterior
over its words.

The model is fitted on a bounded sample of labelled texts; half of its training sequences are stitched from pieces
of different languages, so the transitions learn switches. All texts are labelled in tasks, many texts in step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from tileflow.llm.words import U64, Texts, Words, mix, parts, ranges

UNKNOWN = "und"
LETTER = r"\p{L}"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class LetterWords(Words):
    """Runs of letters' bytes instead of words between white space."""

    def __init__(self, texts: Texts):
        masked = Texts.__new__(Texts)
        masked.data, masked.ends = np.where(_LETTER[texts.data], texts.data, np.uint8(32)), texts.ends
        super().__init__(masked, lower=True)


@dataclass(frozen=True)
class Features:
    """Feature numbers of words; ``lexicon`` maps known words' hashes to a bit set of languages."""

    size: int
    lexicon_words: np.ndarray
    lexicon_bits: np.ndarray

    def of(self, words: Words, which: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of the chosen words, word after word, and where each word's features begin."""
        start, end = words.start[which], words.end[which]
        n = end - start
        kinds: list[tuple[np.ndarray, np.ndarray]] = []  # (owner, hash)
        every = np.arange(len(which))

        def add(kind: int, owner: np.ndarray, value: np.ndarray) -> None:
            kinds.append((owner, mix(value ^ mix(np.array([kind], U64)))))

        def gram(at: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros(len(at), U64)
            for j in range(k):
                out = out << U64(8) | words.data[at + j].astype(U64)
            return out

        for k in (1, 2, 3, 4):
            there = every[n >= k]
            add(k, there, gram(start[there], k))
            add(10 + k, there, gram(end[there] - k, k))
        for k in (2, 3):
            count = np.maximum(n - k + 1, 0)
            add(20 + k, np.repeat(every, count), gram(ranges(start, count), k))
        add(30, every, hashes)
        at = np.minimum(np.searchsorted(self.lexicon_words, hashes), max(len(self.lexicon_words) - 1, 0))
        bits = self.lexicon_bits[at] if len(self.lexicon_words) else np.zeros(len(which), U64)
        known = self.lexicon_words[at] == hashes if len(self.lexicon_words) else np.zeros(len(which), bool)
        add(31, every, np.where(known, bits, U64(0)))
        add(32, every, np.zeros(len(which), U64))
        owner = np.concatenate([o for o, _ in kinds])
        value = np.concatenate([v for _, v in kinds])
        order = np.argsort(owner, kind="stable")
        number = (value % U64(self.size)).astype(np.int64)[order]
        return number, np.searchsorted(owner[order], every)


class Lattice:
    """Texts side by side: place (t, text) holds word t; texts are ordered from long to short."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        sorted_lengths = lengths[self.order]
        longest = int(sorted_lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-sorted_lengths, -np.arange(longest), side="left")
        self.offset = np.concatenate(([0], np.cumsum(self.active)))
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        step = ranges(np.zeros(len(lengths), np.int64), lengths)
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        self.place = self.offset[step] + rank[self.text]  # of each word, text after text

    def posteriors(self, emission: np.ndarray, move: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior label probabilities by place, and expected label pairs summed over all steps.

        ``emission``: positive scores by place and label; ``move``: positive transition scores.
        """
        ahead = np.empty_like(emission)
        labels = emission.shape[1]
        for t, n in enumerate(self.active):
            a, b = self.offset[t], self.offset[t + 1]
            last = ahead[self.offset[t - 1] : self.offset[t - 1] + n] @ move if t else begin
            now = emission[a:b] * last
            ahead[a:b] = now / now.sum(1, keepdims=True)
        back = np.ones_like(emission)
        pairs = np.zeros((labels, labels))
        for t in range(len(self.active) - 1, 0, -1):
            a, b = self.offset[t], self.offset[t + 1]
            n = b - a
            carried = emission[a:b] * back[a:b]
            before = slice(self.offset[t - 1], self.offset[t - 1] + n)
            value = carried @ move.T
            norm = (ahead[before] * value).sum(1, keepdims=True)
            pairs += move * (ahead[before].T @ (carried / norm))
            back[before] = value / value.sum(1, keepdims=True)
        both = ahead * back
        return both / both.sum(1, keepdims=True), pairs


@dataclass(frozen=True)
class Model:
    labels: list[str]
    features: Features
    weights: np.ndarray  # by feature and label
    move: np.ndarray  # positive transition scores
    begin: np.ndarray

    def label(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(number of the label, its mean posterior) of each text; -1 and 0 for a text without words."""
        words = LetterWords(texts)
        hashes = words.hashes()
        kinds, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        number, starts = self.features.of(words, first, kinds)
        scores = np.add.reduceat(self.weights[number], starts, axis=0) if len(first) else np.zeros((0, len(self.labels)))
        positive = np.exp(scores - scores.max(1, keepdims=True)) + 1e-12 if len(first) else scores
        n = words.counts()
        lattice = Lattice(n)
        emission = np.empty((len(words), len(self.labels)))
        emission[lattice.place] = positive[back]
        after, _ = lattice.posteriors(emission, self.move, self.begin)
        after = after[lattice.place]
        mean = np.stack([np.bincount(lattice.text, after[:, j], len(n)) for j in range(len(self.labels))], axis=1)
        mean /= np.maximum(n, 1)[:, None]
        best = mean.argmax(1) if len(n) else np.zeros(0, np.int64)
        return np.where(n > 0, best, -1), np.where(n > 0, mean.max(1), 0.0) if len(n) else np.zeros(0)


def fit(texts: list[str], langs: list[str], rounds: int = 40, size: int = 1 << 17, piece: int = 20, decay: float = 1e-3) -> Model:
    """Fit weights and transitions by gradient steps on the conditional log-likelihood of the labelled words."""
    labels = sorted(set(langs))
    label_of = np.array([labels.index(x) for x in langs])
    words = LetterWords(Texts(pa.array(texts, pa.string())))
    hashes = words.hashes()
    kinds, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    text = np.repeat(np.arange(len(texts)), words.counts())
    gold = label_of[text]
    seen = np.stack([np.bincount(back, gold == j, len(kinds)) for j in range(len(labels))], axis=1)
    listed = (seen >= 3).any(1)
    bits = ((seen >= 3) << np.arange(len(labels)) % 60).sum(1)[listed].astype(U64)
    features = Features(size, kinds[listed], bits)
    number, starts = features.of(words, first, kinds)
    owner = np.repeat(np.arange(len(kinds)), np.diff(np.append(starts, len(number))))

    # Sequences: the texts themselves, and pieces of them in a mixed order, eight to a sequence.
    rng = np.random.default_rng(7)
    n = words.counts()
    piece_n = -(-n // piece)
    begin = np.repeat(words.first[:-1], piece_n) + piece * ranges(np.zeros(len(n), np.int64), piece_n)
    size_of = np.minimum(begin + piece, np.repeat(words.first[1:], piece_n)) - begin
    mixed = rng.permutation(len(begin))
    mixed_words = ranges(begin[mixed], size_of[mixed])
    of_eight = np.add.reduceat(size_of[mixed], np.arange(0, len(mixed), 8)) if len(mixed) else np.zeros(0, np.int64)
    own = n[n > 0]
    token = np.concatenate((np.arange(len(words)), mixed_words))
    lattice = Lattice(np.concatenate((own, of_eight)))
    kind, truth = back[token], gold[token]
    starts_at = np.cumsum(np.concatenate((own, of_eight))) - np.concatenate((own, of_eight))
    within = np.ones(len(token), bool)
    within[starts_at] = False
    wanted_pairs = np.zeros((len(labels), len(labels)))
    np.add.at(wanted_pairs, (truth[:-1][within[1:]], truth[1:][within[1:]]), 1)

    weights = np.zeros((size, len(labels)))
    move = np.zeros((len(labels), len(labels)))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(move), np.zeros_like(move)]
    flat = np.ones(len(labels))
    for i in range(1, rounds + 1):
        scores = np.add.reduceat(weights[number], starts, axis=0)
        positive = np.exp(scores - scores.max(1, keepdims=True)) + 1e-12
        emission = np.empty((len(token), len(labels)))
        emission[lattice.place] = positive[kind]
        after, pairs = lattice.posteriors(emission, np.exp(move), flat)
        after = after[lattice.place]
        after[np.arange(len(token)), truth] -= 1
        per_kind = np.stack([np.bincount(kind, after[:, j], len(kinds)) for j in range(len(labels))], axis=1)
        slope = np.stack([np.bincount(number, per_kind[owner, j], size) for j in range(len(labels))], axis=1)
        slopes = slope / len(token) + decay * weights / 100, (pairs - wanted_pairs) / len(token) + decay * move / 100
        for k, (parameter, slope) in enumerate(zip((weights, move), slopes)):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            parameter -= 0.2 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    return Model(labels, features, weights.astype(np.float32), np.exp(move - move.max()), flat / len(flat))


def _label(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = model.value
        for batch in parts(batches, "text", 3 << 20):
            best, mean = own.label(Texts(batch.column(1)))
            there = best >= 0
            names = [own.labels[j] if ok else UNKNOWN for j, ok in zip(best, there)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.where(there, mean, 0.0))],
                names=["row", "lang_pred", "score"],
            )

    return run


def _slice(text: Column, key: Column, longest: int) -> Column:
    """``text`` itself, or ``longest`` characters of a longer one, with a letter if it has one."""
    size = F.lit(longest)
    placed = F.substr(text, (F.pmod(key, F.length(text) - size + 1) + 1).cast("int"), size)
    lettered = F.substr(text, F.regexp_instr(text, F.lit(f"({LETTER})")), size)
    return F.when(F.length(text) <= size, text).when(placed.rlike(LETTER), placed).otherwise(lettered)


def identify(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = 800,
    longest: int = 10_000,
) -> DataFrame:
    """``docs`` with lang_pred (string) and score (double, 0 to 1) added.

    The model is fitted on ``sample`` texts at most, as many of each language (rows where ``training`` is true, the
    language is not null and the text has a letter; those with the smallest hash of id and text). Of a text above
    ``longest`` characters it reads a slice of that length, placed by the hash, or from the first letter on if that
    slice has none. Every row is labelled, by its text alone. Defined cases: a null text, one without letters, and
    every text when there is nothing to learn from, are ``und`` with score 0; columns called like an added one are
    replaced, others pass through; an empty table gives an empty result.
    """
    fits = F.coalesce(training, F.lit(False)) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(LETTER)
    spread = W.partitionBy("lang").orderBy("key", "text")
    key = F.xxhash64(id_col, text_col).alias("key")
    labelled = docs.where(fits).select(F.col(lang_col).alias("lang"), _slice(F.col(text_col), key, longest).alias("text"), key)
    languages = labelled.select("lang").distinct().count()
    each = max(1, sample // max(1, languages))
    chosen = labelled.withColumn("n", F.row_number().over(spread)).where(F.col("n") <= each).select("lang", "text")
    rows = sorted(chosen.collect(), key=lambda r: (r["lang"], r["text"]))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if not rows:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    model = fit([r["text"] for r in rows], [r["lang"] for r in rows])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.when(F.col(text_col).rlike(LETTER), F.col(text_col)).alias("text")
    packed = docs.select(F.struct(*kept).alias("row"), text)
    out = StructType([packed.schema["row"]]).add("lang_pred", "string").add("score", "double")
    return packed.mapInArrow(_label(shared), out).select("row.*", "lang_pred", "score")
