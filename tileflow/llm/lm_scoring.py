"""Language-model scores of texts by word trigrams that back off to a weighted automaton over classes.

Bigrams and trigrams of words are counted over all training texts, with discounts and backoff weights; what the
trigrams do not hold fails over to the bigrams, and so on. Below the bigrams words are predicted in two steps: the
class of the next word by a trigram model over classes, then the word within its class. The most frequent words are
classes of their own; all others share classes by their ending. The smoothed class n-grams are an automaton: a state
for each seen context, an arc for each seen continuation, and a failure arc to the next shorter context that carries
the backoff weight. The class count is fixed, so the automaton has a proven size (``classes`` ** 3 arcs) and is sent
to all tasks.

Each place of a text, with the two words before it, goes once to a shard, by the word before it; a shard counts the
places of training texts and scores all its places against these counts. The places of a crowded word are dealt
further, by the word before that; so a context of two words is whole in its shard, and the pairs that begin with
crowded words are counted ahead and sent to all their shards. Back go the sums of each text of a shard.

The most frequent words, a fixed number at most, travel with the automaton, and places hold their ranks; other words
are known by a 64-bit hash. Which of them a shard asks for, and the pairs after crowded words, go to buckets of words
first, which meet the counts there and answer the shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tileflow.llm.folders import stored
from tileflow.llm.words import U64, Texts, Words, mix, parts, ranges, signed

END_WORD = -0x0E5D0E5D0E5D0E5D  # the count table's key of the end of a text
LOW = (1 << 32) - 1


def endings(words: Words, forms: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """A form from 0 to forms - 1 for each word, or for those at the given places, by its last two bytes."""
    start, end = words.start[at], words.end[at]
    last = words.data[end - 1].astype(U64)
    before = np.where(end - start > 1, words.data[np.maximum(end - 2, 0)], 0).astype(U64)
    return (mix(last << U64(8) | before) % U64(forms)).astype(np.int64)


def look(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """np.searchsorted; it is several times faster for queries in order."""
    order = np.argsort(asked)
    out = np.empty(len(asked), np.int64)
    out[order] = np.searchsorted(keys, asked[order])
    return out


def _word_counts(forms: int, held: int = 1_000_000):
    """Rows word, form, n, places: a word's number in a task's training texts and in all its texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "form", "n", "places"]
        kept: list[list[np.ndarray]] = [[] for _ in names]

        def merged() -> list[np.ndarray]:
            word, form, *counts = map(np.concatenate, kept)
            key, at, back = np.unique(word, return_index=True, return_inverse=True)
            return [key, form[at], *(np.bincount(back, n, len(key)).astype(np.int64) for n in counts)]

        for batch in parts(batches, "text"):
            words = Words(Texts(batch.column("text")), lower=True)
            trained = batch.column("trained").to_numpy(zero_copy_only=False)
            key, at, back = np.unique(signed(words.hashes()), return_index=True, return_inverse=True)
            n = np.bincount(back, np.repeat(trained, words.counts()), len(key)).astype(np.int64)
            found = [key, endings(words, forms, at), n, np.bincount(back, minlength=len(key))]
            ends = [END_WORD, -1, trained.sum(), len(trained)]
            for column, x, end in zip(kept, found, ends):
                column += [x, np.array([end])]
            if sum(map(len, kept[0])) > held:
                kept = [[x] for x in merged()]
                if len(kept[0][0]) > held // 2:
                    yield pa.RecordBatch.from_arrays([x[0] for x in kept], names=names)
                    kept = [[] for _ in names]
        if kept[0]:
            yield pa.RecordBatch.from_arrays(merged(), names=names)

    return run


@dataclass(frozen=True)
class Frequent:
    """The most frequent words: sorted keys and the rank of each; by rank, the end last: key, count and class."""

    word: np.ndarray
    rank: np.ndarray
    key: np.ndarray
    n: np.ndarray
    klass: np.ndarray
    classes: int
    forms: int

    @property
    def end(self) -> int:
        return len(self.word)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each key, -1 of one that is not frequent."""
        if not len(self.word):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(look(self.word, keys), len(self.word) - 1)
        return np.where(self.word[at] == keys, self.rank[at], -1)

    def classed(self, forms: np.ndarray) -> np.ndarray:
        """Classes by number, those of other words with the given forms behind those of the frequent ones."""
        return np.concatenate((self.klass, self.classes - 1 - self.forms + forms))


@dataclass(frozen=True)
class Deal:
    """The shard of a place: by the word before it, or, where that is crowded, by the two words before it.

    Words have buckets too, a quarter as many as there are shards.
    """

    shards: int
    crowded: np.ndarray  # sorted keys
    pieces: np.ndarray

    def shard(self, key: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return (mix(np.ascontiguousarray(key).view(U64) + mix(piece)) % U64(self.shards)).astype(np.int64)

    def bucket(self, key: np.ndarray) -> np.ndarray:
        return (mix(np.ascontiguousarray(key).view(U64) ^ U64(self.shards)) % U64(self.shards // 4 + 1)).astype(np.int64)

    def split(self, key: np.ndarray) -> np.ndarray:
        """Into how many pieces the places behind each key are dealt."""
        if not len(self.crowded):
            return np.ones(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.crowded, key), len(self.crowded) - 1)
        return np.where(self.crowded[at] == key, self.pieces[at], 1)

    def place(self, key: np.ndarray, split: np.ndarray, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        """The shard of each place; ``two`` and ``one`` are numbers of words, ``key`` and ``split`` go by number."""
        out = self.shard(key, np.zeros(len(key), np.int64))[one]
        at = np.flatnonzero(split[one] > 1)
        out[at] = self.shard(key[one[at]], mix(key[two[at]].view(U64)) % split[one[at]].astype(U64))
        return out

    def everywhere(self) -> tuple[np.ndarray, np.ndarray]:
        """All shards of the crowded words: word, shard."""
        word = np.repeat(self.crowded, self.pieces)
        shard = self.shard(word, ranges(np.zeros(len(self.pieces), np.int64), self.pieces))
        found = np.unique(np.stack((word, shard)), axis=1)
        return found[0], found[1]


def sequences(words: Words, classes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts with an end after each text, and where each text begins."""
    n = words.counts() + 1
    begin = np.cumsum(n) - n
    out = np.full(int(n.sum()), end, np.int64)
    text = np.repeat(np.arange(len(n)), words.counts())
    out[np.arange(len(classes)) + text] = classes
    return out, begin


def contexts(line: np.ndarray, begin: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes two and one places before each place; before a text stand ends."""
    one = np.concatenate(([end], line[:-1])) if len(line) else line
    two = np.concatenate(([end], one[:-1])) if len(line) else line
    one[begin] = end
    two[begin] = end
    second = begin + 1
    second = second[second < len(line)]
    two[second] = end
    return two, one


class Places:
    """The places of some texts: ``text``, and the numbers of the word there (``line``) and one and two places before.

    A frequent word's number is its rank, the end comes next, then all other words by key; ``key`` has all keys by
    number, ``form`` the forms of the other words.
    """

    def __init__(self, texts: pa.Array, frequent: Frequent):
        words = Words(Texts(texts), lower=True)
        keys = signed(words.hashes())
        number = frequent.ranks(keys)
        rare = np.flatnonzero(number < 0)
        other, first, back = np.unique(keys[rare], return_index=True, return_inverse=True)
        number[rare] = frequent.end + 1 + back
        self.key = np.concatenate((frequent.key, other))
        self.form = endings(words, frequent.forms, rare[first])
        self.sizes = words.counts() + 1
        self.text = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        line, begin = sequences(words, number, frequent.end)
        self.line = line.astype(np.int32)
        self.two, self.one = (x.astype(np.int32) for x in contexts(line, begin, frequent.end))


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key for two numbers below 2 ** 31."""
    return a.astype(np.int64) << 32 | b


def _class_grams(model):
    """Rows gram, n of the class trigrams of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, _ = model.value
        c = frequent.classes
        total = np.zeros(c**3, np.int64)
        for batch in parts(batches, "text"):
            at = Places(batch.column("text"), frequent)
            klass = frequent.classed(at.form)
            total += np.bincount((klass[at.two] * c + klass[at.one]) * c + klass[at.line], minlength=c**3)
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": key, "n": total[key]})

    return run


def _rows(kinds: dict[str, pa.DataType], columns: dict) -> pa.RecordBatch:
    """A batch of the given columns and nulls in the others."""
    n = len(next(iter(columns.values())))
    arrays = [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(kinds))


class Automaton:
    """States are seen contexts; ``arc`` holds state * classes + class of each seen continuation in order.

    State 0 is the empty context, with arcs for all classes. ``weight`` and ``fail_weight`` are log10.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, classes: int, discount: float):
        self.classes = c = classes
        levels = [np.bincount(grams % c, counts, c)]
        levels.append(np.bincount(grams % c**2, counts, c**2))
        levels.append(np.bincount(grams, counts, c**3))
        prob = (levels[0] + 1) / (levels[0].sum() + c)
        arcs, weights = [np.arange(c)], [np.log10(prob)]
        self.state_of = [np.zeros(1, np.int64)]  # by context: the state, or that of a shorter context
        fail, fail_weight = [np.array([-1])], [np.zeros(1)]
        states = 1
        for k in (1, 2):
            table = levels[k].reshape(-1, c)
            n, kinds = table.sum(1), (table > 0).sum(1)
            seen = np.flatnonzero(n)
            number = np.full(len(n), -1, np.int64)
            number[seen] = states + np.arange(len(seen))
            shorter = self.state_of[k - 1][seen % c ** (k - 1)]
            lower = prob.reshape(-1, c)[np.arange(len(n)) % c ** (k - 1)] if k > 1 else np.broadcast_to(prob, table.shape)
            back = np.where(n > 0, discount * kinds / np.maximum(n, 1), 1.0)
            prob = np.maximum(table - discount, 0) / np.maximum(n, 1)[:, None] + back[:, None] * lower
            row, column = np.nonzero(table)
            arcs.append(number[row] * c + column)
            weights.append(np.log10(prob[row, column]))
            fail.append(shorter)
            fail_weight.append(np.log10(back[seen]))
            rest = self.state_of[k - 1][np.arange(len(n)) % c ** (k - 1)]
            self.state_of.append(np.where(number >= 0, number, rest))
            states += len(seen)
        self.arc, self.weight = np.concatenate(arcs), np.concatenate(weights)
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(fail_weight)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 probabilities of reading symbols in states; follows failure arcs until an arc is there."""
        out = np.zeros(len(state))
        left = np.arange(len(state))
        state = state.copy()
        while len(left):
            key = state[left] * self.classes + symbol[left]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            there = self.arc[at] == key
            out[left[there]] += self.weight[at[there]]
            left = left[~there]
            out[left] += self.fail_weight[state[left]]
            state[left] = self.fail[state[left]]
        return out

    def read(self, two: np.ndarray, one: np.ndarray, line: np.ndarray) -> np.ndarray:
        """log10 probability of each class after two others.

        After reading a text up to some place the state is that of its last two classes, or of the longest part of
        them that is a seen context.
        """
        return self.step(self.state_of[2][two * self.classes + one], line)


def packed(x: np.ndarray, kind: str = "<u4") -> list[bytes]:
    """Numbers as compressed bytes, those of equal weight together: the upper ones of ranks are nearly all alike."""
    planes = np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize).T)
    return [pa.compress(p, codec="zstd", asbytes=True) if p.any() else b"" for p in planes]


def unpacked(planes: list[bytes], n: int, kind: str = "<u4") -> np.ndarray:
    out = np.zeros((n, len(planes)), np.uint8)
    for i, p in enumerate(planes):
        if p:
            out[:, i] = np.frombuffer(pa.decompress(p, n, codec="zstd", asbytes=True), np.uint8)
    return out.view(kind)[:, 0]


def _runs(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of the runs of a sorted array."""
    value, begin = np.unique(sorted_, return_index=True)
    return list(zip(value.tolist(), begin.tolist(), [*begin[1:].tolist(), len(sorted_)]))


def coded(numbers: np.ndarray, key: np.ndarray, end: int) -> tuple[np.ndarray, list[bytes]]:
    """Rows of numbers of words as bytes, with the keys of those behind ``end``, and which these are."""
    rare = numbers > end
    other, back = np.unique(numbers[rare], return_inverse=True)
    numbers = numbers.copy()
    numbers[rare] = end + 1 + back
    steps = np.diff(key[other], prepend=0)  # the keys ascend, so the upper bytes of most steps are 0
    return other, [np.array([numbers.shape[1], len(other)]).tobytes(), *packed(steps, "<i8"), *(p for x in numbers for p in packed(x))]


def decoded(blob: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keys and the rows of numbers, as ``coded`` made them."""
    n, n_other = np.frombuffer(blob[0], np.int64)
    keys = np.cumsum(unpacked(blob[1:9], n_other, "<i8"))
    return keys, np.stack([unpacked(blob[k : k + 4], n) for k in range(9, len(blob), 4)])


def _requests(model):
    """Rows bucket, asked, pairs: other words that shards ask for, and pairs after crowded words in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, deal = model.value
        for batch in parts(batches, "text"):
            at = Places(batch.column("text"), frequent)
            trained = batch.column("trained").to_numpy(zero_copy_only=False)[at.text]
            bucket, split = deal.bucket(at.key), deal.split(at.key)
            rare = np.flatnonzero(at.line > frequent.end)
            asked = np.unique(joint(deal.place(at.key, split, at.two[rare], at.one[rare]), at.line[rare]))
            order = np.argsort(bucket[asked & LOW], kind="stable")
            asked, found = asked[order], []
            for b, i, j in _runs(bucket[asked & LOW]):
                word = np.unique(asked[i:j] & LOW)
                steps = packed(np.diff(at.key[word], prepend=0), "<i8")
                place = packed(np.searchsorted(word, asked[i:j] & LOW))
                found.append((b, [np.array([j - i, len(word)]).tobytes(), *steps, *packed(asked[i:j] >> 32), *place], None))
            crowd = trained & (split[at.one] > 1)
            pair, n = np.unique(joint(at.one[crowd], at.line[crowd]), return_counts=True)
            order = np.argsort(bucket[pair & LOW], kind="stable")
            pair, n = pair[order], n[order]
            for b, i, j in _runs(bucket[pair & LOW]):
                blob = coded(np.stack((pair[i:j] >> 32, pair[i:j] & LOW)), at.key, frequent.end)[1]
                found.append((b, None, [*blob, *packed(n[i:j])]))
            if found:
                yield _rows(_ASKED, dict(zip(_ASKED, zip(*found))))

    return run


_ASKED = {"bucket": pa.int64(), "asked": pa.list_(pa.binary()), "pairs": pa.list_(pa.binary()), "counts": pa.list_(pa.binary())}


def _other_counts(model, held: int = 1_000_000):
    """Rows bucket, counts: the counts of words that are not sent to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, deal = model.value
        kept: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            word, n = (np.concatenate([b.column(c).to_numpy() for b in kept]) for c in ("word", "n"))
            there = (frequent.ranks(word) < 0) & (word != END_WORD)
            word, n = word[there], n[there]
            bucket = deal.bucket(word)
            order = np.lexsort((word, bucket))
            word, n, bucket = word[order], n[order], bucket[order]
            found = [
                (b, [np.array([j - i]).tobytes(), *packed(np.diff(word[i:j], prepend=0), "<i8"), *packed(n[i:j], "<i8")])
                for b, i, j in _runs(bucket)
            ]
            return _rows(_ASKED, {"bucket": [b for b, _ in found], "counts": [x for _, x in found]})

        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) > held:
                yield made()
                kept = []
        if kept:
            yield made()

    return run


def _answers(model):
    def run(group: pa.Table) -> pa.Table:
        """A bucket's rows -> for each shard the counts of the words it asks for, in the order of their keys, and pairs."""
        frequent, deal = model.value
        asked, pairs, counts = ([x for x in group[c].to_pylist() if x is not None] for c in ("asked", "pairs", "counts"))
        known = [(np.cumsum(unpacked(x[1:9], n, "<i8")), unpacked(x[9:], n, "<i8")) for x in counts for n in np.frombuffer(x[0], np.int64)]
        word, n = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64)), *known))
        order = np.argsort(word)
        word, n = word[order], n[order]

        found = []
        wants = []
        for x in asked:
            size, size_word = np.frombuffer(x[0], np.int64)
            key = np.cumsum(unpacked(x[1:9], size_word, "<i8"))
            wants.append((unpacked(x[9:13], size), key[unpacked(x[13:], size)]))
        shard, key = (np.concatenate(x) for x in zip((np.zeros(0, np.uint32), np.zeros(0, np.int64)), *wants))
        every, back = np.unique(key, return_inverse=True)
        want = np.unique(joint(shard, back))
        times = _find(word, n, every)[want & LOW]
        for s, i, j in _runs(want >> 32):
            found.append((s, [np.array([j - i]).tobytes(), *packed(times[i:j], "<i8")], None))

        read = [(*decoded(x[:-4]), unpacked(x[-4:], np.frombuffer(x[0], np.int64)[0])) for x in pairs]
        other = np.unique(np.concatenate((np.zeros(0, np.int64), *(keys for keys, *_ in read))))
        grams = np.concatenate((np.zeros((2, 0), np.int64), *(renumbered(x, keys, other, frequent.end) for keys, x, _ in read)), axis=1)
        pair, back = np.unique(joint(*grams), return_inverse=True)
        times = np.bincount(back, np.concatenate((np.zeros(0), *(x for *_, x in read))), len(pair)).astype(np.int64)
        key = np.concatenate((frequent.key, other))
        crowd, place = deal.everywhere()
        first = np.searchsorted(crowd, key[pair >> 32])
        size = np.searchsorted(crowd, key[pair >> 32], "right") - first
        shard, at = place[ranges(first, size)], np.repeat(np.arange(len(pair)), size)
        order = np.argsort(shard, kind="stable")
        for s, i, j in _runs(shard[order]):
            mine = pair[at[order[i:j]]]
            blob = coded(np.stack((mine >> 32, mine & LOW)), key, frequent.end)[1]
            found.append((s, None, [*blob, *packed(times[at[order[i:j]]], "<i8")]))
        columns = [list(x) for x in zip(*found)] or [[], [], []]
        bucket = [group["bucket"][0].as_py()] * len(columns[0])
        return pa.Table.from_batches([_rows(_ANSWERED, dict(zip(_ANSWERED, (columns[0], bucket, *columns[1:]))))])

    return run


_ANSWERED = {"shard": pa.int64(), "home": pa.int64(), "answers": pa.list_(pa.binary()), "pairs": pa.list_(pa.binary())}


def renumbered(numbers: np.ndarray, keys: np.ndarray, other: np.ndarray, end: int) -> np.ndarray:
    """Numbers of words, those behind ``end`` by their places in ``other`` instead of in ``keys``."""
    numbers = numbers.astype(np.int64)
    rare = numbers > end
    numbers[rare] = end + 1 + np.searchsorted(other, keys)[numbers[rare] - end - 1]
    return numbers


def _places(model):
    """Rows of texts -> a row for each text, and for each part of the texts (home) and shard the places that go there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, deal = model.value
        home = TaskContext.get().partitionId() << 32
        for batch in parts(batches, "text"):
            kinds = _MADE | {"id": batch.schema.field("id").type}
            trained = batch.column("trained")
            at = Places(batch.column("text"), frequent)
            n_texts = batch.num_rows
            n = np.concatenate((frequent.n, np.zeros(len(at.form), np.int64)))
            known = np.bincount(at.text, n[at.line] > 0, n_texts).astype(np.int64)
            base = np.bincount(at.text, np.log10(n + 1.0)[at.line], n_texts)
            whole = {"shard": np.full(n_texts, home % deal.shards), "home": np.full(n_texts, home), "text": np.arange(n_texts)}
            yield _rows(kinds, whole | {"id": batch.column("id"), "trained": trained, "n_tokens": at.sizes, "known": known, "base": base})

            shard = deal.place(at.key, deal.split(at.key), at.two, at.one)
            order = np.argsort(shard.astype(np.uint16) if deal.shards < 1 << 16 else shard, kind="stable")
            flags = np.packbits(trained.to_numpy(zero_copy_only=False)).tobytes()
            found = []
            for a, i, j in _runs(shard[order]):
                mine = order[i:j]
                other, blob = coded(np.stack((at.two[mine], at.one[mine], at.line[mine])), at.key, frequent.end)
                texts = packed(np.bincount(at.text[mine], minlength=n_texts))
                forms = at.form[other - frequent.end - 1].astype(np.uint16).tobytes()
                found.append((a, home, [np.array([n_texts]).tobytes(), flags, forms, *texts, *blob]))
            if found:
                yield _rows(kinds, dict(zip(("shard", "home", "packed"), zip(*found))))
            home += 1

    return run


_MADE = {c: pa.int64() for c in ("shard", "home", "text")} | {"id": pa.null(), "trained": pa.bool_()}
_MADE |= {"n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "packed": pa.list_(pa.binary())}


def _find(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The counts of the asked keys, 0 of those that are not among the sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(look(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, counts[at], 0)


def _merged(found: Iterator[np.ndarray], held: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several arrays, and how often each is in them; memory follows the distinct keys."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept: list[np.ndarray] = []
    for x in chain(found, [None]):
        kept += [] if x is None else [x]
        if kept and (x is None or sum(map(len, kept)) > held):
            new, n = np.unique(np.concatenate(kept), return_counts=True)
            kept = []
            if len(keys):
                new, back = np.unique(np.concatenate((keys, new)), return_inverse=True)
                n = np.bincount(back, np.concatenate((counts, n)), len(new)).astype(np.int64)
            keys, counts = new, n
    return keys, counts


class Shard:
    """Counts of a shard's n-grams and the scores of its places.

    States are contexts of two words, of one word, and those of the class automaton; n-grams that training texts
    continue a context with are its arcs, and the failure arc to the next shorter context carries the backoff weight.
    Places are read in runs of about ``held``, so that memory follows the distinct n-grams and not the places.
    """

    def __init__(self, blobs, pairs, answers, deal: Deal, frequent: Frequent, form_n, form_v, alpha: float, discount: float, held: int):
        self.blobs, self.discount, self.end = blobs, discount, frequent.end
        self.texts = np.array([np.frombuffer(b[0], np.int64)[0] for b in blobs], np.int64)
        size = np.array([np.frombuffer(b[7], np.int64) for b in blobs], np.int64).reshape(-1, 2)
        self.own = [np.cumsum(unpacked(b[8:16], n, "<i8")) for b, (_, n) in zip(blobs, size)]
        pairs = [(*decoded(x[:-8]), unpacked(x[-8:], np.frombuffer(x[0], np.int64)[0], "<i8")) for x in pairs]
        mates = [keys for keys, *_ in pairs]
        self.other, first = np.unique(np.concatenate((np.zeros(0, np.int64), *self.own, *mates)), return_index=True)
        form = [np.frombuffer(b[2], np.uint16) for b in blobs] + [np.zeros(len(x), np.uint16) for x in mates]
        form = np.concatenate((np.zeros(0, np.uint16), *form))[first].astype(np.int64)
        self.klass = frequent.classed(form)

        run = np.cumsum(size[:, 0]) // max(held, 1)
        self.runs = np.split(np.arange(len(blobs)), np.flatnonzero(np.diff(run)) + 1) if len(blobs) else []
        self.last, self.last_keys = (-1, ()), (-1, np.zeros(0, np.int64))
        asked = np.zeros(len(self.other), bool)

        def contexts_read() -> Iterator[np.ndarray]:
            for i in range(len(self.runs)):
                two, one, line, *_ = self.read(i)
                asked[line[line > self.end] - self.end - 1] = True
                yield joint(two, one)

        self.uv, _ = _merged(contexts_read())
        self.n = np.concatenate((frequent.n, self._answered(np.flatnonzero(asked), answers, deal)))
        # The probability of a word in its class: 1 where it is alone, as are the end and the most frequent words.
        form_of = self.klass - (frequent.classes - 1 - frequent.forms)
        shared = (form_of >= 0) & (form_of < frequent.forms)
        of_form = (form_n + alpha * (form_v + 1))[np.where(shared, form_of, 0)]
        self.inner = np.where(shared, (self.n + alpha) / of_form, 1.0)

        ahead = [joint(*renumbered(x, keys, self.other, self.end)) for keys, x, _ in pairs]
        ahead = np.concatenate((np.zeros(0, np.int64), *ahead))
        crowded = np.zeros(len(self.n), bool)
        crowded[ahead >> 32] = True

        def other_pairs() -> Iterator[np.ndarray]:
            for i in range(len(self.runs)):
                _, one, line, _, trained = self.read(i)
                at = trained & ~crowded[one]
                yield joint(one[at], line[at])

        vw, vw_n = _merged(other_pairs())
        vw, vw_n = np.concatenate((vw, ahead)), np.concatenate((vw_n, *(n for *_, n in pairs)))
        order = np.argsort(vw)
        self.vw, self.vw_n = vw[order], vw_n[order]
        self.uvw, self.uvw_n = _merged(self.keys(i)[self.read(i)[4]] for i in range(len(self.runs)))
        self.after_one = self._contexts(self.vw, self.vw_n, len(self.n))
        self.after_two = self._contexts(self.uvw, self.uvw_n, len(self.uv))

    def _answered(self, asked: np.ndarray, answers: list[tuple[int, list[bytes]]], deal: Deal) -> np.ndarray:
        """Counts of the other words; buckets answer in the order of the keys."""
        out = np.zeros(len(self.other), np.int64)
        bucket = deal.bucket(self.other[asked])
        given = 0
        for b, x in answers:
            at, n = asked[bucket == b], np.frombuffer(x[0], np.int64)[0]
            if len(at) != n:
                raise ValueError("the texts were not the same when they were read again")
            out[at] = unpacked(x[1:], n, "<i8")
            given += n
        if given != len(asked):
            raise ValueError("the texts were not the same when they were read again")
        return out

    def _contexts(self, keys: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each context the count, at least 1, and the weight of its failure arc."""
        total, kinds = np.bincount(keys >> 32, counts, n), np.bincount(keys >> 32, minlength=n)
        return np.maximum(total, 1), np.where(total > 0, self.discount * kinds / np.maximum(total, 1), 1.0)

    def read(self, i: int) -> tuple[np.ndarray, ...]:
        """two, one, line (numbers in the shard), slot (text in the run), trained of all places of a run."""
        if self.last[0] != i:
            self.last = i, self._read(i)
        return self.last[1]

    def keys(self, i: int) -> np.ndarray:
        """Keys of a run's trigrams."""
        if self.last_keys[0] != i:
            two, one, line, *_ = self.read(i)
            self.last_keys = i, joint(look(self.uv, joint(two, one)), line)
        return self.last_keys[1]

    def _read(self, i: int) -> tuple[np.ndarray, ...]:
        grams, slots, flags, before = [], [], [], 0
        for j in self.runs[i]:
            blob, n_texts = self.blobs[j], self.texts[j]
            _, numbers = decoded(blob[7:])
            text = np.repeat(np.arange(n_texts, dtype=np.int32), unpacked(blob[3:7], n_texts))
            flags.append(np.unpackbits(np.frombuffer(blob[1], np.uint8), count=n_texts).astype(bool)[text])
            grams.append(renumbered(numbers, self.own[j], self.other, self.end).astype(np.int32))
            slots.append(text + np.int32(before))
            before += n_texts
        two, one, line = np.concatenate(grams, axis=1)
        return two, one, line, np.concatenate(slots), np.concatenate(flags)

    def logs(self, grams: np.ndarray, automaton: Automaton) -> np.ndarray:
        """log10 probability of the last words of distinct trigrams."""
        at, w = grams >> 32, grams & LOW
        u, v = self.uv[at] >> 32, self.uv[at] & LOW
        total, rest = self.after_one[0][v], self.after_one[1][v]
        p = np.maximum(_find(self.vw, self.vw_n, v << 32 | w) - self.discount, 0) / total
        total, fail = self.after_two[0][at], self.after_two[1][at]
        p = np.maximum(_find(self.uvw, self.uvw_n, grams) - self.discount, 0) / total + fail * p
        c = automaton.classes
        key = (self.klass[u] * c + self.klass[v]) * c + self.klass[w]
        outer = np.zeros(c**3)
        outer[key] = 1
        there = np.flatnonzero(outer)
        outer[there] = automaton.read(there // c**2, there // c % c, there % c)
        return np.log10(p + fail * rest * self.inner[w] * 10 ** outer[key])

    def sums(self, automaton: Automaton) -> Iterator[list[bytes]]:
        """For each blob: texts and the sums of their scores; texts, numbers and base sums of other known words."""
        log_n = np.log10(self.n + 1.0)
        for i, run in enumerate(self.runs):
            _, _, line, slot, _ = self.read(i)
            n = int(self.texts[run].sum())
            gram, back = np.unique(self.keys(i), return_inverse=True)
            model = np.bincount(slot, self.logs(gram, automaton)[back], n)
            seen = np.bincount(slot, minlength=n)
            more = np.flatnonzero((line > self.end) & (self.n[line] > 0))
            known = np.bincount(slot[more], minlength=n)
            base = np.bincount(slot[more], log_n[line[more]], n)
            begin = 0
            for end in np.cumsum(self.texts[run]):
                text, also = np.flatnonzero(seen[begin:end]), np.flatnonzero(known[begin:end])
                sizes = np.array([len(text), len(also)]).tobytes()
                sums = model[begin + text].tobytes(), base[begin + also].tobytes()
                yield [sizes, *sums, *packed(text), *packed(also), *packed(known[begin + also])]
                begin = end


def _shard_sums(model, alpha: float, discount: float, held: int):
    def run(group: pa.Table) -> pa.Table:
        """A shard's rows -> its texts' rows as they are, and sums for the texts of each blob."""
        frequent, deal, automaton, form_n, form_v = model.value
        names = list(_MADE)
        whole = group.filter(pc.is_valid(group["n_tokens"])).select(names)
        blobs = group.filter(pc.is_valid(group["packed"])).sort_by("home")
        pairs = group.filter(pc.is_valid(group["pairs"]))["pairs"].to_pylist()
        answers = group.filter(pc.is_valid(group["answers"]))
        answers = list(zip(answers["home"].to_pylist(), answers["answers"].to_pylist()))
        shard = Shard(blobs["packed"].to_pylist(), pairs, answers, deal, frequent, form_n, form_v, alpha, discount, held // 12)
        sums = list(shard.sums(automaton))
        kinds = {c: group.schema.field(c).type for c in names}
        found = _rows(kinds, {"shard": blobs["shard"].combine_chunks(), "home": blobs["home"].combine_chunks(), "packed": sums})
        return pa.concat_tables([whole, pa.Table.from_arrays(found.columns, schema=whole.schema)])

    return run


def _home_sums(group: pa.Table) -> pa.Table:
    """The rows of a home's texts with their sums of all shards."""
    whole = group.filter(pc.is_valid(group["n_tokens"])).sort_by("text")
    n = len(whole)
    known, base, score = whole["known"].to_numpy().copy(), whole["base"].to_numpy().copy(), np.zeros(n)
    for blob in group.filter(pc.is_valid(group["packed"])).sort_by("shard")["packed"]:
        sizes, sums, more, *planes = blob.as_py()
        n_text, n_also = np.frombuffer(sizes, np.int64)
        score[unpacked(planes[:4], n_text)] += np.frombuffer(sums)
        also = unpacked(planes[4:8], n_also)
        known[also] += unpacked(planes[8:], n_also)
        base[also] += np.frombuffer(more)
    return pa.table({"id": whole["id"], "trained": whole["trained"], "n_tokens": whole["n_tokens"], "known": known, "base": base, "score": score})


def score_texts(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    classes: int = 128,
    forms: int = 31,
    frequent: int = 131_072,
    discount: float = 0.75,
    alpha: float = 1.0,
    held: int = 3 << 19,
) -> DataFrame:
    """id, trained (boolean), n_tokens, n_known, train_tokens (long), base_score, score (double, log10) of every text.

    Tokens are the ASCII-lower-cased words and one end. Rows where ``training`` is true are counted. base_score adds
    up log10((c + 1) / (N + V + 1)). The model: word trigrams and bigrams with interpolated absolute ``discount``,
    all that were counted, and below them classes: ``classes`` - 1 - ``forms`` words with most tokens, the end and
    ``forms`` endings; classes follow each other by interpolated absolute ``discount`` too; a word of an ending has
    probability (c + alpha) / (tokens + alpha * (words + 1)) in it. ``frequent`` bounds how many counts are sent to
    tasks besides those of the words with a class of their own; ``held`` is about the number of places in a shard.
    Both change no result.
    Defined cases: a null text is the empty text; null ids, repeated ids and rows are scored each for itself; a null
    ``training`` is false; without training rows all counts are 0; other columns are not read.
    """
    trained = F.coalesce(training, F.lit(False)).alias("trained")
    read = docs.select(trained, F.col(text_col).alias("text"))
    counted = read.mapInArrow(_word_counts(forms), "word bigint, form bigint, n bigint, places bigint")
    sums = [F.sum(c).alias(c) for c in ("n", "places")]
    counts = stored(counted.groupBy("word").agg(F.min("form").alias("form"), *sums), "counts")
    total = counts.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "places")], F.count(F.when(F.col("n") > 0, 1)).alias("v")
    ).first()

    # The most frequent words, at most ``frequent`` of them: all from the least count that leaves so many.
    step = F.floor(F.log2("n") * 16)
    words = counts.where("form >= 0 and n > 0")
    sizes = {r["step"]: r["words"] for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()}
    least, size = None, 0
    for s in sorted(sizes, reverse=True):
        size += sizes[s]
        if size > frequent:
            break
        least = s
    words = words.select("word", "form", "n")
    top = words.orderBy(F.desc("n"), "word").limit(max(0, classes - 1 - forms))
    sent = words.where(step >= least).unionByName(top).distinct() if least is not None else top
    single, table = top.toArrow(), sent.orderBy(F.desc("n"), "word").toArrow()
    single_n, single_form = (single.column(c).to_numpy().astype(np.int64) for c in ("n", "form"))
    word, form, n = (table.column(c).to_numpy().astype(np.int64) for c in ("word", "form", "n"))
    klass = classes - 1 - forms + form
    klass[: len(single)] = np.arange(len(single))  # the first of ``sent``, which has the same order
    end = counts.where(F.col("word") == END_WORD).first()
    rank = np.argsort(word)
    key, n, klass = (np.append(x, y) for x, y in ((word, END_WORD), (n, end["n"] if end else 0), (klass, classes - 1)))
    known = Frequent(word[rank], rank, key, n, klass, classes, forms)

    # A word is crowded that would fill a quarter of a shard; at most four for each shard are.
    share = max(held // 4, 1)
    crowd = counts.where(F.col("places") > share).select("word", "places").orderBy("word").toArrow()
    crowded, places = (crowd.column(c).to_numpy().astype(np.int64) for c in ("word", "places"))
    deal = Deal(-(-total["places"] // held) or 1, crowded, -(-places // share))

    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((known, deal))
    grams = read.where("trained").mapInArrow(_class_grams(sent), "gram bigint, n bigint")
    grams = grams.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most classes ** 3 rows
    gram, times = (grams.column(c).to_numpy().astype(np.int64) for c in ("gram", "n"))
    by_form = counts.where("form >= 0 and n > 0").groupBy("form").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    form_n, form_v = np.zeros(forms), np.zeros(forms)
    for r in by_form:
        form_n[r["form"]], form_v[r["form"]] = r["n"], r["v"]
    np.subtract.at(form_n, single_form, single_n)
    np.subtract.at(form_v, single_form, 1)
    model = spark.sparkContext.broadcast((known, deal, Automaton(gram, times, classes, discount), form_n, form_v))

    kinds = "bucket bigint, asked array<binary>, pairs array<binary>, counts array<binary>"
    asked = read.mapInArrow(_requests(sent), kinds)
    asked = asked.unionAll(counts.where("n > 0").select("word", "n").mapInArrow(_other_counts(sent), kinds))
    kinds = "shard bigint, home bigint, answers array<binary>, pairs array<binary>"
    asked = asked.groupBy("bucket").applyInArrow(_answers(sent), kinds)

    rows = docs.select(F.col(id_col).alias("id"), trained, F.col(text_col).alias("text"))
    kinds = StructType.fromDDL("shard bigint, home bigint, text bigint").add("id", rows.schema["id"].dataType)
    for f in StructType.fromDDL("trained boolean, n_tokens bigint, known bigint, base double, packed array<binary>"):
        kinds = kinds.add(f)
    made = rows.mapInArrow(_places(sent), kinds)
    made = made.unionByName(asked, allowMissingColumns=True)
    made = made.groupBy("shard").applyInArrow(_shard_sums(model, alpha, discount, held), kinds)
    ends = StructType([kinds[c] for c in ("id", "trained", "n_tokens", "known", "base")]).add("score", "double")
    whole = made.groupBy("home").applyInArrow(_home_sums, ends)
    norm = float(np.log10(total["n"] + total["v"] + 1))
    return whole.select(
        F.col("id").alias(id_col),
        "trained",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(total["n"]).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
    )
