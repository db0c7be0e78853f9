"""Similarity join of word-shingle sets by PartEnum signatures, and the groups that its links form.

Two sets link when 100 * |A n B| >= percent * |A u B|. Sizes fall into bands so that linked sets lie in one band or
in neighbouring ones; inside a band level the number of differing elements of a linked pair has a bound k. The
element domain is cut into parts by hash, and a set gives one signature per part (and per subset of its sub-parts
for small k); linked sets share at least one signature by the pigeonhole principle. Equal sets are one class from
the start. In each signature bucket all classes are first compared with the smallest one, its hub. Where such a
comparison fails, the hub's candidates outside its largest group so far are queries: blocks of them, bounded in
bytes, are held in tasks, all candidates of the hub stream past, and only links that join groups come out, fewer than
there are groups. So no bucket is expanded into pairs, and no link that joins groups is lost. Sketches (parities of element counts) first rule out what
cannot link; every link is checked on the whole sets.

Sets are kept as 64-bit element hashes; equality of classes rests on a 64-bit hash of the set.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tileflow.llm.components import components
from tileflow.llm.folders import stored
from tileflow.llm.words import U64, Texts, Words, fold, mix, parts, ranges, signed, windows

_GOLD = 0x9E3779B97F4A7C15
_ROOM = 8 << 20  # bytes of the sets, or of their sketches, that a block of queries holds


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the cuts between the texts."""
    words = Words(texts, lower=True)
    h = words.hashes()
    grams = windows(h, size)
    sets, cuts = [], [0]
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= size:
            sets.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            sets.append(windows(h[a:b], b - a, salt=b - a))
        else:
            sets.append(np.zeros(0, U64))
        cuts.append(cuts[-1] + len(sets[-1]))
    return np.concatenate(sets) if sets else np.zeros(0, U64), np.array(cuts)


def set_keys(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(fold(mix(values), cuts) + np.diff(cuts).astype(U64) * U64(_GOLD))


def sketch(values: np.ndarray) -> bytes:
    """Parity of the number of elements at each of a power of two of places, about two places an element."""
    places = max(64, 1 << (2 * len(values) - 1).bit_length()) if len(values) else 64
    at = mix(values ^ U64(_GOLD)) & U64(places - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=places) & 1, bitorder="little").tobytes()


def may_link(a: tuple[int, bytes], b: tuple[int, bytes], percent: int) -> bool:
    """False only if two sets, given by size and sketch, cannot link.

    Places with different parity hold an element of just one set, so there are at least as many of those elements.
    """
    (n, x), (m, y) = a, b
    if 100 * min(n, m) < percent * max(n, m):
        return False
    while len(x) != len(y):  # halves of a sketch add up to the next smaller one
        x, y = sorted((x, y), key=len)
        half = len(y) // 2
        y = (int.from_bytes(y[:half]) ^ int.from_bytes(y[half:])).to_bytes(half)
    return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count() <= (100 - percent) * (n + m) // (100 + percent)


def bands(percent: int, most: int) -> list[tuple[int, int]]:
    """(smallest, largest) size of each band up to the one that holds ``most``, and one more."""
    out, low = [], 1
    while not out or out[-1][0] <= most:
        high = low * 100 // percent
        out.append((low, high))
        low = high + 1
    return out


def differing(percent: int, size: int) -> int:
    """Most elements in exactly one of two linked sets of at most ``size`` elements each."""
    return 2 * (100 - percent) * size // (100 + percent)


def layout(k: int, low: int) -> tuple[int, int, int, int]:
    """Parts, sub-parts, sub-parts that may differ, and spare parts, for k differences of sets from ``low`` elements on.

    parts - spare parts hold the pigeonhole: (parts - spare) * (loose + 1) > k. Linked sets agree in more than
    ``spare`` parts, so a set with at most ``spare`` empty ones can leave out their signatures; there are enough
    spare parts for nearly all sets.
    """
    if k <= 24:
        return -(-(k + 1) // 2), 3, 1, 0
    for spare in range(k):
        n = k + 1 + spare
        empty = n * math.exp(-low / n)
        if empty + 3 * math.sqrt(empty) + 1 <= spare:
            break
    return n, 1, 0, spare


def _bounds(n: int) -> np.ndarray:
    """n - 1 inner bounds that cut the 64-bit domain into n equal ranges."""
    return np.array([(i << 64) // n for i in range(1, n)], U64)


def _tag(*numbers: int) -> int:
    x = 0
    for n in numbers:
        x = (x * 1_000_003 + n + 1) & (2**64 - 1)
    return x


class Signatures:
    """Signatures of sorted sets, with the tables of each level made once per task."""

    def __init__(self, percent: int):
        self.percent = percent
        self.levels: dict[int, tuple] = {}

    def level(self, i: int, low: int, high: int) -> tuple:
        if i not in self.levels:
            k = differing(self.percent, high)
            n1, n2, loose, spare = layout(k, low)
            chosen = list(combinations(range(n2), n2 - loose))
            pick = np.zeros((len(chosen), n2), bool)
            for row, c in zip(pick, chosen):
                row[list(c)] = True
            tags = mix(np.array([_tag(i, p, c) for p in range(n1) for c in range(len(chosen))], U64)).reshape(n1, -1)
            self.levels[i] = k, n1, n2, spare, _bounds(n1 * n2), pick, tags, _bounds(k + 1)
        return self.levels[i]

    def of(self, values: np.ndarray, i: int, low: int, high: int) -> np.ndarray:
        """Signatures of one set (sorted hashes) at the level of sizes low to high; none where linked sets must be equal."""
        if not differing(self.percent, high):
            return np.zeros(0, U64)
        k, n1, n2, spare, bounds, pick, tags, nested = self.level(i, low, high)
        with np.errstate(over="ignore"):
            inner = np.searchsorted(values, bounds)
            cuts = np.concatenate(([0], inner, [len(values)]))
            sums = fold(mix(values), cuts).reshape(n1, n2)
            sizes = np.diff(cuts).reshape(n1, n2)
            content = np.stack([sums[:, p].sum(axis=1, dtype=U64) for p in pick], axis=1)
            filled = np.stack([sizes[:, p].sum(axis=1) for p in pick], axis=1) > 0
            out = mix(content + tags)
            empty = np.argwhere(~filled)
            if len(empty) <= spare:
                return out[filled]
            # A set with too many empty parts: an empty part counts only together with a part of a second cut.
            again = np.sort(mix(values ^ U64(_GOLD)))
            cuts = np.concatenate(([0], np.searchsorted(again, nested), [len(again)]))
            second = fold(mix(again), cuts) + mix(np.array([_tag(i, q) for q in range(k + 1)], U64))
            more = [mix(second + mix(np.array([_tag(i, int(p), int(c), 7)], U64))) for p, c in empty]
            return np.concatenate([out[filled], *more])

    def both(self, values: np.ndarray, sized: list[tuple[int, int]], turn: int | None = None) -> np.ndarray:
        """Signatures of a set at the level of its band and at the next one; ``turn`` takes even or odd levels only."""
        i = bisect_right(sized, (len(values), math.inf)) - 1
        levels = [j for j in (i, i + 1) if turn is None or j % 2 == turn]
        return np.concatenate([self.of(values, j, sized[max(j - 1, 0)][0], sized[j][1]) for j in levels])


def _emit(arrays: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(arrays)


def _classes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            values, cuts = shingle_sets(Texts(batch.column(1)), size)
            n = np.diff(cuts)
            key = pa.array(signed(set_keys(values, cuts)), mask=n == 0)
            drawn = [sketch(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            yield _emit({"id": batch.column(0), "n": pa.array(n), "key": key, "sketch": pa.array(drawn, pa.binary())})

    return run


def _signatures(
    size: int, percent: int, crowd: int | None, hot: frozenset, salts: int, turn: int | None = None, chunk: int = 400_000
):
    """Rows sig, slot, key of a task's sets; with ``crowd`` instead rows sig, n of signatures that many sets share.

    Copies of a set inside a task are skipped. ``hot`` signatures are dealt over slots. ``turn``: see ``both``.
    """
    hot_sigs = np.sort(np.array(list(hot), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, seen, sized = Signatures(percent), set(), bands(percent, 1)
        sigs, keys, held = [], [], 0

        def flush() -> pa.RecordBatch:
            sig, key = np.concatenate(sigs), np.concatenate(keys)
            if crowd is not None:
                sig, n = np.unique(sig, return_counts=True)
                return _emit({"sig": sig[n >= crowd], "n": n[n >= crowd]})
            slot = np.zeros(len(sig), np.int32)
            if len(hot_sigs):
                at = np.minimum(np.searchsorted(hot_sigs, sig), len(hot_sigs) - 1)
                is_hot = hot_sigs[at] == sig
                slot[is_hot] = 1 + (mix(key[is_hot].view(U64)) % U64(salts)).astype(np.int32)
            return _emit({"sig": sig, "slot": slot, "key": key})

        for batch in parts(batches, "text"):
            values, cuts = shingle_sets(Texts(batch.column(1)), size)
            own = signed(set_keys(values, cuts))
            most = int(np.diff(cuts).max(initial=1))
            if sized[-1][0] <= most:
                sized = bands(percent, most)
            if len(seen) > 500_000:
                seen.clear()
            for key, a, b in zip(own.tolist(), cuts[:-1], cuts[1:]):
                if a == b or key in seen:
                    continue
                seen.add(key)
                got = signed(np.unique(made.both(values[a:b], sized, turn)))
                sigs.append(got)
                keys.append(np.full(len(got), key))
                held += len(got)
                if held >= chunk:
                    yield flush()
                    sigs, keys, held = [], [], 0
        if held:
            yield flush()

    return run


def _sets(size: int):
    """Rows key, elements (bytes of the sorted hashes); each set once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in parts(batches, "text"):
            values, cuts = shingle_sets(Texts(batch.column(0)), size)
            out = {"key": [], "elements": []}
            for key, a, b in zip(signed(set_keys(values, cuts)).tolist(), cuts[:-1], cuts[1:]):
                if key not in seen:
                    seen.add(key)
                    out["key"].append(key)
                    out["elements"].append(values[a:b].tobytes())
            yield _emit({"key": pa.array(out["key"], pa.int64()), "elements": pa.array(out["elements"], pa.binary())})

    return run


def _compare(percent: int):
    """Rows hub, slot, key, elements, sorted so that a hub's own set comes first: keeps the keys that link with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, whole = None, None
        for batch in batches:
            a, b = [], []
            for hub, slot, key, elements in zip(*(batch.column(i).to_pylist() for i in range(4))):
                values = np.frombuffer(elements, U64)
                if key == hub:
                    place, whole = (hub, slot), values
                    continue
                if place != (hub, slot) or 100 * min(len(whole), len(values)) < percent * max(len(whole), len(values)):
                    continue
                small, large = sorted((whole, values), key=len)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int(np.count_nonzero(large[at] == small))
                if 100 * common >= percent * (len(small) + len(large) - common):
                    a.append(hub)
                    b.append(key)
            yield _emit({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _likely(percent: int):
    """Rows hub, key, n, sketch, hub_n, hub_sketch: the pairs that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, 6)]
            keep = [may_link((n, x), (m, y), percent) for n, x, m, y in zip(*columns)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


class _Block:
    """Sizes, groups and sketches of the queries of a block; one more sketch is compared with all of them at once."""

    def __init__(self, queries: list[tuple[int, int, int, bytes]], percent: int):
        self.percent = percent
        self.keys = [q[0] for q in queries]
        self.place = np.array([q[1] for q in queries], np.int64)
        self.n = np.array([q[2] for q in queries], np.int64)
        lengths = np.array([len(q[3]) for q in queries])
        self.drawn: dict[int, tuple[np.ndarray, dict[int, np.ndarray]]] = {}
        for length in set(lengths.tolist()):
            at = np.flatnonzero(lengths == length)
            words = np.frombuffer(b"".join(queries[i][3] for i in at), U64).reshape(len(at), -1)
            self.drawn[length] = at, {length: words}

    def _folded(self, length: int, to: int) -> np.ndarray:
        made = self.drawn[length][1]
        if to not in made:
            wide = self._folded(length, 2 * to)
            half = wide.shape[1] // 2
            made[to] = wide[:, :half] ^ wide[:, half:]
        return made[to]

    def likely(self, place: int, n: int, drawn: bytes) -> np.ndarray:
        """Numbers of the queries of other groups that may link, as ``may_link`` says."""
        found, own = [], {len(drawn): np.frombuffer(drawn, U64)}
        for length, (at, _) in self.drawn.items():
            m = self.n[at]
            sized = (self.place[at] != place) & (100 * np.minimum(m, n) >= self.percent * np.maximum(m, n))
            if not sized.any():
                continue
            to = min(length, len(drawn))
            while to not in own:
                least = own[min(own)]
                own[min(own) // 2] = least[: len(least) // 2] ^ least[len(least) // 2 :]
            apart = np.bitwise_count(self._folded(length, to)[sized] ^ own[to]).sum(axis=1, dtype=np.int64)
            found.append(at[sized][apart <= (100 - self.percent) * (m[sized] + n) // (100 + self.percent)])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _likely_across(percent: int):
    """Rows hub, block, part, role, key, place, n, sketch in the order of ``_cross``: hub and key of what may link.

    Each row says that a key may link with one of another place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries, held, told = None, [], None, np.zeros(0, bool)
        for batch in batches:
            hubs, keys = [], []
            for hub, block, part, role, key, place, n, drawn in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if now != (hub, block, part):
                    now, queries, held = (hub, block, part), [], None
                if not role:
                    queries.append((key, place, n, drawn))
                    continue
                if not queries:
                    continue
                if held is None:
                    held, told = _Block(queries, percent), np.zeros(len(queries), bool)
                met = held.likely(place, n, drawn)
                if len(met):
                    fresh = met[~told[met]]
                    told[fresh] = True
                    keys += [key, *(held.keys[i] for i in fresh)]
                    hubs += [hub] * (1 + len(fresh))
            yield _emit({"hub": pa.array(hubs, pa.int64()), "key": pa.array(keys, pa.int64())})

    return run


class _Forest:
    """Which of the groups met so far have been joined."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = self.above.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        """Joins the groups of x and y; False if they are one already."""
        x, y = self.root(x), self.root(y)
        self.above[x] = y
        return x != y


def _cross(percent: int):
    """Rows hub, block, part, role, key, place, elements, sorted so that the queries (role 0) of a block come first.

    Keeps the links (query, other) that join groups (places) not yet joined in the block, so there are fewer links
    than groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries, index, joined = None, [], None, _Forest()

        def indexed() -> tuple[np.ndarray, np.ndarray]:
            owner = np.repeat(np.arange(len(queries)), [len(v) for _, _, v in queries])
            values = np.concatenate([v for _, _, v in queries])
            order = np.argsort(values, kind="stable")
            return values[order], owner[order]

        for batch in batches:
            a, b = [], []
            for hub, block, part, role, key, place, elements in zip(*(batch.column(i).to_pylist() for i in range(7))):
                values = np.frombuffer(elements, U64)
                if now != (hub, block, part):
                    now, queries, index, joined = (hub, block, part), [], None, _Forest()
                if not role:
                    queries.append((key, place, values))
                    continue
                if not queries:
                    continue
                if index is None:
                    index = indexed()
                    sizes = np.array([len(v) for _, _, v in queries])
                low = np.searchsorted(index[0], values)
                times = np.searchsorted(index[0], values, side="right") - low
                common = np.bincount(index[1][ranges(low, times)], minlength=len(queries))
                for i in np.flatnonzero(100 * common >= percent * (sizes + len(values) - common)):
                    other, group, _ = queries[i]
                    if joined.join(group, place):
                        a.append(other)
                        b.append(key)
            yield _emit({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _sets_of(keys: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """key, elements of the wanted classes, from the whole text of one document each."""
    ids = stored(keys.join(classes, "key").select(F.col("first_id").alias("id")), "ids")
    sets = docs.join(ids, "id", "left_semi").select("text").mapInArrow(_sets(size), "key bigint, elements binary")
    return stored(sets, "sets")  # a repeated id may add sets that no pair asks for, or one of them twice


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int, slots: int = 16) -> DataFrame:
    """The pairs (hub, key) whose sets link, as a, b. The set of a hub is sent once per slot, not once per pair."""
    pairs = pairs.select("hub", "key", F.pmod(F.xxhash64("key"), F.lit(slots)).cast("int").alias("slot"))
    needed = stored(pairs.union(pairs.select("hub", F.col("hub").alias("key"), "slot").distinct()), "needed")
    rows = needed.join(sets, "key").select("hub", "slot", "key", "elements")
    dealt = rows.repartition("hub", "slot").sortWithinPartitions("hub", "slot", F.col("key") != F.col("hub"))
    return stored(dealt.mapInArrow(_compare(percent), "a bigint, b bigint"), "links")


def _across(
    pairs: DataFrame,
    groups: DataFrame,
    with_key: DataFrame,
    columns: list[str],
    classes: DataFrame,
    width: float,
    block: int | None = None,
) -> DataFrame:
    """Rows hub, block, part, role, key, place and ``columns`` of ``with_key``, dealt and sorted for ``_cross``.

    The candidates of a hub outside its largest group are queries (role 0), in blocks; all its candidates (role 1)
    meet every block. The hub itself has met them all. A block holds as many queries as fit into ``_ROOM`` bytes when
    a set takes ``width`` bytes for each element of the hub (or ``block`` queries).
    """
    place = groups.select(F.col("node").alias("key"), F.col("component").alias("place"))
    family = stored(pairs.join(place, "key", "left").withColumn("place", F.coalesce("place", "key")), "family")
    sizes = family.groupBy("hub", "place").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", "place"))
    hubs = sizes.groupBy("hub").agg(F.sum("n").alias("all"), largest.alias("most")).where("all > most.n")
    held = F.lit(block) if block else F.greatest(F.floor(_ROOM / (F.col("hub_n") * width + 100)), F.lit(1))
    hubs = hubs.join(classes.select(F.col("key").alias("hub"), F.col("n").alias("hub_n")), "hub").select(
        "hub",
        F.col("most.place").alias("core"),
        F.ceil((F.col("all") - F.col("most.n")) / held).cast("int").alias("blocks"),
        F.ceil(F.col("all") / (4 * held)).cast("int").alias("parts"),
    )
    rows = family.join(stored(hubs, "hubs"), "hub")

    def slot(n: str) -> Column:
        return F.pmod(F.xxhash64("key"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    common = ("hub", "key", "place")
    asking = rows.where("place <> core").select(*common, F.lit(0).alias("role"), slot("blocks").alias("block"), every("parts").alias("part"))
    asked = rows.select(*common, F.lit(1).alias("role"), every("blocks").alias("block"), slot("parts").alias("part"))
    sent = stored(asking.unionByName(asked), "sent")
    rows = sent.join(with_key, "key").select("hub", "block", "part", "role", "key", "place", *columns)
    return rows.repartition("hub", "block", "part").sortWithinPartitions("hub", "block", "part", "role")


def linked_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    crowd: int = 3,
    salts: int = 64,
) -> DataFrame:
    """One row per document: id, n_shingles (long), component_id (smallest id that links reach).

    A document's set holds its distinct ``size``-word shingles over ASCII-lower-cased words; a shorter text is one
    shingle. Signatures that at least ``crowd`` sets of a task's chunk share are counted; the most crowded ones (at
    most 1,000 times a set's signatures) are dealt over ``salts`` slots, so no task meets all sets of one signature.
    ``crowd`` and ``salts`` place work only.
    Defined cases: texts that are null or without words have an empty set, link with nothing and are their own
    component; rows without an id get their size but no component; repeated rows and ids get equal results; other
    columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    rows = stored(docs.mapInArrow(_classes(size), f"id {kind}, n bigint, key bigint, sketch binary"), "shingles")
    known = rows.where("key is not null and id is not null")
    classes = known.groupBy("key").agg(F.min("id").alias("first_id"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    classes = stored(classes, "classes")

    with_id = docs.where("id is not null")
    counted = with_id.mapInArrow(_signatures(size, percent, crowd, frozenset(), salts), "sig bigint, n bigint")
    total = classes.count()
    crowded = counted.groupBy("sig").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1000, total // 1000))
    hot = frozenset(r["sig"] for r in crowded.collect())  # few: a set has a bounded share of its signatures here
    bucket = W.partitionBy("sig", "slot")
    sig = F.when(F.col("slot") > 0, F.col("sig")).alias("sig")
    turns = []
    for turn in (0, 1):  # even levels, then odd ones: only half of the signatures are on disk at a time
        run = _signatures(size, percent, None, hot, salts, turn)
        made = with_id.mapInArrow(run, "sig bigint, slot int, key bigint")
        lows = made.withColumn("hub", F.min("key").over(bucket))
        turns.append(stored(lows.where("key <> hub or slot > 0").select(sig, "key", "hub"), "shared"))
    shared = turns[0].union(turns[1])
    # The slots of a crowded signature have one hub in common; there is one row for each such signature.
    heads = shared.where("sig is not null").groupBy("sig").agg(F.min("key").alias("head"))
    crowds = shared.where("sig is not null").join(F.broadcast(heads), "sig").select(F.col("head").alias("hub"), "key")
    pairs = shared.where("sig is null").select("hub", "key").union(crowds).where("key <> hub").distinct()
    pairs = stored(pairs, "pairs")
    drawn = classes.select("key", "n", "sketch")
    of_hub = drawn.select(F.col("key").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch"))
    both = pairs.join(drawn, "key").join(of_hub, "hub").select("hub", "key", "n", "sketch", "hub_n", "hub_sketch")
    likely = stored(both.mapInArrow(_likely(percent), "hub bigint, key bigint"), "likely")
    keys = stored(likely.select("key").union(likely.select("hub")).distinct(), "keys")
    links = _star_links(likely, _sets_of(keys, with_id, classes, size), percent)
    groups = stored(components(links), "components")

    ways = "hub bigint, key bigint"
    # A hub and its candidates lie in two bands. A sketch has at most half a byte for each element of its set.
    largest = (100 / percent) ** 2
    rest = _across(pairs, groups, drawn, ["n", "sketch"], classes, largest / 2).mapInArrow(_likely_across(percent), ways)
    rest = stored(rest.distinct(), "rest")
    sets = _sets_of(stored(rest.select("key").distinct(), "keys"), with_id, classes, size)
    met = _across(rest, groups, sets, ["elements"], classes, largest * 8).mapInArrow(_cross(percent), "a bigint, b bigint")
    more = stored(met, "links")
    groups = stored(components(links.union(more)), "components")

    group = groups.select(F.col("node").alias("key"), F.col("component").alias("group"))
    whole = classes.drop("sketch").join(group, "key", "left").withColumn("group", F.coalesce("group", "key"))
    whole = stored(whole, "placed")
    least = stored(whole.groupBy("group").agg(F.min("first_id").alias("component_id")), "least")
    named = stored(whole.join(least, "group").select("key", "component_id"), "named")
    found = rows.drop("sketch").join(named, "key", "left")
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
    )
