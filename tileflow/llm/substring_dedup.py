"""Removal of word passages that occur more than once, by suffix automata over shards of suspected passages.

1. In every window of ``window`` words the smallest ``gram``-word hash is its anchor (equal windows have equal
   anchors). Neighbouring windows with one anchor form a segment; each window lies in exactly one segment. Anchors
   are counted over all texts, and only segments whose anchor occurs elsewhere go on: nothing else can repeat.
2. If all segments of an anchor are equal, each of their windows repeats. Otherwise one of each different segment
   is fetched with its words. The segments of an anchor are a shard of references: a suffix automaton holds them
   with the number of their places, and each segment is streamed through it for matching statistics, the longest
   passage ending at each word that has another place. An anchor with more than ``most`` different segments
   (a common passage in ever new surroundings) would make a shard without bound; its windows are counted by
   128-bit hash instead, with the same result.
3. Each document meets its own spans once more and loses the words under them.

An automaton of the whole corpus cannot be broadcast, and every document against every shard would be a product of
the two; anchors route each segment to the one shard that can hold its copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tileflow.llm.automaton import SuffixAutomaton
from tileflow.llm.folders import stored
from tileflow.llm.words import U64, Texts, Words, mix, parts, powers, ranges, signed, sliding_argmin, windows

_ODD = 0xD6E8FEB86659FD93


def segments(words: Words, window: int, gram: int) -> dict[str, np.ndarray]:
    """Segments of all texts: text, start (word in the text), run (windows), anchor and whole (64-bit hashes)."""
    h = words.hashes()
    grams = windows(h, gram)
    anchors = sliding_argmin(grams, window - gram + 1)
    n = np.maximum(words.counts() - window + 1, 0)
    at = ranges(words.first[:-1], n)  # first words of all windows
    if not len(at):
        none = np.zeros(0, np.int64)
        return {"text": none, "start": none, "run": none, "anchor": none, "whole": none}
    text = np.repeat(np.arange(len(n)), n)
    anchor = anchors[at]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(new)
    run = np.diff(np.concatenate((first, [len(at)])))
    begin, text = at[first], text[first]
    with np.errstate(over="ignore"):
        up, down = powers(_ODD, len(h)), powers(pow(_ODD, -1, 2**64), len(h))
        total = np.zeros(len(h) + 1, U64)
        np.cumsum(h * up, out=total[1:])
        end = begin + run + window - 1
        whole = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(U64))
    return {
        "text": text,
        "start": begin - words.first[text],
        "run": run,
        "anchor": signed(grams[anchor[first]]),
        "whole": signed(whole),
    }


def _scan(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text", 2 << 20):
            found = segments(Words(Texts(batch.column(1))), window, gram)
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict(
                {
                    "key": keys[found["text"]],
                    "start": found["start"].astype(np.int32),
                    "run": found["run"].astype(np.int32),
                    "anchor": found["anchor"],
                    "whole": found["whole"],
                }
            )

    return run


def _fetch(window: int):
    """Rows of one text and the list of its wanted segments -> a row per segment with its words, one space apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text", 2 << 20):
            words = Words(Texts(batch.column(0)))
            raw = words.data.tobytes()
            out: dict[str, list] = {"key": [], "start": [], "run": [], "anchor": [], "copies": [], "words": []}
            for i, wanted in enumerate(batch.column(1).to_pylist()):
                first = words.first[i]
                for s in wanted:
                    lo = first + s["start"]
                    hi = lo + s["run"] + window - 1
                    if hi > words.first[i + 1]:
                        continue
                    for c in ("key", "start", "run", "anchor", "copies"):
                        out[c].append(s[c])
                    out["words"].append(b" ".join([raw[a:b] for a, b in zip(words.start[lo:hi], words.end[lo:hi])]))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return run


_FOUND = "key bigint, start int, mask bigint"


def _found(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    keys, starts, masks = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict(
        {"key": pa.array(keys, pa.int64()), "start": pa.array(starts, pa.int32()), "mask": pa.array(masks, pa.int64())}
    )


def repeated_windows(shard: list[tuple[bytes, int]], window: int) -> list[int]:
    """For each (words, copies) of a shard a bit mask: bit j says that the window from word j has another place."""
    automaton = SuffixAutomaton()
    split = [w.split(b" ") for w, _ in shard]
    for words, (_, copies) in zip(split, shard):
        automaton.add(words, copies)
    automaton.total()
    out = []
    for words in split:
        mask = 0
        for end, size in enumerate(automaton.matches(words, times=2)):
            if size >= window:
                mask |= 1 << (end - window + 1)
        out.append(mask)
    return out


def _match(window: int):
    """Rows key, start, anchor, copies, words in order of the anchor -> masks of single segments with a repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5))))
        out = []
        for _, group in groupby(rows, key=lambda r: r[2]):
            shard = list({r[:2]: r for r in group}.values())  # repeated rows fetch a segment repeatedly
            masks = repeated_windows([(r[4], r[3]) for r in shard], window)
            out += [(r[0], r[1], mask) for r, mask in zip(shard, masks) if mask and r[3] == 1]
            if len(out) > 20_000:
                yield _found(out)
                out = []
        yield _found(out)

    return run


def _spread(window: int):
    """Rows key, start, copies, words -> a row per window: key, start, copies, place, and 128 bits of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, start, copies, words in zip(*(batch.column(i).to_pylist() for i in range(4))):
                w = words.split(b" ")
                n = len(w) - window + 1
                hashes = [hashlib.md5(b" ".join(w[j : j + window])).digest() for j in range(n)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array([key] * n, pa.int64()),
                        "start": pa.array([start] * n, pa.int32()),
                        "copies": pa.array([copies] * n, pa.int64()),
                        "place": pa.array(range(n), pa.int32()),
                        "hash": pa.array(hashes, pa.binary()),
                    }
                )

    return run


def _strip(window: int):
    """Rows of a text and its spans (start, mask) -> n_words, n_removed, kept (the kept words, one space apart)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text", 2 << 20):
            words = Words(Texts(batch.column(0)))
            covered = np.zeros(len(words) + window + 64, np.int32)  # +1 where a repeated window begins, -1 after it
            for i, spans in enumerate(batch.column(1).to_pylist()):
                for s in spans or ():
                    at, mask = words.first[i] + s["start"], s["mask"]
                    bits = np.flatnonzero([mask >> j & 1 for j in range(mask.bit_length())])
                    begin = at + bits
                    begin = begin[begin + window <= words.first[i + 1]]
                    np.add.at(covered, begin, 1)
                    np.add.at(covered, begin + window, -1)
            stay = np.cumsum(covered)[: len(words)] == 0
            raw = words.data.tobytes()
            kept = []
            for a, b in zip(words.first[:-1], words.first[1:]):
                own = np.flatnonzero(stay[a:b]) + a
                kept.append(b" ".join([raw[s:e] for s, e in zip(words.start[own].tolist(), words.end[own].tolist())]))
            n = words.counts()
            left = np.add.reduceat(np.append(stay, False).astype(np.int64), words.first[:-1]) if len(n) else n
            left = np.where(n > 0, left, 0)
            names = batch.schema.names[2:]
            yield pa.RecordBatch.from_arrays(
                [pa.array(n, pa.int64()), pa.array(n - left, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                + [batch.column(i + 2) for i in range(len(names))],
                names=["n_words", "n_removed", "kept", *names],
            )

    return run


def repeated_spans(texts: DataFrame, window: int, gram: int, most: int) -> DataFrame:
    """key, spans (start, mask): which windows of each text (key, text) repeat; bit j of a mask is the window at start + j."""
    kinds = "key bigint, start int, run int, anchor bigint, whole bigint"
    scanned = texts.mapInArrow(_scan(window, gram), kinds)
    counted = scanned.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), (F.min("whole") != F.max("whole")).alias("mixed")
    )
    shared = stored(counted.where("n > 1").select("anchor", "mixed"), "anchors")
    hits = stored(scanned.join(shared, "anchor"), "hits")
    every = F.expr("shiftleft(1L, run) - 1")
    equal = hits.where("not mixed").select("key", "start", every.alias("mask"))

    differ = hits.where("mixed")
    first = F.min_by(F.struct("key", "start", "run"), F.struct("key", "start"))
    different = stored(differ.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("copies"), first.alias("one")), "segments")
    often = stored(different.where("copies > 1").select("anchor", "whole"), "often")
    copied = differ.join(often, ["anchor", "whole"], "left_semi").select("key", "start", every.alias("mask"))
    crowd = different.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("anchor")
    crowd = stored(crowd, "crowd")
    wanted = different.select("one.*", "anchor", "copies").groupBy("key").agg(
        F.collect_list(F.struct("key", "start", "run", "anchor", "copies")).alias("wanted")  # of one text, not more than its words
    )
    fetched = texts.join(wanted, "key").select("text", "wanted").mapInArrow(
        _fetch(window), "key bigint, start int, run int, anchor bigint, copies bigint, words binary"
    )
    fetched = stored(fetched, "fetched")
    small = fetched.join(crowd, "anchor", "left_anti").select("key", "start", "anchor", "copies", "words")
    by_anchor = small.repartition("anchor").sortWithinPartitions("anchor")
    matched = by_anchor.mapInArrow(_match(window), _FOUND)
    large = fetched.join(crowd, "anchor", "left_semi").select("key", "start", "copies", "words")
    spread = stored(
        large.mapInArrow(_spread(window), "key bigint, start int, copies bigint, place int, hash binary"), "windows"
    )
    spread = spread.dropDuplicates(["key", "start", "place"])
    again = stored(spread.groupBy("hash").agg(F.sum("copies").alias("n")).where("n > 1").select("hash"), "repeats")
    bit = F.expr("shiftleft(1L, place)")
    single = spread.where("copies = 1").join(again, "hash", "left_semi")
    crowded = single.groupBy("key", "start").agg(F.bit_or(bit).alias("mask"))

    found = equal.union(copied).union(matched).union(crowded)
    return found.groupBy("key").agg(F.collect_set(F.struct("start", "mask")).alias("spans"))


def remove_repeats(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    window: int = 35,
    gram: int = 12,
    most: int = 256,
) -> DataFrame:
    """``docs`` with n_words, n_removed (long) and kept (string, the kept words one space apart) added.

    A window is ``window`` consecutive words (``[^\\x20\\x09-\\x0D]+``) of one text; every word of a window whose words
    also start anywhere else, in the same text or another one, is removed, all copies alike. ``gram`` and ``most``
    place work only; ``window - gram`` is below 62.
    Defined cases: a null text has no words; rows with equal id and text share their spans and so are removed
    alike, which makes repeated rows copies of each other; a null id is an id like others; further columns pass
    through, those called like an added column are replaced; an empty table gives an empty result.
    """
    if not 0 < gram <= window or window - gram > 61:
        raise ValueError("gram is at least 1, at most window, and window - gram at most 61")
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*[c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]).alias("row")
    key = F.xxhash64(id_col, text_col).alias("key")
    spans = repeated_spans(docs.select(key, text.alias("text")), window, gram, most)
    joined = docs.select(key, row).join(stored(spans, "spans"), "key", "left")
    joined = joined.select(F.coalesce(F.col("row").getField(text_col), F.lit("")).alias("text"), "spans", "row")
    out = StructType.fromDDL("n_words bigint, n_removed bigint, kept string").add(joined.schema["row"])
    made = joined.mapInArrow(_strip(window), out)
    return made.select("row.*", "n_words", "n_removed", "kept")
