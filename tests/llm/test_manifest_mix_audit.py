"""Merkle manifest, source mixing and filter audit against brute force, with nulls, repeats, ties and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tileflow.llm import filter_audit, merkle, mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, root string, row string, part string"


def make_rows():
    rng = random.Random(5)
    words = "The of and IN to a house tree river stone light cloud seven green".split()
    rows = []
    for k in range(150):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 400])))
        lang = rng.choice(["en", "en", "en", "de", None])
        rows.append((k, rng.choice([text, text, None, "same text", " \t\x0b"]), lang, rng.choice(["b", "a", "ü", "b", None]), len(text)))
    rows += [(7, "one id, two texts", "en", "a", 3), (None, "no id # here", "en", None, None), (None, None, None, None, None)]
    rows += [rows[3], rows[3], (500, "LONG " * 30000, "fr", "d", 9)]
    rng.shuffle(rows)
    return [(*r, "r", "w", "p") for r in rows]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest


def record(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def want_proofs(leaves, fanout):
    """(part, id, leaf) -> subroot, root, siblings, root folded from a changed leaf."""

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            first = i // fanout * fanout
            yield level[first:i], level[i + 1 : first + fanout]
            i //= fanout

    parts = defaultdict(list)
    for x in leaves:
        parts[x[0]].append(x)
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {}
    for p in order:
        parts[p].sort(key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        trees[p] = tree([x[2] for x in parts[p]])
    top = tree([trees[p][-1][0] for p in order])
    out = []
    for k, p in enumerate(order):
        for i, x in enumerate(parts[p]):
            steps = [*path(trees[p], i), *path(top, k)]
            node = "changed"
            for before, after in steps:
                node = sha("".join([*before, node, *after]))
            out.append((*x, trees[p][-1][0], top[-1][0], "".join("".join(a + b) for a, b in steps), node))
    return sorted(map(str, out))


@pytest.mark.parametrize("fanout,levels", [(2, 1), (3, 2), (8, 4)])
def test_merkle(docs, fanout, levels):
    leaf = merkle.record_digest([F.col(c) for c in ("doc_id", "lang", "text")])
    leaves = docs.select("doc_id", "lang", leaf.alias("leaf"), "root", "part")
    got = merkle.merkle_proofs(leaves, fanout=fanout, block_levels=levels)
    assert got.columns == ["doc_id", "lang", "leaf", "part", "subroot", "root", "proof"]
    folds = merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")
    changed = merkle.fold(F.lit("changed"), F.col("proof"))
    rows = got.select("lang", "doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("proof")), changed, folds).collect()
    assert all(r[-1] for r in rows)
    want = want_proofs([(r[2], r[0], record(r[0], r[2], r[1])) for r in ROWS], fanout)
    assert sorted(str(tuple(r)[:-1]) for r in rows) == want


def test_merkle_of_many_blocks_and_parts(spark):
    """More rounds than one, and more parts than fit under one node."""
    leaves = spark.range(700).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 500, F.lit("big")).otherwise(F.concat(F.lit("p"), F.col("id") % 20)).alias("lang"),
        merkle.record_digest([F.col("id")]).alias("leaf"),
    )
    got = merkle.merkle_proofs(leaves, fanout=3, block_levels=1)
    changed = merkle.fold(F.lit("changed"), F.col("proof"))
    rows = got.select("lang", "doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("proof")), changed).collect()
    want = [("big" if i < 500 else f"p{i % 20}", i, record(i)) for i in range(700)]
    assert sorted(str(tuple(r)) for r in rows) == want_proofs(want, 3)


def test_merkle_of_nothing_and_of_one(spark, none):
    assert not merkle.merkle_proofs(none.select("doc_id", "lang", F.lit("x").alias("leaf"))).collect()
    one = merkle.merkle_proofs(spark.createDataFrame([(None, None, "x")], "doc_id bigint, lang string, leaf string"))
    assert [tuple(r) for r in one.collect()] == [(None, None, "x", "x", "x", [])]


# mixing


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def highest(weights, seats):
    """Seats by highest quotients, ties to the first."""
    quotients = [(-w / (2 * k + 1), i) for i, w in enumerate(weights) if w for k in range(seats + 1)]
    return Counter(i for _, i in sorted(quotients)[:seats])


def test_apportion(spark):
    weights = [[5.0, 3.0, 1.0, 1.0], [10.0] * 7, [1.0, 0.0, 999.0], [0.1] * 3 + [50.0], [3.0, 1.0, 1.0, 1.0, 1.0, 1.0]]
    groups = [(ws, seats) for ws in weights for seats in (0, 1, 2, 10, 101)]
    rows = [(g, i, w, seats) for g, (ws, seats) in enumerate(groups) for i, w in enumerate(ws)]
    cells = spark.createDataFrame(rows, "g int, i bigint, w double, seats bigint")
    got = {(r.g, r.i): r.quota for r in mixing.apportion(cells, "g", "i", "w", "seats").collect()}
    for g, (ws, seats) in enumerate(groups):
        want = highest(ws, seats)
        assert [got[g, i] for i in range(len(ws))] == [want[i] for i in range(len(ws))]


def want_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] for s in full}
        target |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("options", [{"block": 4, "shard": 50}, {"seed": 3, "weights": (1,), "share": 0.3}, {"share": 2.0}])
def test_mixing(docs, options):
    got = mixing.mix_sources(docs, **options)
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "passes", "spans", "taken"]
    rows = got.collect()
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((r[0], r[3], len(split(r[1]))) for r in ROWS)
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.passes * r.size + sum(s.length for s in r.spans)
        ends = [0] + [s.start + s.length for s in r.spans]
        assert all(a <= s.start and s.length > 0 for a, s in zip(ends, r.spans)) and ends[-1] <= r.size
    want = want_targets(sizes, options.get("weights", (5, 2, 1)), options.get("share", 1.5), 2)
    block, shard = options.get("block", 16), options.get("shard", 1 << 22)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= block * (1 + math.ceil(sizes[s] / shard))
    again = mixing.mix_sources(docs.repartition(7), **options).collect()
    assert Counter(map(str, again)) == Counter(map(str, rows))


def test_mixed_text(docs):
    mixed = mixing.mix_sources(docs.where("doc_id > 20"), block=4)
    texts = docs.select("doc_id", "text").where("doc_id > 20").join(mixed, "doc_id")
    taken = texts.withColumn("mixed", mixing.taken_text(F.col("text"), F.col("passes"), F.col("spans"))).collect()
    assert any(r.spans for r in taken) and any(r.passes for r in taken)
    for r in taken:
        words = split(r.text)
        want = words * r.passes + [w for s in r.spans for w in words[s.start : s.start + s.length]]
        assert r.mixed == " ".join(want) and len(want) == r.taken


def test_mixing_without_words(spark, none):
    assert not mixing.mix_sources(none).collect()
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert sorted(tuple(r) for r in mixing.mix_sources(blank).select("doc_id", "size", "target", "taken").collect()) == [
        (1, 0, 0.0, 0),
        (2, 0, 0.0, 0),
    ]


# filter audit


def filters():
    return {"A": F.size("words") < 20, "B": F.col("text").rlike("IN"), "D": F.col("text").rlike("[#r]")}


def want_audit(rows, labels):
    names = "ABDE"
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    judged = []
    for r in rows:
        text = r[1] or ""
        fails = {"A": len(split(text)) < 20, "B": "IN" in text, "D": bool(re.search("[#r]", text))}
        fails["E"] = r[0] is not None and first[text] < r[0]
        judged.append((r[2] or "", {f for f in names if fails[f]}, r[0] in good, r[0] in toxic))
    out = []
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        removed = {}
        lines = []
        for order in permutations(names):
            left = own
            for k, f in enumerate(order):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                redundant = sum(f in j[1] and bool(j[1] & set(order[:k])) for j in own)
                lone = sum(j[1] == {f} for j in own)
                removed[f] = removed.get(f, 0) + len(gone)
                counts = [len(left), len(gone), redundant, lone, sum(j[2] for j in gone), sum(j[3] for j in gone)]
                lines.append((part, "".join(order), k + 1, *counts, f))
        out += [(*line[:-1], removed[line[-1]]) for line in lines]
    return sorted(out)


def test_filter_audit(spark, docs):
    rng = random.Random(2)
    marks = [(k, rng.randint(0, 1), rng.choice([0, 1, None])) for k in range(0, 150, 2)]
    marks += [(8, 1, 0), (8, 0, 1), (None, 1, 1), (9999, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit_filters(docs, labels, filters(), repeated="E")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == want_audit(ROWS, marks)


def test_filter_audit_of_nothing(docs, none):
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert not filter_audit.audit_filters(none, labels, filters(), repeated="E").collect()
    passed = filter_audit.audit_filters(docs, labels.limit(0), {"A": F.lit(False), "B": F.lit(None).cast("boolean")})
    assert {(r.removed, r.redundant, r.shapley) for r in passed.collect()} == {(0, 0, 0)}
