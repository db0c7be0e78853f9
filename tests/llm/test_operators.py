"""The text operators on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

import corpus_pipeline
from tileflow.llm import (
    bpe,
    components,
    exact_dedup,
    jaccard_join,
    language_id,
    lm_scoring,
    packing,
    queries,
    substring_dedup,
    token_counts,
    url_filter,
    winnowing,
)

FILE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, row string, key bigint"


def prose(rng, n, words="the of and in to a house tree river stone light cloud seven green".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


def make_rows():
    rng = random.Random(11)
    base = prose(rng, 120)
    edit = base.split()
    edit[60] = "changed"
    texts = {
        1: "Same Text",
        2: "same text",
        3: "SAME TEXT",
        4: "sáme text",
        5: None,
        6: "",
        7: "   ",
        8: base,
        9: " ".join(edit),
        10: base.upper(),
        11: prose(rng, 6000),
        12: prose(rng, 60) + " " + base[:400],
        13: "one two",
        14: "one two",
        15: "!!! 123 ...",
        16: prose(rng, 300),
        17: ("line of a poem that comes again and again and never seems to end here\n") * 12,
        18: "x" * 4000,
        19: prose(rng, 90) + "\t\x0b" + prose(rng, 40),
    }
    rows = [(k, t, ["en", "de", None][k % 3], "s", len(t or ""), True, "r", k) for k, t in texts.items()]
    rows += [(None, "no id here", "en", None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [rows[12], rows[12]]  # a row that repeats
    rng.shuffle(rows)
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def grouped(ids, links):
    """Smallest id of each id's group."""
    head = {i: i for i in ids}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# exact dedup


def want_groups(rows, keep):
    groups = defaultdict(list)
    for r in rows:
        groups[ascii_lower(r[1])].append(r[0])
    out = []
    for r in rows:
        ids = groups[ascii_lower(r[1])]
        known = [i for i in ids if i is not None]
        best = keep(known) if known else None
        out.append((r[0], r[1], best, len(ids), r[0] == best))
    return sorted(map(str, out))


@pytest.mark.parametrize("keep,best", [("smallest", min), ("largest", max)])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, keep, best, weak):
    """With a weak hash texts collide, and the comparison of bytes has to part them."""
    options = {"hashed": lambda t: F.substring(t, 1, 1).cast("binary")} if weak else {}
    got = exact_dedup.duplicate_groups(docs, keep=keep, **options)
    assert [c for c in got.columns if c not in SCHEMA] == ["keep_id", "group_size", "text_hash"]
    found = [(r.doc_id, r.text, r.keep_id, r.group_size, r.kept) for r in got.collect()]
    assert sorted(map(str, found)) == want_groups(ROWS, best)


def test_drop_copies_keeps_rows_as_they_are(docs, none):
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} >= {1, 4, 5, 8, 13, 18}
    assert not {r.doc_id for r in left.collect()} & {2, 3, 6, 10, 14}
    assert exact_dedup.drop_copies(none).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.duplicate_groups(docs, keep="any")


@pytest.mark.parametrize("weak", [False, True])
def test_one_row_stays_of_copies_that_tie(spark, weak):
    """Copies under one id, without ids and in other letters; with a weak hash they collide with other texts."""
    options = {"hashed": lambda t: F.substring(t, 1, 1).cast("binary")} if weak else {}
    rows = [(1, "a row twice"), (1, "a row twice"), (2, "A ROW TWICE"), (None, "a row twice"), (None, "a null"), (None, "A null")]
    rows += [(None, None), (None, ""), (3, "alone"), (1, "another text"), (None, "a lone null")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    left = Counter((r.doc_id, ascii_lower(r.text)) for r in exact_dedup.drop_copies(frame, **options).collect())
    want = [(1, "a row twice"), (None, "a null"), (None, ""), (3, "alone"), (1, "another text"), (None, "a lone null")]
    assert left == Counter(want)


# winnowing


def test_fingerprints(docs, none):
    got = winnowing.fingerprints(docs, gram=8, window=8)
    assert got.columns == [*docs.columns, "positions", "hashes"]
    by_id = {r.doc_id: r for r in got.where("doc_id is not null").collect()}
    assert by_id[5].positions == by_id[6].positions == []
    assert by_id[13].hashes == by_id[14].hashes
    at, hashes = winnowing.fingerprint(by_id[16].text, 8, 8)
    assert by_id[16].positions == at.tolist() and by_id[16].hashes == hashes.astype("int64").tolist()
    assert winnowing.fingerprints(none).count() == 0


@pytest.mark.parametrize("part_rows", [1000, 3])
def test_edited_texts(docs, none, part_rows):
    rows = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        q = len(a) // 4
        edited = a[: len(a) - q] + b[:q]
        prints = [winnowing.fingerprint(t, 16, 24) for t in (a, edited, b)]
        near = [round(winnowing.likeness(prints[0][1], p[1]), 9) for p in prints[1:]]
        want.append((i, len(a), sha(edited), winnowing.written(*prints[0]), winnowing.written(*prints[1]), *near))
    got = winnowing.edit_report(docs, part_rows=part_rows).collect()
    found = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in got]
    assert sorted(map(str, found)) == sorted(map(str, want))
    assert winnowing.edit_report(none).count() == 0
    alone = winnowing.edit_report(docs.where("doc_id = 16")).first()
    assert alone.near_next == 1.0


# similarity join


def sets_of(text, size):
    w = split(ascii_lower(text))
    if not w:
        return set()
    return {" ".join(w)} if len(w) < size else {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)}


def want_components(rows, size, percent):
    sets = {r[0]: sets_of(r[1], size) for r in rows if r[0] is not None}
    ids = sorted(sets)
    links = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    head = grouped(ids, links)
    return {i: (len(sets[i]), head[i]) for i in ids}


@pytest.mark.parametrize("size,percent", [(5, 80), (2, 50)])
def test_linked_groups(docs, none, size, percent):
    got = jaccard_join.linked_groups(docs, size=size, percent=percent).collect()
    assert len(got) == len(ROWS)
    want = want_components(ROWS, size, percent)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert jaccard_join.linked_groups(none).count() == 0


def test_linked_groups_of_a_large_family(spark, monkeypatch):
    """Many versions of one text: some link with few others only, and not with the hub of their buckets."""
    rng = random.Random(12)
    base = prose(rng, 150, [f"w{i}" for i in range(900)]).split()
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(rng, rng.randrange(3, 80))) for i in range(60)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = want_components([(i, t) for i, t in rows], 4, 85)
    assert len({c for _, c in want.values()}) > 70
    across = jaccard_join._across
    monkeypatch.setattr(jaccard_join, "_across", lambda *a: across(*a, block=7))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_groups(frame, size=4, percent=85).collect()}
    assert got == want


def test_crowded_signatures_are_spread(spark, monkeypatch):
    rng = random.Random(13)
    base = prose(rng, 100, [f"w{i}" for i in range(500)]).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[i] = "changed"
        rows.append((i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(jaccard_join, "max", lambda *a: 20, raising=False)
    got = {r.doc_id: r.component_id for r in jaccard_join.linked_groups(frame, size=4, percent=85, crowd=2, salts=4).collect()}
    assert got == {i: 0 for i in range(60)}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (3, None)]
    links += [(129, 40), (5, 6), (6, 5)]
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint"))
    found = {r.node: r.component for r in got.collect()}
    known = [(a, b) for a, b in links if a is not None and b is not None]
    assert found == grouped({i for pair in known for i in pair}, known)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# packing, encoding, counting


def test_packing(docs, none):
    library = Tokenizer.from_file(FILE)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 1]
    got = packing.pack_documents(docs, FILE, capacity=256, shard_rows=4).collect()
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)
    want = Counter()
    for row in ROWS:
        t = ids(row[1])
        for a, n in packing.cut(len(t), 256):
            data = b"".join(i.to_bytes(4, "little") for i in t[a : a + n])
            want[row[0], a, n, zlib.crc32(data), len(t)] += 1
    assert pieces == want
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for places in windows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    again = packing.pack_documents(docs.repartition(5), FILE, capacity=256, shard_rows=4).collect()
    assert Counter((r.doc_id, r.start, r.sequence_id, r.offset) for r in again if r.doc_id not in (None, 13)) == Counter(
        (r.doc_id, r.start, r.sequence_id, r.offset) for r in got if r.doc_id not in (None, 13)
    )
    assert packing.pack_documents(none, FILE).count() == 0


def test_round_trip_and_counts(docs, none):
    library = Tokenizer.from_file(FILE)
    got = Counter((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in bpe.round_trip(docs, FILE).collect())
    want = Counter()
    for row in ROWS:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        want[row[0], len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    assert bpe.round_trip(none, FILE).count() == 0
    vocabulary = bpe.Vocabulary.read(FILE)
    splitter, match, table = bpe.Splitter(vocabulary), token_counts.automaton(vocabulary), bpe.byte_symbols()
    counts = {r.doc_id: (r.n_words, r.n_pieces) for r in token_counts.piece_counts(docs, FILE).collect()}
    for row in ROWS:
        if row[0] is not None:
            words = [w for p in splitter.pieces(row[1] or "") for w in splitter.words(p)]
            symbols = [token_counts.word_symbols(w, table) for w in words]
            assert counts[row[0]] == (len(words), sum(map(match.count, symbols)))
    assert token_counts.piece_counts(none, FILE).count() == 0


def test_separators_are_not_white_space(spark):
    """Python calls U+001C to U+001F space, the pattern does not."""
    library = Tokenizer.from_file(FILE)
    texts = ["\x1c", " \x1d\x1e ", "\x1f\n", " \t\n", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in bpe.round_trip(frame, FILE).collect()}
    packed = {r.doc_id: r.doc_tokens for r in packing.pack_documents(frame, FILE).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i] == " ".join(map(str, ids)) and packed[i] == len(ids) + 1


# passages


def want_kept(texts, window):
    words = [split(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("window,gram,most", [(35, 12, 256), (10, 4, 1), (8, 8, 0)])
def test_remove_repeats(docs, none, window, gram, most):
    got = substring_dedup.remove_repeats(docs.drop("kept"), window=window, gram=gram, most=most)
    assert got.columns == [*docs.drop("kept").columns, "n_words", "n_removed", "kept"]
    found = sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in got.collect())
    want = zip([r[0] for r in ROWS], want_kept([r[1] for r in ROWS], window))
    assert found == sorted(str((i, *w)) for i, w in want)
    assert substring_dedup.remove_repeats(none, window=window, gram=gram, most=most).count() == 0


def test_common_passage_in_ever_new_surroundings(spark):
    rng = random.Random(14)
    many = [f"w{i}" for i in range(5000)]
    passage = prose(rng, 50, many)
    texts = [prose(rng, rng.randrange(60), many) + " " + passage + " " + prose(rng, rng.randrange(60), many) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want = want_kept(texts, 35)
    for most in (5, 1000):
        got = substring_dedup.remove_repeats(frame, window=35, most=most).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == dict(enumerate(want))
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(frame, window=100, gram=10)


# language


def test_identify(docs, none, spark):
    got = language_id.identify(docs, training=F.lit(True))
    assert got.columns == [*docs.columns, "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        letters = re.search(r"[^\W\d_]", r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        assert (r.score == 0.0) if not letters else 0 < r.score <= 1
    assert language_id.identify(none, training=F.lit(True)).count() == 0
    unlearned = language_id.identify(docs, training=F.lit(None).cast("boolean")).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in unlearned] == [("und", 0.0)]


def lettered(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_languages_of_long_texts_only_are_learned(spark):
    """One language has labelled books only, one of them with its letters far from most places."""
    rng = random.Random(22)
    rows = [(i, lettered(rng, "abcdef", 60), "aa") for i in range(12)]
    rows += [(100 + i, lettered(rng, "uvwxyz", 4000), "zz") for i in range(4)]
    rows += [(200, "1 " * 90_000 + lettered(rng, "uvwxyz", 300), "zz"), (201, lettered(rng, "uvwxyz", 40), None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(frame, training=F.lit(True)).collect()}
    assert got == {i: "aa" if i < 100 else "zz" for i, _, _ in rows}
    books = language_id.identify(frame.where("doc_id >= 100"), training=F.lit(True))
    assert {r.lang_pred for r in books.collect()} == {"zz"}


def test_pipeline_keeps_texts_when_nothing_is_labelled(spark):
    rows = [(1, "clean words of some text", None), (2, "12 34 !", None), (3, None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert [tuple(r) for r in corpus_pipeline.language(spark, frame, "").collect()] == rows[:1]


def test_held_out_accuracy(spark):
    rows = queries.QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = rows.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


# language model


@pytest.mark.parametrize("frequent", [131072, 5, 0])
def test_scores(docs, none, frequent):
    training = F.col("doc_id") % 3 != 0
    got = lm_scoring.score_texts(docs, training, classes=16, forms=7, frequent=frequent).collect()
    tokens = [[*split(ascii_lower(r[1])), None] for r in ROWS]
    trained = [r[0] is not None and r[0] % 3 != 0 for r in ROWS]
    c = Counter(w for t, ok in zip(tokens, trained) if ok for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r, t, ok in zip(ROWS, tokens, trained):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        want[r[0], ok, len(t), sum(c[w] > 0 for w in t), n, f"{base:.5f}"] += 1
    assert Counter((*r[:5], f"{r.base_score:.5f}") for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm_scoring.score_texts(none, training).count() == 0


def test_scores_do_not_depend_on_what_is_sent(docs):
    """The classes take the most frequent words, so the bound has to leave those in; the rest is only looked up elsewhere."""
    training = F.lit(True)
    runs = [
        {(r.doc_id, r.n_tokens): round(r.score, 6) for r in lm_scoring.score_texts(docs, training, classes=10, forms=7, frequent=k).collect()}
        for k in (131072, 40)
    ]
    assert runs[0] == runs[1]


def want_scores(rows, classes, forms, discount=0.75, alpha=1.0):
    """Scores of texts under the model of these texts, word by word."""
    words = [split(ascii_lower(t)) for t in rows]
    number = {}
    for w in {w for t in words for w in t}:
        cut = lm_scoring.Words(lm_scoring.Texts(lm_scoring.pa.array([w])), lower=True)
        number[w] = int(lm_scoring.signed(cut.hashes())[0]), int(lm_scoring.endings(cut, forms)[0])
    n = Counter(w for t in words for w in t)
    own = sorted(n, key=lambda w: (-n[w], number[w][0]))[: classes - 1 - forms]
    low = classes - 1 - forms
    klass = {w: own.index(w) if w in own else low + number[w][1] for w in n} | {None: classes - 1}
    sizes, kinds = Counter(), Counter()
    for w in n:
        sizes[klass[w]] += n[w]
        kinds[klass[w]] += 1
    inner = {w: 1.0 if w in own else (n[w] + alpha) / (sizes[klass[w]] + alpha * (kinds[klass[w]] + 1)) for w in n} | {None: 1.0}
    grams = [list(zip([None, None, *t], [None, *t, None][: len(t) + 1], [*t, None])) for t in words]

    def chain(lists, bottom):
        c3 = Counter(g for line in lists for g in line)
        c2, after2, after1, kinds2, kinds1 = Counter(), Counter(), Counter(), Counter(), Counter()
        for (u, v, w), k in c3.items():
            c2[v, w] += k
            after2[u, v] += k
            kinds2[u, v] += 1
        for (v, w), k in c2.items():
            after1[v] += k
            kinds1[v] += 1

        def p(u, v, w):
            one = max(c2[v, w] - discount, 0) / after1[v] + discount * kinds1[v] / after1[v] * bottom(u, v, w)
            return max(c3[u, v, w] - discount, 0) / after2[u, v] + discount * kinds2[u, v] / after2[u, v] * one

        return p

    classed = [[tuple(klass[x] for x in g) for g in line] for line in grams]
    c1 = Counter(g[2] for line in classed for g in line)
    outer = chain(classed, lambda u, v, w: (c1[w] + 1) / (sum(c1.values()) + classes))
    whole = chain(grams, lambda u, v, w: outer(klass[u], klass[v], klass[w]) * inner[w])
    return [sum(math.log10(whole(*g)) for g in line) for line in grams]


def test_scores_count_word_pairs_and_triples(spark):
    """Texts that exchange two rare words of one ending differ; scores are those of a plain computation."""
    rng = random.Random(23)
    rows = [prose(rng, rng.randrange(1, 60)) for _ in range(30)] + ["", "the greyling and the yearling met", "the yearling and the greyling met"]
    rows += ["one greyling and the yearling"] * 3
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)
    for frequent in (131072, 0):
        got = {r.doc_id: r.score for r in lm_scoring.score_texts(frame, F.lit(True), classes=12, forms=7, frequent=frequent).collect()}
        for i, want in enumerate(want_scores(rows, 12, 7)):
            assert got[i] == pytest.approx(want, abs=1e-6)
    held = frame.where("doc_id in (31, 32)")
    both = frame.where("doc_id > 32").unionAll(held)
    got = {r.doc_id: r.score for r in lm_scoring.score_texts(both, F.col("doc_id") > 32, classes=12, forms=11).collect()}
    assert abs(got[31] - got[32]) > 0.01


@pytest.mark.parametrize("held", [3, 40, 400])
def test_scores_do_not_depend_on_shards(spark, held):
    """Small shards crowd their words: the pairs behind these are counted apart, and places are read in many runs."""
    rng = random.Random(29)
    rows = [prose(rng, rng.randrange(1, 60)) for _ in range(20)] + ["", "", "of the " * 40, "the yearling of the greyling"]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)
    for frequent in (131072, 0):
        got = lm_scoring.score_texts(frame, F.col("doc_id") != 23, classes=12, forms=7, frequent=frequent).collect()
        cut = lm_scoring.score_texts(frame, F.col("doc_id") != 23, classes=12, forms=7, frequent=frequent, held=held).collect()
        cut = {r.doc_id: r for r in cut}
        for r in got:
            assert r[:5] == cut[r.doc_id][:5] and r[5:] == pytest.approx(cut[r.doc_id][5:], abs=1e-9)
    got = {r.doc_id: r.score for r in lm_scoring.score_texts(frame, F.lit(True), classes=12, forms=7, held=held).collect()}
    for i, want in enumerate(want_scores(rows, 12, 7)):
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_scores_without_training(docs):
    rows = lm_scoring.score_texts(docs, F.lit(False)).collect()
    assert len(rows) == len(ROWS) and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in rows)


# urls


def test_url_rules_and_odd_urls(spark):
    urls = [
        ("http://Example.COM/en/x?y#z", "example.com", "/en/x", "example.com/en/", "block"),
        ("https://www.example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("https://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://other.com/", "other.com", "/", "com/", "allow"),
        ("https://other.com", "other.com", "", None, None),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("ftp://a.net/es/q", "a.net", "/es/q", "net/es/", "block"),
        ("a.net/es/q", "", "", None, None),
        ("x?://y.net#/es/", "y.net", "", None, None),
        ("http://a.net/ES/", "a.net", "/ES/", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
        ("http://a.org/" + "q" * 3000, "a.org", "/" + "q" * 3000, None, None),
    ]
    rows = [(i, u[0], "clash") for i, u in enumerate(urls)] + [(None, urls[0][0], None), (0, urls[0][0], "clash")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule string")
    got = url_filter.judge_urls(pages, queries.URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        url, host, path, rule, verdict = urls[r.page_id or 0]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert len({r.verdict for r in got if r.page_id in (10, 11)}) == 1
    assert url_filter.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0
    unruled = url_filter.judge_urls(pages, []).select("verdict", "score").distinct().collect()
    assert [tuple(r) for r in unruled] == [("allow", 0.0)]


def test_url_models_tell_the_sides_apart(spark):
    rng = random.Random(15)
    good = [f"http://{rng.choice(['news', 'blog'])}{i}.com/story/{rng.randrange(99)}" for i in range(60)]
    bad = [f"http://win{i}-casino.net/es/bonus{rng.randrange(99)}" for i in range(60)]
    new = ["http://news7.org/story/5", "http://win3-casino.org/bonus8"]
    frame = spark.createDataFrame(list(enumerate(good + bad + new)), "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(frame, queries.URL_RULES).collect()}
    assert (got[120], got[121]) == ("allow", "block")


# pipeline


def test_pipeline_on_odd_rows(docs, none):
    documents = docs.drop("kept", "row", "key")
    for frame in (documents, none.drop("kept", "row", "key")):
        made, columns = frame, frame.columns
        for name, stage in corpus_pipeline.STAGES:
            made = stage(frame.sparkSession, made, "")
            if name != "packing":
                assert made.columns == columns
            made = corpus_pipeline.stored(made, name)
        if frame is documents:
            ids = {r.doc_id for r in made.collect()}
            assert not ids & {2, 3, 5, 6, 7, 9, 10, 14, 15} and ids >= {1, 4, 8, 11, 13, 16, 17}
        else:
            assert made.count() == 0


def test_pipeline_keeps_one_whole_row_of_repeated_rows(spark):
    rng = random.Random(21)
    many = [f"{a}{b}" for a in ("stone", "river", "light", "cloud", "house") for b in "abcdefghijklmnopqrstuvw"]
    twice, nameless, other = (prose(rng, 200, many) for _ in range(3))
    rows = [(1, twice, "en")] * 3 + [(None, nameless, "en")] * 2 + [(2, other, "en")]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = corpus_pipeline.stored(stage(spark, made, ""), name)
    assert Counter(map(tuple, made.collect())) == Counter(rows[2:4] + rows[5:])
    packed = corpus_pipeline.packing(spark, made, "").collect()
    assert sorted(str(r.doc_id) for r in packed) == ["1", "2", "None"] and min(r.doc_tokens for r in packed) > 200


def test_pipeline_leaves_clean_texts_alone(spark):
    made = frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = made
        made = corpus_pipeline.stored(stage(spark, made, ""), name)
        assert made.schema == StructType(before.schema.fields) or made.columns == frame.columns
        changed = made.join(before.select("doc_id", F.col("text").alias("old")), "doc_id").where("text <> old")
        if name != "substring_dedup":
            assert changed.count() == 0
    want = dict(zip([r.doc_id for r in before.collect()], want_kept([r.text for r in before.collect()], 35)))
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in made.collect():
        assert r.text == (want[r.doc_id][2] if want[r.doc_id][1] else texts[r.doc_id])


def test_pipeline_drops_rows_not_ids(spark):
    """A near copy goes, and another text that shares its id, or has no id either, stays."""
    rng = random.Random(22)
    many = [f"{a}{b}" for a in ("stone", "river", "light", "cloud", "house") for b in "abcdefghijklmnopqrstuvw"]
    a, b, c = (prose(rng, 150, many) for _ in range(3))
    rows = [(1, a, "en"), (2, a + " end", "en"), (2, b, "en"), (None, a + " last", "en"), (None, c, "en"), (3, None, "en")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    made = corpus_pipeline.near_copies(spark, frame, "")
    assert Counter(map(tuple, made.collect())) == Counter([rows[0], rows[2], rows[4], rows[5]])


def test_pipeline_keeps_a_text_of_several_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    some = docs.where("lang is not null and n_chars > 1500").orderBy("doc_id").collect()
    words = {r.lang: r.text.split()[:60] for r in some}
    assert len(words) >= 3
    row = some[0].asDict() | {"doc_id": -1, "text": " ".join(w for ws in words.values() for w in ws)}
    frame = docs.limit(400).unionByName(spark.createDataFrame([row], docs.schema))
    assert corpus_pipeline.language(spark, frame, "").where("doc_id = -1").count() == 1


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_drop_copies_of_rows_that_repeat(spark, keep, weak):
    rows = [(1, "A b", 1), (1, "a B", 2), (1, "A b", 1), (2, "a b", 1), (None, "a b", 3), (None, "c", 1), (None, "c", 1), (5, None, 1), (6, "", 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, hash int").repartition(3)
    options = {"hashed": lambda t: F.substring(t, 1, 0).cast("binary")} if weak else {}
    got = [tuple(r) for r in exact_dedup.drop_copies(frame, keep=keep, **options).collect()]
    assert Counter(ascii_lower(r[1]) for r in got) == {"a b": 1, "c": 1, "": 1} and set(got) <= set(rows)
    assert {ascii_lower(r[1]): r[0] for r in got} == {"a b": 1 if keep == "smallest" else 2, "c": None, "": 5 if keep == "smallest" else 6}


def test_packing_of_rows_that_nothing_tells_apart(spark):
    """Rows without an id, or repeated as a whole, are spread over shards, and all windows stay gapless."""
    rows = [(None, "same words here") for _ in range(300)] + [(None, f"other {k}") for k in range(100)] + [(7, "x")] * 200
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = packing.pack_documents(frame, FILE, capacity=64, shard_rows=20).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in got)[7, 2] == 200 and len(got) == 600
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in w) <= 64 and sorted(a for a, _ in w) == [sum(n for _, n in sorted(w)[:i]) for i in range(len(w))] for w in windows.values())
    shards = Counter(r.sequence_id >> 24 for r in got)
    assert len(shards) > 20 and max(shards.values()) < 80
