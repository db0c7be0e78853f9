"""Parts of the text operators without Spark, against brute force."""

import random
import re
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tileflow.llm import bpe, jaccard_join, language_id, lm_scoring, packing, substring_dedup, token_counts, winnowing, words
from tileflow.llm.automaton import SuffixAutomaton

FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "   ", None, "a", "A b\tc\nd", "x" * 5000, "héé ÀÉ 日本 \x0b z", "one  two", "one two"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(FILE)


def test_words_and_hashes():
    found = words.Words(words.Texts(pa.array(ODD)), lower=True)
    raw = found.data.tobytes()
    got = [raw[a:b].decode() for a, b in zip(found.start, found.end)]
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in ODD]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in lower]
    assert got == [w for ws in want for w in ws]
    assert found.counts().tolist() == [len(w) for w in want]
    by_hash = {}
    for word, h in zip(got, found.hashes().tolist()):
        assert by_hash.setdefault(h, word) == word
    assert len(by_hash) == len(set(got))


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = words.Texts(pa.array(["alpha beta gamma " * 50, "beta " * 30]))
    whole = words.Words(texts).hashes()
    monkeypatch.setattr(words, "_BLOCK", 16)
    assert (words.Words(texts).hashes() == whole).all()


def test_sliced_arrays_and_parts():
    column = pa.array(["aa", None, "b c", "d", ""])
    assert words.Words(words.Texts(column.slice(2, 2))).counts().tolist() == [2, 1]
    batch = pa.RecordBatch.from_pydict({"text": column})
    cut = list(words.parts(iter([batch]), "text", 2))
    assert sum(b.num_rows for b in cut) == 5 and len(cut) > 1
    assert not list(words.parts(iter([batch.slice(0, 0)]), "text"))


def test_sliding_argmin():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 6, 300).astype(np.uint64) << np.uint64(40)
    for width in (1, 2, 3, 7, 16, 300):
        got = words.sliding_argmin(values, width, block=50)
        for i in range(len(values) - width + 1):
            part = values[i : i + width]
            assert got[i] == i + max(j for j in range(width) if part[j] == part.min())
    assert not len(words.sliding_argmin(values, 301))


def test_winnowing_guarantee_and_equal_texts():
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdef ") for _ in range(16 + 24 - 1))
    a = "".join(rng.choice("ghij") for _ in range(200)) + shared + "tail of one"
    b = "head " + shared + "".join(rng.choice("klmn") for _ in range(90))
    fa, fb = (winnowing.fingerprint(t, 16, 24) for t in (a, b))
    common = set(fa[1].tolist()) & set(fb[1].tolist())
    assert common
    at = {h: p for p, h in zip(*map(np.ndarray.tolist, fa))}
    for p, h in zip(*map(np.ndarray.tolist, fb)):
        if h in common:
            assert a[at[h] : at[h] + 16] == b[p : p + 16]
    assert winnowing.written(*winnowing.fingerprint(a, 16, 24)) == winnowing.written(*fa)
    assert winnowing.written(*winnowing.fingerprint("", 16, 24)) == ""
    assert len(winnowing.fingerprint("short", 16, 24)[0]) == 1
    assert winnowing.likeness(fa[1], fa[1]) == 1 and winnowing.likeness(fa[1][:0], fa[1]) == 0


def test_winnowing_against_plain_windows():
    text = "".join(random.Random(5).choice("ab ") for _ in range(400))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    hashes = winnowing.gram_hashes(codes, 5)
    grams = [text[i : i + 5] for i in range(len(text) - 4)]
    assert len(set(zip(grams, hashes.tolist()))) == len(set(grams))
    want = sorted({max(range(i, i + 8), key=lambda j: (-(int(hashes[j]) >> 22), j)) for i in range(len(grams) - 7)})
    assert winnowing.fingerprint(text, 5, 8)[0].tolist() == want


@pytest.mark.parametrize("percent", [80, 85, 50])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    made, sized = jaccard_join.Signatures(percent), jaccard_join.bands(percent, 2000)
    linked = 0
    for n in [*range(1, 40, 2), 60, 100, 200, 400, 900]:
        for _ in range(10):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            change = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            b = np.concatenate((a[change:], rng.integers(0, 2**63, int(rng.integers(0, change + 1))).astype(np.uint64)))
            a, b = np.unique(a), np.unique(b)
            common = len(np.intersect1d(a, b))
            if 100 * common < percent * (len(a) + len(b) - common) or len(a) == len(b) == common:
                continue
            linked += 1
            assert jaccard_join.may_link((len(a), jaccard_join.sketch(a)), (len(b), jaccard_join.sketch(b)), percent)
            assert set(made.both(a, sized).tolist()) & set(made.both(b, sized).tolist())
    assert linked > 50


def test_sets_with_too_many_empty_parts_share_nested_signatures():
    made = jaccard_join.Signatures(85)
    size = 400
    k, n1, _, spare, *_ = made.level(3, 300, size)
    low = np.arange(size, dtype=np.uint64) * np.uint64(2**54)  # all in a few parts of the domain
    high = low.copy()
    high[:10] += np.uint64(1)
    a, b = made.of(np.sort(low), 3, 300, size), made.of(np.sort(high), 3, 300, size)
    assert len(a) > n1 and set(a.tolist()) & set(b.tolist())


def test_sketches_rule_out_distant_sets():
    rng = np.random.default_rng(5)
    a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (500, 520))
    c = np.concatenate((a[:250], b[:300]))
    drawn = {k: (len(v), jaccard_join.sketch(v)) for k, v in {"a": a, "b": b, "c": np.unique(c), "e": a[:60]}.items()}
    assert jaccard_join.may_link(drawn["a"], drawn["a"], 100)
    assert not jaccard_join.may_link(drawn["a"], drawn["b"], 80)
    assert not jaccard_join.may_link(drawn["a"], drawn["c"], 80)
    assert not jaccard_join.may_link(drawn["a"], drawn["e"], 80)
    assert len(jaccard_join.sketch(a)) == 128 and len(jaccard_join.sketch(a[:0])) == 8


def test_suffix_automaton_counts():
    rng = random.Random(3)
    for _ in range(60):
        texts = [([rng.choice("abc") for _ in range(rng.randrange(0, 12))], rng.randrange(1, 4)) for _ in range(4)]
        automaton = SuffixAutomaton()
        for text, copies in texts:
            automaton.add(text, copies)
        automaton.total()

        def places(part):
            return sum(c * sum(t[i : i + len(part)] == part for i in range(len(t) - len(part) + 1)) for t, c in texts)

        for text, _ in texts:
            for times in (1, 2, 3):
                got = list(automaton.matches(text, times))
                for end, size in enumerate(got, 1):
                    want = max((n for n in range(1, end + 1) if places(text[end - n : end]) >= times), default=0)
                    assert size == want


def test_repeated_windows_of_a_shard():
    masks = substring_dedup.repeated_windows([(b"a b c d", 1), (b"x b c d", 1), (b"q r s", 2)], 3)
    assert masks == [0b10, 0b10, 0b1]


def test_best_fit_decreasing_takes_the_tightest_window():
    rng = random.Random(4)
    sizes = sorted((rng.randrange(1, 33) for _ in range(300)), reverse=True)
    got = packing.best_fit_decreasing(sizes, 32)
    left = []
    for size, (window, offset) in zip(sizes, got):
        if window == len(left):
            assert all(x < size for x in left)
            left.append(32)
        assert offset == 32 - left[window]
        fitting = [x for x in left if x >= size]
        assert left[window] == min(fitting)
        left[window] -= size
    assert packing.cut(0, 8) == [] and packing.cut(8, 8) == [(0, 8)] and packing.cut(17, 8) == [(0, 8), (8, 8), (16, 1)]


TEXTS = [
    "",
    None,
    "Hello World's don't I'LL 12 345",
    "<|endoftext|>",
    "a<|startoftext|><|endoftext|> B",
    "É é é ΑΣ ΣΑΣ İstanbul ß",
    "x" * 3000,
    "ab" * 500 + "́",
    "日本 語😀 \x1c \x85 ​ .,!?---",
    " lead and trail ",
]


def test_encoding_matches_the_library(vocabulary):
    library = Tokenizer.from_file(FILE)
    rng = random.Random(6)
    alphabet = "aAbß'sΣέİéÉ \t\x1c\x85  日本١²½😀<|endoftext|>!?.,-—́ﬁ'll'd09"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    for text in texts:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert bpe.encode(text, vocabulary) == want
        assert bpe.decode(want, vocabulary) == library.decode(want, skip_special_tokens=False)


def test_merges_of_short_and_long_words_agree(vocabulary):
    rng = random.Random(7)
    merges = bpe.Merges(vocabulary)
    for _ in range(300):
        parts = [rng.choice(merges.inner) for _ in range(rng.randrange(1, 40))] + [rng.choice(merges.last[97:122])]
        assert merges.short(list(parts)) == merges.long(list(parts))


def test_longest_match_counts(vocabulary):
    entries = {tuple(token_counts.symbols_of(t)) for t in vocabulary.ids if t not in vocabulary.specials}
    automaton = token_counts.automaton(vocabulary)
    longest = max(map(len, entries))
    splitter, table = bpe.Splitter(vocabulary), bpe.byte_symbols()
    rng = random.Random(8)
    texts = ["The quick brown foxes jumped overwhelmingly", "".join(rng.choice("etaoinshr") for _ in range(400))]
    for text in texts:
        for piece in text.split():
            for word in splitter.words(piece):
                symbols = token_counts.word_symbols(word, table)
                n = i = 0
                while i < len(symbols):
                    i = next(j for j in range(min(len(symbols), i + longest), i, -1) if tuple(symbols[i:j]) in entries)
                    n += 1
                assert automaton.count(symbols) == n
    small = token_counts.LongestMatch(["a", "ab", "abcd", "b", "c", "d"])
    assert [small.count(t) for t in ("abc", "abcd", "", "abca", "z", "zab")] == [2, 1, 0, 3, 1, 2]


def test_tables_forget_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "_REMEMBERED", 2)
    known = bpe.Remembered(len)
    assert [known[p] for p in ("a", "bb", "c", "dd", "e" * 500)] == [1, 2, 1, 2, 500]
    assert len(known) <= 2


def test_posteriors_against_all_paths():
    rng = np.random.default_rng(9)
    lengths = np.array([3, 0, 1, 4])
    move, begin = rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    emission = rng.random((8, 3)) + 0.1  # text after text
    lattice = language_id.Lattice(lengths)
    placed = np.empty_like(emission)
    placed[lattice.place] = emission
    after, pairs = lattice.posteriors(placed, move, begin)
    after = after[lattice.place]
    want_pairs = np.zeros((3, 3))
    at = 0
    for n in lengths:
        weights, marks, moved = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in product(range(3), repeat=int(n)):
            w = 1.0
            for t, label in enumerate(path):
                w *= emission[at + t, label] * (move[path[t - 1], label] if t else begin[label])
            weights += w
            for t, label in enumerate(path):
                marks[t, label] += w
                if t:
                    moved[path[t - 1], label] += w
        if n:
            assert np.allclose(after[at : at + n], marks / weights)
            want_pairs += moved / weights
        at += n
    assert np.allclose(pairs, want_pairs)


def test_field_follows_a_switch_of_language():
    english = ["the house and the tree are here with them", "this is the way that they went there"] * 5
    german = ["das haus und der baum sind nicht hier bei ihnen", "dies ist der weg den sie nicht gingen"] * 5
    model = language_id.fit(english + german, ["en"] * 10 + ["de"] * 10)
    best, mean = model.label(words.Texts(pa.array(["the tree and the house", "und der baum ist nicht", "... 12", ""])))
    assert [model.labels[i] if i >= 0 else None for i in best] == ["en", "de", None, None]
    assert (mean[:2] > 0.5).all() and (mean[2:] == 0).all()
    both, share = model.label(words.Texts(pa.array(["the house and the tree are here und der baum ist nicht hier bei ihnen das haus"])))
    assert 0.4 < share[0] < 0.75


def test_backoff_automaton_is_a_distribution():
    rng = np.random.default_rng(10)
    c = 5
    grams = rng.choice(c**3, 30, replace=False)
    counts = rng.integers(1, 9, 30)
    automaton = lm_scoring.Automaton(grams, counts, c, 0.75)
    for two in range(c):
        for one in range(c):
            state = np.full(c, automaton.state_of[2][two * c + one])
            p = 10 ** automaton.step(state, np.arange(c))
            assert np.isclose(p.sum(), 1)
    trigram = {int(g): int(n) for g, n in zip(grams, counts)}
    g = int(grams[0])
    a, b, w = g // c**2, g // c % c, g % c
    n_ab = sum(n for k, n in trigram.items() if k // c == g // c)
    kinds = sum(k // c == g // c for k in trigram)
    n_b = sum(n for k, n in trigram.items() if k // c % c == b)
    n_bw = sum(n for k, n in trigram.items() if k % c**2 == b * c + w)
    kinds_b = len({k % c for k in trigram if k // c % c == b})
    p0 = (sum(n for k, n in trigram.items() if k % c == w) + 1) / (sum(trigram.values()) + c)
    p1 = max(n_bw - 0.75, 0) / n_b + 0.75 * kinds_b / n_b * p0
    p2 = (trigram[g] - 0.75) / n_ab + 0.75 * kinds / n_ab * p1
    got = automaton.step(np.array([automaton.state_of[2][a * c + b]]), np.array([w]))[0]
    assert np.isclose(10**got, p2)


def test_places_are_sent_in_few_bytes():
    """Three words of a place take less than a row of three keys, and come back as they were."""
    rng = np.random.default_rng(11)
    end, n = 4000, 20_000
    numbers = np.minimum(rng.zipf(1.3, (3, n)), end)
    numbers[:, ::20] = end + 1 + rng.integers(0, 900, (3, n // 20))
    key = np.concatenate((np.arange(end + 1), np.sort(rng.integers(-(2**63), 2**63, 900))))
    other, blob = lm_scoring.coded(numbers, key, end)
    assert sum(map(len, blob)) < 6 * n
    keys, back = lm_scoring.decoded(blob)
    assert np.array_equal(keys, key[other])
    assert np.array_equal(lm_scoring.renumbered(back, keys, key[end + 1 :], end), numbers)
    keys, back = lm_scoring.decoded(lm_scoring.coded(numbers[:, :0], key, end)[1])
    assert len(keys) == 0 and back.shape == (3, 0)


def test_runs_of_ids_are_those_of_the_library(vocabulary):
    library = Tokenizer.from_file(FILE)
    rng = random.Random(9)
    spaces = [" ", "  ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000"]
    words_ = ["The", "ÀÉ", "日本", "it's", "<|endoftext|>", "<|startoftext|>x", "123", "co-op", "ΣΑΣ", "…", "a" * 90]
    texts = [*ODD, *["".join(rng.choice(words_) + rng.choice(spaces) for _ in range(rng.randint(0, 12))) for _ in range(300)]]
    runs = bpe.IdRuns(vocabulary)
    for column in (pa.array(texts), pa.array(["skip", *texts]).slice(1), pa.array(texts[:1]), pa.array([], pa.string())):
        ids, ends = runs(column)
        want = [library.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want
