"""Operators against plain versions of what they compute."""

import hashlib
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import bpe, brown, components, licenses, media, minhash, packing, quality, simhash, suffix, toxicity
from gridloom.llm.license_texts import TEMPLATES
from tests.llm.cases import PASSAGE, SCHEMA, rows, tokens, words

TEXT = st.text(st.one_of(st.sampled_from("ab éß'’!.1\t\n ΣİK<|>"), st.characters(codec="utf-8")), max_size=40)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], r)
    return out


# --- encoding


@pytest.fixture(scope="module")
def word_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path), bpe.WordCoder(path)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_bpe_equals_the_library(word_library, text):
    library, own = word_library
    want = library.encode(text, add_special_tokens=False).ids
    code, shown = own.both(text)
    assert np.frombuffer(code, "<u4").tolist() == want
    assert shown == library.decode(want, skip_special_tokens=False)


def test_bpe_rows(spark, docs, word_library):
    found = by_id(bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True))
    for doc_id, text, *_ in rows():
        want = word_library[0].encode(text or "", add_special_tokens=False).ids
        assert found[doc_id]["ids"] == want
        assert found[doc_id]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


@pytest.fixture
def walked(word_library, monkeypatch):
    """A coder that has seen nothing yet, and the words that it walks through the automaton."""
    coder, seen = bpe.WordCoder(public_tokenizers.path("word_bpe_49k.json")), []
    word = coder.vocabulary.word
    monkeypatch.setattr(coder.vocabulary, "word", lambda data: seen.append(data) or word(data))
    return coder, seen


def test_bpe_walks_a_word_once_however_it_is_written(word_library, walked):
    coder, seen = walked
    text = "Reading reading, READING. (reading) rEading's <|endoftext|>reading Élan élan, É"
    assert np.frombuffer(coder.both(text)[0], "<u4").tolist() == word_library[0].encode(text, add_special_tokens=False).ids
    assert sorted(seen) == sorted({*seen}) and b"reading" in seen


def test_bpe_keeps_frequent_words_when_its_room_is_full(word_library, walked, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    coder, seen = walked
    for text in [*(f"often {w}" for w in words(400, 11).split()), "often " + "ab" * bpe.LONGEST]:
        code, shown = coder.both(text)
        want = word_library[0].encode(text, add_special_tokens=False).ids
        assert np.frombuffer(code, "<u4").tolist() == want and shown == word_library[0].decode(want, skip_special_tokens=False)
    assert seen.count(b"often") == 1
    for kept in (coder.chunks, coder.words):
        assert len(kept) + len(kept.before) <= bpe.REMEMBERED


@lru_cache
def byte_library(path):
    return Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_packing_ids_equal_the_library(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.coder(path)(text).tolist() == byte_library(path).encode(text, add_special_tokens=False).ids


# --- packing


@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 20))
def test_bins_hold_pieces_without_gaps(lengths, most):
    bins, held = packing.Bins(64, most), {}
    for n in lengths:
        own, at = bins.put(n)
        assert held.get(own, 0) == at and at + n <= 64
        held[own] = at + n
        assert bins.open <= most


@given(st.lists(st.integers(1, 64), max_size=100))
def test_best_fit_with_room_for_all_bins(lengths):
    bins, plain = packing.Bins(64, 1000), []
    for n in lengths:
        fitting = [64 - x for x in plain if 64 - x >= n]
        _, at = bins.put(n)
        if fitting:
            k = plain.index(64 - min(fitting))
            assert at == plain[k]
            plain[k] += n
        else:
            assert at == 0
            plain.append(n)


def test_bounds_bind_and_waste_stays_small(spark, monkeypatch):
    rng, most = random.Random(3), 0
    own = [(i, 0, 0, min(1023, int(rng.lognormvariate(5, 1)) + 1), rng.getrandbits(32)) for i in range(30_000)]
    out = packing.packed(spark.createDataFrame(own, "doc_id long, piece int, start long, length long, ids_crc32 long")).collect()
    ends = Counter()
    for r in out:
        ends[r["sequence_id"]] += r["length"]
    assert len(out) == len(own) and max(ends.values()) <= 1024 and len(ends) <= 1.02 * sum(x[3] for x in own) / 1024
    bins = packing.Bins(1024, packing.OPEN)
    for at in range(0, len(own), packing.WAITING):
        for n in sorted((x[3] for x in own[at : at + packing.WAITING]), reverse=True):
            bins.put(n)
            most = max(most, bins.open)
    assert most == packing.OPEN or most < len(ends)


def test_fullest_bin_closes_first():
    bins = packing.Bins(10, 2)
    assert [bins.put(n) for n in (6, 8, 9)] == [(0, 0), (1, 0), (2, 0)]  # bin 1 closed
    assert bins.put(4) == (0, 6)


def test_packed_rows(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    out = packing.pack(docs, path).collect()
    want = {}
    for doc_id, text, *_ in rows():
        want[doc_id] = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
    for r in out:
        ids = want[r["doc_id"]]
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert r["length"] == 1024 or r["piece"] == 0
    seqs = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert seqs.get(r["sequence_id"], 0) == r["offset"]
        seqs[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(seqs.values()) <= 1024
    assert len(seqs) <= -(-sum(r["length"] for r in out) // 1024) + 1


# --- near duplicates


def plain_fingerprint(text):
    own = tokens(text)
    grams = [" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))] if own else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_components(spark, docs):
    found = simhash.groups(docs).collect()
    own = [(i, plain_fingerprint(t)) for i, t, *_ in rows()]
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in found) == sorted((str(i), f"{f:016x}") for i, f in own)
    group = {i: i for i, _ in own if i is not None}

    def root(x):
        return x if group[x] == x else root(group[x])

    for i, f in own:
        for j, g in own:
            if i is not None and j is not None and (f ^ g).bit_count() <= 4 and root(i) != root(j):
                group[max(root(i), root(j))] = min(root(i), root(j))
    for r in found:
        if r["doc_id"] is not None:
            assert r["component_id"] == root(r["doc_id"])


@pytest.mark.parametrize("pairs", [1, 1 << 18])
def test_links_in_dense_groups(monkeypatch, pairs):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = random.Random(5)
    base = rng.getrandbits(64)
    f = {rng.getrandbits(64) for _ in range(300)} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(200)}
    f = np.array(sorted(f), np.uint64)
    child, parent = simhash.links(simhash.places(f))
    label = {int(x): int(x) for x in f}

    def root(x, of):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in zip(child.tolist(), parent.tolist(), strict=True):
        label[root(a, label)] = root(b, label)
    want = {int(x): int(x) for x in f}
    for i, a in enumerate(f):
        for b in f[i + 1 :]:
            if int(a ^ b).bit_count() <= 4:
                want[root(int(a), want)] = root(int(b), want)
    same = lambda of: {frozenset(y for y in of if root(y, of) == r) for r in {root(x, of) for x in of}}
    assert same(label) == same(want)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, 1000 + i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(60)] + [(5, 5)]
    from gridloom.llm.common import Scratch

    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    near: dict[int, set] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert found.get(node, node) == min(seen)


# --- fingerprints


def test_minhash_rows(spark, docs):
    own = sorted(((i, t or "") for i, t, *_ in rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    found = sorted(minhash.fingerprints(docs).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    for k, ((i, t), r) in enumerate(zip(own, found, strict=True)):
        after = own[(k + 1) % len(own)][1]
        changed = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(t), hashlib.sha256(changed.encode()).hexdigest())
        one, two, three = minhash.signatures(pa.array([t, changed, after], pa.string()))
        assert [r["fingerprint"], r["edited_fingerprint"]] == minhash.written(np.stack([one, two]))
        assert (r["near_edited"], r["near_next"]) == ((one & 0xFFFF == two & 0xFFFF).mean(), (one & 0xFFFF == three & 0xFFFF).mean())


def test_minhash_estimates_jaccard():
    a, b = words(2000, 1), words(2000, 2)
    texts = [a, " ".join(a.split()[:1500] + b.split()[:500]), b]
    s = minhash.signatures(pa.array(texts))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    for i, j in ((0, 1), (1, 2), (0, 2)):
        true = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        assert abs(minhash.likeness(s[i : i + 1], s[j : j + 1])[0] - true) < 0.17


def test_near_duplicates(spark):
    base = [words(120, k) for k in range(6)]
    texts = [*base, *base[:2], base[0] + " more", "the " + base[3], " ".join(base[4].split()[:60]), "", None, "few words", "few words"]
    found = by_id(minhash.near_duplicates(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")))
    sets = []
    for t in texts:
        w = tokens(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    for i, a in enumerate(sets):
        near = [j for j, b in enumerate(sets) if (len(a & b) / len(a | b) if a | b else 1) >= 0.8]
        assert found[i]["component_id"] == min(near), i


# --- passages


def plain_cut(own):
    out = {}
    for i, t in own:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if any(j < i and b[s : s + 50] in (u or "").encode() for j, u in own):
                gone[s : s + 50] = True
        runs = int((gone & np.r_[True, ~gone[:-1]]).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_suffix_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    rng = random.Random(chunk)
    own, base = [], words(300, 77)
    for i in range(40):
        a, n = rng.randrange(len(base) - 400), rng.randrange(30, 400)
        text = words(rng.randrange(1, 20), i) + base[a : a + n] + ("ab" * rng.randrange(60) if i % 3 else "é" * rng.randrange(60)) + words(3, 900 + i)
        own.append((rng.randrange(10**6), text))
    own += [(10**7 + k, own[k][1]) for k in range(5)] + [(10**8, None), (10**8 + 1, ""), (10**8 + 2, PASSAGE), (10**8 + 3, PASSAGE[3:]), (10**8 + 4, "x" * 300), (10**8 + 5, "x" * 55)]
    rng.shuffle(own)
    found = by_id(suffix.cut(spark.createDataFrame(own, "doc_id long, text string").repartition(3)))
    assert {i: tuple(r)[1:5] for i, r in found.items()} == plain_cut(own)


@pytest.mark.parametrize("last", ["", "only twenty bytes ab"])
def test_a_short_last_text_costs_its_neighbours_nothing(spark, last):
    shared = words(40, 31).encode()[:50].decode("utf-8", "ignore").ljust(50, "z")
    own = [(1, words(20, 1) + shared), (2, words(20, 2) + shared), (3, last)]
    found = by_id(suffix.cut(spark.createDataFrame(own, "doc_id long, text string").coalesce(1)))
    assert {i: tuple(r)[1:5] for i, r in found.items()} == plain_cut(own) and found[2]["n_removed"] >= 50
    data = (("p" * 30 + "q" * 50) + last).encode()
    first, count, _, _ = suffix.anchors(np.frombuffer(data, np.uint8), np.array([0, 80, len(data)]))
    assert sorted(w for a, n in zip(first, count, strict=True) for w in range(a, a + n)) == list(range(31))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=120).map(lambda b: bytes(x % 3 + 97 for x in b)), st.integers(1, 30))
def test_bucket_pointer_refinement(data, depth):
    windows = np.arange(max(0, len(data) - depth + 1))
    bucket = suffix.refined(np.frombuffer(data, np.uint8), windows, depth)
    for i in windows:
        for j in windows:
            assert (bucket[i] == bucket[j]) == (data[i : i + depth] == data[j : j + depth])


def test_whole_letters_stay(spark):
    text = "ü" * 60
    out = by_id(suffix.cut(spark.createDataFrame([(1, "a" + text), (2, "b" + text + "é")], "doc_id long, text string"), whole_letters=True))
    assert out[1]["kept"] == "a" + text and out[2]["kept"] == "bé"


# --- language model


def test_brown_base_and_counts(spark, docs):
    found = brown.score(docs).collect()
    own = [(i, [*tokens(t), None]) for i, t, *_ in rows()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    count = Counter(w for i, t in own if i is not None and fold(i) != 1 for w in t)
    n, v = sum(count.values()), len(count)
    base = lambda t: sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
    want = sorted((str(i), i is not None and fold(i) == 1, len(t), sum(count[w] > 0 for w in t), n, round(base(t), 6)) for i, t in own)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    assert all(r["score"] < 0 for r in found)


def test_transitions_sum_to_one(spark, docs):
    from gridloom.llm.common import Scratch, texts

    train = texts(docs).where("doc_id is not null")
    words_ = Scratch(spark).keep(brown.vocabulary(train, 3))
    counts = brown.Counts(words_, train.count())
    coded = Scratch(spark).keep(brown.coded(docs, counts, 5, 1))
    of = brown.exchange(brown.bigrams(coded, counts), counts.symbol_n)
    step = brown.transitions(coded, counts, of)
    assert np.allclose((10.0**step).sum(axis=2), 1)
    model = brown.Model(counts, of, step)
    for c in range(brown.CLASSES):
        own = (of == c) & (counts.symbol_n > 0)
        assert not own.any() or np.isclose((10.0 ** model.symbol[own]).sum(), 1)
    for shape in np.flatnonzero(counts.shape_n)[:50]:
        n = counts.head["n"][(counts.symbol == brown.MOST_WORDS + shape)].astype(float)
        total = (10.0 ** model.in_shape(n, np.full(len(n), shape))).sum() + 10.0 ** model.in_shape(np.zeros(1), np.array([shape]))[0]
        assert np.isclose(total, 1)


def test_score_equals_the_model_by_hand(spark, docs):
    import math
    from collections import defaultdict

    from gridloom.llm.common import Scratch, texts

    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    train = texts(docs).where("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1")
    counts = brown.Counts(Scratch(spark).keep(brown.vocabulary(train, 3)), train.count())
    of = brown.classes(Scratch(spark).keep(brown.coded(docs, counts, 5, 1)), counts)
    assert (counts.symbol >= brown.SYMBOLS).sum() + brown.SYMBOLS == len(of) == len(counts.symbol_n)

    def symbols(text):
        h, shape, _ = brown.tokens(pa.array([text or ""]))
        out = []
        for x, s in zip(h, shape, strict=True):
            at = np.flatnonzero(counts.head["h"] == x)
            own = int(counts.symbol[at[0]]) if len(at) else brown.MOST_WORDS + int(s)
            out.append((own, int(counts.head["n"][at[0]]) if len(at) else 0, int(s)))
        return [*out, (brown.END, 0, 0)]

    own = [(i, symbols(t)) for i, t, *_ in rows()]
    grams = [defaultdict(float) for _ in range(3)]
    start = brown.CLASSES
    for i, s in own:
        if i is not None and fold(i) != 1:
            c = [start, start, *(int(of[x]) for x, _, _ in s)]
            for a, b, d in zip(c, c[1:], c[2:], strict=False):
                grams[0][d] += 1
                grams[1][b, d] += 1
                grams[2][a, b, d] += 1
    total = sum(grams[0].values())

    def step(a, b, d):
        p = (grams[0][d] + 0.5) / (total + 0.5 * brown.CLASSES)
        for table, before in ((grams[1], (b,)), (grams[2], (a, b))):
            n = [table[(*before, x)] for x in range(brown.CLASSES)]
            if sum(n):
                p = (max(n[d] - brown.DISCOUNT, 0) + brown.DISCOUNT * sum(x > 0 for x in n) * p) / sum(n)
        return p

    class_n = defaultdict(float)
    for x, c in enumerate(of):
        class_n[int(c)] += counts.symbol_n[x]
    want = []
    for i, s in own:
        c, out = [start, start, *(int(of[x]) for x, _, _ in s)], 0.0
        for k, (x, n, shape) in enumerate(s):
            out += math.log10(step(c[k], c[k + 1], c[k + 2]))
            out += math.log10(counts.symbol_n[x] / class_n[int(of[x])] if counts.symbol_n[x] > 0 else 0.5 / max(class_n[int(of[x])], 1))
            if brown.MOST_WORDS <= x < brown.END:
                words_n, all_n = counts.shape_words[shape], counts.shape_n[shape]
                out += math.log10((n - counts.discount if n else counts.discount * words_n) / all_n if all_n > 0 else 0.5)
        want.append((str(i), round(out, 6)))
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in brown.score(docs).collect()) == sorted(want)


def test_exchange_finds_two_languages():
    rng, n = np.random.default_rng(0), np.zeros((41, 41))
    n[:20, :20], n[20:40, 20:40] = rng.integers(5, 50, (20, 20)), rng.integers(5, 50, (20, 20))
    of = brown.exchange(n, n.sum(axis=1), classes=3, rounds=20, fixed=40)
    assert len(set(of[:20])) == len(set(of[20:40])) == 1 and of[0] != of[25] and of[40] == 2


# --- classifiers


def test_forest_learns_and_flattens():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < 0)).astype(float)
    forest = quality.fit(x[:2000], y[:2000])
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97

    def walk(row):
        total = forest.base
        for feature, cut, value in zip(forest.feature, forest.cut, forest.value, strict=True):
            at = 0
            for _ in range(forest.depth):
                at = 2 * at + 1 + int(row[feature[at]] > cut[at])
            total += value[at - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x[:20]), [walk(r) for r in x[:20]])


def test_statistics_do_not_depend_on_the_batch():
    texts = [t or "" for _, t, *_ in rows()]
    together = quality.statistics(pa.array(texts))
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(quality.statistics(pa.array([t]))[0], row, atol=1e-5)


def auc(score, label):
    order = np.argsort(np.argsort(score))
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize(("name", "column", "least"), [("quality", "quality", 0.98), ("toxicity", "toxic", 0.85)])
def test_held_out_rows(spark, name, column, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {"quality": quality, "toxicity": toxicity}[name].classify(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert auc(out["score"].to_numpy(), out[column].to_numpy()) > least


@pytest.fixture(scope="module")
def channel():
    own = ["idiot", "scumbag", "worthless", "moron"]
    grid = np.full((28, 28, 28), np.log(28.0))
    for w in own:
        codes = [26, 26, *(ord(c) - 97 for c in w), 26]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            grid[a, b, c] = 0.3
    return toxicity.Channel(grid, own, [0.9] * len(own), 0.02)


@pytest.mark.parametrize("text", ["1d10t", "i d i o t", "i.d.i.o.t", "IDIIIOT", "you 1di0t!!", "w0rthl3$$", "m*ron", "scuuumb4g", "(moron)"])
def test_disguises_are_undone(channel, text):
    assert channel.score(channel.found(text)) > 0.3
    assert any(w in channel.text(text) for w in channel.words)


@pytest.mark.parametrize("text", ["i d i o t.", "(i d i o t)", '"i d i o t"', "i  d  i  o  t", "i\nd\ni\no\nt", "i d i o t, and", "id iot", "you id iot!", "id i ot", "(1d 10t)", "scum bag"])
def test_spaces_within_words_are_dropped(channel, text):
    assert channel.score(channel.found(text)) > 0.3
    assert any(w in channel.text(text) for w in channel.words)


def test_spaced_letters_are_all_restored(channel):
    out = channel.text("hello y o u i d i o t f r i e n d bye").split()
    assert out[0] == "hello" and out[-1] == "bye" and "idiot" in out and "".join(out) == "helloyouidiotfriendbye"


@settings(max_examples=40, deadline=None)
@given(st.text(st.sampled_from("ab01.x"), min_size=1, max_size=6), st.integers(0, 5))
def test_viterbi_finds_the_cheapest_path(text, seed):
    import itertools

    grid = np.random.default_rng(seed).uniform(0.1, 6, (28, 28, 28))
    channel = toxicity.Channel(grid, ["ab"], [0.9])
    lattice = channel.lattice(text)

    def cost(path):
        total, x, y = sum(p for _, p in path), toxicity.BORDER, toxicity.BORDER
        for c in "".join(t for t, _ in path) + " ":
            code = toxicity.BORDER if c == " " else toxicity._CODE.get(c, toxicity.OTHER)
            total += grid[x][y][code]
            x, y = y, code
        return total

    best = min(itertools.product(*lattice), key=cost)
    found = channel.stretch([*lattice, [(" ", 0.0)]]).rstrip(" ")
    own = [p for p in itertools.product(*lattice) if "".join(t for t, _ in p) == found]
    assert np.isclose(min(map(cost, own)), cost(best))


def test_long_runs_are_searched_in_bounded_stretches(channel):
    import tracemalloc

    for text in ("a*" * 1_000, "1a2b3c4d5e" * 3_000, "x y " * 5_000):
        tracemalloc.start()
        channel.found(text)
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
        tracemalloc.stop()
    assert channel.score(channel.found("a*" * 400 + " 1d10t " + "x1" * 3000)) > 0.3


@pytest.mark.parametrize("text", ["the plain text", "call 555-0123 now", "a b c d e", "1234567", "", "v1.0 of x86_64", "mormon idioms"])
def test_clean_text_stays(channel, text):
    assert channel.score(channel.found(text)) < 0.3
    assert channel.text(text).split() == text.split() or channel.found(text) == set()


# --- licences


def test_license_coverage():
    scanner = licenses.Scanner(TEMPLATES, 0.8)
    filler = words(400, 5)
    for name, text in TEMPLATES.items():
        found = scanner.scan(f"{filler} {text} {filler}")
        assert name in [x[0] for x in found] and max(x[1] for x in found) == 1.0, name
    changed = " ".join(w for i, w in enumerate(TEMPLATES["MIT"].split()) if i % 9)
    assert scanner.scan(f"{filler} {changed}")[0][0] == "MIT"
    assert scanner.scan(filler) == [] and scanner.scan("") == []
    half = TEMPLATES["MIT"].split()
    assert "MIT" not in [x[0] for x in scanner.scan(" ".join(half[: len(half) // 2]))]


@pytest.mark.parametrize(
    "text, name",
    [
        ("Released under the BSD License.", "BSD notice"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0 notice"), ("Released under the Foo License.", None), ("Licensed under CC BY-XY 4.0.", None), ("Released under MIT License.", "MIT notice"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0 notice"), ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0 notice"),
    ],
)
def test_short_notices_name_their_own_licence(text, name):
    found = [x[0] for x in licenses.Scanner(TEMPLATES, 0.8).scan(f"{words(50, 5)} {text} {words(50, 6)}")]
    assert found == ([name] if name else [])


def test_a_spread_licence_is_found_wherever_it_begins():
    scanner = licenses.Scanner(TEMPLATES, 0.8)
    spread = " ".join(f"{w} filler{i}" for i, w in enumerate(TEMPLATES["MIT"].split()))
    for offset in range(0, 400, 10):
        found = scanner.scan(f"{words(offset, 5)} {spread} {words(30, 6)}")
        assert [x[:2] for x in found if x[0] == "MIT"] == [("MIT", 1.0)] or not any(scanner.marks[list(TEMPLATES).index("MIT")]), offset


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(12, 40), st.integers(0, 60), st.integers(0, 60))
def test_planted_templates_are_found_like_by_brute_force(seed, n, before, after):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    template = [rng.choice(vocabulary) for _ in range(n)]
    scanner = licenses.Scanner({"t": " ".join(template)}, 0.8)
    text = [rng.choice([*vocabulary, "x", "y"]) for _ in range(before)] + [w for i, w in enumerate(template) if i % 9] + [rng.choice([*vocabulary, "x"]) for _ in range(after)]
    ids = [scanner.words.get(w, -1) for w in text]
    every = {len(licenses.align(ids[a:b], scanner.templates[0][1])) for a in range(len(ids)) for b in range(a + 1, min(len(ids), a + 3 * n) + 1) if b - a >= 0.8 * n}
    found = scanner.scan(" ".join(text))
    assert not found or found[0][1] * n <= max(every) + 1e-9
    if before + after == 0:
        assert found and found[0][1] >= 0.8


def test_ties_go_to_the_longer_custom_template():
    scanner = licenses.Scanner({"a": "one two three four", "b": "one two three four five"}, 0.8)
    assert [x[0] for x in scanner.scan("one two three four five")] == ["b", "a"]


def test_templates_reach_to_the_end_of_the_licence():
    scanner = licenses.Scanner(TEMPLATES, 0.8)
    for name, end in {"BSD-2-Clause": "THIS SOFTWARE IS", "BSD-3-Clause": "THIS SOFTWARE IS", "Zlib": ", subject to", "Unlicense": "In jurisdictions"}.items():
        assert name not in [x[0] for x in scanner.scan(TEMPLATES[name].split(end)[0])]
        assert scanner.scan(TEMPLATES[name])[0][0] == name
    assert "BSD-3-Clause" not in [x[0] for x in scanner.scan(TEMPLATES["BSD-2-Clause"])]


@given(st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(0, 6), max_size=20))
def test_alignment_is_a_common_subsequence(text, template):
    pairs = licenses.align(text, template)
    assert all(text[i] == template[j] for i, j in pairs)
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))


# --- media


def test_media_round_trip(spark, docs):
    found = by_id(media.digest(docs))
    files = by_id(media.store(docs))
    for doc_id, text, *_ in rows():
        own = (text or "").encode()
        payload = own + b" " * (-len(own) % 192 if own else 192)
        r, f = found[doc_id], bytes(files[doc_id]["media"])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(f), hashlib.sha256(f).hexdigest())


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=192, max_size=192))
def test_frames_decode_by_the_general_way(data):
    file = media.stored(pa.array([data], pa.binary()))[0]
    (at, size), = media.frame_index(file)[0].tolist()
    assert media.decode_frame(file[at : at + size])[::8, ::8].tobytes() == data


def test_frames_with_ac_coefficients():
    # one block: DC 4 (category 3), AC at place 1 of value -1 (run 0, category 1), end of block; quantisers 2
    dc = b"\x00" + bytes([0, 1] + [0] * 14) + bytes([3])
    ac = b"\x10" + bytes([0, 2] + [0] * 14) + bytes([0x01, 0x00])
    bits = "00" + "100" + "00" + "0" + "01"
    coded = int(bits.ljust(16, "1"), 2).to_bytes(2, "big")
    frame = b"\xff\xd8" + media._segment(0xDB, bytes([0] + [2] * 64)) + media._segment(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0])) + media._segment(0xC4, dc) + media._segment(0xC4, ac) + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + coded + b"\xff\xd9"
    x = np.arange(8)
    want = 128 + 8 / 8 - 2 * np.sqrt(1 / 8) * 0.5 * np.cos((2 * x + 1) * np.pi / 16)
    assert np.array_equal(media.decode_frame(frame), np.tile(np.rint(want).astype(np.uint8), (8, 1)))


def test_clips(spark):
    still, other = b"a" * 192 * 40, b"\xf0" * 192 * 25
    file = media.stored(pa.array([still + other], pa.binary()))[0]
    own = spark.createDataFrame([(1, file), (2, None), (3, b"junk"), (4, file[:300])], "doc_id long, media binary")
    out = [tuple(r) for r in media.clips(own).orderBy("doc_id", "clip").collect()]
    assert [x[:6] for x in out[:2]] == [(1, 0, 0, 40, 0.0, 1.6), (1, 1, 40, 25, 1.6, 2.6)]
    assert [x[0] for x in out[2:]] == [3, 4] and all(x[1] is None and x[-1] for x in out[2:])


def test_equal_texts_have_equal_features_wherever_they_lie(spark):
    own = words(900, 4)
    df = spark.createDataFrame([(1, own), (2, words(5000, 8)), (3, own), (4, ""), (5, own)], "doc_id long, text string").coalesce(1)
    out = by_id(media.digest(df))
    assert out[1]["feature"] == out[3]["feature"] == out[5]["feature"]
