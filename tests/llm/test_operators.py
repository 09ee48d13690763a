"""Operators against brute force, round trips and held-out accuracy."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tessella.llm import bpe, compact_windows, exact_dedup, graph, media, ngram_join, packing, quality, queries, sharding, suffix_dedup, textkit, toxicity

from .conftest import table, words

# --- 1 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_encoding_equals_the_tokenizer_library(vocabulary):
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    c = bpe.codec(P.path(vocabulary))
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(1)
    letters = list("abcdeXYZ 0189 \n\t'.,!-_éüñ中文字😀½²  \x1c") + ["'s", " the", "  "]
    texts = ["", " ", "a" * 3000, "ab" * 700, "😀" * 50, "é½²³ x", "it's  I'll \n\n x  ", "<|endoftext|>", *("".join(rng.choices(letters, k=rng.randrange(1, 200))) for _ in range(600))]
    for t in texts:
        ids = np.frombuffer(c.encode(t), np.int32)
        assert ids.tolist() == theirs.encode_ordinary(t), t
        assert c.decode(ids) == t


def test_forced_boundaries_cut_nothing_that_merges():
    c = bpe.codec(bpe.VOCABULARY)
    rng = random.Random(2)
    for _ in range(200):
        raw = bytes(rng.randrange(256) for _ in range(rng.randrange(2, 90)))
        parts = c.split(raw)
        assert b"".join(parts) == raw
        assert [x for p in parts for x in c.merge(p)] == c.merge(raw)
    long_word = bytes(rng.choice(b"abcdefgh") for _ in range(400))
    assert b"".join(c.bytes[c.places[k] : c.places[k] + c.sizes[k]].tobytes() for k in c.merge(long_word)) == long_word


def test_encode_then_decode(spark, corpus):
    docs = table(spark, corpus)
    coded = bpe.encode(docs)
    assert {r.doc_id: r.text for r in bpe.decode(coded).collect()} == dict(corpus)


# --- 2 ---------------------------------------------------------------------------------------------------------------


def repeated(corpus, length):
    own = defaultdict(list)
    for i, t in corpus:
        w = t.split()
        for k in range(len(w) - length + 1):
            own[tuple(w[k : k + length])].append((i, k))
    cover = defaultdict(set)
    for places in own.values():
        if len(places) > 1:
            for i, k in places:
                cover[i].update(range(k, k + length))
    return {(i, k) for i, at in cover.items() for k in at}


@pytest.mark.parametrize("length", [50, 20, 5])
def test_repeated_passages(spark, corpus, length):
    got = {(r.doc_id, k) for r in suffix_dedup.repeated_passages(table(spark, corpus), length).collect() for k in range(r.start_word, r.start_word + r.n_words)}
    assert got == repeated(corpus, length)


def test_loser_tree():
    rng = random.Random(3)
    for n in (1, 2, 3, 7):
        runs = []
        for _ in range(n):
            strings = sorted(bytes(rng.choices(b"ab", k=rng.randrange(0, 9))) for _ in range(rng.randrange(0, 40)))
            lcps, rest = suffix_dedup.front_code(strings)
            assert suffix_dedup.front_decode(lcps, [len(s) for s in strings], rest) == strings
            runs.append((strings, lcps))
        merged = list(suffix_dedup.merge_runs(runs))
        out = [runs[r][0][i] for r, i, _ in merged]
        assert out == sorted(s for r in runs for s in r[0])
        for k in range(1, len(out)):
            assert merged[k][2] == suffix_dedup.common_prefix(out[k - 1], out[k], 0)


# --- 3 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("height,width,sampling", [(16, 16, 2), (17, 31, 2), (40, 25, 1), (8, 8, 1), (1, 1, 2)])
def test_progressive_coefficients(height, width, sampling):
    rng = np.random.default_rng(height)
    image = np.clip(rng.normal(128, 60, (height, width, 3)), 0, 255).astype(np.uint8)
    raw = media.encode(image, 3, sampling)
    want, sizes = media.quantise(image, 3, sampling)
    h, w, parts = media.coefficients(raw)
    assert (h, w) == (height, width)
    for (wide, high), blocks, c in zip(sizes, want, parts.values()):
        a, b = np.array(blocks).reshape(high, wide, 64), np.array(c.blocks).reshape(c.high, c.wide, 64)
        assert (a[..., 0] == b[..., 0]).all()
        assert (a[: c.used_high, : c.used_wide] == b[: c.used_high, : c.used_wide]).all()


def test_pixels():
    image = media.picture(np.random.default_rng(1).normal(size=64), 48)
    for sampling, most in ((1, 1.0), (2, 6.0)):
        got = media.decode(media.encode(image, 1, sampling))
        assert got.shape == image.shape and np.abs(got.astype(int) - image).mean() < most
    # by definition: the inverse transform of one block, coefficient by coefficient
    c = media._Component(1, 1, 0)
    c.lay(8, 8, 1, 1)
    c.table = np.full(64, 2.0)
    c.blocks = [list(range(64))]
    got = media._plane(c)
    want = np.zeros((8, 8))
    for z, k in enumerate(media.ZIGZAG.tolist()):
        v, u = divmod(k, 8)
        s = (np.sqrt(0.5) if u == 0 else 1) * (np.sqrt(0.5) if v == 0 else 1) / 4
        want += 2 * z * s * np.outer(np.cos((2 * np.arange(8) + 1) * v * np.pi / 16), np.cos((2 * np.arange(8) + 1) * u * np.pi / 16))
    assert np.allclose(got, want)


# --- 4 ---------------------------------------------------------------------------------------------------------------


def labelled(rng, n):
    rows = []
    for k in range(n):
        w = [f"{rng.choice('abcdefg')}{'xyz'[rng.randrange(3)] * rng.randrange(1, 6)}" for _ in range(rng.randrange(15, 60))]
        good = k % 4 != 0
        rows.append((k, " ".join(w) + "." if good else " ".join(x.upper() + "!!" if k % 8 else x + "$$$" for x in w), int(good)))
    return rows


def test_quality_held_out(spark):
    rng = random.Random(4)
    train, test = labelled(rng, 300), [(i + 1000, t, q) for i, t, q in labelled(rng, 200)]
    labels = spark.createDataFrame([(i, q) for i, _, q in train], "doc_id long, quality int")
    weights = quality.fit(table(spark, [(i, t) for i, t, _ in train]), labels)
    got = {r.doc_id: r.keep for r in quality.posteriors(table(spark, [(i, t) for i, t, _ in test]), weights).collect()}
    right = sum(got[i] == bool(q) for i, _, q in test) / len(test)
    assert right > 0.95


def test_rejected_documents_have_posteriors(spark, tmp_path):
    rows = labelled(random.Random(16), 200)
    table(spark, [(i, t) for i, t, _ in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op4_quality(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows) and {r.keep for r in got} == {True, False}
    assert all(r.keep == (r.quality >= 0.5) for r in got)


def test_posteriors_by_hand(spark, monkeypatch):
    docs = table(spark, [(k, "a b") for k in range(9)])
    scores = {k: (k % 3 + 1) / 4 for k in range(9)}
    fake = spark.createDataFrame([(k, f"h{k % 3}", f"p{k % 2}", scores[k]) for k in range(9)], "doc_id long, host string, path string, evidence double")
    monkeypatch.setattr(quality, "evidence", lambda *a: fake)
    got = quality.posteriors(docs, None).collect()

    def strength(groups):  # (n, s, mean)
        n = sum(g[0] for g in groups)
        spread = sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups) / n
        within = sum(g[2] * (1 - g[2]) for g in groups) / n
        return max(1, min(1e4, np.mean([g[2] * (1 - g[2]) for g in groups]) / max(spread - within, 1e-6) - 1))

    prior = sum(scores.values()) / 9
    hosts = {h: [scores[k] for k in range(9) if k % 3 == h] for h in range(3)}
    k1 = strength([(len(v), sum(v), prior) for v in hosts.values()])
    rate = {h: (sum(v) + k1 * prior) / (len(v) + k1) for h, v in hosts.items()}
    paths = {(h, p): [scores[k] for k in range(9) if k % 3 == h and k % 2 == p] for h in range(3) for p in range(2)}
    k2 = strength([(len(v), sum(v), rate[h]) for (h, _), v in paths.items()])
    for r in got:
        h, p = r.doc_id % 3, r.doc_id % 2
        v = paths[h, p]
        local = (sum(v) + k2 * rate[h]) / (len(v) + k2)
        assert r.host_rate == pytest.approx(rate[h]) and r.path_rate == pytest.approx(local)
        e = scores[r.doc_id]
        odds = e / (1 - e) * local / (1 - local) * (1 - prior) / prior
        assert r.quality == pytest.approx(odds / (1 + odds))


# --- 5 ---------------------------------------------------------------------------------------------------------------


def gram_set(text, n):
    w = text.split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute_classes(rows, n, threshold):
    """{id: (class, links, copies)} and the similar pairs of different texts, by their first ids."""
    first, copies = {}, defaultdict(int)
    for i, t in rows:
        first.setdefault(t, i)
        copies[t] += 1
    sets = {i: gram_set(t, n) for t, i in first.items() if t.split()}
    pairs = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    parent = {i: i for i in sets}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    links = {i: sum(i in p for p in pairs) for i in sets}
    return {i: (root(first[t]), links[first[t]], copies[t]) for i, t in rows if t.split() and (links[first[t]] or copies[t] > 1)}, {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs}, {root(first[t]) for _, t in rows if t.split()}


@pytest.mark.parametrize("n,threshold", [(5, 0.4), (3, 0.6), (5, 0.9)])
def test_similar_documents(spark, corpus, n, threshold):
    want, pairs, _ = brute_classes(corpus, n, threshold)
    docs = table(spark, corpus)
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.similar_documents(docs, n, threshold).collect()} == want
    assert {(r.doc_a, r.doc_b): r.jaccard for r in ngram_join.jaccard_pairs(docs, n, threshold).collect()} == pytest.approx(pairs)


def test_all_size_ratios(spark):
    """A text within another of 1 to 1 / threshold times its size, and just beyond; short and long ones."""
    rng, rows = random.Random(15), []
    for small in (30, 127, 400, 1500):
        for ratio in (1.02, 1.3, 1.7, 2.1, 2.36, 2.49, 2.5, 2.52, 3.0):
            text = words(rng, int(small * ratio) + 4, 10**6)
            rows += [(len(rows), " ".join(text[: small + 4])), (len(rows) + 1, " ".join(text))]
    want, pairs, _ = brute_classes(rows, 5, 0.4)
    assert len(pairs) == 7 * 4
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.similar_documents(table(spark, rows)).collect()} == want


def test_tiles(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 2)
    monkeypatch.setattr(ngram_join, "GATHERED", 500)
    want, pairs, _ = brute_classes(corpus, 5, 0.4)
    docs = table(spark, corpus)
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.similar_documents(docs).collect()} == want
    assert {(r.doc_a, r.doc_b) for r in ngram_join.jaccard_pairs(docs).collect()} == set(pairs)


def test_one_of_each_group_stays(spark, corpus):
    _, _, want = brute_classes(corpus, 5, 0.4)
    assert sorted(r.doc_id for r in ngram_join.drop_similar(table(spark, corpus)).collect()) == sorted(want)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b} - {x for e in edges if e[0] != e[1] for x in e}
    assert {k: v for k, v in got.items() if k not in alone} == {x: root(x) for e in edges if e[0] != e[1] for x in e}


# --- 6 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_golomb(n):
    values = np.sort(np.random.default_rng(n).integers(0, 1 << 40, n).astype(np.uint64))
    for shift in (0, 3, 20, 31) if n < 3 else (30, 31, 40):
        if shift or n == 0:
            assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(values, max(shift, 26)), n, max(shift, 26)) == values).all()


def test_exact_groups(spark, corpus):
    by = defaultdict(list)
    for i, t in corpus:
        by[t].append(i)
    want = {(i, min(g), len(g)) for g in by.values() if len(g) > 1 for i in g}
    for owners in (1, 3, 8):
        assert {tuple(r) for r in exact_dedup.duplicate_groups(table(spark, corpus), owners=owners).collect()} == want
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(table(spark, corpus)).collect()) == sorted(min(g) for g in by.values())


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_lookup_table():
    names = sharding.shard_names(7)
    table_ = sharding.fill_table(names, 251)
    counts = np.bincount(table_)
    assert len(table_) == 251 and min(table_) == 0 and counts.max() - counts.min() <= 1
    # by the definition: at each turn the first free slot of the shard's permutation
    orders = [[(sharding._hash("offset:" + s) % 251 + j * (sharding._hash("skip:" + s) % 250 + 1)) % 251 for j in range(251)] for s in names]
    slots: dict[int, int] = {}
    for turn in range(251):
        slots[next(x for x in orders[turn % 7] if x not in slots)] = turn % 7
    assert [slots[k] for k in range(251)] == table_
    fewer = sharding.fill_table(names[:-1], 251)
    moved = sum(a != b for a, b in zip(table_, fewer) if a != 6) / 251
    assert moved < 0.15
    with pytest.raises(ValueError):
        sharding.fill_table(names, 250)


def test_placement(spark, corpus, tmp_path):
    docs = table(spark, corpus)
    lookup = sharding.fill_table(sharding.shard_names())
    for r in sharding.assign_shards(docs).collect():
        slot = sharding._hash(str(r.doc_id)) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, lookup[slot])
    sharding.write_shards(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(corpus)


# --- 8 ---------------------------------------------------------------------------------------------------------------


def plain_best_fit(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        fits = [(capacity - b - s, -k) for k, b in enumerate(bins) if b + s <= capacity and b < capacity]
        if fits:
            k = -min(fits)[1]
            bins[k] += s
        else:
            k = len(bins)
            bins.append(s)
        out.append(k)
    return out, bins


def test_best_fit():
    rng = random.Random(8)
    for _ in range(30):
        sizes = sorted((rng.randrange(0, 60) for _ in range(80)), reverse=True)
        got = packing.best_fit(sizes, 100)
        _, bins = plain_best_fit(sizes, 100)
        fills = np.bincount(got, weights=sizes)
        assert fills.max() <= 100 and sorted(fills) == sorted(bins)


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_packing(spark, corpus, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = packing.pack_documents(table(spark, corpus), capacity=150).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin].append(r)
    whole = defaultdict(list)
    for b in bins.values():
        assert sum(r.words for r in b) == b[0].fill <= 150 and sorted(r.slot for r in b) == list(range(len(b)))
        for r in b:
            whole[r.doc_id].append((r.chunk, r.begin, r.words))
    for i, t in corpus:
        n = len(t.split())
        assert sorted(whole[i]) == [(k, 150 * k, min(150, n - 150 * k)) for k in range(max(1, -(-n // 150)))]
    sizes = sorted((r.words for r in rows), reverse=True)
    assert len(bins) <= (1 if partitions == 1 else 1.1) * len(plain_best_fit(sizes, 150)[1]) + (partitions > 1)


# --- 9 ---------------------------------------------------------------------------------------------------------------


def toxic_docs(rng, n):
    rows = []
    for k in range(n):
        sentences = [" ".join(words(rng, rng.randrange(3, 9), 300)) + "." for _ in range(rng.randrange(1, 7))]
        bad = k % 5 == 0
        at = rng.randrange(len(sentences)) if bad else -1
        if bad:
            sentences[at] = f"w{rng.randrange(300)} you {rng.choice(('scum', 'moronic', 'Moron', 'idiot!'))} w{rng.randrange(300)}."
        rows.append((k, " ".join(sentences), int(bad), at))
    return rows


def test_toxicity_held_out(spark):
    rng = random.Random(9)
    train, test = toxic_docs(rng, 900), toxic_docs(rng, 400)
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in train], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, [(i, t) for i, t, _, _ in train]), labels)
    docs = table(spark, [(i, t) for i, t, _, _ in test])
    found = {(r.doc_id, r.sentence_no) for r in toxicity.offending_sentences(docs, model).collect()}
    want = {(i, at) for i, _, y, at in test if y}
    assert len(found & want) / len(want) > 0.95 and len({i for i, _ in found} - {i for i, _ in want}) <= 4
    stay = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert stay == {i for i, _, _, _ in test} - {i for i, _ in found}


def test_noisy_or_by_hand():
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 0.8)  # every sentence has 0.5
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["a. b. c.", "a", ""]})
    got = pa.Table.from_batches(list(toxicity._score(model, False)(iter([batch])))).to_pydict()
    assert got["score"] == pytest.approx([1 - 0.5**3, 0.5, 0]) and got["toxic"] == [True, False, False]


# --- 10 --------------------------------------------------------------------------------------------------------------


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(10)
    for least in (1, 3, 7):
        h = np.concatenate([[0], rng.integers(1, 30, 60), [0], rng.integers(1, 9, 25), [0], [0]]).astype(np.uint64)
        got = set(zip(*(x.tolist() for x in compact_windows.compact_windows(h, least))))
        want = set()
        for c in range(len(h)):
            if h[c]:
                l = r = c
                while h[l - 1] > h[c]:
                    l -= 1
                while h[r + 1] >= h[c]:
                    r += 1
                if r - l + 1 >= least:
                    want.add((l, c, r))
        assert got == want


def found_passages(spark, docs):
    by = defaultdict(list)
    for r in compact_windows.near_duplicate_passages(table(spark, [(k, " ".join(d)) for k, d in enumerate(docs)])).collect():
        by[r.doc_id].append(r)
    return by


def test_near_passages(spark):
    rng = random.Random(11)
    docs = [words(rng, 150) for _ in range(40)]
    want = set()
    for k in range(20):  # a passage of one in another, with a few edits
        passage = docs[k][30 : 30 + 60 + k]
        for _ in range(k // 7):
            passage[rng.randrange(len(passage))] = "edit"
        docs.append(words(rng, 25) + passage + words(rng, 40))
        want.add((40 + k, k))
    found = found_passages(spark, docs)
    assert set(found) <= {i for pair in want for i in pair}
    assert sum(a in found and b in found for a, b in want) >= 0.9 * len(want)
    for a, b in want:
        for r in found[a] + found[b]:
            assert r.class_id == b and r.n_links >= 1 and r.n_copies == 1 and r.start_word >= 20 and r.n_words >= 50
        for x, y in zip(found[a], found[b]):
            x, y = (gram_set(" ".join(docs[i][r.start_word : r.start_word + r.n_words]), 5) for i, r in ((a, x), (b, y)))
            assert len(x & y) / len(x | y) >= 0.6


def brute_links(docs, length, similar):
    """Pairs of documents with passages of `length` words of which the given share of 5-word tokens is in both."""
    sets = [[" ".join(d[k : k + 5]) for k in range(len(d) - 4)] for d in docs]
    least = length - 4
    return {
        (a, b)
        for a in range(len(docs)) for b in range(a) if len({*sets[a]} & {*sets[b]}) >= similar * least
        if any(len(x & y) >= similar * len(x | y) for x in ({*sets[a][i : i + least]} for i in range(len(sets[a]) - least + 1)) if len(x & {*sets[b]}) >= similar * least for y in ({*sets[b][j : j + least]} for j in range(len(sets[b]) - least + 1)))
    }


@pytest.mark.parametrize("hot", [2, 48])
def test_links_against_brute_force(spark, monkeypatch, hot):
    """Holders in groups of 2, 3 and 40, exact and edited ones among them, by pairs and by classes."""
    monkeypatch.setattr(compact_windows, "HOT", hot)
    rng = random.Random(17)
    docs = []
    for size in (2, 2, 2, 3, 3, 40):
        passage = words(rng, rng.choice((55, 70)))
        for k in range(size):
            own = list(passage)
            if k % 3 == 2:
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
            docs.append(words(rng, rng.randrange(5, 12)) + own + words(rng, rng.randrange(5, 12)))
    rng.shuffle(docs)
    links = brute_links(docs, 50, 0.75)
    parent = list(range(len(docs)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = found_passages(spark, docs)
    want = {x for pair in links for x in pair}
    assert len(want & set(found)) >= 0.97 * len(want)
    assert all(r.class_id == root(k) for k in want & set(found) for r in found[k])
    left = {r.doc_id for r in compact_windows.cut_passages(table(spark, [(k, " ".join(d)) for k, d in enumerate(docs)])).collect() if len(r.text.split()) >= 55}
    assert len(left & want) <= len({root(k) for k in want}) + 0.03 * len(want)


def test_all_holders_of_a_passage(spark):
    rng = random.Random(13)
    docs, groups = [], []
    sentence = words(rng, 40)  # beside passages of their own, many hold it
    for size in (2, 3, 10, 40, 60, 150):
        for edits in (0, 1, 3):
            passage = words(rng, 100)
            groups.append((range(len(docs), len(docs) + size), edits))
            for _ in range(size):
                own = list(passage)
                for _ in range(edits):
                    own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
                docs.append(words(rng, 30) + own + words(rng, 30))
    docs += [words(rng, 30) + sentence + words(rng, 30) for _ in range(600)]
    beside = range(len(docs), len(docs) + 20)
    for _ in range(10):
        passage = words(rng, 10) + sentence + words(rng, 10)
        docs += [words(rng, 30) + passage + words(rng, 30) for _ in range(2)]
    found = found_passages(spark, docs)
    for g, _ in groups:
        assert sum(any(r.class_id == g[0] for r in found[k]) for k in g) >= 0.97 * len(g)
    assert all(any(r.class_id == k for r in found[k + j]) for k in beside[::2] for j in (0, 1))
    assert not any(k in found for k in range(groups[-1][0][-1] + 1, beside[0]))
    left = {r.doc_id: r for r in compact_windows.cut_passages(table(spark, [(k, " ".join(d)) for k, d in enumerate(docs)])).collect()}
    for g, edits in groups:
        assert len(left[g[0]].text.split()) == len(docs[g[0]])
        # with three edits on either side the Jaccard of the whole is too little, and only parts of it go
        assert sum(len(left[k].text.split()) < (75 if edits < 3 else 115) for k in g[1:]) >= (0.97 if edits < 3 else 0.9) * (len(g) - 1)


def test_classes_of_a_large_group():
    rng = np.random.default_rng(18)
    new = lambda n: rng.integers(0, 1 << 32, n, np.uint32)
    common, families = new(16), [new(40) for _ in range(8)]
    rows = [np.concatenate([new(20), families[k % 8] if k < 200 else new(40), common, new(20)]) for k in range(500)]
    found = compact_windows._classes(np.arange(500), np.full((500, 2), 65), rows, 46, 0.6)
    assert {(i, j) for i, j, *_ in found} == {(k % 8, k) for k in range(8, 200)}
    assert all(v[2:6] == (20, 75, 20, 75) and v[6] == 1 for v in found)


def test_cutting(spark, corpus):
    docs = table(spark, corpus)
    left = {r.doc_id: r for r in compact_windows.cut_passages(docs).collect()}
    assert len(left) == len(corpus)
    again = repeated([(i, r.text) for i, r in left.items()], 50)
    assert not again
    gone = {i for i, t in corpus if left[i].text != t}
    assert gone <= {i for i, _ in repeated(corpus, 50)} | {r.doc_id for r in compact_windows.near_duplicate_passages(docs).collect() if r.class_id < r.doc_id}
    assert all(r.n_chars == len(r.text) for r in left.values())


def test_verified_parts_of_longer_runs():
    rng = np.random.default_rng(14)
    new = lambda n: rng.integers(0, 1 << 32, n, np.uint32)
    a, b = new(120), new(70)
    spans = lambda x, y: {v[:4] for v in compact_windows.verify(x, y, 46, 0.6)}
    whole, parts = np.concatenate([a, b]), np.concatenate([a, new(40), b])
    assert spans(whole, parts) == {(0, 119, 0, 119), (120, 189, 160, 229)}
    assert spans(parts, whole) == {(0, 119, 0, 119), (160, 229, 120, 189)}
    once, twice = np.concatenate([new(9), b, new(9)]), np.concatenate([b, new(40), b])
    assert spans(once, twice) == {(9, 78, 0, 69), (9, 78, 110, 179)}
    assert spans(twice, once) == {(0, 69, 9, 78), (110, 179, 9, 78)}
    c = new(70)  # thirds of a run, none of which is enough of it by itself
    assert spans(np.concatenate([b, a[:60], c]), np.concatenate([c, new(40), a[:60], new(40), b])) == {(0, 69, 210, 279), (70, 129, 110, 169), (130, 199, 0, 69)}


# --- what they share -------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    import pyarrow as pa

    rng = random.Random(12)
    texts = ["", " a", "b\t\nc ", None, "é 中 x", " ".join(words(rng, 500))] + ["".join(rng.choices("ab \n", k=30)) for _ in range(50)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    for size in (1, 64, 1 << 20):
        seen = 0
        by_hash = {}
        for p in textkit.pieces(iter([batch]), size=size):
            p.words()
            h = p.word_hashes()
            for k in range(p.rows.num_rows):
                mine = [p.data[a:b].tobytes().decode() for a, b in zip(p.starts[p.first[k] : p.first[k + 1]], p.ends[p.first[k] : p.first[k + 1]])]
                assert mine == (texts[seen] or "").split()
                for w, x in zip(mine, h[p.first[k] : p.first[k + 1]].tolist()):
                    assert by_hash.setdefault(w, x) == x
                seen += 1
        assert seen == len(texts) and len(set(by_hash.values())) == len(by_hash)


def test_window_min():
    v = np.random.default_rng(0).integers(0, 100, 57)
    for width in (1, 2, 9, 57, 60):
        assert textkit.window_min(v, width).tolist() == [v[k : k + width].min() for k in range(len(v) - width + 1)]
