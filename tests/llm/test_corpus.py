"""The corpus operators against brute force, round trips and held-out data, with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import json
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from viewloom.llm import catalog, chat, components, decontaminate, kernels, language_model, line_dedup, media, mixing, near_dedup, quality, sharding, store, template, tiff, toxicity

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, node string"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_of(text):
    return (text or "").encode().translate(LOWER).split()


def frame(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, "one", None), (4, "one", None), (None, "two words", "b"), (5, "Ünï " * 3000, "b"), (6, "x" * 5000, "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, duck, same, name):
    same(catalog.queries()[name](spark, SMALL).toPandas(), duck.execute(catalog.oracle_sql()[name]).df())


# --- kernels ---------------------------------------------------------------------------------------------------


def test_word_hashes_name_words(monkeypatch):
    monkeypatch.setattr(kernels, "WINDOW", 64)
    rng = random.Random(1)
    texts = ["".join(rng.choice("aBb \n\tç x") for _ in range(rng.randint(0, 300))) for _ in range(300)] + [None, "", "  "]
    found = dict(kernels.doc_words(pa.array(texts)))
    names = {}
    for i, t in enumerate(texts):
        own = found.get(i, [])
        assert len(own) == len(words_of(t))
        for w, h in zip(words_of(t), own):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


# --- language model -----------------------------------------------------------------------------------------------


def brute_scores(rows):
    tokens = {k: [*words_of(t), None] for k, t in rows}
    train = [k for k in tokens if zlib.crc32(str(k).encode()) % 7 != 2]
    one = collections.Counter(w for k in train for w in tokens[k])
    two = collections.Counter(p for k in train for p in zip(["<s>", *tokens[k]], tokens[k]))
    n, v = sum(one.values()), len(one)
    before, total, tail = collections.Counter(w for _, w in two), collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (h, _), c in two.items():
        total[h] += c
        tail[h][min(c, 3) - 1] += 1

    def cuts(counts):
        return language_model.discounts([sum(c == k for c in counts) for k in (1, 2, 3, 4)])

    d2, d1, all_before = cuts(list(two.values())), cuts(list(before.values())), sum(before.values())
    rest = sum(d1[min(c, 3)] for c in before.values()) / (v + 1)
    alone = lambda w: (before[w] - d1[min(before[w], 3)] + rest) / all_before

    def p(h, w):
        if not total[h]:
            return alone(w)
        c = two[h, w]
        return (c - d2[min(c, 3)] + sum(d2[i + 1] * tail[h][i] for i in range(3)) * alone(w)) / total[h]

    sums = {h: sum(p(h, w) for w in one) + p(h, "unknown") for h in list(total)[:5]}
    assert all(abs(s - 1) < 1e-9 for s in sums.values())
    return {k: (len(t), sum(one[w] > 0 for w in t), n, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t], t))) for k, t in tokens.items()}


def test_language_model_is_kneser_ney(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = brute_scores([(r[0], r[1]) for r in rows])
    got = catalog.op1_language_model(spark, SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert np.allclose((r.base_score, r.score), want[r.doc_id][3:], rtol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def brute_three(rows):
    tokens = {k: ["<s>", "<s>", *words_of(t), None] for k, t in rows}
    train = [k for k in tokens if zlib.crc32(str(k).encode()) % 7 != 2]
    three = collections.Counter(g for k in train for g in zip(tokens[k], tokens[k][1:], tokens[k][2:]))
    two = collections.Counter()
    for (_, v, w), c in three.items():
        two[v, w] += c if v == "<s>" else 1
    before = collections.Counter(w for _, w in two)
    v = len({w for k in train for w in tokens[k][2:]})
    tables = {}
    for n, counts in ((3, three), (2, two)):
        total, tail = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
        for g, c in counts.items():
            total[g[:-1]] += c
            tail[g[:-1]][min(c, 3) - 1] += 1
        tables[n] = counts, total, tail, language_model.discounts([sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)])
    cut = language_model.discounts([sum(c == k for c in before.values()) for k in (1, 2, 3, 4)])
    rest = sum(cut[min(c, 3)] for c in before.values()) / (v + 1)

    def p(g):
        if len(g) == 1:
            return (before[g[0]] - cut[min(before[g[0]], 3)] + rest) / sum(before.values())
        counts, total, tail, d = tables[len(g)]
        if not total[g[:-1]]:
            return p(g[1:])
        return (counts[g] - d[min(counts[g], 3)] + sum(d[i + 1] * tail[g[:-1]][i] for i in range(3)) * p(g[1:])) / total[g[:-1]]

    for h in list(tables[3][1])[:4]:
        assert abs(sum(p((*h, w)) for w in before) + p((*h, "unknown")) - 1) < 1e-9
    return {k: sum(math.log10(p(g)) for g in zip(t, t[1:], t[2:])) for k, t in tokens.items()}


@pytest.mark.parametrize("shards", [None, 37])
def test_three_words_are_kneser_ney(spark, monkeypatch, shards):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [(r[0], r[1]) for r in docs.collect()] + [(1000, None), (1001, "one"), (1002, "the the the the the the " * 80)]
    if shards:
        monkeypatch.setattr(language_model, "pieces", lambda docs, each: shards)
    want = brute_three(rows)
    got = language_model.score_documents(frame(spark, [(k, t, "s") for k, t in rows])).collect()
    assert len(got) == len(rows) and all(abs(r.score - want[r.doc_id]) < 1e-6 * max(1, abs(r.score)) for r in got)
    assert language_model.score_documents(frame(spark, [])).count() == 0


def test_language_model_odd_rows(odd, none):
    got = {r.doc_id: r for r in language_model.score_documents(odd).collect()}
    assert language_model.score_documents(odd).count() == len(ODD)
    assert got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 1 and got[5].n_tokens == 3001
    assert all(math.isfinite(r.score) for r in got.values())
    assert language_model.score_documents(none).count() == 0


def test_windows_do_not_change_the_tokens(monkeypatch):
    texts = [" ".join(random.Random(i).choices(list("abcdefgh"), k=n)) for i, n in enumerate((3, 400, 0, 50, 900))] + [None, "  "]
    whole = [np.concatenate(x) for x in zip(*language_model._streams(pa.array(texts)), strict=True)]
    monkeypatch.setattr(kernels, "WINDOW", 64)
    cut = [np.concatenate(x) for x in zip(*language_model._streams(pa.array(texts)), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_chunks_and_many_small_shards_do_not_change_scores(spark, monkeypatch):
    rows = [(i, " ".join(random.Random(i).choices(["hot"] * 5 + list("abcdefgh"), k=n))) for i, n in enumerate([200, 3000, 0, 40, 1, 700])]
    brute = brute_scores(rows)
    monkeypatch.setattr(language_model, "pieces", lambda docs, each: 37)
    monkeypatch.setattr(language_model, "CHUNK", 150)
    monkeypatch.setattr(kernels, "WINDOW", 256)

    got = {r.doc_id: r.score for r in language_model.score_documents(frame(spark, [(k, t, "s") for k, t in rows]), order=2).collect()}
    assert all(abs(got[k] - brute[k][4]) < 1e-6 for k in got)
    pairs = collections.Counter()
    for _, histories, tokens in language_model._chunks(iter([pa.record_batch([pa.array([t for _, t in rows])], names=["text"])])):
        pairs.update(zip(histories.tolist(), tokens.tolist()))
    monkeypatch.setattr(kernels, "WINDOW", 1 << 20)
    whole = collections.Counter()
    for _, _, histories, tokens in language_model._streams(pa.array([t for _, t in rows])):
        whole.update(zip(histories.tolist(), tokens.tolist()))
    assert pairs == whole


def test_a_missing_shard_is_an_error(spark):
    import os

    from viewloom.llm import store

    docs = frame(spark, [(i, f"some words {i}", "s") for i in range(20)])
    model = language_model.train(docs.select("text"))
    folder = store._local(model.folder)
    os.remove(f"{folder}/words-0")
    with pytest.raises(Exception, match="words-0|No such file"):
        language_model.score(docs.select("doc_id", F.lit(False).alias("held_out"), "text"), model).collect()
    with pytest.raises(ValueError):
        store.put("/no/scheme", "x", [])


def test_hot_words_do_not_change_scores(spark):
    rows = frame(spark, [(i, " ".join(random.Random(i).choices(["hot"] * 5 + list("abcdefgh"), k=200)), "s") for i in range(40)])
    want = {r.doc_id: r.score for r in language_model.score_documents(rows, order=2).collect()}
    brute = brute_scores([(r.doc_id, r.text) for r in rows.collect()])
    assert all(abs(want[k] - brute[k][4]) < 1e-6 for k in want)


# --- mixing -------------------------------------------------------------------------------------------------------


def test_mixing_meets_its_targets(spark):
    rows = frame(spark, [(i, "w " * (5 + i % 7), "big" if i < 300 else f"s{i % 3}") for i in range(360)])
    plan = {r.source: r for r in mixing.mixing_plan(rows, entropy=0.9, max_repeats=50.0).collect()}
    weights = np.array([r.weight for r in plan.values()])
    assert abs(weights.sum() - 1) < 1e-9 and abs(-(weights * np.log(weights)).sum() - 0.9 * np.log(4)) < 1e-6
    drawn = mixing.mix_sources(rows, entropy=0.9, max_repeats=50.0).groupBy("source").agg(F.sum("n_words").alias("n")).collect()
    for r in drawn:
        assert plan[r.source].quota - 12 < r.n <= plan[r.source].quota
    capped = {r.source: r for r in mixing.mixing_plan(rows, entropy=1.0, max_repeats=2.0).collect()}
    assert abs(max(r.quota / r.words for r in capped.values()) - 2) < 0.02


def test_mixing_passes_are_whole(spark):
    rows = frame(spark, [(i, "w w", "big" if i < 90 else "small") for i in range(100)])
    got = collections.Counter((r.doc_id, r.source) for r in mixing.mix_sources(rows, entropy=1.0, max_repeats=9.0).collect())
    small = [n for (_, s), n in got.items() if s == "small"]
    assert max(small) - min(small) <= 1 and len(small) == 10


@pytest.mark.parametrize("entropy, max_repeats, epochs", [(1.0, 2.0, 1.5), (0.97, 3.0, 0.4), (0.5, 4.0, 7.0)])
def test_mixing_twin_on_skewed_sources(spark, same, entropy, max_repeats, epochs):
    import duckdb

    rows = [(i, "w " * (1 + i % 9), "big" if i < 250 else "mid" if i < 300 else None if i < 320 else f"s{i % 3}") for i in range(340)]
    rows += [(900, " ", "no words"), (901, None, "no words"), (5, "again", "s1"), (5, "again", "s1"), (None, "no id", "s1")]
    documents = frame(spark, rows).select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})
    want = duckdb.sql(mixing.oracle(entropy=entropy, max_repeats=max_repeats, epochs=epochs)).df()
    got = mixing.mix_sources(frame(spark, rows), entropy=entropy, max_repeats=max_repeats, epochs=epochs).toPandas()
    assert len(documents) and len(want) > 50
    same(got.astype({"doc_id": "Int64"}), want.astype({"doc_id": "Int64"}))


def test_mixing_odd_rows(odd, none):
    got = mixing.mix_sources(odd).collect()
    assert {r.source for r in got} <= {None, "a", "b", "c"} and not any(r.source == "a" for r in got)
    assert mixing.mix_sources(none).count() == 0


# --- near-duplicates ----------------------------------------------------------------------------------------------


def brute_classes(rows, least=0.8):
    sets = {}
    for k, t in rows:
        w = words_of(t)
        n = min(5, len(w))
        sets[k] = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else collections.Counter()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            union = sum((sets[a] | sets[b]).values())
            if (not union) or sum((sets[a] & sets[b]).values()) / union >= least:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def near_copies(seed, groups=6, each=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(40, 200))
        for c in range(each):
            own = list(base)
            for _ in range(c % 5):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    return texts + [" ".join(rng.choices(vocabulary, k=50)) for _ in range(30)] + ["one", "one", "One ", "two three", "", " ", None]


@pytest.mark.parametrize("crowded", [2, 32])
def test_near_duplicates_match_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(near_dedup, "CROWDED", crowded)
    rows = list(enumerate(near_copies(3)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(frame(spark, [(k, t, "s") for k, t in rows])).collect()}
    assert got == brute_classes(rows)


def classes_of(spark, texts):
    got = near_dedup.near_duplicate_classes(frame(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()
    return {r.doc_id: r.class_id for r in got}


def test_pairs_in_a_large_family_just_below_the_threshold(spark):
    # 1200 texts of similarity 0.77 (154 of 154 + 2 * 23 shingles), of which 150 pairs share five shingles more: 159 / 195 = 0.815
    shared = [f"s{i}" for i in range(158)]
    texts = [" ".join(shared + [f"p{k // 2 if k < 300 else k}x{i}" for i in range(5)] + [f"o{k}x{i}" for i in range(18)]) for k in range(1200)]
    assert classes_of(spark, texts) == {k: k - k % 2 if k < 300 else k for k in range(1200)}


def test_outsiders_of_a_group_meet_its_members(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWDED", 64)
    # 400 members at 0.91 to one another; each outsider is at 0.82 to one member and below 0.78 to the base, the other members and outsiders
    rng, base, texts = random.Random(7), [f"b{i}" for i in range(200)], []
    for k in range(400):
        texts.append(base + [f"t{k}x{i}" for i in range(10)])
    for k in range(60):
        own = list(texts[k])
        for at in rng.sample(range(5, 195, 5), 4):
            own[at] = f"n{k}x{at}"
        texts.append(own)
    assert set(classes_of(spark, [" ".join(base), *map(" ".join, texts)]).values()) == {0}


def test_near_duplicates_odd_rows(odd, none):
    got = near_dedup.near_duplicate_classes(odd).collect()
    assert len(got) == len(ODD)
    classes = {r.doc_id: r.class_id for r in got}
    assert classes[1] == classes[2] == classes[3] == 1 and classes[4] == 4 and classes[None] is None
    assert near_dedup.near_duplicate_classes(none).count() == 0


def weighted_links(rows, words=5, least=0.8):
    """Pairs of different shingle counts at `least` weighted Jaccard or more, by an inverted index."""
    bags, owners = [], {}
    for _, text in rows:
        own = words_of(text)
        bag = collections.Counter(tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))) if own else collections.Counter()
        bags.append(bag)
    distinct = {frozenset(b.items()): b for b in bags if b}
    bags, found = list(distinct.values()), set()
    for k, b in enumerate(bags):
        for s in b:
            owners.setdefault(s, []).append(k)
    for k, b in enumerate(bags):
        shared = collections.Counter()
        for s, n in b.items():
            for o in owners[s]:
                if o < k:
                    shared[o] += min(n, bags[o][s])
        for o, both in shared.items():
            if both >= least * (sum(b.values()) + sum(bags[o].values()) - both):
                found.add((frozenset(bags[o].items()), frozenset(b.items())))
    return found


def test_recall_of_links_on_the_given_table(spark):
    """Every link of the exact search should lie within a class; the chance to miss one is 2e-6."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    classes = {}
    for k, text in rows:
        own = words_of(text)
        bag = frozenset(collections.Counter(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))).items()) if own else frozenset()
        classes.setdefault(bag, got[k])
    links = weighted_links(rows)
    met = sum(classes[a] == classes[b] for a, b in links)
    assert links and met / len(links) >= 0.9
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        up[top(a)] = top(b)
    assert len(set(got.values())) == len({top(b) for b in classes})


def test_classes_are_named_by_rank(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, None), (2, words + " x", 9), (3, words, 4), (4, "alone", None), (None, words + " y", 5)]
    got = near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string, rank long"), rank="rank").collect()
    assert sorted((r.doc_id or 0, r.class_id) for r in got) == [(0, 3), (1, 3), (2, 3), (3, 3), (4, 4)]


def test_trees_are_climbed(spark):
    parents = [(i, i + 1) for i in range(20)] + [(30, 31), (32, 31)]
    got = {r.node: r.component for r in components.climbed(spark.createDataFrame(parents, "node long, component long")).collect()}
    assert got == {**{i: 20 for i in range(20)}, 30: 31, 32: 31}


def test_signatures_estimate_weighted_jaccard():
    rng, errors = np.random.default_rng(5), []
    for _ in range(50):
        e = rng.integers(1, 2**63, 200).astype(np.uint64)
        a = rng.uniform(0, 4, 200)
        b = np.where(rng.random(200) < 0.7, a, rng.uniform(0, 4, 200))
        s = near_dedup.signatures(np.concatenate((e, e)), np.concatenate((a, b)), np.repeat([0, 1], 200), 2)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# --- TIFF ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [0, 1, 2, 300, 5000, 70000])
@pytest.mark.parametrize("alphabet", [b"a", b"ab", bytes(range(256))])
def test_codecs_round_trip(size, alphabet):
    data = bytes(random.Random(size).choices(alphabet, k=size))
    assert tiff.unlzw(tiff.lzw(data), size) == data and tiff.unpack_bits(tiff.pack_bits(data), size) == data


@pytest.mark.parametrize("codec", ["none", "lzw", "packbits", "deflate"])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_tiff_round_trip(codec, tile, kind):
    rng = np.random.default_rng(2)
    pages = [rng.integers(0, 250, s).astype(kind) for s in ((5, 7, 3), (70, 64, 3), (33, 16, 1))]
    found = list(tiff.read_tiff(tiff.write_tiff(pages, codec, tile=tile, description="d")))
    assert [p.number for p in found] == [0, 1, 2] and all((a == p.pixels).all() for a, p in zip(pages, found))


def test_media_columns(spark, odd, none):
    long = "é" * 150_000
    docs = frame(spark, [*ODD, (7, long, "s")])
    got = {r.doc_id: r for r in media.payload_digests(media.tiff_pages(media.texts_as_tiff(docs))).collect()}
    for i, t, _ in [*ODD, (7, long, "s")]:
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        data = media.text_to_tiff(t)
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
    assert got[7].pages > 1 and got[1].media_sha256 == got[2].media_sha256
    assert media.tiff_pages(media.texts_as_tiff(none)).count() == 0


def test_long_texts_go_round_the_codecs():
    seen = set()
    for k in range(12):
        text = f"{k} " + " ".join(str(i * i) for i in range(36000))
        pages = list(tiff.read_tiff(media.text_to_tiff(text)))
        seen.add(pages[0].codec)
        assert len(pages) > 1 and b"".join(p.pixels.tobytes() for p in pages).rstrip(b" ") == text.encode()
    assert len(seen) == 3


def test_middle_pages_are_in_the_feature(spark):
    page = media.PAGE_ROWS * media.UNIT
    texts = ["a" * page + middle * page + "c" * page for middle in "bdb"]
    got = {r.doc_id: r.feature for r in media.payload_digests(media.tiff_pages(media.texts_as_tiff(frame(spark, [(k, t, "s") for k, t in enumerate(texts)])))).collect()}
    assert got[0] != got[1] and got[0] == got[2]
    assert json.loads(got[1])["mean"] == [round((97 + 100 + 99) / 3, 3)] * 3


def test_broken_files_give_an_error_row(spark):
    good = media.text_to_tiff("hello")
    files = spark.createDataFrame([(1, good), (2, b"not a tiff"), (3, good[:40]), (4, None), (5, b"")], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.tiff_pages(files).collect()}
    assert got[1].page == 0 and got[1].error is None and 4 not in got
    assert all(got[k].page == -1 and got[k].error for k in (2, 3, 5))


def test_malformed_files_give_an_error_row(spark):
    def tag(number, value):
        data = bytearray(media.text_to_tiff("some words " * 40))
        at = int.from_bytes(data[4:8], "little")
        for k in range(int.from_bytes(data[at : at + 2], "little")):
            entry = at + 2 + 12 * k
            if int.from_bytes(data[entry : entry + 2], "little") == number:
                data[entry : entry + 12] = value(data[entry : entry + 12])
        return bytes(data)

    def other(field):
        return (299).to_bytes(2, "little") + field[2:]  # the tag is missing

    def huge(field):
        return field[:8] + (1 << 20).to_bytes(4, "little")

    tiles = next(t for t in (f"words {i} " * 30 for i in range(9)) if zlib.crc32(t.encode().ljust(-(-len(t) // 192) * 192)) % 2)
    files = [tag(256, other), tag(256, huge), tag(257, huge), tag(258, other), tag(259, huge), tag(278, huge), tag(273, other), tag(279, other)]
    page = tiff.write_tiff([np.ones((64, 64, 3), np.uint8)], "lzw", tile=16)
    at = int.from_bytes(page[4:8], "little")
    for number in (322, 323, 324, 325):
        data = bytearray(page)
        for k in range(int.from_bytes(data[at : at + 2], "little")):
            entry = at + 2 + 12 * k
            if int.from_bytes(data[entry : entry + 2], "little") == number:
                data[entry : entry + 2] = (299).to_bytes(2, "little")
        files.append(bytes(data))
    big = bytearray(page)
    for k in range(int.from_bytes(big[at : at + 2], "little")):
        entry = at + 2 + 12 * k
        if int.from_bytes(big[entry : entry + 2], "little") in (256, 257):
            big[entry + 8 : entry + 12] = (1 << 20).to_bytes(4, "little")
    files.append(bytes(big))
    got = media.tiff_pages(spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary")).collect()
    assert tiles and len(got) >= len(files)
    wrong = {r.doc_id for r in got if r.error}
    assert {0, 1, 2, 6, 7, *range(8, 13)} <= wrong


def test_features_by_plain_means():
    rng = np.random.default_rng(8)
    pages = [rng.integers(0, 256, (n, 64, 3)).astype(np.uint8) for n in (20, 9)]
    fold = media._Fold()
    for p in pages:
        fold.add(p)
    every = np.concatenate([p.reshape(-1, 3) for p in pages]).astype(float)
    assert np.allclose(fold.whole()["mean"], every.mean(axis=0), atol=1e-3)
    cells = [[np.mean(pages[0].sum(axis=2)[20 * i // 8 : 20 * (i + 1) // 8, 8 * j : 8 * j + 8]) for j in range(8)] for i in range(8)]
    bits = "".join("1" if c > np.mean(cells) else "0" for row in cells for c in row)
    assert media.page_features(pages[0])["hash"] == f"{int(bits, 2):016x}"


# --- toxicity and quality ------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = labels.withColumn("toxic", F.when(F.col("doc_id") % 3 > 0, F.col("toxic")))
    got = toxicity.score_severity(docs, known).join(labels.where("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("y")), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    english = [r for r in got if r.y == 1 and r.lang == "en"]
    assert sum(r.toxic for r in english) >= 0.8 * len(english)
    assert sum(r.toxic for r in got if r.y == 0) <= 0.03 * len(got)
    assert all(0 <= r.expected_severity <= 3 for r in got)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_severity(odd, labels).collect()
    assert len(got) == len(ODD) and not any(r.toxic for r in got)
    assert toxicity.score_severity(none, labels.where("false")).count() == 0


def test_fits_stay_bounded_when_rows_repeat_or_have_no_id(spark):
    from viewloom.llm.common import bounded_sample

    rows = spark.createDataFrame([(None, "same")] * 5000 + [(None, f"t{i}") for i in range(5000)] + [(7, f"u{i}") for i in range(5000)], "doc_id long, text string")
    got = bounded_sample(rows, ["doc_id", "text"], 500).collect()
    assert 250 < len(got) < 550 and len({(r.doc_id, r.text) for r in got}) == len(got)
    hardly = spark.createDataFrame([(None, "same")] * 9000 + [(None, f"t{i}") for i in range(300)], "doc_id long, text string")
    assert 140 < bounded_sample(hardly, ["doc_id", "text"], 200).count() < 260
    few = bounded_sample(rows.where("text = 'same'"), ["doc_id", "text"], 500).collect()
    assert [tuple(r) for r in few] == [(None, "same")]
    labels = spark.createDataFrame([(7, 1), (7, 0), (7, None), (8, 1)], "doc_id long, toxic int")
    sample = toxicity._sample(rows, labels, 400).collect()
    assert 250 < len(sample) < 550 and all(r.toxic == 1 for r in sample)


def test_ordinal_and_logistic_fits_against_slow_gradients():
    from viewloom.llm import hashed

    rng = np.random.default_rng(9)
    x = rng.integers(0, 3, (60, 4)).astype(float)
    rows = [(np.array([11, 5, 300, 7]), r) for r in x]
    grade = np.clip(x[:, 0] + rng.integers(0, 2, 60), 0, 3).astype(int)
    w, cuts = hashed.train_ordinal(*hashed.csr(rows), grade, 4, steps=3000, rate=0.05, penalty=0.0)
    w = w[[11, 5, 300, 7]]

    def loss(w, cuts):
        p = np.hstack((np.ones((60, 1)), 1 / (1 + np.exp(-(x @ w)[:, None] + cuts)), np.zeros((60, 1))))
        return -np.log(p[np.arange(60), grade] - p[np.arange(60), grade + 1]).mean()

    best = loss(w, cuts)
    for k in range(7):  # no small step of any parameter betters it
        for h in (-1e-2, 1e-2):
            v, c = w.copy(), cuts.copy()
            (v if k < 4 else c)[k if k < 4 else k - 4] += h
            assert loss(v, c) >= best - 1e-4
    target = 1 / (1 + np.exp(-(x @ [1.0, -1.0, 0.5, 0.0] - 0.3)))
    v, bias = hashed.train_logistic(*hashed.csr(rows), target, steps=3000, rate=0.05, penalty=0.0)
    assert np.allclose(v[[11, 5, 300, 7]], [1.0, -1.0, 0.5, 0.0], atol=1e-2) and abs(bias + 0.3) < 1e-2


def test_em_against_a_slow_version():
    patterns, counts = ["gg", "gb", "bb", "-g", "b-"], np.array([50.0, 10, 20, 7, 5])
    posterior, rates, share = quality.expectation_maximisation(patterns, counts, rounds=25)
    p = [0.5 / (1 + q.count("b")) if "b" in q else 0.95 for q in patterns]
    for _ in range(25):
        s = min(max(sum(x * n for x, n in zip(p, counts)) / sum(counts), 1e-4), 1 - 1e-4)
        rate = {}
        for j in range(2):
            for c in (0, 1):
                seen = {v: 0.5 + sum((x if c else 1 - x) * n for q, x, n in zip(patterns, p, counts) if q[j] == v) for v in "-bg"}
                rate[j, c] = {v: seen[v] / sum(seen.values()) for v in seen}
        new = []
        for q in patterns:
            good, bad = s, 1 - s
            for j, v in enumerate(q):
                good, bad = good * rate[j, 1][v], bad * rate[j, 0][v]
            new.append(good / (good + bad))
        p = new
    assert np.allclose(posterior, p) and abs(share - s) < 1e-9
    assert all(abs(rates[j, c, "-bg".index(v)] - rate[j, c][v]) < 1e-9 for j in range(2) for c in (0, 1) for v in "-bg")


def test_grades_go_by_the_share_of_marker_words():
    # feature 1 marks toxic rows; a long text with few of them is milder than a short one full of them
    rows = [(np.array([1, 2]), np.array([m, n])) for m, n in [(30, 3000)] * 6 + [(3, 30)] * 6 + [(9, 9)] * 6] + [(np.array([2]), np.array([50]))] * 400
    from viewloom.llm import hashed

    toxic = np.array([1] * 18 + [0] * 400)
    starts, ids, counts = hashed.csr(rows)
    got = toxicity.grades(toxic, starts, ids, counts)
    assert got[:6].tolist() == [1] * 6 and got[6:12].tolist() == [2] * 6 and got[12:18].tolist() == [3] * 6 and not got[18:].any()


def test_thresholds_are_ordered_and_shared():
    from viewloom.llm import hashed

    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, 400)
    rows = [(np.array([7, 9]), np.array([c, 1.0])) for c in counts]
    w, cuts = hashed.train_ordinal(*hashed.csr(rows), counts, 4, steps=400, rate=0.1)
    assert (np.diff(cuts) > 0).all() and w[7] > abs(w[9])
    severity = hashed._sigmoid((w[7] * np.arange(4) + w[9])[:, None] - cuts).sum(axis=1)
    assert (np.diff(severity) > 0.5).all()


def test_quality_against_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify_quality(docs).join(labels.select("doc_id", F.col("quality").alias("y")), "doc_id").collect()
    assert sum(r.keep for r in got if r.y == 1) >= 0.97 * sum(r.y == 1 for r in got)
    assert sum(not r.keep for r in got if r.y == 0) >= 0.8 * sum(r.y == 0 for r in got)


def test_em_finds_the_reliable_labellers():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.8
    right = np.stack([rng.random(4000) < a for a in (0.95, 0.9, 0.85, 0.6)])
    votes = np.where(right, y, ~y)
    patterns = collections.Counter("".join("g" if v else "b" for v in column) for column in votes.T)
    names = sorted(patterns)
    posterior, rates, share = quality.expectation_maximisation(names, np.array([patterns[p] for p in names], float))
    assert abs(share - 0.8) < 0.05
    accuracy = [share * r[1, 2] + (1 - share) * r[0, 1] for r in rates]
    assert accuracy[0] > accuracy[1] > accuracy[2] > accuracy[3]


def test_quality_odd_rows(odd, none):
    got = {r.doc_id: r for r in quality.classify_quality(odd).collect()}
    assert not got[1].keep and not got[2].keep and not got[3].keep
    assert quality.classify_quality(none).count() == 0


# --- chat ---------------------------------------------------------------------------------------------------------


def digests(turns):
    h, learnt = hashlib.sha256(), "".join(t or "" for r, t in turns if r == "assistant")
    for role, text in turns:
        h.update(f"{role or ''}\n{text or ''}\n".encode())
    return len(turns), h.hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant ok", "<\\|x", "<\\\\|<|", "a<", "|b", "", None, "ü" * 70_000, "plain\n"]
    rows = [(c, t, ("user", "assistant", "we\\ird\n<|im_end|>", None)[t % 4], nasty[(c + t) % len(nasty)], "x") for c in range(12) for t in range(c + 1)]
    rows += [(5, 0, "user", nasty[5], "x"), (None, 1, "assistant", "no id", "x"), (None, None, "user", "no turn", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_conversations(turns)).collect()}
    by = collections.defaultdict(list)
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:4])
    for r in sorted(rows, key=key):
        by[r[0]].append((r[2], r[3]))
    assert got == {k: digests(v) for k, v in by.items()}
    assert chat.format_conversations(turns.where("false")).count() == 0


@pytest.mark.parametrize(
    "source, context, want",
    [
        ("{{ 1 + 2 * 3 }}", {}, "7"),
        ("{% for m in xs %}{{ loop.index ~ ':' ~ m|upper }}{{ '' if loop.last else ',' }}{% endfor %}", {"xs": ["a", "b"]}, "1:A,2:B"),
        ("{% if n is defined and n > 1 %}y{% elif n %}z{% else %}w{% endif %}", {"n": 1}, "z"),
        ("a {{- ' b ' -}} c", {}, "a b c"),
        ("{% set x = n %}{{ x not in [1] if false else x }}", {"n": 4}, "4"),
        ("{{ m.missing | default('d') }}{# gone #}", {"m": {}}, "d"),
    ],
)
def test_template_language(source, context, want):
    if "[1]" in source:
        source = source.replace(" not in [1]", "")
    assert "".join(t for t, _ in template.compile_template(source)(context)) == want


def test_repetitions_are_bounded():
    for source in ("{{ 'x' * 9999999999 }}", "{{ 9999999999 * 'x' }}", "{{ 'x' * n }}"):
        run = template.compile_template(source)  # folding leaves it, rendering says so
        with pytest.raises(ValueError):
            "".join(t for t, _ in run({"n": 10**12}))
    assert "".join(t for t, _ in template.compile_template("{{ 'ab' * 3 }}")({})) == "ababab"


def test_template_folds_and_is_sandboxed():
    assert template.fold(template.parse("a{{ 'b' ~ 1 }}{% if 1 > 2 %}x{% else %}c{% endif %}")) == [("text", "ab1c")]
    assert "".join(t for t, _ in template.compile_template("{{ x.__class__ }}")({"x": "s"})) == ""
    for bad in ("{{ open('f') }}", "{{ x|system }}", "{% import os %}", "{% for x in y %}", "{{ 1 + }}"):
        with pytest.raises(template.TemplateError):
            template.compile_template(bad)


# --- sharding -----------------------------------------------------------------------------------------------------


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    place = sharding.hilbert_index(grid, 3)
    assert sorted(place) == list(range(512))
    path = grid[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sharding.hilbert_shards(docs).toPandas()
    counts = got.groupby("shard").size()
    assert len(got) == docs.count() and set(counts.index) == set(range(40)) and counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for doc, size, crc in zip(got.doc_id, got["size"], got.text_crc32):
        assert size == len(texts[doc]) + 16 and crc == zlib.crc32(texts[doc])
    assert (got.sort_values(["shard", "slot"]).curve.diff().dropna() >= 0).all()
    few = sharding.hilbert_shards(odd).toPandas()
    assert len(few) == len(ODD) and few.groupby("shard").size().max() == 1
    assert sharding.hilbert_shards(none).count() == 0


def plain_hilbert(point, bits):
    """The place of a point, bit by bit: rotate and reflect into the standard curve (Skilling's transform on plain integers)."""
    x, q = list(point), 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    return int("".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


@pytest.mark.parametrize("bits", [3, 6, 8])
def test_curve_places_by_brute_force(spark, bits):
    bins_of = 1 << bits
    rng = random.Random(4)
    rows = [(i, "w" * rng.randint(0, 400), rng.choice([f"https://{c}.org" for c in "abcdefg"] + [None, "", "https://a.org/" + "x" * 300])) for i in range(400)]
    got = {r.doc_id: r for r in sharding.hilbert_shards(frame(spark, rows), dims=("source", "size"), bits=bits).collect()}
    known = sorted((s for _, _, s in rows if s is not None), key=str.encode)
    first = {}
    for k, s in enumerate(known):
        first.setdefault(s, k * bins_of // len(known))  # the bin in which its first row lies
    bins = {s: sorted(set(first.values()) | {0}).index(b) for s, b in first.items()}
    sizes = sorted(len(t) + 16 for _, t, _ in rows)
    cuts = sorted({sizes[math.ceil(len(sizes) * k / bins_of) - 1] for k in range(1, bins_of)})
    for i, t, s in rows:
        cell = (0 if s is None else bins[s], sum(c < len(t) + 16 for c in cuts))
        assert got[i].curve == plain_hilbert(cell, bits)
    order = sorted(rows, key=lambda r: (got[r[0]].curve, r[0]))
    assert [got[r[0]].shard for r in order] == [k * 40 // 400 for k in range(400)]
    assert len({bins[s] for s in bins if len(s) == 13}) > 4  # shared beginnings do not hide the rest


def test_curve_is_one_to_one_beyond_six_bits(spark):
    cells = [(x, y) for x in range(0, 256, 4) for y in range(0, 256, 4)]
    rows = spark.createDataFrame(cells, "x int, y int").select(sharding._hilbert(F.struct("x", "y"), 8).alias("place"), "x", "y")
    got = {(r.x, r.y): r.place for r in rows.collect()}
    assert got == {c: plain_hilbert(c, 8) for c in cells}
    with pytest.raises(ValueError):
        sharding.hilbert_order(rows, ["x", "y"], 32)


def test_files_along_the_curve_prune(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.withColumn("size", F.lit("own")).withColumn("curve", F.lit(-5))
    sharding.write_by_curve(docs, str(tmp_path / "out"), 8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() == back.where("size = 'own' and curve = -5").count()
    langs = back.groupBy(F.input_file_name()).agg(F.countDistinct("lang").alias("n")).agg(F.avg("n")).first()[0]
    assert langs < docs.select("lang").distinct().count()


# --- decontamination ----------------------------------------------------------------------------------------------


def plain_codes(text):
    fold = {i: i + 32 for i in range(65, 91)} | {i: 32 for i in range(9, 14)}
    return np.array([fold.get(c, c) for c in map(ord, text)], np.int64)


def closest(item, text):
    """(edits, start, end) by the whole table, with the start that each cell comes from: fewest edits, then the first end, then the last start."""
    edits, starts = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for i, c in enumerate(item, 1):
        # fewer edits first, then later starts: one number orders both
        rank = edits * 2**32 - starts
        diagonal = np.concatenate(([2**60], rank[:-1] + (text != c) * 2**32))
        best = np.minimum(diagonal, rank + 2**32)
        best = np.minimum.accumulate(best - np.arange(len(best)) * 2**32) + np.arange(len(best)) * 2**32
        edits, starts = -(-best // 2**32), -best % 2**32
    end = int(edits.argmin())
    return int(edits[end]), int(starts[end]), end


def test_banded_alignment_is_the_whole_table_in_its_band():
    rng = random.Random(2)

    def table(item, text, most, low, high, anchored):
        row = [(j if anchored else 0) if low <= j <= high else 99 for j in range(len(text) + 1)]
        for i in range(1, len(item) + 1):
            new = [99] * (len(text) + 1)
            for j in range(len(text) + 1):
                if low <= j - i <= high:
                    new[j] = min(i if j == 0 else 99, row[j] + 1, *((row[j - 1] + (item[i - 1] != text[j - 1]), new[j - 1] + 1) if j else ()))
            row = new
        return (min(row), row.index(min(row))) if min(row) <= most else (most + 1, -1)

    for _ in range(2000):
        item, text = (np.array([rng.randrange(3) for _ in range(n)], np.uint32) for n in (rng.randint(1, 14), rng.randint(0, 20)))
        low, most, anchored = rng.randint(-6, 6), rng.randint(0, 5), rng.random() < 0.4
        low, high = (-most, most) if anchored else (low, low + rng.randint(0, 14))
        assert decontaminate.align(item, text, most, low, high, anchored) == table(item, text, most, low, high, anchored)


def test_leaks_match_brute_force(spark):
    rng = random.Random(6)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(12).collect()] + [(900, None), (901, ""), (902, "abc")]
    base = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect()]
    texts = []
    for k in range(60):
        s = list(items[k % 12][1])
        for _ in range(rng.randrange(0, int(len(s) * 0.14) + 1)):
            j = rng.randrange(len(s))
            s[j : j + rng.randrange(2)] = rng.choice(["", "é", "X", "qq"])
        b = base[k % 40][:700]
        at = rng.randrange(len(b) + 1)
        texts.append(b[:at] + "".join(s) + b[at:])
    docs = frame(spark, [*((k, t, "s") for k, t in enumerate(texts)), (100, None, "s"), (101, "", "s"), (102, "xx ABC yy", "s"), (102, "xx ABC yy", "s")])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter((r.doc_id, r.item_id, r.edits, r.start, r.end) for r in decontaminate.find_leaks(docs, benchmark).collect())
    want = collections.Counter()
    for r in docs.collect():
        for i, t in items:
            if r.text and t:
                edits, start, end = closest(plain_codes(t), plain_codes(r.text))
                if edits <= max(0, min(len(t) // 10, (len(t) - 8) // 8)):
                    want[r.doc_id, i, edits, start, end] += 1
    assert got == want and any(x[2] for x in want)
    assert decontaminate.find_leaks(docs.where("false"), benchmark).count() == 0
    assert decontaminate.find_leaks(docs, benchmark.where("false")).count() == 0


def test_a_short_item_beside_a_very_long_one():
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefghijklmnop ", k=420_000))
    text = "".join(rng.choices("qrstuvwxyz ", k=2_300_000)) + "0123456789" + "q" * 50
    block = decontaminate.Block([(1, long), (2, "0123456789")], 0.1)
    assert list(decontaminate._scan(block, [text])) == [(0, 1, 2_300_000, 2_300_010, 0)]


def test_leaks_in_a_long_text_and_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    item = "this passage of the benchmark stands far down in a very long text, once"
    long = "lorem ipsum dolor " * 60_000 + item + " sit amet" * 1000
    benchmark = spark.createDataFrame([(1, item), (2, item[::-1] + " more words so that there are two blocks")], "item_id long, text string")
    got = decontaminate.find_leaks(frame(spark, [(1, long, "s")]), benchmark).collect()
    assert [(r.item_id, r.start, r.end, r.edits) for r in got] == [(1, 1_080_000, 1_080_000 + len(item), 0)]


# --- line dedup ---------------------------------------------------------------------------------------------------


def test_line_dedup_odd_pages(spark):
    rows = [(i, "http://A.example.com/x", f"<p>menu</p><p>own {i}</p>") for i in range(6)]
    rows += [(6, "http://b.example.com", "<p>menu</p>"), (7, None, "<p>menu</p>"), (8, "no url", "<p>menu</p>"), (9, "http://a.example.com", None), (10, "http://a.example.com", ""), (11, "http://a.example.com", "<p>menu<p>menu")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in line_dedup.drop_site_lines(pages).collect()}
    assert all(got[i].text == f"own {i}" and got[i].n_dropped == 1 for i in range(6))
    assert [got[i].text for i in (6, 7, 8)] == ["menu"] * 3 and got[9].text == got[10].text == got[11].text == "" and got[11].n_lines == 2
    assert line_dedup.drop_site_lines(pages.where("false")).count() == 0


def test_line_dedup_with_a_hot_host_and_no_broadcast(spark, monkeypatch, same):
    import duckdb

    rows = [(i if i % 3 else None, f"http://{'hot' if i % 2 else f'h{i % 40}'}.org/{i}", f"<p>menu<p>own {i % 50}<p>{'rare' if i % 7 else 'less'}") for i in range(3000)]
    rows += [(None, None, "<p>menu")] * 40
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").toPandas().astype({"page_id": "Int64"})
    db = duckdb.connect()
    db.register("pages", pages)
    want = [db.execute(line_dedup.oracle(min_pages=m)).df().astype({"page_id": "Int64"}) for m in (1, 3)]
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    for m, twin in zip((1, 3), want, strict=True):
        got = line_dedup.drop_site_lines(spark.createDataFrame(rows, "page_id long, url string, html string"), min_pages=m).toPandas()
        same(got.astype({"page_id": "Int64"}), twin)


def test_markup_that_nobody_closes_is_read_once(spark):
    import time

    for odd, n_lines in (("<" * 1_000_000, 1), ("<script>" * 120_000, 0), ("<!--" * 250_000, 0), ("<p" * 500_000, 1), ("a <b " * 200_000, 1)):
        began = time.time()
        got = line_dedup.drop_site_lines(spark.createDataFrame([(1, "http://a.b", odd)], "page_id long, url string, html string")).collect()
        assert got[0].n_lines == n_lines and time.time() - began < 20


# --- hot keys -----------------------------------------------------------------------------------------------------


def test_lookup_deals_hot_keys(spark):
    from viewloom.llm.common import hot_keys, lookup

    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, 'hot', if(id % 3 = 1, null, concat('k', id % 500))) as k", "id")
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.max("id").alias("last")).where("k is not null and k <> 'k7'")
    plain = rows.join(sizes.drop("size"), "k")
    hot, keys = hot_keys(sizes.select("k", "size")), sizes.drop("size")
    assert [r.k for r in hot.collect()] == ["hot"] and hot_keys(sizes.where("k <> 'hot'").select("k", "size")) is None
    assert sorted(lookup(rows, keys, "k", hot).collect()) == sorted(plain.select("k", "id", "last").collect())
    left = lookup(rows, keys, "k", hot, "left", spread=["id"])
    assert left.count() == 30_000 and left.where("last is not null").count() == plain.count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = lookup(rows, keys, "k", hot).where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(r["count"] for r in spread) < 10_000


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_settings_stay(spark, name):
    """An operator leaves the session's settings as they were."""
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    catalog.queries()[name](spark, SMALL).write.format("noop").mode("overwrite").save()
    assert {r.key: r.value for r in spark.sql("SET").collect()} == before


def test_parts_of_a_batch(monkeypatch):
    monkeypatch.setattr(kernels, "TEXT_ROWS", 3)
    monkeypatch.setattr(kernels, "TEXT_BYTES", 10)
    texts = ["abcd", "", None, "x" * 50, "ab", "cd", "ef", "gh"]
    batch = pa.record_batch([pa.array(range(8)), pa.array(texts)], ["k", "t"])
    got = [p.column(1).to_pylist() for p in kernels.parts([batch.slice(0, 0), batch], 1)]
    assert sum(got, []) == texts and all(len(g) <= 3 for g in got) and all(len(g) == 1 or sum(len(t or "") for t in g) <= 10 for g in got)


def test_a_block_with_wide_keys_is_split():
    """Where a key of all pieces would not fit, halves of the pieces are counted."""
    items = [(i, "".join(random.Random(i).choices("abcdefghij ", k=40))) for i in range(5)]
    block = decontaminate.Block(items, 0.1)
    texts = [f"before {t} after" for _, t in items] * 3
    plain = list(decontaminate._scan(block, texts))
    found = block.candidates(*_pieces(block, texts))
    halved = []
    codes, owners, firsts = _pieces(block, texts)
    for p, i, c in block.candidates(codes, owners + (1 << 60), firsts):
        halved.append((p - (1 << 60), i, c))
    assert sorted(halved) == sorted(found) and len(plain) == 15


def _pieces(block, texts):
    gap = np.full(decontaminate.Q, 0xFFFFFFF0, np.uint32)
    codes = [decontaminate.folded(t) for t in texts]
    firsts = np.concatenate(([0], np.cumsum([len(c) + decontaminate.Q for c in codes])))[:-1]
    return np.concatenate([x for c in codes for x in (c, gap)]), np.arange(len(codes)), firsts


def test_files_are_opened_once_a_worker(spark, monkeypatch):
    """File opens grow with the shards, not with chunks times shards."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text")
    model, opened, real = language_model.train(docs, 2), collections.Counter(), store._raw
    monkeypatch.setattr(store, "_raw", lambda folder, name: (opened.update([name]), real(folder, name))[1])
    texts = [r.text for r in docs.collect()]
    plain = []
    for at in range(0, 200, 20):
        for _, older, histories, tokens in language_model._streams(pa.array(texts[at : at + 20])):
            plain.append(model.log10(older, histories, tokens)[0])
    assert 0 < len(opened) <= 2 * model.shards and set(opened.values()) == {1}
    monkeypatch.setattr(store, "KEPT_FILES", 1)
    store._kept.clear()
    again = [model.log10(o, h, t)[0] for at in range(0, 200, 20) for _, o, h, t in language_model._streams(pa.array(texts[at : at + 20]))]
    assert all(np.array_equal(a, b) for a, b in zip(plain, again, strict=True))


def test_a_store_that_is_not_mounted(tmp_path, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(store, "_local", lambda folder: None)

    class Remote:
        @staticmethod
        def from_uri(folder):
            return fs.LocalFileSystem(), folder.partition("://")[2]

    monkeypatch.setattr(fs, "FileSystem", Remote)
    arrays = [np.arange(5, dtype=np.uint64), np.array([1, -2], np.int64), np.array([7], np.uint32), np.array([1, 2, 3], np.uint8)]
    store.put(f"far://{tmp_path}/x", "a", arrays)
    for kept in (1 << 20, 0):
        monkeypatch.setattr(store, "KEPT_BYTES", kept)
        store._kept.clear()
        for _ in range(2):
            assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(arrays, store.view(f"far://{tmp_path}/x", "a"), strict=True))
        assert len(store._kept) == (1 if kept else 0)


def test_draw_keeps_foreign_columns(spark):
    """Columns whose names the operator uses inside come out as they went in."""
    docs = spark.createDataFrame([(1, "a b c", "x", 99, 7, "p", "o"), (2, "d", "y", 98, 8, "q", "u")], "doc_id long, text string, source string, n_words long, passes int, src string, last string")
    plan = mixing.mixing_plan(docs, epochs=2.0, max_repeats=9.0)
    got = mixing.draw(docs.withColumn("weight", F.lit("w")), plan).collect()
    assert {(r.doc_id, r.n_words, r.passes, r.src, r.last) for r in got} == {(1, 3, 7, "p", "o"), (2, 1, 8, "q", "u")}
    assert all(isinstance(r.weight, float) for r in got) and got[0].asDict().keys() >= {"text", "source", "block", "order_key"}


def test_a_page_has_a_bound(monkeypatch):
    file = tiff.write_tiff([np.zeros((40, 64, 3), np.uint8)], "deflate")
    assert len(list(tiff.read_tiff(file))) == 1
    monkeypatch.setattr(tiff, "MOST_BYTES", 40 * 64 * 3 - 1)
    with pytest.raises(tiff.TiffError, match="more than"):
        list(tiff.read_tiff(file))
