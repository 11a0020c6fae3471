"""Packing, vector codes and lexical search against plain versions of what they say, with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from viewloom.llm import catalog, lexical, packing, tokens, vector_codes
from viewloom.llm.packing import Example, Limits, Packer

public = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"
FILE = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(open(FILE, encoding="utf-8").read())


# --- tokens --------------------------------------------------------------------------------------------------------


def exact(encoder, text):
    return encoder.exact.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aé'sdt 1\n\t!Zß  ", max_size=60)))
def test_ids_are_those_of_the_library(text):
    own = test_ids_are_those_of_the_library
    own.encoder = getattr(own, "encoder", None) or tokens.Encoder(open(FILE, encoding="utf-8").read())
    assert own.encoder.ids([text])[0].tolist() == exact(own.encoder, text)


def test_ids_of_odd_texts(encoder, monkeypatch):
    assert encoder.fast is not None
    odd = ["", "x" * 5000, " " * 5000, "\n \t" * 2000, "a <|endoftext|> b", "Привет, мир", "日本語" * 50, "a b \x1c c", "don't 'S we'll 12345"]
    for text in odd:
        assert encoder.ids([text])[0].tolist() == exact(encoder, text)
    assert [len(x) for x in encoder.ids([None, ""])] == [0, 0]
    text = "".join(random.Random(1).choices("ab c'.\n d1", k=5000))
    parts = list(tokens.windows(text, 100))
    assert "".join(parts) == text and len(parts) > 20
    assert [i for p in parts for i in exact(encoder, p)] == exact(encoder, text)


# --- packing -------------------------------------------------------------------------------------------------------


def sequences(examples, limits, least_cut=16, cut=True):
    packer, found = Packer(limits, least_cut, cut), []
    for e in examples:
        found += packer.add(e)
        if len(packer) >= packing.POOL - 1:
            found += packer.filled(packing.FILL_FROM)
    return found + list(packer.filled(0))


def some_examples(seed, count, longest, masks=True):
    rng, found = random.Random(seed), []
    for k in range(count):
        ids = np.array([rng.randrange(50_000) for _ in range(rng.randint(1, longest))], np.uint32)
        mask = np.array([rng.random() < 0.4 for _ in ids], np.int64) if masks and k % 3 else None
        found.append(Example(k, k, ids, mask))
    return found


def covered(examples, found):
    pieces = collections.defaultdict(list)
    for sequence in found:
        for e, start, end in sequence:
            pieces[e.row].append((start, end))
    for e in examples:
        own = sorted(pieces[e.row])
        assert [s for s, _ in own] == [0, *(x for _, x in own[:-1])] and own[-1][1] == len(e.ids)


@pytest.mark.parametrize("limits", [Limits(), Limits(512, 4, 512), Limits(512, 64, 100), Limits(300, 3, 40)])
def test_sequences_keep_all_limits_at_once(limits):
    examples = some_examples(1, 400, 900)
    found = sequences(examples, limits)
    covered(examples, found)
    for s in found:
        assert sum(end - start for _, start, end in s) <= limits.tokens and len(s) <= limits.segments
        assert sum(e.loss(start, end) for e, start, end in s) <= limits.loss


def test_little_padding():
    examples = some_examples(2, 3000, 5000, masks=False)
    found = sequences(examples, Limits())
    covered(examples, found)
    sizes = [sum(end - start for _, start, end in s) for s in found]
    padding = sum(packing._padding(n, 2048) for n in sizes)
    assert padding < 0.002 * sum(sizes)
    assert sum(map(len, found)) < 1.2 * (len(examples) + sum(sizes) / 2048)  # and few cuts


def test_whole_examples_stay_whole_without_cut():
    examples = some_examples(3, 500, 400)
    found = sequences(examples, Limits(512, 8, 200), cut=False)
    covered(examples, found)
    split = {e.row for s in found for e, start, end in s if end - start < len(e.ids)}
    assert split == {e.row for e in examples if e.loss(0, len(e.ids)) > 200}  # only what breaks a limit by itself
    sizes = [sum(end - start for _, start, end in s) for s in found]
    assert all(a + b > 512 or len(s) == 8 for a, b, s in zip(sizes, sizes[1:], found)) or sum(sizes) / len(sizes) > 256


def test_the_largest_dot_product_goes_next():
    """Against a plain loop over the examples that fit."""
    limits = Limits(256, 5, 90)
    examples = some_examples(4, 200, 200)
    examples = [e for e in examples if e.loss(0, len(e.ids)) <= 90]
    packer = Packer(limits, 10**9, True)  # nothing is cut
    for e in examples:
        assert list(packer.add(e)) == []
    demand = [np.mean([len(e.ids) for e in examples]), 1, np.mean([e.loss(0, len(e.ids)) for e in examples])]
    waiting = [packer.examples[i] for i in range(packing.POOL)]
    while len(packer):
        left, plain = [256, 5, 90], []
        while left[0] and left[1]:
            fits = [(k, e) for k, e in enumerate(waiting) if e and len(e.ids) <= left[0] and e.loss(0, len(e.ids)) <= left[2]]
            if not fits:
                break
            price = [d / c * x / c / c for d, c, x in zip(demand, (256, 5, 90), left)]  # mean demand, what is left and demand, each as a share of the limit
            k, e = max(fits, key=lambda x: (round(price[0] * len(x[1].ids) + price[2] * x[1].loss(0, len(x[1].ids)), 12), -x[0]))
            plain.append(e.row)
            waiting[k] = None
            left = [left[0] - len(e.ids), left[1] - 1, left[2] - e.loss(0, len(e.ids))]
        assert [e.row for e, _, _ in packer._sequence()] == plain


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, start long, sequence_id string")


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (None, "no id"), (5, "long text, " * 4000), (6, "x" * 9000), (None, "no id"), (7, "Привет")]


def check_pieces(rows, texts, encoder):
    """`rows`: what pack_documents gave; `texts`: multiset of (doc_id, text)."""
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_row].append(r)
        seqs[r.sequence_id].append(r)
    expected = collections.Counter()
    for k, t in texts:
        ids = np.array(exact(encoder, t or "") + [1], "<u4")
        expected[k, len(ids), zlib.crc32(ids.tobytes())] += 1
    by_ids = {(k, np.array(exact(encoder, t or "") + [1], "<u4").tobytes()) for k, t in texts}
    whole = {(k, len(b) // 4): [] for k, b in by_ids}
    for k, b in by_ids:
        whole[k, len(b) // 4].append(np.frombuffer(b, "<u4"))
    found = collections.Counter()
    for own in pieces.values():
        own.sort(key=lambda r: r.start)
        at = 0
        fits = [ids for ids in whole[own[0].doc_id, own[0].doc_tokens]]
        for r in own:
            assert r.start == at and r.length > 0
            fits = [ids for ids in fits if zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
            at += r.length
        assert at == own[0].doc_tokens and len(fits) >= 1
        found[own[0].doc_id, at, zlib.crc32(fits[0].tobytes())] += 1
    assert found == expected
    for own in seqs.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
        size = sum(r.length for r in own)
        assert size <= 2048 and {r.padding for r in own} == {0 if size & (size - 1) == 0 else 2048 - size}
    return seqs


def test_documents_are_packed(spark, encoder):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = catalog.queries()["op11_packing"](spark, SMALL).collect()
    seqs = check_pieces(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], encoder)
    tokens_of = sum(r.length for r in rows)
    assert sum(own[0].padding for own in seqs.values()) < 0.01 * tokens_of


def test_odd_documents_are_packed(spark, encoder):
    check_pieces(packing.pack_documents(documents(spark, ODD).repartition(3), FILE).collect(), ODD, encoder)
    assert packing.pack_documents(documents(spark, []), FILE).collect() == []


def test_instruction_examples_are_packed(spark):
    rng = random.Random(5)
    sizes = [rng.randint(0, 60) for _ in range(200)]
    rows = [(k, [rng.randrange(900) for _ in range(n)], [j > n // 2 for j in range(n)], 3) for k, n in enumerate(sizes)] + [(None, None, None, 3), (201, [5, 6], [None], 3)]
    frame = spark.createDataFrame(rows, "doc_id long, ids array<int>, loss array<boolean>, length int")
    limits = Limits(128, 6, 30)
    got = packing.pack_examples(frame, limits, loss="loss", cut=False).collect()
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
    assert sorted(r.doc_id for r in got) == sorted(k for k, ids, _, _ in rows if ids)
    for own in seqs.values():
        assert sum(r.length for r in own) <= 128 and len(own) <= 6 and sum(r.loss_tokens for r in own) <= 30
    assert {r.doc_id: r.loss_tokens for r in got} == {k: sum(bool(x) for x in m) for k, ids, m, _ in rows if ids}


# --- vector codes --------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(id, code, error, label_error), digest, with Python integers; `rows`: (id, vector, label)."""
    kept = [(k, [math.floor(256 * x) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-len(kept[0][1]) // parts)
    cut = lambda v: [(v + [0] * (width * parts - len(v)))[p * width : p * width + width] for p in range(parts)]
    vectors = [cut(v) for _, v, _ in kept]
    first = sorted((k, v) for k, v, _ in kept if k is not None)[:entries]
    books = [[cut(v)[p] for _, v in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for v in vectors:
                groups[near(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if groups[i] else e for i, e in enumerate(books[p])]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in vectors]
    errors = [sum(d for d, _ in f) for f in found]
    total = collections.Counter()
    for (_, _, label), e in zip(kept, errors):
        total[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((k if k is not None else -1, "".join(f"{i:02x}" for _, i in f), e, total[label]) for (k, _, label), f, e in zip(kept, found, errors))), digest


def coded(frame, **given):
    got = vector_codes.code_vectors(frame, **given).collect()
    return sorted((r.vec_id if r.vec_id is not None else -1, r.code, r.error, r.label_error) for r in got), {r.codebooks_sha256 for r in got}


VECTORS = "vec_id long, embedding array<double>, label int, code string, v int"


@pytest.mark.parametrize("parts,entries,width", [(16, 64, 64), (4, 7, 64), (2, 5, 13), (3, 200, 3)])
def test_codes_by_brute_force(spark, parts, entries, width):
    rng = random.Random(parts)
    rows = [(rng.randint(0, 90) if k % 9 else None, [round(rng.gauss(0, 1), 2) for _ in range(width)], rng.choice([None, 1, 2])) for k in range(120)]
    rows += rows[:10]  # repeated rows
    rows += [(1, None, 1), (2, [float("nan")] * width, 1), (3, [float("inf")] * width, 2), (4, [None] * width, None), (5, [0.5] * (width + 1), 1), (6, [], 1)]
    frame = spark.createDataFrame([(*r, "clash", 9) for r in rows], VECTORS).repartition(3)
    plain, digest = plain_codes([r for r in rows if r[1] is None or len(r[1]) == width], parts, entries)
    assert coded(frame, parts=parts, entries=entries) == (plain, {digest})


def test_codes_of_few_and_no_rows(spark):
    rows = [(3, [1.0] * 16, None), (1, [-0.001] * 16, 5)]
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS)
    plain, digest = plain_codes(rows)
    assert coded(frame) == (plain, {digest})
    for nothing in (frame.where("false"), frame.withColumn("embedding", F.lit(None).cast("array<double>")), frame.withColumn("vec_id", F.lit(None).cast("long"))):
        assert vector_codes.code_vectors(nothing).collect() == []
    with pytest.raises(Exception, match="too large"):
        vector_codes.code_vectors(frame.withColumn("embedding", F.expr("transform(embedding, x -> x * 1e9)"))).collect()


@pytest.mark.parametrize("width,scale", [(1, 50), (4, 300), (6, 3), (16, 2000), (64, 1 << 22)])
def test_bounds_keep_the_nearest(width, scale):
    rng = np.random.default_rng(width)
    centre = rng.integers(-scale, scale + 1, (40, width))
    x = centre[rng.integers(0, 40, 3000)] + rng.integers(-(scale // 8) - 1, scale // 8 + 2, (3000, width))
    book = vector_codes.Codebook(np.concatenate((centre, centre[:8])))  # ties with repeated entries
    index, distance, measured = book.nearest(x)
    plain = ((x[:, None, :] - book.entries[None]) ** 2).sum(axis=2)
    assert (distance == plain.min(axis=1)).all() and (index == plain.argmin(axis=1)).all()
    assert measured < 0.75 * plain.size  # the bounds drop entries
    for blocks, segments in book.levels:
        own = vector_codes._segments(x, blocks)
        low = vector_codes._bound(tuple(s[:, None] for s in own), tuple(s[None] for s in segments), width // blocks)
        assert (low <= plain).all()


def test_finer_levels_are_tighter():
    assert vector_codes.levels(64) == [1, 2, 4, 8, 16, 32] and vector_codes.levels(4) == [1, 2] and vector_codes.levels(1) == [1] and vector_codes.levels(6) == [1, 2]
    rng = np.random.default_rng(1)
    book, x = vector_codes.Codebook(rng.integers(-500, 500, (50, 32))), rng.integers(-500, 500, (200, 32))
    sums = []
    for blocks, segments in book.levels:
        own = vector_codes._segments(x, blocks)
        sums.append(vector_codes._bound(tuple(s[:, None] for s in own), tuple(s[None] for s in segments), 32 // blocks).sum())
    assert sums == sorted(sums) and sums[-1] > 1.2 * sums[0]


# --- lexical search ------------------------------------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain_search(docs, items, k=10, repeats=False):
    own = [(i, collections.Counter(terms_of(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n, total = len(own), sum(s for _, _, s in own)
    df = collections.Counter(t for _, c, _ in own for t in c)
    found = []
    for item, text in items:
        wanted, scores = collections.Counter(terms_of(text)), []
        for i, c, s in own:
            m = 10 + 90 * s * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) * (times if repeats else 1) for t, times in wanted.items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        found += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(found, key=str)


def searched(docs, items, **given):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.search(docs, items, **given).collect()), key=str)


def corpus(seed, count):
    rng, words = random.Random(seed), [f"w{i}" for i in range(60)] + ["Straße", "日本", "x1", "the"]
    docs = [(rng.randint(0, count), rng.choice([" ", "-", ", ", "\n"]).join(rng.choices(words, [1 / (1 + i % 40) for i in range(len(words))], k=rng.randint(0, 60)))) for _ in range(count)]
    docs += docs[:20] + [(None, docs[0][1]), (None, docs[0][1]), (7, None), (8, ""), (9, " .,!"), (10, "w1 " * 5000), (11, "THE the The"), (12, "unseen")]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 15)))) for k in range(12)] + [(3, "w1 w1 W1 w2"), (None, "the w3"), (20, None), (21, ""), (22, "!?"), (23, "nowhere"), (24, "unseen")]
    return docs, items


def tables(spark, docs, items):
    return spark.createDataFrame([(i, t, 5, "r") for i, t in docs], "doc_id long, text string, score long, rank string").repartition(5), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("repeats,block", [(False, 4096), (True, 16)])
def test_search_by_brute_force(spark, monkeypatch, repeats, block):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 100 if block == 16 else 1 << 20)
    docs, items = corpus(3, 150)
    assert searched(*tables(spark, docs, items), repeats=repeats) == plain_search(docs, items, repeats=repeats)


def test_search_of_nothing(spark):
    docs, items = corpus(4, 10)
    some, asked = tables(spark, docs, items)
    assert searched(some.where("false"), asked) == [] and searched(some, asked.where("false")) == []
    assert searched(some.withColumn("text", F.lit("...")), asked) == []


def test_blocks_hold_what_texts_have(monkeypatch):
    docs, _ = corpus(5, 80)
    vocabulary = lexical.Items(0, [(1, "w1 w2 the Straße 日本 w9")]).vocabulary
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 3)
    monkeypatch.setattr(lexical.kernels, "WINDOW", 64)  # postings of a text come in windows and are merged
    gather = lexical._Gather(vocabulary)
    gather.add(pa.array([i for i, _ in docs]), pa.array([t for _, t in docs]))
    row = gather.block().to_pylist()[0]
    ids, rows, counts = (np.frombuffer(row[n], t) for n, t in (("ids", np.int64), ("rows", np.uint16), ("counts", np.uint16)))
    got = collections.Counter()
    for r, c in zip(rows.tolist(), counts.tolist()):
        got[int(ids[r])] += c
    wanted = {"w1", "w2", "the", "straße", "日本", "w9"}
    plain = collections.Counter()
    for i, t in docs:
        plain[i or 0] += sum(w in wanted for w in terms_of(t))
    assert got == +plain and row["n_terms"] == sum(len(terms_of(t)) for _, t in docs)


def test_lengths_beyond_64_bits():
    sizes = np.array([10**10, 5, 10**12], np.int64)
    assert lexical._share(sizes, 10**10, 10**13).tolist() == [90 * int(n) * 10**10 // 10**13 for n in sizes]
