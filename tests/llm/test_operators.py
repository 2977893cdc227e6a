"""The operators against plain versions, with nulls, empty and repeated rows, and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import additive, budget, crf, gru, hilbert, huffman, pigeonhole, sigtree, suffix, urllists
from tracewright.llm.textbytes import Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab\n é") for _ in range(rng.randint(0, 700)))) for i in range(30)]
    t = [r[1] for r in rows]
    rows += [(100 + i, t[i][50:400] + t[i + 1][:250] + "x" + t[i][100:330]) for i in range(15)]
    return [*rows, (200, "a" * 1000), (201, None), (202, ""), (None, t[3]), (None, t[3]), (5, "zz"), (5, t[5]), (5, t[5]), (300, "ab" * 300), (301, "It's <|endoftext|> x. 12,3 ＡÉ—,a")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "en", "s", 1) for r in rows], "doc_id long, text string, version string, lang string, source string, label int")


def test_repeats_are_those_of_a_plain_scan(spark, odd_texts):
    count = Counter(b[i : i + 200] for _, t in odd_texts for b in [(t or "").encode()] for i in range(len(b) - 199))
    want = []
    for d, t in odd_texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        want.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    assert order(tuple(r) for r in suffix.remove_repeats(frame(spark, odd_texts)).collect()) == order(want)


def test_hot_anchors_are_split_without_loss(spark, odd_texts, monkeypatch):
    want = order(tuple(r) for r in suffix.remove_repeats(frame(spark, odd_texts)).collect())
    monkeypatch.setattr(suffix, "HOT", 0)
    assert order(tuple(r) for r in suffix.remove_repeats(frame(spark, odd_texts)).collect()) == want


def test_suffix_arrays_order_by_tag_and_bytes(monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 7)
    rng = np.random.default_rng(6)
    data = rng.integers(0, 2, 400).astype(np.uint8)
    tags, starts = rng.integers(0, 12, 300).astype(np.uint64), rng.integers(0, 395, 300)
    order_, same = suffix.arranged(tags, starts, data, 5)
    keys = [(int(tags[i]), data[starts[i] : starts[i] + 5].tobytes()) for i in order_]
    assert keys == sorted(keys) and same.tolist() == [False] + [x == y for x, y in zip(keys, keys[1:])]


@pytest.mark.parametrize("stored", [False, True])
def test_suffix_family_merges_levels(tmp_path, stored):
    """Every batch meets those before it, also where the family was stored between them."""
    rng = np.random.default_rng(0)
    family, seen = suffix.Family(4), []
    for k, n in enumerate((50, 3, 70, 1, 1, 40)):
        data, tags = rng.integers(0, 3, n + 3).astype(np.uint8), rng.integers(0, 2, n).astype(np.uint64)
        seen += [(t, data[i : i + 4].tobytes()) for i, t in enumerate(tags.tolist())]
        family.add(data, np.arange(n), tags)
        if stored:
            family.save(tmp_path / f"{k}.npz")
            family = suffix.Family.load(tmp_path / f"{k}.npz")
    count = Counter(seen)
    assert family.marked[: family.count].tolist() == [count[x] > 1 for x in seen]
    assert len(family.levels) < 5 and sum(map(len, family.levels)) == len(count)


def components_of(rows, n, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return order((d, len(sets[i]), (min(least[find(i)], default=None) if sets[i] else d)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("chunk", [6_000_000, 300])
def test_joined_components_are_exact(spark, chunk):
    rng = random.Random(2)
    vocabulary, rows = [f"w{i}" for i in range(300)], []
    for n in (5, 6, 8, 9, 12, 20, 60, 150):
        base = [rng.choice(vocabulary) for _ in range(n)]
        for k in range(rng.choice([1, 3, 12])):
            x = list(base)
            for _ in range(rng.randint(0, max(1, n // 40))):
                x[rng.randrange(n)] = rng.choice(vocabulary)
            rows.append((len(rows), ("\n" if k % 2 else " ").join(x)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (None, rows[0][1]), (None, "q r s t u"), (3, rows[3][1])]
    got = sigtree.near_duplicates(frame(spark, rows), chunk_tokens=chunk, leaders=2)
    assert order(tuple(r) for r in got.collect()) == components_of(rows, 4, 85)


def test_frequent_signatures_connect_no_blocks(spark):
    rows = [(10 * k + i, 2, [7, 100 + k], 0, []) for k in range(1, 4) for i in (0, 1)]
    found = sigtree._candidates(spark.createDataFrame(rows, f"node long, {sigtree.SIGNED}"))
    assert {(r.node, r.root) for r in found.collect()} == {(11, 10), (21, 20), (31, 30)}


@pytest.mark.parametrize("percent", [80, 85])
def test_links_survive_frequent_shingles(spark, percent):
    rng = random.Random(percent)
    texts = []
    for _ in range(40):  # few words, so that many parts are shared by chance, and near copies on both sides of the threshold
        words = [rng.choice("abcde") for _ in range(rng.randint(5, 150))]
        for changes in (0, 1, 2, 3):
            copy = list(words)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = rng.choice("abcdefg")
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    got = sigtree.near_duplicates(frame(spark, rows), percent)
    assert order(tuple(r) for r in got.collect()) == components_of(rows, 4, percent)


def test_ids_survive_the_file(spark, odd_texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, start, want = Tokenizer.from_file(path), 0, []
    coded = [(d, [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in odd_texts]
    for d, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0], len(x[1]), np.array(x[1], "<u2").tobytes())):
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    written, lengths = huffman.encode_documents(frame(spark, odd_texts), path)
    assert order(tuple(r) for r in huffman.read_blocks(spark, written, lengths).collect()) == order(want)
    empty, lengths = huffman.encode_documents(frame(spark, odd_texts).limit(0), path)
    assert huffman.read_blocks(spark, empty, lengths).count() == 0


def test_code_lengths_keep_the_limit():
    counts = np.array([2**min(i, 40) for i in range(50)])
    lengths = huffman.code_lengths(counts, 8)
    assert lengths.max() <= 8 and math.isclose((2.0**-lengths).sum(), 1)


def test_base_scores_and_gradient(spark, odd_texts):
    rows = [(i, f"the cat {i % 7} sat on The mat\n" * (i % 4)) for i in range(60)] + odd_texts
    tokens = [[*WORD.findall(low(t)), None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    want = order((d, h, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)) for (d, _), t, h in zip(rows, tokens, held))
    for common in (gru.COMMON, 5):
        got = gru.score_documents(frame(spark, rows), common=common).collect()
        assert order((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


class Corpus:
    """What gru.new_network() takes of a corpus, made up: 40 listed words in 6 classes, the tenth one the end."""

    class_of, end = np.sort(np.arange(40) % 6), 9
    often, tails = np.arange(40, 0, -1.0), np.full(gru.TAIL, 3.0)


def windows(rng, steps, lanes):
    target = rng.integers(0, 40 + gru.TAIL, (steps, lanes))
    given = np.concatenate([np.full((1, lanes), 9), target[:-1]])
    return given, target, np.ones((steps, lanes), bool)


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    net, w, h = gru.new_network(Corpus), windows(rng, 9, 4), rng.standard_normal((4, gru.HIDDEN)).astype(np.float32)
    g = gru.gradient(net, *w, h)[1]
    places = [i for p in net.like(np.arange(len(net.flat), dtype=np.float32)).p.values() for i in rng.choice(p.reshape(-1), 12).astype(int)]
    for i in places:
        a, b = net.like(net.flat.copy()), net.like(net.flat.copy())
        a.flat[i] += 0.01
        b.flat[i] -= 0.01
        assert abs((gru.gradient(a, *w, h)[0] - gru.gradient(b, *w, h)[0]) / 0.02 - g[i]) < 1e-3


def test_states_are_carried_across_windows():
    rng = np.random.default_rng(1)
    net, (given, target, real), h = gru.new_network(Corpus), windows(rng, 12, 3), np.zeros((3, gru.HIDDEN), np.float32)
    loss, _, state = gru.gradient(net, given, target, real, h)
    first, _, between = gru.gradient(net, given[:7], target[:7], real[:7], h)
    second, _, after = gru.gradient(net, given[7:], target[7:], real[7:], between)
    assert np.allclose(state, after, atol=1e-6) and abs(loss - (7 * first + 5 * second) / 12) < 1e-5


def test_network_learns_from_every_token_and_end(spark, monkeypatch):
    texts = [None, "", "one two three", "w " * 63, "w " * 64, "a b c " * 70, "one two three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = gru.Words(gru.count_words(docs), gru.COMMON)
    ids = [np.frombuffer(r.ids, "<u2") for r in gru.training_ids(docs, known).collect()]
    assert sorted(map(len, ids)) == sorted(len(WORD.findall(t or "")) + 1 for t in texts)
    assert all(i[-1] == known.end and (i[:-1] != known.end).all() for i in ids)
    counted, plain = [], gru.gradient
    monkeypatch.setattr(gru, "gradient", lambda net, given, target, real, h: counted.append(target[real]) or plain(net, given, target, real, h))
    everything = np.concatenate(ids)
    gru.train(gru.new_network(known), np.tile(everything, 40))
    assert np.array_equal(np.sort(np.concatenate(counted)), np.sort(np.tile(everything, 40)))


def test_scores_are_whole_document_likelihoods(spark):
    """Against one step after the other with all class and word probabilities written out."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randrange(30)))) for i in range(80)]
    rows.append((1000, " ".join(rng.choices([*words, "never", "Seen"], k=700))))
    docs = frame(spark, rows)
    training = docs.filter(~gru.is_held_out(F.col("doc_id")))
    counts = gru.count_words(training)
    known = gru.Words(counts, gru.COMMON, 30)
    net = gru.train_network(gru.training_ids(training, known), gru.new_network(known), 1000, 2)
    p, n = {k: v.astype(float) for k, v in net.p.items()}, len(known.heads)
    texts = Texts(0, np.frombuffer(low(rows[-1][1]).encode(), np.uint8), np.array([0, len(rows[-1][1])]))
    s = gru.Slice(texts)
    ids = known.ids(s.keys, s.tails)[s.token]
    h, given, want = np.zeros(gru.HIDDEN), net.end, []
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for x in ids:
        a, r = p["x"][given] + p["b"], h @ p["u"]
        keep, reset = np.split(sigmoid((a + r)[: 2 * gru.HIDDEN]), 2)
        new = np.tanh(a[2 * gru.HIDDEN :] + reset * r[2 * gru.HIDDEN :])
        h = keep * h + (1 - keep) * new
        e = np.exp(h @ p["o"] + p["c"])
        q = e[net.class_of[x]] / e.sum()
        if x < n:
            e = np.exp(h @ p["w"] + p["d"])
            q *= e[x] / e[net.class_of[:n] == net.class_of[x]].sum()
        want.append(math.log10(q))
        given = x
    assert np.allclose(gru.token_logs(net, ids, s.first), want, atol=1e-4)


def test_documents_of_a_batch_advance_together(spark, monkeypatch):
    """A step for each token of the longest document, in however many slices the words are looked up; scores as one by one."""
    rng = random.Random(9)
    texts = [None, "", *(" ".join(rng.choices("abcdefghij", k=rng.randrange(1, 60))) for _ in range(40)), "a b c " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = gru.Words(gru.count_words(docs), gru.COMMON, 8)
    net = gru.new_network(known)
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array([False] * len(some)), pa.array(some, pa.string())], ["doc_id", "held_out", "text"])
    alone = [b.column("score")[0].as_py() for t in texts for b in gru.scored_batch(known, net, batch([t]), 0)]
    steps, plain, slices = [], gru.step, gru.slices
    monkeypatch.setattr(gru, "step", lambda *a: steps.append(1) or plain(*a))
    monkeypatch.setattr(gru, "slices", lambda column: slices(column, 200))
    out = pa.Table.from_batches(gru.scored_batch(known, net, batch(texts), 7))
    assert len(steps) == 121 and out["row"].to_pylist() == list(range(7, 7 + len(texts)))
    assert out["doc_id"].to_pylist() == list(range(len(texts))) and np.allclose(out["score"].to_numpy(), alone, atol=1e-4)


def test_large_outputs_are_shifted_and_sums_by_id_are_whole(monkeypatch):
    rng = np.random.default_rng(3)
    net, w, h = gru.new_network(Corpus), windows(rng, 9, 300), np.zeros((300, gru.HIDDEN), np.float32)
    plain = gru.gradient(net, *w, h)
    monkeypatch.setattr(gru, "FAR", 0.0)
    shifted = gru.gradient(net, *w, h)
    assert abs(plain[0] - shifted[0]) < 1e-5 and np.allclose(plain[1], shifted[1], atol=1e-6)
    monkeypatch.setattr(gru, "FAR", 60.0)
    for bias in ("c", "d"):
        net.p[bias][:] = rng.choice([-300, 0, 300], len(net.p[bias]))
    loss, grad, _ = gru.gradient(net, *w, h)
    assert math.isfinite(loss) and np.isfinite(grad).all()
    ids, rows = np.minimum(rng.geometric(0.05, 3000), 90).astype(np.uint16), rng.standard_normal((3000, 5))
    found, sums = gru.sums_by_id(ids, rows)
    assert np.array_equal(found, np.unique(ids)) and all(np.allclose(s, rows[ids == i].sum(0)) for i, s in zip(found, sums))


def test_network_beats_counts_on_held_out_text(spark):
    got = gru.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_languages_and_letterless_texts(spark):
    rng = random.Random(4)
    kinds = {"aa": ["the", "thing", "with", "ing", "that"], "bb": ["ción", "mente", "los", "que", "ñas"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 30))), k) for i, k in enumerate(["aa", "bb"] * 40)] + [(500, None, "aa"), (501, "12 -- !", "bb"), (502, "", None), (None, "the thing", None)]
    got = {r.doc_id: r for r in crf.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[d].lang_pred == k for d, _, k in rows[:80]) and got[None].lang_pred == "aa"
    assert [(got[d].lang_pred, got[d].score) for d in (500, 501, 502)] == [("und", 0.0)] * 3
    assert all(r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 for d, r in got.items())


def test_copies_of_a_text_take_one_training_place(spark, monkeypatch):
    monkeypatch.setattr(crf, "fit", lambda texts, langs: (texts, langs))
    rows = [(f"text {i}", lang) for lang in ("aa", "bb") for i in range(12) for _ in range(30)]
    texts, langs = crf.train(spark.createDataFrame(rows, "text string, lang string"), per_label=5)
    assert langs == ["aa"] * 5 + ["bb"] * 5 and len(set(texts[:5])) == len(set(texts[5:])) == 5


def test_all_labelled_languages_are_learned(spark):
    rng = random.Random(8)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(4)] for k in range(70)}
    rows = [(f"{w[0]} {w[1]} {w[2]} {w[3]} " * 3 + w[i], k) for k, w in words.items() for i in range(2 if k > "l63" else 3)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = crf.train(docs)
    assert model.labels == sorted(words) and model.weights.shape == (crf.BUCKETS + 70, 70)
    assert all(r.lang == r.lang_pred for r in crf.predict(docs, model, ["lang"]).collect())


def test_languages_fit_takes_little_memory_and_its_slices_change_nothing(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(5)
    letters = {"aa": np.frombuffer(b"abcdefghijkl", "S1"), "bb": np.frombuffer(b"hijklmnopqrs", "S1")}
    texts = [" ".join(b"".join(w).decode() for w in rng.choice(letters[k], (4000, 6))) for k in ("aa", "bb") for _ in range(20)]
    langs = ["aa"] * 20 + ["bb"] * 20
    monkeypatch.setattr(crf, "STEPS", 2)
    tracemalloc.start()
    got = crf.fit(texts, langs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110 * sum(map(len, texts))
    for name in ("FIT_SLICE", "FIT_SEQUENCES", "SOME_WORDS"):
        monkeypatch.setattr(crf, name, 1 << 30)
    whole = crf.fit(texts, langs)
    assert all(np.allclose(a, b) for a, b in zip(got[1:], whole[1:], strict=True)) and got.labels == whole.labels


def test_forward_backward_against_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    emit, trans = rng.random((7, 3)) + 0.1, rng.random((3, 3)) + 0.1
    first = np.array([0, 4, 4, 7])
    got = crf.marginals(emit, first, trans)
    for a, b in ((0, 4), (4, 7)):
        want = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            p = np.prod([emit[a + i, x] for i, x in enumerate(path)]) * np.prod([trans[x, y] for x, y in zip(path, path[1:])])
            for i, x in enumerate(path):
                want[i, x] += p
        assert np.allclose(got[a:b], want / want.sum(1, keepdims=True))


@pytest.mark.parametrize("part", [additive.PART, 200])
def test_nearest_vectors(spark, part):
    """With parts of 200 codes there are several waves, which changes nothing."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16))
    x[700:760] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0, None] * 8), (2200, [1.0])]
    got = defaultdict(list)
    for r in additive.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), part=part).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits, u = 0, x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 1500, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -2
        want = np.lexsort((np.arange(1500), -s))[:5]
        hits += len(set(want) & {v for _, v, _ in got[q]})
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
    assert hits >= 0.9 * 150 and set(got) == set(range(0, 1500, 50))
    assert [v for _, v, _ in sorted(got[50])] == [700, 701, 702, 703, 704]


def test_codebooks_are_learned_by_a_task(spark, monkeypatch):
    import os

    driver, real = os.getpid(), additive.fit

    def fit(x):
        assert os.getpid() != driver
        return real(x)

    monkeypatch.setattr(additive, "fit", fit)
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))]
    assert additive.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 6 * 5


@pytest.mark.parametrize("n", [5000, 700])
def test_codebook_sample_is_that_of_least_hash(spark, n):
    """With a wrong n (many rows share few hashes, as it were) too few pass the bound, and all are ordered."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((n, 4))
    entries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entry long, v array<double>")
    want = [r.entry for r in entries.orderBy(F.xxhash64("entry"), "entry").limit(300).collect()]
    assert [r.entry for r in additive.least_hashed(entries, n, 300).collect()] == want
    books = additive.fit(additive.unit(x[want]))
    for told in (n, 100 * n):
        assert np.allclose(additive.learned(entries, told, 300), books, atol=1e-5)
    assert additive.learned(entries.limit(0), 0, 300) is None


@pytest.mark.parametrize("size", [1e200, 1e-200, 1e-308])
def test_vectors_of_extreme_size(spark, size):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 8))
    scaled = x * np.where(np.arange(120) % 3 == 0, size, 1.0)[:, None]
    got = {(r.query_id, r.vec_id): r.score for r in additive.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(scaled)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 50, 100):
        s = u @ u[q]
        s[q] = -2
        for v in np.argsort(-s)[:5]:
            assert abs(got[q, v] - s[v]) < 1e-6


def distance(a, b):
    """Least edit distance of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_leaks_against_plain_distances(spark):
    rng = random.Random(6)
    items = [(i, "".join(rng.choice("abcde ") for _ in range(rng.randint(30, 120)))) for i in range(6)] + [(7, None), (8, "short")]
    docs = []
    for i, t in items[:6]:
        for edits in (0, 1, 2, 4, 9):
            x = list(pigeonhole.normal(t))
            for _ in range(edits):
                x[rng.randrange(len(x))] = rng.choice(["", "z", "ab"])
            docs.append((len(docs), "zz Y " + "".join(x).upper() + "\n\nzz"))
    docs += [(100, None), (101, ""), (100, docs[0][1])]
    got = {(r.doc_id, r.item_id): r.distance for r in pigeonhole.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        for i, item in items:
            a, b = pigeonhole.normal(item or ""), pigeonhole.normal(t or "")
            if len(a) >= pigeonhole.MIN_ITEM and (k := distance(a, b)) <= int(len(a) * pigeonhole.RATE):
                want[d, i] = k
    assert got == want


def test_short_items_are_found_at_word_limits(spark):
    items = [(1, "Paris"), (2, "4 2"), (3, "Who won it in 1998, eh?"), (4, " "), (5, "c++"), (6, None)]
    docs = [(10, "In  PARIS, 4\n2 times"), (11, "Parisian 14 2 and 4 23"), (12, "x who won it in 199, eh? y"), (13, "parisian paris c++ a"), (14, "pari s")]
    got = {(r.doc_id, r.item_id, r.distance, r.start, r.stop) for r in pigeonhole.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(10, 1, 0, 3, 8), (10, 2, 0, 10, 13), (12, 3, 1, 2, 24), (13, 1, 0, 9, 14), (13, 5, 0, 15, 18)}


def test_curve_visits_neighbours(spark):
    from pyspark.sql import functions as F

    cube = spark.range(8**3).select(*[F.expr(f"cast(floor(id / {8**k}) % 8 as int)").alias(c) for k, c in enumerate("xyz")])
    rows = sorted(tuple(r) for r in cube.select(hilbert.curve_index([F.col(c) for c in "xyz"], 3).alias("i"), "x", "y", "z").collect())
    assert [r[0] for r in rows] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:])) == 1 for p, q in zip(rows, rows[1:]))


def test_runs_are_even_and_gapless(spark, odd_texts):
    rows = hilbert.hilbert_shards(frame(spark, odd_texts), 7).collect()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(rows) == len(odd_texts)
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    text = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert text == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in odd_texts)


def test_budgets_pass_shortages_to_siblings_first(spark):
    rows = [("a", "x", 10), ("a", "y", 100), ("b", "z", 1000)]
    leaves = spark.createDataFrame(rows, "d string, l string, supply long")
    got = {(r.d, r.l): r.budget for r in budget.leaf_budgets(leaves, ["d", "l"], {}, 0.15, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 73, ("b", "z"): 83}
    got = {(r.d, r.l): r.budget for r in budget.leaf_budgets(leaves, ["d", "l"], {}, 0.9, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 889}


def test_weight_zero_leaves_a_node_out(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "xyz"[i % 3], 10) for i in range(60)], "doc_id long, lang string, source string, n_tokens long")
    for weights in ({"lang": {"a": 0}}, {"source": {"x": 0}}, {"lang": {"b": 0}, "source": {"y": 0}}):
        got = budget.hierarchical_mix(docs, ["lang", "source"], weights, share=0.5).collect()
        out = [r for r in got if 0 in (weights.get("lang", {}).get(r.lang), weights.get("source", {}).get(r.source))]
        taken = sum(r.full_epochs * r.n_tokens + r.part_tokens for r in got)
        assert all(not r.full_epochs and not r.part_tokens for r in out) and 300 - 6 <= taken <= 300
    got = budget.hierarchical_mix(docs, ["lang", "source"], {"lang": {"a": 0, "b": 0}}).collect()
    assert len(got) == 60 and not any(r.full_epochs or r.part_tokens for r in got)


def test_list_entries_hold_at_fetch_time(spark):
    from datetime import date

    day = lambda n: date(2024, 1, n)
    entries = [("l", "block", "domain", "ex.com", "add", day(5)), ("l", "block", "domain", "ex.com", "remove", day(9)), ("l", "allow", "host", "a.ex.com", "add", day(7)), ("l", "block", "host", None, "add", day(1)), ("l", "block", "domain", "ex.com", "add", day(5))]
    captures = [(1, "http://a.ex.com/p", day(4)), (2, "http://a.ex.com/p", day(5)), (3, "https://u@A.ex.com:8/p?q", day(8)), (4, "http://b.ex.com", day(9)), (5, None, day(5)), (6, "not a url", day(5)), (7, "http://b.ex.com", day(8)), (7, "http://b.ex.com", day(8)), (8, "http://b.ex.com", None)]
    got = urllists.evaluate(spark.createDataFrame(captures, "page_id long, url string, day date"), spark.createDataFrame(entries, "list string, verdict string, kind string, pattern string, action string, day date")).collect()
    assert sorted((r.page_id, r.verdict, r.n_active) for r in got) == [(1, "none", 0), (2, "block", 1), (3, "allow", 2), (4, "none", 0), (5, "none", 0), (6, "none", 0), (7, "block", 1), (7, "block", 1), (8, "none", 0)]


def test_domains_of_many_labels_match(spark):
    from datetime import date

    deep, day = "a.b.c.d.e.f.ex.com", date(2024, 1, 2)
    entries = [("l", "allow", "domain", "ex.com", "add", day), ("l", "block", "domain", deep, "add", day)]
    captures = [(1, f"http://{deep}/p", day), (2, f"http://x.y.{deep}", day), (3, "http://z.b.c.d.e.f.ex.com", day)]
    got = urllists.evaluate(spark.createDataFrame(captures, "page_id long, url string, day date"), spark.createDataFrame(entries, "list string, verdict string, kind string, pattern string, action string, day date")).collect()
    assert sorted((r.page_id, r.verdict, r.pattern, r.n_active) for r in got) == [(1, "block", deep, 2), (2, "block", deep, 2), (3, "allow", "ex.com", 1)]


def test_empty_tables(spark):
    docs = frame(spark, [(1, "a")]).limit(0)
    for out in (hilbert.hilbert_shards(docs), crf.identify(docs), suffix.remove_repeats(docs), sigtree.near_duplicates(docs), gru.score_documents(docs), budget.hierarchical_mix(budget.with_tree(docs), budget.LEVELS, budget.WEIGHTS), pigeonhole.leaks(docs, spark.createDataFrame([], "item_id long, text string")), additive.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert out.count() == 0
