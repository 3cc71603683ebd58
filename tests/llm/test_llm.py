"""Each operator against a plain version on small tables, odd rows included."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioflow.llm import bpe, decontam, exact, graph, ngram, passages, simhash, textops, tokenfile, toxicity, urlfilter, wrappers

P = pytest.importorskip("public_tokenizers")
RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(900)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


BASE = [prose(120) for _ in range(12)]
ODD = [None, "", " ", "\n\t ", "x", "a  b\r\n c d", "don't stop'LL", "été ñ ΣΑΣ 😀👨‍👩‍👧 ½", "word" * 60, "a\x1cb c\x85d", prose(9000), "dup  text", "dup text", "dup\ttext", "dup text ", "a <|endoftext|> b<|startoftext|>C D", "<|ENDOFTEXT|> A<B", "one\ntwo\n\nthree \nfour\n five", "x\u00a0 y\u3000z \u2009 w", " lead and trail "]
TEXTS = BASE + [b.replace(" ", "  ", 3) for b in BASE[:3]] + [BASE[0] + " tail", BASE[1].upper()] + ODD


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i, "clash", 1.0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, id long, fp string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def test_words_and_hashes():
    import pyarrow as pa

    h, at = textops.words(pa.array(TEXTS))
    assert np.diff(at).tolist() == [len(words(t)) for t in TEXTS]
    seen = {}
    for x, w in zip(h.tolist(), (w for t in TEXTS for w in words(t)), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_exact(docs, empty):
    groups = {}
    for i, t in enumerate(TEXTS):
        groups.setdefault(norm(t), []).append(i)
    got = {r.doc_id: r for r in exact.exact_duplicates(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        g = groups[norm(t)]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, bytes(r.text_sha256)) == (g[0], len(g), i == g[0], hashlib.sha256(norm(t).encode()).digest())
    assert exact.exact_duplicates(empty).count() == 0


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 40, 3000, dtype=np.uint64), np.full(700, (1 << 64) - 1, np.uint64), np.zeros(300, np.uint64)])
    rng.shuffle(x)
    a, b = (exact.CountingQuotientFilter.of(p) for p in (x[:2500], x[2500:]))
    whole = a.merge(b)
    h, n = whole.items()
    assert dict(zip(h.tolist(), n.tolist(), strict=True)) == Counter(x.tolist()) and (h[1:] > h[:-1]).all()
    assert whole.slots.shape[1] < 8  # quotients aren't stored
    many = exact.CountingQuotientFilter.of(np.array([5, 6, 7], np.uint64), np.array([1, 1 << 40, 3]), q=20).items()
    assert many[0].tolist() == [5, 6, 7] and many[1].tolist() == [1, 1 << 40, 3]
    got = Counter()
    for k, f in whole.blocks(6):
        h, n = exact.CountingQuotientFilter.loads(f.dumps()).items()
        got.update(dict(zip((h >> np.uint64(6) | np.uint64(k << 58)).tolist(), n.tolist(), strict=True)))
    assert got == Counter(x.tolist())
    empty = exact.CountingQuotientFilter.of(np.zeros(0, np.uint64))
    assert len(empty.items()[0]) == 0 and len(empty.merge(a).items()[0]) == len(a.items()[0])


def fingerprint(t):
    w = words(t)
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(n, edges):
    root = list(range(n))
    for _ in range(n):
        new = root[:]
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            return root
        root = new
    return root


def test_simhash(docs, empty):
    fps = [fingerprint(t) for t in TEXTS]
    root = reach(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    for i, f in enumerate(fps):
        assert (got[i].fingerprint & (1 << 64) - 1, got[i].component_id) == (f, root[i]), TEXTS[i]
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [50_000, 7])
def test_simhash_links(spark, monkeypatch, block):
    """Blocks of a large prefix node lose nothing."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        for _ in range(8):
            x = f
            for b in rng.sample(range(64), rng.randint(1, 7)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    root = reach(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "id long, fp long")
    got = {r.node: r.component for r in graph.components(simhash.links(df)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == root


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = reach(140, edges)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root[x] for x in linked}


def test_bpe_like_the_library(docs, empty):
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode(docs, ranks, P.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        assert bytes(got[i].ids) == ids, t
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(empty, ranks, P.PATTERN).count() == 0


def test_token_files(docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in TEXTS]
    shards = tokenfile.write_tokens(docs, path, 2, "file://" + str(tmp_path))
    got = sorted(tokenfile.read_digests(shards).collect())
    at = 0
    for i, ids in enumerate(want):
        assert tuple(got[i]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    picked = {d: x.tolist() for s in shards.collect() for d, x in tokenfile.TokenReader(s.uri).documents([0, 7, len(TEXTS) - 1, 999])}
    assert picked == {i: want[i] for i in (0, 7, len(TEXTS) - 1)}
    assert tokenfile.read_digests(tokenfile.write_tokens(empty, path, 2)).count() == 0
    with pytest.raises(Exception, match="must be an integer"):
        tokenfile.write_tokens(docs.withColumn("doc_id", F.lit(None).cast("long")), path, 2)


def test_token_file_frames(tmp_path):
    with open(tmp_path / "f", "wb") as out:
        w = tokenfile.TokenWriter(out, 2)
        docs = [(i, np.full(30_000, i % 7, "<u2")) for i in range(9)] + [(8, np.zeros(0, "<u2")), (12, np.arange(5, dtype="<u2"))]
        for d, x in docs:
            w.add(d, x.tobytes())
        w.close()
    r = tokenfile.TokenReader(f"file://{tmp_path}/f")
    assert len(r.table) > 2 and [(d, x.tolist()) for d, x in r] == [(d, x.tolist()) for d, x in docs]
    assert [d for d, _ in r.documents([8, 12])] == [8, 8, 12]
    raw = bytearray((tmp_path / "f").read_bytes())
    raw[int(r.starts[1]) + 9] ^= 1
    (tmp_path / "g").write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017  zstandard's or ours
        list(tokenfile.TokenReader(f"file://{tmp_path}/g"))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_kneser_ney(docs, empty, order):
    """Scores are those of the model written out run by run, and probabilities after a context sum up to 1."""
    model = ngram.train(docs.filter("doc_id % 4 != 1"), order=order)
    got = {r.doc_id: r for r in ngram.score(docs, model).collect()}

    def runs(t):
        marked = [*["<s>"] * (order - 1), *(("w", w) for w in words(t)), "</s>"]
        return [tuple(marked[i : i + order]) for i in range(len(marked) - order + 1)]

    trained = [t for i, t in enumerate(TEXTS) if i % 4 != 1]
    n = Counter(r[-1] for t in trained for r in runs(t))
    counts = {order: Counter(r for t in trained for r in runs(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(r[1:] for r in counts[k + 1])
    d = {k: ngram.discounts(*(Counter(c.values())[j] for j in (1, 2, 3, 4))) for k, c in counts.items()}
    context, taken = Counter(), Counter()
    for k, c in counts.items():
        for r, m in c.items():
            context[k, r[:-1]] += m
            taken[k, r[:-1]] += d[k][min(m, 3)]

    def prob(r):
        k = len(r)
        if not k:
            return 1 / (len(n) + 1)
        if not context[k, r[:-1]]:
            return prob(r[1:])
        return (max(counts[k][r] - d[k][min(counts[k][r], 3)], 0) + taken[k, r[:-1]] * prob(r[1:])) / context[k, r[:-1]]

    some = runs(TEXTS[0])[5][:-1]
    assert math.isclose(sum(prob((*some, w)) for w in [*n, "unknown"]), 1)
    total = sum(n.values())
    for i, t in enumerate(TEXTS):
        s = sum(math.log10(prob(r)) for r in runs(t))
        base = sum(math.log10((n[r[-1]] + 0.5) / (total + 0.5 * (len(n) + 1))) for r in runs(t))
        assert got[i].n_tokens == len(runs(t)) and got[i].n_known == sum(n[r[-1]] > 0 for r in runs(t))
        assert math.isclose(got[i].score, s, rel_tol=1e-9) and math.isclose(got[i].base_score, base, rel_tol=1e-9)
    assert model.tokens == total
    if order == 3:
        assert len(model.hot) and ngram.score(empty, model).count() == 0
        blank = ngram.train(empty)
        assert all(math.isfinite(r.score) for r in ngram.score(docs, blank).collect())


def test_kneser_ney_of_many_buckets(docs, monkeypatch):
    """A model of more files than a process may hold open, or map, gives the same scores."""
    import resource

    import pyarrow as pa

    col = pa.array(TEXTS)
    want = ngram.train(docs).score(col)
    monkeypatch.setattr(ngram, "BUCKET_TOKENS", 400)
    model = ngram.train(docs)
    assert 5 << model.bits > 150
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (max(map(int, os.listdir("/proc/self/fd"))) + 20, hard))
    try:
        for most in (ngram.MAPS, 7):
            monkeypatch.setattr(ngram, "MAPS", most)
            model.open = {}
            for g, w in zip(model.score(col), want, strict=True):
                np.testing.assert_allclose(g, w)
            assert len(model.open) <= most
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))


def test_kneser_ney_tables(spark, docs, monkeypatch):
    """A run and what is known of a context take few bytes; hot words in parts and buckets change no score."""
    import pyarrow as pa

    rng = random.Random(12)
    texts = [prose(400, rng) for _ in range(120)]
    model = ngram.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    folder = model.folder.removeprefix("file://")
    size = sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder))
    marked = [["<s>", "<s>", *words(t), "</s>"] for t in texts]
    three = {r for m in marked for r in zip(m, m[1:], m[2:])}  # noqa: B905
    two, contexts = {r[1:] for r in three}, {r[:2] for r in three}
    assert size < 7 * (len(three) + len(two)) + 9 * len(contexts) + 60_000
    often = [" the ".join(prose(100, rng).split()) for _ in range(20)]
    docs = docs.select("text").unionAll(spark.createDataFrame([(t,) for t in often[:15]], "text string"))
    col = pa.array(TEXTS + often)
    for order in (2, 3, 4):
        want = ngram.train(docs, order=order).score(col)
        with monkeypatch.context() as m:
            m.setattr(ngram, "BUCKET_TOKENS", 800)
            model = ngram.train(docs, order=order)
        assert model.deal.parts.max() > 1
        for g, w in zip(model.score(col), want, strict=True):
            np.testing.assert_allclose(g, w)


def test_toxicity(spark):
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        bad = rng.random() < 0.2
        t = prose(rng.randint(5, 60), rng).split()
        if bad:
            t.insert(rng.randrange(len(t)), rng.choice(["vilest", "vileness", "vile", "rotten"]))
        rows.append((i, " ".join(t), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(77777, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 5 == 0]
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.95
    assert 0 <= got[9001] <= 1 and got[9001] == got[9002]
    assert len(model[0]) < 400  # most weights are 0
    none = toxicity.train(docs, labels.limit(0))
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, none).collect())


def test_toxicity_like_plain_ftrl(spark):
    """Weights are those of FTRL-proximal written out coordinate by coordinate."""
    import pyarrow as pa

    rng = random.Random(12)
    rows = [(i, prose(rng.randint(0, 25), rng) + (" vile rotten" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    feature, weight = toxicity.train(docs, docs.select("doc_id", "toxic"))
    order = np.argsort(textops.mix(np.arange(len(rows), dtype=np.int64).view(np.uint64)))
    bias = 1 << toxicity.BITS
    bags = [sorted({int(x) for f, _ in toxicity.features(pa.array([t])) for x in f}) + [bias] for _, t, _ in rows]

    def fit(chosen):
        z, n = Counter(), Counter()

        def w(i):
            l1 = 0 if i == bias else toxicity.L1
            return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

        for _ in range(toxicity.EPOCHS):
            for k in chosen:
                own = {i: w(i) for i in bags[k]}
                g = 1 / (1 + math.exp(-max(-35, min(35, sum(own.values()))))) - rows[k][2]
                for i, x in own.items():
                    z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * x
                    n[i] += g * g
        return {i: w(i) for i in z if w(i)}

    cut = len(order) * 4 // 5
    first = fit(order[:cut])
    rest = order[cut:]
    level = toxicity.best_level(np.array([sum(first.get(i, 0) for i in bags[k]) for k in rest]), np.array([rows[k][2] for k in rest]))
    want = fit(order)
    want[bias] = want.get(bias, 0) - level
    got = dict(zip(feature.tolist(), weight.tolist(), strict=True))
    assert set(got) == {i for i, x in want.items() if x} and all(math.isclose(got[i], want[i], rel_tol=1e-6, abs_tol=1e-9) for i in got)
    extra = docs.withColumns({"score": F.lit("clash"), "label": F.lit(7), "feature": F.lit(1)}).unionByName(docs.filter("doc_id = 3").withColumns({"score": F.lit("clash"), "label": F.lit(7), "feature": F.lit(1)}))
    assert toxicity.score(extra, (feature, weight)).count() == len(rows) + 1  # a repeated row is returned twice


ITEMS = [prose(30) + ". " + prose(8) for _ in range(6)]


def test_leaks_like_brute_force(spark):
    """Every document of a table against every item, window by window."""
    import pyarrow as pa

    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    items = decontam.Items.read([(r.item_id, r.text) for r in bench.collect()])
    w, at = textops.plain_words(pa.array([t for _, t in rows]))
    want = set()
    for d, (i, _) in enumerate(rows):
        own = w[at[d] : at[d + 1]].tolist()
        for k, (item, answer) in enumerate(zip(items.words, items.answers, strict=True)):
            item, answer, n = item.tolist(), answer.tolist(), len(item)
            bag = set(item)
            for a in range(0, max(1, len(own)), decontam.BLOCK):
                near = own[max(0, a - n) : a + 2 * decontam.BLOCK + n]
                if len(bag.intersection(near)) < 0.5 * len(bag):
                    continue
                part = decontam.lcs(item, near) / n
                held = lambda run, near=near: any(near[x : x + len(run)] == run for x in range(len(near) - len(run) + 1))
                if held(item) if n < decontam.SHORT else part >= decontam.SAME or (part >= decontam.PARAPHRASE and held(answer)):
                    want.add((i, items.ids[k]))
                    break
    assert len(want & got) >= 0.9 * len(want) and got <= want


def test_leaks(spark):
    rng = random.Random(11)
    rows, want = [(i, prose(150, rng)) for i in range(40)], set()
    for k, item in enumerate(ITEMS):
        w = item.split()
        host = prose(90, rng).split()
        altered = [x for j, x in enumerate(w) if j % 9 != 4]  # a word in nine is gone
        para = [x if j % 4 or j > len(w) - 10 else "changed" for j, x in enumerate(w)]  # but the answer stands
        for n, text in enumerate((w, [x.upper() + "***" for x in w], altered, para)):
            i = 100 + 10 * k + n
            rows.append((i, " ".join(host[:40] + text + host[40:])))
            want.add((i, k))
        rows.append((100 + 10 * k + 9, " ".join(host[:40] + w[: len(w) // 3] + host[40:])))  # a third is no leak
    rows += [(900, None), (901, ""), (902, ITEMS[0])]
    want.add((902, 0))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string").repartition(4)
    bench = spark.createDataFrame([*enumerate(ITEMS), (50, None), (51, "")], "item_id long, text string")
    got = decontam.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), bench).count() == 0


def test_lcs():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 12))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontam.lcs(a, b) == best[-1][-1]


def test_passages(spark):
    rng = random.Random(8)
    shared = [prose(51, rng), prose(70, rng)]
    rows = [(i, prose(rng.randint(20, 200), rng)) for i in range(30)]
    for i, s in ((100, 0), (101, 0), (102, 0), (103, 1), (104, 1)):
        a, b = prose(40, rng), prose(33, rng)
        rows.append((i, f"{a} {shared[s]}\n{b}"))
    near = shared[1].split()
    near[60] = "other"
    rows += [(105, prose(50, rng) + "\n" + " ".join(near)), (106, prose(60, rng) + " " + " ".join(shared[0].split()[:30])), (107, None), (108, ""), (109, "w " * 200), (110, "w " * 300)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, id int, passage int").repartition(3)
    got = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    assert set(got) == {100, 101, 102, 103, 104, 105, 109, 110}
    assert [got[i].component_id for i in (100, 101, 102, 103, 104, 105)] == [100, 100, 100, 103, 103, 103]
    assert not got[100].remove and got[101].remove and got[102].remove
    for i in (101, 102):
        (s,) = got[i].spans
        assert 33 <= s.start and s.end <= 98 and s.end - s.start >= 36  # paragraphs are alike, so some words beside may go along
    assert passages.repeated_passages(docs.limit(0)).count() == 0
    assert passages.repeated_passages(docs.filter("doc_id < 20")).count() == 0


def test_passages_like_brute_force(spark):
    """Every word that stands in a run of SPAN equal words with another document, known from runs of 50 on; short equal lines with a lower ``least``."""
    rng = random.Random(51)
    rows, pool = [], [prose(rng.randint(50, 120), rng).split() for _ in range(12)]
    for i in range(80):
        parts = [prose(rng.randint(5, 60), rng).split() for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) - 50)
            parts.insert(rng.randint(0, len(parts)), p[a:] if rng.random() < 0.5 else p[: len(p) - a])
        rows.append((i, "".join(" ".join(p) + rng.choice([" ", " ", "\n"]) for p in parts)))
    rows.append((5, rows[3][1]))  # a repeated id
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {}
    for r in passages.repeated_passages(docs).collect():
        got.setdefault(r.doc_id, []).append({k for s in r.spans for k in range(s.start, s.end)})
    n, owners = passages.SPAN, {}
    texts = [(i, words(t)) for i, t in rows]
    for i, w in texts:
        for k in range(len(w) - n + 1):
            owners.setdefault(tuple(w[k : k + n]), set()).add(i)
    for i, w in texts[:80]:
        if i == 5:
            continue
        own = [k for k in range(len(w) - n + 1) if len(owners[tuple(w[k : k + n])]) > 1]
        most = {j for k in own for j in range(k, k + n)}
        # maximal stretches of runs: those of 50 words or more must be whole
        sure, k = set(), 0
        while k < len(own):
            z = k
            while z + 1 < len(own) and own[z + 1] == own[z] + 1 and owners[tuple(w[own[z + 1] : own[z + 1] + n])] == owners[tuple(w[own[z] : own[z] + n])]:
                z += 1
            if own[z] - own[k] + n >= 50:
                sure |= set(range(own[k], own[z] + n))
            k = z + 1
        have = got.get(i, [set()])[0]
        lines = {j for j in have if j not in most}
        assert sure <= have, i
        assert not lines or "\n" in rows[i][1]  # beyond equal runs, only lines that are alike
    short = [(k, f"{prose(9, rng)}\nthe same line of {k // 2} stands here again and once more today\n{prose(8, rng)}") for k in range(8)]
    few = passages.repeated_passages(spark.createDataFrame(short, "doc_id long, text string"), least=10).collect()
    assert {(r.doc_id, r.component_id) for r in few} == {(k, k - k % 2) for k in range(8)}


def test_url_filter(spark):
    import datetime as D

    day = lambda n: D.date(2024, 1, 1) + D.timedelta(n)
    entries = [("bad.com", "spam", 10, "add"), ("bad.com", "spam", 20, "remove"), ("bad.com", "spam", 30, "add"), ("x.org/ads", "ads", 5, "add"), ("bad.com", "adult", 15, "add"), ("bad.com", "spam", 20, "remove"), (None, "spam", 1, "add")]
    captures = [("http://www.bad.com/a", 9), ("http://bad.com", 10), ("http://WWW.bad.com:80/a?b", 19), ("http://bad.com/", 20), ("http://bad.com/", 40), ("http://notbad.com/", 40), ("https://x.org/ads/1", 6), ("https://x.org/other", 6), (None, 6), ("http://bad.com", None), ("rubbish", 3)]
    e = spark.createDataFrame([(k, c, day(n), a) for k, c, n, a in entries], "key string, category string, effective date, action string")
    c = spark.createDataFrame([(i, u, None if n is None else day(n), "mine") for i, (u, n) in enumerate(captures)], "i int, url string, fetched_on date, blocked string")
    got = {r.i: r.block_categories for r in urlfilter.evaluate(c, e).collect()}
    assert [got[i] for i in range(len(captures))] == ["", "spam", "adult,spam", "adult", "adult,spam", "", "ads", "", "", "", ""]
    assert urlfilter.evaluate(c, e.limit(0)).filter("blocked").count() == 0 and urlfilter.evaluate(c.limit(0), e).count() == 0


PAGE = """<html><head><title>x</title></head><body><div id="cookie-banner">We use cookies</div><header><h1>Site</h1></header><nav>menu</nav><div class="wrap"><aside>side</aside>
<div class="post-content"><h1>Head&amp;line {}</h1><p>One <b>two</b> {}
 three<br>four<ul><li>a {}<li>b {}</ul><div class="share">Share!</div><p>{}&nbsp;para <script>if(a<b){{"</p>"}}</script></div><div class="comments"><p>Nice!</p></div></div><form><input>Sub</form><footer>f</footer></body></html>"""
PLAIN = "<html><body><p>Template line</p><div><p>{} one</p><p>{} two</p></div><p>Template end</p></body></html>"


def test_wrappers(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", (PAGE if i % 2 else PLAIN).replace("{}", f"T{i}").replace("{{", "{").replace("}}", "}")) for i in range(8)]
    rows += [(20, "http://h1.org/z", None), (21, None, "<p>alone"), (22, "http://h3.org", ""), (23, "http://h4.org", "<article>a <b>b</b><p>c&lt;d</article><footer>no"), (24, "x", "no tags & <3")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: r for r in wrappers.main_text(pages).collect()}
    for i in range(8):
        want = f"Head&line T{i}\n\nOne two T{i} three four\n\na T{i}\n\nb T{i}\n\nT{i} para" if i % 2 else f"T{i} one\n\nT{i} two"
        assert (got[i].text, got[i].n_chars) == (want, len(want))
    assert [got[i].text for i in (20, 22, 23)] == ["", "", "a b\n\nc<d"] and got[21].text == "alone" and got[24].text == "no tags & <3"
    assert wrappers.main_text(pages.limit(0)).count() == 0


def main_of(pages):
    trees = [wrappers.parse(p) for p in pages]
    w = wrappers.locate(wrappers.infer(trees))
    return ["\n\n".join(wrappers.extract(t, w)) for t in trees]


def test_slots_decide(monkeypatch):
    """Without any list of names, what differs from page to page is the article; names don't overrule slots."""
    rng = random.Random(6)
    own = [[prose(40, rng) for _ in range(rng.randint(2, 6))] for _ in range(6)]
    plain = [PAGE.replace("{{", "{").replace("}}", "}").replace("{}", f"T{i}") for i in range(4)]
    blocks = [f"<div>Site name</div><div>Menu<span>Home</span></div><div><div>{''.join(f'<p>{t}</p>' for t in o)}<div>Share this now</div></div></div><div>Contact us here</div>" for o in own]
    liar = ['<div class="content">Buy our things here today</div>' + b for b in blocks]
    want = ["\n\n".join(o) for o in own]
    named = main_of(plain)
    assert main_of(liar) == want  # the element that says "content" holds nothing that differs
    alone = wrappers.parse(blocks[0])
    assert "\n\n".join(wrappers.extract(alone, wrappers.locate(wrappers.fold(alone)))) != want[0]  # one page doesn't tell
    monkeypatch.setattr(wrappers, "AWAY_NAMES", re.compile("(?!)"))
    monkeypatch.setattr(wrappers, "MAIN_NAMES", re.compile("(?!)"))
    monkeypatch.setattr(wrappers, "AWAY", set())
    monkeypatch.setattr(wrappers, "AWAY_ROLES", set())
    assert main_of(blocks) == want and main_of(plain) == named


def test_deep_and_long_pages(spark):
    deep = "<div>" * 4000 + "<p>deep text</p>" + "</div>" * 4000
    long = "<article>" + "".join(f"<h{k % 6 + 1}>t{k}</h{k % 6 + 1}><{'p' if k % 3 else 'pre'}>x{k}" for k in range(20_000)) + "</article>"
    rows = [(1, "http://a.org/1", deep), (2, "http://a.org/2", deep.replace("deep", "other")), (3, "http://b.org/1", long), (4, "http://b.org/2", long.replace("x7", "<i>y7</i><section>z</section>"))]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "deep text" and got[2] == "other text"
    assert got[3].count("\n\n") == 39_999


def test_alignment():
    rng = random.Random(3)
    node = lambda s: wrappers.Node(s)
    for n in (5, 30, 600):
        x = [rng.choice("abcdefgh") + (str(rng.randrange(400)) if n > 100 else "") for _ in range(n)]
        y = [c for c in x if rng.random() < 0.9]
        for _ in range(n // 10):
            y.insert(rng.randrange(len(y) + 1), "new")
        got = wrappers.matches(list(map(node, x)), list(map(node, y)))
        assert [i for i, _ in got if i is not None] == list(range(len(x))) and [j for _, j in got if j is not None] == list(range(len(y)))
        assert all(x[i] == y[j] for i, j in got if i is not None and j is not None)
        assert sum(i is not None and j is not None for i, j in got) >= 0.8 * n


def test_wrapper_expressions():
    w = wrappers.infer(map(wrappers.parse, ["<ul><li>a</ul><p>x", "<ul><li>a<li>b</ul><h2>t</h2><p>x", "<p>y"]))
    kinds = {c.label: (c.optional, c.repeated) for c in w.children}
    assert kinds == {"ul": (True, False), "h2": (True, False), "p": (False, False)}
    assert w.children[-1].children[0].text is None  # x and y: a slot
    again = wrappers.Node.load(w.dump())
    assert again == w and w.seen == 3


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    step, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, step, sf)
        assert new.columns == docs.columns
        assert new.select("doc_id").subtract(step.select("doc_id")).count() == 0
        kept.append({r.doc_id for r in new.select("doc_id").collect()})
        step = new
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = {}
    for i in sorted(kept[0]):
        first.setdefault(norm(texts[i]), i)
    assert kept[1] == set(first.values())
    assert len(kept[3]) > 0.5 * len(texts)
    last = corpus_pipeline.STAGES[-1][1](spark, step, sf).select("doc_id", "decoded_sha256").collect()
    assert {r.doc_id: r.decoded_sha256 for r in last} == {i: hashlib.sha256(texts[i].encode()).hexdigest() for i in kept[3]}


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, blanks, repeated rows, further columns and empty tables pass through every stage."""
    import corpus_pipeline

    spark.createDataFrame([(i, 0) for i in range(4)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, ITEMS[0])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, BASE[0], "a"), (1, BASE[0], "a"), (2, BASE[0].replace(" ", "  "), "a"), (3, None, "a"), (4, "", "b"), (5, BASE[1], None), (6, ITEMS[0], "b"), (7, prose(3000), "c")]
    docs = spark.createDataFrame([(*r, "x", 5.0) for r in rows], "doc_id long, text string, source string, id string, score double").repartition(3)
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns, name
    assert sorted(r.doc_id for r in step.collect()) == [1, 1, 3, 5, 7]
    last = corpus_pipeline.STAGES[-1][1](spark, step, str(tmp_path))
    assert {r.doc_id: r.n_tokens for r in last.collect()}[3] == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, f"{tmp_path}/none").count() == len(rows)  # nothing learnt, nothing rejected


@pytest.mark.parametrize("block", [4000, 3])
def test_near_copies_like_brute_force(spark, monkeypatch, block):
    """All that the pipeline's stage should drop at a Jaccard similarity of 0.8 is dropped, and no more."""
    import corpus_pipeline

    from folioflow.llm import near

    monkeypatch.setattr(near, "BLOCK_ROWS", block)
    rng = random.Random(21)
    texts = ["", " \n", None, "one two", "One  two", "three"]
    for _ in range(40):
        base = prose(rng.randint(60, 300), rng).split()
        texts.append(" ".join(base))
        for _ in range(3):
            new = base[:]
            for at in rng.sample(range(len(new)), max(1, len(new) // rng.randint(35, 120))):
                new[at] = rng.choice(VOCAB)
            texts.append(" ".join(new))
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for w in map(words, texts)]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = reach(len(texts), edges)
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, node int").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    want = {i for i, r in enumerate(root) if r == i}
    assert want <= got and len(got) - len(want) <= 0.02 * (len(texts) - len(want))
    assert near.near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("piece", "changes", "most"), [(256, 2, 6), (20, 3, 30)])
def test_near_copies_of_one_text(spark, monkeypatch, piece, changes, most):
    """A large group of near copies isn't compared once for each of the 48 nodes that its texts lie below; no link is lost."""
    from folioflow.llm import near

    monkeypatch.setattr(near, "PIECE", piece)
    held = {}

    def keep(df, name):
        out = stored(df, name)
        held.setdefault(name, []).append(out.count())
        return out

    stored = near.stored
    monkeypatch.setattr(near, "stored", keep)
    rng = random.Random(31)
    base, texts = prose(200, rng).split(), []
    for copies in [300] + 40 * [1]:
        for _ in range(copies):
            new = base[:]
            for at in rng.sample(range(len(new)), changes):
                new[at] = rng.choice(VOCAB)
            texts.append(" ".join(new))
        base = prose(rng.randint(60, 300), rng).split()
    half = base[: len(base) // 2] + prose(len(base), rng).split()
    texts += [" ".join(base), " ".join(half)]
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for w in map(words, texts)]
    root = reach(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near.near_copies(docs).collect()} == dict(enumerate(root))
    assert sum(held["near-candidates"]) < most * len(texts)


def test_near_copies_by_fingerprints(spark, monkeypatch):
    """The stage's candidates are those of operator 10's fingerprints and index, whole or with its nodes cut in blocks."""
    from folioflow.llm import near

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, textops.U)) for n in (1, 2, 9, 300, 255, 256, 2000)]
    words = near.fingerprints(sets, 2)
    for k, seed in enumerate(np.random.default_rng(5).integers(0, 1 << 63, 4, textops.U)):
        for s, f in zip(sets, words[:, k].tolist(), strict=True):
            hashes = textops.mix(s ^ seed).tolist()
            assert f == sum((sum(h >> i & 1 for h in hashes) * 2 > len(hashes)) << i for i in range(64))

    wide = rng.integers(0, 1 << 63, (30, 2), textops.U)
    flips = [[textops.U(sum(1 << b for b in rng.choice(64, rng.integers(0, 25), False).tolist())) for _ in range(2)] for _ in range(90)]
    wide = np.concatenate([wide, wide[np.arange(90) % 30] ^ np.array(flips)])
    apart = np.bitwise_count(wide[:, None] ^ wide).sum(axis=2, dtype=int)
    want = reach(120, [(i, j) for i in range(120) for j in range(i) if apart[i, j] <= near.DISTANCE])
    order = np.argsort(simhash.gray_rank(wide[:, 0]))
    root = simhash.near_pairs(wide[order], None, near.DISTANCE)
    assert {frozenset(order[root == r].tolist()) for r in set(root)} == {frozenset(i for i in range(120) if want[i] == w) for w in set(want)}

    texts = [rng.integers(0, 1 << 63, 60, textops.U) for _ in range(150)]
    texts += [np.concatenate([t[:56], rng.integers(0, 1 << 63, 4, textops.U)]) for t in texts]
    width, several = near.plan(len(texts))
    words = near.fingerprints(texts, several)
    nodes = spark.createDataFrame([(i, w) for i, w in enumerate(words.view(np.int64).tolist())], "id long, words array<long>").repartition(3)
    for most in (near.NODE_ROWS, 2):
        monkeypatch.setattr(near, "NODE_ROWS", most)
        groups = {}
        for r in near.candidates(nodes, width, len(texts)).collect():
            groups.setdefault(r.key, set()).add(r.id)
        assert all(any({i, i + 150} <= g for g in groups.values()) for i in range(150))
        assert sum(map(len, groups.values())) < 2 * len(texts)


def test_passages_to_their_ends(spark):
    """An equal run is a span from its first word to its last."""
    rng = random.Random(31)
    rows, want = [], {}
    for n in range(51, 91, 3):
        shared = prose(n, rng)
        for i in (2 * n, 2 * n + 1):
            head = rng.randint(16, 50)
            rows.append((i, f"{prose(head, rng)} x{i} {shared} y{i} {prose(rng.randint(16, 50), rng)}"))
            want[i] = (head + 1, head + 1 + n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    for i, run in want.items():
        for spans in (got[i].spans, got[i].remove) if i % 2 else (got[i].spans,):
            (s,) = spans
            assert run[0] - 3 <= s.start <= run[0] and run[1] <= s.end <= run[1] + 3, i  # alike paragraphs may take three words along
        assert i % 2 or not got[i].remove


def test_passages_alike_like_brute_force(spark):
    """Paragraphs with changed words, similar at 0.8 or more, link whatever place the changes have."""
    rng = random.Random(41)
    rows, pairs = [], []
    for k in range(90):
        n, at = [(100, (33, 66)), (60, (30,)), (70, (35,))][k % 3]
        a = prose(n, rng).split()
        b = [f"other{k}" if i in at else x for i, x in enumerate(a)]
        sets = [{tuple(w[i : i + 5]) for i in range(n - 4)} for w in (words(" ".join(x)) for x in (a, b))]
        assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
        for i, x in ((2 * k, a), (2 * k + 1, b)):
            rows.append((i, f"{prose(40, rng)}\n{' '.join(x)}\n{prose(30, rng)}"))
        pairs.append(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    whole = [k for k in range(90) if 2 * k + 1 in got and any(s.start <= 40 and 40 + pairs[k] <= s.end for s in got[2 * k + 1].remove)]
    assert len(whole) >= 0.95 * len(pairs)
    for k in whole:
        assert got[2 * k + 1].component_id == 2 * k and not got[2 * k].remove
        assert all(37 <= s.start and s.end <= 43 + pairs[k] for s in got[2 * k + 1].remove), got[2 * k + 1]


@pytest.fixture(scope="module")
def repeated(spark):
    """Ids that stand on equal rows, on rows of other texts, and on empty ones."""
    return spark.createDataFrame([(1, BASE[0]), (1, BASE[0]), (1, BASE[1]), (2, BASE[0]), (3, None), (3, ""), (4, BASE[1])], "doc_id long, text string").repartition(3)


def test_repeated_ids_of_copies(repeated):
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(repeated).collect())
    assert got == [(1, 1, 2, True), (1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False), (3, 3, 2, True), (3, 3, 2, True), (4, 1, 2, False)]
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(repeated).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 1)]


def test_repeated_ids_of_tokens(repeated, tmp_path):
    import tiktoken
    from tokenizers import Tokenizer

    texts = [(r.doc_id, r.text or "") for r in repeated.collect()]
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(repeated, ranks, P.PATTERN).collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in got) == sorted((i, np.array(enc.encode_ordinary(t), "<u4").tobytes()) for i, t in texts)
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = sorted(tokenfile.read_digests(tokenfile.write_tokens(repeated, path, 2, "file://" + str(tmp_path))).collect(), key=lambda r: r.start)
    want = [(i, zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in texts]
    assert sorted((r.doc_id, r.ids_crc32) for r in got) == sorted(want)
    assert [r.doc_id for r in got] == sorted(i for i, _ in texts)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]


def test_repeated_ids_of_scores(repeated):
    got = [(r.doc_id, r.n_tokens, round(r.score, 6)) for r in ngram.score(repeated, ngram.train(repeated)).collect()]
    assert Counter((i, n) for i, n, _ in got) == Counter((r.doc_id, len(words(r.text)) + 1) for r in repeated.collect())
    assert len({s for _, n, s in got if n == 1}) == 1  # null and empty texts are the end alone
    assert len(set(got)) == len({(r.doc_id, r.text or "") for r in repeated.collect()})


def test_repeated_ids_of_leaks(spark):
    host = BASE[2].split()
    leak = " ".join([*host[:40], ITEMS[0], *host[40:]])
    docs = spark.createDataFrame([(1, leak), (1, leak), (1, BASE[3]), (2, BASE[4]), (3, prose(30_000) + " " + ITEMS[0])], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(ITEMS), (0, ITEMS[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert got == {(1, 0), (3, 0)}


def test_repeated_pages_and_captures(spark):
    import datetime as D

    page = "<article><p>one two</p></article>"
    pages = spark.createDataFrame([(1, "http://a.org/", page)] * 2 + [(1, "http://a.org/b", "<article>three</article>")], "page_id long, url string, html string")
    assert sorted(r.text for r in wrappers.main_text(pages).collect()) == ["one two", "one two", "three"]
    entries = spark.createDataFrame([("bad.com", "spam", D.date(2024, 1, 1), "add")] * 3, "key string, category string, effective date, action string")
    captures = spark.createDataFrame([(1, "http://bad.com/a", D.date(2024, 2, 1))] * 2 + [(1, "http://good.com/a", D.date(2024, 2, 1))], "i int, url string, fetched_on date")
    assert sorted(r.block_categories for r in urlfilter.evaluate(captures, entries).collect()) == ["", "spam", "spam"]
