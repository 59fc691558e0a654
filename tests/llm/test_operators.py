"""The training-data operators against brute-force versions and libraries, on tables of the smallest scale and on odd input."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylens.llm import components, decontamination, embedding_dedup, html_extraction, language_id, pretokenizer, quality, registry, sentencepiece_wfst, simhash, token_counts, token_ids, url_filters
from quarrylens.llm.common import scratch, table

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, fp string"
ODD = [
    (1, "The same words stand here, the same words stand here, more than eight of them.", "en", "a", 1, 0.5, "x", "y"),
    (1, "The same words stand here, the same words stand here, more than eight of them.", "en", "a", 1, 0.5, "x", "y"),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", None, 0, None, None, None),
    (None, "no id at all <|endoftext|> and ▁ signs", None, None, None, None, None, None),
    (4, "  \n\t ", "de", "b", 5, None, None, None),
    (5, "wort " * 30000, "de", "b", 5, None, None, None),
    (6, "漢字🙂 \u00a0é ÄÖ 123", "de", "b", 5, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}


def library(name="byte_bpe_50k.json"):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def noise(n, seed=1):
    rnd = random.Random(seed)
    signs = [*"abst rdvlemd'''  \n\t!?1234éßÇ漢字🙂\u2003\u3000▁<>", "<|endoftext|>", "<s>", "<0x0A>", "the ", "ing", " of"]
    return ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(n)] + ["", "", "<|endoftext|>"]


# --- 1


def test_urls_by_rule_and_method(spark):
    urls = ["http://A.Example.ORG/en/1x?q", "https://example.org/en/2", "https://x.example.org/es/", "http://b.com/fr/1", "http://b.com/de/1", "http://com/de/", "http://notcom.net/x", "nothing", None, "", "http://xorg/", "http://org", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "clash", 1.0) for i, u in enumerate([*urls, *urls])], "page_id long, url string, host string, score double")
    got = {r.page_id: r for r in url_filters.url_filter(df).collect()}
    assert len(got) == 2 * len(urls)
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == [
        ("a.example.org", "/en/1x", "example.org/en/1"), ("example.org", "/en/2", "org/"), ("x.example.org", "/es/", "example.org/es/"), ("b.com", "/fr/1", "com/fr/"), ("b.com", "/de/1", "com/de/"), ("com", "/de/", "com/de/"),
        ("notcom.net", "/x", None), ("", "", None), ("", "", None), ("", "", None), ("xorg", "/", None), ("org", "", None), ("b:", "//c/d", None),
    ]
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filters.url_filter(df.limit(0)).count() == 0


def test_url_scores_by_brute_force(spark):
    rows = url_filters.op1_url_filters(spark, DATA).collect()
    fold = lambda s: re.sub(r"(?s)[^a-z0./_-]", "~", re.sub("[0-9]", "0", s.translate({c: c + 32 for c in range(65, 91)})))
    kind = {h + p: v for v, h, p in url_filters.RULES}
    k = url_filters.ORDER
    counts = {"allow": collections.Counter(), "block": collections.Counter()}
    grams = lambda t: [("^" * k + t + "$")[i : i + k + 1] for i in range(len(t) + 1)]
    for r in rows:
        if r.rule:
            counts[kind[r.rule]].update(grams(fold(r.host + r.path)))

    def p(c, gram):
        out = 1 / url_filters.SYMBOLS
        for o in range(k + 1):
            after = collections.Counter()
            for g, n in c.items():
                if g[k - o : k] == gram[k - o : k]:
                    after[g[k]] += n
            n, t = sum(after.values()), len(after)
            if n:
                out = (after[gram[k]] + t * out) / (n + t)
        return out

    for r in rows[:6]:
        g = grams(fold(r.host + r.path))
        assert r.score == pytest.approx(sum(math.log(p(counts["allow"], x) / p(counts["block"], x)) for x in g) / len(g), abs=1e-6)


# --- 2


def test_quality_on_held_out(spark):
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = quality.op2_quality(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_quality_fit_is_the_optimum():
    """The fitted weights against the definition: no step in any direction lessens the loss of the drawn pairs."""
    rng = np.random.default_rng(3)
    x, good = rng.normal(size=(400, 6)), np.arange(400) % 2 == 0
    x[good, 0] += 1.0
    ranker = quality.Ranker(x, good)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    draw = np.random.default_rng(42)
    a, b = draw.choice(np.flatnonzero(good), quality.PAIRS), draw.choice(np.flatnonzero(~good), quality.PAIRS)
    loss = lambda w: np.logaddexp(0, -(z[a] - z[b]) @ w).sum() + quality.RIDGE * (w @ w) / 2
    for step in (1e-2, 1e-3):
        assert all(loss(ranker.w) < loss(ranker.w + step * s * e) for e in np.eye(6) for s in (1, -1))
    scores = ranker.score(x)
    share = np.mean(scores >= quality.CUT)
    assert share == pytest.approx(good.mean(), abs=0.01) and ((scores >= quality.CUT) == (z @ ranker.w >= ranker.threshold)).mean() > 0.995


def test_quality_learns_from_all_pairs_of_all_rows(spark):
    """Weights against the gradient over all pairs, threshold and means against numpy, over more rows than any sample had."""
    rnd = random.Random(4)
    for n in (500, 24_000):
        texts = ["".join(rnd.choice(("ab cd ", "efg ", "hi, ", "3 ", "X. ", "jk\n")) for _ in range(rnd.randrange(1, 9))) for _ in range(n)]
        good = np.array([rnd.random() < (0.75 if "3" in t else 0.35) for t in texts])
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        model = quality.train(df, spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int"))
        x = quality.features(texts).astype(float)
        assert np.abs(model.mean - x.mean(axis=0)).max() < 1e-5
        z = (x - model.mean) * model.scale
        s = z @ model.w
        assert model.threshold == pytest.approx(np.quantile(s, 1 - good.mean()), abs=1e-9)
        if n == 500:
            p = 1 / (1 + np.exp(s[good][:, None] - s[~good]))
            gradient = p.mean(axis=1) @ z[good] / good.sum() - p.mean(axis=0) @ z[~good] / (~good).sum() - quality.RIDGE / quality.PAIRS * model.w
            assert np.abs(gradient).max() < 1e-5


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    ranker = quality.train(odd, labels)
    rows = quality.score_quality(odd, ranker).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.train(odd, labels.limit(0)) is None
    assert {r.score for r in quality.score_quality(odd, None).collect()} == {0.7}
    assert quality.keep_good(odd, None).columns == odd.columns and quality.keep_good(odd, ranker).count() <= len(ODD)
    assert quality.score_quality(odd.limit(0), ranker).count() == 0


# --- 3


def test_sentencepiece_is_the_librarys(spark, docs):
    import sentencepiece

    path = sentencepiece_wfst.default_model()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    machine = sentencepiece_wfst.Transducer(sentencepiece_wfst.Model(path))
    for t in [*noise(1500), *list(docs.values())[:60]]:
        ids = machine.encode(t)
        assert ids == lib.encode(t)
        assert machine.decode(ids) == lib.decode(ids)


def test_shortest_path_of_weights():
    """The relaxation over the tropical semiring against all ways to cut a text, with the scores of the file as weights."""
    model = sentencepiece_wfst.Model(sentencepiece_wfst.default_model())
    model.bpe = False
    machine = sentencepiece_wfst.Transducer(model)
    rnd = random.Random(5)
    for _ in range(200):
        text = "".join(rnd.choice(["the", "ing", "an", "s", "e", "er", "▁"]) for _ in range(rnd.randrange(1, 5)))[:9]
        ways = [[]]
        for i in range(1, len(text) + 1):
            ways.append([[*w, model.pieces[text[j:i]]] for j in range(i) if text[j:i] in model.pieces for w in (ways[j] or ([[]] if j == 0 else []))])
        weight = lambda ids: -sum(model.scores[i] for i in ids)
        assert weight(machine.shortest_path(text)) == pytest.approx(min(map(weight, ways[-1])))


def test_sentencepiece_odd(spark, odd):
    rows = sentencepiece_wfst.with_pieces(odd.withColumnRenamed("score", "ids"), sentencepiece_wfst.default_model()).collect()
    assert len(rows) == len(ODD) and {r.n_pieces for r in rows if r.doc_id in (2, 3)} == {0}
    assert sum(not r.round_trip for r in rows) == 1  # the text with U+2581
    digest = sentencepiece_wfst.sentencepiece_digest(odd, sentencepiece_wfst.default_model()).collect()
    assert sorted(r.n_pieces for r in digest) == sorted(r.n_pieces for r in rows)


# --- 4


def brute_fingerprint(text, k=3):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(p, 42) >> b & 1 for p in parts) for b in range(64)]
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(parts))


def classes_of(values, budget):
    values = np.array(values, np.uint64)
    return simhash.merge(np.arange(len(values)), *np.where(np.bitwise_count(values[:, None] ^ values[None, :]) <= budget))


def wide_classes_of(codes, budget, whole_budget):
    bits = np.bitwise_count(codes[:, None, :] ^ codes[None, :, :]).astype(int)
    return simhash.merge(np.arange(len(codes)), *np.where((bits[:, :, 0] <= budget) & (bits.sum(axis=2) <= whole_budget)))


def test_simhash_classes(spark, docs, odd):
    ids = sorted(docs)
    prints = [brute_fingerprint(docs[i]) for i in ids]
    labels = classes_of(prints, 3)
    got = {r.doc_id: r for r in simhash.op4_simhash(spark, DATA).collect()}
    assert {i: (f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, labels)} == {i: (r.fingerprint, r.component_id) for i, r in got.items()}
    rows = simhash.simhash_classes(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2} and {r.fp for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert simhash.simhash_classes(odd.limit(0)).count() == 0


@pytest.mark.parametrize("budget,hot", [(3, 8192), (6, 8192), (3, 400)])
def test_forest_finds_every_link(spark, monkeypatch, budget, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(0)
    values = set(map(int, rng.integers(0, 2**63, 300, dtype=np.uint64)))
    for base in map(int, rng.integers(0, 2**63, 4, dtype=np.uint64)):
        for _ in range(200):
            x = base
            for bit in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= 1 << int(bit)
            values.add(x)
    values = sorted(values)
    nodes = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    root = {v: v for v in values} | {r.a % 2**64: r.b % 2**64 for r in components.components(simhash.forest_links(nodes, budget)).collect()}
    want, got = collections.defaultdict(set), collections.defaultdict(set)
    for v, c in zip(values, classes_of(values, budget).tolist()):
        want[c].add(v)
        got[root[v]].add(v)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


@pytest.mark.parametrize("crowd", [1 << 15, 300])
def test_wide_forest_finds_every_link(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "DENSE", (64, 1 << 12))
    rng = np.random.default_rng(2)
    codes = [rng.integers(0, 2**64, 4, dtype=np.uint64) for _ in range(200)]
    for base in list(codes[:3]):
        for _ in range(400):
            flips = np.packbits(rng.random(256) < rng.choice([0.03, 0.1, 0.2]), bitorder="little").view(np.uint64)
            codes.append(base ^ flips)
    codes = np.unique(np.stack(codes), axis=0)
    nodes = spark.createDataFrame([tuple(map(int, c)) for c in codes.view(np.int64)], "fp long, w1 long, w2 long, w3 long")
    name = lambda c: tuple(map(int, c))
    root = {name(c): name(c) for c in codes.view(np.int64)}
    root |= {name(r.a): name(r.b) for r in components.components(simhash.forest_links(nodes, 11, 4, 44)).collect()}
    want, got = collections.defaultdict(set), collections.defaultdict(set)
    for c, label in zip(codes.view(np.int64), wide_classes_of(codes, 11, 44).tolist()):
        want[label].add(name(c))
        got[root[name(c)]].add(name(c))
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values())) and 3 < len(want) < len(codes)


def near_copies(rng, similarity, n_words=200):
    """A text and a copy with words replaced one by one until the 5-word shingles' similarity is just above the one given."""
    words = [f"w{x}" for x in rng.integers(0, 5000, n_words)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    copy, own = list(words), shingles(words)
    for place in rng.permutation(n_words):
        changed = list(copy)
        changed[place] = "other" + str(place)
        theirs = shingles(changed)
        if len(own & theirs) / len(own | theirs) < similarity:
            break
        copy = changed
    return " ".join(words), " ".join(copy)


@pytest.mark.parametrize("similarity,recall", [(0.95, 1.0), (0.9, 0.98), (0.85, 0.95), (0.8, 0.84)])
def test_recall_of_near_copies(similarity, recall):
    """Pairs of just that similarity, and pairs far from it: the figures that the README gives."""
    rng = np.random.default_rng(4)
    found = []
    for _ in range(300):
        a, b = (simhash.fingerprint(t, 5, simhash.WORDS) for t in near_copies(rng, similarity))
        bits = np.bitwise_count(a ^ b).astype(int)
        found.append(bits[0] <= 13 and bits.sum() <= simhash.allowed_bits(0.8, 256))
    print(similarity, np.mean(found))
    assert np.mean(found) >= recall
    far = []
    for _ in range(200):
        a, b = (simhash.fingerprint(t, 5, simhash.WORDS) for t in near_copies(rng, 0.5))
        far.append(np.bitwise_count(a ^ b).sum() <= simhash.allowed_bits(0.8, 256))
    assert not any(far)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    assert {r.a: r.b for r in components.components(links).collect()} == {i: 0 for i in range(1, 41)} | {101: 100}
    assert components.components(links.limit(0)).count() == 0


# --- 5 and 6


def test_token_counts(spark, docs, odd):
    lib = library()
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    got = {r.doc_id: r for r in token_counts.op5_token_counts(spark, DATA).collect()}
    assert {i: (len((t or "").encode()), n(t), n(t) > 512) for i, t in docs.items()} == {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in got.items()}
    texts = spark.createDataFrame(list(enumerate(noise(2000))), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(texts, public_tokenizers.path("byte_bpe_50k.json")).collect()} == {i: n(t) for i, t in enumerate(noise(2000))}
    rows = token_counts.token_counts(odd, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted((r.n_tokens for r in rows)) == sorted(n(r[1]) for r in ODD)


def test_pretokenizer_chunks_are_seamless():
    lib = library()
    classes = pretokenizer.compile_classes(lib)
    long = "".join(noise(400, 7)).replace("<|endoftext|>", "")
    distinct, index, per_text = pretokenizer.split_texts([long, "", long[:5]], classes)
    want = [long[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(long)]
    assert [distinct[i] for i in index[: per_text[0]]] == want and per_text[1] == 0


def test_acceptor_of_neighbours():
    vocab, ranks, _ = token_counts.read_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    machine = token_counts.BpeMachine(vocab, ranks)
    rnd, tokens = random.Random(3), [t for t in vocab if machine.merge(t) == [t]]
    for _ in range(20000):
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        assert machine.adjacent(a, b) == (machine.merge(a + b) == [a, b])


@pytest.mark.parametrize("bits", [1, 3, 8, 9, 16, 17, 31])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 999).astype(np.uint32)
    packed = token_ids.pack(ids, bits)
    assert len(packed) == -(-999 * bits // 8)
    assert (token_ids.unpack(packed, bits, 0, 999) == ids).all() and (token_ids.unpack(packed, bits, 321, 77) == ids[321:398]).all()
    with pytest.raises(ValueError):
        token_ids.pack(np.array([1 << bits], np.uint64), bits)


def test_token_id_files(spark, docs, odd, tmp_path):
    lib = library()
    ids = lambda t: np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
    start, want = 0, {}
    for i in sorted(docs):
        x = ids(docs[i])
        want[i] = (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    assert want == {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_ids.op6_token_ids(spark, DATA).collect()}
    token_ids.write_token_ids(odd, str(tmp_path / "odd"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    rows = token_ids.documents_of(token_ids.read_token_ids(spark, str(tmp_path / "odd")), with_ids=True).orderBy("start").collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in rows] == [r[0] for r in order] and [list(r.ids) for r in rows] == [ids(r[1]).tolist() for r in order]
    token_ids.write_token_ids(odd.limit(0), str(tmp_path / "none"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert token_ids.documents_of(token_ids.read_token_ids(spark, str(tmp_path / "none"))).count() == 0


# --- 7


@pytest.mark.parametrize("chunk", [2048, 8])
def test_embeddings_by_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1):
        for base in rng.normal(size=(12, 24)):
            rows += [(label, (base + rng.normal(size=24) * s).tolist()) for s in (0.0, 0.0, 0.15, 0.25, 0.3, 0.4)]
    rows += [(0, [0.0] * 24), (None, rows[0][1]), (0, None), (0, []), (0, [float("nan")] + [1.0] * 23), (0, [None] + [1.0] * 23), (0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, x, "clash") for i, (x, v) in enumerate(rows)], "vec_id long, embedding array<double>, label int, cid string")
    links = np.zeros((len(rows), len(rows)), bool)
    for i, (a, x) in enumerate(rows):
        for j, (b, y) in enumerate(rows):
            if i != j and a is not None and a == b and x and y and len(x) == len(y) and None not in x + y and np.isfinite(x + y).all() and any(x) and any(y):
                links[i, j] = np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93
    labels = simhash.merge(np.arange(len(rows)), *np.where(links))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert got == {i: (int(links[i].sum()), int(labels[i]), bool(labels[i] == i)) for i in range(len(rows))}
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


# --- 8


def test_decontamination_by_brute_force(spark, docs):
    words = lambda t: re.sub(r"[^\w ]+", "", " ".join((t or "").lower().split())).split()
    w, least = decontamination.WINDOW, decontamination.RUN - decontamination.WINDOW + 1
    want = set()
    items = {r.item_id: words(r.text) for r in table(spark, DATA, "benchmark").collect()}
    for i, t in docs.items():
        mine = {tuple(x) for x in zip(*(words(t)[k:] for k in range(w)))}
        for item, theirs in items.items():
            hits = sum(tuple(theirs[k : k + w]) in mine for k in range(len(theirs) - w + 1))
            if hits >= least:
                want.add((i, item))
    assert {(r.doc_id, r.item_id) for r in decontamination.op8_decontamination(spark, DATA).collect()} == want


def test_decontamination_slots(spark, odd):
    item = "well Tom has 5 apples and buys 7 more apples at the market on the hill today so how many"
    texts = [
        item, "so then Bob has 12 apples and buys 30 more apples at the market on the hill today so how many",  # re-parameterised
        "well Tom has 5 apples and buys nothing else", "short one", None, "",
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts + texts)], "doc_id long, text string, digest string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, "Short, one!"), (3, None), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.reparameterised) for r in decontamination.contaminated(df, bench).collect()}
    assert got == {(0, 1, False), (6, 1, False), (1, 1, True), (7, 1, True), (3, 2, False), (9, 2, False)}
    assert sorted(r.doc_id for r in decontamination.without_contaminated(df, bench).collect()) == [2, 4, 5, 8, 10, 11]
    clash = decontamination.without_contaminated(df.withColumnsRenamed({"digest": "h"}).select("*", F.lit(1).alias("digest"), F.lit(2).alias("item")), bench)
    assert clash.columns == ["doc_id", "text", "h", "digest", "item"] and clash.count() == 6
    assert decontamination.contaminated(df.limit(0), bench).count() == 0 and decontamination.contaminated(odd, bench.limit(0)).count() == 0
    torn = spark.createDataFrame([(1, "then Ann has 5 apples and Bob has 5 apples, but they also say Cid has 9 apples here")], "doc_id long, text string")
    same = spark.createDataFrame([(9, "then Ann has 5 apples and Ann has 5 apples, but they also say Ann has 5 apples here")], "item_id long, text string")
    assert decontamination.contaminated(torn, same).count() == 0  # one slot value would stand for several


def test_decontamination_short_items_at_each_offset(spark):
    before, after = "so here is one text that goes on ".split(), "and then it goes on for a while yet".split()
    lists = {n: [f"{chr(97 + n)}{'x' * (k + 1)}" for k in range(n)] for n in (1, 3, 7, 8, 9, 10, 12)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in lists.items()], "item_id long, text string")
    rows = [(100 * n + at, " ".join((before * 2)[:at] + w + after)) for n, w in lists.items() for at in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.coverage) for r in decontamination.contaminated(df, bench).collect()}
    assert got == {(i, i // 100, 1.0) for i, _ in rows}


def test_decontamination_window_keys(spark):
    """Keys are equal exactly for equal windows, plain or templated; the search plan makes each text's words once, in one step before its windows."""
    texts = ["a b c a b c d", "so Tom has 5 km to go", "so Bob has 7 km to go", "one", " . ", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    made = decontamination.window_keys(df, ["id"], "t", [2, 3])
    got = collections.defaultdict(list)
    for r in made.collect():
        got[r.id].append(r.h)
    windows = {0: "a b c a b c d".split(), 1: "so tom has 5 km to go".split(), 2: "so bob has 7 km to go".split()}
    assert set(got) == set(windows)
    assert len(got[0]) == 6 + 5 and len(set(got[0])) == 4 + 4  # no template words of its own
    assert len(got[1]) == len(got[2]) == (6 + 5) + (5 + 5)  # "to go" and none of the longer ones is its own template
    # plain: "km to", "to go", "km to go"; templated: all five and five
    assert len(set(got[1]) & set(got[2])) == 3 + 5 + 5
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("‹›]+") == 1


def test_decontamination_verbatim_and_runs(spark):
    numbers = "2 4 8 16 32 64 128 256 512 1024 2048 4096 8192 3 5 7"
    named = "when Ann met Bob she gave Bob 3 pears and then Ann told Bob that Ann had 9 more while Bob said to Ann that he wants 12 of them all"
    changed = "then Ann takes 5 red apples from the old shop and walks 7 long miles with them home where Ann eats 5 of them"
    bench = spark.createDataFrame([(1, numbers), (2, named), (3, changed)], "item_id long, text string")
    late = " and ".join([named, "so it goes on", "then Ann slept"])
    texts = {
        10: f"here are the powers {numbers} and so on", 11: "here are the powers 9 8 7 6 5 4 3 2 1 11 12 13 14 15 16 17 and so on",
        20: late, 21: named.lower(), 22: named.replace("12 of", "13 of").replace("to Ann", "to Cid"),
        30: "so then Eve takes 6 red apples from the old shop and walks 8 long miles with them home where Tom eats 9 of them",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontamination.contaminated(df, bench).collect()}
    assert got == {(10, 1): False, (20, 2): False, (21, 2): False, (22, 2): True, (30, 3): True}


# --- 9


def test_main_text():
    f = html_extraction.main_text
    page = '<body><header><p>Site</p></header><nav><ul><li><a href="/">Menu</a></ul></nav><div class="sidebar">x</div><article><h1>T &amp; x</h1><div class="cookie-notice">n</div><p>Hello<br>wor<b>ld</b>\n 1 &lt; 2<p>second<script>var t="</p>";</script><form><p>f</p></form><aside>q</aside><section class="comments"><p>c</p></section></article><!-- a --><div id="comments">z</div><footer>&copy; x</footer></body>'
    assert f(page) == "T & x\n\nHello world 1 < 2\n\nsecond"
    assert f(None) == f("") == f("<html></html>") == ""
    assert f("<article>" + "<p>x" * 20000 + "</article>").count("x") == 20000
    assert f("<article>a < b <p unclosed='") .startswith("a < b")


LONG = "This paragraph has many words, and they stand there so that it is long enough to be seen as text of the page."
#: Pages with their main text, written by hand.
TRUTH = [
    # no mark of an article: title and byline before, short paragraphs between and after
    (f"<body><div><a href=/>Home</a></div><div><a href=/n>News</a> <a href=/s>Sport</a></div><div><h1>A title</h1><div>By A. B.</div><div>3 May</div><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>The end.</p></div><div class=footer>Imprint</div></body>",
     ["A title", "By A. B.", "3 May", LONG, "Short.", LONG, "The end."]),
    # furniture by name, tag, role and the hidden attribute between the paragraphs
    (f"<div><p>{LONG}</p><div class='ad-slot big'>Buy</div><div class=sidebar>s</div><aside>q</aside><div role=banner>b</div><div hidden>h</div><p>Then a short end.</p></div>", [LONG, "Then a short end."]),
    # names that only resemble furniture
    (f"<div class='side-by-side hidden-gem'><p title='now hidden here'>{LONG}</p></div><section class='discussion-of-results'><p>{LONG}</p></section>", [LONG, LONG]),
    (f"<article><p>{LONG}</p><div class='share-bar'>s</div><div id=related_posts>r</div><div class='legal'>l</div><div class='social-links-top'>x</div><div class=legal-history><p>{LONG}</p></div></article>", [LONG, LONG]),
    # an article of a few signs
    ("<div><p>Hi there.</p></div>", ["Hi there."]),
    ("<nav>x</nav><article><p>Hi.</p></article><div><p>" + LONG + "</p></div>", ["Hi."]),
    # links only
    ("<ul><li><a href=/a>a</a><li><a href=/b>b</a></ul>", []),
    # a list of links between the paragraphs belongs to the text; one after the last does not
    (f"<p>{LONG}</p><ul><li><a href=/a>a link</a></ul><p>{LONG}</p><div><a href=/x>next</a></div>", [LONG, "a link", LONG]),
    # far from the text, after an empty window, and light
    (f"<article><p>{LONG}</p><aside>1</aside><aside>2</aside><aside>3</aside><aside>4</aside><p>End.</p></article>", [LONG, "End."]),
    (f"<div>tiny</div><ul>{'<li><a href=/m>menu</a>' * 4}</ul><p>{LONG}</p><ul>{'<li><a href=/m>menu</a>' * 4}</ul><div>tiny</div>", [LONG]),
]


@pytest.mark.parametrize("html,want", TRUTH)
def test_main_text_by_hand(html, want):
    assert html_extraction.main_text(html) == "\n\n".join(want)


def test_windows_decide(monkeypatch):
    """Without window sums (all windows alike) the light text far from the article would stay."""
    html, want = TRUTH[-1]
    monkeypatch.setattr(html_extraction, "window_sums", lambda mass: np.full(len(mass), 1000))
    assert html_extraction.main_text(html) != "\n\n".join(want)


@pytest.mark.parametrize("broken", ["<a '", '<a "', "<b></i>", "<b>", "<b><hr>", "</p>", "<p><b>", "<td>", "<!--", "<div", "<textarea>", "<li><b>", "&lt;<"])
def test_broken_markup_takes_linear_time(broken):
    began = time.process_time()
    html_extraction.main_text(broken * (1_000_000 // len(broken)))
    assert time.process_time() - began < 8


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, "c"), (None, None, "<article><p>x</p></article>", "c"), (1, "u", None, "c")], "page_id long, url string, html string, text string")
    rows = sorted(map(tuple, html_extraction.extract_text(pages).collect()), key=str)
    assert rows == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "x", 1)], key=str)
    for r in html_extraction.op9_html_extraction(spark, DATA).collect():
        assert r.n_chars == len(r.text) > 0 and "track(" not in r.text


# --- 10


def test_language_on_held_out(spark):
    langs = {r.doc_id: r.lang for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    rows = language_id.op10_language_id(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) >= 0.97
    assert np.mean([r.rejected for r in rows]) < 0.02


def brute_kneser_ney(words, vocabulary):
    """(gram of ORDER signs) -> probability, straight from the definition."""
    counts = {language_id.ORDER: collections.Counter()}
    for w in words:
        padded = "\2" * (language_id.ORDER - 1) + w + "\3"
        counts[language_id.ORDER].update(padded[i : i + language_id.ORDER] for i in range(len(w) + 1))
    for k in range(language_id.ORDER - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / vocabulary
        lower, c = p(gram[1:]), counts[k]
        after = [n for g, n in c.items() if g[:-1] == gram[:-1]]
        if not after:
            return lower
        once, twice = (sum(n == x for n in c.values()) for x in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        return (max(c[gram] - d, 0) + d * len(after) * lower) / sum(after)

    return p


WORDS = ["abc", "abd", "ab", "bca", "abc", "cab", "a", "\U00010400\U00010401", "\U00020000b", "ab\U0001f0ff"]


def test_kneser_ney_by_brute_force():
    vocabulary = len({c for w in WORDS for c in w}) + 1
    p = brute_kneser_ney(WORDS, vocabulary)
    grams, _ = language_id.grams_of(WORDS)
    spelt = language_id.spelt(grams)
    assert (language_id.unspelt(spelt) == grams).all()
    seen = collections.Counter(spelt)
    model = language_id.Model(language_id.unspelt(list(seen)), np.array(list(seen.values())), vocabulary)
    asked, _ = language_id.grams_of([*WORDS, "zz", "bb", "abz", "ca", "\U00010401"])
    assert np.exp(model.log_p(asked)).tolist() == pytest.approx([p(g) for g in language_id.spelt(asked)], abs=1e-12)
    for context in {g[:-1] for g in spelt}:
        assert sum(p(context + c) for c in {g[-1] for g in spelt}) == pytest.approx(1, abs=1e-9)


def language_rows(frame):
    return sorted((str(r.doc_id), r.lang_pred, round(r.score, 6), r.rejected) for r in frame.collect())


def test_language_same_by_tables(spark, odd, monkeypatch):
    """The way for models that are too large to broadcast gives the same rows."""
    docs = table(spark, DATA, "documents").select("doc_id", "text", "lang").where("doc_id % 9 < 2").union(odd.select("doc_id", "text", "lang"))
    model = language_id.train(docs)
    want = language_rows(language_id.identify_languages(docs, model))
    kept = sorted(map(str, language_id.keep_identified(docs, model).collect()))
    monkeypatch.setattr(language_id, "BROADCAST_GRAMS", 0)
    tables = language_id.train(docs)
    assert isinstance(model, language_id.Identifier) and isinstance(tables, language_id.TableIdentifier)
    assert tables.langs == model.langs and [tables.limit[x] for x in model.langs] == pytest.approx(model.limit) and [tables.spread[x] for x in model.langs] == pytest.approx(model.spread)
    assert language_rows(language_id.identify_languages(docs, tables)) == want
    assert sorted(map(str, language_id.keep_identified(docs, tables).collect())) == kept
    assert language_id.identify_languages(docs.limit(0), tables).count() == 0


def test_language_odd(spark, odd):
    model = language_id.train(odd)
    rows = language_id.identify_languages(odd, model).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {2, 3, 4} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    empty = language_id.train(odd.limit(0))
    assert {r.lang_pred for r in language_id.identify_languages(odd, empty).collect()} == {"und"}
    assert language_id.keep_identified(odd, model).columns == odd.columns


# --- pipeline


def test_pipeline_by_brute_force(spark):
    """Each stage on its predecessor's rows, held against what it should keep of them."""
    docs = table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = scratch(spark, stage(spark, docs, DATA), name)
        after = {r.doc_id: r for r in out.collect()}
        if name != "sentencepiece":
            assert out.columns == docs.columns and after.items() <= before.items()
        if name == "quality":
            x = quality.score_quality(docs, quality.train_on_tables(spark, docs, DATA)).where("predicted = 1").collect()
            assert {r.doc_id for r in x} == set(after)
        if name == "language":
            x = language_id.identify_languages(docs, language_id.train_on_documents(docs)).where("not rejected").collect()
            assert {r.doc_id for r in x} == set(after)
        if name == "simhash":
            ids = sorted(before)
            codes = np.stack([simhash.fingerprint(before[i].text, 5, simhash.WORDS) for i in ids])
            assert codes[:, 0].tolist() == [brute_fingerprint(before[i].text, 5) for i in ids]
            labels = wide_classes_of(codes, 13, simhash.allowed_bits(0.8, 64 * simhash.WORDS))
            assert set(after) == {ids[c] for c in labels}
        if name == "decontamination":
            x = decontamination.contaminated(docs, table(spark, DATA, "benchmark")).collect()
            assert set(after) == set(before) - {r.doc_id for r in x}
        if name == "sentencepiece":
            import sentencepiece

            lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_wfst.default_model())
            assert set(after) == set(before) and all(list(r.ids) == lib.encode(before[i].text) and r.round_trip for i, r in after.items())
        docs = out


def test_pipeline_odd(spark, odd, tmp_path):
    """Nulls, ties, repeated rows, long texts and clashing names through every stage; and empty tables."""
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, None), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "wort wort wort wort wort wort wort wort wort wort wort wort wort"), (None, None)], "item_id long, text string")
    for name, docs in (("odd", odd.select("*", F.lit("z").alias("digest"), F.lit(0).alias("rejected"))), ("none", odd.limit(0))):
        folder = tmp_path / name
        for table_name, df in (("documents", docs), ("labels", labels if name == "odd" else labels.limit(0)), ("benchmark", bench if name == "odd" else bench.limit(0))):
            df.write.parquet(str(folder / f"{table_name}.parquet"))
        kept = docs
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            kept = scratch(spark, stage(spark, kept, str(folder)), stage_name)
            assert kept.columns == docs.columns
        rows = corpus_pipeline.run(spark, str(folder)).collect()
        assert len(rows) == kept.count() and all(r.doc_id in (1, 6, None) for r in rows)


def test_one_of_each_keeps_one(spark, odd):
    kept = simhash.one_of_each(odd).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 2, 5, 6, None]
    clash = odd.select("*", *(F.lit(1).alias(c) for c in ("kept_id", "kept_digest", "kept_copies", "code", "digest", "least")))
    kept = simhash.one_of_each(clash)
    assert kept.columns == clash.columns and kept.count() == 5
    assert simhash.one_of_each(clash.limit(0)).count() == 0


def test_registry():
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in registry.queries()} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    ran = duck.execute(registry.oracle_sql()[name])
    names = sorted(c[0] for c in ran.description)
    want = sorted(str([row[k] for k in np.argsort([c[0] for c in ran.description])]) for row in ran.fetchall())
    df = registry.queries()[name](spark, DATA)
    assert sorted(df.columns) == names
    assert sorted(str([r[c] for c in names]) for r in df.collect()) == want
