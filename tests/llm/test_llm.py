"""Each operator against a brute-force version on a small fixture, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import tracemalloc
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.llm import _graph, _spark, _text, chat, decontaminate, embeddings, jaccard, language, pieces, pii, quality, sharding, toxicity
from sylva.llm._graph import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = {}
    for k in range(0, 60):
        out[k] = sentence(rng, rng.randrange(1, 80))
    for k in range(60, 110):  # chains of near copies
        words = out[rng.choice([5, 9, k - 1 if k > 60 else 5])].split()
        words[rng.randrange(len(words))] = "EDIT"
        out[k] = "  ".join(words).upper() if k % 7 == 0 else "\n".join(words)
    out |= {200: None, 201: "", 202: " \t\n", 203: "one two", 204: "ONE two", 205: "one", 206: out[5], 207: out[5], 208: "éa " * 9, 209: "x " * 5000}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "x", 1, 2) for k, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, score int, component_id int").repartition(3)


def empty(docs):
    return docs.where("false")


@pytest.mark.parametrize("hot", [3, 1 << 17])
@pytest.mark.parametrize("path", [list(range(2, 61)) + [1], random.Random(5).sample(range(500), 500)], ids=["smallest last", "random"])
def test_components_settle_chains_by_rounds(spark, monkeypatch, path, hot):
    """Forests of a few hundred edges leave chains that span tasks, which rounds must join."""
    monkeypatch.setattr(_graph, "HOT", hot)
    links = spark.createDataFrame(list(itertools.pairwise(path)), "a long, b long")
    got = components(links, most=len(path) // 6).collect()
    assert sorted(r["id"] for r in got) == sorted(path) and {r["component"] for r in got} == {min(path)}


@pytest.mark.parametrize("path", [range(500), range(500, 0, -1), [*range(2, 501), 1]], ids=["up", "down", "smallest last"])
def test_components_of_long_chains(spark, path):
    got = components(spark.createDataFrame(list(itertools.pairwise(path)), "a long, b long")).collect()
    assert len(got) == 500 and {r["component"] for r in got} == {min(path)}


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 99), (7, 7), (3, 2)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 7: 1, 99: 99, 100: 99}
    assert components(links.where("false")).count() == 0


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_equals_brute_force(docs, texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    linked = set()
    for a, b in itertools.combinations(sorted(texts), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
            linked.add((a, b))
    want = {k: (len(sets[k]), root(k)) for k in texts}
    rows = docs.union(docs.where("doc_id in (5, 200)")).unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), "text", "n", "score", "component_id"))
    got = jaccard.near_duplicates(rows).collect()
    assert len(got) == len(texts) + 3
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert jaccard.near_duplicates(empty(docs)).count() == 0
    # every link between different texts, each by its smallest doc_id
    first = {k: min(j for j in texts if sets[j] == sets[k]) for k in texts}
    named = {(min(first[a], first[b]), max(first[a], first[b])) for a, b in linked if first[a] != first[b]}
    assert sorted(map(tuple, jaccard.links(docs).collect())) == sorted(named) and named


def test_jaccard_of_a_large_group(spark, monkeypatch):
    """Hundreds of near copies over many blocks, among strays that share half of their words."""
    monkeypatch.setattr(jaccard, "PART_ROWS", 8)
    rng = random.Random(12)
    base = sentence(rng, 60).split()
    rows = {}
    for k in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2]) if k % 5 else 4):
            words[rng.randrange(60)] = f"edit{rng.randrange(9)}"
        rows[k] = " ".join(words)
    rows |= {k: " ".join(base[:30] + sentence(rng, 30).split()) for k in range(150, 180)}
    sets = {k: shingles(t) for k, t in rows.items()}
    want = {k: k for k in rows}
    while True:
        after = {k: min(want[j] for j in rows if 100 * len(sets[k] & sets[j]) >= 75 * len(sets[k] | sets[j])) for k in rows}
        if after == want:
            break
        want = after
    got = jaccard.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_jaccard_links_inside_blocks_dealt_anew(spark, monkeypatch):
    """Pairs of near copies that share a home with a large group: its leaving changes what their blocks hold."""
    monkeypatch.setattr(jaccard, "PART_ROWS", 8)
    monkeypatch.setattr(jaccard, "_sketch", lambda parts: np.zeros(jaccard.CELLS, np.uint8))
    rng = random.Random(3)
    base, rows = [f"base{k}" for k in range(40)], {}
    for f in range(61):
        own = [f"own{f}x{k}" for k in range(40)]
        for _ in range(60 if f == 60 else 2):
            words = base + own
            words[rng.randrange(40, 80)] = f"edit{len(rows)}"
            rows[len(rows)] = " ".join(words)
    sets = {k: shingles(t) for k, t in rows.items()}
    want = {k: min(j for j in rows if 100 * len(sets[k] & sets[j]) >= 75 * len(sets[k] | sets[j])) for k in rows}
    got = jaccard.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(1)
    classes = rng.integers(0, 3, jaccard.CELLS).astype(np.uint8)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.union1d(rng.choice(a, max(1, len(a) * 8 // 10), replace=False), rng.integers(0, 1 << 60, 2).astype(np.uint64))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            for seed in jaccard.SEEDS:
                assert len(np.intersect1d(jaccard.prefix(a, classes, seed), jaccard.prefix(b, classes, seed))) >= jaccard.least_shared(min(len(a), len(b)))


def benchmark_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("most", [1_000_000, 700])
def test_decontaminate_equals_brute_force(spark, docs, texts, most):
    rng = random.Random(8)
    items = {1: " ".join((texts[5] or "").split()[3:20]), 2: "One! two", 3: "", 4: None, 10: sentence(rng, 30), 11: texts[9], 12: texts[9], 13: "éa éa éa éa"}
    table = spark.createDataFrame([(k, t, 0) for k, t in items.items()] + [(None, "one", 0)], "item_id long, text string, items int")
    got = {r["doc_id"]: r for r in decontaminate.find(docs.select("doc_id", "text", F.lit(1).alias("hits")), table, most=most).collect()}
    for k, t in texts.items():
        w, hit, found = benchmark_words(t), set(), set()
        for i, x in items.items():
            v = benchmark_words(x)
            n = min(10, len(v))
            for s in range(len(v) - n + 1) if v else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(i))
        assert got[k]["n_words"] == len(w)
        assert {x for s, e in got[k]["hits"] for x in range(s, e)} == hit
        assert got[k]["items"] == sorted(found)
    none = decontaminate.find(docs.select("doc_id", "text"), table.where("false"))
    assert none.where("size(items) > 0").count() == 0 and none.count() == len(texts)
    assert decontaminate.find(empty(docs).select("doc_id", "text"), table).count() == 0


def learnable(spark):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        bad = k % 3 == 0
        body = sentence(rng, 40).split()
        if bad:
            body[5:5] = ["idiot", "them"] * 2
        rows.append((k, " | ".join(body) if bad else " ".join(body), 0 if bad else 1, 1 if bad else 0, ["en", "de"][k % 2]))
    rows += [(900, None, 1, 0, "en"), (901, "", 1, 0, None), (902, "\n", None, None, "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int, lang string")


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_learn(spark, module, label):
    data = learnable(spark)
    sample = data.where(f"{label} is not null and doc_id % 5 <> 0").select("text", F.col(label).alias("y"))
    out = module.score(data.withColumn("score", F.lit("clash")), module.fit(sample)).collect()
    assert len(out) == 403 and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["doc_id"] < 900 and r["doc_id"] % 5 == 0]
    assert sum((r["score"] >= 0.5) == r[label] for r in held) >= 0.95 * len(held)
    scores = {r["doc_id"]: r["score"] for r in out}
    assert scores[900] == scores[901] == scores[902]
    assert module.score(data.where("false"), module.fit(sample)).count() == 0
    assert {r["score"] for r in module.score(data, module.fit(sample.where("false"))).collect()} == {0.5}


def test_toxic_pairs_weigh_more_than_parts(spark):
    """A label that only a pair decides: factors must separate what linear weights cannot."""
    rng = random.Random(4)
    rows = []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((" ".join(["insult"] * a + ["group"] * b + [rng.choice(WORDS)]), int(a and b)))
    model = toxicity.fit(spark.createDataFrame(rows, "text string, y int"), epochs=20, rate=0.05, decay=0.0)
    docs = spark.createDataFrame([("insult group",), ("insult",), ("group",)], "text string")
    both, one, other = (r["score"] for r in toxicity.score(docs, model).collect())
    assert both > 0.5 > max(one, other)


def test_toxic_pairs_change_decisions_with_the_defaults(spark):
    """Insults alone and groups alone are clean, however many: held-out errors of an additive model that pairs settle."""
    rng = random.Random(1)
    rows = []
    for k in range(4000):
        a, b = rng.choice([0] * 4 + [1, 2, 3]), rng.choice([0] * 4 + [1, 2, 3])
        words = [f"w{rng.randrange(400)}" for _ in range(25)] + [f"insult{j}" for j in rng.sample(range(12), a)] + [f"group{j}" for j in rng.sample(range(12), b)]
        rows.append((k, " ".join(words), int(a > 0 and b > 0)))
    data = spark.createDataFrame(rows, "doc_id long, text string, y int")
    sample, held = data.where("doc_id < 3000").select("text", "y"), data.where("doc_id >= 3000")
    model = toxicity.fit(sample)
    additive = toxicity.fit(sample, rate=0.0)
    out = []
    for m in (model, replace(model, factors=0 * model.factors), replace(additive, factors=0 * additive.factors)):
        out.append({r["doc_id"]: (r["score"] >= 0.3, r["y"]) for r in toxicity.score(held, m).collect()})
    wrong = [sum(flag != y for flag, y in o.values()) for o in out]
    assert sum(out[0][k] != out[1][k] for k in out[0]) >= 50
    assert wrong[0] < 0.95 * wrong[2], wrong


def test_language(spark):
    rng = random.Random(6)
    parts = {"aa": "the ing tion and er", "bb": "que los ción ñad es", "cc": "üng sch kei ße der"}
    rows = [(k, " ".join("".join(rng.choices(parts[g].split(), k=2)) for _ in range(rng.randrange(5, 60))), g) for k in range(300) for g in [sorted(parts)[k % 3]]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !! \u00bd \u00b2 \u2460 _", "bb"), (903, "the", None)]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(language.training_rows(data))
    assert model.languages == ["aa", "bb", "cc"] and 0 < np.mean(model.weights == 0) < 1
    out = {r["doc_id"]: r for r in language.identify(data.withColumn("lang_pred", F.lit(1)), model).collect()}
    assert sum(out[k]["lang_pred"] == g for k, _, g in rows[:300]) >= 297
    for k in (900, 901, 902):
        assert (out[k]["lang_pred"], out[k]["score"]) == ("und", 0.0)
    texts, counts = language.document_frequencies(data)
    assert texts == 304 and counts.max() <= 304
    nothing = language.fit(data.where("false"))
    assert {r["lang_pred"] for r in language.identify(data, nothing).collect()} == {"und"}
    assert language.identify(data.where("false"), model).count() == 0


def plain_hash(word):
    """A word's 64-bit hash, byte by byte."""
    total = sum(int(_text.FOLDED[b]) * pow(int(_text._BASE), k, 1 << 64) for k, b in enumerate(word))
    return int(_text.mix(np.array([total & (1 << 64) - 1], np.uint64))[0])


def plain_mix(x):
    return int(_text.mix(np.array([x & (1 << 64) - 1], np.uint64))[0])


SCORED = ["The cat  sat on the cat", "", None, "é\tÀ9 | x-ray (yes) YES yes", "one", "a b " * 40, "日本 語! " * 7, "\n ", "insult group, group insult"]


def test_quality_scores_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    model = quality.QualityModel(rng.normal(size=quality.SIZE).astype(np.float32), 0.25)
    out = {r["k"]: r["score"] for r in quality.score(spark.createDataFrame(list(enumerate(SCORED)), "k int, text string"), model).collect()}
    for k, t in enumerate(SCORED):
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode()) if w]
        hashes, shapes = [plain_hash(w) for w in words], []
        for j, w in enumerate(words):
            kinds = [int(quality._KIND[b]) for b in w]
            seen = 0
            for x in kinds:
                seen |= x
            again = int(j > 0 and hashes[j] == hashes[j - 1])
            shapes.append(plain_mix(seen | kinds[0] << 8 | kinds[-1] << 16 | again << 24 | min(len(w), 31) // 8 << 25))
        total = 0.0
        for family, (h, n) in enumerate(((hashes, 1), (hashes, 2), (shapes, 1), (shapes, 2))):
            for j in range(len(h) - n + 1):
                gram = plain_mix(sum(h[j + i] * int(_text.PLACE[i]) for i in range(n)))
                total += float(model.weights[plain_mix(gram + family + 1) >> 64 - quality.BITS])
        assert out[k] == pytest.approx(1 / (1 + np.exp(-np.clip(0.25 + total * quality.SCALE / max(1, len(words)), -35, 35))), abs=1e-5)


def test_toxicity_scores_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    draw = lambda *n: rng.normal(0, 0.4, n).astype(np.float32)
    model = toxicity.ToxicityModel(-0.5, draw(toxicity.SIZE), draw(toxicity.SIZE, toxicity.FACTORS), np.abs(draw(toxicity.SIZE)))
    out = {r["k"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(SCORED)), "k int, text string"), model).collect()}
    for k, t in enumerate(SCORED):
        terms = sorted({plain_hash(w) >> 64 - toxicity.BITS for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode())})
        total = -0.5 + sum(float(model.linear[i] * model.value[i]) for i in terms)
        for i, j in itertools.combinations(terms, 2):
            total += float(model.factors[i] @ model.factors[j] * model.value[i] * model.value[j])
        assert out[k] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-5)


def test_language_scores_equal_brute_force(spark):
    rng = np.random.default_rng(13)
    model = language.LanguageModel(["aa", "bb", "cc"], rng.normal(0, 3, (language.SIZE, 3)).astype(np.float32), np.array([0.1, 0.0, -0.2]), 1.7)
    out = {r["k"]: r for r in language.identify(spark.createDataFrame(list(enumerate(SCORED)), "k int, text string"), model).collect()}
    for k, t in enumerate(SCORED):
        points, total, n = [ord(c) for c in (t or "").lower()], np.zeros(3), 0
        for order in language.ORDERS:
            for i in range(len(points) - order + 1):
                h = order * 0x9E3779B1 & 0xFFFFFFFF
                for c in points[i : i + order]:
                    h = (h ^ c) * 0x85EBCA6B & 0xFFFFFFFF
                    h ^= h >> 15
                total += model.weights[h >> 32 - language.BITS]
                n += 1
        e = np.exp((total / max(1, n) + model.bias) / model.temperature)
        want = ("und", 0.0) if not any(c.isalpha() for c in t or "") else (model.languages[int(e.argmax())], e.max() / e.sum())
        assert out[k]["lang_pred"] == want[0] and out[k]["score"] == pytest.approx(want[1], abs=1e-5)


def test_grams_stay_inside_texts():
    rows = ["abc", "", "Da", "xyzw", "é", "ÀB"]
    together = language._grams(rows)
    for r, t in enumerate(rows):
        for (g, o), (alone, _) in zip(together, language._grams([t]), strict=True):
            assert g[o[r] : o[r + 1]].tolist() == alone.tolist()


def test_workers_take_up_long_texts_slice_by_slice(spark):
    rows = [(k, "x" * 90_000 if k != 7 else "y" * 5_000_000) for k in range(120)] + [(120, None), (121, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    make = lambda b: [pa.array([b.nbytes] * b.num_rows), pa.array([b.num_rows] * b.num_rows)]
    got = _spark.append(docs, make, [("bytes", T.LongType()), ("rows", T.LongType())]).collect()
    assert [(r["doc_id"], r["text"]) for r in got] == rows
    assert all(r["bytes"] <= 2 << 20 or r["rows"] == 1 for r in got) and any(r["rows"] > 1 for r in got)


def test_pieces_and_languages_take_bounded_memory(monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(200_000)]
    texts = [" ".join(rng.choices(words, k=600)) for _ in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    monkeypatch.setattr(pieces, "append", lambda docs, make, *rest: make)
    monkeypatch.setattr(language, "append", lambda docs, make, *rest: make)
    model = language.LanguageModel(list("abcd"), np.zeros((language.SIZE, 4), np.float32), np.zeros(4), 1.0)

    class Docs:  # a session whose broadcast is the value itself
        sparkSession = sparkContext = property(lambda self: self)  # noqa: N815
        broadcast = staticmethod(lambda value: type("Shared", (), {"value": value}))

    for make in (pieces.tokenize(None, pieces_model()), language.identify(Docs(), model)):
        make(batch.slice(0, 1))
        tracemalloc.start()
        make(batch)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80e6


def pieces_model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(7)
    letters = list("abcdeinorst     ▁\n\té日本😀\x00<s>.,AB19")
    rows = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(500)]
    rows += ["".join(rng.choices(["members", "membre", "ing", "tion", " ", "  ", "ions", "ss"], k=rng.randrange(30))) for _ in range(500)]
    rows += [" " * n for n in range(40)] + ["a" * 3000, "ab" * 2000, " " * 100_000, "th" * 50_000, "and" * 30_000 + "  " * 500 + "end", "<s></s><unk><0x0A>", "", None]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = {r["doc_id"]: r for r in pieces.decode(pieces.tokenize(df, path), path).collect()}
    for k, t in enumerate(rows):
        ids = library.encode(t or "")
        assert out[k]["ids"] == ids and out[k]["n_tokens"] == len(ids)
        assert out[k]["decoded"] == library.decode(ids)
        assert out[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


PII_TEXTS = [
    "mail a@b.c.d@e.f and a@b.c_d@e.fg x@y @ z@ q@w.e.", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.002.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112 and 12 34",
    "+1 (988) 555-2485 +12 +123456789012345678 (988) 555-2485", "call 988-555-2485 now", "bob [at] mail (dot) com", "é😀 a@b.cd 1.2.3.4", "", None, "+1 (988) 555-2485" * 3, "9" * 30000, "a" * 30000 + "@", "1 " * 9000,
]


def brute_spans(t):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0

    ok = {"email": lambda m, d: True, "ip": lambda m, d: all(int(p) <= 255 for p in m.split(".")), "card": lambda m, d: 12 <= len(d) <= 19 and luhn(d), "phone": lambda m, d: 9 <= len(d) <= 15}
    patterns = {"ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"}
    out = []
    for kind, p in patterns.items():
        if kind == "email" and "@" not in t.rstrip("@"):
            continue  # the plain pattern is quadratic on long runs
        out += [(m.start(), pii.KINDS.index(kind), m.end(), kind) for m in re.finditer(p, t) if ok[kind](m[0], re.sub("[^0-9]", "", m[0]))]
    return sorted(out)


def test_pii_base_spans_and_model(spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(PII_TEXTS)], "doc_id long, text string, spans int")
    model = pii.fit(df)
    assert set(model.reliability) == set(pii.LABELERS) and all(0.5 < r < 1 for r in model.reliability.values())
    out = {r["doc_id"]: r for r in pii.detect(df, model).withColumn("clean", pii.redacted(F.col("text"), F.col("spans"))).collect()}
    for k, t in enumerate(PII_TEXTS):
        want = brute_spans(t or "")
        assert [tuple(s) for s in out[k]["base"]] == want
        assert set(map(tuple, out[k]["base"])) <= set(map(tuple, out[k]["spans"]))
        assert [tuple(s) for s in out[k]["spans"]] == sorted(map(tuple, out[k]["spans"]))
        if t is None:
            assert out[k]["clean"] is None
    assert "988" not in out[3]["clean"].replace("(988)", "")[:12] and out[6]["clean"] == "é😀 <EMAIL> <IP>"
    assert [s["kind"] for s in out[4]["spans"]] == ["phone"]
    fresh = pii.fit(df.where("false"))
    assert pii.detect(df.where("false"), fresh).count() == 0 and pii.detect(df, fresh).count() == len(PII_TEXTS)


def test_pii_votes_recover_planted_reliabilities():
    """EM over votes of labelers that are right as often as planted, on truths that it never sees."""
    rng = random.Random(21)
    right = dict(zip(pii.LABELERS, (0.95, 0.85, 0.75, 0.65), strict=True))
    counts, truths = {}, {}
    for _ in range(40_000):
        truth = rng.random() < 0.6
        votes = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < r) == truth else -1) for r in right.values())
        counts[votes] = counts.get(votes, 0) + 1
        truths[votes] = truths.get(votes, 0) + truth
    rows = sorted(("phone", v, n) for v, n in counts.items())
    found, posterior = pii.aggregate_votes(rows)
    assert all(abs(found[k] - r) < 0.05 for k, r in right.items()), found
    # the posterior of each vote pattern is the share of true spans among it
    off = sum(n * abs(p - truths[v] / n) for p, (_, v, n) in zip(posterior, rows, strict=True)) / 40_000
    assert off < 0.06


def test_pii_adds_planted_spans(spark):
    """Loose phones and spelled-out mails among numbers that look like them: precision and recall of what is added."""
    rng = random.Random(22)
    number = lambda: f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    rows, planted = [], {}
    for k in range(300):
        kind = k % 4
        if kind == 0:
            body, lead = number(), "please call "
        elif kind == 1:
            body, lead = f"{rng.choice(WORDS)} [at] mail (dot) com", "contact "
        elif kind == 2:
            body, lead = number(), "order "
        else:
            body, lead = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", "call "
        text = f"{sentence(rng, 5)} {lead}{body} {sentence(rng, 5)}"
        rows.append((k, text))
        if kind < 2:
            planted[k] = (text.index(body), text.index(body) + len(body))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.detect(df, pii.fit(df)).collect()}
    added = {(k, s["start"], s["end"]) for k, r in out.items() for s in r["spans"] if tuple(s) not in set(map(tuple, r["base"]))}
    true = {(k, *span) for k, span in planted.items()}
    print("added", len(added), "of", len(true), "planted, right", len(added & true))
    assert len(added & true) >= 0.9 * len(true) and len(added & true) >= 0.9 * len(added)


def test_pii_context_decides_where_votes_are_alike(spark):
    """Two words that no labeler knows, one met beside valid phones and one beside failing ones, tell loose numbers apart."""
    rng = random.Random(23)
    digits = lambda n: str(rng.randrange(2 * 10 ** (n - 1), 10**n))
    loose = lambda: f"{digits(3)}.{rng.randrange(200, 554)}.{digits(4)}"
    bodies = [("hotline", f"+{rng.choice(['1', '99'])} ({digits(3)}) {digits(3)}-{digits(4)}") for _ in range(200)] + [("gauge", f"+99 ({digits(2)}) {digits(2)}-{digits(2)}") for _ in range(200)]
    bodies += [(w, loose()) for w in ("hotline", "gauge") for _ in range(50)]
    df = spark.createDataFrame([(k, f"{sentence(rng, 4)} {w} {b} {sentence(rng, 4)}", w) for k, (w, b) in enumerate(bodies)], "doc_id long, text string, w string")
    model = pii.fit(df)
    added = {r["w"]: r["n"] for r in pii.detect(df, model).where("doc_id >= 400").groupBy("w").agg(F.sum(F.size("spans")).alias("n")).collect()}
    print(added)
    assert added["hotline"] >= 45 and added["gauge"] <= 5
    votes_alone = {r["w"]: r["n"] for r in pii.detect(df, replace(model, slots=())).where("doc_id >= 400").groupBy("w").agg(F.sum(F.size("spans")).alias("n")).collect()}
    assert votes_alone["hotline"] == votes_alone["gauge"]


def test_pii_stays_native(spark):
    plan = pii.detect(spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string"), pii.SpanModel({}, 0.0, {"kind=ip": 1.0}))
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString().replace("LocalTableScan", ""))


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = []
    for k in range(300):
        v = base[k % 40] + rng.normal(size=16) * [0.05, 0.2, 0.4][k % 3]
        rows.append((k, [float(np.float32(x)) for x in v * (1 + k % 5)], k % 3 if k % 4 else 0))
    rows += [(400 + k, rows[0][1], rows[0][2]) for k in range(30)]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [None] + [1.0] * 15, 1), (504, [float("nan")] * 16, 1), (505, [float("inf")] * 16, 1), (506, rows[0][1], None), (507, rows[0][1][:8], rows[0][2]), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("weight", F.lit(1))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, cell_rows=50).collect()}
    fine = {k: (np.asarray(v, float) / np.linalg.norm(v), c) for k, v, c in rows if k is not None and k < 500} | {507: (np.asarray(rows[0][1][:8]) / np.linalg.norm(rows[0][1][:8]), rows[0][2])}
    links = {a: [b for b in fine if b != a and fine[a][1] == fine[b][1] and len(fine[a][0]) == len(fine[b][0]) and fine[a][0] @ fine[b][0] >= 0.93] for a in fine}
    assert sum(map(len, links.values())) > 500
    for k, v, _ in rows:
        if k is None:
            assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, None, False)
            continue
        seen, todo = {k}, [k]
        while todo:
            new = set(links.get(todo.pop(), [])) - seen
            seen |= new
            todo += new
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (len(links.get(k, [])), min(seen), min(seen) == k)
    assert embeddings.near_duplicates(df.where("false")).count() == 0
    assert embeddings.near_duplicates(df.where("vec_id >= 500 and vec_id < 506")).agg(F.sum("n_links")).head()[0] == 0


def test_sharding(spark, docs, texts):
    out = sharding.shards(docs.withColumn("slot", F.lit("clash")), count=7, bucket_bytes=2000).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    assert all(r["text"] == texts[r["doc_id"]] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(k, [])) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shards(docs.repartition(5), count=7, bucket_bytes=2000).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in again} == {(r["doc_id"], r["shard"], r["slot"]) for r in out}
    assert [r["doc_id"] for r in sorted(out, key=lambda r: (r["slot"], r["shard"]))] != sorted(texts)
    nulls = spark.createDataFrame([(1, None), (1, ""), (None, "x"), (None, None), (1, "")], "doc_id long, text string")
    one, two = (sharding.shards(nulls.repartition(n), count=2).collect() for n in (1, 3))
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == 5
    twice = sharding.shards(docs.union(docs), count=7, bucket_bytes=2000)
    assert twice.count() == 2 * len(texts) and twice.select("shard", "slot").distinct().count() == 2 * len(texts)
    assert sharding.shards(empty(docs)).count() == 0


def test_sharding_splits_repeated_records(spark):
    rows = [(1, "same text")] * 3000 + [(None, None)] * 2000 + [(k, "other") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = sharding.scattered(df, bucket_bytes=2500)[0].groupBy("bucket").count().toPandas()["count"]
    assert sizes.sum() == 5500 and sizes.max() < 250
    out = sharding.shards(df, count=7, bucket_bytes=2500).collect()
    assert sorted((r["shard"], r["slot"]) for r in out) == sorted((k % 7, k // 7) for k in range(5500))
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out))) == sorted(map(str, rows))


def test_chat(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "é?"), (0, 3, "assistant", "a"), (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "no"), (2, 0, "user", "x"), (3, 0, "user", "x"), (4, 0, None, None), (5, 0, "user", None), (None, 0, "user", "lost"), (6, None, "user", "lost"), (8, 0, "user", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit(1))
    pairs = chat.neighbours(df)
    rows = {r["pair_id"]: r for r in chat.preferences(df, pairs).collect()}
    assert sorted(map(str, chat.preferences(df, pairs.union(pairs)).collect())) == sorted(map(str, rows.values()))
    assert sorted(rows) == [0, 1, 2]
    r = rows[0]
    assert r["prompt_turns"] == 2 and r["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n"
    assert r["chosen_completion"] == "<|user|>\né?<|end|>\n<|assistant|>\na<|end|>\n"
    (mask,) = r["chosen_masks"]
    assert r["chosen_completion"][mask["start"] : mask["end"]] == "a<|end|>\n" and r["rejected_masks"] == []
    assert rows[1]["chosen_completion"] == rows[1]["rejected_completion"] == "" and rows[2]["prompt_turns"] == 0
    assert chat.preferences(df.where("false"), chat.neighbours(df.where("false"))).count() == 0


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    rows = [(k, f"{sentence(random.Random(k), 60)} mail x{k}@y.com", "en", "src", 9) for k in range(40)]
    rows += [(50, rows[3][1] + " more", "en", "src", 9), (51, "12 34", "en", "src", 9), (52, None, None, None, None), (53, "bad " * 3 + "one two three four five six seven eight nine ten eleven", "de", "s", 1)]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    data.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "pii", "sentencepiece"]
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == list(range(40))
    assert all(r["text"].endswith("<EMAIL>") and r["n_chars"] == len(r["text"]) and len(r["ids"]) == r["n_tokens"] for r in out.values())


def test_pipeline_keeps_rows_without_doc_id(spark, tmp_path):
    import corpus_pipeline

    rows = [(k if k % 3 else None, f"{sentence(random.Random(k), 60)} end", "en", "src", 9) for k in range(1, 13)]
    data = spark.createDataFrame([*rows, (40, rows[0][1] + " more", "en", "src", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, data, str(tmp_path)).collect()
    assert sorted(r["text"] for r in out) == sorted(r[1] for r in rows)
    twice = data.union(data.where("doc_id < 5")).union(spark.createDataFrame([(1, "zzz another text", "en", "src", 9), (1, None, None, None, None)], data.schema))
    got = corpus_pipeline.drop_near_duplicates(spark, twice, str(tmp_path)).where("doc_id is not null").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows if r[0])
    assert corpus_pipeline.drop_near_duplicates(spark, data.where("false"), str(tmp_path)).count() == 0


def test_pipeline_stages_equal_brute_force(spark, tmp_path, docs, texts):
    """Near duplicates, decontamination and encoding on one fixture with nulls, empties and copies."""
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline

    spark.createDataFrame([(1, " ".join((texts[9] or "").split()[2:14]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = docs.select("doc_id", "text")
    sets = {k: shingles(t) for k, t in texts.items()}
    near = {k: {j for j in texts if k == j or (sets[k] and 100 * len(sets[k] & sets[j]) >= 75 * len(sets[k] | sets[j]))} for k in texts}
    least = {k: k for k in texts}
    for _ in texts:
        least = {k: min(least[j] for j in near[k]) for k in texts}
    kept = corpus_pipeline.drop_near_duplicates(spark, given, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(k for k in texts if least[k] == k)
    window = benchmark_words(texts[9])[2:14]
    parts = [window[k : k + 10] for k in range(3)]
    hit = {k for k, t in texts.items() for w in [benchmark_words(t)] if any(w[p : p + 10] in parts for p in range(len(w)))}
    clean = corpus_pipeline.drop_contaminated(spark, given, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in clean) == sorted(set(texts) - hit) and hit
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r["ids"] == library.encode(r["text"] or "") for r in corpus_pipeline.encode(spark, given, str(tmp_path)).collect())
