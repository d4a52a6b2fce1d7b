"""The joins, decontamination, toxicity and the pipeline against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tidemark.llm import decontaminate, embedding_join, shingle_join, toxicity
from tidemark.llm.common import Scratch, components

DOCS = "doc_id long, text string"


def groups(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    for links in ([(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(rnd.randrange(90), rnd.randrange(90)) for _ in range(60)], []):
        scratch = Scratch(spark)
        got = {r["node"]: r["component"] for r in scratch.finish(components(spark.createDataFrame(links, "a long, b long"), scratch)).collect()}
        nodes = {x for a, b in links for x in (a, b) if a != b}
        assert got == groups(nodes, [x for x in links if x[0] != x[1]])


# --- shingles -------------------------------------------------------------------------------------------


def sets_of(docs, words):
    out = []
    for d, text in docs:
        w = (text or "").encode().lower().split()
        out.append((d, {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())))
    return out


def near_copies(rnd, n):
    """Groups of edited copies, copies, short texts and a shared passage."""
    word = lambda: "".join(rnd.choices("abcdefgh", k=3))
    passage = " ".join(word() for _ in range(40))
    docs = []
    while len(docs) < n:
        base = [word() for _ in range(rnd.choice([1, 2, 3, 11, 12, 13, 30, 60, 150, 400]))]
        for _ in range(rnd.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 8])):
                w[rnd.randrange(len(w))] = word()
            docs.append(" ".join(w[rnd.choice([0, 0, 0, 1]) :] + ([passage] if rnd.random() < 0.2 else [])))
    return list(enumerate(docs))


@pytest.mark.parametrize("words,num,den,dense", [(3, 90, 100, 128), (5, 80, 100, 128), (5, 80, 100, 2)])
def test_shingle_join(spark, monkeypatch, words, num, den, dense):
    monkeypatch.setattr(shingle_join, "DENSE", dense)
    docs = near_copies(random.Random(words), 260)
    docs += [(1000, None), (1001, ""), (1002, " \t"), (1003, "One two"), (1004, "one TWO"), (3, docs[3][1]), (5, docs[40][1]), (None, "x"), (1005, "\x85a b c"), (1006, "w " * 9000)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "0 AS tile", "1 AS node", "2 AS n")
    scratch = Scratch(spark)
    got = scratch.finish(shingle_join.jaccard_groups(df, scratch, words=words, num=num, den=den)).collect()
    sets = [s for s in sets_of(docs, words) if s[0] is not None]
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((d, len(s)) for d, s in sets)
    links = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if s and t and den * len(s & t) >= num * len(s | t)]
    want = groups({d for d, _ in sets}, links)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len({d for d in want if want[d] != d}) > 30


@pytest.mark.parametrize("dense", [1000, 3])
def test_blocks_compare_all(spark, monkeypatch, dense):
    """Groups larger than a block, none linked with the smallest: found by the comparison across components."""
    monkeypatch.setattr(shingle_join, "BLOCK", 4)
    monkeypatch.setattr(shingle_join, "DENSE", dense)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(40):
        w = list(base)
        for k in rnd.sample(range(120), 6):
            w[k] = f"x{i}_{k}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join(t.split()[:-1] + [f"z{i}"])) for i, t in docs[1:]]
    df = spark.createDataFrame(docs, DOCS)
    scratch = Scratch(spark)
    got = {r["doc_id"]: r["component_id"] for r in scratch.finish(shingle_join.jaccard_groups(df, scratch, words=3, num=90, den=100)).collect()}
    sets = sets_of(docs, 3)
    links = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if 100 * len(s & t) >= 90 * len(s | t)]
    assert links and got == groups([d for d, _ in docs], links)


def test_common_passages_make_no_pairs(spark, monkeypatch):
    """Documents put together from the same passages share tiles, but are not alike: their pairs are ruled out before they are sent."""
    made = spark.sparkContext.accumulator(0)
    trimmed = shingle_join.trimmed

    def counted(run):
        def counting(batches):
            for out in run(batches):
                if out.schema.names == ["a", "b", "n", "tiles"]:
                    made.add(out.num_rows)
                yield out

        return trimmed(counting)

    monkeypatch.setattr(shingle_join, "trimmed", counted)
    rnd = random.Random(4)
    passages = [" ".join(f"p{i}w{k}" for k in range(20)) for i in range(80)]
    docs = [(i, " ".join(rnd.sample(passages, 20))) for i in range(200)]
    docs += [(500 + i, f"{t} more{i}") for i, t in docs[:5]]
    scratch = Scratch(spark)
    got = {r["doc_id"]: r["component_id"] for r in scratch.finish(shingle_join.jaccard_groups(spark.createDataFrame(docs, DOCS), scratch, words=5, num=80, den=100)).collect()}
    assert got == {d: d - 500 if d >= 500 else d for d, _ in docs}
    assert made.value < 200


def test_no_documents(spark):
    scratch = Scratch(spark)
    assert scratch.finish(shingle_join.jaccard_groups(spark.createDataFrame([], DOCS), scratch, words=3, num=90, den=100)).count() == 0


# --- embeddings -----------------------------------------------------------------------------------------


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "TILE", 16)
    monkeypatch.setattr(embedding_join, "PER_CELL", 4)  # a grid of many cells
    rng = np.random.default_rng(4)
    rows = []
    for i in range(150):
        v = rng.standard_normal(16)
        for _ in range(rng.choice([1, 1, 3, 9])):
            noise = rng.standard_normal(16)
            rows.append((len(rows), (v / np.linalg.norm(v) + rng.choice([0, 0.02, 0.1, 0.2]) * noise / np.linalg.norm(noise)).tolist(), int(rng.integers(0, 3))))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [float("inf")] * 16, 1), (n + 4, rows[0][1], None), (n + 5, [], 1), (n + 6, [1.0, None], 1), (n + 7, [1.0], 1), (n + 8, [3.0], 1), (n + 9, rows[5][1], rows[5][2]), (None, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "0 AS node", "1 AS cell", "2 AS k1")
    scratch = Scratch(spark)
    got = {r["vec_id"]: r for r in scratch.finish(embedding_join.near_vectors(df, scratch, min_cosine=0.98)).collect()}
    good = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0]
    links = [(a, b) for k, (a, x, p) in enumerate(good) for b, y, q in good[:k] if p == q and len(x) == len(y) and x @ y >= 0.98]
    count = Counter(x for pair in links for x in pair)
    found = sum(got[i]["n_links"] for i, *_ in good)
    assert found >= 0.99 * 2 * len(links) and all(got[i]["n_links"] <= count[i] for i, *_ in good)
    want = groups(got, links)
    for i, *_ in good:  # whatever was found: components are those of links, and rows with all their links have their component whole
        assert want[got[i]["component_id"]] == want[i] and got[i]["component_id"] <= i
    assert sum(got[i]["component_id"] == want[i] for i in got) >= 0.99 * len(got)
    assert set(got) == set(range(n + 10)) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert all(got[i]["n_links"] == 0 for i in range(n, n + 7)) and got[n + 7]["n_links"] == 1
    scratch = Scratch(spark)
    assert scratch.finish(embedding_join.near_vectors(df.limit(0), scratch, min_cosine=0.98)).count() == 0


# --- decontamination ------------------------------------------------------------------------------------


def brute_items(docs, items):
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    words = lambda t: (t or "").lower().replace("\t", " ").replace("\n", " ").split()
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            x = words(item)
            best = 0.0
            for at in range(max(len(w) - len(x), 0) + 1) if x and w else ():
                a, b = bag(w[at : at + len(x)]), bag(x)
                best = max(best, (a & b).total() / (a | b).total())
            if best >= 0.8:
                out.setdefault(d, {})[i] = best
    return out


def test_decontamination(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefghijk", k=4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 9, 13, 14, 15, 16, 24, 25, 30, 48, 49, 59, 70, 100, 150])] + [(90, None), (91, ""), (92, "A " * 30), (0, "same id")]
    docs = []
    for i, text in items * 4:
        w = (text or "").split()
        for edit in range(6):
            x = list(w)
            if edit == 1 and x:
                x[rnd.randrange(len(x))] = "edited"
            elif edit == 2 and x:
                x[-1] = "edited"
            elif edit == 3 and len(x) > 3:
                del x[rnd.randrange(len(x))]
            elif edit == 4 and x:
                x.insert(rnd.randrange(len(x)), "new")
            elif edit == 5:
                x = [c.upper() for c in x[: len(x) * 19 // 20]]
            docs.append((len(docs), " ".join([word() for _ in range(rnd.randint(0, 40))] + x + [word() for _ in range(rnd.randint(0, 40))])))
    docs += [(5000, None), (5001, ""), (5002, "\n"), (None, items[9][1]), (7, docs[7][1])]
    scratch = Scratch(spark)
    frame = spark.createDataFrame(docs, DOCS).selectExpr("*", "0 AS h", "1 AS item_id", "2 AS start")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS h")
    got = scratch.finish(decontaminate.contamination(frame, bench, scratch)).collect()
    want = brute_items(docs, items)
    assert {r["doc_id"]: list(r["item_ids"]) for r in got if r["contaminated"]} == {d: sorted(x) for d, x in want.items() if d is not None}
    assert all(abs(r["similarity"] - max(want[r["doc_id"]].values())) < 1e-12 for r in got if r["contaminated"])
    assert len(got) == len(docs)
    scratch = Scratch(spark)
    assert scratch.finish(decontaminate.contamination(frame, bench.limit(0), scratch)).where("contaminated").count() == 0


def test_decontamination_of_reordered_and_cut_items(spark):
    """A repeated phrase with its fillers in another order has similarity 1; a document may be an item that lacks its end."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choices("abcdefghijk", k=4))
    items, docs = [], []
    for i in range(8):
        phrase, fill = [word() for _ in range(4)], [word() for _ in range(12)]
        text = lambda order: " ".join([*[" ".join([*phrase, x]) for x in order], *phrase])  # noqa: E731, B023
        items.append((i, text(fill)))
        for alone in (True, False):
            order = rnd.sample(fill, 12)
            docs.append((len(docs), text(order) if alone else " ".join([word() for _ in range(30)] + [text(order)] + [word() for _ in range(30)])))
    for i in range(8, 14):
        w = [word() for _ in range(60)]
        items.append((i, " ".join(w)))
        docs += [(len(docs), " ".join(w[:-1])), (len(docs) + 1, " ".join(w[12:])), (len(docs) + 2, " ".join(w[13:])), (len(docs) + 3, " ".join(w[:55] * 40))]
    items.append((50, "again " * 40))
    docs += [(len(docs), "again " * 9000), (len(docs) + 1, "again " * 33), (len(docs) + 2, " ".join(["common", "words"] * 6000))]
    scratch = Scratch(spark)
    got = scratch.finish(decontaminate.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), scratch)).collect()
    want = brute_items(docs, items)
    assert {r["doc_id"]: list(r["item_ids"]) for r in got if r["contaminated"]} == {d: sorted(x) for d, x in want.items()}
    assert all(abs(r["similarity"] - max(want[r["doc_id"]].values())) < 1e-12 for r in got if r["contaminated"])
    assert set(range(16)) <= set(want)


# --- toxicity -------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rnd = random.Random(6)
    plain, bad = [f"w{i}" for i in range(300)], ["vile", "rotten", "foul"]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        w = rnd.choices(plain, k=rnd.randint(20, 120))
        for _ in range(rnd.randint(2, 4) if toxic else 0):
            w[rnd.randrange(len(w))] = rnd.choice(bad)
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    extra = [(2000, None), (2001, ""), (2002, "!!"), (2003, "w1 " * 40_000)]
    df = spark.createDataFrame(docs + extra, DOCS).selectExpr("*", "0 AS toxic_score", "1 AS toxic")
    lab = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(df, lab.where("doc_id < 600"))
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.predict(df, model).collect()}
    right = [(got[i] >= 0.5) == bool(t) for i, t in labels if i >= 600]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= s <= 1 for s in got.values()) and max(got[i] for i in (2000, 2001, 2002, 2003)) < 0.5
    none = toxicity.learn(df, lab.limit(0))
    assert toxicity.predict(df, none).where("toxic_score >= 0.5").count() == 0
    assert toxicity.predict(df.limit(0), model).count() == 0


def test_toxicity_rare_words(spark):
    rnd = random.Random(7)
    plain, rare = [f"w{i}" for i in range(300)], [f"rare{i}" for i in range(150)]
    docs, labels = [], []
    for i in range(1200):
        w = rnd.choices(plain, k=60)
        for x in [rare[i // 5 % 150], rare[(i // 5 + 1) % 150], rare[(i // 5 + 2) % 150]] if i % 5 == 0 else []:
            w[rnd.randrange(60)] = x
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    df = spark.createDataFrame(docs, DOCS)
    model = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id < 750"))
    got = {r["doc_id"]: r["toxic_score"] >= 0.5 for r in toxicity.predict(df, model).collect()}
    toxic, clean = ([got[i] for i, t in labels if i >= 750 and t == c] for c in (1, 0))
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_toxicity_against_dictionaries():
    """Evidence and features, computed word by word with dictionaries."""
    import math

    rnd = random.Random(3)
    classes = {c: [[rnd.choice("abcdefgh") + str(min(9, int(rnd.expovariate(0.4 if c else 0.6)))) for _ in range(rnd.randint(1, 30))] for _ in range(40)] for c in (0, 1)}
    ids = toxicity._Ids()
    counted = [(c, ids.of([w.encode() for w in t]).astype(np.int32)) for c, texts in classes.items() for t in texts]
    vocabulary = list(ids)
    contexts = np.array([rnd.randint(0, 50) for _ in vocabulary], float)
    total = contexts.sum() + 0.5 * len(vocabulary) + 77
    model = toxicity._estimate(vocabulary, counted, contexts, total)
    shared = {w.decode(): (n + 0.5) / total for w, n in zip(vocabulary, contexts, strict=True)}
    tables = {}
    for c, texts in classes.items():
        lefts, before = {}, {}
        for t in texts:
            for v, w in zip(t, t[1:]):
                lefts.setdefault(w, set()).add(v)
            for u, v, w in zip(t, t[1:], t[2:]):
                before.setdefault((v, w), set()).add(u)
        tables[c] = lefts, before

    def unigram(c, w):
        lefts = tables[c][0]
        n = sum(map(len, lefts.values()))
        lam = toxicity.DISCOUNT * len(lefts) / n
        return lam if w not in shared else max(len(lefts.get(w, ())) - toxicity.DISCOUNT, 0) / n + lam * shared[w]

    def gamma(c, v):
        own = [len(x) for (a, _), x in tables[c][1].items() if a == v]
        return toxicity.DISCOUNT * len(own) / sum(own) if own else 1.0

    def likelihood(c, v, w):
        if v is None:
            return math.log(unigram(c, w))
        own = sum(len(x) for (a, _), x in tables[c][1].items() if a == v)
        seen = len(tables[c][1].get((v, w), ()))
        high = (seen - toxicity.DISCOUNT) / own if seen else 0.0
        return math.log(high + gamma(c, v) * unigram(c, w))

    def strength(w):
        n = sum(len(tables[c][0].get(w, ())) for c in (0, 1))
        e = max(-toxicity.CLIP, min(toxicity.CLIP, likelihood(1, None, w) - likelihood(0, None, w)))
        return e * n / (n + toxicity.RELIABLE)

    for _ in range(40):
        text = [rnd.choice([*shared, "unseen", "words"]) for _ in range(rnd.randint(1, 40))]
        want = [max(-toxicity.CLIP, min(toxicity.CLIP, likelihood(1, v, w) - likelihood(0, v, w))) for v, w in zip([None, *text], text)]
        assert np.allclose(model.evidence(" ".join(text)), want)
        strong = [max(strength(w), 0.0) for w in text]
        assert np.allclose(model.features(" ".join(text)), [1, sum(want) / len(want), (sum(x**4 for x in strong) / len(strong)) ** 0.25])
    assert model.features("").tolist() == model.features(None).tolist() == [1, 0, 0]


def test_toxicity_corpus_counts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PLACES", 2000)
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["the", f"w{rnd.randrange(3000)}", f"w{rnd.randrange(20)}"]) for _ in range(rnd.randint(0, 60))) for _ in range(900)] + [None, "", "lonely"]
    pairs, places = set(), {}
    for t in texts:
        w = toxicity.words(t)
        pairs |= set(zip(w, w[1:]))
        for x in w:
            places[x] = places.get(x, 0) + 1
    contexts = {x: 0 for x in places}
    for _, x in pairs:
        contexts[x] += 1
    assert contexts[b"the"] > 311
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS).repartition(5)
    h = lambda x: np.array([xxhash.xxh3_64_intdigest(x)], np.uint64)
    for frequent in (None, np.sort(np.concatenate([h(b"the"), h(b"w3")]))):
        got = {r["word"]: (r["n"], r["contexts"]) for r in toxicity.corpus_counts(df, frequent).collect()}
        assert got == {int(h(x).view(np.int64)[0]): (places[x], contexts[x]) for x in places}
    # the shared distribution spans words outside the sample, too
    sampled = [b"the", b"w3", b"lonely", b"nowhere"]
    known, total = toxicity._contexts(df, sampled, np.zeros(0, np.uint64))
    assert known.tolist() == [contexts.get(x, 0) for x in sampled]
    assert total == sum(contexts.values()) + 0.5 * len({*places, *sampled})


# --- pipeline -------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rnd = random.Random(8)
    vocabulary = {"en": "the of and to in is that for with was on are this from by it".split(), "de": "der die und das nicht ist von mit zu den auf für ein eine".split()}
    make = lambda lang, n: " ".join(w + rnd.choice(["", "", rnd.choice("abcdef") + rnd.choice("xyz")]) for w in rnd.choices(vocabulary[lang], k=n))
    docs = [(i, make(lang, 80), lang, "s", 0) for i, lang in enumerate(["en", "de"] * 40)]
    line = make("en", 12)
    item = make("en", 40)
    docs += [(100 + i, f"{make('en', 60)}\n{line}", "en", "s", 0) for i in range(4)]
    docs += [(200, docs[0][1], "en", "s", 0), (201, docs[2][1] + " tail", "en", "s", 0), (300, f"{make('en', 30)} {item} {make('en', 30)}", "en", "s", 0), (400, "123 456", None, "s", 0), (401, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {d for d, *_ in docs} - {200, 201, 300, 400, 401}
    from tidemark.llm.piece_encoding import Encoder, model_path

    library = Encoder(model_path()).vocabulary.library
    texts = {d: t for d, t, *_ in docs}
    for d, r in got.items():
        text = texts[d] if d not in (100, 101, 102) else texts[d].split("\n")[0]
        assert r["ids"] == library.encode(text, add_eos=True) and r["n_tokens"] == len(r["ids"])


def brute_pipeline(spark, docs, items):
    """The five stages in plain Python, but for the dictionaries that language ID learns."""
    import zstandard

    from tests.llm.test_small_operators import brute_lines
    from tidemark.llm import language_id
    from tidemark.llm.piece_encoding import Encoder, model_path

    model = language_id.learn(language_id.training_rows(spark.createDataFrame([d[:3] for d in docs], "doc_id long, text string, lang string")))

    def clear(text):
        if not text or not any(c.isalpha() for c in text):
            return False
        raw = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split(" ")).encode()
        raw = __import__("re").sub(rb" +", b" ", raw)
        sizes = []
        for dictionary in model.values():
            d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(raw[k : k + 4096])) for k in range(0, len(raw), 4096)))
        least, second = sorted(sizes)[:2]
        return second - least >= max(2, 0.002 * least)

    kept = [d for d in docs if clear(d[1])]
    kept = [(d, text) for (d, text, _, _), row in zip(brute_lines([(d, text) for d, text, *_ in kept]), kept, strict=True)]
    named = [(d, t) for d, t in kept if d is not None]
    sets = sets_of(named, 5)
    links = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if s and t and 100 * len(s & t) >= 80 * len(s | t)]
    component = groups({d for d, _ in named}, links)
    kept = [(d, t) for d, t in kept if d is None or component[d] == d]
    held = brute_items([k for k in kept if k[0] is not None], items)
    library = Encoder(model_path()).vocabulary.library
    return Counter((d, tuple(library.encode(t, add_eos=True))) for d, t in kept if d not in held)


def test_pipeline_against_brute_force(spark, tmp_path):
    rnd = random.Random(18)
    vocabulary = {lang: ["".join(rnd.choices(letters, k=rnd.randint(2, 8))) for _ in range(200)] for lang, letters in (("en", "etaoinshrdlu"), ("fr", "çéèaeuxmptno"), ("ru", "оеаинтсрвл"))}
    make = lambda lang, n: " ".join(rnd.choices(vocabulary[lang], k=n))
    items = [(i, make("en", n)) for i, n in enumerate((20, 40, 60))]
    shared = [make("en", 8) for _ in range(3)]
    docs = []
    for i in range(160):
        lang = rnd.choice(list(vocabulary))
        parts = [make(lang, rnd.randint(1, 60)) for _ in range(rnd.randint(1, 3))]
        if rnd.random() < 0.2:
            parts.insert(rnd.randint(0, len(parts)), rnd.choice(shared))
        text = "\n".join(parts)
        if i % 5 == 4:
            w = docs[rnd.randrange(len(docs))][1].split(" ")
            w[rnd.randrange(len(w))] = "edited"
            text = " ".join(w)
        if i % 11 == 3:
            w = items[i % 3][1].split(" ")
            if rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = "edited"
            text += " " + " ".join(w) + " " + make(lang, 5)
        docs.append((i, text, lang, "s", len(text)))
    docs += [(500, None, "en", None, None), (501, "", "en", "s", 0), (502, "123 ½", None, "s", 5), (503, "x", "fr", "s", 1), (3, docs[3][1], "en", "s", 0), (7, make("en", 30), "en", "s", 0), (None, make("ru", 40), "ru", "s", 0), (504, make("fr", 30_000), "fr", "s", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS h", "1 AS tile", "2 AS ids", "3 AS _lost")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == brute_pipeline(spark, docs, items)
    assert 60 < sum(got.values()) < len(docs) - 30


def test_pipeline_without_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
