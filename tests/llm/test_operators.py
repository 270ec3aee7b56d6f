"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, part int, slot string, size double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rng = np.random.default_rng(5)
    words = ["the", "of", "und", "Élan", "x1", *("w%d" % i for i in range(300))]
    line = " ".join(words[i] for i in rng.integers(0, len(words), 40))
    out = [None, "", " \t\n", "a", "a b c", line, line, line + " tail", "start " + line, "x " * 3000, "é" * 400]
    for i in range(25):
        t = " ".join(words[j] for j in rng.integers(0, len(words), int(rng.integers(5, 120))))
        out += [t] * (1 + i % 3 // 2)
        if i % 4 == 0:
            out.append(t.replace("w1", "W1", 1) + " more")
            out.append(t[: len(t) // 2] + " " + line)
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    rows = [(3 * i, x, None if i % 5 == 0 else f"s{i % 3}", 1, "y", 2.0) for i, x in enumerate(t)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return WORD.findall((t or "").translate(FOLD))


def test_mix(spark, docs, rows, empty):
    from pathloom.llm.mixing import mix_digest

    got = mix_digest(docs).collect()
    assert len(got) == len(rows) and mix_digest(empty).count() == 0
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    source = {r[0]: r[2] for r in rows}
    taken = collections.Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    target = {source[r["doc_id"]]: r["target"] for r in got}
    assert all(abs(taken[s] - t) < 1 for s, t in target.items())
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_digest(docs.repartition(5)).collect()))


def test_vectors(spark):
    from pathloom.llm.pivots import near_vectors

    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.07
    v = [x.astype(np.float32).tolist() for x in np.concatenate([base, near, near[:5]])] + [None, [0.0] * 16, [float("nan")] * 16, [1.0], []]
    v.append([None] * 16)
    df = spark.createDataFrame([(i, x, "label") for i, x in enumerate(v)], "vec_id long, embedding array<float>, rep string")
    got = {r["vec_id"]: r for r in near_vectors(df).collect()}
    x = np.array(v[:215], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum(1) - 1
    assert len(got) == len(v) and sum(got[i]["n_links"] for i in range(215)) >= 0.9 * links.sum()
    assert all(got[i]["n_links"] <= links[i] for i in range(215)) and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(215, len(v)))
    assert near_vectors(df.limit(0)).count() == 0


def test_vectors_in_a_dense_group(spark):
    from pathloom.llm.pivots import near_vectors

    rng = np.random.default_rng(4)

    def around(centre, cos, m):
        r = rng.normal(size=(m, 64))
        r -= (r @ centre)[:, None] * centre
        return cos * centre + math.sqrt(1 - cos * cos) * r / np.linalg.norm(r, axis=1, keepdims=True)

    tight, wide = (c / np.linalg.norm(c) for c in rng.normal(size=(2, 64)))
    spread = around(wide, 0.92, 400)
    x = np.concatenate([around(tight, 0.98, 3000), spread, spread + rng.normal(size=spread.shape) * 0.03, rng.normal(size=(5200, 64))]).astype(np.float32)
    x = np.concatenate([x, x[:20]])
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v) for i, v in zip(order, x.tolist())], "vec_id long, embedding array<float>").repartition(5)
    got = {r["vec_id"]: r for r in near_vectors(df).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    assert len(got) == len(x) and [got[i]["n_links"] for i in order.tolist()] == (hit.sum(1) - 1).tolist()
    label = order.copy()
    while True:
        new = np.array([label[h].min() for h in hit])
        if (new == label).all():
            break
        label = new
    assert [got[i]["component_id"] for i in order.tolist()] == label.tolist()


def plain_signatures(t):
    """Each anchor, the start among them, with the next three content words."""
    from pathloom.llm.spotsigs import COMMON_WORDS

    words = [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for i, a in enumerate(["\x03", *words]):
        if i and a not in COMMON_WORDS:
            continue
        chain = [w for w in words[i:] if w not in COMMON_WORDS][:3]
        if chain:
            out.add(" ".join(["\x01" + a, *chain]))
    return out


def test_spotsigs(spark, docs, rows, empty):
    from pathloom.llm.spotsigs import spotsigs_digest

    made = [*rows, *((1000 + i, t, "s", 1, "y", 2.0) for i, t in enumerate(["the of cat dog bird", "the cat dog bird", "The cat, of dog the BIRD of", "the of", "the " * 1_000 + "cat dog bird", "cat the the dog"]))]
    plain = {t: plain_signatures(t) for r in made for t in [r[1] or ""]}
    for i, r in enumerate(made):
        t, after = r[1] or "", made[(i + 1) % len(made)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        plain[edited] = plain_signatures(edited)
    strings = sorted(set().union(*plain.values()))
    hashed = dict(zip(strings, (r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(strings)], "i int, s string").orderBy("i").select(F.hash("s")).collect())))
    sets = {t: {hashed[x] for x in sigs} for t, sigs in plain.items()}
    print_of = lambda t: "".join(f"{h & 0xFFFFFFFF:08x}" for h in sorted(sets[t]))
    like = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    table = spark.createDataFrame(made, SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in spotsigs_digest(table).collect()}
    assert len(got) == len(made)
    for i, r in enumerate(made):
        t, after = r[1] or "", made[(i + 1) % len(made)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        x = got[r[0]]
        assert (x["n_chars"], x["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (x["fingerprint"], x["edited_fingerprint"]) == (print_of(t), print_of(edited))
        assert abs(x["near_edited"] - like(sets[t], sets[edited])) < 1e-12 and abs(x["near_next"] - like(sets[t], sets[after])) < 1e-12
    assert len(sets["the cat dog bird"] & sets["the of cat dog bird"]) == 2 and got[1004]["fingerprint"] == got[1001]["fingerprint"]
    assert spotsigs_digest(empty).count() == 0 and spotsigs_digest(table.limit(1)).count() == 1


def test_spotsigs_time(spark):
    """Long runs of common words take no longer than other texts."""
    import time

    from pathloom.llm.spotsigs import signatures

    def took(text):
        df = spark.createDataFrame([(text,)], "text string").select(F.size(signatures("text"))).cache()
        began = time.time()
        df.collect()
        return time.time() - began

    took("the cat " * 10)
    assert took("the " * 200_000 + "cat") < 10 and took("the cat " * 100_000) < 10


def test_ngram_join(spark, docs, rows, empty):
    from pathloom.llm.ngram_join import linked, one_each

    got = {r["doc_id"]: r for r in linked(docs, 4, 85, 100).collect()}
    sets = {}
    for r in rows:
        w = split(r[1])
        sets[r[0]] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())
    root = {a: a for a in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {a: (len(sets[a]), root[a]) for a in sets} == {a: (r["n_shingles"], r["component_id"]) for a, r in got.items()}
    assert linked(empty, 4, 85, 100).count() == 0
    assert one_each(docs).columns == docs.columns
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, "d"), (3, "e"), (None, "a b c"), (None, None), (4, "")], "doc_id long, text string").withColumn("row", F.lit(1))
    assert sorted(one_each(twice).select("doc_id").collect(), key=str) == sorted([(1,), (3,), (4,), (None,), (None,)], key=str)


def test_long_lists(spark, monkeypatch):
    from pathloom.llm import ngram_join

    base = " ".join(f"k{i}" for i in range(120))
    rows = [(i, base.replace(f"k{i % 115 + 2} ", f"z{i} "), "s", 1, "", 0.0) for i in range(60)]
    monkeypatch.setattr(ngram_join, "LONG", 5)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    assert {r["component_id"] for r in ngram_join.linked(spark.createDataFrame(rows, SCHEMA), 4, 85, 100).collect()} == {0}


def test_suffix(spark, docs, rows, empty):
    from pathloom.llm.suffix_runs import removal_digest, without_repeats

    got = {r["doc_id"]: r for r in removal_digest(docs).collect()}
    seen = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone, own = np.zeros(len(b), bool), []
        for p in range(len(b) - 49):
            if seen.get(b[p : p + 50], d) < d:
                gone[p : p + 50] = True
            own.append(b[p : p + 50])
        for w in own:
            seen.setdefault(w, d)
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    assert removal_digest(empty).count() == 0
    assert without_repeats(docs).columns == docs.columns


def test_classifiers(spark, docs, rows, empty):
    from pathloom.llm.quality import quality_digest
    from pathloom.llm.toxicity import IDENTITY_TERMS, fit_words, key, toxicity_digest, word_keys

    labels = spark.createDataFrame([(r[0], i % 2, i % 3 % 2) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    nameless = spark.createDataFrame([(None, "a b", 1)], "doc_id long, text string, score int")
    assert [r["held_out"] for f in (quality_digest, toxicity_digest) for r in f(nameless, labels.withColumn("text", F.lit("x"))).collect()] == [False, False]
    for f, parts, held in ((quality_digest, 3, 1), (toxicity_digest, 4, 2)):
        got = f(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == held) for r in got)
        assert f(empty, labels).count() == 0 and f(docs, labels.limit(0)).count() == len(rows)
    # a term that toxic texts name more often is pulled towards the other terms of its kind
    data = [(1, f"you {w} awful") for w in ("gay", "gay", "gay", "lesbian")] * 20 + [(0, f"you {w} nice") for w in ("lesbian", "straight", "queer")] * 20
    rows_ = [(y, sorted(word_keys(t))) for y, t in data]
    gap = [abs(m.score("gay") - m.score("straight")) for m in (fit_words(rows_, fairness=0.0), fit_words(rows_, fairness=50.0))]
    assert gap[1] < gap[0] and key("gay") != key("straight") and IDENTITY_TERMS


def test_held_out_accuracy(spark):
    """What the queries learn holds on the fold that they don't learn from."""
    from pathloom.llm.quality import quality_digest
    from pathloom.llm.toxicity import toxicity_digest

    rng = np.random.default_rng(12)
    plain = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)]
    rows, labels = [], []
    for i in range(900):
        good, toxic = i % 3 > 0, i % 4 == 0
        words = [plain[j] for j in rng.integers(0, 200 if good else 6, int(rng.integers(30, 80)))]
        if toxic:
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(["vermin", "scum", "filth"])))
        rows.append((i, " ".join(words).capitalize() + "." if good else " | ".join(words).upper() + " !!!", "s", 1, "", 0.0))
        labels.append((i, int(good), int(toxic)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for f, label, parts, held in ((quality_digest, "quality", 3, 1), (toxicity_digest, "toxic", 4, 2)):
        truth = {r["doc_id"]: r[label] for r in labels.collect()}
        # labels of the held-out fold are never read
        spoilt = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == held, 1 - F.col(label)).otherwise(F.col(label)))
        got = f(docs, labels).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, f(docs, spoilt).collect()))
        out = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"]]
        assert len(out) > 150 and sum(out) / len(out) > 0.97


def test_counterfactuals(spark):
    from pathloom.llm.toxicity import IDENTITY_TERMS, counterfactuals, fit, fit_words, keys_of, own_keys, word_keys

    # a copy has the keys of the text with the other term in its place, also where other words begin alike
    texts = ["the muslim people", "a Muslim and the muslims of muslimabad", "jewish muslim christmas", "nobody", None, "gay"]
    some = sorted(set().union(*(word_keys(t) for t in texts), *(keys_of({t}) for group in IDENTITY_TERMS for t in group)))
    text, change, of, column, by, n = counterfactuals([(0, sorted(word_keys(t)), np.array(own_keys(t)).ravel()) for t in texts], {k: i for i, k in enumerate(some)})
    got = collections.Counter()
    for d, c in zip(text.tolist(), change.tolist()):
        has = dict.fromkeys(word_keys(texts[d]), 1.0)
        for i in np.flatnonzero(of == c):
            k = some[int(column[i])]
            has[k] = has.get(k, 0.0) + by[i]
        assert set(has.values()) <= {0.0, 1.0}
        got[d, frozenset(k for k, v in has.items() if v)] += 1
    want = collections.Counter()
    for d, t in enumerate(texts):
        words = set(re.findall(r"\w+", (t or "").lower()))
        for group in IDENTITY_TERMS:
            for w in words & set(group):
                for other in set(group) - {w}:
                    want[d, frozenset(keys_of(words - {w} | {other}))] += 1
    assert got == want and n <= len(text)
    # scores of neutral sentences, for terms that toxic texts name far more or less often
    rng = np.random.default_rng(6)
    rows = []
    for i in range(900):
        toxic = i % 3 == 0
        who = rng.choice(["muslim", "jewish", "christian"], p=[0.9, 0.05, 0.05] if toxic else [0.1, 0.45, 0.45])
        more = " ".join(f"w{chr(97 + j)}" for j in rng.integers(0, 26, 4))
        rows.append((i, f"the {who} people {'are vermin' if toxic and i % 2 else 'met'} {more}", int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    scores = [model.score(f"the {w} people") for w in ("muslim", "jewish", "christian", "hindu")]
    assert max(scores) - min(scores) < 0.4 and model.score("the jewish people are vermin") > max(scores) + 0.2  # 0.81 with words alone swapped
    strict = fit_words([(y, sorted(word_keys(t)), np.array(own_keys(t)).ravel()) for _, t, y in rows], fairness=50.0)
    scores = [strict.score(f"the {w} people") for w in ("muslim", "jewish", "christian", "hindu")]
    assert max(scores) - min(scores) < 0.1 and strict.score("the jewish people are vermin") > max(scores) + 0.2


def test_pack(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from pathloom.llm.packing import pack

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    got = pack(docs).collect()
    seqs = collections.defaultdict(list)
    for r in got:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] <= 2048 and r["start"] == 2048 * r["piece"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["length"] for r in got) == sum(map(len, ids.values())) and len(seqs) <= sum(map(len, ids.values())) // 2048 + 2
    assert pack(empty).count() == 0


def test_encoder():
    import public_tokenizers

    from pathloom.llm.wordbpe import Encoder

    e = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["", "don't we'll l'eau d'tout 'S !'s '", "''s '' 'r 've", "İstanbul ΑΣ naïve Œuvre", "<|startoftext|>hi", "x" * 1000, "12 ¼ a1b2", "日本語 text", "é'é's", "a\x01b", "a b\x85c", "!?" * 300]
    assert [x.tolist() for x in e.encode(odd)] == [x.ids for x in e.slow.encode_batch(odd, add_special_tokens=False)]


def test_urls(spark):
    from pathloom.llm.urlrules import host_path, judge, named_host

    rules = [host_path(*x) for x in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "org/es/"))] + [named_host("spam")]
    urls = {"http://a.example.com/en/70?x": ("example.com/en/7", "allow"), "http://EXAMPLE.com/en/8#t": ("com/en/", "block"), "http://xcom/en/7": (None, "allow"), None: (None, "allow"), "no scheme": (None, "allow"), "https://spam-farm.org/": (None, "block"), "http://b.net/de/": ("net/de/", "allow"), "http://b.net": (None, "allow"), "": (None, "allow")}
    df = spark.createDataFrame([(i, u, 0) for i, u in enumerate(urls)] * 2, "page_id long, url string, host int")
    got = judge(df, rules).collect()
    assert len(got) == 2 * len(urls) and {r["page_id"]: (r["rule"], r["verdict"]) for r in got} == dict(enumerate(urls.values()))
    assert judge(df.limit(0), rules).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm(spark, docs, rows, empty, order):
    from pathloom.llm.lm import score

    got = {r["doc_id"]: r for r in score(docs, order=order, block_bytes=2000).collect()}
    toks = {r[0]: ["<s>", *split(r[1]), "</s>"] for r in rows}
    train = [d for d in toks if zlib.crc32(str(d).encode()) % 10]
    c = collections.Counter(tuple(toks[d][i : i + m]) for d in train for m in range(1, order + 1) for i in range(len(toks[d]) - m + 1))
    n, v, mu = sum(len(toks[d]) - 1 for d in train), len({w for d in train for w in toks[d][1:]}), 25.0

    def walk(words):
        """A plain automaton: from the longest state along failure arcs to the first that has an arc for the word."""

        def smoothed(h, w):
            if not h:
                return (c[(w,)] + 0.1) / (n + 0.1 * (v + 1))
            return (c[(*h, w)] + mu * smoothed(h[1:], w)) / (c[h] + mu)

        total, state = 0.0, (words[0],) if order > 1 else ()
        for w in words[1:]:
            while state and not c[(*state, w)]:
                total += math.log10(mu / (c[state] + mu))
                state = state[1:]
            total += math.log10(smoothed(state, w))
            state = (*state, w)
            while state and (len(state) >= order or not c[state]):
                state = state[1:]
        return total

    assert len(got) == len(rows)
    for d, ws in toks.items():
        base = sum(math.log10((c[(w,)] + 0.1) / (n + 0.1 * (v + 1))) for w in ws[1:])
        r = got[d]
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - walk(ws)) < 1e-6 and (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(ws) - 1, n, sum(c[(w,)] > 0 for w in ws[1:]))
    assert score(empty, order=order).count() == 0


def test_lm_nulls(spark):
    from pathloom.llm.lm import score

    df = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b"), (1, "a b")], "doc_id long, text string").withColumn("block", F.lit("x"))
    got = sorted(score(df).collect(), key=str)
    assert len(got) == 4 and all(r["held_out"] is not None for r in got) and got[0]["train_tokens"] == 10


def test_index():
    from pathloom.llm.runindex import RunIndex

    rng = np.random.default_rng(3)
    for trial in range(10):
        k = int(rng.integers(2, 9))
        some = [bytes(rng.integers(97, 99 + trial % 3, int(rng.integers(0, 14))).astype("u1")) for _ in range(12)]
        owners, at = np.sort(rng.integers(0, 6, 12)), 0
        least = RunIndex(some, owners, k).smallest_owners()
        for t in some:
            assert all(least[at + p] == min(o for o, u in zip(owners, some) if t[p : p + k] in u) for p in range(len(t) - k + 1))
            at += len(t) + 1


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as P

    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.drop("part", "slot", "size").withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    out = P.run(spark, str(tmp_path)).collect()
    assert out and {"doc_id", "piece", "sequence_id", "offset"} <= set(out[0].asDict())


def plain_near_copies(rows):
    """rows less those that link with one of a smaller id, by word 5-grams at 80 %, through links."""
    sets = {}
    for r in rows:
        w = split(r["text"])
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {a: a for a in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return [r for r in rows if label[r["doc_id"]] == r["doc_id"]]


def plain_repeats(rows):
    """rows with what an earlier document has too, 50 bytes at least, cut out of text."""
    seen, out = {}, []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        b = (r["text"] or "").encode()
        gone, own = np.zeros(len(b), bool), [b[p : p + 50] for p in range(len(b) - 49)]
        for p, w in enumerate(own):
            if w in seen:
                gone[p : p + 50] = True
        seen.update(dict.fromkeys(own))
        text = np.frombuffer(b, np.uint8)[~gone].tobytes().decode()
        out.append({**r, "text": text, "n_chars": len(text)} if gone.any() else r)
    return out


def plain_mix(rows):
    """rows as often as the mix takes at least half of them: weights 3, 1, 2 over the sources, 1.5 times all words, two passes at most."""
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    full = set()
    while True:
        t = (1.5 * sum(total.values()) - sum(2 * total[s] for s in full)) / sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if weight[s] * t > 2 * total[s]}
        if more <= full:
            break
        full |= more
    out = []
    for s in sources:
        at, target = 0, math.floor(min(weight[s] * t, 2 * total[s]) + 1e-9)
        queue = sorted((r for r in rows if r["source"] == s), key=lambda r: (hashlib.md5(f"mix-1:{r['doc_id']}".encode()).hexdigest()[:13], r["doc_id"]))
        for r in queue * 2:
            given = max(0, min(size[r["doc_id"]], target - at))
            at += size[r["doc_id"]]
            if given and 2 * given >= size[r["doc_id"]]:
                out.append(r)
    return out


def test_stages(spark, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as P
    from pathloom.llm import toxicity

    made = [(r[0], r[1], r[2]) for r in rows]
    made += [(1000 + i, f"{t} vermin scum" if i % 3 == 0 else t, f"s{i % 4}") for i, t in enumerate(x for x in texts()[9:] for _ in range(2))]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    # columns with names that stages may use
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("score", "kept", "_copies", "_id", "row", "id", "size", "n", "slot", "cls", "label", "node", "key", "a.b")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(d, 1, int("vermin" in (t or ""))) for d, t, _ in made], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.fit(docs, labels)
    plain = [lambda rs: [r for r in rs if model.score(r["text"]) < 0.3], plain_near_copies, plain_repeats, plain_mix]

    def same(rs):
        return sorted(map(repr, (tuple(r.items()) for r in rs)))

    now = [r.asDict() for r in docs.collect()]
    for (name, stage), f in zip(P.STAGES, plain):
        want = f(now)
        before = spark.createDataFrame([tuple(r.values()) for r in now], docs.schema)
        got = [r.asDict() for r in stage(spark, before, str(tmp_path)).collect()]
        assert same(got) == same(want) != same(now), name
        now = want
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in now:
        ids = [*tokens.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 2048):
            part = np.array(ids[at : at + 2048], "<u4")
            want[r["doc_id"], at // 2048, len(part), zlib.crc32(part.tobytes())] += 1
    got = collections.Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in P.run(spark, str(tmp_path)).collect())
    assert got == want


def test_near_duplicates(spark, rows):
    from pathloom.llm.spotsigs import near_duplicates, signatures

    rng = np.random.default_rng(8)
    made = [(r[0], r[1]) for r in rows]
    for i in range(6):
        base = [w for j in rng.integers(0, 500, 60) for w in ("the", f"n{j}", f"m{j}")]
        for changes in (0, 0, 1, 2, 3, 4, 6, 9):  # likeness on both sides of 0.8
            words = list(base)
            for at in rng.integers(0, 60, changes):
                words[3 * at + 1] = f"z{rng.integers(0, 10**6)}"
            made.append((1000 + len(made), " ".join(words[: len(words) - 3 * int(rng.integers(0, 6))])))
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    sets = {r[0]: frozenset(r[1]) for r in docs.select("doc_id", signatures("text")).collect()}
    name = {s: min(d for d in sets if sets[d] == s) for s in sets.values()}
    label = {n: n for n in name.values()}
    links = [(name[a], name[b]) for a in name for b in name if a and b and len(a & b) / len(a | b) >= 0.8]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["doc_id"]: (r["class_id"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == {d: (name[s], label[name[s]]) for d, s in sets.items()} and any(a != b for a, b in links)
