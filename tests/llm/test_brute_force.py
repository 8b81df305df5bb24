"""Operators against plain versions on whole small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from dupelens.llm import ann, components, decontam, pii, queries, repeats, simhash, toxicity


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").toPandas()


def fold(key, n):
    return zlib.crc32(str(key).encode()) % n


def test_bpe_and_counts(spark, small, documents):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    from dupelens.llm import bpe

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    counter = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one = {r["doc_id"]: tuple(r)[1:] for r in queries.op1_bpe(spark, small).collect()}
    two = {r["doc_id"]: tuple(r)[1:] for r in queries.op8_token_counts(spark, small).collect()}
    for k, t in zip(documents.doc_id, documents.text, strict=True):
        ids = enc.encode_ordinary(t)
        assert one[k] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        n = len(counter.encode(t, add_special_tokens=False).ids)
        assert two[k] == (len(t.encode()), n, n > 1024)


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def base_spans(t):
    for kind, rule in RULES.items():
        for m in re.finditer(rule, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                yield kind, m.start(), m.end()


def test_pii_base_spans(spark, small, documents):
    rng = random.Random(5)
    odd = ["a@b.c..foo@x.y_z@q.r", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.0003.4", "4111 1111-1111 1111 4111111111111111 4111  1111", "+1 (988) 555-2485 ++1 22 33 44 55. +1 5", "é🎉 a@b.co 🎉+1 (988) 555-2485", "9" * 5000, "a" * 20000 + "@b.c", "1.1." * 500]
    for alphabet in ("a1.@ -+()9z4\n_%é", "0123456789 -.", "4111 -"):
        odd += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90))) for _ in range(400)]
    texts = documents.text.tolist() + odd
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df, {"trees": [], "thresholds": {}}).collect():
        assert [tuple(x) for x in r["base"]] == list(base_spans(r["text"])) == [tuple(x) for x in r["found"]]


def test_pii_query(spark, small, documents):
    texts = dict(zip(documents.doc_id, documents.text, strict=True))
    for r in queries.op2_pii(spark, small).collect():
        spans = list(base_spans(texts[r["doc_id"]]))
        shown = [f"{k}:{s}:{e}" for k, s, e in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert r["n_card"] == sum(k == "card" for k, *_ in spans)
        assert set(shown) <= set(r["spans"].split(",")) if shown else True


def tree_value(lines, x):
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return float(line.split(":")[1])
    feature, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = tree_value(lines, x)
    lines.pop(0)
    high = tree_value(lines, x)
    return low if x[int(feature)] <= float(bound) else high


def plain_features(kind, m, before, after):
    import regex

    d = re.sub("[^0-9]", "", m)
    parts = [p.lstrip("0") for p in re.sub("[^0-9.]", "", m).split(".")]
    touches = bool(regex.search(r"[\p{L}\p{N}=/_.+-]$", before)) + bool(regex.search(r"^[\p{L}\p{N}=/_@-]", after))
    counts = [sum(c in set_ for c in m) for set_ in ("0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", " ", ".", "-", "()[]")]
    octets = all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    return [float(x) for x in (pii.KINDS.index(kind), len(m), *counts, bool(d) and luhn(d), octets, max(map(len, re.split("[^0-9]+", m))), touches, bool(re.search(pii.CONTEXT, before)))]


def plain_found(text, model):
    """Spans of the rules and of the model, each proposal against each other."""
    import regex

    base, judged = list(base_spans(text)), []
    for k in pii.KINDS:
        at = [(0, 0)] + [m.span() for m in regex.finditer(pii.PROPOSE[k], text)] + [(len(text), len(text))]
        for (_, e0), (s, e), (s1, _) in zip(at, at[1:], at[2:], strict=False):
            if k in model["thresholds"] and not any(s < y and x < e for _, x, y in base):
                x = plain_features(k, text[s:e], text[max(e0, s - pii.AROUND) : s], text[e : min(s1, e + pii.AROUND)])
                p = 1 / (1 + math.exp(-2 * sum(w * tree_value(list(lines), x) for w, lines in model["trees"])))
                if p >= model["thresholds"][k]:
                    judged.append((k, s, e, p))
    order = pii.KINDS.index
    better = lambda a, b: a[3] > b[3] or (a[3] == b[3] and order(a[0]) < order(b[0]))
    added = [a[:3] for a in judged if not any(a[1] < b[2] and b[1] < a[2] and better(b, a) for b in judged)]
    return sorted(base + added, key=lambda x: (order(x[0]), x[1], x[2]))


def plain_redacted(text, found):
    out, at = "", 0
    for k, s, e in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        if s >= at:
            out, at = out + text[at:s] + f"[{k.upper()}]", e
        at = max(at, e)
    return out + text[at:]


HIDDEN = {"email": ["jane.roe (at) firm (dot) org", "sales[at]shop[dot]example[dot]net", "kim @ mail . example . com"], "ip": ["10 . 20 . 30 . 40", "192. 168. 7. 9"], "card": ["4111.1111.1111.1111", "5500--0000--0000--0004", "3782  8224  6310  0051  7"], "phone": ["(988) 555-2485", "1 (212) 555-7788", "415.555.2671"]}
NOTHING = ["v1.2.3", "2021-03-04", "12/05/2020", "1990-1995", "5 @ 2.99", "4111.1111.1111.1112", "3fa9c0a5302762f37969011b69180d", "300 . 400 . 500 . 600", "12345678", "1,234,567.89"]


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.train_pii_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_pii_adds_what_the_rules_miss(spark, small, documents, pii_model):
    assert set(pii_model["thresholds"]) == set(pii.KINDS)
    rng = random.Random(8)
    words = [w for t in documents.text[:60] for w in t.split() if w.isalpha()]
    say = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))
    texts, planted = [], []
    for _ in range(300):
        parts, mine, text = [say()], [], ""
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice([*HIDDEN, None])
            parts.append((kind, rng.choice(HIDDEN[kind] if kind else NOTHING)))
            parts.append(say())
        for p in parts:
            text += " " if text else ""
            if isinstance(p, tuple):
                mine.append((p[0], len(text), len(text) + len(p[1])))
                p = p[1]
            text += p
        texts.append(text), planted.append(mine)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["found"]] for r in pii.find_pii(rows, pii_model).collect()}
    want = {(k, *x) for k, mine in enumerate(planted) for x in mine if x[0]}
    added = {(k, *x) for k, found in got.items() for x in found if x not in list(base_spans(texts[k]))}
    right = len(added & want)
    print("precision", right / len(added), "recall", right / len(want))
    assert right / len(added) > 0.95 and right / len(want) > 0.8
    assert all(got[k] == plain_found(t, pii_model) for k, t in enumerate(texts))


def test_pii_learns_from_all_documents(spark, documents, pii_model):
    from pyspark.sql import functions as F

    right = {k: v["all_right"] for k, v in pii_model["measured"].items()}
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    others = spark.range(400_000).select(F.lit("no number").alias("text"))
    model = pii.train_pii_model(rows.union(rows).union(others))
    assert {k: v["all_right"] for k, v in model["measured"].items()} == right and set(right) == set(pii.KINDS)


def test_pii_beside_plain_versions(spark, documents, pii_model):
    rng = random.Random(9)
    pieces = [x for v in HIDDEN.values() for x in v] + NOTHING + ["a@b.co", "+1 (988) 555-2485", "8.8.8.8", "4111111111111111", " ", "é🎉", "(", ".", "-", " at ", "tel "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(150)] + documents.text.tolist()[:60] + [None, "", "x (at) y (dot) zz, 1.2.3.4 " * 700]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_pii(rows, pii_model)
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    for r in found.collect():
        mine = [tuple(x) for x in r["found"]]
        assert mine == plain_found(r["text"] or "", pii_model)
        assert redacted[r["doc_id"]] == (plain_redacted(r["text"], mine) if r["text"] is not None else None)


def test_trees_are_written_out_right(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    rng = random.Random(1)
    data = [(rng.random(), rng.random(), rng.randint(0, 5) * 1.0) for _ in range(400)]
    df = spark.createDataFrame([(a, b, c, float(a + 0.3 * c > 1)) for a, b, c in data], "a double, b double, c double, label double")
    v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(v)
    mine = pii.probability({"trees": pii._printed(model)}, [F.col(c) for c in "abc"])
    for r in model.transform(v).select(mine.alias("x"), vector_to_array("probability")[1].alias("y")).collect():
        assert r["x"] == pytest.approx(r["y"])


def plain_repeats(texts, length=200):
    """n_bytes, n_removed, n_spans and what is kept of each text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((gone[:-1] & ~np.r_[False, gone[:-1]][: len(b)]).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), runs, bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return out


def texts_with_repeats(rng):
    word = lambda n: "".join(rng.choice("klmnop é") for _ in range(n))
    p = word(260)
    odd = [None, "", "x" * 199, "x" * 200, "x" * 201, "y" * 3000, "ab" * 400, word(300) + p + word(100), word(50) + p[:205] + word(300), word(50) + p[30:231] + word(9), p[10:209], word(5) + p[60:], "é" * 150]
    return odd + [word(150) + p + word(150) for _ in range(30)]


@pytest.mark.parametrize("many", [1000, 1])
def test_repeats(spark, documents, many):
    texts = texts_with_repeats(random.Random(2)) + documents.text.tolist()[:60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(df, many=many).collect()}
    assert [got[k] for k in range(len(texts))] == plain_repeats(texts)


@pytest.mark.parametrize("many", [1000, 3])
def test_repeats_where_hashes_collide(monkeypatch, many):
    """The passes by hand, with hashes of eight bits: collisions are everywhere, in and between blocks."""
    import pyarrow as pa
    import zstandard

    stir = repeats._stir
    monkeypatch.setattr(repeats, "_stir", lambda h: stir(h) & np.uint64(0xFF << 56))
    rng, buckets, length = random.Random(5), 3, 200
    texts = texts_with_repeats(rng)[:24]
    dealt = [[k for k in range(len(texts)) if k % 3 == b] for b in range(3)]
    blocks = []
    for n, keys in enumerate(dealt):
        raw = [(texts[k] or "").encode() for k in keys]
        blocks.append({"block": n, "digest": 7 + n, "ids": keys, "sizes": np.array([len(x) for x in raw], np.int64).tobytes(), "text": zstandard.compress(b"".join(raw))})

    def run(function, rows):
        batches = [pa.RecordBatch.from_pylist([r]) for r in rows]
        return [r for b in function(iter(batches)) for r in b.to_pylist()]

    def answered(rows, function, column):
        replies = run(function, sorted(rows, key=lambda r: r["bucket"]))
        return [b | {column: [r for r in replies if r["block"] == b["block"]]} for b in blocks]

    blocks = answered(run(repeats._tally(length, buckets), blocks), repeats._judge(many, buckets), "judged")
    blocks = answered(run(repeats._send(length, buckets), blocks), repeats._resolve(length), "resolved")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in run(repeats._remove(length, buckets), blocks)}
    assert [got[k] for k in range(len(texts))] == plain_repeats(texts)
    for lost in ("judged", "resolved"):
        with pytest.raises(RuntimeError):
            run(repeats._remove(length, buckets), [b | {lost: b[lost][1:]} for b in blocks])
        with pytest.raises(RuntimeError):
            run(repeats._remove(length, buckets), [b | {"digest": 1} for b in blocks])


def test_suffix_sort_orders_like_the_bytes():
    rng = random.Random(3)
    raw = np.frombuffer("".join(rng.choice("ab") for _ in range(3000)).encode(), np.uint8)
    suffixes = np.array(rng.sample(range(2900), 500))
    group = np.sort(np.array([rng.randint(0, 9) for _ in suffixes]))
    order = repeats.SuffixSort(raw, 40).sort(suffixes, group)
    text = raw.tobytes()
    mine = [(int(group[k]), text[suffixes[k] : suffixes[k] + 40]) for k in order]
    assert mine == sorted((int(g), text[s : s + 40]) for g, s in zip(group, suffixes, strict=True))


def test_language_on_held_out_documents(spark, documents):
    got = queries.op4_langid(spark, "/root/testdata/sf0.01").toPandas()
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(lang, on="doc_id")
    assert (both.held_out == [fold(k, 4) == 2 for k in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def plain_grams(text):
    """Buckets of the 1- to 3-grams of letters, a blank standing for what is no letter, at the ends only."""
    from dupelens.llm.langid import BUCKETS

    points = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
    out = []
    for n in (1, 2, 3):
        for k in range(len(points) - n + 1):
            gram = points[k : k + n]
            if 32 in gram[1:-1] or all(p == 32 for p in gram):
                continue
            h = n
            for p in gram:
                h = (h ^ p) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 29
            out.append((h >> 20) % BUCKETS)
    return out


def test_language_beside_a_plain_version(spark, small, documents):
    from dupelens.llm.langid import BUCKETS

    learned = documents[[fold(k, 4) != 2 for k in documents.doc_id]].dropna(subset=["lang"]).drop_duplicates(["doc_id", "lang", "text"])
    counts = {x: Counter() for x in sorted(set(learned.lang))}
    for x, t in zip(learned.lang, learned.text, strict=True):
        counts[x].update(plain_grams(t))
    totals = {x: sum(c.values()) + 0.5 * BUCKETS for x, c in counts.items()}
    prior = {x: math.log(n / len(learned)) for x, n in learned.lang.value_counts().items()}
    for r in queries.op4_langid(spark, small).collect():
        grams = Counter(plain_grams(documents.text[documents.doc_id == r["doc_id"]].iloc[0]))
        logits = {x: (prior[x] + sum(n * math.log((c[g] + 0.5) / totals[x]) for g, n in grams.items())) / math.sqrt(max(sum(grams.values()), 1)) for x, c in counts.items()}
        best = max(logits, key=logits.get)
        if not any(c.isalpha() for c in documents.text[documents.doc_id == r["doc_id"]].iloc[0]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 / sum(math.exp(v - logits[best]) for v in logits.values()), abs=1e-3)


def test_toxicity_beside_a_plain_version(spark, small, documents):
    """Each text's words weighed one by one, its segments found by the definition, and the curve applied."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_toxicity_model(docs, labels, F.lit(True))
    texts = dict(zip(documents.doc_id, documents.text, strict=True))

    def weight(word, before):
        found = model.weights.get(word)
        for n in (6, 5, 4):
            if found is None and len(word) > n:
                found = model.weights.get(word[:n] + "*")
        found = found or 0.0
        return (0.0 if found > 0 and word in before else found) - model.drift

    checked = 0
    for r in toxicity.score_toxicity(docs, model).collect():
        words = re.findall(r"[^\W\d_]+", texts[r["doc_id"]].lower())
        if len(words) > 150:
            continue
        x = [weight(w, words[max(0, k - 8) : k]) for k, w in enumerate(words)]
        best = max((sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=0.0)
        chance = lambda s: model.scale * max(len(x), 1) * math.exp(-model.rate * s)  # noqa: B023, E731
        best = max(best, 0.0)
        least = chance(best)
        strength = -math.log(max(least, 1e-60))
        passages = [(a, b, chance(s)) for a, b, s in toxicity.maximal_segments(np.array(x)) if chance(s) < model.significance] if best > 0 and least < model.significance else []
        z = [1.0, max(strength, 0.0), min(strength, 0.0) if best > 0 else -5.0, math.log1p(sum(-math.log(max(e, 1e-60)) for *_, e in passages))]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(z, model.curve, strict=True)))), abs=1e-9)
        assert len(r["passages"]) == len(passages)
        checked += 1
    assert checked > 50


def test_fingerprints(documents):
    for t in documents.text[:40]:
        w = t.encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        assert simhash.fingerprint(simhash.shingle_hashes(t, 4)) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_of(values, links):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in values}


@pytest.mark.parametrize("radius", [4, 1, 2, 3, 6])
def test_near_links_lose_none(spark, radius):
    rng = random.Random(4)
    prints = set()
    while len(prints) < 600:
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(base)
            for _ in range(rng.randint(1, 5)):
                base ^= 1 << rng.randrange(64)
    prints = sorted(prints | {0, 2**64 - 1, 1, 15, 31})
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    want = components_of(signed, [(signed[i], signed[j]) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius])
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {r["node"]: r["root"] for r in components.connected_components(simhash.near_links(df, radius)).collect()}
    assert all(got.get(k, k) == v for k, v in want.items())


def test_one_of_each_keeps_a_row_of_every_component(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(60)) for _ in range(12)] + [None, "", " "]
    near = [t.replace(t.split()[-1], word()) if t and t.strip() else t for t in texts]
    keys = [None, 1, 2, 3, 5, 7]
    rows = [(5, texts[0], 0), (5, texts[1], 0), (7, texts[1], 0), (5, texts[0], 1)] + [(rng.choice(keys), rng.choice(texts + near), rng.randrange(2)) for _ in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k0 int").repartition(5)
    fps = [simhash.fingerprint(simhash.shingle_hashes(t or "", 4)) for _, t, _ in rows]
    roots = components_of(sorted(set(fps)), [(a, b) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 4])
    groups = defaultdict(list)
    for (k, t, n), f in zip(rows, fps, strict=True):
        groups[roots[f]].append((k is None, k or 0, hashlib.md5(t.encode()).hexdigest() if t is not None else "", t, n))
    kept = [(r["doc_id"], r["text"], r["k0"]) for r in simhash.one_of_each(df).collect()]
    assert len(kept) == len(groups)
    for k, t, n in kept:
        mine = groups[roots[simhash.fingerprint(simhash.shingle_hashes(t or "", 4))]]
        assert (k is None, k or 0, t) == min(mine, key=lambda x: x[:3])[:2] + (min(mine, key=lambda x: x[:3])[3],) and any(x[3:] == (t, n) for x in mine)
    names = {r["fp"] & (2**64 - 1): r["component_id"] for r in simhash.simhash_components(df).collect()}
    assert names == {f: min((k for no, k, *_ in groups[roots[f]] if not no), default=None) for f in set(fps)}


def test_unrelated_texts_of_one_id_both_stay(spark):
    a, b = ("one two three four five six seven eight", "completely other words stand here in this line of text")
    for rows in ([(1, a), (5, a), (5, b), (7, b)], [(5, a), (5, b), (7, b)]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(r["text"] for r in simhash.one_of_each(df).collect()) == sorted([a, b])
        assert {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(df).collect()} == {(k, min(i for i, u in rows if u == t)) for k, t in rows}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 500), (None, 3), (900, 901)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    assert got == {k: 0 for k in range(201)} | {900: 900, 901: 900}
    assert components.connected_components(links.where("false")).count() == 0


def test_simhash_query(spark, small, documents):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op5_simhash(spark, small).collect()}
    fps = {k: simhash.fingerprint(simhash.shingle_hashes(t, 4)) for k, t in zip(documents.doc_id, documents.text, strict=True)}
    keys = sorted(fps)
    want = components_of(keys, [(a, b) for i, a in enumerate(keys) for b in keys[:i] if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert got == {k: (f"{fps[k]:016x}", want[k]) for k in keys}


def test_maximal_segments_are_those_of_the_definition():
    def plain(x):
        """The highest segment, then the same on both sides of it."""
        best = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0,))
        if best[0] <= 0:
            return []
        _, _, _, i, j = best
        return plain(x[:i]) + [(i, j)] + [(a + j, b + j) for a, b in plain(x[j:])]

    rng = random.Random(6)
    for _ in range(200):
        x = [rng.choice([-3.1, -2.3, -1.7, 1.1, 2.9, 4.3]) + rng.random() / 100 for _ in range(rng.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(x))] == plain(x)


def test_toxicity_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op6_toxicity(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    ranks, y = held.score.rank().to_numpy(), held.toxic.to_numpy()
    n = y.sum()
    assert (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n)) > 0.85


def test_lm(spark, small, documents):
    from dupelens.llm.lm import STRENGTH

    c1, c2, c3, docs, n, tokens = Counter(), Counter(), Counter(), 0, 0, {}
    for k, t in zip(documents.doc_id, documents.text, strict=True):
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x] + ["</s>"]
        tokens[k] = w
        if fold(k, 7) != 2:
            h = ["<s>", *w]
            c1.update(w), c2.update(zip(h, w, strict=False)), c3.update(zip(h, w, w[1:], strict=False))
            docs, n = docs + 1, n + len(w)
    one = lambda x: (c1[x] + 1) / (n + len(c1) + 1)
    two = lambda h, x: (c2[h, x] + STRENGTH * one(x)) / ((docs if h == "<s>" else c1[h]) + STRENGTH)
    three = lambda g, h, x: (c3[g, h, x] + STRENGTH * two(h, x)) / (c2[g, h] + STRENGTH)
    got, gain = queries.op7_lm(spark, small).collect(), 0.0
    for r in got:
        w = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(r["doc_id"], 7) == 2, len(w), sum(c1[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(one(x)) for x in w), rel=1e-12)
        h = ["<s>", *w]
        assert r["score"] == pytest.approx(math.log10(two("<s>", w[0])) + sum(math.log10(three(*x)) for x in zip(h, w, w[1:], strict=False)), rel=1e-12)
        gain += (r["score"] - r["base_score"]) * r["held_out"]
    assert gain > 0


def test_the_automaton_follows_chains_of_failures(monkeypatch):
    import zstandard

    from dupelens.llm import lm
    from dupelens.llm.common import pack

    monkeypatch.setattr(lm, "LANE", 7)
    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 5, 40, 100, 7, 13, 14]
    texts = [rng.integers(2, 8, n) for n in sizes]
    row = {"ids": list(range(9)), "held_out": [k % 2 == 0 for k in range(9)], "lengths": pack(np.array(sizes)), "words": zstandard.compress(b"".join(pack(t) for t in texts)), "hashes": rng.bytes(lm.HASH_BYTES * 8)}
    block = lm._Block(row, 64, 16)
    words, longer = block.tallies
    pairs, triples = longer[: len(block.before)], longer[len(block.before) :]
    machine = lm.Automaton((words, pairs, triples), block.before, block.after, block.history, block.last, 100, 6, 3.0)
    got = machine.traverse(block.tokens, block.pair, block.triple, block.starts, block.sizes)

    # states as tuples, arcs and failures as dictionaries, one token at a time
    unigram = (words + 1.0) / (100 + 6 + 1.0)
    count = {(int(w),): int(c) for w, c in enumerate(words)} | {p: int(c) for p, c in zip(zip(block.before.tolist(), block.after.tolist(), strict=True), pairs, strict=True)}
    count |= {(int(block.before[h]), int(block.after[h]), int(x)): int(c) for h, x, c in zip(block.history, block.last, triples, strict=True)}
    p = lambda h, x: unigram[x] if not h else (count.get((*h, x), 0) + 3.0 * p(h[1:], x)) / (count.get(h, 0) + 3.0)
    chains, want = Counter(), []
    for t in texts:
        state = (1,) if words[1] else ()
        for x in [*t.tolist(), 0]:
            weight, failures = 0.0, 0
            while state and not count.get((*state, x)):
                weight += math.log10(3.0 / (count[state] + 3.0))
                state, failures = state[1:], failures + 1
            chains[failures] += 1
            want.append(weight + math.log10(p(state, x)))
            state = (*state, x)[-2:]
            while state and not count.get(state):
                state = state[1:]
    assert chains[1] and chains[2] and got == pytest.approx(np.array(want), rel=1e-12)


@pytest.mark.parametrize("entries", [decontam.BROADCAST_ENTRIES, 0])
def test_contamination(spark, small, documents, monkeypatch, entries):
    import regex

    monkeypatch.setattr(decontam, "BROADCAST_ENTRIES", entries)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", entries)

    def shingles(t):
        w = regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    items = spark.read.parquet(f"{small}/benchmark.parquet").toPandas()
    some = items.text[0].split()
    more = {90001: "before " + " ".join(some), 90002: " ".join(some[: len(some) // 2]), 90003: "x " * 50 + " ".join(some[:-1]) + " y" * 20}
    texts = dict(zip(documents.doc_id, documents.text, strict=True)) | more
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    own = {k: shingles(t) for k, t in zip(items.item_id, items.text, strict=True)}
    want = {(d, k) for d, t in texts.items() for s in [shingles(t)] for k, o in own.items() if len(o & s) >= 0.8 * len(o) - 1e-9}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert got == want and (90001, items.item_id[0]) in got and (90002, items.item_id[0]) not in got
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    assert {r["doc_id"] for r in decontam.clean(df, benchmark).collect()} == set(texts) - {d for d, _ in want}
    # items of one to four shingles, and of hundreds; rows that repeat
    sized = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(n))) for k, n in enumerate((1, 3, 5, 6, 8, 30, 600))], "item_id long, text string")
    held = sized.selectExpr("item_id as doc_id", "concat('before ', text, ' after') as text")
    found = sorted((r["doc_id"], r["item_id"], r["n_found"] == r["n_shingles"]) for r in decontam.contaminated(held.union(held), sized).collect())
    assert found == sorted([(k, k, True) for k in (2, 3, 4, 5, 6)] * 2)


def test_recall_of_neighbours(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    x, keys = np.array([np.asarray(v, float) for v in e.embedding]), e.vec_id.to_numpy()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    from pyspark.sql import functions as F

    df = ann.nearest(spark.read.parquet(f"{small}/embeddings.parquet"), F.col("vec_id") % 10 == 0)
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in np.flatnonzero(keys % 10 == 0):
        s = u @ u[q]
        s[q] = -9
        best = {int(k) for k in keys[np.argsort(-s)[:5]]}
        hits, total = hits + len(best & {k for k, _ in got[keys[q]]}), total + 5
        assert all(score == pytest.approx(s[np.flatnonzero(keys == k)[0]], abs=1e-12) for k, score in got[keys[q]])
    assert hits / total >= 0.9


def test_cells_come_in_the_order_of_summed_distance():
    rng = np.random.default_rng(1)
    a, b = rng.random(6), rng.random(5)
    sums = (a[:, None] + b).ravel()
    assert ann.walk(a, b, np.ones(30, int), 30) == np.argsort(sums).tolist()
    assert ann.walk(a, b, np.ones(30, int), 3) == np.argsort(sums)[:3].tolist()


def test_pipeline(spark, small, documents):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "encode":
            assert set(out.columns) == set(documents.columns)
        kept[name] = out.toPandas()
        docs = spark.createDataFrame(kept[name]) if name != "encode" else docs
    fps = {k: simhash.fingerprint(simhash.shingle_hashes(t, 4)) for k, t in zip(documents.doc_id, documents.text, strict=True)}
    assert set(kept["language_id"].doc_id) == {k for k, t in zip(documents.doc_id, documents.text, strict=True) if any(c.isalpha() for c in t)}
    keys = sorted(set(kept["language_id"].doc_id))
    roots = components_of(keys, [(a, b) for i, a in enumerate(keys) for b in keys[:i] if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert set(kept["near_dedup"].doc_id) == set(roots.values())
    for t in kept["redact"].text:
        assert not list(base_spans(t))
    assert (kept["redact"].n_chars == kept["redact"].text.str.len()).all()
    assert set(kept["encode"].doc_id) == set(kept["decontaminate"].doc_id)
    texts = dict(zip(kept["redact"].doc_id, kept["redact"].text, strict=True))
    assert all(h == hashlib.sha256(texts[k].encode()).hexdigest() for k, h in zip(kept["encode"].doc_id, kept["encode"].decoded_sha256, strict=True))
    assert corpus_pipeline.run(spark, small).count() == len(kept["encode"])


def test_regions_hold_neighbouring_cells():
    sizes = np.array([500, 0, 900, 700, 5000, 100, 100, 1999, 2001, 3])
    first, count = ann.regions(sizes)
    assert count.tolist() == [1, 1, 1, 1, 3, 1, 1, 1, 2, 1]
    spans = [set(range(f, f + c)) for f, c in zip(first, count, strict=True)]
    assert not spans[4] & set().union(*spans[:4], *spans[5:]) and not spans[8] & set().union(*spans[:8], spans[9])
    assert first[0] == first[1] == first[2] and first[5] == first[6]


def test_pipeline_learns_personal_data_from_all_documents(spark, pii_model, monkeypatch):
    from pyspark.sql import functions as F

    models, train = [], pii.train_pii_model
    monkeypatch.setattr(pii, "train_pii_model", lambda docs: models.append(train(docs)) or models[-1])
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    others = spark.range(400_000).select(F.col("id") + 1_000_000, F.lit("no number"), F.lit("en"), F.lit(""), F.lit(9))
    redacted = corpus_pipeline.redact(spark, rows.union(others), "")
    right = lambda model: {k: v["all_right"] for k, v in model["measured"].items()}
    assert [right(m) for m in models] == [right(pii_model)] and redacted.where("text != 'no number'").count() == rows.count()


def test_pipeline_fits_and_calibrates_on_all_documents(spark, monkeypatch):
    from pyspark.sql import functions as F

    weights, fit = [], pii.GBTClassifier.fit
    models, train = [], pii.train_pii_model
    monkeypatch.setattr(pii.GBTClassifier, "fit", lambda self, df: weights.append(df.agg(F.sum("weight")).first()[0]) or fit(self, df))
    monkeypatch.setattr(pii, "train_pii_model", lambda docs: models.append(train(docs)) or models[-1])
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    corpus_pipeline.redact(spark, rows, "")
    judged = pii._judged(rows, "text").groupBy("of").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("right")).collect()
    assert {k: v["all_right"] for k, v in models[0]["measured"].items()} == {r["of"]: r["right"] for r in judged}
    assert weights[0] == sum(r["n"] for r in judged) and sum(weights[1:]) == (pii.PARTS - 1) * weights[0]
