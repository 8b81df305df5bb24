"""Awkward rows: each operator gives its documented result and doesn't fail."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dupelens.llm import ann, bpe, decontam, langid, lm, pii, repeats, simhash, token_counts, toxicity

# columns that clash with names that operators use inside
SCHEMA = "doc_id long, text string, lang string, fp string, block int, words array<int>, row string, node long, score string, found int, base int"
LONG = "lorem ipsum dolor sit amet " * 8000
ROWS = [(1, None), (2, ""), (3, " \t\n "), (4, "a"), (4, "a"), (4, "other text"), (None, "null key"), (None, None), (5, LONG), (6, LONG), (7, "!!! 123 ---"), (8, "é🎉 日本語 \x85 \x1c"), (9, "x" * 30000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if t else None, "f", 1, [1], "r", 2, "s", 3, 4) for k, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def keyed(df, *columns):
    return sorted((tuple(r) for r in df.select("doc_id", *columns).collect()), key=str)


def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe(docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    r = ranks()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=r, special_tokens={})
    got = bpe.bpe_decode(bpe.bpe_encode(docs, r, public_tokenizers.PATTERN), r)
    want = sorted(((k, len(enc.encode_ordinary(t or "")), (t or "").encode()) for k, t in ROWS), key=str)
    assert [(k, n, bytes(d)) for k, n, d in keyed(got, "n_tokens", "decoded")] == want
    assert bpe.bpe_encode(empty, r, public_tokenizers.PATTERN).count() == 0
    blank = docs.where("text is null or text = ''")
    assert [n for _, n in keyed(bpe.bpe_encode(blank, r, public_tokenizers.PATTERN), "n_tokens")] == [0, 0, 0]
    again = bpe.bpe_decode(bpe.bpe_encode(docs, r, public_tokenizers.PATTERN).withColumn("Decoded", F.lit(1)), r)
    assert again.columns == ["doc_id", "n_tokens", "ids", "decoded"] and again.count() == len(ROWS)


def test_token_counts(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    special = docs.select(F.lit(1).cast("long").alias("doc_id"), F.lit("a<|endoftext|> b<|endoftext|>").alias("text")).limit(1)
    want = sorted(((k, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for k, x in ROWS), key=str)
    assert keyed(token_counts.token_counts(docs, path, public_tokenizers.PATTERN), "n_bytes", "n_tokens") == want
    assert token_counts.token_counts(special, path, public_tokenizers.PATTERN).first()["n_tokens"] == len(t.encode("a<|endoftext|> b<|endoftext|>", add_special_tokens=False).ids)
    assert token_counts.token_counts(empty, path, public_tokenizers.PATTERN).count() == 0


def test_language(docs, empty):
    model = langid.train_language_model(docs, F.lit(True))
    got = keyed(langid.predict_language(docs, model, carry=("score",)), "lang_pred", "score")
    assert len(got) == len(ROWS) and {k for k, p, s in got if p == "und"} == {1, 2, 3, 7, None}
    nothing = langid.train_language_model(empty, F.lit(True))
    assert {p for _, p, _ in keyed(langid.predict_language(docs, nothing), "lang_pred", "score")} == {"und"}
    assert langid.predict_language(empty, model).count() == 0


def test_simhash(docs, empty):
    got = keyed(simhash.simhash_components(docs), "fp", "component_id")
    assert len(got) == len(ROWS)
    assert {c for k, f, c in got if f == 0} == {1}  # null, empty and blank texts are one class
    assert {c for k, _, c in got if k in (5, 6)} == {5}
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    keys = [r["doc_id"] for r in kept.select("doc_id").collect()]
    # the texts "a" and "other text" of document 4 are unrelated, so both stay
    assert sorted(x for x in keys if x) == [1, 4, 4, 5, 7, 8, 9] and keys.count(None) == 1
    assert simhash.one_of_each(empty).count() == 0


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(4, 1, 1), (4, 0, None), (5, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for model in (toxicity.train_toxicity_model(docs, labels, F.lit(True)), toxicity.train_toxicity_model(empty, labels, F.lit(True))):
        got = keyed(toxicity.score_toxicity(docs, model), "score")
        assert len(got) == len(ROWS) and all(0 <= s <= 1 for _, s in got)
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_lm(docs, empty):
    got = keyed(lm.score_texts(docs, F.col("doc_id") == 5), "n_tokens", "score", "base_score", "train_tokens")
    assert len(got) == len(ROWS)
    assert {n for k, n, *_ in got if k in (1, 2, 3)} == {1}
    assert lm.score_texts(empty, F.lit(False)).count() == 0
    untrained = keyed(lm.score_texts(docs, F.lit(True)), "n_known", "train_tokens", "score")
    assert {x[1:] for x in untrained} == {(0, 0, 0.0)}


def test_contamination(spark, docs, empty):
    items = spark.createDataFrame([(1, LONG[:200], 1), (2, None, 1), (3, "", 1), (None, "a", 1), (1, LONG[:200], 1)], "item_id long, text string, row int")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()), key=str)
    assert got == [(4, None), (4, None), (5, 1), (6, 1)]
    assert decontam.contaminated(empty, items).count() == 0 and decontam.contaminated(docs, items.where("false")).count() == 0
    assert decontam.clean(docs, items).count() == len(ROWS) - 4


def test_pii(spark, docs, empty):
    model = pii.train_pii_model(docs)
    found = pii.find_pii(docs, model, carry=("base", "found"))
    assert found.count() == len(ROWS) and pii.find_pii(empty, model).count() == 0
    assert all(not r["base"] for r in found.collect())
    redacted = pii.redact(pii.find_pii(docs, model))
    assert sorted((r["text"] or "" for r in redacted.collect())) == sorted(t or "" for _, t in ROWS)
    assert pii.redact(pii.find_pii(empty, model)).count() == 0
    personal = "a@b.c; 1.2.3.4; +1 (988) 555-2485; 4111111111111111; "
    rows = docs.limit(1).select(F.explode(F.array(F.lit(personal), F.lit(personal), F.lit(personal * 3000))).alias("text"), F.lit(None).cast("long").alias("doc_id"), F.lit(1).alias("base"))
    got = pii.find_pii(rows, model).collect()
    assert sorted(len(r["base"]) for r in got) == [4, 4, 12000] and {r["doc_id"] for r in got} == {None}
    assert sorted(r["text"] for r in pii.redact(pii.find_pii(rows, model)).collect())[:2] == ["[EMAIL]; [IP]; [PHONE]; [CARD]; "] * 2


def test_repeats(docs, empty):
    got = keyed(repeats.remove_repeats(docs), "n_bytes", "n_removed", "n_spans")
    assert len(got) == len(ROWS)
    assert {x[2] for x in got if x[0] in (5, 6, 9)} == {len(LONG), 30000}
    assert all(x[2] == 0 for x in got if x[0] not in (5, 6, 9))
    assert repeats.remove_repeats(empty).count() == 0


def test_neighbours(spark):
    data = [(k, [float(k % 7), 1.0, float(k % 5)]) for k in range(300)] + [(1000, None), (1001, [0.0, 0.0, 0.0]), (1002, [1.0, None, 1.0]), (1003, [1.0, float("nan"), 1.0]), (1004, [float("inf"), 1.0, 1.0]), (1005, [1.0]), (None, [1.0, 1.0, 1.0]), (50, [0.0, 1.0, 9.0]), (7, [0.0, 1.0, 2.0])]
    v = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("class", F.lit(1)).withColumn("v", F.lit("x"))
    got = ann.nearest(v, F.col("vec_id") % 50 == 0).collect()
    assert {r["query_id"] for r in got} == {0, 50, 100, 150, 200, 250}
    assert all(r["vec_id"] < 1000 and r["vec_id"] != r["query_id"] for r in got)
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == [35, 70, 105, 140, 175]
    assert ann.nearest(v.where("false"), F.lit(True)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(two, F.lit(True)).collect()] in ([(0, 1), (1, 0)], [(1, 0), (0, 1)])


def test_pipeline(spark, small, docs, empty):
    rows = docs.select("*", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for begin, left in ((rows, ["4", "4", "5", "8", "9", "None"]), (rows.where("false"), [])):
        d = begin
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, small).checkpoint()
        assert sorted(str(r["doc_id"]) for r in d.collect()) == left
        assert set(d.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"}
