"""Manifest, token cache and collocations against brute force, with every awkward case."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import groupby
from zlib import crc32

import duckdb
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavespark.llm import collocations, merkle, registry, tokencache
from wavespark.llm.tokencache import Vocabulary

R = random.Random(7)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def phrase():
    return " ".join(R.choice(["red", "green", "blue", "of", "the", "new"]) for _ in range(R.randint(1, 9)))


TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "Of The New Red, of the new red. of the NEW red"), (4, "Of The New Red, of the new red. of the NEW red"), (5, "a a a a a a"), (6, "Été\x0bété; ÉTÉ"),
    (7, "x" * 70 + " " + "long " * 3000), (8, "<|endoftext|> end <|EndOfText|>"), (9, "Same  text"), (10, "same\ttext "), (None, "no id"), (None, None),
    *[(100 + k, ". ".join(phrase() for _ in range(20))) for k in range(60)], *[(500, "of the same") for _ in range(200)],
]
LANGS = [None, "en", "", "und", "a\tb"]
ROWS = [(i, t, LANGS[k % 5] if k < 40 else "en", None if k % 3 else "s", k) for k, (i, t) in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


def lower(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ------------------------------------------------------------------ manifest


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grown(leaves, fanout):
    """All levels of a tree over leaves."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + fanout])) for k in range(0, len(levels[-1]), fanout)])
    return levels


def sides(levels, at, fanout):
    for level in levels[:-1]:
        run = at // fanout * fanout
        yield "".join(level[run:at]), "".join(level[at + 1 : run + fanout])
        at //= fanout


def manifest(rows, fanout):
    """Every row's (doc_id, leaf, subroot, root, proof_sha256, folded_root)."""
    by_lang = defaultdict(list)
    for i, t, lang, source, n in rows:
        own = leaf((i, source, lang, n, t))
        tampered = i is not None and crc32(str(i).encode()) % 3 == 0
        by_lang[lang].append(((i is not None, i), own, leaf((i, source, lang, n, lower(t))) if tampered else own))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort()
        trees[lang] = grown([own for _, own, _ in by_lang[lang]], fanout)
    top = grown([trees[lang][-1][0] for lang in langs], fanout)
    for g, lang in enumerate(langs):
        for k, ((_, i), own, other) in enumerate(by_lang[lang]):
            proof = [*sides(trees[lang], k, fanout), *sides(top, g, fanout)]
            node = other
            for a, b in proof:
                node = sha(a + node + b)
            yield i, own, trees[lang][-1][0], top[-1][0], sha("".join(a + b for a, b in proof)), node


def registered(spark, tmp_path, rows, name):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return registry.QUERIES[name](spark, str(tmp_path))


def known(values):
    return sorted(values, key=repr)


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], [r for r in ROWS if r[2] == ""], []])
def test_manifest_query(spark, tmp_path, rows):
    found = registered(spark, tmp_path, rows, "op11_merkle_manifest").collect()
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    assert known(tuple(r[c] for c in columns) for r in found) == known(manifest(rows, 8))
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in found)


@pytest.mark.parametrize("fanout", [2, 3])
def test_proofs_lead_to_the_root_and_tampering_does_not(docs, fanout):
    built = merkle.build(docs, merkle.digest([F.col(c) for c in merkle.COLUMNS]), "lang", "doc_id", fanout=fanout)
    found = built.proofs().withColumn("folded", merkle.fold(F.col("digest"), F.col("proof"))).withColumn("other", merkle.fold(F.sha2("digest", 256), F.col("proof")))
    rows = found.collect()
    assert len(rows) == len(ROWS) and {r["root"] for r in rows} == {built.root}
    assert all(r["folded"] == built.root != r["other"] for r in rows)
    assert known(r["subroot"] for r in rows) == known(m[2] for m in manifest(ROWS, fanout))


def test_manifest_takes_named_columns_only(spark):
    rows = [(k, "a" if k % 2 else None, k, k, "x", 0, 0) for k in range(20)]
    docs = spark.createDataFrame(rows, "id long, key string, pos long, n long, digest string, _order long, `group` int")
    built = merkle.build(docs, merkle.digest([F.col("id"), F.col("digest")]), "key", "id")
    found = built.proofs().orderBy("key", "pos").collect()
    assert [r["id"] for r in found] == [*range(0, 20, 2), *range(1, 20, 2)]
    top = [grown([leaf((i, "x")) for i in range(s, 20, 2)], 8)[-1][0] for s in (0, 1)]
    assert built.root == grown(top, 8)[-1][0]


@pytest.mark.parametrize("chunk", [3, 4096])
def test_places_within_keys(spark, monkeypatch, chunk):
    monkeypatch.setattr(merkle, "CHUNK", chunk)
    rows = [("a", R.randint(0, 9)) for _ in range(300)] + [("b", 1)] * 40 + [("c", None)]
    found = merkle.ranked(spark.createDataFrame(rows, "key string, v int").repartition(7), ["v"]).collect()
    for _, group in groupby(sorted(found, key=lambda r: (r["key"], r["pos"])), key=lambda r: r["key"]):
        group = list(group)
        assert [r["pos"] for r in group] == list(range(len(group))) and {r["n"] for r in group} == {len(group)}
        assert [r["v"] for r in group] == sorted((r["v"] for r in group), key=lambda v: (v is not None, v))


# ------------------------------------------------------------------ token cache


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD_BPE)


def counts(tokenizer, rows):
    return known((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aAeÉ̱̈hH's<|>endoftxt \t\n\x0b\x1c\x85  Σσς1½漢") | st.characters(exclude_categories=["Cs"]), max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", "<|EndOfText|>", "don't", "I'LL", " ", "\n", "x"])).map("".join))
def test_words_are_encoded_as_whole_texts(text):
    vocabulary = Vocabulary(WORD_BPE, folds=True)
    whole = Tokenizer.from_file(WORD_BPE) if not hasattr(test_words_are_encoded_as_whole_texts, "t") else test_words_are_encoded_as_whole_texts.t
    test_words_are_encoded_as_whole_texts.t = whole
    assert tokencache.counter(vocabulary, vocabulary.version)(text.encode()) == len(whole.encode(text, add_special_tokens=False).ids)


def test_normalised_texts_count_alike(spark, tokenizer):
    texts = ["Same  text", "same\ttext ", "<|endoftext|>", "<|EndOfText|>", "H̱", "ẖ", "\x1c A  b", "É  E", "", None]
    vocabulary = Vocabulary(WORD_BPE, folds=True)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokencache.normalised(F.col("t"), vocabulary).alias("x")).collect()
    for r in rows:
        assert len(tokenizer.encode(r["x"], add_special_tokens=False).ids) == len(tokenizer.encode(r["t"] or "", add_special_tokens=False).ids)
    assert len({r["x"] for r in rows}) == len(texts) - 2  # two that differ in case and blanks, and null and empty
    plain = spark.createDataFrame([("A  b",), (None,)], "t string").select(tokencache.normalised(F.col("t"), Vocabulary("x.model")).alias("x"))
    assert {r["x"] for r in plain.collect()} == {"A  b", ""}


def test_token_query(spark, tmp_path, tokenizer):
    found = registered(spark, tmp_path, ROWS, "op12_digest_cache").collect()
    assert known(tuple(r)[:3] for r in found) == counts(tokenizer, ROWS)
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in found) and any(r["over_limit"] for r in found)


def test_cache_is_asked_first_and_grows_by_misses(docs, spark, tmp_path, tokenizer):
    vocabulary, path = Vocabulary(WORD_BPE, folds=True), str(tmp_path / "cache")
    held = lambda: spark.read.schema(tokencache.CACHED).parquet(path)
    some = docs.where("doc_id <= 105")
    tokencache.token_counts(some, path, vocabulary).collect()
    first = held().count()
    assert first == some.select(tokencache.normalised(F.col("text"), vocabulary)).distinct().count()
    # What is stored is believed: a changed count shows that it isn't encoded again.
    lies = held().withColumn("n_tokens", F.col("n_tokens") + 1000).collect()
    spark.createDataFrame(lies, tokencache.CACHED).write.mode("overwrite").partitionBy("tokenizer").parquet(str(tmp_path / "lies"))
    found = tokencache.token_counts(docs, str(tmp_path / "lies"), vocabulary).collect()
    texts = {tokencache_key(t) for i, t, *_ in ROWS if i is not None and i <= 105}
    truth = known((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1000 if tokencache_key(t) in texts else 0)) for i, t, *_ in ROWS)
    assert known(map(tuple, found)) == truth
    again = known(map(tuple, tokencache.token_counts(docs, path, vocabulary).collect()))
    grown_to = held().count()
    assert again == counts(tokenizer, ROWS) and grown_to == docs.select(tokencache.normalised(F.col("text"), vocabulary)).distinct().count() > first
    tokencache.token_counts(docs, path, vocabulary).collect()
    assert held().count() == grown_to
    # Another version finds nothing, and leaves what is there alone.
    assert known(map(tuple, tokencache.token_counts(docs, path, Vocabulary(WORD_BPE)).collect())) == counts(tokenizer, ROWS)
    assert held().select("tokenizer").distinct().count() == 2


def tokencache_key(t):
    t = t or ""
    if t.isascii() and "<|endoftext|>" not in t.lower():
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", t.lower()).strip(" ")
    return t


def test_other_vocabularies_and_names(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = spark.createDataFrame([("Some Text", "k", "r", 1), ("some text", "k", "r", 2), (None, "k", "r", None)], "text string, content string, meeting string, id long")
    found = tokencache.token_counts(rows, str(tmp_path / "c"), Vocabulary(path), id_col="id").collect()
    pieces = SentencePieceProcessor(model_file=path)
    assert known(map(tuple, found)) == known([(1, 9, len(pieces.encode("Some Text"))), (2, 9, len(pieces.encode("some text"))), (None, 0, 0)])


def test_differing_vocabulary_is_an_error():
    with pytest.raises(ValueError, match="differs"):
        tokencache.counter(Vocabulary(WORD_BPE, folds=True), "0" * 64)


def test_nothing_to_count(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert tokencache.token_counts(empty, str(tmp_path / "none"), Vocabulary(WORD_BPE, folds=True)).collect() == []


# ------------------------------------------------------------------ collocations


def mined(rows, longest=5, least=100, share=100, first=2000):
    n, f = Counter(), Counter()
    for _, t, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(t) or ""):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, tuple(words[k : k + m])) for k in range(len(words) - m + 1))
    f = {k: v for k, v in f.items() if v >= least}
    by_lang = defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) == 1:
            continue
        if any(la == lang and len(x) > len(w) and 100 * b >= share * a and any(x[k : k + len(w)] == w for k in range(len(x))) for (la, x), b in f.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        by_lang[lang].append((-score, -a, " ".join(w).encode(), a, l, r, n[lang]))
    for lang, found in by_lang.items():
        for rank, (score, _, words, a, l, r, total) in enumerate(sorted(found)[:first], 1):
            yield lang, rank, words.decode(), a, l, r, total, -score


@pytest.mark.parametrize("settings", [{}, {"least": 5}, {"least": 3, "share": 60, "first": 7, "longest": 4}, {"least": 2, "longest": 2}])
def test_collocations(docs, settings):
    found = collocations.collocations(docs, **settings).collect()
    truth = known(mined(ROWS, **settings))
    assert truth and known(map(tuple, found)) == truth


def test_collocations_of_small_portions_and_memory(docs, monkeypatch):
    monkeypatch.setattr(collocations, "PORTION", 50)
    found = collocations.collocations(docs, least=4, memory_mb=64).collect()
    assert known(map(tuple, found)) == known(mined(ROWS, least=4))


@pytest.mark.parametrize("rows", [[], ROWS[:3]])
def test_no_collocations(spark, rows):
    assert collocations.collocations(spark.createDataFrame(rows, SCHEMA), least=1).collect() == []


def test_scores_are_exact(spark):
    values = [tuple(R.randint(1, 10 ** R.randint(1, 15)) for _ in range(4)) for _ in range(300)]
    values = [(a, n, max(a, l), max(a, r)) for a, n, l, r in values]
    values += [(7, 10**15, 7, 7 * 10**14), (10**13, 10**15, 10**13, 10**13), (10**13 - 1, 10**15, 10**13, 10**13 + 1)]
    found = spark.createDataFrame(values, "a long, n long, l long, r long").select("*", collocations.score("a", "n", "l", "r").alias("s")).collect()
    assert all(x["s"] == 1000 * x["a"] * x["n"] // (x["l"] * x["r"]) for x in found)


def test_out_of_core_sums_are_whole():
    batches = [pa.RecordBatch.from_pylist([{"gram": f"a phrase of some length {(k * 7919 + b) % 90000}", "f": 2} for k in range(20000)], collocations.COUNTS) for b in range(20)]
    found = pa.Table.from_batches(collocations.summed(iter(batches), 1, 64))
    truth = Counter(g for b in batches for g in b.column("gram").to_pylist())
    assert dict(zip(found["gram"].to_pylist(), found["f"].to_pylist(), strict=True)) == {g: 2 * c for g, c in truth.items()}


# ------------------------------------------------------------------ SQL


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_collocations"])
def test_queries_equal_their_sql(spark, tmp_path, name):
    found = registered(spark, tmp_path, ROWS, name)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    truth = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in truth.description]
    assert sorted(columns) == sorted(found.columns)
    assert known(map(tuple, found.select(*columns).collect())) == known(truth.fetchall())
