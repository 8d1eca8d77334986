"""Trained scores on held-out rows, exact round trips, and the small contracts; with nulls, empty and repeated rows, empty tables."""

import pickle
import random
import sys
import tracemalloc
import types

import numpy as np

import pytest
from pyspark.sql import functions as F

from certflume.llm import language, pieces, quality, queries, toxicity, urls, warc
from certflume.llm.frames import shared_folder
from compare import differences

FOLDER = "/root/testdata/sf0.01"
MODEL = queries.PIECES


# ---- trained operators


def held_out(spark, name, label):
    scored = queries.QUERIES[name](spark, FOLDER).where("held_out")
    return scored.join(spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", F.col(label).alias("y")), "doc_id").collect()


def test_toxicity_held_out(spark):
    rows = held_out(spark, "op1_toxicity", "toxic")
    assert sum(r.predicted == r.y for r in rows) / len(rows) > 0.94
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_held_out(spark):
    rows = held_out(spark, "op2_quality", "quality")
    assert sum(r.predicted == r.y for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_language_held_out(spark):
    got = queries.QUERIES["op10_language"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98


EDGE = [(1, None, 9), (2, "", 9), (3, "?!", 9), (4, "word " * 50000, 9), (None, "a text", 9), (4, "word " * 50000, 9)]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_edge_rows(spark, module):
    docs = spark.createDataFrame(EDGE, "doc_id bigint, text string, SCORE int")
    labels = spark.createDataFrame([(2, 0, 1), (4, 1, 0), (3, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        rows = module.score(docs, module.train(docs, given)).collect()
        assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 4}) == 1
    assert module.score(docs.limit(0), module.train(docs.limit(0), labels)).count() == 0


@pytest.mark.parametrize("few, many", [(10, 10), (10, 20), (10, 11), (6, 9), (8, 100), (3, 4)])
def test_partners_of_a_text_differ(few, many):
    left, right = quality.pairs(np.arange(few), np.arange(many), 8)
    assert set(right.tolist()) == set(range(many))
    for a in range(few):
        own = right[left == a].tolist()
        assert len(own) >= 8 and len(set(own)) == min(len(own), many)


def test_label_model_finds_accuracies_and_discounts_copies():
    rng = np.random.default_rng(1)
    y = rng.random(20000) < 0.3
    say = lambda right: np.where(rng.random(len(y)) < right, y, ~y) * 2
    a, b, c = say(0.9), say(0.8), say(0.7)
    votes = np.stack([a, b, c, c, np.ones_like(a)], 1)
    model = toxicity.label_model(votes, np.ones(len(votes)))
    right = [np.exp(model.table[j, 2, 1]) for j in range(3)]
    assert np.allclose(right, [0.9, 0.8, 0.7], atol=0.07), right
    assert model.own[2] < 0.65 < model.own[0]
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.88


def test_language_model_sums_to_one_and_edge_rows(spark):
    rng = np.random.default_rng(0)
    rows = np.unique(rng.integers(97, 101, (60, 3)), axis=0).astype(np.uint32)
    model = language.kneser_ney(rows, rng.integers(1, 5, len(rows)))
    known = sorted(set(rows[:, 2].tolist()))
    for c in rows[:10, :2]:
        p = [np.exp(model.log_probability([np.array([c[0]]), np.array([c[1]]), np.array([w])])[0]) for w in [*known, 999]]
        assert abs(sum(p) - 1) < 1e-9
    docs = spark.createDataFrame([(i, "the cat and the dog" if i % 2 else "der Hund und die Katze", "en" if i % 2 else "de") for i in range(40)] + [(i, t, None) for i, t, _ in EDGE], "doc_id bigint, text string, lang string")
    trained = language.train(docs)
    got = {r.doc_id: r for r in language.predict(docs, trained).collect()}
    assert [got[i].lang_pred for i in (3, 2, 1)] == ["en", "de", "en"] or got[1].lang_pred == "und"
    assert language.predict(docs.limit(0), trained).count() == 0
    nothing = language.predict(docs, language.train(docs.limit(0))).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in nothing] == [("und", 0.0)]
    edge = spark.createDataFrame([(t,) for t in (None, "", "123 ?")], "text string")
    assert {(r.lang_pred, r.score) for r in language.predict(edge, trained).collect()} == {("und", 0.0)}


def test_language_counts_are_exact(spark):
    docs = spark.createDataFrame([("ab ab!", "x"), ("Ab", "x"), ("ab", "y")], "t string, lang string")
    got = {(r.lang, r.g): r.n for r in language.gram_counts(docs, "t", "lang", 2).collect()}
    assert got == {("x", " a"): 3, ("x", "ab"): 3, ("x", "b "): 3, ("y", " a"): 1, ("y", "ab"): 1, ("y", "b "): 1}


def test_language_blocks_keep_the_order(spark):
    """Many small blocks and many grams: the same cross-entropies as models of the full order in memory."""
    import pyarrow as pa

    rng = random.Random(4)
    alphabet = [chr(0x4E00 + i) for i in range(300)] + list("abcdefgh ")
    rows = [(i, "".join(rng.choice(alphabet[j::3]) for _ in range(200)), "xyz"[j]) for i in range(120) for j in (i % 3,)]
    docs = spark.createDataFrame([*rows, (500, None, "x"), (501, "?!", "w")], "doc_id bigint, text string, lang string")
    trained = language.train(docs, block_terms=3000)
    assert trained.order == language.ORDER and len(trained.blocks) > language.KEPT_BLOCKS
    counts = language.gram_counts(docs.where("crc32(cast(doc_id as string)) % 3 <> 1 AND text IS NOT NULL"), "text", "lang", language.ORDER).collect()
    texts = pa.array([t for _, t, _ in rows[:30]] + ["", None, "never 𠀀 seen"])
    h, letter = trained.entropies(texts)
    assert letter.tolist() == [True] * 30 + [False, False, True]
    flat, first = language.codes(texts, language.ORDER)
    for j, name in enumerate(trained.names):
        own = [(r.g, r.n) for r in counts if r.lang == name]
        chars = np.array([g for g, _ in own], f"<U{language.ORDER}").view(np.uint32).reshape(len(own), language.ORDER)
        plain = language.kneser_ney(chars, np.array([n for _, n in own]))
        for d in range(len(texts)):
            at = np.arange(first[d] + language.ORDER - 1, first[d + 1])
            logs = plain.log_probability([flat[at - language.ORDER + 1 + k] for k in range(language.ORDER)])
            assert abs(h[d, j] + logs.sum() / max(len(at), 1)) < 1e-9


def test_language_limits_of_rare_languages(spark):
    """One language in 60,000 rows, another in few: both get limits from their own texts, and foreign letters are not accepted."""
    hot = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("the cat").alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([(100_000 + i, f"der Hund und die Katze {'so' * (i % 4)}", "de") for i in range(9)] + [(200_000 + i, "?!", "xx") for i in range(5)], "doc_id bigint, text string, lang string")
    trained = language.train(hot.unionByName(rare))
    limit = dict(zip(trained.names, trained.limit, strict=True))
    assert np.isfinite(limit["de"]) and np.isfinite(limit["en"]) and limit["xx"] == -np.inf
    asked = spark.createDataFrame([("der Hund und die Katze",), ("der qqqqqqqq wwwwwwww vvvvvvvvvv",)], "text string")
    known, foreign = language.predict(asked, trained).collect()
    assert (known.lang_pred, known.accepted) == ("de", True) and not foreign.accepted


# ---- SentencePiece


@pytest.fixture(scope="module")
def models():
    import sentencepiece

    return pieces.Model.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


SNIPPETS = ["a", "b", " ", "  ", "the", "漢", "字", "\n", "é", "😀", "▁", "\t", "x1", " of", "....", "ing", "<0x0A>", "\0", "lo", "ll"]


def test_encoding_equals_the_library(models):
    model, library = models
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice(SNIPPETS) for _ in range(rng.randint(0, 60)))
        ids = library.encode(text)
        assert model.encode(model.escaped(text)) == ids
        assert model.decode(ids) == library.decode(ids)


def scanned(model, text, chunk):
    t, m = model.escaped(text), model.longest
    bounds = [0, *range(chunk, len(t), chunk), len(t)]
    if bounds[-1] - bounds[-2] < 4 * m:
        bounds.pop(-2)
    parts = [(t[max(0, lo - 2 * m):hi + 2 * m], min(lo, 2 * m), min(lo, 2 * m) + hi - lo) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    states = pieces.boundary_states([model.transfer(*p) for p in parts], (0, ""), None)
    return [i for p, e, n in zip(parts, states, states[1:], strict=False) for i in model.trace(*p, e, n)]


def test_learning_units_takes_little_memory():
    """A few new units beside many remembered ones do not copy all ids several times."""
    model = pieces.Model.load(queries.PIECES)
    rng = random.Random(1)
    for _ in range(20):
        model.encode(model.escaped(" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(1500))))
    held = len(model._remembered[0])
    tracemalloc.start()
    try:
        model.encode(model.escaped("zyxw"))
        model.encode(model.escaped("zyxwv"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert held > 20_000 and peak < 150 * held


def test_a_model_replaces_what_earlier_steps_left(monkeypatch):
    model = pieces.Model([("a", 0.0, 1)], True, False)
    sent = types.SimpleNamespace(value=pickle.dumps((model.listed, model.bpe, model.dummy_prefix)))
    monkeypatch.setitem(sys.__dict__, "_certflume_shipped", {1: "a lexicon"})
    monkeypatch.setitem(sys.__dict__, "_certflume_pieces", {})
    assert pieces._received(sent).listed == model.listed and not sys._certflume_shipped


def test_chunks_give_the_same_path(models):
    model, library = models
    rng = random.Random(2)
    for letters in (SNIPPETS, ["漢", "字", "的", "是"], ["a", "b", "the", "ing", "lo", "ll", "er", "st"]):
        for _ in range(25):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(200, 500)))
            assert scanned(model, text, 70) == library.encode(text)


def test_unigram_models_take_the_best_sum():
    import itertools

    listed = [("<unk>", 0.0, 2), *[(p, s, 1) for p, s in [("a", -2.0), ("b", -2.5), ("ab", -3.0), ("ba", -2.1), ("aba", -5.5), ("bb", -6.0), (pieces.SPACE, -1.0)]]]
    model = pieces.Model(listed, bpe=False, dummy_prefix=False)
    scores = {p: s for p, s, _ in listed[1:]}
    for n in range(1, 8):
        for letters in itertools.product("ab", repeat=n):
            text = "".join(letters)
            best = {0: 0.0}
            for e in range(1, n + 1):
                best[e] = max(best[b] + scores.get(text[b:e], -99) for b in range(e))
            assert abs(sum(listed[i][1] for i in model.encode(text)) - best[n]) < 1e-9


def test_encode_and_decode_frames(spark, models):
    model, library = models
    rng = random.Random(3)
    rows = [(1, None, 3), (2, "", 4), (3, "x", 5), (3, "x", 5), (None, "漢字" * 3000, 1), (7, "a" * 9000, 1), (8, "".join(rng.choice(["the ", "ing", "lo", "\n", "漢", "er st"]) for _ in range(8000)), 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, IDS int")
    got = pieces.decode(pieces.encode(df, model, chunk=300), model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == (None if r.text is None else library.encode(r.text))
        assert r.decoded == r.text
    assert pieces.encode(df.limit(0), model).count() == 0


def test_sentencepiece_query_round_trip(spark):
    assert queries.QUERIES["op5_sentencepiece"](spark, "/root/testdata/sf0.001").where("NOT round_trip OR n_tokens IS NULL").count() == 0


# ---- urls and archives


def test_url_verdicts(spark):
    rows = [("http://A.Example.ORG/es/1", "block"), ("https://org/x", "allow"), ("http://org", "allow"), ("http://x.com/fr/porn", "allow"), ("http://x.net/a-porn-b", "block"), ("http://x.net/sporn", "allow"),
            ("http://x.net/sex/adult", "block"), ("http://x.net/sex/sex", "allow"), ("http://x.net/free-cheap-win", "block"), ("PORN", "block"), (None, "allow"), ("", "allow"), ("http://x.net/" + "a" * 50000, "allow")]
    df = spark.createDataFrame([(i, u, "h") for i, (u, _) in enumerate(rows)], "page_id bigint, url string, Host string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert [got[i].verdict for i in range(len(rows))] == [v for _, v in rows]
    assert (got[0].host, got[0].path, got[0].rule) == ("a.example.org", "/es/1", "example.org/es/")
    assert (got[10].host, got[10].path, got[10].rule) == ("", "", None)
    assert urls.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op4_top_k", "op8_url_filter", "op9_warc"])
def test_queries_equal_their_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, FOLDER), FOLDER, queries.ORACLES[name]) is None


def test_archives_round_trip(spark):
    long, text = "é\r\n\r\nWARC/1.1\r\n" * 9000, "same " * 300
    rows = [(1, "http://a/", text), (2, None, text), (2, None, text), (3, "http://b/", long), (None, "u v\r\nX: y", text), (5, "http://c/", None), (6, "", "short"), (7, "", "short")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = shared_folder(spark, "test")
    warc.write(df, folder)
    found = warc.payloads(warc.read(spark, folder)).withColumn("page", warc.page_of(F.col("record_id"))).withColumn("to", warc.page_of(F.col("refers"))).collect()
    assert all(r.error is None for r in found)
    got = sorted(((r.page, r.record_type, r.payload_bytes, r.to) for r in found), key=repr)
    size = len(text)
    assert got == sorted([(1, "revisit", size, 2), (2, "response", size, None), (2, "response", size, None), (3, "response", len(long.encode()), None), (None, "revisit", size, 2),
                          (5, "response", 0, None), (6, "response", 5, None), (7, "response", 5, None)], key=repr)
    assert next(bytes(r.payload) for r in found if r.page == 3) == long.encode()
    empty = shared_folder(spark, "test")
    warc.write(df.limit(0), empty)
    assert warc.payloads(warc.read(spark, empty)).count() == 0


def test_broken_segments_are_told(spark):
    row = lambda number, total, block: ("o", "response", "u", None, None, "o", number, total, block)
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    body = head + warc.chunked(b"payload")
    cases = {"fine": [row(2, len(body), body[40:]), row(1, None, body[:40])], "gap": [row(1, None, body[:40]), row(3, len(body), body[40:])],
             "length": [row(1, None, body[:40]), row(2, len(body) + 1, body[40:])], "open": [row(1, None, body[:40])], "twice": [row(1, None, body[:40]), row(1, None, body[:40]), row(2, len(body), body[40:])]}
    rows = [(k, *r[1:5], k, *r[6:]) for k, rs in cases.items() for r in rs]
    got = {r.record_id: r for r in warc.payloads(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert bytes(got["fine"].payload) == b"payload" and got["fine"].error is None
    assert all(got[k].error and got[k].payload is None for k in ("gap", "length", "open", "twice"))
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab\r\n0\r\n\r\n")


def test_url_verdicts_without_a_vocabulary(spark):
    df = spark.createDataFrame([(1, "http://casino.net/"), (2, None)], "page_id bigint, url string")
    assert {r.page_id: (r.verdict, r.weight) for r in urls.judge(df, vocabulary={}).collect()} == {1: ("allow", 0), 2: ("allow", 0)}
