"""Decontamination, substring and near-duplicates, top-k: against brute force, with nulls, empty and repeated rows."""

import random

import brute
import pytest

from certflume.llm import decontaminate, near, queries, substrings, topk

FOLDER = "/root/testdata/sf0.001"


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def table(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{name}.parquet").select(*columns).collect()]


def test_decontaminate_against_brute_force(spark):
    rng = random.Random(1)
    words = ["alpha", "Beta", "é", "x1", "of"]
    bench = [(1, " ".join(rng.choices(words, k=30))), (2, "of"), (3, None), (4, "..."), (None, "alpha alpha"), (10, "Beta,x1"), (10, "Beta,x1")]
    docs = [(i, "; ".join(rng.choices(words + ["other"], k=rng.randint(0, 60)))) for i in range(30)]
    docs += [(50, bench[0][1].upper() + " tail"), (51, None), (52, ""), (53, "other " * 5000 + bench[0][1])]
    for block in (decontaminate.BLOCK_BYTES, 40):
        marked = decontaminate.judged(texts(spark, docs), spark.createDataFrame(bench, "item_id bigint, text string"), keep=["doc_id"], block_bytes=block)
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in marked.collect()}
        assert got == brute.decontaminated(docs, bench)


def test_decontaminate_spans_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d", "kept", 5)], "doc_id bigint, text string, extra string, N_WORDS int")
    bench = spark.createDataFrame([(7, "b c")], "item_id bigint, text string")
    row = decontaminate.mark(docs, bench).first()
    assert (row.extra, row.n_words, [tuple(s) for s in row.spans], row["items"]) == ("kept", 4, [(1, 3)], ["7"])
    assert decontaminate.judged(docs.limit(0), bench).count() == 0
    assert decontaminate.judged(docs, bench.limit(0)).first().contaminated is False


def test_decontaminate_query(spark):
    import hashlib

    expected = brute.decontaminated(table(spark, "documents", "doc_id", "text"), table(spark, "benchmark", "item_id", "text"))
    got = {r.doc_id: r for r in queries.QUERIES["op3_decontaminate"](spark, FOLDER).collect()}
    assert {i: (r.n_words, r.n_hit, r.n_items, r.contaminated) for i, r in got.items()} == {i: (a, b, len(c), d) for i, (a, b, c, d) in expected.items()}
    assert all(r.items_sha256 == hashlib.sha256(",".join(expected[i][2]).encode()).hexdigest() for i, r in got.items())


def test_substrings_against_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefgh") for _ in range(200)] for _ in range(6)]
    rows = []
    for i in range(60):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, 10)):
            b[rng.randrange(200)] = rng.choice("xyz")
        at = rng.randrange(150)
        rows.append((rng.choice([i, i, i, None]), " \n".join(b[at:at + rng.randint(0, 120)])))
    rows += [(5, None), (7, ""), (1, "a b"), rows[0], rows[0], (90, "same word " * 20000)]
    got = sorted((tuple(r) for r in substrings.digests(texts(spark, rows)).collect()), key=repr)
    assert got == brute.substrings(rows)


def test_substrings_hot_minimizers_are_spread(spark):
    """Thousands of documents share five words among their own: no shard gets them all, and the results stay right."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    rng = random.Random(5)
    phrases = [f"all rights {i} reserved {i}" for i in range(3000)]
    w = substrings.words(pa.array(phrases), substrings.SPACED, False)
    hot = phrases[int(np.argmin(substrings.window_hashes(w.hashes(), 5)[::5]))]
    rows = [(i, " ".join([*(f"a{rng.randrange(10**6)}" for _ in range(12)), hot, *(f"b{rng.randrange(10**6)}" for _ in range(12))])) for i in range(3000)]
    # Some windows around the hot words are equal, with several first holders.
    for i in range(0, 3000, 7):
        own, other = rows[i][1].split(), rows[rng.randrange(3000)][1].split()
        cut = rng.randrange(8, 13)
        rows[i] = (rng.choice([i, i, None]), " ".join([*own[:cut], *other[cut:cut + rng.randrange(6, 14)], *own[20:]]))
    # The sets of words count, not the order of rows.
    docs = texts(spark, rows).repartition(8)
    assert sorted((tuple(r) for r in substrings.digests(docs).collect()), key=repr) == brute.substrings(rows)
    p = F.pmod(F.xxhash64("doc_id", "text"), F.lit(8)).cast("int")
    given = docs.select(p.alias("p"), F.coalesce("doc_id", F.lit(substrings.LAST)).alias("id"), F.col("text").alias("t"))
    sent = substrings._routed(given, given.repartition(8, "p"), 8, 13, 5, None).select("b", (F.octet_length("texts") + F.octet_length("windows")).alias("n"))
    sizes = [r.n for r in sent.groupBy("b").agg(F.sum("n").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8, sizes


@pytest.mark.parametrize("hot", [0, 4])
def test_substrings_window_by_window(spark, hot):
    rng = random.Random(6)
    base = [[rng.choice("abcdefgh") for _ in range(200)] for _ in range(4)]
    rows = [(rng.choice([i, i, None]), " ".join(rng.choice(base)[rng.randrange(100):][:rng.randint(0, 120)])) for i in range(50)]
    rows += [(5, None), rows[0], (90, "same word " * 2000), (91, " ".join(f"u{i}" for i in range(100)))]
    assert sorted((tuple(r) for r in substrings.digests(texts(spark, rows), hot=hot).collect()), key=repr) == brute.substrings(rows)


def test_substrings_keep_columns_and_cut_text(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"one {passage} end", 3), (2, f"two\t{passage}\nlast", 4), (3, None, 5), (3, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, p int")
    got = sorted((tuple(r) for r in substrings.strip(docs).collect()), key=repr)
    assert got == [(1, f"one {passage} end", 3, 0), (2, "two\tlast", 4, 20), (3, None, 5, 0), (3, None, 5, 0)]
    assert substrings.strip(docs.limit(0)).count() == 0


def test_substring_query(spark):
    got = sorted((tuple(r) for r in queries.QUERIES["op6_substring_dedup"](spark, FOLDER).collect()), key=repr)
    assert got == brute.substrings(table(spark, "documents", "doc_id", "text"))


def test_suffix_automaton_knows_first_holders():
    rng = random.Random(5)
    for _ in range(50):
        lists = [([rng.randrange(3) for _ in range(rng.randint(1, 14))], rng.randrange(20)) for _ in range(6)]
        automaton = substrings.SuffixAutomaton()
        for s, i in lists:
            automaton.add(s, i)
        automaton.finish()
        query = [rng.randrange(3) for _ in range(25)]
        expected = [min((i for s, i in lists if any(s[a:a + 4] == query[k:k + 4] for a in range(len(s) - 3))), default=substrings.LAST) for k in range(22)]
        assert automaton.first_holders(query, 4) == expected


#: Two words of 1,024 letters whose polynomial hashes modulo 2 ** 64 are equal for every base.
MORSE = tuple("".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(1024)) for flip in (0, 1))


def test_unlike_words_with_equal_polynomial_hashes(spark):
    x, y = MORSE
    assert x != y
    docs = [(1, " ".join(f"{x} w{i}" for i in range(20))), (2, " ".join(f"{y} w{i}" for i in range(20))), (3, x), (4, y), (5, f"{x} {y} " * 20), (6, f"{y} {x} " * 20)]
    assert sorted((tuple(r) for r in substrings.digests(texts(spark, docs)).collect()), key=repr) == brute.substrings(docs)
    assert sorted((tuple(r) for r in substrings.digests(texts(spark, docs), hot=0).collect()), key=repr) == brute.substrings(docs)
    assert sorted(tuple(r) for r in near.clusters(texts(spark, docs), shingle=4).collect()) == brute.near(docs)
    bench = [(1, x), (2, f"{y} w3 {y}")]
    marked = decontaminate.judged(texts(spark, docs), spark.createDataFrame(bench, "item_id bigint, text string"), keep=["doc_id"])
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in marked.collect()} == brute.decontaminated(docs, bench)


def test_near_unlike_texts_of_one_id(spark):
    rows = [(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "P Q R S T U V"), (3, "a b c d e f g"), (3, "other words of its own here"), (None, "a b c d e f g")]
    got = sorted((tuple(r) for r in near.clusters(texts(spark, rows)).collect()), key=repr)
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 2, 3, True), (3, 3, 1, False), (None, 3, None, True)]


def near_rows():
    rng = random.Random(4)
    base = [[f"w{rng.randrange(999)}" for _ in range(150)] for _ in range(6)]
    rows = []
    for i in range(200):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 4, 8, 12])):
            b[rng.randrange(150)] = f"v{rng.randrange(9999)}"
        rows.append((i, " ".join(b)))
    return rows + [(400, None), (401, ""), (402, " \n"), (403, "a b"), (404, "A  b"), (405, "a b c"), (406, "x " * 20000), (407, "x " * 30000)]


def test_near_against_brute_force(spark, monkeypatch):
    # Small blocks, so that buckets are cut and centres dealt out.
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "MEMBERS", 4)
    rows = near_rows()
    assert sorted(tuple(r) for r in near.clusters(texts(spark, rows), shingle=4).collect()) == brute.near(rows)


def test_near_null_ids_repeats_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F")]
    got = sorted((tuple(r) for r in near.clusters(texts(spark, rows)).collect()), key=repr)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)]
    assert near.clusters(texts(spark, rows).limit(0)).count() == 0


def test_near_query(spark):
    assert sorted(tuple(r) for r in queries.QUERIES["op7_near_dedup"](spark, FOLDER).collect()) == brute.near(table(spark, "documents", "doc_id", "text"))


def test_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert {tuple(r) for r in near.components(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


@pytest.mark.parametrize("block", [2, 4096])
def test_top_against_brute_force(spark, block):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(160)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(200, 230)] + [(100, [9.0, 9.0, 9.0, 9.0]), (300, None), (350, [1.0, None, 2.0, 1.0]), (400, [1.0, float("nan"), 1.0, 1.0]), (None, [1.0] * 4),
                                                                     (450, [float("inf")] * 4), (50, rows[50][1]), (50, rows[50][1]), (100, [0.0, 0.0, 0.25, 1.0]), (7, [1.0] * 4), *[(8, [0.5, 1.0, 1.0, 1.0])] * 9]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    from pyspark.sql import functions as F

    got = sorted(tuple(r) for r in topk.top(df, F.col("vec_id") % 50 == 0, 5, block=block).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute.top(rows)


def test_top_few_candidates_huge_components_and_empty_table(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1e9, 3e9]), (1, [2e3, -1e3]), (2, [1.0, 2.0]), (3, [1.9e16, 0.0]), (4, [0.0, -1e300]), (50, [0.0, 0.5]), (100, [1e-3, 3e17])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    ask = F.col("vec_id") % 50 == 0
    assert sorted(tuple(r) for r in topk.top(df, ask).select("query_id", "rank", "vec_id", "score").collect()) == brute.top(rows)
    assert topk.top(df.limit(0), ask).count() == 0
    assert topk.top(df.where("vec_id = 0"), ask).count() == 0
