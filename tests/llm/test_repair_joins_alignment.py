"""Conversation repair, n-gram join and cross-tokenizer alignment: against brute force and SQL, with nulls, ties, repeats and hot keys."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from certflume.llm import alignment, grams, queries, repair
from compare import differences

FOLDER = "/root/testdata/sf0.001"


# ---- repair


def plain_repair(rows):
    """(role, text, turn) in order: the contract, by recursion."""
    seen, judged = set(), []
    counts = collections.Counter()
    for role, text, _ in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        judged.append(fault)
    roles = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(i, q, inserts=0):
        found = []
        if i == len(rows) and q in ("", "a"):
            found.append((0, "", ()))
        if inserts < 3:
            c, e, told = best(i, roles[q], inserts + 1)
            found.append((c + 3, "I" + e, (f"{names[roles[q]]}:",) + told))
        if i < len(rows):
            role, text, _ = rows[i]
            c, e, told = best(i + 1, q)
            found.append((c + 4, "D" + e, told))
            if judged[i] not in ("blank", "duplicate"):
                add = 3 if judged[i] == "truncated" else 0
                x = role[:1]
                if x and (x == roles[q] or (x == "s" and q == "")):
                    c, e, told = best(i + 1, x)
                    found.append((c + add, "K" + e, (f"{role}:{text}",) + told))
                c, e, told = best(i + 1, roles[q])
                found.append((c + add + 3, "R" + e, (f"{names[roles[q]]}:{text}",) + told))
        return min(found) if found else (10**9, "", ())

    cost, audit, told = best(0, "")
    turns = [t for _, _, t in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest()


def random_rows(rng, conversations):
    out = []
    for c in conversations:
        for _ in range(rng.randint(1, 9)):
            out.append((c, rng.choice([None, *range(8)]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", "ünder"]),
                        rng.choice(["Hi.", "Hi.", "ok", " ", " \n", "", "What? \t", "Yes! é", "née"]), rng.choice([1, 1, 1, 2, 0])))
    return out


@pytest.mark.parametrize("options", [{}, {"limit": 3, "range_bytes": 8}])
def test_repair_against_brute_force(spark, options):
    rows = random_rows(random.Random(11), [*range(50), None])
    # One conversation of very many rows, most of them equal.
    if options:
        rows += [(1000, random.Random(i).choice([None, i % 40]), ("user", "assistant")[i % 2], ("Sure.", "Sure.", f"text {i % 60}.", f"open {i}")[i % 4], 1) for i in range(300)]
    given = spark.createDataFrame(rows, "conv bigint, turn bigint, role string, text string, copies bigint").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(given, rows=given, **options).collect()}
    expected = {}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, role, text) for k, t, role, text, n in rows if k == c for _ in range(n)))
        if c == 1000:
            continue
        expected[c] = plain_repair([(role, text, t if has else None) for has, t, role, text in own])
    assert {c: r for c, r in got.items() if c != 1000} == expected
    if options:
        # The long one by the plain path, in one task.
        whole = repair.repair(given, rows=given.where("conv = 1000")).first()
        assert got[1000] == tuple(whole)[1:] and len(whole.audit) >= 300


def test_repair_long_conversations_use_their_checkpoints():
    import numpy as np

    rng = np.random.default_rng(2)
    n = 500
    must = rng.random(n) < 0.1
    rows = repair.Rows(rng.integers(0, 4, n), must, ((rng.random(n) < 0.2) & ~must).astype(np.int64), np.where(rng.random(n) < 0.1, 3, 0))
    programme = repair.Programme(rows, np.array([0, n]), repair.FINAL[None])
    assert len(programme.marks) <= programme.every <= 24
    _, letter, row, role, state = programme.walk(np.array([repair.NOTHING]), True)
    edits = letter.tobytes().decode()
    cost = 4 * edits.count("D") + 3 * (edits.count("I") + edits.count("R")) + 3 * sum(int(rows.cut[i]) for x, i in zip(edits, row, strict=True) if x in "KR")
    assert cost == programme.start[0, repair.NOTHING] and state[0] == repair.ASSISTANT
    assert re.fullmatch("(1?(23)+)?", "".join(str(r) for x, r in zip(edits, role, strict=True) if x != "D"))


def test_repair_query_equals_its_sql(spark, tmp_path):
    assert differences(queries.QUERIES["op11_repair"](spark, FOLDER), FOLDER, repair.ORACLE) is None
    # Nulls in all columns, ties, repeated rows, odd roles; then no rows at all.
    rng = random.Random(12)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, -3, 0, 1, 2, 900]), rng.choice([None, "user", "assistant", "system", "sudo"]), rng.choice([None, "", "a.", "b", "c? "])) for _ in range(150)]
    for n, part in enumerate((rows, rows[:0])):
        folder = f"{tmp_path}/{n}"
        spark.createDataFrame(part, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{folder}/conversations.parquet")
        db = duckdb.connect()
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
        df = queries.QUERIES["op11_repair"](spark, folder)
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, db.execute(repair.ORACLE).fetchall()))


def test_damage(spark):
    rows = [(c, t, "assistant", "a. b") for c in range(20) for t in range(10)]
    got = {(r.conv, r.turn): (r.role, r.text, r.copies) for r in repair.damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    kinds = {0: ("", "", 0), 1: ("assistant", "", 1), 2: ("assistant", "a b", 1), 3: ("assistant", "a. b", 2), 4: ("user", "a. b", 1)}
    assert got == {(c, t): kinds.get(zlib.crc32(f"{c}:{t}".encode()) % 20, ("assistant", "a. b", 1)) for c, t, _, _ in rows}


# ---- n-gram join


def gram_rows():
    rng = random.Random(14)
    base = [[f"w{rng.randrange(999)}" for _ in range(120)] for _ in range(5)]
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(160):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6])):
            b[rng.randrange(120)] = f"v{rng.randrange(9999)}"
        rows.append((i, " ".join(b)))
    # A frequent passage with a few words of each document's own.
    rows += [(200 + i, " ".join([*common, *(f"o{rng.randrange(10**6)}" for _ in range(rng.randint(0, 16)))])) for i in range(60)]
    return rows + [(400, None), (401, ""), (402, " \n"), (403, "a b"), (404, "A  b"), (405, "a b c"), (406, "x " * 20000), (407, "x " * 30000), (0, rows[0][1])]


@pytest.mark.parametrize("options", [{}, {"short": 4, "block": 5, "size": 16}, {"size": 0}])
def test_grams_against_brute_force(spark, options):
    rows = gram_rows()
    got = sorted({tuple(r) for r in grams.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), **options).collect()})
    assert got == [r[:3] for r in brute.near(rows, k=5)]


def test_grams_find_what_single_partners_miss(spark, monkeypatch):
    """Without the passes of single partners, all links come from comparing lists across components."""
    first = grams.first_pass

    def lists_only(percent):
        run = first(percent)
        return lambda table: (lambda found: found.filter(grams.pa.array(found.column("pos").to_numpy() >= 0)))(run(table))

    monkeypatch.setattr(grams, "first_pass", lists_only)
    rows = gram_rows()
    got = sorted({tuple(r) for r in grams.join(spark.createDataFrame(rows, "doc_id bigint, text string"), short=8, block=8).collect()})
    assert got == [r[:3] for r in brute.near(rows, k=5)]


def test_grams_pairs_grow_with_documents(spark, monkeypatch):
    """A group whose first document is like few of it is joined by its likeliest pairs, not by all."""
    rng = random.Random(5)
    rows = []
    for i in range(240):
        copy = [f"w{n}" for n in range(120)]
        at = rng.randrange(5, 110)
        for n in [20, 60, 100] if i == 0 else [at, at + 2] if i % 3 else [at]:
            copy[n] = f"v{i}_{n}"
        rows.append((i, " ".join(copy)))
    looked = []
    confirmed = grams.confirmed

    def counted(pairs, *more):
        looked.append(pairs.count())
        return confirmed(pairs, *more)

    monkeypatch.setattr(grams, "confirmed", counted)
    got = sorted({tuple(r) for r in grams.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()})
    assert got == [r[:3] for r in brute.near(rows, k=5)]
    assert sum(looked) < 4 * len(rows), looked


def test_grams_classes_of_one_prefix(spark):
    """Sets of equal size and prefix are linked also where the first of them is linked with none."""
    passage = [f"p{i}" for i in range(30)]
    x, y = ([f"{c}{i}" for i in range(70)] for c in "xy")
    near = [*y[:-3], "a", "b", "c"]
    rows = [(i, " ".join(passage + rest)) for i, rest in enumerate((x, y, near))]
    # What follows the passage is frequent, so it stands last.
    rows += [(10 + i, " ".join([f"q{i}_{n}" for n in range(40)] + passage[-4:] + (x, y, near)[i % 3])) for i in range(36)]
    got = sorted(tuple(r) for r in grams.join(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect())
    assert got == [r[:3] for r in brute.near(rows, k=5)]
    assert got[2] == (2, 96, 1)


def test_gram_sketches_and_forests():
    rng = np.random.default_rng(6)
    value = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.sort(rng.choice(value, n, replace=False)) for n in (0, 1, 50, 300, 390)]
    found = grams.sketches(np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])])
    marks = [np.frombuffer(s, np.uint8) for s in found]
    for a, b in itertools.combinations(range(len(sets)), 2):
        bits = int(np.bitwise_count(marks[a] ^ marks[b]).sum())
        assert bits <= len(np.setxor1d(sets[a], sets[b])) and bits > 0
    for nodes, edges in ((2, 5), (30, 20), (30, 200)):
        a, b = rng.integers(0, nodes, (2, edges))
        a, b = a[a != b], b[a != b]
        rank = rng.permutation(len(a))
        parent, taken = list(range(nodes)), []
        for i in np.argsort(rank).tolist():
            if parent[a[i]] != parent[b[i]]:
                old, new = parent[a[i]], parent[b[i]]
                parent = [new if p == old else p for p in parent]
                taken.append(i)
        assert grams.forest(rank, a, b).tolist() == sorted(taken)
    assert not len(grams.forest(*[np.zeros(0, np.int64)] * 3))


def test_gram_stars():
    rng = np.random.default_rng(8)
    for nodes, edges in ((2, 1), (40, 30), (40, 200), (400, 399)):
        a, b = rng.integers(0, nodes, (2, edges)) * 7 - 50
        if nodes == 400:  # a path
            a, b = np.arange(399), np.arange(1, 400)
        least = {x: x for x in np.r_[a, b].tolist()}
        for _ in range(nodes):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                least[x] = least[y] = min(least[x], least[y])
        x, y = grams.starred(a, b)
        assert dict(zip(y.tolist(), x.tolist(), strict=True)) == {k: v for k, v in least.items() if v < k} and len(y) == len(set(y.tolist()))
    assert not len(grams.starred(*[np.zeros(0, np.int64)] * 2)[0])


def test_grams_tasks_follow_rows_not_partitions(spark):
    """Of few rows in many partitions the driver has not a task for each partition at every step."""
    rows = [(i, " ".join(f"w{n}" for n in range(i, i + 60))) for i in range(40)] + [(100 + i, f"u{i} " * 9) for i in range(20)]
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    changed = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    sc.setJobGroup("gram-tasks", "gram-tasks")
    try:
        got = sorted(tuple(r) for r in grams.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == [r[:3] for r in brute.near(rows, k=5)]
    stages = {s for j in tracker.getJobIdsForGroup("gram-tasks") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)) is not None)
    # 163 times the partitions when every step read and wrote all of them.
    assert tasks < 125 * 64, tasks


def test_grams_edges(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, "a b c d e f"), (3, "q r s t u v")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id bigint, text string, n bigint, `gram` string")
    got = sorted((tuple(r) for r in grams.join(docs).collect()), key=repr)
    # The other text of id 3 is linked with nothing.
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (3, 2, 3), (None, 2, None)]
    assert grams.join(docs.limit(0)).count() == 0


def test_gram_query_equals_its_sql(spark):
    assert differences(queries.QUERIES["op12_gram_join"](spark, FOLDER), FOLDER, grams.ORACLE) is None


# ---- alignment


@pytest.fixture(scope="module")
def vocabularies():
    return alignment.Vocabularies.load(queries.BYTES, queries.PIECES)


def plain_alignment(texts):
    """The contract for a list of texts, by the public libraries and loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    letters = alignment.byte_letters()
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        encoded = a.encode(" " + t, add_special_tokens=False)
        left = [(i, bytes(letters[c] for c in s)) for i, s in zip(encoded.ids, encoded.tokens, strict=True)]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
        given = (" " + t).encode()
        if b"".join(x for _, x in left) != given or b"".join(x for _, x in right) != given:
            docs.append(None)
            continue
        ends = []
        for side in (left, right):
            at, own = 0, []
            for i, x in side:
                at += len(x)
                own.append((at, i))
            ends.append(own)
        common = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        groups, begin = [], 0
        for c in common:
            groups.append([[i for e, i in side if begin < e <= c] for side in ends])
            begin = c
        docs.append((len(left), len(right), groups))
    held = collections.Counter()
    for d in docs:
        if d:
            held.update({(x, y) for p, q in d[2] for x in p for y in q})
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for p, q in d[2] for x in p for y in q]
        told = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in d[2])
        out.append((d[0], d[1], len(d[2]), len(links), sum(held[k] == most[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(told.encode()).hexdigest()))
    return out


ODD = [None, "", " ", "  two  spaces ", "tab\tand\nline", "▁ under", "é è 你好 世界 �", "<|endoftext|> and </s> <unk> <0x41>", "it's we'll o'clock", "a" * 3000, "nul \x00 z", "ends ",
       "1 2  3", "😀 😀😀", "0" * 700 + " 7", "'s 's", "a b", "a b", "x" + " y" * 500]


@pytest.mark.parametrize("block", [50, 2_000_000])
def test_alignment_against_brute_force(spark, vocabularies, block, monkeypatch):
    # Large groups, small steps and a small memory are used, too.
    monkeypatch.setattr(alignment, "LARGE_GROUP", 4)
    monkeypatch.setattr(alignment, "STEP_PAIRS", 64)
    monkeypatch.setattr(alignment, "UNITS", 40)
    rng = random.Random(15)
    texts = ODD + ["".join(rng.choice(["a", "the", " ", " ", "é", "1", "\n", "'ll", "-", "你"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    expected = plain_alignment(texts)
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id bigint, text string, N_A int")
    rows = alignment.measure(docs, vocabularies, block_pairs=block).collect()
    assert rows[0].__fields__ == ["doc_id", "text", *alignment.RESULTS]
    assert {r.doc_id: tuple(r)[2:] for r in rows} == dict(enumerate(expected))
    assert alignment.measure(docs.limit(0), vocabularies).count() == 0


def test_alignment_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    expected = plain_alignment([t for _, t in rows])
    assert {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op13_alignment"](spark, FOLDER).collect()} == {i: e for (i, _), e in zip(rows, expected, strict=True)}


def test_both_readers_of_the_byte_vocabulary_agree(spark, vocabularies):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.BYTES)
    plain.encode_special_tokens = True
    rng = random.Random(16)
    texts = [t for t in ODD if t] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), rng.randrange(9, 14), 32, 39, 0x1F600])) for _ in range(200)) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect() if r.text]
    assert vocabularies.a([" " + t for t in texts]) == [e.ids for e in plain.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_pair_counts(spark, vocabularies):
    docs = spark.createDataFrame([(1, "a cat"), (2, "a cat"), (3, "a cat a cat"), (4, None)], "doc_id bigint, text string")
    got = {(r.a, r.b): (r.n, r.best) for r in alignment.pair_counts(docs, vocabularies).collect()}
    a, _, b, _ = vocabularies.encode(["a cat"])
    assert got == {(x, y): (3, True) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
