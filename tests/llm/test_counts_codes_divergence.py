"""Token counts against the tokenizer's library, part codes and source divergence against brute force and SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import differences
from tradewinds.llm import divergence, part_codes, queries, token_counts

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "n_bytes n_tokens over_limit tf df term part item value rank v code error label_error p q p0 n _label _n r0".split()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_counts.tokenizer_path())
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    path = token_counts.tokenizer_path()
    return token_counts.Counter(path, token_counts.prove(path))


ODD = [
    "", " \t\n", "ΑΣ ΣΑΣ Σ", "İstanbul İ é", "a\u0085b\x1cc\x00d", "<|endoftext|>x <|startoftext|><|ENDOFTEXT|> <|endoftext", "it's IT'S 'LL we'll 've'vex", "٣٤½²Ⅷ漢字かな゙ゔ", "👩‍👩‍👧 ok",
    "ﬁ ſ K Å", " x　y\xa0z", "a" * 5000 + "é" * 3000, "!?" * 2000, "ǅ ẞ ß ŉ", "﻿abc", "𝐀𝐁 𐐀", "한국어 각 가", "x̣́", "a<b <|endoftext|", "é e ́", "word " * 60_000,
]


@pytest.mark.parametrize("text", ODD)
def test_counts_of_odd_texts(library, counter, text):
    assert counter.count(text) == library(text)


@pytest.mark.parametrize("top", [0x80, 0x250, 0x3100, 0x20000])
def test_counts_of_random_texts(library, counter, top):
    rng = random.Random(top)
    for _ in range(2000):
        text = "".join(c for c in (chr(rng.choice([rng.randrange(top), 32, 39, 115, 0x3A3, 60])) for _ in range(rng.randrange(1, 30))) if not "\ud800" <= c <= "\udfff")
        assert counter.count(text) == library(text), repr(text)


def test_whole_tokens_are_one_token(library):
    whole = sorted(token_counts.prove(token_counts.tokenizer_path()).whole)
    assert len(whole) > 30_000 and all(library(w) == 1 for w in whole[::37])


def test_counts_with_little_memory_and_in_parts(library, counter, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    for text in ("one two three four one two unheardofword 12'34 x.", "alpha, beta. gamma; alpha, beta. gamma;"):
        assert counter.count(text) == library(text)
    assert "".join(token_counts.parts("ab cde f ghijkl " * 50, 7)) == "ab cde f ghijkl " * 50
    assert len(list(token_counts.parts("ab cde f ghijkl " * 50, 7))) > 50 and list(token_counts.parts("x" * 90, 7)) == ["x" * 90]


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_query_against_the_library(spark, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op11_tokens(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got == {d.doc_id: (len((d.text or "").encode()), n := library(d.text), n > 2048) for d in docs} and len(docs) == len(got)


def test_token_counts_of_odd_rows(spark, library):
    rows = [(k, t, None, None, None) for k, t in enumerate(ODD)] + [(None, "null id", "en", "s", 1), (3, None, "en", "s", 1), (3, "again", "en", "s", 1), (3, "again", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in CLASH})
    got = sorted(map(tuple, token_counts.count_tokens(df).collect()), key=repr)
    assert got == sorted(((i, len((t or "").encode()), library(t), library(t) > 2048) for i, t, *_ in rows), key=repr)
    assert token_counts.count_tokens(df.limit(0)).collect() == []


def test_codes_agree_with_sql(spark):
    assert differences(spark, SF2, "op12", queries.op12_codes, queries.ORACLE_SQL["op12_codes"]) == []


def nearest(entries, x):
    far = [sum((int(a) - int(b)) ** 2 for a, b in zip(e, x)) for e in entries]
    return far.index(min(far)), min(far)


@pytest.mark.parametrize("kind", ["spread", "equal", "lattice", "line", "large"])
def test_tree_finds_the_nearest_entry(kind):
    rng = np.random.default_rng(5)
    make = {
        "spread": lambda n: rng.integers(-4000, 4000, (n, 8)), "equal": lambda n: rng.integers(0, 2, (n, 8)) * 7, "lattice": lambda n: rng.integers(-2, 3, (n, 2)),
        "line": lambda n: np.column_stack([rng.integers(0, 9, n), np.zeros(n, np.int64)]), "large": lambda n: rng.integers(-(2**27) + 1, 2**27, (n, 8)),
    }[kind]
    for entries in (1, 2, 5, 16, 40):
        search, queries_ = part_codes.Search(make(entries)), make(300)
        index, far = search.nearest(queries_)
        assert [(int(a), int(b)) for a, b in zip(index, far)] == [nearest(search.entries, x) for x in queries_]


def test_tree_leaves_branches_out():
    rng = np.random.default_rng(6)
    centres = rng.integers(-4000, 4000, (64, 4))
    search = part_codes.Search(centres)
    search.nearest(centres[rng.integers(0, 64, 5000)] + rng.integers(-50, 50, (5000, 4)))
    assert search.looked < 5000 * 64 / 3


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, lab, [int(np.floor(np.float64(x) * 4096)) for x in v]) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = [[v[p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[nearest(books[p], c[p])[0]].append(c[p])
            books[p] = [[sum(x) // len(members[k]) for x in zip(*members[k])] if members[k] else e for k, e in enumerate(books[p])]
    found = [[nearest(books[p], c[p]) for p in range(parts)] for c in cut]
    totals = Counter()
    for (_, lab, _), f in zip(kept, found):
        totals[lab] += sum(e for _, e in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for k, _ in f), sum(e for _, e in f), totals[lab], sha) for (i, lab, _), f in zip(kept, found)), key=repr)


@pytest.mark.parametrize("n", [0, 5, 120])
def test_codes_of_odd_rows_by_definition(spark, n):
    rng = np.random.default_rng(7)
    rows = [(k // 2 if k % 9 == 0 else k, [float(x) for x in rng.standard_normal(16).astype(np.float32)], [None, 1, 2][k % 3]) for k in range(n)]
    rows += [(0, None, 1), (1, [1.0, None] * 8, 1), (2, [float("nan")] * 16, 1), (3, [float("-inf")] * 16, None), (4, [], 2)]
    rows += [(None, rows[0][1], None), (None, [0.0] * 16, 3), (7, rows[1][1], 1), (7, rows[1][1], 1)] if n else []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in CLASH})
    assert sorted(map(tuple, part_codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr) == brute_codes(rows)


def test_codes_refuse_what_would_not_be_exact(spark):
    for vector in ([1e9] * 8, [1.0] * 7):
        with pytest.raises(Exception):
            part_codes.compress(spark.createDataFrame([(1, vector, 1)], "vec_id long, embedding array<float>, label int")).collect()


def test_divergence_agrees_with_sql(spark):
    assert differences(spark, SF2, "op13", queries.op13_divergence, queries.ORACLE_SQL["op13_divergence"]) == []


def brute_audit(rows, least=10, top=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= least)
        tf = {s: Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in mine}}
        whole = sum(tf.values(), Counter())

        def p(c, t):
            return 1 + Fraction(1000000000 * (c[t] + 2), sum(c.values()) + 2 * len(kept)).__floor__()

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in tf:
            pairs = sorted(((-sum(f(p(tf[s], t), p(tf[o], t)) for t in kept), o.encode()) for o in tf if o != s))
            terms = sorted((-f(p(tf[s], t), p(whole, t)), t.encode()) for t in kept if tf[s][t] and p(tf[s], t) > p(whole, t))[:top]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found)]
    return sorted(out)


def test_divergence_of_odd_rows_by_definition(spark):
    rng = random.Random(8)
    words = ["Alpha", "beta", "GAMMA", "été", "É", "漢字", "𝐀", "zz", "a", "b-c", "d1e", "don't", "Ω\x00x", "_u_", "@at"]
    rows = [(k, " ".join(rng.choices(words[: 4 + k % 12], k=rng.randrange(0, 30))), rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s1", "s1", "s2", "S3", "é", None, ""]), 0) for k in range(150)]
    rows += [(1, None, "en", "empty", None), (1, "", "de", "alone", 0), (None, None, None, None, None), (None, "few words", "xx", "a", 1), (None, "few words", "xx", "b", 1), (5, "Alpha " * 50_000, "en", "s1", 1), (5, "Alpha " * 50_000, "en", "s1", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in CLASH})
    got = sorted(map(tuple, divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == brute_audit(rows) and {r[2] for r in got} == {"pair", "term"}
    assert divergence.audit(df.limit(0)).collect() == []


def test_divergence_hands_on_what_a_task_cannot_hold(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 20)
    df = spark.createDataFrame([(k, f"t{k % 7} word of letters abc{chr(97 + k % 9)}", "en", f"s{k % 3}", 0) for k in range(90)], DOCS)
    got = sorted(map(tuple, divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == brute_audit([tuple(r) for r in df.collect()])


def test_divergence_in_small_slices(spark, monkeypatch):
    for name, value in (("SLICE_BYTES", 40), ("SLICE_TEXTS", 3), ("HANDED", 7), ("HELD", 60)):
        monkeypatch.setattr(divergence, name, value)
    words = ["Alpha", "été", "漢字", "zz", "a", "b-c", "d1e", "\x00", "-", ""]
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices(words, k=k % 13)) * (k % 3), rng.choice(["en", "de", None]), rng.choice(["s1", "S2", "é"]), 0) for k in range(160)] + [(1, None, "en", "void", 0)]
    got = sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, DOCS)).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == brute_audit(rows)


def test_texts_are_cut_into_slices():
    assert divergence.slices(np.array([3, 0, 4, 20, 1, 1, 0, 0]), 8, 3) == [(0, 3), (3, 4), (4, 7), (7, 8)] and divergence.slices(np.array([], np.int32), 8, 3) == []


def test_divergence_shuffles_counts_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = divergence.kept_terms(divergence.count_terms(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_large_counts_are_exact(spark):
    rows = [(10**14 + k, 10**16, 10**6 + k) for k in range(20)] + [(0, 0, 0), (0, 0, 3)]
    got = [r[0] for r in spark.createDataFrame(rows, "c long, n long, v long").select(divergence.per_unit("c", "n", "v")).collect()]
    assert got == [1 + 10**9 * (c + 2) // (n + 2 * v) if v else 1 for c, n, v in rows]


def test_small_and_large_counts_are_exact(spark):
    edge = divergence.LONG_COUNT
    rows = [(c, n, v) for c in (0, 7, edge - 1, edge, edge + 1, 10**15) for n, v in ((10**16, 10**6), (c, 1), (3, 0))]
    got = [r[0] for r in spark.createDataFrame(rows, "c long, n long, v long").select(divergence.per_unit("c", "n", "v")).collect()]
    assert got == [1 + 10**9 * (c + 2) // (n + 2 * v) if v else 1 for c, n, v in rows]
