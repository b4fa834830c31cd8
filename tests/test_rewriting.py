"""Rewriting by a table of phrases."""

import random
import re

from pyspark.sql import functions as F

from tradewinds.functions import rewriting

RULES = "pass int, phrase string, replacement string"


def brute(text, rules):
    """Replacement at every place in turn, by trying every rule."""
    for number in sorted({p for p, _, _ in rules}):
        mine = [(ph.lower().split(), r) for p, ph, r in rules if p == number]
        words, out, done, k = list(re.finditer(r"[A-Za-z0-9']+", text)), "", 0, 0
        while k < len(words):
            fits = []
            for phrase, r in mine:
                some = words[k : k + len(phrase)]
                same = len(some) == len(phrase) and all(a[0].lower() == b or (b == "#" and a[0].isdigit()) for a, b in zip(some, phrase))
                if same and all(re.fullmatch(r"[ \t-]*", text[a.end() : b.start()]) for a, b in zip(some, some[1:])):
                    fits.append((-len(phrase), [b == "#" for b in phrase], r, [a[0] for a, b in zip(some, phrase) if b == "#"]))
            if not fits:
                k += 1
                continue
            n, _, r, numbers = min(fits)
            for i, x in enumerate(numbers, 1):
                r = r.replace(f"{{{i}}}", x)
            out, done, k = out + text[done : words[k].start()] + r, words[k - n - 1].end(), k - n
        text = out + text[done:]
    return text


def test_against_brute_force(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(["a", "b", "c", "d", "#", "1"]) for _ in range(n))
    rules = [(rng.randrange(3), some(rng.randrange(1, 5)), rng.choice(["x", "a b", "<{1}>", "C d", ""])) for _ in range(60)]
    texts = ["".join(rng.choice(["a", "B", "c", "d", "1", "22", " ", " ", " ", "-", ", ", "| "]) for _ in range(rng.randrange(0, 40))) for _ in range(400)] + [None, "", "word " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    table = spark.createDataFrame([*rules, (None, None, None)], RULES)
    got = {r.k: r.t for r in df.select("k", rewriting.rewritten(F.col("s"), table).alias("t")).collect()}
    assert got == {k: t and brute(t, rules) if t else t for k, t in enumerate(texts)}
    assert {r.t for r in df.limit(5).select(rewriting.rewritten(F.col("s"), table.limit(0)).alias("t")).collect()} == set(texts[:5])


def test_the_walk_does_not_grow_with_the_rules():
    text = "wts zkey and obby shards q 9 bds for 5 e " * 20
    steps = []
    for n in (0, 20_000):
        trie = rewriting.Trie([("obby shards", "x"), ("q #", "q{1}")] + [(f"w{k} and more", "y") for k in range(n)])
        trie.rewrite(text)
        steps.append(trie.steps)
    assert steps[0] == steps[1] < 3 * len(text.split())


def test_standard_rules_and_learned_aliases(spark):
    cases = {
        "WTS Rez 4e/stk": "WTS Scroll of Resurrection 4e/stk", "wtb stack of obi shards": "wtb Obsidian Shard", "WTS elite monk tomes 2e": "WTS Elite Monk Tome 2e", "WTS bow req 9 insc": "WTS bow q9 inscribable",
        "WTS BDay Present 1-7": "WTS " + " | ".join(f"Xunlai Birthday Present {y} Year" for y in rewriting.YEARS.values()), "WTS 57x Birthday Present Vouchers": "WTS 57x Xunlai Birthday Voucher",
        "unded gpriest": "unded Miniature Ghostly Priest", "WTS mybow rq 8": "WTS Storm Bow q8", "ghostly, priest": "ghostly, priest", "bday present 3": "Xunlai Birthday Present 3rd Year", "gzc/szc": "Gold Zaishen Coin/Silver Zaishen Coin",
    }
    aliases = spark.createDataFrame([("mybow", "Storm Bow"), (None, "x")], "alias string, name string")
    rules = spark.createDataFrame(rewriting.standard(), RULES).unionByName(rewriting.learned(aliases))
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.t for r in df.select("s", rewriting.rewritten(F.col("s"), rules).alias("t")).collect()} == cases
    assert rewriting.written("drok(nar) key(s)") == ["drok key", "drok keys", "droknar key", "droknar keys"] and rewriting.written("[a ]b") == ["a b", "b"]
