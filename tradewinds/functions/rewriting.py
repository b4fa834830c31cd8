"""Rewriting of messages by a table of phrases, in passes; one walk over the words a pass, however many rules there are.

A rule is a row (pass, phrase, replacement). Phrases are words; ``#`` stands for a number, which ``{1}``, ``{2}`` put into the
replacement. Within a pass the text is read once from left to right: where phrases begin, the longest is taken (a word before a
number), what it is replaced by is not read again in that pass, and the next pass reads the result. Words of a phrase may be
apart by blanks and hyphens, not by other marks; case doesn't count.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that a table may have, as it goes to every task.
MOST = 200_000
_WORD = re.compile(r"[A-Za-z0-9']+")
_JOINS = re.compile(r"[ \t-]*\Z")
_NUMBER = "#"
_END = ""  # no word is empty


def written(form: str) -> list[str]:
    """All ways to write a form: what stands in brackets may be left out. 'stack(s) [of] x' gives no more than it says."""
    parts = re.split(r"[(\[]([^)\]]*)[)\]]", form)
    ways = product(*([p] if k % 2 == 0 else ["", p] for k, p in enumerate(parts)))
    return sorted({" ".join("".join(w).split()) for w in ways})


class Trie:
    """The phrases of one pass by their words; ``steps`` counts the words looked up."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        self.steps = 0
        for phrase, replacement in rules:
            node = self.root
            for word in phrase.lower().split():
                node = node.setdefault(word, {})
            if node is not self.root:
                node[_END] = min(node.get(_END, replacement), replacement)  # of two equal phrases always the same

    def _longest(self, text: str, words: list, at: int) -> tuple[int, str, list[str]] | None:
        best, open_ = None, [(self.root, at, [])]
        while open_:
            node, k, numbers = open_.pop()
            if _END in node and (best is None or k > best[0]):
                best = (k, node[_END], numbers)
            if k == len(words) or (k > at and not _JOINS.match(text[words[k - 1].end() : words[k].start()])):
                continue
            word = words[k][0].lower()
            self.steps += 1
            if _NUMBER in node and word.isdigit():
                open_.append((node[_NUMBER], k + 1, [*numbers, word]))
            if word in node:  # taken from the stack first, so that it wins over a number
                open_.append((node[word], k + 1, numbers))
        return best

    def rewrite(self, text: str) -> str:
        words, out, done, k = list(_WORD.finditer(text)), [], 0, 0
        while k < len(words):
            found = self._longest(text, words, k)
            if found is None:
                k += 1
                continue
            end, replacement, numbers = found
            for n, number in enumerate(numbers, 1):
                replacement = replacement.replace(f"{{{n}}}", number)
            out += [text[done : words[k].start()], replacement]
            done, k = words[end - 1].end(), end
        return "".join([*out, text[done:]])


def tries(rules: DataFrame) -> list[Trie]:
    """A trie for each pass, in order."""
    rows = rules.select(F.col("pass").cast("int").alias("pass"), "phrase", "replacement").where("phrase IS NOT NULL AND replacement IS NOT NULL").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rules")
    return [Trie((r.phrase, r.replacement) for r in rows if r["pass"] == p) for p in sorted({r["pass"] for r in rows})]


def rewritten(message: Column, rules: DataFrame) -> Column:
    """``message`` after all passes; null stays null."""
    passes = tries(rules)

    @F.pandas_udf("string")
    def walk(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            for trie in passes if text else ():
                text = trie.rewrite(text)
            return text

        return texts.map(one, na_action="ignore")

    return walk(message)


# What traders write, and the name that the catalog has.
NAMES = {
    "Obsidian Shard": ["obby shard(s)", "[stack of ]obi(dian) shard(s)", "[stack of ]obsidian shard(s)"],
    "Droknar's Key": ["drok(nar) key(s)"],
    "Scroll of Resurrection": ["res scroll(s)", "resurrection scroll(s)", "rez"],
    "Candy Apple": ["[candy ]apple(s)"],
    "Slice of Pumpkin Pie": ["[pumpkin ]pie(s)"],
    "Pumpkin Cookie": ["cookie(s)"],
    "Candy Corn": ["[candy ]corn"],
    "Drake Kabob": ["kebab(s)", "kabob(s)"],
    "Lunar Fortune": ["lunar(s)"],
    "Scroll of the Lightbringer": ["lightbringer scroll(s)"],
    "Zaishen Key": ["zkey(s)", "z key(s)"],
    "Trick-or-Treat Bag": ["[all ]tot bag(s)", "trick or treat bag(s)"],
    "Golden Flame of Balthazar": ["gold(en) flame(s)"],
    "Stygian Gemstone": ["stygian gem(s)", "stygian gemstone(s)"],
    "Pile of Glittering Dust": ["[stack of ][glittering ]dust"],
    "Bolt of Cloth": ["[stack of ]cloth"],
    "Iron Ingot": ["[stack of ]iron"],
    "Granite Slab": ["granite[ slab(s)]"],
    "Jadeite Summoning Stone": ["turtle stone(s)"],
    "Golden Egg": ["golden egg(s)"],
    "Hero's Strongbox": ["herobox(es)", "hero box(es)", "heros strongbox(es)"],
    "Charr Carving": ["char carving(s)"],
    "Essence of Celerity": ["bu", "bus"],
    "Four-Leaf Clover": ["clover(s)"],
    "Gold Zaishen Coin": ["gzc", "gold zcoin(s)", "golden zaishen coin(s)"],
    "Silver Zaishen Coin": ["szc", "silver zcoin(s)"],
    "Map Set": ["[full ]map[ piece] set(s)"],
    "Birthday Cupcake": ["d cake", "dcake"],
    "Battle Isle Iced Tea": ["ice tea", "icetea"],
    "Red Rock Candy": ["red rock(s)"],
    "Rainbow Candy Cane": ["rainbow(s)"],
    "Measure for Measure": ["m4m"],
    "Perfect Salvage Kit": ["perf(ect) salvage kit(s)"],
    "Large Equipment Pack": ["large equip(ment) pack", "large eqbag", "large eq bag"],
    "Heavy Equipment Pack": ["heavy equip(ment) pack", "heavy eqbag", "heavy eq bag"],
    "Superior Rune of Vigor": ["sup(erior) rune [of ]vigor"],
    "Aptitude not Attitude": ["apt not att", "aptitude no attitude"],
    "Xunlai Birthday Voucher": ["[xunlai ]birthday present voucher(s)", "bday present voucher(s)"],
    "Voltaic Spear": ["volta"],
    "Miniature Ghostly Priest": ["gpriest", "g priest", "ghostly priest"],
    "Miniature Kuunavang": ["mini(ature) kuuna(vang)"],
    "Miniature Zhed Shadowhoof": ["mini(ature) zhed[ shadowhoof]"],
    "Miniature Rift Warden": ["mini(ature) rift warden"],
    "Miniature Ghostly Hero": ["mini(ature) ghostly hero"],
}
PROFESSIONS = {
    "Assassin": "assassin sin", "Dervish": "derv dervish", "Elementalist": "ele elementalist", "Mesmer": "mes mesmer", "Monk": "mo monk", "Necromancer": "necro necromancer", "Paragon": "para paragon", "Ranger": "rang ranger",
    "Ritualist": "rit ritualist", "Warrior": "war warr warrior",
}
#: The years of a birthday present.
YEARS = {1: "1st", 2: "2nd", 3: "3rd", 4: "4th", 5: "5th", 6: "6th", 7: "7th"}


def standard() -> list[tuple[int, str, str]]:
    """The table of the trade: spelling (pass 1), then names (pass 2). Learned aliases are rows of pass 0."""
    rows = [(1, f"{w} #", "q{1}") for w in ("q", "r", "rq", "req", "requirement")] + [(1, w, "inscribable") for w in ("insc", "inscr", "inscrib", "inscriptable")]
    rows += [(2, way, name) for name, forms in NAMES.items() for form in forms for way in written(form)]
    rows += [(2, f"{elite}{p} {tome}", f"{elite.title()}{name} Tome") for name, short in PROFESSIONS.items() for p in short.split() for elite in ("", "elite ") for tome in ("tome", "tomes")]
    rows += [(2, f"{day} {present} {n}", f"Xunlai Birthday Present {year} Year") for day in ("bday", "birthday") for present in ("present", "presents") for n, year in YEARS.items()]
    rows += [(2, f"{day} {present} 1 {to}7", " | ".join(f"Xunlai Birthday Present {y} Year" for y in YEARS.values())) for day in ("bday", "birthday") for present in ("present", "presents") for to in ("", "to ", "through ")]
    return rows


def learned(aliases: DataFrame) -> DataFrame:
    """Rows of pass 0 from learned aliases (alias, name)."""
    return aliases.select(F.lit(0).alias("pass"), F.col("alias").alias("phrase"), F.col("name").alias("replacement"))
