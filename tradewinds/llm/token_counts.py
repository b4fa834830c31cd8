"""Token counts by whole-token shortcut: most pre-tokens are one token, which is proved beforehand; only the rest is merged.

Before any text is read, the driver proves two things with the tokenizer's own library:

* which entries of the vocabulary, written as text and encoded alone, are one pre-token and come back as one token
  (:attr:`Proof.whole`); such a pre-token counts 1 wherever it stands, as merging never looks beyond a pre-token;
* for which characters lower-casing and splitting by this module do what the library does (:attr:`Proof.unsafe` finds the
  others); a text that holds another is normalised and split by the library itself, and then counted in the same way.

Both are bounded by the vocabulary and by the characters tried, and are broadcast.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Runs between white space and words whose counts a process keeps; beyond, it forgets all and starts anew.
REMEMBERED = 600_000
#: A longer text is counted in parts that end at a space, so that its pre-tokens are never all held at once.
PART = 1 << 20
#: Characters that are tried: Latin, Greek and Cyrillic letters, punctuation and signs, Kana, common Han, full-width forms.
TRIED = ((0x0, 0x2FF), (0x370, 0x45F), (0x2000, 0x27BF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xFF00, 0xFFEF))
#: The pre-tokens of the supported files, as their libraries split normalised text. Fixed value.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_OF_WORD = "</w>"

_FIND = regex.compile(PRE_TOKENS).findall
#: Printable stand-ins of the 256 bytes: bytes that are no visible Latin-1 character are numbered from U+0100 on.
_VISIBLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_SHOWN = {b: b for b in _VISIBLE} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_VISIBLE))}
_BYTES = {c: b for b, c in _SHOWN.items()}


def shown(text: str) -> str:
    """The UTF-8 bytes of ``text`` as the characters that stand for them in the vocabulary."""
    return text.encode().decode("latin-1").translate(_SHOWN)


def lowered(text: str) -> str:
    """Lower case, letter by letter: a sigma at the end of a word is like any other."""
    return text.replace("Σ", "σ").lower()


@dataclass(frozen=True)
class Proof:
    """What is known of a tokenizer before texts are read."""

    whole: frozenset[str]  #: pre-tokens that are one token
    unsafe: str  #: a pattern for characters that the library must normalise and split
    special: str  #: a pattern for strings that are one token wherever they stand; empty if there is none


def load(path: str):
    """The tokenizer of a file, without truncation and padding; refused if its parts aren't those that the proof is about."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if getattr(tokenizer.model, "end_of_word_suffix", None) != END_OF_WORD:
        raise ValueError("only tokenizers whose words end with " + END_OF_WORD + " are supported")
    probe = "It's   Ab12'x ?! Été一\n"
    normal = tokenizer.normalizer.normalize_str(probe)
    if normal != "it's ab12'x ?! été一 " or [t for t, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal)] != list(map(shown, _FIND(normal))):
        raise ValueError("only tokenizers that lower-case and split as the supported ones are supported")
    return tokenizer


@functools.cache
def prove(path: str) -> Proof:
    """The proof for the tokenizer of a file."""
    tokenizer = load(path)
    normal, split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
    names = []
    for token in tokenizer.get_vocab():
        if token.endswith(END_OF_WORD):
            try:
                names.append(bytes(_BYTES[ord(c)] for c in token.removesuffix(END_OF_WORD)).decode())
            except (KeyError, UnicodeDecodeError):  # not the text of a whole word
                continue
    names = [s for s in names if s and normal(s) == s and len(split(s)) == 1 and _FIND(s) == [s]]
    whole = frozenset(s for s, e in zip(names, tokenizer.encode_batch_fast(names, add_special_tokens=False)) if len(e.ids) == 1)

    def safe(c: str) -> bool:
        text = f"a{lowered(c)}{lowered(c)}!1"
        alone = unicodedata.is_normalized("NFC", c) and not unicodedata.combining(c) and unicodedata.normalize("NFC", "e" + c) == "e" + c
        return alone and normal(f"a{c}{c}!1").replace(" ", "") == "".join(text.split()) and [t for t, _ in split(normal(f"a{c}{c}!1"))] == list(map(shown, _FIND(text)))

    ranges: list[list[int]] = []
    for at in itertools.chain.from_iterable(range(a, b + 1) for a, b in TRIED):
        if safe(chr(at)):
            if ranges and ranges[-1][1] == at - 1:
                ranges[-1][1] = at
            else:
                ranges.append([at, at])
    unsafe = "[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]"
    special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    return Proof(whole, unsafe, "|".join(map(regex.escape, special)))


def parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut only before spaces."""
    start = 0
    while len(text) - start > size and (end := text.find(" ", start + size)) >= 0:
        yield text[start:end]
        start = end
    yield text[start:]


class Counter:
    """Counts the tokens of whole texts."""

    def __init__(self, path: str, proof: Proof):
        self.tokenizer, self.whole = load(path), proof.whole
        self.unsafe, self.special = re.compile(proof.unsafe).search, proof.special and re.compile(proof.special)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(END_OF_WORD)]] = True
        self.chunks: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def tokens(self, words: list[str]) -> int:
        """Tokens of pre-tokens: 1 for each that is known to be one, and those that merging leaves of any other."""
        rest = [w for w in words if w not in self.whole]
        return len(words) - len(rest) + sum(len(self.tokenizer.model.tokenize(shown(w))) for w in rest)

    def merge(self, words: list[str]) -> None:
        """Remember the tokens of words of letters that are not known to be one, merged in one call and told apart by their ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids)
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(words):
            raise ValueError("a word's tokens don't end with one end of word")
        self.words.update(zip(words, np.diff(ends, prepend=-1).tolist()))

    def learn(self, new: set[str]) -> None:
        """Remember the tokens of runs between white space; most are a word of letters with punctuation behind."""
        split, missing = [], set()
        for chunk in new:
            word = chunk.rstrip(".,;:!?*#%&$|\"()-")
            if (low := lowered(word)).isalpha():
                split.append((chunk, low, len(word) < len(chunk) and self.tokens([chunk[len(word) :]])))
                if low not in self.whole and low not in self.words:
                    missing.add(low)
            else:
                self.chunks[chunk] = self.tokens(_FIND(lowered(chunk)))
        if missing:
            self.merge(list(missing))
        for chunk, low, rest in split:
            self.chunks[chunk] = (1 if low in self.whole else self.words[low]) + rest

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings; what stands between white space is counted once and remembered."""
        if self.unsafe(text):
            normal = self.tokenizer.normalizer.normalize_str(text)
            return self.tokens([normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)])
        chunks = text.split()
        new = set(chunks).difference(self.chunks)
        if new:
            if len(self.chunks) + len(self.words) > REMEMBERED:
                self.chunks, self.words, new = {}, {}, set(chunks)
            self.learn(new)
        return sum(map(self.chunks.__getitem__, chunks))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if not self.special or "<" not in text:
            return sum(map(self.plain, parts(text)))
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(self.plain(part) for piece in pieces for part in parts(piece))


_COUNTERS: dict[str, Counter] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Return doc_id, n_bytes (of UTF-8), n_tokens and over_limit (more than ``limit`` tokens) for each document.

    Tokens are those that the library gives by its defaults without adding special ones: a special string within a text is one
    token. A null or empty text has 0 bytes and tokens. Each row is counted for itself, whatever its id (null, repeated); other
    columns are ignored; an empty table gives no rows. Each text is read once, in one task, and nothing is shuffled.
    """
    path = path or tokenizer_path()
    proof = docs.sparkSession.sparkContext.broadcast(prove(path))

    def run(batches):
        if path not in _COUNTERS:  # shared by the tasks that this Python process runs
            _COUNTERS[path] = Counter(path, proof.value)
        count = _COUNTERS[path].count
        for batch in batches:
            n = pa.array((count(text.as_py()) for text in batch["text"]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], n], names=["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
