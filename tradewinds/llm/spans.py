"""Substring dedup by sliding spans of sentences.

A text is cut into sentences, and these into segments: one of ``WINDOW`` words or more after the word whose pair with the word
before it has the least hash in any window of so many words, so that cuts depend on nothing but the words around them and no
segment is longer than a window. From every segment a span runs over the next ones until it has ``least`` segments and
``words`` words. Equal spans meet in one global join by hash; the first in order of id and position stays, and what another
occurrence covers is removed from its text: whole sentences, and of sentences of more than ``LONG`` words the segments.

Every passage of 50 words that occurs twice holds a common span, wherever it begins in a sentence: its first whole window
gives both a cut, so a span begins at its tenth word or before; it ends 25 to 32 words later, by the 41st, and the cuts up to
there are seen by no window that reaches out of the passage. At least 31 words of it are covered, which hold a segment of a
long sentence or, as two ends of others are at most 30 words, a whole sentence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_uneven, materialize

#: Segments and words that a span has at least.
LEAST, WORDS = 3, 25
#: Words of a window; each within a sentence gives one cut. Three windows and ``WORDS`` are at most 50 words.
WINDOW = 8
#: Words up to which a sentence is only removed whole.
LONG = 16
#: Characters (as code points) that are worked on at once; a longer text is taken alone.
CHUNK = 1 << 20
#: For each code point, the last for all beyond: 1 for white space, 2 for what ends a sentence, 4 for what may follow that.
_KIND = np.zeros(1 << 16, np.uint8)
_KIND[[k for k in range(1 << 16) if chr(k).isspace()]] = 1
_KIND[[ord(x) for x in ".!?…。！？"]] = 2
_KIND[[ord(x) for x in "\"'”’»)]"]] = 4
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[int, list[np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2 ** 64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(16, n.bit_length())
        _POWERS[base] = [np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64))]
    return _POWERS[base][0][:n], _POWERS[base][1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(symbols: np.ndarray, first: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A hash of each run of symbols, from ``first`` to before ``end``; the same wherever the run lies."""
    power, inverse = _powers(len(symbols) + 1, base)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * power[: len(symbols)], dtype=np.uint64)])
    return _mix((total[end] - total[first]) * inverse[first])


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x.lower()) > 1 else x.lower() for x in text)


def _segments(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts one after the other: (hash of each word, first word of each segment and the number of words,
    where in its text each segment's first word begins, first segment of each text and the number of segments,
    for each segment the number of what is removed whole with it: its sentence or, in a long one, itself; and that of its sentence).
    """
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    begin = np.cumsum(sizes) - sizes
    code = np.frombuffer("\n".join([*map(_lower, texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KIND[np.minimum(code, len(_KIND) - 1)]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], kind == 1]).astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    n = len(start)
    words = _hashes(code.astype(np.uint64) + np.uint64(1), start, end)
    at = end - 1
    for _ in range(3):
        at = at - ((kind[at] == 4) & (at > start))
    cuts = kind[at] == 2
    owner = np.searchsorted(begin, start, "right") - 1
    head = np.diff(owner, prepend=-1) != 0
    cuts |= np.append(head, True)[1:]
    ends = cuts.copy()
    # the last place of the least hash in each window that ends no sentence before its last word
    pairs = _mix(words + np.where(head, np.uint64(0), np.roll(words, 1)) * np.uint64(3))
    if n >= WINDOW:
        views = np.lib.stride_tricks.sliding_window_view(pairs[::-1], WINDOW)[::-1]
        sentence = np.cumsum(cuts) - cuts
        whole = np.flatnonzero(sentence[WINDOW - 1 :] == sentence[: n - WINDOW + 1])
        for k in range(0, len(whole), 1 << 16):
            part = whole[k : k + (1 << 16)]
            cuts[part + WINDOW - 1 - views[part].argmin(1)] = True
    firsts = np.concatenate([np.zeros(min(n, 1), np.int64), np.flatnonzero(cuts)[:-1] + 1])
    of = owner[firsts]
    # a segment begins something that is removed whole if it begins a sentence or lies in a long one
    sentence = (np.cumsum(ends) - ends)[firsts]
    long = np.diff(np.flatnonzero(ends), prepend=-1) > LONG
    whole = np.cumsum(long[sentence] | (np.diff(sentence, prepend=-1) != 0)) - 1
    return words, np.append(firsts, n), start[firsts] - begin[of], np.searchsorted(of, np.arange(len(texts) + 1)), whole, sentence


def _spans(texts: list[str], least: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first segment, segments, two hashes) of every span, and for each text how many sentences it has.

    A text with fewer segments but enough words is one span.
    """
    hashes, firsts, _, of, _, sentence = _segments(texts)
    begun = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.diff(sentence, prepend=-1))])
    k = np.arange(len(firsts) - 1)
    text = np.searchsorted(of, k, "right") - 1
    last = of[text + 1]
    end = np.maximum(np.searchsorted(firsts, firsts[:-1] + words), k + least)
    short = (end > last) & (k == of[text]) & (firsts[last] - firsts[:-1] >= words)
    end = np.where(short, last, end)
    k = np.flatnonzero(end <= last)
    end, text = end[k], text[k]
    first, end_word = firsts[k], firsts[end]
    other = _hashes(_mix(hashes + np.uint64(_OTHER)), first, end_word, _OTHER).astype(np.uint32).view(np.int32)
    return text, k - of[text], end - k, _hashes(hashes, first, end_word).view(np.int64), other, np.diff(begun[of])


def spans(text: str, least: int = LEAST, words: int = WORDS) -> list[tuple[int, int, int]]:
    """(first segment, segments, hash) of every span of one text."""
    return list(zip(*(x.tolist() for x in _spans([text], least, words)[1:4])))


def _chunks(texts: list[str]):
    """(from, to) of stretches of texts of about ``CHUNK`` characters."""
    first = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield first, k
            first, size = k, 0
        size += len(t) + 1
    if texts:
        yield first, len(texts)


def cut(text: str, marks: list[tuple[int, int]]) -> tuple[str, int]:
    """(text without the sentences that the marks (first segment, segments) cover, how many lose something)."""
    _, _, starts, _, whole, sentence = _segments([text])
    if not len(starts):
        return text, 0
    covered = np.zeros(len(whole), bool)
    for first, n in marks:
        covered[first : first + n] = True
    left = np.bincount(whole[~covered], minlength=whole[-1] + 1)
    edges = np.concatenate([[0], starts[np.flatnonzero(np.diff(whole)) + 1], [len(text)]]).tolist()
    return "".join(text[a:b] for a, b, n in zip(edges, edges[1:], left.tolist()) if n), len(np.unique(sentence[left[whole] == 0]))


_FOUND = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("at", pa.int64()), ("h", pa.int64()), ("g", pa.int32())])


def find(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """(doc_id, uid, at, h, g): every span; ``uid`` tells rows with equal ids but different texts apart.

    ``at`` is the first segment, times 2 ** 32, and the number of segments; h and g are hashes of 64 and 32 bits. One more row
    for each row of ``docs`` has no hash, and as ``at`` the number of its sentences.
    """

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            for a, b in _chunks(texts):
                text, pos, n, h, g, sizes = _spans(texts[a:b], least, words)
                row = pa.array(text + a)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(row), batch["uid"].take(row), pa.array(pos << 32 | n), pa.array(h), pa.array(g)], schema=_FOUND)
                none = [pa.nulls(b - a, t) for t in (pa.int64(), pa.int32())]
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], batch["uid"][a:b], pa.array(sizes, pa.int64()), *none], schema=_FOUND)

    return docs.mapInArrow(run, "doc_id long, uid long, at long, h long, g int")


def dedup(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """Return doc_id, text (without repeated sentences), n_sentences, n_removed for every row of ``docs``.

    The first occurrence is that with the least id (null: before all), then the earliest in its text. A null text stays null,
    an empty one empty. Repeated rows (equal id and text) are one document and have the same result; texts of equal ids are
    told apart. Texts shorter than a span lose nothing. ``n_sentences`` counts sentences, ``n_removed`` those that are gone or,
    having more than LONG words, lose segments. Other columns are ignored; an empty table gives none.

    Spans are equal if both their hashes are (96 bits). Joins on hashes are those for uneven keys: no task gathers the places
    of a passage that many documents share.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("uid"))
    found = materialize(find(rows, least, words), "spans")
    spans = found.where("h IS NOT NULL")
    # only the hashes are shuffled to tell which occur again, and then the spans that may be of these
    twice = materialize(spans.groupBy("h").count().where("count > 1"), "spans-twice")
    found_again = materialize(join_uneven(spans, twice, "h", "count", found.count()).select("doc_id", "uid", "at", F.struct("h", "g").alias("k")), "spans-again")
    place = F.struct("doc_id", "uid", "at")
    first = found_again.groupBy("k").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where(F.col("first") != F.col("last"))
    first = materialize(first.drop("last"), "spans-first")
    later = join_uneven(found_again, first, "k", "n", found.count()).where(~place.eqNullSafe(F.col("first")))
    sizes = found.where("h IS NULL").select("doc_id", "uid", F.lit(None).cast("long").alias("at"), F.col("at").alias("n"))
    marked = sizes.unionByName(later.select("doc_id", "uid", "at", F.lit(None).cast("long").alias("n")))
    marks = marked.groupBy(F.col("doc_id").alias("_doc"), F.col("uid").alias("_uid")).agg(F.collect_set("at").alias("marks"), F.max("n").alias("n"))

    def run(batches):
        for batch in batches:
            texts, gone = [], []
            for old, marked in zip(batch["text"].to_pylist(), batch["marks"].to_pylist()):
                text, n = cut(old, [(m >> 32, m & 0xFFFFFFFF) for m in marked]) if marked else (old, 0)
                texts.append(text)
                gone.append(n)
            columns = [batch["doc_id"], pa.array(texts, pa.string()), batch["n"], pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_sentences", "n_removed"])

    joined = rows.join(marks, (F.col("uid") == F.col("_uid")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    return joined.select("doc_id", "text", "marks", "n").mapInArrow(run, "doc_id long, text string, n_sentences long, n_removed long")
