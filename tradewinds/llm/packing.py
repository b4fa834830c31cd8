"""Best-fit packing of tokenized documents by linear grouping.

Tokenizing is one pass over the texts; it keeps a row of numbers per piece. Planning needs only how many pieces have each
length (at most ``capacity`` counts, whatever the size of the corpus):

1. Pieces of at least ``capacity // small_part`` tokens are sorted by length on paper and cut into groups of equal
   cardinality; within a group every length is rounded up to the largest.
2. Configurations (multisets of the few rounded sizes that fit one sequence) are chosen to fill sequences best.
3. The actual pieces of each group are substituted, which leaves the rounding as free space.
4. The small pieces go, largest first, to the sequence with the least sufficient space (best fit).

The plan is a list of runs ("ranks a to b of length l go to sequences s, s+1, ... at offset o"); every piece then finds
its place by its length and its rank among pieces of that length.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, small
from .token_counts import shown

TOKENIZER = "word_bpe_49k.json"
#: Chunks of text whose ids a Python process keeps at most.
CACHE = 800_000


class WordEncoder(dict):
    """Ids of whole texts by a tokenizer whose tokens never cross white space, remembering those of each chunk, as bytes.

    A chunk is a run without space, tab or line feed. If it is letters below U+0250 and then ASCII punctuation, its ids are
    those of the letters and those of the punctuation, and those of the letters are what the tokenizer's model makes of them
    in lower case, which is tried beforehand for each letter. Any other chunk is encoded as it is.

    When half of ``CACHE`` is full, it becomes the older half and what was the older half is forgotten; a chunk of the older
    half that is met again comes back. So chunks that are met again and again are never encoded anew.
    """

    END = "</w>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.split, self.older = self.tokenizer.model.tokenize, {}
        if max(self.tokenizer.get_vocab().values()) >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        if getattr(self.tokenizer.model, "end_of_word_suffix", None) != self.END:
            raise ValueError("only tokenizers whose words end with " + self.END + " are supported")
        for letter in filter(str.isalpha, map(chr, range(0x250))):
            if letter != "İ" and any(self.encode(w) != self.merge(w.lower()) for w in (letter, f"a{letter}{letter}e")):
                raise ValueError("only tokenizers that lower-case and keep words of letters whole are supported")

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def merge(self, word: str) -> bytes:
        """The ids of a word of lower-case letters."""
        ids = [t.id for t in self.split(shown(word))]
        return struct.pack(f"<{len(ids)}H", *ids)

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            core = chunk.rstrip(".,;:!?*#%&$|\"()-")
            if not core.isalpha() or not core.isascii() and (max(core) >= "ɐ" or "İ" in core):
                ids = self.encode(chunk)
            elif (word := core.lower()) == chunk:
                ids = self.merge(word)
            elif len(core) == len(chunk):
                ids = self[word]
            else:
                rest = chunk[len(core) :]
                ids = self[word] + self[rest]
        if len(self) >= CACHE // 2:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def batch(self, texts: list[str | None]):
        """The ids of each text, as an array."""
        for text in texts:
            words = (text or "").replace("\n", " ").replace("\t", " ").split(" ")
            yield np.frombuffer(b"".join(map(self.__getitem__, words)), "<u2")


_ENCODERS: dict[str, WordEncoder] = {}


def shared_encoder(path: str) -> WordEncoder:
    """The encoder of this Python process, so that the tasks that it runs one after the other share what is remembered."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_PIECE = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())]
)
_PIECE_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int, path: str | None = None, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): the ids of each document, then ``end_id``, cut every ``capacity``.

    ``nth`` counts the pieces of that length in the task that made them, from 0. The rows must be written before they are
    used, as a task that runs again may number others. Tokenizers with ids above 16 bits are refused.
    """

    def run(batches):
        encoder = shared_encoder(path or tokenizer_path())
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        for batch in batches:
            out: list[list[int]] = [[] for _ in _PIECE]
            for doc, ids in zip(batch["doc_id"].to_pylist(), encoder.batch(batch["text"].to_pylist())):
                ids = np.append(ids, end_id).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    n = len(part)
                    for column, x in zip(out, (doc, k, start, n, zlib.crc32(part.tobytes()), task, seen[n])):
                        column.append(x)
                    seen[n] += 1
            yield pa.record_batch([pa.array(x, t.type) for x, t in zip(out, _PIECE)], schema=_PIECE)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"{_PIECE_SQL}, task int, nth long")


class _Sequences:
    """``many`` sequences that hold the same lengths; ``items``: (length, rank of the first sequence's piece)."""

    __slots__ = ("items", "many")

    def __init__(self, items: list[tuple[int, int]], many: int):
        self.items, self.many = items, many

    def split(self, n: int) -> "_Sequences":
        """Keep the first ``n``; return the others."""
        rest = _Sequences([(size, rank + n) for size, rank in self.items], self.many - n)
        self.many = n
        return rest


def _groups(counts: dict[int, int], number: int) -> list[tuple[int, list[list[int]]]]:
    """Equal-cardinality groups, largest first: (rounded size, [[length, first rank, count], ...])."""
    total, groups, used = sum(counts.values()), [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = used * number // total
            end = -(-(at + 1) * total // number)
            n = min(left, end - used)
            if groups and groups[-1][2] == at:
                groups[-1][1].append([size, rank, n])
            elif groups and groups[-1][0] == size:
                groups[-1][1].append([size, rank, n])
                groups[-1][2] = at
            else:
                groups.append([size, [[size, rank, n]], at])
            rank, left, used = rank + n, left - n, used + n
    return [(size, runs) for size, runs, _ in groups]


def _fill(space: int, sizes: list[int], counts: list[int]) -> list[int]:
    """Indices (repeats allowed, within ``counts``) whose sizes fill ``space`` best, few large ones rather than many small."""
    reached = np.zeros(space + 1, bool)
    reached[0] = True
    came = np.full(space + 1, -1, np.int32)
    for i, (size, count) in enumerate(zip(sizes, counts)):
        if size > space or not count:
            continue
        for _ in range(min(count, space // size)):
            new = np.zeros_like(reached)
            new[size:] = reached[:-size]
            new &= ~reached
            new[size:] &= (came[:-size] <= i) if size else True
            if not new.any():
                break
            came[new] = i
            reached |= new
        if reached[space]:
            break
    at = int(np.flatnonzero(reached)[-1])
    out = []
    while at:
        out.append(int(came[at]))
        at -= sizes[came[at]]
    return out


def _configure(groups: list[tuple[int, list[list[int]]]], capacity: int) -> list[tuple[list[int], int]]:
    """(groups in a sequence, number of such sequences), from the largest remaining size on."""
    sizes, counts = [s for s, _ in groups], [sum(n for _, _, n in runs) for _, runs in groups]
    out = []
    for i, size in enumerate(sizes):
        while counts[i]:
            counts[i] -= 1
            chosen = [i, *_fill(capacity - size, sizes, counts)]
            counts[i] += 1
            need = {k: chosen.count(k) for k in chosen}
            many = min(counts[k] // n for k, n in need.items())
            for k, n in need.items():
                counts[k] -= n * many
            out.append((chosen, many))
    return out


def _substitute(groups, configurations) -> list[_Sequences]:
    """Put the groups' actual runs in the place of the rounded sizes."""
    queues = [[list(run) for run in reversed(runs)] for _, runs in groups]
    out = []
    for chosen, many in configurations:
        slots = []
        for k in chosen:  # ``many`` pieces of the group for this slot, as runs
            need, taken = many, []
            while need:
                run = queues[k][-1]
                n = min(need, run[2])
                taken.append((run[0], run[1], n))
                run[1], run[2], need = run[1] + n, run[2] - n, need - n
                if not run[2]:
                    queues[k].pop()
            slots.append(taken)
        bounds = sorted({0, many, *(sum(n for _, _, n in taken[:j]) for taken in slots for j in range(len(taken)))})
        for a, b in zip(bounds, bounds[1:]):
            items = []
            for taken in slots:
                at = 0
                for size, rank, n in taken:
                    if at <= a < at + n:
                        items.append((size, rank + a - at))
                        break
                    at += n
            out.append(_Sequences(items, b - a))
    return out


def _best_fit(sequences: list[_Sequences], counts: dict[int, int], capacity: int) -> list[_Sequences]:
    """Add pieces, largest first, each to the sequence with the least space that suffices."""
    free: dict[int, list[_Sequences]] = defaultdict(list)
    for x in sequences:
        free[capacity - sum(s for s, _ in x.items)].append(x)
    spaces = sorted(free)
    done: list[_Sequences] = []

    def put(x: _Sequences, space: int) -> None:
        if space not in free or not free[space]:
            if space not in free:
                bisect.insort(spaces, space)
        free[space].append(x)

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(spaces, size)
            while at < len(spaces) and not free[spaces[at]]:
                del free[spaces[at]]
                del spaces[at]
            if at == len(spaces):
                x, space = _Sequences([], left), capacity
            else:
                space = spaces[at]
                x = free[space].pop()
            each = min(space // size, left)
            many = min(x.many, left // each)
            if many < x.many:
                rest = x.split(many)
                if rest.items:
                    put(rest, space)
            x.items += [(size, rank + k * many) for k in range(each)]
            rank, left = rank + each * many, left - each * many
            put(x, space - each * size)
    for xs in free.values():
        done += xs
    return done


def plan(counts: dict[int, int], capacity: int, groups: int = 192, small_part: int = 8) -> np.ndarray:
    """Runs (length, first rank, ranks, first sequence, offset) that place every piece, from the number of each length."""
    large = {s: n for s, n in counts.items() if capacity // small_part <= s < capacity}
    small_ones = {s: n for s, n in counts.items() if s < capacity // small_part}
    sequences: list[_Sequences] = []
    if large:
        grouped = _groups(large, min(groups, sum(large.values())))
        sequences = _substitute(grouped, _configure(grouped, capacity))
    sequences = _best_fit(sequences, small_ones, capacity)
    if counts.get(capacity):
        sequences.append(_Sequences([(capacity, 0)], counts[capacity]))
    runs, first = [], 0
    for x in sequences:
        offset = 0
        for size, rank in x.items:
            runs.append((size, rank, x.many, first, offset))
            offset += size
        first += x.many
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def ranked(found: DataFrame) -> DataFrame:
    """``found`` with ``rank``: its place (from 0) among the rows of its length, by task and then by place in the task."""
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)  # one row for each task
    base = found.groupBy("length", "task").count().select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return found.join(small(base), ["length", "task"]).withColumn("rank", F.col("nth") + F.col("base")).drop("task", "nth", "base")


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """Return doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each document goes.

    A null or empty text is the end id alone. Rows with equal ids are packed each for itself; other columns are ignored; an
    empty table gives none.
    """
    found = materialize(pieces(docs, capacity, path), "pack-pieces")
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = plan(counts, capacity)
    keys = runs[:, 0] << 44 | runs[:, 1]

    def place(batches):
        for batch in batches:
            size, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(keys, size << 44 | rank, "right") - 1
            run = runs[at]
            columns = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked(found).mapInArrow(place, f"{_PIECE_SQL}, sequence_id long, offset long")
