"""Best-fit packing of token sequences by a linear grouping scheme.

1. Every text becomes token ids plus the end id; longer ones are cut from the end into pieces of ``capacity``,
   so that the first piece may be shorter.
2. The lengths of all pieces are counted (at most ``capacity`` distinct lengths, whatever the corpus).
3. Large lengths are dealt to groups of equal cardinality and rounded up to the longest of their group. The
   few-size problem is optimised by configurations: the largest size left is completed by an exact bounded
   subset-sum over the sizes left, and the configuration found is used as often as its sizes last.
4. Actual pieces take the places of the rounded ones, longest first, which leaves a little room in each
   sequence; small pieces go into that room by best fit, then the emptiest sequences are opened anew.

The plan (steps 3 and 4) works on counts, so its size depends on ``capacity`` alone; pieces find their place by
their number among the pieces of their length. That number is the count of such pieces in earlier parts plus
their number in their own part, so no task holds all pieces of a length.

Defined results: a null or empty text is the end id alone (one piece); repeated rows each get their pieces;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetloom.llm.common import stored, table, text_of, tidy

CAPACITY = 1024
END_ID = 2
GROUPS = 512
SMALL = 32
CACHE_WORDS = 250_000


def _byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str):
    """The byte-level vocabulary of a tokenizers file as a rank encoder: the ids are the library's, found faster."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


class _Words(dict):
    """' word' -> its ids as little-endian uint32 bytes. None: white space at an end, so not encoded apart."""

    def __init__(self, path: str):
        super().__init__()
        self.path, self.encode = path, load(path).encode

    def library(self, text: str) -> list[int]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        alone = not word or word[0].isspace() or word[-1].isspace()
        found = self[word] = None if alone else self.packed(" " + word)
        return found

    def packed(self, text: str) -> bytes:
        try:
            ids = self.encode(text, allowed_special="all")
        except ValueError:  # its pattern gives up on very long white space, which the library's doesn't
            ids = self.library(text)
        return np.asarray(ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """A space between two other characters always begins a pre-token, so words can be encoded one by one."""
        words = text.split(" ")
        try:
            return self.packed(words[0]) + b"".join(map(self.__getitem__, words[1:]))
        except TypeError:
            return self.packed(text)


_WORKER: dict = {}


def _words(path: str) -> _Words:
    if path not in _WORKER:
        _WORKER[path] = _Words(path)
    return _WORKER[path]


def subset_sum(sizes: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The multiset of ``sizes`` (each at most counts[size] times) that fills ``room`` best."""
    reached: list[tuple[int, int]] = []  # (size, sums reached before it)
    sums, mask = 1, (1 << (room + 1)) - 1
    for s in sizes:
        if s > room:
            continue
        for _ in range(min(counts[s], room // s)):
            reached.append((s, sums))
            more = sums | (sums << s) & mask
            if more == sums:
                reached.pop()
                break
            sums = more
            if sums >> room & 1:
                break
        if sums >> room & 1:
            break
    left, chosen = sums.bit_length() - 1, []
    for s, before in reversed(reached):
        if not before >> left & 1:
            chosen.append(s)
            left -= s
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL):
    """Runs of equal sequences: a list of (number of sequences, the lengths in each), made from counts of lengths."""
    big = {n: c for n, c in histogram.items() if n > small and c}
    tiny = {n: c for n, c in histogram.items() if n <= small and c}
    # groups of equal cardinality, longest first; a length that straddles a border is divided
    share, members, at = max(1, -(-sum(big.values()) // groups)), defaultdict(list), 0
    for n in sorted(big, reverse=True):
        c = big[n]
        while c:
            take = min(c, share - at % share)
            members[at // share].append([n, take])
            at += take
            c -= take
    rounded: dict[int, list] = defaultdict(list)  # rounded size -> [length, count], longest first
    for g in sorted(members):
        rounded[members[g][0][0]] += members[g]
    left = {size: sum(c for _, c in lens) for size, lens in rounded.items()}
    runs: list[tuple[int, list[int]]] = []
    while left:
        order = sorted(left, reverse=True)
        largest = order[0]
        left[largest] -= 1
        use = Counter([largest, *subset_sum([s for s in order if left[s]], left, capacity - largest)])
        left[largest] += 1
        times = min(left[s] // n for s, n in use.items())
        for s, n in use.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        # actual lengths take the places: one queue per place, cut wherever a length runs out
        queues = []
        for s, n in use.items():
            for _ in range(n):
                queue, need = [], times
                while need:
                    length, c = rounded[s][0]
                    take = min(c, need)
                    queue.append([length, take])
                    need -= take
                    rounded[s][0][1] -= take
                    if not rounded[s][0][1]:
                        rounded[s].pop(0)
                queues.append(queue if len(queues) % 2 == 0 else queue[::-1])
        while times:
            step = min(q[0][1] for q in queues)
            runs.append((step, [q[0][0] for q in queues]))
            for q in queues:
                q[0][1] -= step
                if not q[0][1]:
                    q.pop(0)
            times -= step
    return _fill(runs, tiny, capacity)


def _fill(runs, tiny: dict[int, int], capacity: int):
    """Small lengths, longest first, by best fit: into the sequences with the least room that suffices."""
    rooms: dict[int, list] = defaultdict(list)
    for count, lengths in runs:
        rooms[capacity - sum(lengths)].append((count, lengths))
    for n in sorted(tiny, reverse=True):
        c = tiny[n]
        while c:
            room = min((r for r in rooms if r >= n and rooms[r]), default=None)
            if room is None:
                fits = capacity // n
                whole, rest = divmod(c, fits)
                rooms[capacity - fits * n].append((whole, [n] * fits)) if whole else None
                rooms[capacity - rest * n].append((1, [n] * rest)) if rest else None
                break
            count, lengths = rooms[room].pop()
            fits = room // n
            whole = min(count, c // fits)
            if whole:
                rooms[room - fits * n].append((whole, lengths + [n] * fits))
                c -= whole * fits
                count -= whole
            if count and c and c < fits:
                rooms[room - c * n].append((1, lengths + [n] * c))
                c, count = 0, count - 1
            if count:
                rooms[room].append((count, lengths))
    return [run for same in rooms.values() for run in same]


def places(runs) -> dict[int, list[tuple[int, int, int, int]]]:
    """Per length, in order of the pieces' numbers: (first number, sequences, first sequence id, offset)."""
    out: dict[int, list] = defaultdict(list)
    number, sequence = Counter(), 0
    for count, lengths in runs:
        offset = 0
        for n in lengths:
            out[n].append((number[n], count, sequence, offset))
            number[n] += count
            offset += n
        sequence += count
    return out


class Packer:
    """Cuts texts into pieces of at most ``capacity`` tokens and packs the pieces of the whole table."""

    def __init__(self, path: str, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS, small: int = SMALL):
        self.path, self.capacity, self.end_id, self.groups, self.small = path, capacity, end_id, groups, small

    def pieces(self, docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
        """One row per piece; part and number: the task that made it and its number there among those of its length."""
        path, capacity, end = self.path, self.capacity, np.uint32(self.end_id).astype("<u4").tobytes()
        plain = docs.select(F.spark_partition_id().alias("part"), F.col(id_column).alias("id"), text_of(text).alias("t"))

        def run(batches):
            words, seen = _words(path), Counter()
            for batch in batches:
                parts, keys, texts = batch.columns
                for at in range(0, len(texts), 512):
                    rows, of = [], []
                    for i, t in enumerate(texts.slice(at, 512).to_pylist(), at):
                        ids = (words.ids(t) if t else b"") + end
                        n = len(ids) // 4
                        cut = list(range(n, 0, -capacity))[::-1]
                        start = 0
                        for k, stop in enumerate(cut):
                            size = stop - start
                            of.append(i)
                            rows.append((k, start, size, zlib.crc32(ids[4 * start : 4 * stop]), seen[size]))
                            seen[size] += 1
                            start = stop
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
                    take = pa.array(of, pa.int32())
                    yield pa.RecordBatch.from_arrays([parts.take(take), keys.take(take), *columns], ["part", "id", "piece", "start", "length", "ids_crc32", "number"])

        kind = docs.schema[id_column].dataType.simpleString()
        return plain.mapInArrow(tidy(run), f"part int, id {kind}, piece int, start long, length long, ids_crc32 long, number long")

    def pack(self, docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
        """``id_column``, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
        made = stored(self.pieces(docs, text, id_column))
        counts = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
        histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
        by_length = places(plan(histogram, self.capacity, self.groups, self.small))
        earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("before"))
        shared = made.sparkSession.sparkContext.broadcast({n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in by_length.items()})

        def settle(batches):
            for batch in batches:
                length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy() + batch.column("before").to_numpy()
                sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
                for n in np.unique(length):
                    at = np.flatnonzero(length == n)
                    first, _, ids, offsets = shared.value[int(n)]
                    run = np.searchsorted(first, number[at], "right") - 1
                    sequence[at], offset[at] = ids[run] + number[at] - first[run], offsets[run]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

        kind = docs.schema[id_column].dataType.simpleString()
        numbered = made.join(before, ["part", "length"])
        return numbered.mapInArrow(tidy(settle), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_column)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return Packer(public_tokenizers.path("byte_bpe_50k.json")).pack(table(spark, sf_dir, "documents"))


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLES = {}
