"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Texts with equal n-gram sets are one row of the incidence (told by 128-bit signatures). Its product with its
transpose is computed block by block, a block being the rows that hold an n-gram, and only where a pair can
still reach the threshold t; what is smaller by its sizes is never accumulated:

* sizes: 100 * smaller >= 100 t * larger;
* prefix: with n-grams ordered rare first, a pair over the threshold shares an n-gram among the first
  ``n - ceil(t n) + 1`` of both rows, and ``EXTRA`` of them among the first ``n - ceil(t n) + EXTRA``. Overlap counts
  are accumulated over those columns of the matrix, and pairs below the bound are discarded.

An n-gram is common if at least ``COMMON`` texts hold one of its fingerprint, of 32 to 48 bits: 15 more than the number of
rows has, so that fingerprints outnumber n-grams at any size. These counts cover the corpus; tasks send sorted fingerprints
as compressed differences, 2 to 4 bytes each, with counts up to 65,535, beyond which they stay
there: the order of n-grams has to be one for all texts, not exact. The at most ``MAX_COMMON`` most frequent ones are
broadcast. Blocks of other n-grams thus hold fewer than ``COMMON`` rows and give all their pairs; where the table could not
hold all common ones, the blocks are counted, and larger ones are treated as those of common n-grams. Blocks of common
n-grams, which stand in a prefix only of a text that is made of them, are joined with one pivot for each size class
first, the row with the fewest rare n-grams. After that, only pairs of different components are left to try. The first
n-gram that such a pair shares, in the order of all, stands in both prefixes, at places i and j (else it gave a pair
above), so the two share ``min(n - i, m - j)`` at most; all pairs where this reaches the overlap that the threshold asks for
are tried.

Every candidate is verified on the whole sets. Links connect rows; the result is a component per text.

Links are counted exactly. Only a pair whose rows both hold a common n-gram in their prefix may have gone untried, and
if it is a link, both lie in one component. So after the components stand, all pairs of such rows of a component are
counted on whole sets: rows are dealt to blocks by component and size class, and each two blocks that can hold a link
are one product of incidence matrices, of which only sums per row are kept. Other links are those that were verified.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; with fewer words
than n, the whole sequence is the one n-gram; repeated rows are linked; an empty table gives an empty result;
other columns are ignored. A null id is a component of its own row's text like any other, with the least non-null id.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import Scratch, forget, hot_keys, numbered, spread_join, stored, table, text_of, tidy
from facetloom.llm.components import components
from facetloom.llm.shingles import sets, signature

WIDTH, PERCENT, EXTRA = 3, 90, 4
COMMON, MAX_COMMON = 24, 2_000_000
FLUSH, MERGE, ROWS_PER_SHARD = 1_000_000, 500_000, 1_000  # a Python worker holds some tens of MB of fingerprints
BLOCK_ROWS, BLOCK_GRAMS, SLICE = 512, 1_000_000, 4096
BROADCAST_IDS = 1_000_000
LEAST_BITS, MOST_BITS, MOST = 32, 48, 65_535
PAIRS_PER_TASK = 2_000
CELL_ROWS = 256  # a cell's other side is one pivot, so that it costs next to nothing to deal a cell to many tasks


def _pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    counts = np.minimum(counts, MOST).astype("<u2")
    planes = steps.view(np.uint8).reshape(-1, 8).T[:6].tobytes() + counts.view(np.uint8).reshape(-1, 2).T.tobytes()
    return len(values).to_bytes(8, "little") + len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[16:], int.from_bytes(blob[8:16], "little"), "zstd", asbytes=True), np.uint8)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :6] = planes[: 6 * n].reshape(6, n).T
    counts = np.ascontiguousarray(planes[6 * n :].reshape(2, n).T).view("<u2").ravel()
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64), counts


def _summed(parts):
    """One sorted run of (values, counts); a count stops at ``MOST``. A pair is sorted as one 64-bit number, without an index."""
    both = np.concatenate([(v << np.uint64(16)) | c.astype(np.uint64) for v, c in parts])
    both.sort()
    counts = both.astype(np.uint16)
    both >>= np.uint64(16)
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    total = np.add.reduceat(counts, first, dtype=np.uint64)
    return both[first], np.minimum(total, np.uint64(MOST)).astype(np.uint16)


def _key(sig: bytes | None) -> int | None:
    """Half of a signature: enough to find candidates by, in rows of fixed width."""
    return None if sig is None else int.from_bytes(sig[:8], "little", signed=True)


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The number of n-grams that each set of ``x`` shares with each of ``y``: a product of incidences, by slices of columns."""
    grams, at = np.unique(np.concatenate(x + y), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in x + y])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    out = np.zeros((len(x), len(y)), np.int64)
    for first in range(0, len(grams), SLICE):
        a, b = np.searchsorted(at, (first, first + SLICE))
        held = np.zeros((len(x) + len(y), min(SLICE, len(grams) - first)), np.float32)
        held[row[a:b], at[a:b] - first] = 1
        out += (held[: len(x)] @ held[len(x) :].T).astype(np.int64)
    return out


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold. Their overlap is accumulated slice by slice of the columns; the pair is
    given up as soon as what is left of the smaller can't reach the bound that the sizes set."""
    least = -(-percent * (len(x) + len(y)) // (100 + percent))
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    shared = 0
    for lo in range(0, len(x), SLICE):
        if shared + len(x) - lo < least:
            return False
        part = x[lo : lo + SLICE]
        at = np.searchsorted(y, part)
        shared += int((y[np.minimum(at, len(y) - 1)] == part).sum())
    return shared >= least


def _fingerprints(s: np.ndarray, bits: int) -> np.ndarray:
    return s >> np.uint64(64 - bits)


class NgramJoin:
    def __init__(self, width: int = WIDTH, percent: int = PERCENT, extra: int = EXTRA, common: int = COMMON, max_common: int = MAX_COMMON):
        self.width, self.percent, self.extra, self.common, self.max_common = width, percent, extra, common, max_common

    def _rows(self, docs: DataFrame, id_column: str, text: str) -> DataFrame:
        return docs.select(F.col(id_column).alias("id"), text_of(text).alias("t"))

    def _signed(self, docs: DataFrame, shards_log2: int, bits: int, id_type: str) -> DataFrame:
        """Per text its signature and set size; and per task the fingerprints of its sets, cut in shards."""
        width, shift = self.width, bits - shards_log2

        def packed(held, key_type):
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            shards = (values >> np.uint64(shift)).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))
            blobs = [_pack(values[a:b], counts[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(values)))]
            nulls = [pa.nulls(len(cuts), kind) for kind in (key_type, pa.int64(), pa.binary(), pa.int64())]
            return pa.RecordBatch.from_arrays([*nulls, pa.array(shards[cuts], pa.int32()), pa.array(blobs, pa.binary())], names)

        names = ["id", "n", "sig", "key", "shard", "blob"]

        def run(batches):
            held, n_held, key_type = [], 0, None
            for batch in batches:
                key_type = batch.column(0).type
                for at, chunk in sets(batch.column(1), width):
                    k = len(chunk)
                    sigs = [signature(s) for s in chunk]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, k), pa.array([len(s) for s in chunk], pa.int64()), pa.array(sigs, pa.binary()), pa.array([_key(x) for x in sigs], pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
                    held += [_fingerprints(s, bits) for s in chunk]
                    n_held += sum(map(len, chunk))
                    if n_held > FLUSH:
                        yield packed(held, key_type)
                        held, n_held = [], 0
            if n_held:
                yield packed(held, key_type)

        return docs.mapInArrow(tidy(run), f"id {id_type}, n long, sig binary, key long, shard int, blob binary")

    def _common(self, blobs: DataFrame, shards: int):
        """Sorted fingerprints of common n-grams and their counts, at most ``max_common``; and whether these are all."""
        least = self.common

        def run(batches):
            held: dict[int, list] = {}
            size = 0
            for batch in batches:
                for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    part = _unpack(blob)
                    held.setdefault(shard, []).append(part)
                    size += len(part[0])
                    if size > MERGE:
                        for k in held:
                            held[k] = [_summed(held[k])]
                        size = 0
            for parts in held.values():
                values, counts = _summed(parts)
                at = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(values[at].astype(np.int64)), pa.array(counts[at].astype(np.int64))], ["f", "c"])

        counted = stored(blobs.repartition(shards, "shard").mapInArrow(tidy(run), "f long, c long"))
        power = F.floor(F.log2("c"))
        by_size = sorted(counted.groupBy(power.alias("k")).count().collect(), key=lambda r: -r[0])
        total, chosen, complete = 0, F.lit(False), True
        for k, n in by_size:  # whole powers of two, the most frequent first, while they fit, then a part of one
            fit = self.max_common - total
            chosen = chosen | ((power == k) & (F.pmod("f", F.lit(-(-n // max(fit, 1)))) == 0 if n > fit else F.lit(True)) & F.lit(fit > 0))
            total, complete = total + min(n, fit), complete and n <= fit
            if not complete:
                break
        rows = counted.where(chosen).orderBy("f").toPandas()
        forget(counted)
        return rows["f"].to_numpy(np.uint64), rows["c"].to_numpy(np.int32), complete

    def _prefixes(self, docs: DataFrame, common, bits: int) -> DataFrame:
        """(h, key, n, c, r, hot, sig, i): the first n-grams of each distinct set; c: common ones among its longer prefix, r: rare
        ones of all, i: the n-gram's place; sig stands in the rows of common n-grams only."""
        width, percent, extra = self.width, self.percent, self.extra
        shared = docs.sparkSession.sparkContext.broadcast(common[:2])

        def run(batches):
            values, counts = shared.value
            seen: set = set()
            for batch in batches:
                for _, chunk in sets(batch.column(1), width):
                    out = []
                    for s in chunk:
                        sig, n = signature(s), len(s)
                        if sig is None or sig in seen:
                            continue
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(sig)
                        fp = _fingerprints(s, bits)
                        at = np.searchsorted(values, fp)
                        weight = np.where((at < len(values)) & (values[np.minimum(at, len(values) - 1)] == fp), counts[np.minimum(at, len(values) - 1)], 0) if len(values) else np.zeros(n, np.int64)
                        base = n - -(-percent * n // 100) + 1
                        order = np.argsort(weight, kind="stable")[: min(n, base + extra - 1)]
                        hot = weight[order] > 0
                        at = np.flatnonzero(~hot | (np.arange(len(order)) < base))
                        use = order[at]
                        out.append((s[use].view(np.int64), _key(sig), n, int(hot.sum()), int((weight == 0).sum()), sig, weight[use] > 0, at))
                    if out:
                        sizes = np.array([len(o[0]) for o in out])
                        row = pa.array(np.repeat(np.arange(len(out)), sizes))
                        columns = [pa.array(np.concatenate([o[0] for o in out])), *(pa.array([o[i] for o in out], kind).take(row) for i, kind in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()))), pa.array(np.concatenate([o[6] for o in out]))]
                        sigs = pa.array([o[5] for o in out], pa.binary()).take(pc.if_else(columns[-1], row, pa.scalar(None, row.type)))
                        places = pa.array(np.concatenate([o[7] for o in out]), pa.int32())
                        yield pa.RecordBatch.from_arrays([*columns, sigs, places], ["h", "key", "n", "c", "r", "hot", "sig", "i"])

        return docs.mapInArrow(tidy(run), "h long, key long, n int, c int, r int, hot boolean, sig binary, i int")

    def _large_blocks(self, pre: DataFrame, owners: DataFrame) -> DataFrame:
        """``pre`` where the blocks that the table could not tell, but that hold ``common`` rows, are those of common n-grams."""
        rare = pre.where("NOT hot")
        large = stored(rare.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= self.common).select("h", F.lit(True).alias("large")))
        told = stored(spread_join(rare, large, "h", hot_keys(rare, "h"), ["key"]).select("h", "key", "n", "c", "r", "i"))
        more = stored(told.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("more")))
        named = told.join(owners.select("key", F.col("sig").alias("s")), "key").select("h", "key", "n", "c", "r", F.lit(True).alias("hot"), F.col("s").alias("sig"), "i")
        others = rare.join(told.select("h", "key"), ["h", "key"], "left_anti").unionByName(pre.where("hot")).unionByName(named)
        return stored(others.join(more, "key", "left").withColumn("c", F.col("c") + F.coalesce("more", F.lit(0))).select(*pre.columns))

    def _sizes_fit(self, a, b):
        return (100 * F.least(a, b) >= self.percent * F.greatest(a, b))

    def _rare_pairs(self, rare: DataFrame) -> DataFrame:
        """All pairs of the blocks of n-grams that aren't common, by accumulated overlap."""
        # most n-grams stand in one text: rows of two and a half longs are shuffled as they are, not as sets of one
        dealt = rare.select("h", "key", F.shiftleft(F.col("n").cast("long"), 31).bitwiseOR(F.col("c").cast("long")).alias("nc")).repartition("h")
        blocks = dealt.groupBy("h").agg(F.collect_set(F.struct("key", "nc")).alias("rows")).where(F.size("rows") > 1)
        blocks = blocks.select(F.transform("rows", lambda x: F.struct(x["key"].alias("key"), F.shiftright(x["nc"], 31).alias("n"), x["nc"].bitwiseAND(F.lit((1 << 31) - 1)).alias("c"))).alias("rows"))
        pairs = F.flatten(F.transform("rows", lambda x, i: F.transform(F.filter("rows", lambda y: (x["key"] < y["key"]) & self._sizes_fit(x["n"], y["n"])), lambda y: F.struct(x.alias("x"), y.alias("y")))))
        each = blocks.select(F.explode(pairs).alias("p")).select(F.col("p.x.key").alias("a"), F.col("p.y.key").alias("b"), F.col("p.x.n").alias("na"), F.col("p.y.n").alias("nb"), F.least("p.x.c", "p.y.c").alias("c"))
        overlap = each.groupBy("a", "b", "na", "nb", "c").agg(F.count(F.lit(1)).alias("shared"))
        least = F.ceil(self.percent * (F.col("na") + F.col("nb")) / (100 + self.percent))
        return overlap.where(F.col("shared") >= F.greatest(F.lit(1), F.least(F.lit(self.extra), least) - F.col("c"))).select("a", "b")

    def _pivot_pairs(self, hot: DataFrame) -> DataFrame:
        """Of a common n-gram's block, each row with the first of its size class."""
        classed = hot.select("key", "r", F.struct("h", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / self.percent)).alias("k")).alias("cell"))
        pivots = classed.groupBy("cell").agg(F.min(F.struct("r", "key")).alias("p")).select("cell", F.col("p.key").alias("b"))
        return spread_join(classed, pivots, "cell", hot_keys(classed, "cell", CELL_ROWS), ["key"]).where("key <> b").select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct()

    def _cross_pairs(self, hot: DataFrame, found: DataFrame) -> DataFrame:
        """Of common n-grams' blocks, the pairs that lie in different components still."""
        labelled = stored(hot.join(found.select(F.col("node").alias("sig"), "root"), "sig", "left").select("h", "key", "n", "i", F.coalesce("root", "sig").alias("root")))
        mixed = labelled.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
        rows = stored(labelled.join(mixed, "h"))
        if rows.isEmpty():
            return rows.select(F.col("key").alias("a"), F.col("key").alias("b"))
        other = rows.select("h", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("root").alias("rb"))
        reach = (100 + self.percent) * F.least(F.col("n") - F.col("i"), F.col("nb") - F.col("ib")) >= self.percent * (F.col("n") + F.col("nb"))
        return rows.join(other, "h").where((F.col("key") < F.col("b")) & (F.col("root") != F.col("rb")) & self._sizes_fit(F.col("n"), F.col("nb")) & reach).select(F.col("key").alias("a"), "b").distinct()

    def _sets(self, pairs: DataFrame, owners: DataFrame, docs: DataFrame) -> DataFrame:
        """(key, sig, grams) of the rows that stand in ``pairs``, dealt by key."""
        return self._sets_of(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), owners, docs)

    def _sets_of(self, needed: DataFrame, owners: DataFrame, docs: DataFrame) -> DataFrame:
        width = self.width
        ids = stored(needed.join(owners, "key").select(F.col("id").alias("owner")).distinct())
        if ids.count() <= BROADCAST_IDS:  # else the texts are joined by a shuffle
            ids = F.broadcast(ids)

        def run(batches):
            for batch in batches:
                for _, chunk in sets(batch.column(0), width):
                    sigs = [signature(s) for s in chunk]
                    yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in sigs], pa.int64()), pa.array(sigs, pa.binary()), pa.array([s.tobytes() for s in chunk], pa.binary())], ["key", "sig", "grams"])

        made = docs.join(ids, F.col("id").eqNullSafe(F.col("owner"))).select("t").mapInArrow(tidy(run), "key long, sig binary, grams binary")
        return made.where(F.col("key").isNotNull()).repartition("key").dropDuplicates(["key", "sig"])

    def _verified(self, pairs: DataFrame, grams: DataFrame) -> DataFrame:
        """The links among ``pairs`` of keys, as pairs of signatures. ``grams`` is shuffled once: both joins read the same exchange.

        Pairs of rows that have over ``PAIRS_PER_TASK`` of them, as pivots have, are joined apart, dealt to several tasks."""
        percent = self.percent

        def run(batches):
            for batch in batches:
                keep = []
                xs, ys = batch.column("x"), batch.column("y")
                for i in range(batch.num_rows):  # the sets are read where they lie
                    keep.append(_linked(np.frombuffer(xs[i].as_buffer(), np.uint64), np.frombuffer(ys[i].as_buffer(), np.uint64), percent))
                links = batch.select(["sa", "sb"]).filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays(links.columns, ["a", "b"])

        one = grams.select(F.col("key").alias("b"), F.col("sig").alias("sb"), F.col("grams").alias("y"))
        two = grams.select(F.col("key").alias("a"), F.col("sig").alias("sa"), F.col("grams").alias("x"))
        hot_a, hot_b = hot_keys(pairs, "a", PAIRS_PER_TASK), hot_keys(pairs, "b", PAIRS_PER_TASK)
        joined = pairs.join(one, "b").join(two, "a").select("sa", "sb", "x", "y")
        if hot_a is not None or hot_b is not None:
            of = {c: h.select(c, F.lit(True).alias(f"h{c}")) for c, h in (("a", hot_a), ("b", hot_b)) if h is not None}
            marked = reduce(lambda p, c: p.join(F.broadcast(of[c]), c, "left"), of, pairs)
            warm = reduce(lambda x, y: x | y, [F.col(f"h{c}").isNotNull() for c in of])
            few, cold = marked.where(warm).select("a", "b"), marked.where(~warm).select("a", "b")
            some = lambda side, c: side.join(few.select(c).distinct(), c, "left_semi")
            spread = spread_join(spread_join(few, some(one, "b"), "b", hot_b, ["a"]), some(two, "a"), "a", hot_a, ["b"])
            joined = cold.join(one, "b").join(two, "a").select(*joined.columns).union(spread.select(*joined.columns))
        return joined.select("sa", "sb", "x", "y").mapInArrow(tidy(run), "a binary, b binary")

    def _hot_degrees(self, hot: DataFrame, found: DataFrame, owners: DataFrame, docs: DataFrame) -> DataFrame:
        """(sig, links): for rows of common n-grams, all links among them, counted block by block within components."""
        percent = self.percent
        members = hot.select("sig", "key", "n").distinct().join(found.select(F.col("node").alias("sig"), "root"), "sig")
        alone = members.groupBy("root").count().where("count > 1").select("root")
        # classes are a little wider than the threshold, so two rows whose sizes fit lie at most one class apart
        width = 1.001 * math.log(100 / percent) if percent < 100 else 1e-9
        classed = stored(members.join(alone, "root").withColumn("k", F.floor(F.log(F.col("n").cast("double")) / width)).withColumn("cell", F.struct("root", "k")))
        if classed.isEmpty():
            return classed.select("sig", F.lit(0).cast("long").alias("links"))
        rows_of = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(BLOCK_GRAMS / F.exp((F.col("k") + 1) * width)))).cast("long")
        dealt = stored(numbered(classed, "cell", ["sig"], "number").select("sig", "key", "root", "k", F.floor(F.col("number") / rows_of).alias("i")))
        grams = self._sets_of(dealt.select("key").distinct(), owners, docs).select("sig", "grams")

        def block(table: pa.Table) -> pa.Table:
            sets_, sigs = table.column("grams").to_pylist(), table.column("sig").to_pylist()
            raw = b"".join(sets_)
            one = [table.column(c)[0].as_py() for c in ("root", "k", "i")]
            return pa.table({"root": pa.array(one[:1], pa.binary()), "k": pa.array(one[1:2], pa.int64()), "i": pa.array(one[2:], pa.int64()), "sigs": pa.array([sigs], pa.list_(pa.binary())), "sizes": pa.array([[len(s) // 8 for s in sets_]], pa.list_(pa.int64())), "packed": pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary())})

        blocks = stored(dealt.join(grams, "sig").groupBy("root", "k", "i").applyInArrow(block, "root binary, k long, i long, sigs array<binary>, sizes array<long>, packed binary"))
        one = blocks.select("root", F.col("k").alias("ka"), F.col("i").alias("ia"))
        two = blocks.select("root", F.col("k").alias("kb"), F.col("i").alias("ib"))
        pairs = stored(one.join(two, "root").where("kb = ka AND ib >= ia OR kb = ka + 1"))
        dealt_pairs = pairs.repartition(max(1, min(5_000, pairs.count() // 4)), "root", "ka", "ia", "kb", "ib")
        parts = lambda x: [F.col(c).alias(c + x) for c in ("k", "i", "sigs", "sizes", "packed")]
        joined = dealt_pairs.join(blocks.select("root", *parts("a")), ["root", "ka", "ia"]).join(blocks.select("root", *parts("b")), ["root", "kb", "ib"])
        columns = [c + x for x in "ab" for c in ("sigs", "sizes", "packed")]

        def run(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    sa, na, pa_, sb, nb, pb = (batch.column(c)[r].as_py() for c in columns)
                    unpacked = [np.split(np.frombuffer(pa.decompress(p, 8 * sum(n), "zstd", asbytes=True), np.uint64), np.cumsum(n)[:-1]) for p, n in ((pa_, na), (pb, nb))]
                    same = sa == sb
                    both = _overlaps(*unpacked)
                    linked = 100 * both >= percent * (np.array(na)[:, None] + np.array(nb)[None, :] - both)
                    if same:
                        np.fill_diagonal(linked, False)
                    of, counts = (sa, linked.sum(1)) if same else (sa + sb, np.concatenate([linked.sum(1), linked.sum(0)]))
                    yield pa.RecordBatch.from_arrays([pa.array(of, pa.binary()), pa.array(counts, pa.int64())], ["sig", "links"])

        return joined.select(*columns).mapInArrow(tidy(run), "sig binary, links long")

    def classes(self, docs: DataFrame, text: str = "text", id_column: str = "doc_id", count: bool = True) -> DataFrame:
        """``id_column``, n_shingles, component_id, and with ``count`` n_links of every row: the links to texts with other sets."""
        with Scratch(docs.sparkSession) as made:
            return made.keep(self._classes(docs, text, id_column, count))

    def _classes(self, docs: DataFrame, text: str, id_column: str, count: bool) -> DataFrame:
        rows = self._rows(docs, id_column, text)
        total = docs.count()
        log2 = min(20, max(4, (total // ROWS_PER_SHARD).bit_length()))
        bits = min(MOST_BITS, max(LEAST_BITS, total.bit_length() + 15))
        made = stored(self._signed(rows, log2, bits, docs.schema[id_column].dataType.simpleString()))
        signed = stored(made.where(F.col("shard").isNull()).select("id", "n", "sig", "key"))
        common = self._common(made.where(F.col("shard").isNotNull()).select("shard", "blob"), 1 << log2)
        forget(made)
        owners = stored(signed.where(F.col("sig").isNotNull()).groupBy("sig", "key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))

        pre = stored(self._prefixes(rows, common, bits))
        if not common[2]:
            pre = self._large_blocks(pre, owners)
        hot = stored(pre.where("hot").select("h", "sig", "key", "n", "r", "i").distinct())
        pairs = stored(self._rare_pairs(pre.where("NOT hot")).union(self._pivot_pairs(hot)).distinct())
        forget(pre)
        links = stored(self._verified(pairs, self._sets(pairs, owners, rows)))
        found = components(links)
        more = stored(self._cross_pairs(hot, found))
        if not more.isEmpty():
            links = stored(links.union(self._verified(more, self._sets(more, owners, rows))))
            found = components(links)

        if count:
            of_hot = hot.select("sig").distinct().withColumn("hot", F.lit(True))
            marked = links.join(of_hot.toDF("a", "hot_a"), "a", "left").join(of_hot.toDF("b", "hot_b"), "b", "left")
            other = stored(marked.where("hot_a IS NULL OR hot_b IS NULL").select("a", "b", F.lit(1).cast("long").alias("links")))
            each = other.select(F.col("a").alias("sig"), "links").union(other.select("b", "links")).union(self._hot_degrees(hot, found, owners, rows))
            degree = each.groupBy("sig").agg(F.sum("links").alias("links"))
        else:
            degree = owners.where("false").select("sig", F.lit(0).cast("long").alias("links"))
        rooted = owners.join(found.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        least = rooted.groupBy("root").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("texts"))
        # texts that are alone need no lookup
        rooted = rooted.select("root", "sig", "copies")
        whole = spread_join(rooted, least, "root", hot_keys(rooted, "root"), ["sig"])
        named = whole.join(degree, "sig", "left").where("copies > 1 OR texts > 1").select("sig", "component", "links")
        # the copies of one text are dealt to several tasks; rows without a set meet nothing
        held = signed.where("sig IS NOT NULL").select("id", "n", "sig")
        empty = signed.where("sig IS NULL").select("sig", "id", "n", F.lit(None).cast(dict(named.dtypes)["component"]).alias("component"), F.lit(None).cast("long").alias("links"))
        joined = spread_join(held, named, "sig", hot_keys(held, "sig"), ["id"], "left").select(*empty.columns)
        return joined.unionByName(empty).select(
            F.col("id").alias(id_column),
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "id").alias("component_id"),
            *([F.coalesce("links", F.lit(0)).cast("long").alias("n_links")] if count else []),
        )


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return NgramJoin().classes(table(spark, sf_dir, "documents"))


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
ORACLES = {}
