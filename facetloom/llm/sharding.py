"""Sharding by k-d tree partitioning at distributed weighted medians.

Every row is a point of metadata coordinates, scaled to 0..1, and weighs its bytes. A node of the tree is split
along its widest dimension where the weight left of the cut reaches the share of its left leaves, until a node
is one leaf of the target bytes. Points with equal coordinates are told apart by the checksum of their text.

Equal texts (same size and checksum) form a group that shares one point, the least of its coordinates:

* a group of over a leaf can't stay in one: it is dealt by id to parts of ``WHOLE`` of a leaf, which follow each other
  in every order, so that it lies in as few leaves as its size asks for, and one more;
* a group of at least ``WHOLE`` of a leaf (there are at most ``shards / WHOLE`` of them) is never cut: at each node it goes, as
  a whole, to the side where it lies, as long as that side has room, else to the other, and the cut among all smaller points
  makes up for it, so that sizes stay near equal;
* smaller groups are points like others.

The cut is found digit by digit: one aggregation per digit counts the weight of each value of the digit (at most
``2 ** DIGIT_BITS`` values a node), so neither a task nor the driver holds the rows of a node.

Law: ``bytes`` (sizes near equal). Defined results: a null text has no bytes (size 1); null metadata is a value of its own, before
all others; repeated rows each get a slot; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import forget, hot_keys, numbered, spread_join, stored, table, text_of

SHARDS = 16
DIGIT_BITS = 12
DIGITS = 5  # coordinate, checksum (12 + 12 + 8 bits of 32), part of a large group
WHOLE = 0.02
TOP = (1 << DIGIT_BITS) - 1


def sides(groups: list[tuple[int, float]], left: float, right: float) -> list[bool]:
    """Which of the groups (weight, place on the node's dimension) go left, where ``left`` and ``right`` bytes are to lie.

    In the order of their places while the left side's share of them lasts; if that overfills a side, the heaviest
    first to the side with more room.
    """
    whole, at, out = sum(w for w, _ in groups), 0.0, [False] * len(groups)
    for i in sorted(range(len(groups)), key=lambda i: (groups[i][1], i)):
        if at + groups[i][0] / 2 <= whole * left / (left + right):
            out[i], at = True, at + groups[i][0]
    if at <= left and whole - at <= right:
        return out
    room = {True: left, False: right}
    for i in sorted(range(len(groups)), key=lambda i: -groups[i][0]):
        out[i] = room[True] / left >= room[False] / right if min(room.values()) >= groups[i][0] else room[True] >= room[False]
        room[out[i]] -= groups[i][0]
    return out


class KdSharder:
    """Splits rows into ``shards`` leaves of near-equal weight. ``dimensions``: name -> numeric expression."""

    def __init__(self, shards: int = SHARDS, dimensions: dict[str, Column] | None = None):
        self.shards, self.dimensions = shards, dimensions
        self.splits: list[dict] = []

    def _points(self, docs: DataFrame, id_column: str, text: str) -> DataFrame:
        dims = self.dimensions or {"lang": F.crc32(F.coalesce(F.col("lang"), F.lit(""))), "source": F.crc32(F.coalesce(F.col("source"), F.lit(""))), "log_chars": F.log1p(F.length(text_of(text)))}
        return docs.select(
            F.col(id_column).alias("id"),
            (F.octet_length(text_of(text)) + 1).cast("long").alias("size"),
            F.crc32(text_of(text).cast("binary")).alias("crc"),
            *[c.cast("double").alias(f"x_{n}") for n, c in dims.items()],
        ).withColumn("text", F.shiftleft("size", 32).bitwiseOR(F.col("crc")))

    def _grouped(self, points: DataFrame, names: list[str], leaf: float) -> tuple[DataFrame, list]:
        """The points with their group's coordinates and number of parts; and the groups that are never cut."""
        groups = points.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), *[F.min(n).alias(n) for n in names]).withColumn("weight", F.col("n") * F.col("size"))
        groups = stored(groups)  # one narrow row a text
        kept = groups.where((F.col("n") > 1) & (F.col("weight") >= leaf * WHOLE) & (F.col("weight") <= leaf)).collect()  # at most shards / WHOLE
        parts = F.when((F.col("n") > 1) & (F.col("weight") > leaf), F.least(F.ceil(F.col("weight") / F.lit(max(leaf * WHOLE, 1.0))), F.lit(TOP + 1))).otherwise(1)
        # a text that is copied very often is dealt to several tasks
        narrow = points.select("text", "id", "size", "crc")
        out = stored(spread_join(narrow, groups.select("text", parts.cast("long").alias("parts"), *names), "text", hot_keys(narrow, "text"), ["id"]))
        forget(groups)
        return out, kept

    def assign(self, docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
        """id, size, crc, shard of every row."""
        self.splits = []
        points = stored(self._points(docs, id_column, text))
        names = [c for c in points.columns if c.startswith("x_")]
        total = points.agg(F.sum("size")).first()[0] or 0
        raw, (points, kept) = points, self._grouped(points, names, total / self.shards)
        forget(raw)
        span = points.agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
        lows = {n: span[f"lo_{n}"] or 0.0 for n in names}
        widths = {n: max((span[f"hi_{n}"] or 0.0) - lows[n], 1e-12) for n in names}
        scaled = [F.when(F.col(n).isNull(), 0).otherwise(F.floor((F.col(n) - F.lit(lows[n])) / F.lit(widths[n]) * (TOP - 1)) + 1).cast("int").alias(n) for n in names]
        place = lambda g, n: 0 if g[n] is None else int((g[n] - lows[n]) / widths[n] * (TOP - 1)) + 1
        uncut = F.col("text").isin([g["text"] for g in kept]) if kept else F.lit(False)
        work = points.where(~uncut).select("id", "size", "crc", *scaled, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
        shifted = lambda c, bits: F.shiftright(c, bits).bitwiseAND(TOP)
        rest = [shifted(F.col("crc"), 20), shifted(F.col("crc"), 8), F.col("crc").bitwiseAND(255), F.col("part")]

        node, active, leaves = F.lit(0), {0: (0, self.shards)}, {}  # node number -> its leaves
        held = {0: list(range(len(kept)))}  # node number -> its uncut groups
        if self.shards == 1:
            leaves[0] = 0
        while active := {k: v for k, v in active.items() if v[1] - v[0] > 1}:
            here = work.withColumn("node", node).where(F.col("node").isin(list(active)))
            spread = {r["node"]: r for r in here.groupBy("node").agg(F.sum("size").alias("w"), *[(F.max(n) - F.min(n)).alias(n) for n in names]).collect()}
            cuts, children = {}, {}
            for k, (lo, hi) in active.items():
                half, weights = (hi - lo) // 2, {i: kept[i]["weight"] for i in held.get(k, [])}
                r = spread.get(k)
                whole = (r["w"] if r else 0) + sum(weights.values())
                dim = max(names, key=lambda n: ((r[n] if r else 0) or 0, n))
                left = whole * half / (hi - lo)
                groups = list(weights)
                goes = sides([(weights[i], place(kept[i], dim)) for i in groups], left, whole - left) if whole else []
                held[2 * k + 1], held[2 * k + 2] = [i for i, g in zip(groups, goes) if g], [i for i, g in zip(groups, goes) if not g]
                if r:
                    cuts[k] = {"dim": dim, "left": left - sum(weights[i] for i in held[2 * k + 1]), "digits": [], "closed": False}
                children[2 * k + 1], children[2 * k + 2] = (lo, lo + half), (lo + half, hi)
            digits = [F.coalesce(*[F.when(F.col("node") == k, F.col(c["dim"])) for k, c in cuts.items()]), *rest] if cuts else []
            for at in range(DIGITS if cuts else 0):
                on_cut = F.lit(False)
                for k, c in cuts.items():
                    same = F.col("node") == k
                    for digit, value in zip(digits, c["digits"]):
                        same = same & (digit == value)
                    on_cut = on_cut | same
                found: dict[int, list] = {k: [] for k in cuts}
                for r in here.where(on_cut).groupBy("node", digits[at].alias("d")).agg(F.sum("size").alias("w")).collect():
                    found[r["node"]].append((r["d"], r["w"]))
                for k, c in cuts.items():
                    pairs, c["closed"] = sorted(found[k]), False
                    for d, w in pairs:
                        if c["left"] < (w / 2 if at == DIGITS - 1 else w) or d == pairs[-1][0]:
                            c["digits"].append(d)
                            c["closed"] = c["left"] >= w / 2
                            break
                        c["left"] -= w
            step = F.col("node")
            for k, c in cuts.items():
                goes_left, before = F.lit(False), F.lit(True)
                for i, (digit, value) in enumerate(zip(digits, c["digits"])):
                    # the point on the cut goes to the right unless most of it belongs to the left
                    goes_left, before = goes_left | (before & ((digit <= value) if i == DIGITS - 1 and c["closed"] else (digit < value))), before & (digit == value)
                step = F.when(F.col("node") == k, F.when(goes_left, 2 * k + 1).otherwise(2 * k + 2)).otherwise(step)
            before, work, first = work, stored(work.withColumn("node", node).withColumn("node", step)), node is not None and not self.splits
            if not first:
                forget(before)
            node = F.col("node")
            self.splits.append({k: (c["dim"][2:], c["digits"]) for k, c in cuts.items()})
            leaves |= {k: v[0] for k, v in children.items() if v[1] - v[0] == 1}
            active = children
        leaf = F.lit(0)
        for k, s in leaves.items():
            leaf = F.when(node == k, s).otherwise(leaf)
        out = work.select("id", "size", "crc", leaf.cast("int").alias("shard"))
        if kept:
            at = {i: leaves[k] for k, groups in held.items() if k in leaves for i in groups}
            where = F.broadcast(points.sparkSession.createDataFrame([(kept[i]["text"], s) for i, s in at.items()], "text long, shard int"))
            out = out.unionByName(points.where(uncut).join(where, "text").select("id", "size", "crc", "shard"))
        return out.withColumnRenamed("id", id_column)


def op2_kd_sharding(spark, sf_dir: str) -> DataFrame:
    rows = KdSharder().assign(table(spark, sf_dir, "documents"))
    slots = numbered(rows, "shard", ["doc_id", "size", "crc"], "slot")
    return slots.select("doc_id", "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_kd_sharding": op2_kd_sharding}
ORACLES = {}
