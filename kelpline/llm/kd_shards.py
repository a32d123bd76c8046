"""Shards from a k-d tree over document metadata.

Documents with equal texts are one unit, weighted by all their bytes; only a
group of more than a share of a shard is dealt into several units of about that
size. The tree splits all units at the median of their bytes along the widest
metadata dimension, then each half likewise, until the leaves have the target
bytes. Medians are found for all nodes of a level together, by distributed
histograms that narrow down on the cut; the driver sees only bounded counts.
Equal values are cut by a hash of the text and then by the unit's number, so a
value that a third of the rows share is split, and no unit is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

#: Buckets of a node's histogram, and rows of a node that the driver reads to end the search for a cut: both are bounds.
BUCKETS, FEW_ROWS = 4096, 4096
#: A group of equal texts of up to this share of a shard stays together; larger ones are dealt into units of about this size.
WHOLE_SHARE = 1 / 32
#: Rows of each group that is numbered by itself.
SLOT_ROWS = 20_000
EDGE = 1 << 62


def _ordered(col: str, kind: str) -> Column:
    """A long that orders as the column does: numbers by value, strings by their first seven bytes."""
    c = F.col(f"`{col}`")
    if kind == "string":
        head = F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 7)), 14, "0")
        return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(-1))
    return F.greatest(F.least(F.coalesce(c.cast("long"), F.lit(-1)), F.lit(EDGE)), F.lit(-EDGE))


def _of(node: Column, values: dict[int, int]) -> Column:
    """The value of a row's node; null for nodes without one."""
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("long"))))[node]


def _find_cuts(rows: DataFrame, dim_of: dict[int, int], half: dict[int, float]) -> dict[int, tuple[int, int, int]]:
    """For each node the (dimension value, text key, unit) up to which rows go left, so that their bytes come nearest to ``half``.

    Histograms of one key narrow down to a few rows, which the driver reads;
    where one value alone has more rows, the next key goes on inside it.
    """
    node = F.col("node")
    keyed = rows.withColumn("k0", F.element_at("dims", _of(node, {n: d + 1 for n, d in dim_of.items()}).cast("int")))
    keys = ("k0", "key_text", "key_id")
    left: dict[int, float] = dict.fromkeys(dim_of, 0)
    fixed: dict[int, list[int]] = {n: [] for n in dim_of}
    span: dict[int, tuple[int, int] | None] = dict.fromkeys(dim_of)
    found: dict[int, tuple[int, int, int]] = {}
    while todo := [n for n in dim_of if n not in found]:
        inside = F.lit(False)
        value = F.lit(None).cast("long")
        for depth, key in enumerate(keys):
            own = [n for n in todo if len(fixed[n]) == depth]
            if not own:
                continue
            here = node.isin(own)
            for k in range(depth):
                here = here & (F.col(keys[k]) == _of(node, {n: fixed[n][k] for n in own}))
            if bounded := [n for n in own if span[n]]:
                here = here & (~node.isin(bounded) | F.col(key).between(_of(node, {n: span[n][0] for n in bounded}), _of(node, {n: span[n][1] for n in bounded})))
            inside = inside | here
            value = F.when(node.isin(own), F.col(key)).otherwise(value)
        part = keyed.filter(inside).select("node", value.alias("v"), "weight", *keys)
        if unknown := [n for n in todo if not span[n]]:
            for r in part.filter(node.isin(unknown)).groupBy("node").agg(F.min("v"), F.max("v")).collect():
                span[r[0]] = (r[1], r[2])
        low = {n: span[n][0] for n in todo}
        width = {n: max(1, -(-(span[n][1] - span[n][0] + 1) // BUCKETS)) for n in todo}
        bucket = F.expr("(v - lo) div width").cast("int")
        table = part.select("node", "v", "weight", _of(node, low).alias("lo"), _of(node, width).alias("width"))
        got = table.groupBy("node", bucket.alias("b")).agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).orderBy("node", "b").collect()
        few = []
        for n in todo:
            own = [r for r in got if r["node"] == n]
            for r in own:
                if left[n] + r["w"] >= half[n] or r is own[-1]:
                    span[n] = (r["least"], r["most"])
                    if r["n"] <= FEW_ROWS:
                        few.append(n)
                    elif r["least"] == r["most"]:
                        fixed[n].append(r["least"])
                        span[n] = None
                        if len(fixed[n]) == len(keys):  # rows alike in all keys stay together
                            found[n] = tuple(fixed[n])
                    break
                left[n] += r["w"]
        if few:
            ends = part.filter(node.isin(few) & F.col("v").between(_of(node, {n: span[n][0] for n in few}), _of(node, {n: span[n][1] for n in few}))).select("node", "weight", *keys).collect()
            for n in few:
                last = None
                for r in sorted((r for r in ends if r["node"] == n), key=lambda r: r[2:]):
                    if last is not None and left[n] + r["weight"] / 2 > half[n]:
                        break
                    left[n] += r["weight"]
                    last = tuple(r[2:])
                found[n] = last
    return found


def kd_leaves(docs: DataFrame, leaves: int = 16, dims: Sequence[str] = ("n_chars", "lang")) -> DataFrame:
    """``docs`` reduced to id, size and text_crc32 with their leaf of a tree of ``leaves`` (a power of two).

    size: the text's UTF-8 bytes plus one (null: one). Null metadata counts as
    the least value; copies whose metadata differ have the least of it;
    dimensions that the table lacks are left out; an empty table gives no rows.
    """
    kinds = dict(docs.dtypes)
    use = [d for d in dims if d in kinds]
    text = F.coalesce(F.col("text"), F.lit(""))
    every = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("weight"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("key_text"),
        F.array(*(_ordered(d, kinds[d]) for d in use)).alias("dims"),
        F.monotonically_increasing_id().alias("row"),
    )
    every = written(every, "kd")
    most = (every.agg(F.sum("weight")).first()[0] or 0) * WHOLE_SHARE / leaves
    large = every.groupBy("key_text").agg(F.sum("weight").alias("all"), F.count("*").alias("n")).filter((F.col("all") > most) & (F.col("n") > 1))
    large = large.select("key_text", F.least(F.ceil(F.col("all") / most), "n").alias("units"))
    every = every.join(F.broadcast(large), "key_text", "left")  # at most leaves / WHOLE_SHARE groups
    every = every.withColumn("key_id", F.coalesce(F.pmod(F.xxhash64("row"), "units"), F.lit(0)).cast("long")).drop("units")
    rows = every.groupBy("key_text", "key_id").agg(F.sum("weight").alias("weight"), F.min("dims").alias("dims")).withColumn("node", F.lit(1))
    rows = written(rows, "kd")
    root: list[int] = []
    for _ in range(leaves.bit_length() - 1):
        ends = (f(F.element_at("dims", i + 1)) for i in range(len(use)) for f in (F.min, F.max))
        stats = rows.groupBy("node").agg(F.sum("weight"), *ends).collect()
        if not stats:
            break
        spread = {r[0]: [r[3 + 2 * i] - r[2 + 2 * i] for i in range(len(use))] for r in stats}
        root = root or spread[1]
        dim_of = {n: max(range(len(use)), key=lambda d: (s[d] / root[d] if root[d] else 0.0, -d)) for n, s in spread.items()}
        cut = _find_cuts(rows, dim_of, {r[0]: r[1] / 2 for r in stats})
        node = F.col("node")
        own = F.array(F.element_at("dims", _of(node, {n: d + 1 for n, d in dim_of.items()}).cast("int")), "key_text", "key_id")
        last = F.array(*(_of(node, {n: c[k] for n, c in cut.items()}) for k in range(3)))
        before = rows
        rows = written(rows.withColumn("node", node * 2 + F.when(own <= last, 0).otherwise(1)), "kd")
        drop_written(before)
    leaf = rows.select("key_text", "key_id", (F.col("node") - leaves).cast("int").alias("shard"))
    return every.join(leaf, ["key_text", "key_id"]).select("doc_id", F.col("weight").alias("size"), "text_crc32", "row", "shard")


def shard_documents(docs: DataFrame, shards: int = 16, dims: Sequence[str] = ("n_chars", "lang")) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: the shards' sizes differ by about a unit. Equal texts
    share a shard unless they are more than ``WHOLE_SHARE`` of one. Slots are numbered in groups of bounded size, whose starts come from their counts.
    """
    placed = written(kd_leaves(docs, shards, dims), "leaves")
    groups = max(32, -(-placed.count() // (shards * SLOT_ROWS)))
    placed = placed.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    counts = placed.groupBy("shard", "grp").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "grp").orderBy(F.col("doc_id").asc_nulls_first(), "row")
    numbered = placed.withColumn("own", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "grp"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
