"""Splits that keep related records together (problem 7).

Vessels are the connected components of the graph of numbers and the IMO numbers and call signs they
gave. Components come from parallel hooking and shortcutting over parent arrays kept as tables: each
round hooks every root to the smallest root seen through a shared identifier, shortcuts the hooks by
pointer jumping, and rewrites the edges in terms of roots, so edges shrink every round. Splits are
chosen by subset-sum bitsets over the multiplicities of component sizes.

Defined results: null numbers are ignored; null or empty lists give no pairs; identifiers that are
blank, a word for none, or one repeated character say nothing; a number without identity is its own
component; repeated rows change nothing; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.session import write_table

#: Words that stand for no identifier, after removal of everything but letters and digits.
NO_VALUE = ["NONE", "UNKNOWN", "UNKN", "UNK", "NA", "NAN", "NULL", "NIL", "NOTSET", "NOTAVAILABLE", "NOTKNOWN", "NOCALLSIGN", "UNDEFINED", "TBD", "TBA", "MISSING", "EMPTY", "TEST"]


def imo_key(imo: Column) -> Column:
    """The seven digits of an IMO number, or null."""
    digits = F.regexp_replace(imo, "[^0-9]", "")
    return F.when(digits.rlike("^[0-9]{7}$") & ~digits.rlike(r"^(.)\1*$"), F.concat(F.lit("i"), digits))


def callsign_key(callsign: Column) -> Column:
    """Upper-case letters and digits of a call sign, or null."""
    text = F.upper(F.regexp_replace(callsign, "[^0-9A-Za-z]", ""))
    return F.when((text != "") & ~text.rlike(r"^(.)\1*$") & ~text.isin(NO_VALUE), F.concat(F.lit("c"), text))


def identity_edges(identity: DataFrame) -> DataFrame:
    keys = identity.filter(F.col("mmsi").isNotNull()).select("mmsi", F.explode(F.array(imo_key(F.col("imo")), callsign_key(F.col("callsign")))).alias("key"))
    return keys.filter(F.col("key").isNotNull()).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(mmsi, root) of every number in edges (mmsi, key); root is the smallest number of its component.

    Every round takes away at least half of the roots that share an identifier with a smaller one, so it ends.
    """
    edges = write_table(edges.select(F.col("mmsi").alias("node"), "key"), "edges")
    parent = edges.select(F.col("node").alias("mmsi"), F.col("node").alias("root")).distinct()
    while True:
        # Hook: the smallest root seen through each identifier; pre-aggregated per key.
        least = edges.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
        hooks = write_table(edges.join(least.select("key", "least"), "key").groupBy("node").agg(F.min("least").alias("up")).filter("up < node"), "hooks")
        if hooks.isEmpty():
            return parent
        while True:  # Shortcut: pointer jumping halves the height of every tree.
            nxt = hooks.alias("h").join(hooks.select(F.col("node").alias("n2"), F.col("up").alias("up2")), F.col("h.up") == F.col("n2"), "left")
            jumped = write_table(nxt.select("node", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved")), "jump")
            hooks = jumped.select("node", "up")
            if jumped.filter("moved").isEmpty():
                break
        relabel = hooks.select(F.col("node").alias("__n"), F.col("up").alias("__u"))
        edges = write_table(edges.join(relabel, F.col("node") == F.col("__n"), "left").select(F.coalesce("__u", "node").alias("node"), "key").distinct(), "edges")
        parent = write_table(parent.join(relabel, F.col("root") == F.col("__n"), "left").select("mmsi", F.coalesce("__u", "root").alias("root")), "parent")


def found_leaks(runs: DataFrame, identity: DataFrame) -> DataFrame:
    """For each run every two numbers of one vessel on different sides; a number on both sides pairs with itself."""
    roots = connected_components(identity_edges(identity))

    def side(col: str, out: str) -> DataFrame:
        nums = runs.select("run_id", F.explode(F.array_distinct(col)).alias(out)).filter(F.col(out).isNotNull()).distinct()
        return nums.join(roots.withColumnRenamed("mmsi", "__m"), F.col(out) == F.col("__m"), "left").select("run_id", out, F.coalesce("root", out).alias("root"))

    pairs = side("train_mmsis", "tr").join(side("test_mmsis", "te"), ["run_id", "root"])
    return pairs.select("run_id", F.least("tr", "te").alias("mmsi_a"), F.greatest("tr", "te").alias("mmsi_b")).distinct()


def choose_counts(sizes: dict[int, int], target: int, unit: int = 1) -> dict[int, int]:
    """How many components of each size to take so that their total is as close to target as can be (ties: below).

    Subset sums as one bitset per item; a multiplicity is cut into powers of two, so an item stands for several
    components of one size. An item weighs its rows to the nearest unit. Bitsets are kept at about the square root
    of their number of places and made again from these on the way back.
    """
    items: list[tuple[int, int, int]] = []
    for size, n in sorted(sizes.items(), reverse=True):
        chunk = 1
        while n > 0:
            take = min(chunk, n)
            items.append((size, take, (2 * size * take + unit) // (2 * unit)))
            n -= take
            chunk *= 2
    aim = (2 * target + unit) // (2 * unit)
    mask = (1 << (2 * aim + 1)) - 1
    every = max(1, math.isqrt(len(items)))

    def onward(bits: int, part: list[tuple[int, int, int]]) -> Iterator[int]:
        for *_, weight in part:
            bits = (bits | (bits << weight)) & mask
            yield bits

    kept, bits = [1], 1
    for k, bits in enumerate(onward(1, items), 1):
        if k % every == 0:
            kept.append(bits)
    best = (bits & ((1 << (aim + 1)) - 1)).bit_length() - 1
    above = bits >> (aim + 1)
    if above:
        up = aim + 1 + ((above & -above).bit_length() - 1)
        if up - aim < aim - best:
            best = up
    taken: dict[int, int] = {}
    for block in range(-(-len(items) // every) - 1, -1, -1):
        part = items[block * every : (block + 1) * every]
        reach = [kept[block], *onward(kept[block], part)]
        for k in range(len(part) - 1, -1, -1):
            size, take, weight = part[k]
            if not reach[k] >> best & 1:
                taken[size] = taken.get(size, 0) + take
                best -= weight
    return taken


def choose_split(sizes: dict[int, int], target: int, max_units: int) -> dict[int, int]:
    """choose_counts over rows; where target is above max_units rows, in units first and then to the row.

    The smallest components, of about twice the rows that rounding to units can amount to, are held back; the others
    are chosen in units for what the held-back ones leave half open, and these settle the rest in rows.
    """
    unit = max(1, -(-target // max_units))
    if unit == 1:
        return choose_counts(sizes, target)
    items = sum(n.bit_length() + 1 for n in sizes.values())
    hold, rest, held = {}, {}, 0
    for size, n in sorted(sizes.items()):
        take = min(n, max(0, -(-(items * unit - held) // size)))
        if take:
            hold[size] = take
            held += take * size
        if n > take:
            rest[size] = n - take
    taken = choose_counts(rest, max(0, target - held // 2), unit)
    left = target - sum(s * n for s, n in taken.items())
    for s, n in (choose_counts(hold, left) if left > 0 else {}).items():
        taken[s] = taken.get(s, 0) + n
    return taken


def assign_splits(rows: DataFrame, roots: DataFrame, *, shares: dict[str, float], max_units: int = 1 << 21, buckets: int = 1024) -> DataFrame:
    """Every row of rows (with mmsi) gets a split; all rows of one vessel get the same one.

    Rows of a null number form one component. Only the histogram of component sizes reaches the driver;
    it has at most sqrt(2 * rows) entries. Splits of more than max_units rows are chosen in units of rows first
    and settled to the row with the smallest components. Which components of a size go where follows a hash of the root; ranks are made from bucket counts, so no
    task holds all components of a size.
    """
    labelled = rows.join(roots.withColumnRenamed("mmsi", "__m"), F.col("mmsi") == F.col("__m"), "left").withColumn("vessel", F.coalesce("root", "mmsi", F.lit(-1))).drop("__m", "root")
    sizes = write_table(
        labelled.groupBy("vessel").agg(F.count("*").alias("size")).withColumn("bucket", F.pmod(F.xxhash64("vessel"), F.lit(buckets)).cast("int")), "sizes"
    )
    hist_rows = sizes.groupBy("size").agg(F.count("*").alias("n")).collect()
    total = sum(r["size"] * r["n"] for r in hist_rows)
    left = {r["size"]: r["n"] for r in hist_rows}
    quota: dict[str, dict[int, int]] = {}
    names = sorted(shares, key=shares.get)
    for name in names[:-1]:
        quota[name] = choose_split({s: n for s, n in left.items() if n}, round(shares[name] * total), max_units)
        for size, n in quota[name].items():
            left[size] -= n
    spark = rows.sparkSession
    bounds, start = [], {}
    for name in names[:-1]:
        for size, n in quota[name].items():
            lo = start.get(size, 0)
            bounds.append((size, lo, lo + n, name))
            start[size] = lo + n
    bound_df = spark.createDataFrame(bounds, "b_size bigint, lo bigint, hi bigint, split string")
    # Rank of a component within its size: earlier buckets' counts plus its rank within the bucket.
    from pyspark.sql import Window

    counts = sizes.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    inner = F.row_number().over(Window.partitionBy("size", "bucket").orderBy(F.xxhash64("vessel"), "vessel")) - 1
    ranked = sizes.withColumn("inner", inner).join(before.select("size", "bucket", "before"), ["size", "bucket"]).withColumn("rank", F.col("inner") + F.coalesce("before", F.lit(0)))
    placed = ranked.join(F.broadcast(bound_df), (F.col("size") == F.col("b_size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    placed = placed.select("vessel", F.coalesce("split", F.lit(names[-1])).alias("split"))
    return labelled.drop("split").join(placed, "vessel")
