"""Sharding by histogram sort.

Rows are ordered by a key and cut at splitters into shards of near equal bytes.
The splitters come from rounds of exact histograms: each round counts the bytes
below candidate boundaries (digits of the key) in every partition, adds the
partial counts and keeps, for each splitter, the one digit range that holds its
target; the next round probes inside that range alone. A splitter is done when
a probed boundary is within the tolerance. Then the rows are exchanged once, in
key order.

The key is (hash of the text, hash of the id, hash of the row's place), read as
one number of 180 bits in digits of 12. Equal texts are neighbours. While the
first part is probed no boundary can cut a group of equal texts; a group is cut
only where no edge of it is within ``group_tolerance`` of the target, so that a
group of a third of all rows still spreads. The place is only reached by rows
that are equal in text and id.

Everything is DataFrame expressions. The driver sees at most (shards - 1) x 4096
sums a round, whatever the input. Nulls: a null text counts as empty (size 1),
a null id is a value like others. Empty input gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.scratch import stored

DIGIT = 12
DIGITS = 5
KEY_BITS = DIGIT * DIGITS
KEYS = ("_k1", "_k2", "_k3")
ROW_MASK = (1 << 33) - 1


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size, text_crc32 and the three key parts; no text."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def key(*columns: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*columns), 64 - KEY_BITS)

    return df.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text).cast("long") + 1).alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        key(text).alias("_k1"),
        key(F.col(id_col), F.lit("id")).alias("_k2"),
        key(F.monotonically_increasing_id()).alias("_k3"),
    )


def _parts(number: int) -> list[int]:
    """The three key parts of a boundary of 180 bits."""
    mask = (1 << KEY_BITS) - 1
    return [number >> (2 * KEY_BITS), (number >> KEY_BITS) & mask, number & mask]


def _histogram(keys: DataFrame, level: int, prefixes: list[int]) -> dict[int, list]:
    """For each prefix of ``level`` digits: (digit, bytes, rows) of its rows."""
    part, inside = divmod(level, DIGITS)
    shift = KEY_BITS - DIGIT * (inside + 1)
    digit = F.shiftrightunsigned(F.col(KEYS[part]), shift).bitwiseAND((1 << DIGIT) - 1)

    def under(prefix: int) -> Column:
        tests = []
        rest = prefix >> (DIGIT * inside)
        for name in reversed(KEYS[:part]):
            tests.append(F.col(name) == (rest & ((1 << KEY_BITS) - 1)))
            rest >>= KEY_BITS
        if inside:
            head = prefix & ((1 << (DIGIT * inside)) - 1)
            tests.append(F.shiftrightunsigned(F.col(KEYS[part]), shift + DIGIT) == head)
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    which = F.coalesce(*[F.when(under(p), F.lit(i)) for i, p in enumerate(prefixes)])
    rows = (
        keys.select(which.alias("p"), digit.alias("d"), "_size")
        .where("p is not null")
        .groupBy("p", "d")
        .agg(F.sum("_size").alias("bytes"), F.count("*").alias("n"))
        .collect()
    )
    out: dict[int, list] = {p: [] for p in prefixes}
    for r in sorted(rows):
        out[prefixes[r["p"]]].append((r["d"], r["bytes"], r["n"]))
    return out


def splitters(keys: DataFrame, shards: int, tolerance: float, group_tolerance: float) -> list[int]:
    """Ascending key boundaries; a row goes to shard i if i of them are at or
    below its key."""
    total = keys.agg(F.sum("_size")).first()[0] or 0
    share = total / shards
    levels = DIGITS * len(KEYS)
    done: dict[int, int] = {}
    open_ = {i: (0, 0) for i in range(1, shards)} if total else {}
    level = 0
    while open_:
        bins = _histogram(keys, level, sorted({p for p, _ in open_.values()}))
        left = levels - level - 1
        following = {}
        for i, (prefix, below) in open_.items():
            target = share * i
            for digit, size, rows in bins[prefix]:
                if below + size > target:
                    break
                below += size
            low, high = target - below, below + size - target
            bound = (prefix << DIGIT) | digit
            near = (bound if low <= high else bound + 1) << (DIGIT * left)
            group = level + 1 == DIGITS  # a bin is now one group of equal texts
            enough = share * (group_tolerance if group else tolerance)
            if min(low, high) <= enough or rows == 1 or not left:
                done[i] = near
            else:
                following[i] = (bound, below)
        open_, level = following, level + 1
    return [done[i] for i in sorted(done)]


def at_or_above(boundary: int) -> Column:
    """Whether a row's key is at or above the boundary."""
    a, b, c = _parts(boundary)
    k1, k2, k3 = (F.col(k) for k in KEYS)
    return (k1 > a) | ((k1 == a) & ((k2 > b) | ((k2 == b) & (k3 >= c))))


def shard_by_bytes(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 16,
    tolerance: float = 0.001,
    group_tolerance: float = 0.02,
) -> DataFrame:
    """id, size, text_crc32, shard and slot of every row.

    Tolerances are shares of a shard's bytes. Slots count from 0 without gaps
    in key order within each shard.
    """
    keys = stored(keyed(df, id_col, text_col), "shard-keys")
    cuts = splitters(keys, shards, tolerance, group_tolerance)
    shard = reduce(lambda a, b: a + b, [at_or_above(c).cast("int") for c in cuts], F.lit(0))
    ranged = stored(
        keys.repartitionByRange(*KEYS)
        .sortWithinPartitions(*KEYS)
        .select(
            "_id",
            "_size",
            "_crc",
            shard.alias("shard"),
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(ROW_MASK).alias("_row"),
        ),
        "shard-rows",
    )
    # one row for each partition and shard that meet: partitions + shards at most
    runs = ranged.groupBy("_part", "shard").agg(
        F.min("_row").alias("_first"), F.count("*").alias("_n")
    )
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "_part",
        "shard",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"),
    )
    return ranged.join(F.broadcast(runs), ["_part", "shard"]).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        "shard",
        (F.col("_row") + F.col("_base")).alias("slot"),
    )
