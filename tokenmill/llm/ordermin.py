"""Near-duplicates by Order MinHash and banded alignment.

A text is its runs of five words, each labelled with how often it came before.
A sketch takes the two runs with the least hash and keeps them in the order of
the text; texts that share such an ordered pair in one of ``BANDS`` sketches are
candidates. Keeping the order and the labels makes the chance of sharing follow
edit similarity rather than the mere sets of runs.

Two texts are linked if their edit similarity on words, 1 - distance / greater
length, is 0.8 or more. The distance is found by an alignment in a band as wide
as that similarity allows (bit vectors, one step a word), after a bound by
common words.

Copies of a text are one node. A group is the nodes that share a sketch and are
of about one length (two staggered scales, so that lengths within the similarity
share a step of one).

1. Every node is verified against the least of its candidates, the least nodes
   of its groups, which settles most copies of one text, however many there are.
2. All those candidates that are not in one class by then are verified.
3. Groups that still hold several classes are compared in full: all pairs of
   different classes whose word counts allow the similarity are verified. The
   bound is exact, so no pair is lost. Of groups of more than ``FEW``, as those of
   a passage that unlike texts share, only the nodes are kept, once each, and
   grouped anew by their rare words: similar texts share one of theirs at about
   the same place (``rare_words``). What is still crowded is dealt into blocks.

Classes are the connected components of the links, and each document gets the
least id of its class, null if no row of it has one.

Ids name documents only at the end: rows with one id, or none, and different
texts are different nodes. A null text counts as empty; empty texts are copies
of each other. Texts of less than five words have one run, all their words. Only
id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import frugal, sub_batches
from tokenmill.llm.components import components
from tokenmill.scratch import new_path, stored, temporary_tables
from tokenmill.sizes import BROADCAST_ROWS, broadcast_if_small

RUN = 5
#: Of pairs just at the similarity, by scattered changes of words, 99 % share a
#: sketch: 37 of 4,000 did not, with 120 bands 45 and with 32 bands 1,138.
BANDS = 128
#: Similarity as a fraction, to compare whole numbers.
SIMILAR = (4, 5)
#: Places of a word profile, and members of a group that are compared at once.
PROFILE = 512
BLOCK = 1024
#: Nodes of small classes in a group that are compared as they are.
FEW = 32
#: Counters behind the order of words, as 1 << COUNTERS, and those of a row.
COUNTERS = 22
COUNTED = 16

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)
SEEDS = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
MOST = np.uint64((1 << 64) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX2
    return x ^ (x >> np.uint64(29))


def labelled_runs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of RUN words, and the same with its label."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - RUN + 1)
    runs = np.zeros(n, dtype=np.uint64)
    for part in (h[i : i + n] for i in range(min(RUN, len(h)))):
        runs = runs * MIX + part
    runs = _mixed(runs)
    return runs, _numbered(runs)


def _numbered(values: np.ndarray) -> np.ndarray:
    """Hashes of values with how often each came before."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    places = np.arange(len(values))
    label = np.empty(len(values), dtype=np.uint64)
    label[order] = places - np.maximum.accumulate(np.where(first, places, 0))
    return values + label * MIX


def word_pairs(words: list[bytes]) -> np.ndarray:
    """Hash of each word with the one before it, as often as it comes."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    return _numbered(_mixed(np.concatenate([[np.uint64(0)], h[:-1]]) * MIX + h))


def rare_grams(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest of a text's ``word_pairs``, so many that two texts of the
    similarity share one of theirs; without those that no other text can have.

    An edit takes two pairs away, so similar texts of at most m words share at
    least m - 2 * (allowed edits) of them, and of two sets in one order that share
    t, the first size - t + 1 of either have one in common. Any counts give such
    an order; that of true ones puts a common passage last."""
    return grams[_rarest(grams, counts, 2)]


def _rarest(grams: np.ndarray, counts: np.ndarray, lost: int) -> np.ndarray:
    """Places of the rarest grams, one more than the allowed edits take away;
    equal ones in the order of the text."""
    count = counts[grams >> np.uint64(64 - COUNTERS)]
    most = lost * len(grams) * (SIMILAR[1] - SIMILAR[0]) // SIMILAR[1] + 1
    first = np.lexsort((grams, count))[:most]
    return first[count[first] > 1]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return _mixed(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)))


def rare_words(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rarest of a text's words, each with its first and its last place among
    those; without words that no other text can have.

    Texts at the similarity, the longer of m words, align but for at most m / 5
    words of either. So at most that many come before the rarest aligned word, and
    the first aligned occurrence of it in one text is aligned with the first in the
    other, at most m / 5 places off."""
    places = _rarest(hashes, counts, 1)
    words, which = np.unique(hashes[places], return_inverse=True)
    low, high = np.full(len(words), len(hashes)), np.zeros(len(words), np.int64)
    np.minimum.at(low, which, places)
    np.maximum.at(high, which, places)
    return words, low, high


def sketch(words: list[bytes]) -> np.ndarray:
    """One key for each band; none for a text without words."""
    if not words:
        return np.zeros(0, dtype=np.int64)
    runs, labelled = labelled_runs(words)
    keys = np.empty(BANDS, dtype=np.uint64)
    step = max(1, (1 << 18) // len(runs))
    for at in range(0, BANDS, step):
        seeds = SEEDS[at : at + step]
        values = _mixed((labelled[None, :] ^ seeds[:, None]) * MIX)
        rows = np.arange(len(seeds))
        one = values.argmin(axis=1)
        values[rows, one] = MOST
        two = values.argmin(axis=1)
        first, second = runs[np.minimum(one, two)], runs[np.maximum(one, two)]
        keys[at : at + step] = _mixed((first * MIX + second) * MIX ^ seeds)
    return keys.view(np.int64)


# -- alignment ---------------------------------------------------------------


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance, or most + 1 if it is greater.

    Only cells within ``most`` of the diagonal can lie on a path that short.
    A column of that band is kept as two bit vectors, of the steps up and of
    the steps down, and moves one cell down with each word of ``b``.
    """
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[same:], b[same:]
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > most:
        return most + 1
    if not n:
        return m
    most_ = min(most, m)
    width = 2 * most_ + 2
    full = (1 << width) - 1
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    # the lowest band cell is row j + most_; rows above the table read as steps
    up, down = (full << (width - most_ - 1)) & full, 0
    bottom, score = 1 << (width - 1), most_
    start = most_ + 1 - width
    last = 1 << (width - 2)
    get = where.get
    for j, x in enumerate(b):
        match = get(x, 0)
        if match:
            match = (match >> start if start > 0 else match << -start) & full
        zero = (((match & up) + up) ^ up | match | down) & full
        plus = down | (full & ~(zero | up))
        minus = zero & up
        if j < m - most_:
            score += not zero & bottom
        else:
            if plus & last:
                score += 1
            elif minus & last:
                score -= 1
            last >>= 1
        half = zero >> 1
        up = minus | (full & ~(half | plus))
        down = half & plus
        start += 1
    return score if score <= most else most + 1


def alike(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the edit similarity on words is at least SIMILAR."""
    longer = max(len(a), len(b))
    most = longer * (SIMILAR[1] - SIMILAR[0]) // SIMILAR[1]
    if longer - min(len(a), len(b)) > most:
        return False
    if longer - (Counter(a) & Counter(b)).total() > most:
        return False
    return banded_distance(a, b, most) <= most


def profile(words: list[bytes]) -> np.ndarray:
    """Words counted in PROFILE places, at most 255 each. Two profiles are at
    most as far apart as the words of their texts."""
    places = np.fromiter(map(xxhash.xxh32_intdigest, words), dtype=np.int64, count=len(words)) % PROFILE
    return np.minimum(np.bincount(places, minlength=PROFILE), 255).astype(np.uint8)


# -- jobs --------------------------------------------------------------------


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, "_text", 2 << 20):
        words = [(x or "").encode().split() for x in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_id"),
                batch.column("_copy"),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([sketch(w) for w in words], pa.list_(pa.int64())),
            ],
            names=["id", "copy", "n", "keys"],
        )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, words = None, []
    for batch in sub_batches(batches, "text_b"):
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        links = []
        texts = zip(batch.column("text_a"), batch.column("text_b"))
        for node, other, (text, other_text) in zip(a, b, texts):
            if node != last:
                last, words = node, (text.as_py() or "").encode().split()
            if alike(words, (other_text.as_py() or "").encode().split()):
                links.append((node, other))
        columns = list(zip(*links)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])


def _labelled(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, copy (md5 of the text) and label, one row for each row of the input.
    Only this table stays in the shared folder."""
    path = new_path(df.sparkSession, "near-rows")
    with temporary_tables(df.sparkSession):
        rows = _walked(df, id_col, text_col)
        rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def _walked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = df.select(F.col(id_col).cast("long").alias("_id"), df[text_col].alias("_text"))
    marked = docs.withColumn("_copy", F.md5(F.coalesce("_text", F.lit("")).cast("binary")))
    with temporary_tables(df.sparkSession):  # of sketches, the largest table
        sketched = marked.mapInArrow(frugal(_sketched), "id long, copy string, n long, keys array<long>")
        # numbers stay as they are once they are written
        sketched = stored(sketched.withColumn("row", F.monotonically_increasing_id()), "near-sketches")
        named = stored(sketched.select("id", "copy"), "near-names", outer=True)
        copies = sketched.groupBy("copy").agg(F.min(F.struct("row", "n")).alias("_first"), F.min("id").alias("least"))
        copies = copies.select("copy", "least", F.col("_first.row").alias("node"), F.col("_first.n").alias("n"))
        copies = stored(copies, "near-copies", outer=True)
        # sketches of more than one row; arrays of sketches are never sent
        keyed = sketched.select(F.col("row").alias("node"), F.explode(F.array_distinct("keys")).alias("key"))
        groups = keyed.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
        shared = keyed.join(groups, "key").join(copies.select("node", "n"), "node")
        # one row a node: what asks for nodes or classes need not read its keys one by one
        shared = shared.groupBy("node", "n").agg(F.collect_list("key").alias("keys"))
        shared = stored(shared, "near-shared", outer=True)
    wanted = stored(copies.join(shared.select("node"), "node", "left_semi"), "near-wanted")
    # only rows with the least id of their text are sent, and none while the
    # list of those is small
    one = (F.col("_copy") == F.col("copy")) & F.col("_id").eqNullSafe(F.col("least"))
    listed = broadcast_if_small(wanted.select("copy", "least", "node"), F.lit(64))
    # a row that comes again is there as often
    texts = stored(marked.join(listed, one).select("node", F.col("_text").alias("text")), "near-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among stored pairs. A text is sent once for either end, and
        only if it is one."""

        def end(name: str) -> DataFrame:
            ends = broadcast_if_small(pairs.select(F.col(name).alias("node")).distinct(), F.lit(16))
            mine = texts.join(ends, "node", "left_semi").groupBy("node").agg(F.first("text").alias(f"text_{name}"))
            return mine.withColumnRenamed("node", name)

        both = pairs.select("a", "b").join(end("b"), "b").join(end("a"), "a").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(frugal(_verified), "a long, b long")

    def near(x: str, y: str):
        longer, shorter = F.greatest(x, y), F.least(x, y)
        return shorter * SIMILAR[1] >= longer * SIMILAR[0]

    # groups of a sketch, by two staggered scales of length
    step = F.log(F.col("n")) / float(np.log(SIMILAR[1] / SIMILAR[0])) / 2
    shared = shared.withColumn("scales", F.array(2 * F.floor(step), 2 * F.floor(step + 0.5) + 1))
    members = _members(shared)
    least = members.groupBy("key", "scale").agg(F.min(F.struct("node", "n")).alias("first"))
    candidates = (
        members.join(least, ["key", "scale"])
        .select(F.col("first.node").alias("a"), F.col("first.n").alias("a_n"), F.col("node").alias("b"), "n")
        .where((F.col("a") < F.col("b")) & near("n", "a_n"))
        .select("a", "b")
        .distinct()
    )
    candidates = stored(candidates, "near-candidates")
    first = stored(candidates.groupBy("b").agg(F.min("a").alias("a")), "near-first")
    labels = components(stored(verified(first), "near-links"))
    labels = _joined(candidates.join(first, ["a", "b"], "left_anti"), labels, verified)
    labels = stored(labels, "near-labels")
    rest = _residual(shared, labels, texts).join(candidates, ["a", "b"], "left_anti")
    labels = _joined(rest, labels, verified)
    rows = named.join(copies, "copy").join(labels, "node", "left")
    return rows.select("id", "copy", F.coalesce("label", "node").alias("label"))


def _members(shared: DataFrame) -> DataFrame:
    """One row for each group of a node."""
    return shared.withColumn("key", F.explode("keys")).withColumn("scale", F.explode("scales")).drop("keys", "scales")


def _joined(pairs: DataFrame, labels: DataFrame, verified) -> DataFrame:
    """Labels after the pairs that are not of one class are verified."""
    for end in ("a", "b"):
        of = labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        pairs = pairs.join(of, end, "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", end))
    pairs = stored(pairs.where("a_label <> b_label"), "near-rest")
    links = verified(pairs).join(pairs, ["a", "b"])
    # classes of classes: only the newly linked ones are walked again
    joined = components(links.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))
    joined = joined.select(F.col("node").alias("label"), F.col("label").alias("_joined"))
    labels = labels.unionByName(
        joined.select(F.col("label").alias("node"), "label").join(labels.select("node"), "node", "left_anti")
    )
    return labels.join(joined, "label", "left").select("node", F.coalesce("_joined", "label").alias("label"))


PROFILED = "key long, scale long, low int, high int, block int, node long, label long, n long, profile binary"


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, "text"):
        found = [profile((x or "").encode().split()).tobytes() for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "profile"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each pair of blocks; rows come ordered by those."""
    places = ("key", "scale", "low", "high")
    held: list[pa.RecordBatch] = []

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        node, label, n = (rows.column(c).to_numpy() for c in ("node", "label", "n"))
        block = rows.column("block").to_numpy()
        profiles = np.frombuffer(b"".join(rows.column("profile").to_pylist()), dtype=np.uint8)
        profiles = profiles.reshape(len(node), PROFILE).astype(np.int16)
        crossed = rows.column("low")[0] != rows.column("high")[0]
        a, b = [], []
        for i in range(len(node)):
            others = np.flatnonzero((block > block[i] if crossed else np.arange(len(node)) > i) & (label != label[i]))
            longer, shorter = np.maximum(n[others], n[i]), np.minimum(n[others], n[i])
            others = others[shorter * SIMILAR[1] >= longer * SIMILAR[0]]
            if not len(others):
                continue
            longer = np.maximum(n[others], n[i])
            most = longer * (SIMILAR[1] - SIMILAR[0]) // SIMILAR[1]
            apart = np.abs(profiles[others] - profiles[i]).sum(axis=1)
            for j in others[apart <= n[others] + n[i] - 2 * (longer - most)]:
                a.append(min(node[i], node[j]))
                b.append(max(node[i], node[j]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        marks = np.stack([rows.column(c).to_numpy() for c in places])
        starts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist()]
        for start, stop in zip(starts, starts[1:]):
            yield pairs(rows.slice(start, stop - start))
        held = rows.slice(starts[-1]).to_batches()
    if held:
        yield pairs(pa.Table.from_batches(held))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts words come, in rows of 1 << COUNTED counters."""
    counts = np.zeros(1 << COUNTERS, dtype=np.int32)
    for batch in sub_batches(batches, "text"):
        for text in batch.column("text").to_pylist():
            counts[np.unique(word_hashes((text or "").encode().split()) >> np.uint64(64 - COUNTERS))] += 1
    rows = counts.reshape(-1, 1 << COUNTED)
    used = np.flatnonzero(rows.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array([rows[i].tobytes() for i in used], pa.binary())], names=["at", "counts"]
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, at = np.zeros(1 << COUNTED, dtype=np.int32), None
    for batch in batches:
        for at, counts in zip(batch.column("at").to_pylist(), batch.column("counts").to_pylist()):
            total += np.frombuffer(counts, np.int32)
    if at is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["at", "counts"]
        )


RARE = "key long, node long, label long, n long, low long, high long"


def _with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a word that another class has too, in a text of such a length
    and about there. Rows come ordered by word and length. Words of more texts
    than BLOCK are not looked through and keep all theirs."""

    def kept(rows: pa.Table) -> pa.RecordBatch:
        key, label, n, low, high = (rows.column(c).to_numpy() for c in ("key", "label", "n", "low", "high"))
        keep, at, step = np.zeros(len(key), bool), np.arange(len(key)), 0
        while len(at) and step < BLOCK:
            step += 1
            at = at[at + step < len(key)]
            at = at[(key[at] == key[at + step]) & (n[at] * SIMILAR[1] >= n[at + step] * SIMILAR[0])]
            other = at + step
            apart = n[other] * (SIMILAR[1] - SIMILAR[0]) // SIMILAR[1]
            met = (label[at] != label[other]) & (low[at] <= high[other] + apart) & (low[other] <= high[at] + apart)
            keep[at[met]] = keep[other[met]] = True
        keep |= np.isin(key, key[at])
        return rows.filter(pa.array(keep)).combine_chunks()

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < 1 << 16 or held[0].column("key")[0] == batch.column("key")[-1]:
            continue
        rows = pa.Table.from_batches(held)
        key = rows.column("key").to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
        yield from kept(rows.slice(0, cut)).to_batches()
        held = rows.slice(cut).to_batches()
        size = len(key) - cut
    if held:
        yield from kept(pa.Table.from_batches(held)).to_batches()


def _split(crowd: DataFrame, texts: DataFrame) -> DataFrame:
    """The nodes of crowded groups in groups of one rare word each."""
    mine = texts.join(crowd.select("node"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    mine = stored(mine.join(crowd, "node"), "near-crowd")
    tasks = -(-mine.count() // (16 * BLOCK))
    each = mine.select("text").coalesce(tasks).mapInArrow(frugal(_counted), "at int, counts binary")
    counts = np.zeros((1 << COUNTERS - COUNTED, 1 << COUNTED), dtype=np.int32)
    for row in each.groupBy("at").applyInArrow(_added, "at int, counts binary").collect():
        counts[row["at"]] = np.frombuffer(row["counts"], np.int32)
    counts = counts.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            found = [rare_words(word_hashes((x or "").encode().split()), counts) for x in batch.column("text").to_pylist()]
            of = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            key, low, high = (np.concatenate(x) for x in zip(*found))
            node, label, n = (batch.column(c).to_numpy()[of] for c in ("node", "label", "n"))
            columns = (key.view(np.int64), node, label, n, low, high)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in RARE.split(", ")])

    rare = mine.repartition("node").mapInArrow(frugal(run), RARE)
    rare = rare.repartition("key").sortWithinPartitions("key", "n").mapInArrow(frugal(_with_partner), RARE)
    # no scale is as great
    return stored(rare.select("key", F.lit(1 << 40).alias("scale"), "node", "label", "n"), "near-split")


def _of_groups(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """node, label and n of the nodes in any of the groups. These are looked up in
    each node's own list; a longer list of groups is joined."""
    ids = groups.select(F.xxhash64("key", "scale").alias("id"))
    if groups.count() > BROADCAST_ROWS:
        return _members(nodes).join(groups, ["key", "scale"], "left_semi").select("node", "label", "n").distinct()
    wanted = np.unique(ids.toArrow().column("id").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column("ids")
            of = np.repeat(np.arange(batch.num_rows), mine.value_lengths().to_numpy())
            hit = np.unique(of[np.isin(mine.flatten().to_numpy(), wanted)])
            yield batch.select(["node", "label", "n"]).take(pa.array(hit))

    of_scale = F.transform("scales", lambda s: F.transform("keys", lambda k: F.xxhash64(k, s)))
    rows = nodes.select("node", "label", "n", F.flatten(of_scale).alias("ids"))
    return rows.mapInArrow(frugal(run), "node long, label long, n long")


def _residual(shared: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of different classes that share a group and that the word counts do
    not rule out, whatever the size of groups and classes.

    Nodes of groups of more than FEW members of small classes are taken once each
    and grouped by rare words. A word of more than BLOCK nodes is dealt into
    blocks, and every two blocks are compared by a task of their
    own. A class of BLOCK nodes or more is large: it is dealt into
    parts once, not in each group, and every node that shares a group with it is
    sent to its parts. So rows of a large class are as many as its nodes, and
    pairs become rows only after their bound.
    """
    group = ["key", "scale"]
    few = min(FEW, BLOCK)
    shared = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    shared = stored(shared, "near-nodes")
    nodes = shared.select("node", "label", "n")
    large = nodes.groupBy("label").agg(F.count("*").alias("_size")).where(F.col("_size") >= BLOCK)
    large = stored(large.withColumn("_parts", F.ceil(F.col("_size") / BLOCK).cast("int")), "near-large")
    shared = shared.join(large.select("label", "_size"), "label", "left")
    members, small = _members(shared), F.col("_size").isNull()
    own_label = F.when(small, F.col("label"))
    held = members.groupBy(*group).agg(
        F.count("*").alias("_all"), F.min("label").alias("_one"), F.max("label").alias("_other"),
        F.count(own_label).alias("_n"), F.min(own_label).alias("_least"), F.max(own_label).alias("_most"),
    )
    # the least node of a group has been compared with the others
    held = stored(held.where("_all > 2 AND _one < _other"), "near-groups")
    small_members = members.where(small).select(*group, "node", "label", "n")
    big = members.where(~small).select(*group, F.col("label").alias("of"), F.col("_size").alias("_of_size")).distinct()
    big = stored(big.join(held, group, "left_semi"), "near-big")

    # within groups: small classes against each other
    several = held.where("_least < _most")
    near = small_members.join(several.where(F.col("_n") <= few).select(*group), group)
    near = stored(near.withColumns({c: F.lit(0) for c in ("low", "high", "block")}), "near-few")
    crowded = several.where(F.col("_n") > few).select(*group)
    if crowded.limit(1).count():
        crowd = stored(_of_groups(shared.where(small), crowded), "near-crowd-nodes")
        split = _split(crowd, texts)
        blocks = split.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks")).where("_blocks > 1")
        dealt = split.join(blocks, group, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
        dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        dealt = dealt.withColumns({"low": F.least("block", "_other"), "high": F.greatest("block", "_other")})
        near = near.unionByName(dealt.select(*near.columns))

    # large classes: against the nodes of smaller ones that share a group
    asked = small_members.join(big, group).select("of", "node", "label", "n")
    mine = big.select(*group, F.col("of").alias("label"), F.col("_of_size").alias("_size"))
    lesser = (F.col("_size") < F.col("_of_size")) | ((F.col("_size") == F.col("_of_size")) & (F.col("label") > F.col("of")))
    both = mine.join(big, group).where(lesser).select("of", "label").distinct()
    asked = asked.unionByName(nodes.join(both, "label").select("of", "node", "label", "n")).distinct()
    asked = stored(asked.join(large.select(F.col("label").alias("of"), "_parts"), "of"), "near-asked")
    parted = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("block", F.lit(1))
    own = nodes.join(large, "label").join(asked.select(F.col("of").alias("label")).distinct(), "label", "left_semi")
    own = own.select(
        F.col("label").alias("of"), "node", "label", "n",
        F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int").alias("_part"), F.lit(0).alias("block"),
    )
    parted = own.unionByName(parted.select(*own.columns))
    # a part is a group of its own: below zero no scale lies
    parted = parted.select(
        F.col("of").alias("key"), (-1 - F.col("_part").cast("long")).alias("scale"),
        F.lit(0).alias("low"), F.lit(1).alias("high"), "block", "node", "label", "n",
    )
    met = near.select(*parted.columns).unionByName(parted)
    wanted = met.select("node").distinct()
    profiles = texts.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    profiles = stored(profiles.mapInArrow(_profiles, "node long, profile binary"), "near-profiles")
    places = ("key", "scale", "low", "high")
    met = met.join(profiles, "node").select(*(c.split()[0] for c in PROFILED.split(", ")))
    ordered = met.repartition(*places).sortWithinPartitions(*places)
    return ordered.mapInArrow(frugal(_compared), "a long, b long").distinct()


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id, one row for each row of the input."""
    rows = _labelled(df, id_col, text_col)
    names = rows.groupBy("label").agg(F.min("id").alias("class_id"))
    return rows.join(names, "label").select(F.col("id").alias(id_col), "class_id")


def first_of_class(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_per_id: bool = True
) -> DataFrame:
    """One row of each class, of its least id, all columns. With ``one_per_id``
    one row stays of several kept ones with the same id; null is no id."""
    firsts = _labelled(df, id_col, text_col).groupBy("label")
    kept = firsts.agg(F.min(F.struct(F.col("id").isNull(), "id", "copy")).alias("_kept")).select("_kept.id", "_kept.copy")
    if one_per_id:
        kept = kept.groupBy("id", F.when(F.col("id").isNull(), F.col("copy"))).agg(F.min("copy").alias("copy"))
    kept = kept.select(F.col("id").alias("__class_id"), F.col("copy").alias("__class_copy"))
    mine, copy = "__class_member_id", "__class_member_copy"
    rows = df.withColumns(
        {mine: F.col(id_col).cast("long"), copy: F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))}
    )
    same = F.col(mine).eqNullSafe(F.col("__class_id")) & (F.col(copy) == F.col("__class_copy"))
    return rows.join(kept, same, "left_semi").dropDuplicates([mine, copy]).drop(mine, copy)
