"""Set similarity self-join by chosen paths.

Documents are sets of word shingles; equal sets are joined once. Sets are embedded by minimum hashes, so that a coordinate
is a token sampled from the set, which two sets share with a probability equal to their Jaccard index. From the root, every
set follows BRANCH sampled tokens, chosen by the node's path; sets with the same path meet. A node of more than LIMIT sets
is split again by further tokens, down to DEPTH; smaller ones, and those hardly smaller than the node above, are compared by
brute force, first by all coordinates, then by their whole sets. Runs with other paths are repeated until the target recall
at the threshold. A pair that meets at several nodes counts at the first only. Large nodes are compared in tiles, and a tile
returns how many links each set has and which sets hang together, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import cut, enter, runs, skew_join, small_batches, spent
from ._words import groups
from .components import components

#: Coordinates of a set; tokens followed from a node; sets of a node that is not split; deepest node; sets on a tile's side;
#: a node larger than this share of the one above is not split.
WIDTH, BRANCH, LIMIT, DEPTH, TILE, SHRINK = 64, 3, 200, 8, 1024, 0.7
#: Pairs are compared whole if their coordinates agree up to so many standard deviations below the threshold.
DEVIATIONS = 4.0
#: Texts that are compared whole are found by so many slots of their hashes, which bounds what is broadcast; a slot shared by chance only costs time.
SLOTS = 1 << 20
_rng = np.random.default_rng(99)
_TIMES = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)
_PLUS = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64)


def recall(threshold: float, branch: int = BRANCH, depth: int = DEPTH) -> float:
    """The least recall of one run for a pair at the threshold: it must share a token at each of `depth` levels."""
    return (1 - (1 - threshold) ** branch) ** depth


def runs_for(target: float, threshold: float) -> int:
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - recall(threshold))))


def _shingles(words, size: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, ascending; of a text of fewer words none."""
    hashes, _ = words.windows(size)
    for a, b in zip(words.bounds[:-1], words.bounds[1:]):
        yield np.unique(hashes[a : b - size + 1]) if b - a >= size else hashes[:0]


def _embed(size: int):
    """Of each text: the set's name and size, its coordinates, and the low byte of each for the comparison in tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("chosenpath")
        for batch in batches:
            for first, last, words in groups(batch.column(1)):
                sets = list(_shingles(words, size))
                n = np.array([len(s) for s in sets])
                keys = batch.column(2).slice(first, last - first).to_numpy().copy()  # of the text, where it has no shingles
                coordinates: list = [None] * len(sets)
                low: list = [None] * len(sets)
                full = np.flatnonzero(n)
                if len(full):
                    flat, at = np.concatenate([sets[i] for i in full]), np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    keys[full] = (np.add.reduceat(flat * np.uint64(0x9E3779B97F4A7C15), at) ^ (np.bitwise_xor.reduceat(flat, at) * np.uint64(0xD6E8FEB86659FD93))).view(np.int64)
                    least = np.stack([np.minimum.reduceat(((flat ^ plus) * times) >> np.uint64(32), at) for times, plus in zip(_TIMES, _PLUS)], 1).astype(np.uint32)
                    short = (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
                    for k, i in enumerate(full):
                        coordinates[i], low[i] = least[k].view(np.int32), short[k].tobytes()
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(first, last - first), "set": pa.array(keys), "n": pa.array(n, pa.int64()), "sig": pa.array(coordinates, pa.list_(pa.int32())), "low": pa.array(low, pa.binary()), "key": batch.column(2).slice(first, last - first)})

    return run


def _candidates(table: pa.Table, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a tile the later rows that it is to be compared with whole: those that belong to the tile, are of fitting size, agree in enough coordinates, and do not meet it at an earlier leaf."""
    side, n = table.column("side").to_numpy(), table.column("n").to_numpy()
    low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(len(side), WIDTH)
    leaves = table.column("leaves").combine_chunks()
    flat, owner = leaves.values.to_numpy(), np.repeat(np.arange(len(side)), np.diff(leaves.offsets.to_numpy()))
    before = flat < table.column("path")[0].as_py()
    _, column = np.unique(flat[before], return_inverse=True)
    met = np.zeros((len(side), int(column.max()) + 1 if len(column) else 1), np.float32)
    met[owner[before], column] = 1
    least = WIDTH * (threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / WIDTH))
    two = side.max() > side.min()
    for i in range(len(side) - 1):
        other = np.arange(i + 1, len(side))
        if two:
            other = other[side[other] != side[i]]
        other = other[(n[other] >= threshold * n[i]) & (n[i] >= threshold * n[other])]
        if len(other):
            other = other[(low[other] == low[i]).sum(1) >= least]
            if len(other):
                yield i, other[met[other] @ met[i] == 0]


def _filter(threshold: float):
    """The rows of a tile that are to be compared: each with its place among them, and a bit for each later one it is compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("chosenpath")
        for table in runs(batches):
            if len(table) < 2:
                continue
            found = {i: other for i, other in _candidates(table, threshold) if len(other)}
            if not found:
                continue
            keep = np.unique(np.concatenate([[*found], *found.values()]))
            bits = []
            for i in keep:
                mine = np.zeros(len(keep), bool)
                mine[np.searchsorted(keep, found.get(i, []))] = True
                bits.append(np.packbits(mine[: 1 + int(np.flatnonzero(mine)[-1])] if mine.any() else mine[:0]).tobytes())
            rows = table.select(["tile", "set", "copies"]).take(pa.array(keep))
            yield from rows.append_column("place", pa.array(range(len(keep)), pa.int32())).append_column("partners", pa.array(bits, pa.binary())).to_batches()

    return run


def _overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """The exact number of common shingles of each pair."""
    if len(pairs) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], True)) for i, j in pairs])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    column, owner = (np.cumsum(shared) - 1)[column[shared[column]]], owner[shared[column]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(shared.sum()), 4096):
        here = (column >= low) & (column < low + 4096)
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[here], column[here] - low] = 1
        common += part @ part.T
    i, j = pairs.T
    return common[i, j].astype(np.int64)


def _verify(threshold: float, size: int):
    """Per set of a tile: how many documents it is linked to there, and the least set that hangs together with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("chosenpath")
        for table in runs(batches):
            place = table.column("place").to_numpy()  # sorted; a row that stands in the input twice may come twice
            table = table.take(pa.array(np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))))
            pairs = [(i, int(j)) for i, bits in enumerate(table.column("partners").to_pylist()) if bits for j in np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))]
            sets: list[np.ndarray] = []
            for _, _, words in groups(table.column("text").combine_chunks()):
                sets += _shingles(words, size)
            pairs = np.array(pairs)
            common = _overlaps(sets, pairs)
            n, copies = np.array([len(s) for s in sets]), table.column("copies").to_numpy()
            left, right = pairs.T
            near = (common > 0) & (common >= threshold * (n[left] + n[right] - common) - 1e-9)
            left, right = left[near], right[near]
            links = np.bincount(left, copies[right], len(n)).astype(np.int64) + np.bincount(right, copies[left], len(n)).astype(np.int64)
            root = np.arange(len(n))
            while True:  # the least place of those that hang together, over ever longer ways
                least = root.copy()
                np.minimum.at(least, left, root[right])
                np.minimum.at(least, right, root[left])
                least = np.minimum(least, least[least])
                if (least == root).all():
                    break
                root = least
            has = np.flatnonzero(links)
            if len(has):
                keys = table.column("set").to_numpy()
                yield pa.RecordBatch.from_pydict({"set": pa.array(keys[has]), "links": pa.array(links[has]), "root": pa.array(keys[root[has]])})

    return run


def _leaves(sets: DataFrame, n_runs: int) -> DataFrame:
    """(path, set, size) of every node that is compared by brute force; size is how many sets are there.

    The nodes of the first level are exploded from the sets; further ones only where a node is split. Sizes are counted by
    partial aggregates before they are shuffled, and a node's rows meet its size in a join whose large partitions Spark splits.
    """
    token = lambda depth: F.pmod(F.xxhash64("path", F.lit(depth)) + F.col("branch"), F.lit(WIDTH)).cast("int")
    branches = F.explode(F.array(*[F.lit(b * (WIDTH // BRANCH)) for b in range(BRANCH)]))
    above = sets.where("n > 0").select("set", "sig", F.explode(F.array(*[F.lit(r).cast("long") for r in range(n_runs)])).alias("path"), F.lit(None).cast("long").alias("parent"))
    leaves, passed = None, []
    for depth in range(1, DEPTH + 1):
        node = above.withColumn("branch", branches).withColumn("token", token(depth))
        node = node.select("set", "parent", F.xxhash64("path", "token", F.element_at("sig", F.col("token") + 1)).alias("path"))
        met = node.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        node = cut(skew_join(node, met, ["path"]))
        passed.append(node)
        split = F.lit(False) if depth == DEPTH else (F.col("size") > LIMIT) & (F.col("parent").isNull() | (F.col("size") <= F.col("parent") * SHRINK))
        found = node.where(~split).select("path", "set", "size")
        leaves = found if leaves is None else leaves.unionByName(found)
        deeper = node.where(split).select("set", "path", F.col("size").alias("parent"))
        if deeper.isEmpty():
            break
        above = deeper.join(sets.select("set", "sig"), "set")
    out = cut(leaves)
    spent(*passed)
    return out


def similar_documents(docs: DataFrame, threshold: float = 0.8, size: int = 5, target: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, key (hash of its text), copy_of (least id of the documents of the same shingle set), class_id
    (least id of those linked to it over any number of links), class_key (with class_id the document that stands for the
    class; of a class without ids the least text hash), n_copies (documents of its set) and n_links (other documents at or
    above the threshold).

    Texts of fewer than `size` words have no shingles and link to equal texts only. Similarity is exact, by 64-bit shingle
    hashes; a set is named by 64 bits of its shingles. Pairs between copies are counted, not made. Null text: empty. Null
    ids are documents (they count as copies and links) but give no name while another has one; repeated rows are copies; an
    empty table gives no rows; other columns are not read. Texts that have candidates, and by chance of slots some others,
    are shuffled once to be found and once for each tile they are compared in; tiles carry 64 bytes of a set.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    keyed = rows.withColumn("key", F.xxhash64("text"))
    named = cut(keyed.mapInArrow(_embed(size), f"doc_id {kind}, set bigint, n bigint, sig array<int>, low binary, key bigint"))
    # Of each set the document of least id, null last, stands for it.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    sets = cut(named.groupBy("set").agg(F.count(F.lit(1)).alias("copies"), first.alias("one"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("low").alias("low")))
    leaves = _leaves(sets, runs_for(target, threshold))
    # A row for each tile of each leaf of a set.
    of = leaves.groupBy("set").agg(F.collect_set(F.struct("path", "size")).alias("at"))
    about = of.join(sets.select("set", "n", "low", "copies"), "set").withColumn("leaves", F.transform("at", lambda x: x["path"])).withColumn("leaf", F.explode("at"))
    member = about.withColumn("parts", F.ceil(F.col("leaf.size") / TILE).cast("int")).withColumn("side", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = member.select(F.xxhash64("leaf.path", F.least("side", "other"), F.greatest("side", "other")).alias("tile"), "set", F.col("leaf.path").alias("path"), "side", "n", "low", "leaves", "copies")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = cut(tiles.repartition(count, "tile").sortWithinPartitions("tile", "set").mapInArrow(_filter(threshold), "tile bigint, set bigint, copies bigint, place int, partners binary"))
    # One text of each set that has candidates, found by id and text hash.
    wanted = cut(sets.join(small.select("set").distinct(), "set", "left_semi").select("set", F.col("one.doc_id").alias("one_id"), F.col("one.key").alias("one_key")))
    slot = lambda c: F.pmod(F.col(c), F.lit(SLOTS))
    near = keyed.withColumn("slot", slot("key")).join(F.broadcast(wanted.select(slot("one_key").alias("slot")).distinct()), "slot", "left_semi")
    texts = near.join(wanted, F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("key") == F.col("one_key"))).select("set", "text")
    whole = small.join(texts, "set").repartition(count, "tile").sortWithinPartitions("tile", "place")
    linked = cut(whole.select("tile", "place", "partners", "set", "copies", "text").mapInArrow(_verify(threshold, size), "set bigint, links bigint, root bigint"))
    spent(leaves, small, wanted)
    links = linked.groupBy("set").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("set").alias("u"), F.col("root").alias("v")))
    group = sets.select("set", "one", "copies").join(links, "set", "left").join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = group.groupBy("root").agg(F.min("one").alias("least"))
    group = skew_join(group, least, ["root"]).select("set", F.col("one.doc_id").alias("copy_of"), F.col("least.doc_id").alias("class_id"), F.col("least.key").alias("class_key"), F.col("copies").alias("n_copies"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return skew_join(named.select("doc_id", "key", "set"), group, ["set"]).select("doc_id", "key", "copy_of", "class_id", "class_key", "n_copies", "n_links")


def one_of_each_class(docs: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each class of similar_documents() the rows of docs that stand for it, with all their columns; of repeated rows one.

    Rows are told apart by id and text, so that null and repeated ids lose no other text. Only rows in a slot of one that
    goes or is repeated are shuffled; the slots are bounded and broadcast.
    """
    groups = similar_documents(docs, threshold, size, id_col=id_col, text_col=text_col)
    groups = cut(groups.groupBy("doc_id", "key").agg(F.max(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key"))).alias("stays"), F.count(F.lit(1)).alias("n")))
    touched = groups.where(~F.col("stays") | (F.col("n") > 1))
    gone = groups.where(~F.col("stays")).select(F.col("doc_id").alias("_gone_id"), F.col("key").alias("_gone_key"))
    slot = lambda i, k: F.pmod(F.xxhash64(i, k), F.lit(SLOTS))
    slots = F.broadcast(touched.select(slot("doc_id", "key").alias("_slot")).distinct())
    rows = docs.withColumn("_key", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).withColumn("_slot", slot(id_col, "_key"))
    far, near = rows.join(slots, "_slot", "left_anti"), rows.join(slots, "_slot", "left_semi")
    near = near.join(gone, F.col(id_col).eqNullSafe(F.col("_gone_id")) & (F.col("_key") == F.col("_gone_key")), "left_anti").dropDuplicates([id_col, "_key"])
    return far.select(*docs.columns).unionByName(near.select(*docs.columns))
