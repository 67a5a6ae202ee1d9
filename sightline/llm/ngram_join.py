"""Jaccard join of documents on word n-grams, and its connected components.

The exact join at 0.8 of the sets of 5-word shingles. Documents with equal sets
form a class, of which one stands for all. The product of the incidence matrix
with its transpose is never formed: bounds from the sets' sizes say which blocks
of it can hold a link.

1. A set's partner holds at least 0.8 of it, so 0.8 of its shingles occur in some
   other set. Of the first ``n - ceil(0.8 n) + floor(0.2 n)`` shingles in the
   order of hashes at least ``floor(0.2 ceil(0.8 n))`` must. Shingles that two
   classes of a task's batch share are counted there; of each shingle one posting
   a batch goes to the shuffle, whatever the number of documents that have it.
2. The classes left are tested on their whole sets in the same way.
3. Linked sets share one of their first ``n - ceil(0.8 n) + 1`` shingles. The
   posting lists of these, rare shingles first, put classes into blocks. Each block's incidence rows are
   multiplied with its own and with those of its group's first block, overlaps
   accumulated over slices of shingles, and pairs below the bound
   ``100 * overlap >= 80 * union`` discarded; links join classes to components.
4. All other pairs of blocks that share a posting list are multiplied too, so
   every link between classes is found, in exactly one pair of blocks. A row's
   number of links counts each linked class by its rows, and its own class's others.
   Where only components are asked for, pairs of blocks whose shared lists hold one
   component are left out: links inside a component do not change components.

Shingles are told apart by 64-bit hashes, rows' sets by 128 bits. A class goes by the
first 64 of them, whatever the ids of its rows; among 10 ** 9 classes one pair in 40
such tables would have that in common.

Null texts and texts without a word have an empty set and are linked with
nothing; fewer than five words are one shingle. Repeated rows each get a row and
are linked; rows that repeat an id with other texts are told apart by their texts. A
row with a null id is linked like others, but gives no component its name, which is
null where no row has an id. An empty table gives an empty result. Columns other than
doc_id and text are not read."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import join_counted, key_filter, materialize, maybe_in, mix, row_groups, small_batches, text_buffers, trimmed, word_hashes, word_spans
from .components import components

WORDS = 5
#: Postings that one task of a shuffle by shingle handles.
TASK_POSTINGS = 2_000_000
#: Bytes of text that a kernel works on at a time, postings that it holds, and postings
#: that it sorts at a time.
GROUP_BYTES, HELD_POSTINGS, RANGE_POSTINGS = 1 << 20, 300_000, 100_000
#: Classes in a block, and shingles in a slice of the product.
BLOCK, BLOCK_SHINGLES, COLUMNS = 256, 500_000, 4096
#: Pairs of blocks that meet one copy of a block.
SHARE = 64
#: Buckets of the table of shingle counts, and of a part of it; tasks whose parts are
#: added up together.
SKETCH, SKETCH_PART, SKETCH_TASKS = 1 << 22, 1 << 16, 256
_FACTORS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, sorted."""
    starts, ends, row = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    n_rows = len(offsets) - 1
    count = np.bincount(row, minlength=n_rows)
    full = row[: -WORDS + 1] == row[WORDS - 1 :] if len(row) >= WORDS else np.zeros(0, bool)
    total = np.zeros(len(full), dtype=np.uint64)
    for k in range(WORDS):
        total += h[k : k + len(full)] * _FACTORS[k]
    rows, out = [row[: len(full)][full]], [mix(total[full])]
    few = np.flatnonzero(count[row] < WORDS)
    if len(few):  # the whole sequence as one
        nth = few - np.searchsorted(row, row[few])
        total = np.zeros(n_rows, dtype=np.uint64)
        np.add.at(total, row[few], h[few] * _FACTORS[nth])
        own = np.unique(row[few])
        rows.append(own)
        out.append(mix(total[own] + count[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    rows, out = np.concatenate(rows), np.concatenate(out)
    order = np.lexsort((out, rows))
    rows, out = rows[order], out[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (out[1:] != out[:-1])
    return rows[new], out[new]


def _batches_of_sets(batch: pa.RecordBatch, column: int):
    """(first row, sizes, hashes, class, second digest) for groups of rows."""
    data, offsets = text_buffers(batch.column(column))
    for lo, hi in row_groups(offsets, GROUP_BYTES):
        part = offsets[lo : hi + 1]
        row, h = shingle_sets(data[part[0] : part[-1]], part - part[0])
        n = np.bincount(row, minlength=hi - lo)
        digests = []
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            total = np.zeros(hi - lo, dtype=np.uint64)
            if len(row):
                has = np.flatnonzero(n)
                total[has] = np.add.reduceat(mix(h ^ np.uint64(salt)), np.searchsorted(row, has))
            digests.append(mix(total + n.astype(np.uint64)).astype(np.int64))
        yield lo, n, h, *digests


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class and second digest of every row."""

    def kernel(batches):
        for b in batches:
            for lo, n, _, c, d in _batches_of_sets(b, 1):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(n)), pa.array(n), pa.array(c), pa.array(d)], names=["doc_id", "n_shingles", "c", "d"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(kernel), "doc_id long, n_shingles long, c long, d long")


def _need(n):
    """ceil(0.8 n), in integers."""
    return (4 * n + 4) // 5


def _prefix(n):
    """So many of the first shingles hold floor(0.2 n) common ones of a link."""
    return n - _need(n) + n // 5


def _shared_part(n, whole: bool):
    """So many of the counted shingles must occur in another set, at least."""
    return _need(n) if whole else _need(n) // 5


def _count_locally(h: np.ndarray, c: np.ndarray):
    """Classes once for each of their shingles that another class of the batch
    has, and one posting for each shingle: class 0 where it is shared already."""
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = h[1:] != h[:-1]
    size = np.diff(np.append(np.flatnonzero(first), len(h)))
    shared = np.repeat(size > 1, size)
    return c[shared], h[first], np.where(size > 1, 0, c[first])


def _shared_counts(rows: DataFrame, kernel, n_tasks: int) -> DataFrame:
    """(c, n_shared) from a kernel of (bucket, kind, blob) rows: blobs of kind 0
    hold postings (shingle, class), those of kind 1 classes counted already."""

    def tally(h: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Classes once for each of their shingles here that another class has."""
        order = np.lexsort((who, h))
        h, who = h[order], who[order]
        first = np.append(True, h[1:] != h[:-1])
        keep = first | np.append(True, who[1:] != who[:-1])
        at = np.flatnonzero(first)
        # A marker, or two classes, or a marker and a class: shared.
        shared = (np.add.reduceat(keep.astype(np.int32), at) > 1) | np.logical_or.reduceat(who == 0, at)
        return who[keep & np.repeat(shared, np.diff(np.append(at, len(h)))) & (who != 0)]

    def reduce(batches):
        postings, low, high = [], np.uint64(2**64 - 1), np.uint64(0)
        for b in batches:
            for kind, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(blob.as_buffer(), dtype=np.int64).reshape(-1, 2)
                if kind:
                    yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["c", "n_shared"])
                else:
                    postings.append(x)
                    low, high = min(low, x[0, 0].view(np.uint64)), max(high, x[-1, 0].view(np.uint64))
        if not postings:
            return
        # The blobs are sorted; so many ranges of shingles are worked on one after another.
        parts = max(1, sum(map(len, postings)) // RANGE_POSTINGS)
        edges = np.array([int(low) + (int(high) - int(low)) * k // parts for k in range(1, parts)], dtype=np.uint64)
        cuts = [[0, *np.searchsorted(x[:, 0].view(np.uint64), edges).tolist(), len(x)] for x in postings]
        c, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in range(parts):
            some = np.concatenate([x[e[k] : e[k + 1]] for x, e in zip(postings, cuts, strict=True)])
            if len(some):
                own, times = np.unique(tally(some[:, 0], some[:, 1]), return_counts=True)
                c, back = np.unique(np.concatenate([c, own]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([n, times]), minlength=len(c)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], names=["c", "n_shared"])

    blobs = rows.mapInArrow(trimmed(kernel), "bucket int, kind int, blob binary")
    counts = blobs.repartitionById(n_tasks, F.col("bucket")).select("kind", "blob").mapInArrow(trimmed(reduce), "c long, n_shared long")
    return counts.groupBy("c").agg(F.sum("n_shared").alias("n_shared"))


def _emit(h: np.ndarray, c: np.ndarray, n_tasks: int):
    """The (bucket, kind, blob) rows of a batch's postings."""
    shared, h, c = _count_locally(h, c)
    bucket = (h >> np.uint64(32)).astype(np.int64) * n_tasks >> 32  # h is sorted, and so are buckets
    flat = np.stack([h.view(np.int64), c], axis=1)
    bounds = np.searchsorted(bucket, np.arange(n_tasks + 1))
    out = [(k, 0, flat[a:b].tobytes()) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
    who, times = np.unique(shared, return_counts=True)
    to = who % n_tasks
    for k in np.unique(to):
        out.append((int(k), 1, np.stack([who[to == k], times[to == k]], axis=1).tobytes()))
    kinds = (pa.int32(), pa.int32(), pa.binary())
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "kind", "blob"])


def _window_counts(docs: DataFrame, n_tasks: int) -> DataFrame:
    """How many of each class's first shingles occur in another class."""

    def kernel(batches):
        seen: set[int] = set()  # copies within a task count once
        hs, cs, held = [], [], 0
        for b in batches:
            for _, n, h, c, _ in _batches_of_sets(b, 0):
                at = np.cumsum(n) - n
                for i in np.flatnonzero(n):
                    if int(c[i]) not in seen:
                        seen.add(int(c[i]))
                        k = _prefix(int(n[i]))
                        hs.append(h[at[i] : at[i] + max(k, 1)])
                        cs.append(np.full(max(k, 1), c[i]))
                        held += max(k, 1)
                if held > HELD_POSTINGS:
                    yield from _emit(np.concatenate(hs), np.concatenate(cs), n_tasks)
                    hs, cs, held = [], [], 0
        if hs:
            yield from _emit(np.concatenate(hs), np.concatenate(cs), n_tasks)

    return _shared_counts(docs.select("text"), kernel, n_tasks)


def _whole_counts(sets: DataFrame, n_tasks: int) -> DataFrame:
    def kernel(batches):
        for b in batches:
            parts = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in b.column(1)]
            c, ends = b.column(0).to_numpy(zero_copy_only=False), np.cumsum([len(p) for p in parts])
            at = 0
            while at < len(parts):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD_POSTINGS, side="right")))
                yield from _emit(np.concatenate(parts[at:upto]), np.repeat(c[at:upto], [len(p) for p in parts[at:upto]]), n_tasks)
                at = upto

    return _shared_counts(sets.select(F.col("id").alias("c"), "hashes"), kernel, n_tasks)


def _id_key(id_: str) -> Column:
    """A 64-bit key of an id, null included."""
    return F.xxhash64(F.col(id_), F.col(id_).isNull())


def _sets(spark: SparkSession, docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """id (of the class), n, m and sorted hashes of the chosen classes (c, d, id, m),
    each from a row that has the class and the class's least doc_id. A bit table tells
    most rows that are not chosen, so few sets go to the join and no text does."""
    shared = spark.sparkContext.broadcast(key_filter(chosen.select(_id_key("id")), chosen.count()))

    def kernel(batches):
        seen: set[int] = set()  # equal rows of a task
        for b in batches:
            b = b.filter(pa.array(maybe_in(shared.value, b.column(2).to_numpy())))
            for lo, n, h, c, d in _batches_of_sets(b, 1):
                at = np.cumsum(n) - n
                good = [i for i in np.flatnonzero(n > 0) if (k := (b.column(0)[lo + i].as_py(), int(c[i]))) not in seen and not seen.add(k)]
                blobs = [h[at[i] : at[i] + n[i]].tobytes() for i in good]
                own = b.column(0).slice(lo, len(n)).take(pa.array(good, pa.int64()))
                columns = [own, pa.array(c[good]), pa.array(d[good]), pa.array(n[good]), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "c", "d", "n", "hashes"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").withColumn("k", _id_key("doc"))
    rows = text.mapInArrow(trimmed(kernel), "doc long, c long, d long, n long, hashes binary")
    picked = chosen.select(F.col("id").alias("_doc"), F.col("c").alias("_c"), F.col("d").alias("_d"), "m")
    same = (F.col("c") == F.col("_c")) & (F.col("d") == F.col("_d")) & F.col("doc").eqNullSafe(F.col("_doc"))
    return rows.join(picked, same).select(F.col("c").alias("id"), "n", "m", "hashes").dropDuplicates(["id"])


def _sketch(keys: DataFrame) -> np.ndarray:
    """The binary logarithm of how many 64-bit keys (a column of binary rows of them)
    fall into each of SKETCH buckets: a table of fixed size, whatever their number.
    Tasks' tables are added up in two steps, so no task holds those of all."""
    parts = SKETCH // SKETCH_PART

    def count(batches):
        total = np.zeros(SKETCH, dtype=np.int64)
        for b in batches:
            for at in range(0, len(b), 256):
                h = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in b.column(0).slice(at, 256)])
                bucket, n = np.unique((h & np.uint64(SKETCH - 1)).astype(np.int64), return_counts=True)
                total[bucket] += n
        if total.any():
            blobs = [zlib.compress(total[k * SKETCH_PART : (k + 1) * SKETCH_PART].tobytes(), 1) for k in range(parts)]
            several = [TaskContext.get().partitionId() // SKETCH_TASKS] * parts
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(several, pa.int32()), pa.array(blobs)], names=["part", "several", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_PART, dtype=np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_buffer()), dtype=np.int64)
        first = table.slice(0, 1)
        return pa.table({"part": first.column("part"), "several": first.column("several"), "counts": pa.array([zlib.compress(total.tobytes(), 1)])})

    kind = "part int, several int, counts binary"
    some = keys.mapInArrow(trimmed(count), kind).groupBy("part", "several").applyInArrow(add, kind)
    out = np.zeros(SKETCH, dtype=np.uint8)
    with small_batches(keys.sparkSession):
        rows = some.groupBy("part").applyInArrow(add, kind).collect()
    for r in rows:
        n = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int64)
        out[r["part"] * SKETCH_PART : (r["part"] + 1) * SKETCH_PART] = np.ceil(np.log2(n + 1))
    return out


def _lists(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """(h, id, n): postings of the first n - ceil(0.8 n) + 1 shingles of each set,
    rare ones first. Any order that all sets share will do, so counts of buckets
    are as right as counts of shingles."""
    shared = spark.sparkContext.broadcast(_sketch(sets.select("hashes")))

    def kernel(batches):
        for b in batches:
            for i, n, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                h = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
                often = shared.value[(h & np.uint64(SKETCH - 1)).astype(np.int64)]
                h = h[np.lexsort((h, often))][: n - _need(n) + 1].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), i)), pa.array(np.full(len(h), n))], names=["h", "id", "n"])

    return sets.select("id", "n", "hashes").mapInArrow(trimmed(kernel), "h long, id long, n long")


def _blocks(lists: DataFrame) -> DataFrame:
    """(id, group, part): classes whose posting lists have the same smallest id lie
    in one group, dealt by a hash into parts of about BLOCK classes, fewer if large."""
    heads = lists.groupBy("h").agg(F.min("id").alias("head"), F.count("*").alias("size")).where("size > 1").select("h", "head")
    group = lists.join(heads, "h").groupBy("id").agg(F.min("head").alias("group"), F.max("n").alias("n"))
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    sizes = group.groupBy("group").agg(parts.alias("parts"))
    return group.join(sizes, "group").select("id", "group", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the symmetric matrix ``linked`` joins."""
    out, todo = [], np.ones(len(linked), dtype=bool)
    for root in range(len(linked)):
        if todo[root]:
            todo[root] = False
            front = [root]
            while front:
                i = front.pop()
                new = np.flatnonzero(linked[i] & todo)
                todo[new] = False
                out += [(i, int(j)) for j in new]
                front += new.tolist()
    return out


def overlaps(hashes: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Incidence times its transpose: overlap counts of all pairs of a block, added
    up over slices of the shingles that two of its rows have."""
    _, column, df = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = df[column] > 1
    number = np.cumsum(df > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n_rows, n_rows), dtype=np.float32)
    for at in range(0, int((df > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((n_rows, COLUMNS), dtype=np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T
    return out


def _dealt(spark: SparkSession, pairs: DataFrame, held: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """Pairs and blocks keyed by a block of one side and a copy of it, of which there is
    one for each SHARE pairs that the block is in, so no task has all of one block's."""
    key = [f"g{side}", f"p{side}"]
    n = materialize(spark, pairs.groupBy(*key).agg(F.count("*").alias("n")), "pair-counts")
    copies = F.ceil(F.col("n") / SHARE)
    dealt = join_counted(pairs, n, key, "n", pairs.count()).withColumn(f"s{side}", F.pmod(F.xxhash64("g1", "p1", "g2", "p2"), copies)).drop("n")
    blocks = held.select(F.col("group").alias(key[0]), F.col("part").alias(key[1]), F.col("rows").alias("x" if side == "1" else "y"))
    return dealt, blocks.join(n, key).withColumn(f"s{side}", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("n")


def block_links(spark: SparkSession, pairs: DataFrame, members: DataFrame, count: bool) -> DataFrame:
    """Links (a, b) between different components in pairs of blocks (g1, p1, g2,
    p2), enough to join all that the pair's links join. With ``count`` also (a, null,
    n): with how many rows the class ``a`` is linked in the other block, or in its own
    where the pair is one block twice. ``members``: id, group, part, component, m,
    hashes."""
    held = members.groupBy("group", "part").agg(F.collect_list(F.struct("id", "component", "m", "hashes")).alias("rows"))
    pairs, left = _dealt(spark, materialize(spark, pairs, "pairs"), held, "1")
    pairs, right = _dealt(spark, materialize(spark, pairs, "pairs"), held, "2")
    same = (F.col("g1") == F.col("g2")) & (F.col("p1") == F.col("p2"))
    rows = pairs.join(left, ["g1", "p1", "s1"]).join(right, ["g2", "p2", "s2"]).select("x", F.when(~same, F.col("y")).alias("y"))

    def kernel(batches):
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                parts = [v.values for v in (x, y) if v.is_valid]
                ids = np.concatenate([p.field(0).to_numpy(zero_copy_only=False) for p in parts])
                component = np.concatenate([p.field(1).to_numpy(zero_copy_only=False) for p in parts])
                sets = [np.frombuffer(h.as_buffer(), dtype=np.uint64) for p in parts for h in p.field(3)]
                size = np.array([len(v) for v in sets])
                both = overlaps(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), len(sets)).astype(np.int64)
                # Below the bound from the sizes a pair is no link, whatever the two have in common.
                linked = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
                if count:
                    m = np.concatenate([p.field(2).to_numpy(zero_copy_only=False) for p in parts])
                    side = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                    counted = linked & (side[:, None] != side[None, :] if len(parts) > 1 else ~np.eye(len(ids), dtype=bool))
                    n_links = counted @ m
                    has = n_links > 0
                    yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.nulls(int(has.sum()), pa.int64()), pa.array(n_links[has])], names=["a", "b", "n"])
                linked &= component[:, None] != component[None, :]
                found = _spanning(linked)
                yield pa.RecordBatch.from_arrays([*(pa.array([ids[k[side]] for k in found], pa.int64()) for side in (0, 1)), pa.nulls(len(found), pa.int64())], names=["a", "b", "n"])

    return rows.mapInArrow(trimmed(kernel), "a long, b long, n long")


def _star(blocks: DataFrame) -> DataFrame:
    """Every block with itself and with the first block of its group."""
    each = blocks.select("group", "part").distinct()
    return each.select(F.col("group").alias("g1"), F.col("part").alias("p1"), F.col("group").alias("g2"), F.explode(F.array_distinct(F.array("part", F.lit(0).cast("long")))).alias("p2"))


def _pairs(met: DataFrame) -> DataFrame:
    """Pairs of blocks that lie in one of the sorted sets ``s`` of blocks (group, part,
    lo, hi), but those of _star(). Most lists of a group meet the same blocks, so sets
    are made distinct before they are paired."""
    pair = F.explode(F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> struct(x, y))))"))
    pairs = met.select("s").distinct().select(pair.alias("p"))
    done = (F.col("p.x.group") == F.col("p.y.group")) & ((F.col("p.x.part") == F.col("p.y.part")) | (F.col("p.x.part") == 0) | (F.col("p.y.part") == 0))
    one = (F.col("p.x.lo") == F.col("p.x.hi")) & (F.col("p.x.lo") == F.col("p.y.lo")) & (F.col("p.x.lo") == F.col("p.y.hi"))
    pairs = pairs.where(~done & ~F.coalesce(one, F.lit(False)))
    return pairs.select(F.col("p.x.group").alias("g1"), F.col("p.x.part").alias("p1"), F.col("p.y.group").alias("g2"), F.col("p.y.part").alias("p2")).distinct()


def _mixed(lists: DataFrame, labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of blocks that share a posting list with two components, and the ids
    in such lists."""
    rows = lists.select("h", "id").join(labelled.select("id", "group", "part", "component"), "id")
    lists_ = rows.groupBy("h").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("h")
    rows = rows.join(lists_, "h")
    per_list = rows.groupBy("h", "group", "part").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    met = per_list.groupBy("h").agg(F.array_sort(F.collect_set(F.struct("group", "part", "lo", "hi"))).alias("s"))
    return _pairs(met), rows.select("id").distinct()


def _touching(lists: DataFrame, labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of blocks that share a posting list, but those of _star(), and the ids
    in lists of more than one block."""
    rows = lists.select("h", "id").join(labelled.select("id", "group", "part"), "id")
    none = F.lit(None).cast("long")
    met = rows.groupBy("h").agg(F.array_sort(F.collect_set(F.struct("group", "part", none.alias("lo"), none.alias("hi")))).alias("s")).where("size(s) > 1")
    return _pairs(met), rows.join(met.select("h"), "h").select("id").distinct()


def _linked(spark: SparkSession, docs: DataFrame, count: bool = False) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles, c, d, group (a number of its component), component_id,
    class_id and, with ``count``, n_links of every row with a shingle; doc_id of the
    others."""
    prints = materialize(spark, fingerprints(docs), "fingerprints")
    filled = prints.where("n_shingles > 0")
    reps = materialize(spark, filled.groupBy("c", "d").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.count("*").alias("m")), "classes")
    sizes = reps.agg(F.sum("n"), F.sum("m"), F.count("*")).collect()[0]
    n_tasks = max(8, (sizes[0] or 0) * 2 // 5 // TASK_POSTINGS + 1)
    n = F.col("n")
    need = F.floor((4 * n + 4) / 5)
    near = materialize(spark, reps.join(_window_counts(docs, n_tasks), "c").where(F.col("n_shared") >= F.floor(need / 5)), "near")
    sets = materialize(spark, _sets(spark, docs, near), "sets")
    n_tasks = max(8, (sets.agg(F.sum("n")).collect()[0][0] or 0) // TASK_POSTINGS + 1)
    whole = _whole_counts(sets, n_tasks).where("n_shared > 0").withColumnRenamed("c", "id")
    sets = materialize(spark, sets.join(whole, "id").where(F.col("n_shared") >= need).select("id", "n", "m", "hashes"), "sets")
    lists = materialize(spark, _lists(spark, sets), "lists")
    blocks = materialize(spark, _blocks(lists), "blocks")
    alone = sets.join(blocks, "id").withColumn("component", F.col("id"))
    links = materialize(spark, block_links(spark, _star(blocks), alone, count), "links")
    labels = components(spark, links.where("b IS NOT NULL").select("a", "b"))
    labelled = materialize(spark, blocks.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")
    pairs, ids = _touching(lists, labelled) if count else _mixed(lists, labelled)
    members = sets.join(labelled, "id").join(ids, "id", "left_semi")
    more = materialize(spark, block_links(spark, pairs, members, count), "links")
    if more.where("b IS NOT NULL").head(1):
        labels = components(spark, links.unionByName(more).where("b IS NOT NULL").select("a", "b"))
    classes = reps.join(labels.withColumnRenamed("id", "c"), "c", "left").select("c", "d", "m", F.col("id").alias("class_id"), F.coalesce("component", "c").alias("group"))
    if count:
        counts = links.unionByName(more).where("n IS NOT NULL").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("others"))
        classes = classes.join(counts, "c", "left").withColumn("n_links", F.col("m") - 1 + F.coalesce("others", F.lit(0))).drop("others")
    classes = materialize(spark, classes, "classes")
    names = materialize(spark, classes.groupBy("group").agg(F.min("class_id").alias("component_id"), F.count("*").alias("_classes")), "components")
    classes = materialize(spark, join_counted(classes, names, ["group"], "_classes", sizes[2] or 0).drop("_classes"), "classes")
    return join_counted(filled, classes, ["c", "d"], "m", sizes[1] or 0).drop("m"), prints.where("n_shingles = 0").select("doc_id")


def link_components(spark: SparkSession, docs: DataFrame, count: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (the smallest id with the same
    set) of every row of ``docs`` (doc_id, text); with ``count`` also n_links, the
    number of other rows that the row is linked with."""
    rows, others = _linked(spark, docs, count)
    columns = ["doc_id", "n_shingles", "component_id", "class_id", *["n_links"] * count]
    none = [F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), *[F.lit(0).cast("long").alias("n_links")] * count]
    return rows.select(*columns).unionByName(others.select("doc_id", *none))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each group of linked documents, that with the smallest id (a row
    without one only where no other has one), with the columns of ``docs``. Of rows
    that repeat the id that with the smallest class stays, and of equal texts the first
    in the order of texts. Documents without a word are linked with nothing and stay.

    Only rows whose id may be dropped or repeated are shuffled: a bit table tells the
    others."""
    rows, _ = _linked(spark, docs)
    each = materialize(spark, rows.groupBy("group", "doc_id", "c", "d").agg(F.count("*").alias("n")), "each")
    rank = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "c", "d")
    first = materialize(spark, each.groupBy("group").agg(F.min(rank).alias("first"), F.sum("n").alias("n_rows"), F.count("*").alias("kinds")).where("n_rows > 1"), "first")
    several = join_counted(each, first, ["group"], "kinds", first.agg(F.sum("kinds")).collect()[0][0] or 0)
    special = several.withColumn("keep", rank == F.col("first")).select(F.col("doc_id").alias("_id"), F.col("c").alias("_c"), F.col("d").alias("_d"), "keep", "n")
    special = materialize(spark, special.where("NOT keep OR n > 1"), "special")
    shared = spark.sparkContext.broadcast(key_filter(special.select(_id_key("_id")), special.count()))

    @F.arrow_udf(BooleanType())
    def maybe(k: pa.Array) -> pa.Array:
        return pa.array(maybe_in(shared.value, k.to_numpy()))

    @F.arrow_udf(StructType([StructField(x, LongType()) for x in "ncd"]))
    def digests(texts: pa.Array) -> pa.Array:
        found = [(n, c, d) for _, n, _, c, d in _batches_of_sets(pa.RecordBatch.from_arrays([texts], names=["text"]), 0)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in zip(*found, strict=True)] or [pa.array([], pa.int64())] * 3, names=list("ncd"))

    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].cast("long").alias("_id"), docs["text"].cast("string").alias("_text"))
    row = row.withColumn("_maybe", maybe(_id_key("_id")))
    told = row.where("_maybe").withColumn("_f", digests(F.coalesce("_text", F.lit(""))))
    # Equal rows are combined before they are shuffled, and then looked for among those that go.
    one = told.where("_f.n > 0").groupBy("_id", F.col("_f.c").alias("_c"), F.col("_f.d").alias("_d")).agg(F.min_by("_row", "_text").alias("_row"))
    goes = special.where("NOT keep").select(F.col("_id").alias("i"), F.col("_c").alias("c"), F.col("_d").alias("d"))
    one = one.join(goes, F.col("_id").eqNullSafe(F.col("i")) & (F.col("_c") == F.col("c")) & (F.col("_d") == F.col("d")), "left_anti")
    return row.where("NOT _maybe").select("_row.*").unionByName(told.where("_f.n = 0").select("_row.*")).unionByName(one.select("_row.*"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), count=True)
