"""Exact n-gram Jaccard self-join by vertical partitioning.

Grams are word shingles, known by 64-bit hashes; a text's class is the hash of its whole
set, so texts with equal sets are one class from the start.

1. Tasks take the sets of their texts, each class once, and send them, packed, to buckets
   of the gram.  A bucket counts in how many classes each of its grams occurs, forgets
   those of one class only, and sends the rest to buckets of the class.  A gram that one
   task finds in ``DENSE`` or more classes (a passage that a third of all documents
   share) is not gathered: its postings go to their classes directly and only its name
   goes to the bucket, so no bucket is longer than its grams times the tasks.
2. The global order of grams is: one class, ascending number of classes, dense; then by
   hash.  A class whose grams of other classes are too few to reach the similarity with
   anything is done.  Of the others the rarest grams, the prefix, are kept: two classes
   that are similar enough share a gram of both prefixes.
3. The least class of each prefix gram is its hub, and the classes of all grams of a hub
   form a group, so each two classes that share a prefix gram are in a group together.
   Groups are cut into tiles; each pair of tiles is compared in a task of its own.
4. There the order is cut into fragments (``PIVOTS``, by number of classes).  The overlaps
   within a fragment are counted separately, for all pairs of the two tiles at once, and
   summed up per pair; pairs that cannot reach the similarity with all that is left of
   them are dropped between fragments.  A tile pair gives a spanning forest of its links,
   not all of them.

Nothing is capped: a group of m near copies costs m*m/2 comparisons in tiles of bounded
memory, and about m rows per tile pair.  Exact up to collisions of 64-bit hashes: of N
classes N*N/2**65 pairs are expected to fall together, and of two texts with n grams
n*n/2**64 grams.

A null text, like one without words, has no grams, is no class (null) and is linked with
nothing.  One of fewer words than a gram has all of them as its only gram.  Repeated
rows are rows of one class.  Columns kept are in a struct, so no name can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.batches import buffer_of, encode, gather, lower, pieces, word_spans
from tidegauge.llm.components import components, written
from tidegauge.llm.simhash import _forest

#: Classes of one task (of ``FLUSH`` grams) from which on a gram counts as dense.
DENSE = 64
FLUSH = 3_000_000
#: Classes in a tile.
TILE = 1024
#: Numbers of classes at which the global order is cut into fragments.
PIVOTS = (3, 5, 17, 257)
_INF = np.int64(1 << 40)
_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the shingles of each row, and the n+1 offsets of the rows."""
    raw, offsets = buffer_of(texts)
    raw = lower(raw)
    starts, ends, rows = word_spans(raw, offsets)
    codes, distinct = encode(raw, starts, ends)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))
    words = np.append(hashes[codes] | np.uint64(1), np.zeros(size, np.uint64)) if len(codes) else np.zeros(size, np.uint64)
    n = np.diff(rows)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    first = gather(rows[:-1], count)
    last = rows[1:][row]
    total = np.zeros(len(first), np.uint64)
    for k in range(size):
        word = words[first + k]
        word[first + k >= last] = 0  # a short row ends before its shingle does
        total = (total ^ word) * _P
        total ^= total >> np.uint64(32)
    order = np.argsort(total)
    order = order[np.argsort(row[order], kind="stable")]
    total, row = total[order], row[order]
    new = np.append(True, (row[1:] != row[:-1]) | (total[1:] != total[:-1]))[:len(row)]
    return total[new], np.searchsorted(row[new], np.arange(len(n) + 1))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers, as planes of bytes, compressed; sorted ones should come as differences."""
    head = np.array([len(columns), *map(len, columns)], "<i8").tobytes()
    planes = [np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return head + zstandard.compress(b"".join(planes), 1)


def _unpack(block: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(block, "<i8", 1)[0])
    lengths = np.frombuffer(block, "<i8", n, 8).tolist()
    body, at, out = zstandard.decompress(block[8 * (n + 1):]), 0, []
    for size in lengths:
        planes = np.frombuffer(body, np.uint8, 8 * size, at).reshape(8, size)
        out.append(np.ascontiguousarray(planes.T).view("<u8").reshape(-1))
        at += 8 * size
    return out


def _steps(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=np.uint64(0))


def _total(blocks: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*blocks, strict=True)]


def _cut(bucket: np.ndarray):
    """(bucket, start, end) of the runs of a sorted array."""
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    return zip(bucket[at].tolist(), at.tolist(), np.append(at, len(bucket))[1:].tolist(), strict=True)


def _postings(node: np.ndarray, gram: np.ndarray, classes: np.ndarray, shift: np.uint64):
    """(bucket of the class, block) of postings."""
    order = np.lexsort((gram, node))
    node, gram, classes = node[order], gram[order], classes[order]
    for bucket, a, b in _cut((node >> shift).astype(np.int64)):
        own, counts = np.unique(node[a:b], return_counts=True)
        none = np.zeros(0, np.uint64)
        yield bucket, _pack(_steps(own), counts, gram[a:b], classes[a:b], none, none)


GRAMS, POSTINGS, ROW = 0, 1, 2


class _Out:
    """Rows of the tasks' one schema, whose ``row`` is of the type given."""

    def __init__(self, row_type: pa.DataType):
        self.row_type = row_type

    def blocks(self, kind: int, items) -> pa.RecordBatch:
        bucket, block = zip(*items, strict=True) if (items := list(items)) else ((), ())
        n = len(bucket)
        return self._batch(kind, pa.array(bucket, pa.int32()), pa.array(block, pa.binary()), pa.nulls(n, self.row_type),
                           pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()))

    def rows(self, bucket: np.ndarray, row: pa.Array, node: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return self._batch(ROW, pa.array(bucket, pa.int32()), pa.nulls(len(bucket), pa.binary()), row, node, pa.array(n, pa.int64()))

    def _batch(self, kind: int, *columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(columns[0]), pa.int32()), *columns],
                                          ["kind", "bucket", "block", "row", "node", "n"])


def _runs(batches, keys: tuple[str, ...]):
    """(key, batches) of the runs of rows, sorted by ``keys``, that agree in them."""
    current, held = None, []
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if not batch.num_rows:
            continue
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0) if batch.num_rows > 1 else np.zeros(0, bool)
        at = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:]):
            key = tuple(c[a] for c in columns)
            if key != current and held:
                yield current, held
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield current, held


def _spread(size: int, bits: int, dense_from: int):
    """Task: rows with their class and size, the sets of new classes by bucket of the gram, and those classes' sizes."""
    shift = np.uint64(64 - bits)

    def flush(out, nodes, counts, grams):
        node, n, gram = np.concatenate(nodes), np.concatenate(counts).astype(np.uint64), np.concatenate(grams)
        index = np.repeat(np.arange(len(node)), n.astype(np.int64))
        order = np.argsort(gram)
        gram, index = gram[order], index[order]
        new = np.append(True, gram[1:] != gram[:-1])
        run = np.cumsum(new) - 1
        dense = np.bincount(run)[run] >= dense_from
        if dense.any():
            yield out.blocks(POSTINGS, _postings(node[index[dense]], gram[dense], np.full(int(dense.sum()), _INF, np.uint64), shift))
        named = gram[dense & new]
        gram, index = gram[~dense], index[~dense]
        bucket, named_bucket = (gram >> shift).astype(np.int64), (named >> shift).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        named_cuts = np.searchsorted(named_bucket, np.arange((1 << bits) + 1))
        blocks = []
        for k in np.flatnonzero(np.diff(cuts) + np.diff(named_cuts)).tolist():
            own, place = np.unique(index[cuts[k]:cuts[k + 1]], return_inverse=True)
            blocks.append((k, _pack(node[own], _steps(gram[cuts[k]:cuts[k + 1]]), place, _steps(named[named_cuts[k]:named_cuts[k + 1]]))))
        yield out.blocks(GRAMS, blocks)
        order = np.argsort(node)
        none = np.zeros(0, np.uint64)
        yield out.blocks(POSTINGS, [(k, _pack(none, none, none, none, node[order[a:b]], n[order[a:b]]))
                               for k, a, b in _cut((node[order] >> shift).astype(np.int64))])

    def run(batches):
        seen: set = set()
        nodes, counts, grams, held, dealt = [], [], [], 0, 0
        for piece in pieces(batches):
            out = _Out(piece.column("row").type)
            sets, cuts = shingle_sets(piece.column("text"), size)
            n = np.diff(cuts)
            view = memoryview(np.ascontiguousarray(sets.astype("<u8"))).cast("B")
            node = np.fromiter((xxhash.xxh3_64_intdigest(view[8 * a:8 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())),
                               np.uint64, len(n))
            deal = (dealt + np.arange(len(n))) % (1 << bits)
            dealt += len(n)
            yield out.rows(deal, piece.column("row"), pa.array(node.view(np.int64), mask=n == 0), n.astype(np.int64))
            own = node.tolist()
            new = np.array([i for i in np.flatnonzero(n).tolist() if not (own[i] in seen or seen.add(own[i]))], np.int64)
            if len(new):
                nodes.append(node[new])
                counts.append(n[new])
                grams.append(sets[gather(cuts[new], n[new])])
                held += len(grams[-1])
            if held >= FLUSH:
                yield from flush(out, nodes, counts, grams)
                nodes, counts, grams, held = [], [], [], 0
        if held:
            yield from flush(out, nodes, counts, grams)

    return run


def _count_classes(bits: int):
    """Task: grams of several classes, by bucket of the class; everything else as it is."""
    shift = np.uint64(64 - bits)

    def run(batches):
        for (kind, _), held in _runs(batches, ("kind", "bucket")):
            if kind != GRAMS:
                yield from held
                continue
            blocks, out = [], _Out(held[0].column("row").type)
            for x in (x for b in held for x in b.column("block").to_pylist()):
                node, steps, place, named = _unpack(x)
                blocks.append([node[place.astype(np.int64)], np.cumsum(steps, dtype=np.uint64), np.cumsum(named, dtype=np.uint64)])
            node, gram, named = _total(blocks)
            order = np.lexsort((node, gram))
            node, gram = node[order], gram[order]
            one = np.append(True, (gram[1:] != gram[:-1]) | (node[1:] != node[:-1]))[:len(gram)]
            node, gram = node[one], gram[one]
            if not len(gram):
                continue
            new = np.append(True, gram[1:] != gram[:-1])
            run_of = np.cumsum(new) - 1
            classes = np.bincount(run_of)
            classes[np.isin(gram[new], named)] = _INF
            classes = classes[run_of]
            shared = classes > 1
            yield out.blocks(POSTINGS, _postings(node[shared], gram[shared], classes[shared], shift))

    return run


def _gather_classes(percent: int):
    """Task: classes that may be similar to another: their shared grams in the global order, fragment cuts and prefix."""
    def run(batches):
        for _, held in _runs(batches, ("bucket",)):
            own, counts, gram, classes, known, sizes = _total([
                [np.cumsum(s, dtype=np.uint64), *rest] for s, *rest in (_unpack(x) for b in held for x in b.column("block").to_pylist())])
            known, at = np.unique(known, return_index=True)
            n = sizes[at].astype(np.int64)
            node = np.searchsorted(known, np.repeat(own, counts.astype(np.int64)))
            order = np.lexsort((gram, classes, node))
            node, gram, classes = node[order], gram[order], classes[order].astype(np.int64)
            one = np.append(True, (node[1:] != node[:-1]) | (gram[1:] != gram[:-1]))[:len(node)]
            node, gram, classes = node[one], gram[one], classes[one]
            shared = np.bincount(node, minlength=len(n))
            least = -(-percent * n // 100)
            use = np.flatnonzero(shared >= least)
            cuts = np.concatenate(([0], np.cumsum(shared)))
            fragment = np.searchsorted(np.array(PIVOTS), classes, "right")
            out = []
            for i in use.tolist():
                a, b = cuts[i], cuts[i + 1]
                prefix = max(0, n[i] - least[i] + 1 - (n[i] - shared[i]))
                out.append((known[i].astype(np.int64).item(), n[i], gram[a:b].astype("<u8").tobytes(),
                            np.searchsorted(fragment[a:b], np.arange(len(PIVOTS) + 2)).astype("<i4").tobytes(),
                            gram[a:a + prefix].view(np.int64)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)],
                ["node", "n", "grams", "cuts", "prefix"])

    return run


class _Side:
    """The classes of a tile: sizes and the grams of each fragment."""

    def __init__(self, n: np.ndarray, grams: list[bytes], cuts: list[bytes]):
        self.n = n
        self.grams = [np.frombuffer(g, "<u8") for g in grams]
        self.cuts = np.array([np.frombuffer(c, "<i4") for c in cuts], np.int64).reshape(len(n), len(PIVOTS) + 2)

    def fragment(self, k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.cuts[rows, k], self.cuts[rows, k + 1]
        none = [np.zeros(0, np.uint64)]
        return np.repeat(np.arange(len(rows)), b - a), np.concatenate(none + [self.grams[i][x:y] for i, x, y in zip(rows, a, b, strict=True)])

    def after(self, k: int, rows: np.ndarray) -> np.ndarray:
        """Grams in later fragments."""
        return self.cuts[rows, -1] - self.cuts[rows, k + 1]


def partial_overlaps(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, shape: tuple[int, int], columns: int = 4096) -> np.ndarray:
    """Common grams of each two rows: ``i`` has grams ``x`` and ``j`` has ``y``, each once a row."""
    both = np.intersect1d(x, y)
    u, v = (np.searchsorted(both, g) for g in (x, y))
    at_u, at_v = (np.flatnonzero((c < len(both)) & (both[np.minimum(c, len(both) - 1)] == g)) if len(both) else np.zeros(0, np.int64)
                  for c, g in ((u, x), (v, y)))
    u, i, v, j = u[at_u], i[at_u], v[at_v], j[at_v]
    order = np.argsort(u, kind="stable")
    u, i = u[order], i[order]
    order = np.argsort(v, kind="stable")
    v, j = v[order], j[order]
    many, few = np.bincount(u, minlength=len(both)), np.bincount(v, minlength=len(both))
    out = np.zeros(shape, np.int64)
    # Rare grams: each pair of rows by itself.  The others, of which there are few: a product of 0-1 matrices.
    rare = many * few <= 64
    first = np.concatenate(([0], np.cumsum(few)))
    for a in range(0, len(u), 1 << 15):
        own = np.arange(a, min(a + (1 << 15), len(u)))
        own = own[rare[u[own]]]
        width = few[u[own]]
        out += np.bincount(np.repeat(i[own], width) * shape[1] + j[gather(first[u[own]], width)], minlength=shape[0] * shape[1]).reshape(shape)
    common = np.flatnonzero(~rare)
    for a in range(0, len(common), columns):
        own = common[a:a + columns]
        left, right = np.zeros((shape[0], len(own)), np.float32), np.zeros((shape[1], len(own)), np.float32)
        for matrix, code, row in ((left, u, i), (right, v, j)):
            p, q = np.searchsorted(code, [own[0], own[-1] + 1])
            there = p + np.flatnonzero(~rare[code[p:q]])
            matrix[row[there], np.searchsorted(own, code[there])] = 1
        out += (left @ right.T).astype(np.int64)
    return out


def tile_links(x: _Side, y: _Side, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All links between two tiles (of one with itself, each pair twice): rows of x and of y."""
    a, b = np.arange(len(x.n)), np.arange(len(y.n))
    total = np.zeros((len(a), len(b)), np.int64)
    for k in range(len(PIVOTS) + 1):
        total += partial_overlaps(*x.fragment(k, a), *y.fragment(k, b), total.shape)
        need = -(-percent * (x.n[a][:, None] + y.n[b][None, :]) // (100 + percent))
        open_ = total + np.minimum(x.after(k, a)[:, None], y.after(k, b)[None, :]) >= need
        p, q = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if not len(p):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b, total, open_ = a[p], b[q], total[np.ix_(p, q)], open_[np.ix_(p, q)]
    i, j = np.nonzero(open_)
    return a[i], b[j]


def _compare(percent: int):
    """Task: a spanning forest of the links of each pair of tiles."""
    def run(batches):
        for (_, p, q), held in _runs(batches, ("hub", "p", "q")):
            t = pa.Table.from_batches(held)
            part, node, n = (t.column(c).to_numpy() for c in ("part", "node", "n"))
            grams, cuts = t.column("grams").to_pylist(), t.column("cuts").to_pylist()
            sides = []
            for k in (p, q):
                rows = np.flatnonzero(part == k)
                sides.append((rows, _Side(n[rows], [grams[i] for i in rows], [cuts[i] for i in rows])))
            (rows, x), (others, y) = sides
            if not len(rows) or not len(others):
                continue
            i, j = tile_links(x, x if p == q else y, percent)
            i, j = rows[i], others[j]
            label = _forest(len(node), i, j)
            linked = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], ["a", "b"])

    return run


def jaccard_links(docs: DataFrame, size: int, percent: int, keep: list[str], text: str = "text",
                  dense: int = DENSE, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Rows (``row`` of the columns kept, ``node``, ``n`` grams) and links (a, b) of their nodes.

    Two texts are linked if 100 * intersection >= ``percent`` * union of their sets of
    shingles of ``size`` words; the links given connect all that are.
    """
    spark = docs.sparkSession
    bits = max(2, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    sent = docs.select(docs[text].cast("string").alias("text"), F.struct(*[docs[c] for c in keep]).alias("row"))
    spark_type = sent.schema["row"].dataType.simpleString()
    schema = f"kind int, bucket int, block binary, row {spark_type}, node long, n long"

    spread = sent.mapInArrow(_spread(size, bits, dense), schema)
    counted = written(spread.repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions("kind", "bucket")
                      .mapInArrow(_count_classes(bits), schema), "grams")
    rows = counted.where(f"kind = {ROW}").select("row", "node", "n")
    blocks = counted.where(f"kind = {POSTINGS}").select("bucket", "block")
    classes = written(blocks.repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(
        _gather_classes(percent), "node long, n long, grams binary, cuts binary, prefix array<long>"), "classes")

    prefixes = classes.select("node", F.explode("prefix").alias("gram"))
    hubs = prefixes.groupBy("gram").agg(F.min("node").alias("hub"), F.count("*").alias("m")).where("m > 1").select("gram", "hub")
    members = written(prefixes.join(hubs, "gram").select("hub", "node").distinct(), "members")
    tiles = members.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = (members.join(tiles, "hub").withColumn("part", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
             .join(classes.drop("prefix"), "node").withColumn("other", other)
             .select("hub", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "n", "grams", "cuts"))
    links = (dealt.repartition("hub", "p", "q").sortWithinPartitions("hub", "p", "q")
             .mapInArrow(_compare(percent), "a long, b long"))
    return rows, links


def roots(rows: DataFrame, links: DataFrame, least) -> DataFrame:
    """(node, root, least): each class with a root of its component and the least value over all its rows."""
    own = rows.where("node is not null").groupBy("node").agg(F.min(least).alias("own"))
    stars = components(links)
    member = own.join(stars, F.col("node") == F.col("a"), "left").select("node", "own", F.coalesce("b", "node").alias("root"))
    return member.join(member.groupBy("root").agg(F.min("own").alias("least")), "root").select("node", "root", "least")


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85, **options) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable by links, itself included) of every row.

    A null id has no part in the least; a component of null ids only has a null id.
    """
    rows, links = jaccard_links(docs, size, percent, [doc_id], text, **options)
    rows = rows.select(F.col(f"row.{doc_id}").alias("doc_id"), "node", F.col("n").alias("n_shingles"))
    found = roots(rows, links, F.col("doc_id")).select(F.col("node").alias("of"), "least")
    joined = rows.join(found, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))
