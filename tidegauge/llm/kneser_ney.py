"""Interpolated modified Kneser-Ney scores of any order from memory-mapped hash arrays.

Counting is in Spark.  Each task counts the grams of ``order`` words of its documents and
sends them, packed, to buckets of their context (all words but the last).  A bucket adds
them up and writes two sorted arrays of hashes, grams with their counts and contexts with
their sums; and it passes each gram on without its first word, once, to the buckets of the
next order, whose counts are these continuations.  So it goes down to two words.  A hot
word or context is pre-summed by every task and bucket.

The model is a folder of arrays.  Hashes are kept by 44 bits a bucket; all numbers of a
hash are one code of half a byte or a byte, with a list of the rarer ones beside it.
Workers map the files into memory and look up the distinct grams of a batch.  Only a dozen
sums an order come to the driver.

A word's tokens are the sum of the counts of two words that it ends, and what the counts of
longer grams that it ends are above one: for each order counts the grams of the next.  So
the buckets of longer grams hand on words of repeated grams only.

Words are known by 48-bit hashes (see the README for the error that this and the 44 bits
make).

Texts are lower-cased in A-Z; tokens are the words and one end, after ``order`` - 1
starts.  A null text counts as empty and has the end only.  Repeated rows count each time.
Without training tokens every score is 0.  Columns kept are in a struct, so no name can
clash.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import hash_arrays
from tidegauge.llm.batches import annotate, buffer_of, encode, lower, pieces, row_sums, word_spans
from tidegauge.llm.jaccard_join import _pack, _runs, _steps, _unpack
from tidegauge.session import freed_shuffles, hadoop_path, work_dir

ORDER = 3
#: Grams that a task holds before it sends them on.
FLUSH = 3_000_000


#: The bits of a word's hash.
_WORD = np.uint64((1 << 48) - 1)


def _hash48(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & int(_WORD)


# Neither can be a word.
START, END = _hash48(b" "), _hash48(b"\n")


def _mix(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of word hashes."""
    x = first * np.uint64(0x9E3779B97F4A7C15) ^ (second + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _tokens(texts: pa.Array):
    """Hashes of the distinct tokens, token codes (each row closed by the end), and the row offsets."""
    raw, offsets = buffer_of(texts)
    raw = lower(raw)
    starts, ends, rows = word_spans(raw, offsets)
    codes, distinct = encode(raw, starts, ends)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_numpy(zero_copy_only=False)), np.uint64, len(distinct)) & _WORD
    n = len(hashes)
    closed = np.insert(codes.astype(np.int64), rows[1:], n)
    return np.append(hashes, np.array([END, START], np.uint64)), closed, rows + np.arange(len(rows))


def _before(words: np.ndarray, rows: np.ndarray, back: int, start) -> np.ndarray:
    """The value ``back`` places before each token of its row, or the start."""
    out = np.full(len(words), start, words.dtype)
    out[back:] = words[:-back] if back else words
    first = np.repeat(rows[:-1], np.diff(rows))
    out[np.arange(len(words)) - first < back] = start
    return out


def _hash_of(words: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(words[0]), 0x243F6A8885A308D3, np.uint64)
    for w in words:
        out = _mix(out, w)
    return out


def _summed(words: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct grams, their hashes (sorted) and sums."""
    key = _hash_of(words)
    order = np.argsort(key)
    key, n = key[order], n[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return [w[order][at] for w in words], key[at], np.add.reduceat(n, at) if len(at) else n


def _sorted_steps(places: np.ndarray) -> list[np.ndarray]:
    """Columns of sorted rows, each number as its distance to the row before where that agrees in all columns before."""
    out, same = [], np.arange(places.shape[1]) > 0
    for p in places:
        before = np.append(np.uint64(0), p[:-1])
        out.append(np.where(same, p - before, p))
        same = same & (p == before)
    return out


def _sorted_rows(steps: list[np.ndarray]) -> list[np.ndarray]:
    """The columns that ``_sorted_steps`` was given."""
    out, same = [], np.arange(len(steps[0])) > 0
    for d in steps:
        total, at = np.cumsum(d), np.flatnonzero(~same)
        out.append(total - np.repeat((total - d)[at], np.diff(np.append(at, len(d)))))
        same = same & (d == 0)
    return out


def _blocks(bucket: np.ndarray, words: list[np.ndarray], n: np.ndarray):
    """(bucket, block) of grams: the words of a block are numbered, frequent ones first, and grams sorted by them.

    ``n``: a number a gram, or a row of them.
    """
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cuts):
        own, place, times = np.unique(np.concatenate([w[rows] for w in words]), return_inverse=True, return_counts=True)
        # By powers of two: numbers of like size have like bytes, and hashes in sorted runs small steps.
        first = np.argsort((64 - np.frexp(times)[1]).astype(np.uint8), kind="stable")
        number = np.empty(len(own), np.uint64)
        number[first] = np.arange(len(own), dtype=np.uint64)
        own, place = own[first], number[place.reshape(len(words), -1)]
        width = len(own).bit_length()
        if width * len(words) <= 64:  # one number a gram
            key = place[0]
            for p in place[1:]:
                key = key << np.uint64(width) | p
            by = np.argsort(key)
        else:
            by = np.lexsort(place[::-1])
        yield int(bucket[rows[0]]), _pack(_steps(own), *n[rows][by].reshape(len(rows), -1).T, *_sorted_steps(place[:, by]))


def _grams(blocks: list[bytes], numbers: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    words, counts = [], []
    for block in blocks:
        steps, *columns = _unpack(block)
        own = np.cumsum(steps, dtype=np.uint64)
        words.append([own[p.astype(np.int64)] for p in _sorted_rows(columns[numbers:])])
        counts.append(np.column_stack(columns[:numbers]).astype(np.int64))
    n = np.concatenate(counts)
    return [np.concatenate(c) for c in zip(*words, strict=True)], n[:, 0] if numbers == 1 else n


def _rows(kind: str, items, stats: str = "") -> pa.RecordBatch:
    buckets, blocks = zip(*items, strict=True) if (items := list(items)) else ((), ())
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(buckets), pa.string()), pa.array(buckets, pa.int32()), pa.array(blocks, pa.binary()),
         pa.array([stats] * len(buckets), pa.string())], ["kind", "bucket", "block", "stats"])


SCHEMA = "kind string, bucket int, block binary, stats string"

# A table: hashes by 12 bits (offsets) and the 32 after those; a code for the numbers of each, the last one for those in a list.
_SCATTER = np.uint64(0xD6E8FEB86659FD93)


def _save_table(uri: str, name: str, keys: np.ndarray, columns: list[np.ndarray]) -> None:
    scattered = keys * _SCATTER
    order = np.argsort(scattered)
    short = scattered[order] >> np.uint64(20)
    hash_arrays.save(uri, f"{name}.offsets", np.searchsorted(short >> np.uint64(32), np.arange(4097)).astype("<i8"))
    hash_arrays.save(uri, f"{name}.keys", (short & np.uint64(0xFFFFFFFF)).astype("<u4"))
    numbers = np.stack([c[order] for c in columns])
    width, size = numbers.shape
    each = 16 // width
    small = numbers.max(axis=0) < 1 << each
    packed = np.zeros(size, np.int64)
    for c in numbers:
        packed = packed << each | np.where(small, c, 0)
    seen = np.bincount(packed[small], minlength=1 << 16)
    common = np.argsort(-seen, kind="stable")[:255]
    number_bytes = 4 if max(size, numbers.max(initial=0)) < 1 << 32 else 8
    takes = {bits: size * bits // 8 + (size - int(seen[common[:(1 << bits) - 1]].sum())) * (1 + width) * number_bytes for bits in (4, 8)}
    bits = min(takes, key=takes.get)
    last = (1 << bits) - 1
    code_of = np.full(1 << 16, last, np.uint8)
    code_of[common[:last]] = np.arange(last)
    codes = np.where(small, code_of[packed], np.uint8(last))
    large = np.flatnonzero(codes == last)
    if bits == 4:
        codes = np.append(codes, np.zeros(size % 2, np.uint8))
        codes = codes[::2] | codes[1::2] << 4
    hash_arrays.save(uri, f"{name}.codes", codes)
    hash_arrays.save(uri, f"{name}.common", np.concatenate(
        ((bits, number_bytes), *((common[:last] >> each * i) & ((1 << each) - 1) for i in reversed(range(width))))).astype("<i8"))
    hash_arrays.save(uri, f"{name}.large", np.concatenate((large, *numbers[:, large])).astype(f"<u{number_bytes}"))


def _find_in(uri: str, name: str, keys: np.ndarray, width: int) -> list[np.ndarray]:
    """Numbers of each key in one table, 0 for one that is not there."""
    out = [np.zeros(len(keys), np.int64) for _ in range(width)]
    # Plain arrays on the mapped files: numpy wraps each result of a mapped one anew.
    offsets, own = (np.asarray(hash_arrays.load(uri, f"{name}.{x}", t)) for x, t in (("offsets", "<i8"), ("keys", "<u4")))
    if not len(own):
        return out
    short = (keys * _SCATTER) >> np.uint64(20)
    part, want = (short >> np.uint64(32)).astype(np.int64), (short & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    low, end = offsets[part], offsets[part + 1]
    step = 1 << int((end - low).max(initial=0)).bit_length() >> 1
    while step:  # past as many smaller ones as there are, by halves
        probe = low + step
        low = np.where((probe <= end) & (own[np.minimum(probe, len(own)) - 1] < want), probe, low)
        step >>= 1
    found = np.flatnonzero((low < end) & (own[np.minimum(low, len(own) - 1)] == want))
    at = low[found]
    (bits, number_bytes), common = np.split(np.asarray(hash_arrays.load(uri, f"{name}.common", "<i8")), [2])
    codes, last = np.asarray(hash_arrays.load(uri, f"{name}.codes", "u1")), (1 << int(bits)) - 1
    code = codes[at] if bits == 8 else codes[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & np.uint8(15)
    listed = np.flatnonzero(code == last)
    if len(listed):
        places, *large = np.asarray(hash_arrays.load(uri, f"{name}.large", f"<u{number_bytes}")).reshape(1 + width, -1)
        row = np.searchsorted(places, at[listed].astype(places.dtype))
    for i, own in enumerate(common.reshape(width, last)):
        n = np.append(own, 0)[code]
        if len(listed):
            n[listed] = large[i][row]
        out[i][found] = n
    return out


def train(docs: DataFrame, folder: str, text: str = "text", bits: int | None = None, order: int = ORDER) -> dict:
    """Count all documents and write the model's arrays; gives its sums and discounts.

    ``bits``: there are 2**bits buckets of grams and of words; by default about as
    many as the session's shuffle partitions.
    """
    if order < 2:
        raise ValueError("the order is two or more")
    spark = docs.sparkSession
    uri = hash_arrays.make_folder(folder)
    if bits is None:
        bits = max(2, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    shift = np.uint64(64 - bits)
    bucket_of = lambda words: (_hash_of(words) >> shift).astype(np.int32)

    def count(batches):
        held: list = []
        size = 0

        def flush():
            words, _, n = _summed([np.concatenate(c) for c in zip(*(w for w, _ in held), strict=True)], np.concatenate([n for _, n in held]))
            return _rows("gram", _blocks(bucket_of(words[:-1]), words, n))

        for piece in pieces(batches):
            hashes, codes, rows = _tokens(piece.column("text"))
            tokens = hashes[codes]
            words, _, n = _summed([_before(tokens, rows, back, START) for back in range(order - 1, 0, -1)] + [tokens],
                                  np.ones(len(tokens), np.int64))
            held.append((words, n))
            size += len(n)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def merge(k: int):
        def run(batches):
            sums = np.zeros(5, np.int64)
            for (bucket,), part in _runs(batches, ("bucket",)):
                words, n = _grams([x for b in part for x in b.column("block").to_pylist()])
                words, key, n = _summed(words, n)
                _save_table(uri, f"gram{k}-{bucket}", key, [n])
                sums += [len(n), *((n == c).sum() for c in (1, 2, 3, 4))]
                context = _hash_of(words[:-1])
                by = np.argsort(context)
                context, counts = context[by], n[by]
                at = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
                add = lambda values: np.add.reduceat(values.astype(np.int64), at)
                _save_table(uri, f"context{k}-{bucket}", context[at], [add(counts), add(counts == 1), add(counts == 2), add(counts > 2)])
                # What the next order counts; and of each last word the counts beyond one, at the end the counts and the grams of two.
                if k > 2:
                    yield _rows("gram", _blocks(bucket_of(words[1:-1]), words[1:], np.ones(len(n), np.int64)))
                    more = n > 1
                    last, key, beyond = _summed([words[-1][more]], n[more] - 1)
                    yield _rows("tokens", _blocks((key >> shift).astype(np.int32), last, beyond))
                else:
                    last, key, both = _summed(words[-1:], np.column_stack((n, np.ones(len(n), np.int64))))
                    yield _rows("kinds", _blocks((key >> shift).astype(np.int32), last, both))
            yield _rows("sums", [(0, b"")], json.dumps(sums.tolist()))

        return run

    def merge_words(batches):
        sums = np.zeros(7, np.int64)
        for (bucket,), part in _runs(batches, ("bucket",)):
            keys, columns = [], []
            for kind in ("tokens", "kinds"):
                blocks = [x for b in part for x in b.filter(pa.compute.equal(b.column("kind"), kind)).column("block").to_pylist()]
                if blocks:
                    (word,), n = _grams(blocks, 1 if kind == "tokens" else 2)
                    keys.append(word)
                    columns.append((n, np.zeros_like(n)) if kind == "tokens" else tuple(n.T))
            word, of = np.unique(np.concatenate(keys), return_inverse=True)
            n, kinds = (np.bincount(of, np.concatenate(c), len(word)).astype(np.int64) for c in zip(*columns, strict=True))
            _save_table(uri, f"word-{bucket}", _hash_of([word]), [n, kinds])
            sums += [n.sum(), (n > 0).sum(), *((kinds == k).sum() for k in (1, 2, 3, 4)), (kinds > 2).sum()]
        yield _rows("sums", [(0, b"")], json.dumps(sums.tolist()))

    def deal(df: DataFrame, *columns: str) -> DataFrame:
        return df.select("bucket", "block", *columns).repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions("bucket")

    def total(df: DataFrame, width: int) -> list[int]:
        return np.sum([np.zeros(width, np.int64), *(
            json.loads(r.stats) for r in df.where("kind = 'sums'").select("stats").collect())], axis=0).tolist()

    current = docs.select(docs[text].cast("string").alias("text")).mapInArrow(count, SCHEMA)
    levels, words, used = {}, None, None
    with freed_shuffles(spark):
        for k in range(order, 1, -1):
            path = work_dir(spark, f"grams{k}")
            deal(current.where("kind = 'gram'")).mapInArrow(merge(k), SCHEMA).write.partitionBy("kind").parquet(path)
            current = spark.read.schema(SCHEMA).parquet(path)
            # Grams that were handed on are in this order's model; the rest of their table is read at the end.
            if used:
                files, folder = hadoop_path(spark, used)
                files.delete(folder, True)
            used = f"{path}/kind=gram"
            kinds, *ones = total(current, 5)
            levels[k] = {"kinds": kinds, "discounts": discounts(ones)}
            own = current.where("kind in ('tokens', 'kinds')")
            words = own if words is None else words.unionAll(own)
        sums = total(deal(words, "kind").mapInArrow(merge_words, SCHEMA), 7)
    d = discounts(sums[2:6])
    return {"uri": uri, "bits": bits, "order": order, "levels": levels, "kinds": levels[2]["kinds"], "tokens": sums[0], "vocabulary": sums[1],
            "word_discounts": d,
            # The mass that the discounts of words leave: once, twice, more.
            "left": d[0] * sums[2] + d[1] * sums[3] + d[2] * sums[6]}


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts from the numbers of things seen once to four times.

    Where a number is zero the discount falls back to the plain one, or to one half.
    """
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a else y
        out.append(min(max(d, 0.0), float(k)) if a and b else min(y, float(k)))
    return out


def _find(model: dict, name: str, bucket: np.ndarray, keys: np.ndarray, width: int) -> list[np.ndarray]:
    """Numbers of keys, bucket by bucket; 0 for one that is not there."""
    out = [np.zeros(len(keys), np.int64) for _ in range(width)]
    order = np.argsort(bucket.astype(np.uint16) if model["bits"] <= 16 else bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange((1 << model["bits"]) + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        rows = order[cuts[b]:cuts[b + 1]]
        for column, found in zip(out, _find_in(model["uri"], f"{name}-{b}", keys[rows], width), strict=True):
            column[rows] = found
    return out


def score_batch(texts: pa.Array, model: dict) -> list[np.ndarray]:
    """Per row: n_tokens, n_known, train_tokens, base_score, score."""
    hashes, codes, rows = _tokens(texts)
    shift = np.uint64(64 - model["bits"])
    key = _hash_of([hashes])
    n, kinds = _find(model, "word", (key >> shift).astype(np.int64), key, 2)
    vocabulary, tokens = model["vocabulary"], model["tokens"]
    base = np.log10((n + 0.1) / (tokens + 0.1 * (vocabulary + 1)))

    # Words by continuations, interpolated with one over vocabulary and unknown word.
    d = np.array([0.0, *model["word_discounts"]])
    if model["kinds"]:
        word = np.maximum(kinds - d[np.minimum(kinds, 3)], 0) / model["kinds"]
        word = word + model["left"] / model["kinds"] / (vocabulary + 1)
    else:
        word = np.ones(len(n))
    p = word[codes]
    words = hashes[codes]
    context = [words[:0]]
    for k in range(2, model["order"] + 1 if model["kinds"] else 2):
        d = np.array([0.0, *model["levels"][k]["discounts"]])
        context = _hash_of([_before(words, rows, back, START) for back in range(k - 1, 0, -1)])
        gram, where = np.unique(_mix(context, words), return_inverse=True)
        at = np.empty(len(gram), np.int64)
        at[where] = np.arange(len(where))
        (c,) = _find(model, f"gram{k}", (context[at] >> shift).astype(np.int64), gram, 1)
        context, of = np.unique(context, return_inverse=True)
        total, *seen = _find(model, f"context{k}", (context >> shift).astype(np.int64), context, 4)
        back = (d[1] * seen[0] + d[2] * seen[1] + d[3] * seen[2]) / np.maximum(total, 1)
        own = np.maximum(c - d[np.minimum(c, 3)], 0)[where] / np.maximum(total, 1)[of]
        p = np.where(total[of] > 0, own + back[of] * p, p)
    n_rows = len(rows) - 1
    return [np.diff(rows), row_sums((n > 0)[codes].astype(np.int64), rows), np.full(n_rows, tokens, np.int64),
            row_sums(base[codes], rows), row_sums(np.log10(p), rows)]


def score(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` and ``out``: n_tokens, n_known, train_tokens, base_score, score (base-10 logarithms)."""
    return annotate(docs, text, lambda: lambda t: score_batch(t, model),
                    "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double", keep)


def held_out(doc_id: str = "doc_id", folds: int = 10):
    """Whether crc32 of the id as text is divisible by ``folds``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def perplexity(log10_probability: float, tokens: int) -> float:
    """Of a text, from its score."""
    return 10 ** (-log10_probability / max(tokens, 1))
