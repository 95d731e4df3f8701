"""Every operator against its plain version, on the small table and hard cases."""

import glob
import hashlib
import itertools
import math
import os
import pickle
import random
import tempfile
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import SMALL, by_id
from tidegauge.llm import (
    binary_output, bpe, components, decontaminate, hash_arrays, kneser_ney, language, quality, secret_scan, segments, sharding, simhash, suffix_arrays,
)
from tidegauge import session
from tidegauge.session import work_dir

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def plain(df):
    return by_id([tuple(r) for r in df.collect()])


class TestBinaryOutput:
    def test_known_segments_cost_less_than_arrow_scalars(self):
        """Measured beside each other: a scalar for each segment took most of the time of a known one."""
        words = pa.array([b" w%d" % i for i in range(200_000)], pa.binary())
        cache = segments.SegmentCache(lambda many: [([len(s), 7],) for s in many], (np.uint32,))
        numbers = cache.find(words)
        ids, cuts = cache.join(0, numbers[:3], np.arange(4))
        assert ids.dtype == np.uint32 and ids.tolist() == [3, 7] * 3 and cuts.tolist() == [0, 2, 4, 6]
        assert (cache.find(words) == numbers).all()

        def seconds(run):
            start = time.process_time()
            run()
            return time.process_time() - start

        assert min(seconds(lambda: cache.find(words)) for _ in range(5)) < 0.7 * min(seconds(words.to_pylist) for _ in range(5))

    def test_full_cache_keeps_what_was_found_again(self):
        asked = []
        cache = segments.SegmentCache(lambda many: asked.extend(many) or [([len(s), s[0]],) for s in many], (np.uint32,), limit=8)
        ids = lambda words: cache.join(0, cache.find(pa.array(words, pa.binary())), np.arange(len(words) + 1))[0].tolist()
        ids([b"a", b"bb", b"c1", b"c2"])
        ids([b"bb", b"a", b"c3"])
        asked.clear()
        assert ids([b"d", b"bb", b"c1", b"a", b"eee"]) == [1, 100, 2, 98, 2, 99, 1, 97, 3, 101]
        assert asked == [b"d", b"c1", b"eee"] and len(cache.index) == 5

    def test_cases_and_white_space_are_one_segment(self):
        words = binary_output.WordTokenizer(WORDS)
        rng = np.random.default_rng(3)
        some = list("AaHhTtWwYyJjIisSvVeE.,!'<|>\t\n\x0b\r 09\u0331\u0308\u030a\u030c\u0307\u0301\x85\xa0\u3000\u0130\u03a3\xe9")
        texts = ["The\tthe\nTHE the", "H\u0331 T\u0308 W\u030a J\u030c I\u0307", "I'LL <|ENDOFTEXT|> x<|endoftext|>Y", None, "", "A\x1cB\x85C \x0bD",
                 *("".join(rng.choice(some, rng.integers(1, 30))) for _ in range(3000))]
        assert len(segments.segment(pa.array(texts[:1]), words.folded)[1]) == 2
        ids, lengths = words.batch(pa.array(texts), 2)
        got = np.split(ids, np.cumsum(lengths)[:-1])
        assert [x.tolist() for x in got] == [words.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]

    def test_only_own_rows_are_searched_for_names(self, monkeypatch):
        words = binary_output.WordTokenizer(WORDS)
        read = []
        monkeypatch.setattr(binary_output, "buffer_of", lambda t: read.append(len(t)) or segments.buffer_of(t))
        texts = pa.array(["a <|endoftext|>", "b c", "d"])
        lengths = [words.batch(texts.slice(i, 1), 2)[1].tolist() for i in range(3)]
        assert lengths == [[3], [3], [2]] and read == [1, 1, 1]

    def test_against_library(self, spark, docs, rows):
        folder = work_dir(spark, "t")
        files = binary_output.write_tokens(docs, folder, WORDS, 2)
        got = [tuple(r) for r in binary_output.read_tokens(spark, folder, files).orderBy("start").collect()]
        want = Counter((d, n, c) for d, _, n, c in brute.token_rows(rows))
        assert Counter((d, n, c) for d, _, n, c in got) == want
        ids = [-1 << 63 if d is None else d for d, *_ in got]
        assert ids == sorted(ids)
        assert [s for _, s, *_ in got] == np.concatenate(([0], np.cumsum([n for _, _, n, _ in got])[:-1])).tolist()

    def test_no_documents(self, spark, empty):
        folder = work_dir(spark, "t")
        files = binary_output.write_tokens(empty, folder, WORDS, 2)
        assert files == [] and binary_output.read_tokens(spark, folder, files).count() == 0

    @pytest.mark.parametrize("vocabulary", [2, 300, 49408, 70_000, 2**31])
    def test_packing(self, vocabulary):
        bits = binary_output.width(vocabulary)
        assert 2**bits >= vocabulary > 2 ** (bits - 1)
        ids = np.random.default_rng(1).integers(0, vocabulary, 999).astype(np.uint32)
        data = binary_output.pack(ids, bits)
        assert len(data) == -(-999 * bits // 8)
        assert (binary_output.unpack(data, 999, bits) == ids).all()

    def test_random_access(self, tmp_path):
        from pyarrow import fs
        rng = np.random.default_rng(2)
        parts = [rng.integers(0, 70_000, n).astype(np.uint32) for n in (0, 5000, 3, 9000)]
        path = str(tmp_path / "x")
        binary_output.write_file(fs.LocalFileSystem(), path, parts[:2] + parts[2:], np.array([len(p) for p in parts]), 17)
        f = binary_output.TokenFile(fs.LocalFileSystem(), path)
        flat = np.concatenate(parts)
        assert all((f.document(i) == p).all() for i, p in enumerate(parts))
        for a, b in ((0, 1), (4095, 4097), (4096, 8192), (100, len(flat)), (7, 7)):
            assert (f.read(a, b) == flat[a:b]).all()


class TestByteBpe:
    def test_against_library(self, docs, rows):
        got = plain(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep=["doc_id"], arrays=False).select("row.doc_id", "out.*"))
        assert got == by_id(brute.bpe_rows(rows))

    def test_round_trip(self, docs, rows):
        encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep=["doc_id", "text"]).select("row.text", "out.ids")
        for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).select("row.text", "decoded").collect():
            assert bytes(r.decoded) == (r.text or "").encode()

    def test_long_pre_tokens(self):
        """Ten thousand of 180 bytes, some of 100 KB, and whole texts over one piece of bytes."""
        rng = random.Random(4)
        common = [chr(0x4E00 + rng.randrange(1500)) for _ in range(600)]
        runs = ["".join(rng.choices(common, k=60)) for _ in range(10_000)]
        long = ["x" * 100_000, "ab" * 50_000 + "a", "".join(rng.choices(common, k=33_000)), "กขค" * 11_000, "=" * 100_001,
                "aab" * 3000 + "abb" * 3000, "x" * 1_000_000]
        texts = [" ".join(runs), *long, "".join(rng.choices("etaoinshr", k=3000)), "日本語のテキスト。" * 160_000]
        codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
        want = brute.bpe_rows(list(enumerate(texts)))
        for text, (_, n, ids_sha, text_sha) in zip(texts, want, strict=True):
            ids, _, data, _ = codec.batch(pa.array([text]))
            assert len(ids) == n and hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() == ids_sha
            assert hashlib.sha256(data.tobytes()).hexdigest() == text_sha

    @given(st.lists(st.text(alphabet="abxé日 ", min_size=1, max_size=300), min_size=1, max_size=8))
    @settings(max_examples=25, deadline=None)
    def test_any_words(self, texts):
        codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
        want = [n for _, n, *_ in brute.bpe_rows(list(enumerate(texts)))]
        ids = [codec.batch(pa.array([t]))[0] for t in texts]
        assert list(map(len, ids)) == want
        shas = [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]
        assert shas == [r[2] for r in brute.bpe_rows(list(enumerate(texts)))]

    def test_null_and_unknown_ids(self, spark, empty):
        frame = spark.createDataFrame([(None,), ([],), ([50],)], "ids array<int>")
        assert [r.decoded for r in bpe.decode(frame, RANKS, public_tokenizers.PATTERN).collect()][:2] == [None, b""]
        bad = spark.createDataFrame([([999_999],)], "ids array<int>")
        with pytest.raises(Exception, match="not in the vocabulary"):
            bpe.decode(bad, RANKS, public_tokenizers.PATTERN).collect()
        assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0

    def test_single_words(self):
        import tiktoken

        codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
        rng = np.random.default_rng(5)
        for _ in range(200):
            word = bytes(rng.choice(list(b"abeinrst"), rng.integers(2, 60)))
            assert codec.encode_words([word])[0].tolist() == library._encode_single_piece(word)


class TestKneserNey:
    def test_used_grams_are_freed(self, spark, docs):
        """What an order has handed on is deleted when the next has counted it."""
        kneser_ney.train(docs, work_dir(spark, "t"), bits=2, order=3)
        left = {k: spark.read.parquet([p for p in session._named if f"/grams{k}-" in p][-1]) for k in (3, 2)}
        assert left[3].where("kind = 'gram'").isEmpty() and not left[3].where("kind = 'tokens'").isEmpty()
        assert not left[2].where("kind = 'kinds'").isEmpty()

    def test_used_shuffles_are_freed(self, spark, docs):
        """No shuffle of the training is left when it ends, and the setting is as it was."""
        blocks = lambda: {(d, f) for top in glob.glob(f"{local}/**/blockmgr-*", recursive=True) for d, _, fs in os.walk(top)
                          for f in fs if f.startswith("shuffle_")}
        local = spark.sparkContext._jsc.sc().getConf().get("spark.local.dir", tempfile.gettempdir())
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before, was = blocks(), spark.conf.get(key)
        kneser_ney.train(docs, work_dir(spark, "t"), bits=2, order=3)
        end = time.time() + 10
        while blocks() - before and time.time() < end:
            time.sleep(0.1)
        assert not blocks() - before and spark.conf.get(key) == was

    def test_known_keys_are_found_and_others_not(self, tmp_path):
        rng = np.random.default_rng(5)
        for size in (0, 1, 2, 3, 5000, 200_000):
            keys = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            n = rng.integers(1, 600, len(keys))
            kneser_ney._save_table(str(tmp_path), f"t{size}", keys, [n])
            others = rng.integers(1 << 63, (1 << 64) - 1, 1000, dtype=np.uint64)
            (got,) = kneser_ney._find_in(str(tmp_path), f"t{size}", np.concatenate((others, keys)), 1)
            assert not got[:1000].any() and (got[1000:] == n).all()

    @pytest.mark.parametrize("top, size", [(1 << 14, 3.3), (1 << 47, 7.8)])
    def test_blocks_of_grams(self, top, size):
        rng = np.random.default_rng(7)
        words = [rng.integers(0, top, 40_000).astype(np.uint64) % np.uint64(300 if i < 2 else top) for i in range(3)]
        words, key, n = kneser_ney._summed(words, np.ones(40_000, np.int64))
        blocks = list(kneser_ney._blocks((key >> np.uint64(61)).astype(np.int32), words, n))
        got = kneser_ney._summed(*kneser_ney._grams([b for _, b in blocks]))
        assert sorted(b for b, _ in blocks) == list(range(8))
        assert (got[1] == key).all() and (got[2] == n).all() and all((a == b).all() for a, b in zip(got[0], words, strict=True))
        # Words that repeat from row to row take little: 3.0 and 7.6 bytes a gram, as plain numbers 3.5 and 7.9.
        assert sum(len(b) for _, b in blocks) < len(n) * size

    @pytest.mark.parametrize("order", [2, 3, 4])
    def test_against_plain(self, spark, docs, rows, order):
        model = kneser_ney.train(docs.where(~kneser_ney.held_out()), work_dir(spark, "t"), bits=3, order=order)
        got = plain(kneser_ney.score(docs, model, keep=["doc_id"]).select("row.doc_id", "out.*"))
        want, _ = brute.kneser_ney([t for d, t in rows if not brute.held_out(d, 10)], [t for _, t in rows], order)
        want = by_id([(d, *w) for (d, _), w in zip(rows, want)])
        for g, w in zip(got, want, strict=True):
            assert g[:4] == w[:4]
            assert g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=1e-9)

    @pytest.mark.parametrize("order", [2, 3, 4])
    def test_sums_to_one(self, order):
        _, (count, probability) = brute.kneser_ney(["a b a c", "b b c d a", "a b", "d d d a b c"], [], order)
        for context in itertools.product(("<s>", ("w", "a"), ("w", "b"), ("w", "unseen")), repeat=order - 1):
            assert sum(probability((*context, ("w", w))) for w in [*count, "new"]) == pytest.approx(1)

    def test_a_longer_order_tells_more(self, spark):
        docs = spark.createDataFrame([(i, "one two three four five six " * 3) for i in range(30)] + [
            (i + 50, "two one four three six five " * 3) for i in range(30)], "doc_id long, text string")
        scores = []
        for order in (2, 3):
            model = kneser_ney.train(docs, work_dir(spark, "t"), order=order)
            scores.append(kneser_ney.score(docs, model).agg(F.sum("out.score")).first()[0])
        assert scores[1] > scores[0]
        with pytest.raises(ValueError, match="two or more"):
            kneser_ney.train(docs, work_dir(spark, "t"), order=1)

    def test_beats_the_base_on_held_out(self, spark):
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
        model = kneser_ney.train(docs.where(~kneser_ney.held_out()), work_dir(spark, "t"))
        r = kneser_ney.score(docs.where(kneser_ney.held_out()), model).agg(F.sum("out.score"), F.sum("out.base_score")).first()
        assert r[0] > r[1]

    def test_nothing_to_learn(self, spark, docs, empty):
        model = kneser_ney.train(empty, work_dir(spark, "t"), bits=2)
        assert kneser_ney.score(docs, model).agg(F.sum(F.abs("out.score"))).first()[0] == 0

    def test_blocks_round_trip(self):
        rng = np.random.default_rng(6)
        words = [rng.integers(0, 2**48, 200).astype(np.uint64)[rng.integers(0, 200, 900)] for _ in range(3)]
        n, bucket = rng.integers(1, 2**40, 900), rng.integers(0, 5, 900).astype(np.int32)
        found = []
        for b, block in kneser_ney._blocks(bucket, words, n):
            own, counts = kneser_ney._grams([block])
            found += zip([b] * len(counts), *(w.tolist() for w in own), counts.tolist(), strict=True)
        assert sorted(found) == sorted(zip(bucket.tolist(), *(w.tolist() for w in words), n.tolist(), strict=True))

    def test_blocks_of_frequent_words(self):
        """Words that many grams have get the small numbers, so that a gram takes less."""
        rng = np.random.default_rng(8)
        hashes = rng.integers(0, 2**48, 20_000, dtype=np.uint64)
        words = [hashes[np.minimum(rng.zipf(1.3, 60_000), 20_000) - 1] for _ in range(3)]
        words, _, n = kneser_ney._summed(words, np.ones(60_000, np.int64))
        (_, block), = kneser_ney._blocks(np.zeros(len(n), np.int32), words, n)
        # 2.6 bytes a gram; 3.5 where they are numbered by their hashes.
        assert len(block) < 3 * len(n)
        got = kneser_ney._summed(*kneser_ney._grams([block]))
        want = kneser_ney._summed(words, n)
        assert (got[1] == want[1]).all() and (got[2] == want[2]).all() and all((a == b).all() for a, b in zip(got[0], want[0], strict=True))

    def test_blocks_of_two_numbers(self):
        rng = np.random.default_rng(9)
        words, n = [rng.permutation(500).astype(np.uint64)], rng.integers(1, 2**40, (500, 2))
        (word,), got = kneser_ney._grams([b for _, b in kneser_ney._blocks(rng.integers(0, 3, 500).astype(np.int32), words, n)], 2)
        assert (got[np.argsort(word)] == n[np.argsort(words[0])]).all()

    def test_tables_are_small(self, tmp_path):
        """The numbers of a hash take a byte or less, however many they are."""
        rng = np.random.default_rng(10)
        keys = np.unique(rng.integers(0, 2**64, 300_000, dtype=np.uint64))
        once, twice, more = (rng.geometric(p, len(keys)) - 1 for p in (0.5, 0.9, 0.97))
        seldom = rng.integers(0, len(keys), 500)
        once[seldom] = rng.integers(0, 2**40, 500)
        contexts = [once + 2 * twice + 3 * more + 1, once, twice, more]
        for name, values, most in (("context", contexts, 5.4), ("gram", [rng.geometric(0.8, len(keys))], 4.7)):
            kneser_ney._save_table(str(tmp_path), name, keys, values)
            assert sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/{name}.*")) < most * len(keys)
            for got, want in zip(kneser_ney._find_in(str(tmp_path), name, keys, len(values)), values, strict=True):
                assert (got == want).all()

    def test_only_words_of_repeated_grams_are_handed_on(self, spark):
        docs = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "x y"), (4, "x z")], "doc_id long, text string")
        model = kneser_ney.train(docs, work_dir(spark, "t"), bits=2, order=3)
        left = spark.read.parquet([p for p in session._named if "/grams3-" in p][-1])
        blocks = [bytes(r.block) for r in left.where("kind = 'tokens'").collect()]
        (word,), n = kneser_ney._grams(blocks)
        assert word.tolist() == [kneser_ney._hash48(b"x")] and n.tolist() == [1]  # after two starts, twice
        assert model["tokens"] == 14 and model["vocabulary"] == 10

    def test_tables(self, spark):
        """Counts of any size, beyond a byte and beyond 32 bits, and keys that are not there."""
        rng = np.random.default_rng(7)
        keys = np.unique(rng.integers(0, 2**64, 20_000, dtype=np.uint64))
        values = [rng.choice([0, 1, 254, 255, 256, 2**33], len(keys)) for _ in range(2)]
        uri = hash_arrays.make_folder(work_dir(spark, "t"))
        kneser_ney._save_table(uri, "x", keys[::2], [v[::2] for v in values])
        there = np.arange(len(keys)) % 2 == 0
        for got, want in zip(kneser_ney._find_in(uri, "x", keys, 2), values, strict=True):
            assert (got == np.where(there, want, 0)).all()
        kneser_ney._save_table(uri, "none", keys[:0], [keys[:0].astype(np.int64)])
        assert not kneser_ney._find_in(uri, "none", keys, 1)[0].any()


class TestQuality:
    def test_statistics(self, docs, rows):
        m = quality.measure(docs, keep=["doc_id"])
        got = plain(m.select("row.doc_id", "out.n_words", "out.word_chars", "out.n_symbols", "out.n_dup_lines",
                             "out.n_repeat_words", quality.base_failed(F.col("out"))))
        assert got == by_id([(d, *brute.quality(t)) for d, t in rows])

    def test_labels(self, spark):
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
        labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
        m = quality.measure(docs, keep=["doc_id"])
        kept = quality.judge(m, quality.fit_votes(m)).select("row.doc_id", "kept").join(labels, "doc_id")
        r = {(x.quality, x.kept): x["count"] for x in kept.groupBy("quality", "kept").count().collect()}
        right = r.get((1, True), 0) + r.get((0, False), 0)
        assert right / sum(r.values()) > 0.9
        assert r.get((1, True), 0) / (r.get((1, True), 0) + r.get((1, False), 0)) > 0.95

    def test_fit_finds_planted_accuracies(self):
        rng = np.random.default_rng(1)
        good = rng.random(20_000) < 0.7
        accuracy = np.array([0.9, 0.8, 0.7, 0.95])
        right = rng.random((20_000, 4)) < accuracy
        votes = np.where(right == good[:, None], 1, -1) * (rng.random((20_000, 4)) < 0.8)
        patterns, counts = np.unique(votes, axis=0, return_counts=True)
        model = quality.fit(patterns, counts.astype(float), trust=0.01)
        assert abs(model.prior - 0.7) < 0.05 and np.abs(model.accuracy - accuracy).max() < 0.06

    def test_empty(self, empty):
        m = quality.measure(empty)
        assert quality.judge(m, quality.fit_votes(m)).count() == 0


class TestLanguage:
    def test_held_out_accuracy(self, spark):
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
        held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
        found = language.identify(docs.where(held), language.train(docs.where(~held)), keep=["lang"])
        r = found.agg(F.avg((F.col("row.lang") == F.col("out.lang_pred")).cast("double")), F.min("out.score"), F.max("out.score")).first()
        assert r[0] > 0.95 and 0 <= r[1] <= r[2] <= 1

    def test_code_lengths(self):
        """Table look-ups equal the definition, byte by byte."""
        rng = np.random.default_rng(4)
        train = {name: bytes(rng.choice(list(b"abcd "), 300, p=p)) for name, p in
                 (("x", [.5, .2, .1, .1, .1]), ("y", [.1, .1, .2, .3, .3]))}
        grams = [(int.from_bytes(t[i:i + 4]), k) for k, t in enumerate(train.values()) for i in range(len(t) - 3)]
        trees = []
        for code in range(2):
            own = Counter(g for g, c in grams if c == code)
            trees.append(language.Tree.fit(np.array(list(own)), np.array(list(own.values()))))
        counts = [defaultdict(Counter) for _ in range(2)]
        for g, code in grams:
            own = g.to_bytes(4)
            for k in range(4):
                counts[code][own[3 - k:3]][own[3]] += 1

        def bits(text, code):
            total = 0.0
            for i, byte in enumerate(text):
                for k in range(min(3, i), -1, -1):
                    seen = counts[code].get(text[i - k:i])
                    if not seen:
                        continue
                    n, d = sum(seen.values()), len(seen)
                    if byte in seen:
                        total -= math.log2(seen[byte] / (n + d))
                        break
                    total -= math.log2(d / (n + d))
                else:
                    total += 8
            return total

        texts = [b"abcd abca", b"zzz", b"a", b"", bytes(rng.choice(list(b"abcdz "), 200))]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        got = language.score(trees, np.frombuffer(b"".join(texts), np.uint8), offsets)
        for i, t in enumerate(texts):
            assert got[i] == pytest.approx([bits(t, 0), bits(t, 1)], abs=1e-3)

    def test_many_dense_languages(self, spark):
        """Thirty scripts: the model is files, what is sent to tasks are names; each knows its own."""
        rng = random.Random(8)
        rows = []
        for k in range(30):
            letters = [chr(0x4E00 + 700 * k + i) for i in range(700)]
            rows += [(1000 * k + i, f"l{k:02}", "".join(rng.choices(letters, k=300))) for i in range(60)]
        docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(8)
        model = language.train(docs.where("doc_id % 4 > 0"))
        assert len(pickle.dumps(model)) < 2000 and len(model.languages) == 30
        found = language.identify(docs.where("doc_id % 4 = 0"), model, keep=["lang"])
        assert found.where("row.lang <> out.lang_pred").count() == 0

    def test_sample_is_of_least_hashes(self, spark):
        docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 > 0, "a").otherwise("b").alias("lang"), F.lit("t").alias("text"))
        docs = docs.unionAll(docs.where("doc_id < 50"))  # repeated rows
        got = language._sample(docs, "lang", "text", "doc_id", 40, keep_key=True).collect()
        for lang in "ab":
            keys = sorted(r.key for r in docs.where(F.col("lang") == lang).select(F.xxhash64(F.col("doc_id").cast("string")).alias("key")).collect())
            assert sorted(r.key for r in got if r.lang == lang) == keys[:40]

    def test_undetermined(self, spark, docs, empty):
        assert language.train(empty) is None
        trees = language.train(docs)
        und = {r.text for r in language.identify(docs, trees, keep=["text"]).where("out.lang_pred = 'und' and out.score = 0")
               .select("row.text").collect()}
        assert {None, "", " ", "\n\n"} <= und and "a" not in und
        assert language.identify(docs, None).where("out.lang_pred <> 'und'").count() == 0
        assert language.identify(empty, trees).count() == 0


class TestSimHash:
    def test_groups(self, docs, rows):
        assert plain(simhash.near_duplicates(docs)) == by_id(brute.simhash_groups(rows))

    def test_links_of_close_fingerprints(self, spark):
        rng = np.random.default_rng(7)
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        near = [b ^ np.uint64(1 << int(x)) ^ np.uint64(1 << int(y)) for b in base for x, y in rng.integers(0, 64, (20, 2))]
        prints = sorted({int(x) for x in [*base, *near]})
        signed = [x - (1 << 64) if x >= 1 << 63 else x for x in prints]
        frame = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
        got = {tuple(sorted((r.a, r.b))) for r in simhash.links(frame, tile=16).collect()}
        close = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]

        def classes(pairs, n):
            p = list(range(n))
            def root(i):
                while p[i] != i:
                    i = p[i]
                return i
            for a, b in pairs:
                p[root(a)] = root(b)
            return Counter(frozenset(x for x in range(n) if root(x) == r) for r in {root(i) for i in range(n)})

        at = {s: i for i, s in enumerate(signed)}
        assert classes([(at[a], at[b]) for a, b in got], len(prints)) == classes(close, len(prints))

    def test_empty(self, empty):
        assert simhash.near_duplicates(empty).count() == 0

    def test_components(self, spark):
        rng = np.random.default_rng(8)
        chain = [(i, i + 1) for i in range(100)]
        pairs = chain + [(200, 300), (300, 250), (7, 7)] + [tuple(map(int, x)) for x in rng.integers(1000, 1400, (300, 2))]
        got = {r.a: r.b for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        parent = {x: x for p in pairs for x in p}
        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i
        for a, b in pairs:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        assert got == {x: root(x) for x in parent if root(x) != x}
        assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


class TestSharding:
    def test_against_plain(self, docs, rows):
        got = sharding.assign_shards(docs, 40).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is not None:
                assert (r.shard, r.grown_shard) == (brute.jump(r.doc_id, 40), brute.jump(r.doc_id, 41))
            assert r.grown_shard in (r.shard, 40)
        text = {(d, brute.crc(t or ""), len((t or "").encode()) + 16) for d, t in rows}
        assert {(r.doc_id, r.text_crc32, r.size) for r in got} == text
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())

    @pytest.mark.parametrize("shards", [1, 2, 7, 1000])
    def test_jump(self, spark, shards):
        keys = [0, 1, -1, 2**63 - 1, -(2**63), 123456789, 42]
        got = spark.createDataFrame([(k,) for k in keys], "k long").select(sharding.jump_shard(F.col("k"), shards)).collect()
        assert [r[0] for r in got] == [brute.jump(k, shards) for k in keys]

    def test_balance(self, spark):
        n = [r["count"] for r in spark.range(40_000).select(sharding.jump_shard(F.col("id"), 40).alias("s")).groupBy("s").count().collect()]
        assert len(n) == 40 and max(n) < 1.2 * 1000 and min(n) > 0.8 * 1000

    def test_empty(self, empty):
        assert sharding.assign_shards(empty).count() == 0


class TestDecontamination:
    def items(self, spark):
        given = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
        return given + [(900, None), (901, ""), (902, "One two THREE"), (903, "solo"), (904, "solo"), (905, "... !!"), (None, "nul item id")]

    def test_against_plain(self, spark, docs, rows):
        items = self.items(spark)
        extra = [(50_000 + i, f"begin words {t or ''} end words one, two; three SOLO") for i, (_, t) in enumerate(items)]
        extra.append((60_000, "nul item id " * 400 + (items[0][1] + " ") * 3))
        docs = docs.select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = plain(decontaminate.contamination(docs, bench, keep=["doc_id"]).select(
            "row.doc_id", "out.n_words", "out.n_hit", "out.n_items", "out.items_sha256"))
        every = [*rows, *extra]
        named = [("null" if i is None else i, t) for i, t in items]
        assert got == by_id([(d, *x) for (d, _), x in zip(every, brute.contamination([t for _, t in every], named))])

    def test_blocks(self, spark, docs):
        bench = spark.createDataFrame(self.items(spark), "item_id long, text string")
        blocks = decontaminate.compile_benchmark(bench, 10, "item_id", "text", block_words=100)
        assert len(blocks.numbers) > 5
        texts = pa.array([r.text for r in docs.select("text").collect()] + [i[1] for i in self.items(spark)])
        whole = decontaminate.compile_benchmark(bench, 10, "item_id", "text")
        a = decontaminate.find_hits(texts, blocks.blocks())
        b = decontaminate.find_hits(texts, whole.blocks())
        assert (a[1] == b[1]).all() and a[2] == b[2] and a[1].sum() > 0

    def test_empty(self, spark, docs, empty):
        none = spark.createDataFrame([], "item_id long, text string")
        assert decontaminate.contamination(docs, none).where("out.contaminated").count() == 0
        assert decontaminate.contamination(empty, none).count() == 0


class TestSuffixArrays:
    @pytest.mark.parametrize("group", [suffix_arrays.GROUP, 3])
    def test_against_plain(self, spark, docs, rows, group):
        rng = np.random.default_rng(11)
        passage = [f"p{i}" for i in range(70)]
        noise = lambda n: [f"n{x}" for x in rng.integers(0, 10**9, n)]
        extra = []
        for i in range(60):  # one passage cut, shifted and changed in many surroundings, down to 49 words
            a = int(rng.integers(0, 15))
            cut = passage[a:a + int(rng.integers(49, 62))]
            if i % 4 == 0:
                cut[int(rng.integers(len(cut)))] = "changed"
            extra.append((70_000 + i, " ".join(noise(int(rng.integers(0, 60))) + cut + noise(int(rng.integers(0, 60))))))
        extra.append((71_000, " ".join(["same"] * 400)))
        extra.append((71_001, " ".join(["x"] + ["same"] * 120 + ["y"])))
        extra.append((71_002, " ".join(["alone"] * 200)))
        frame = docs.select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
        assert plain(suffix_arrays.passages(frame, group=group)) == by_id(brute.passages([*rows, *extra]))

    @pytest.mark.parametrize("group", [suffix_arrays.GROUP, 3])
    def test_far_apart_repeats_are_two_stretches(self, spark, group):
        rows = []
        for k in range(20):  # a document with one passage twice, unique words between, and another that shares half of it
            passage = [f"d{k}p{i}" for i in range(120)]
            between = [f"d{k}n{i}" for i in range(500)]
            rows.append((2 * k, " ".join(passage + between + passage)))
            rows.append((2 * k + 1, " ".join([f"d{k}x"] * 5 + passage[30:90] + [f"d{k}y"] * 5)))
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert plain(suffix_arrays.passages(frame, group=group)) == by_id(brute.passages(rows))

    def test_empty(self, empty):
        assert suffix_arrays.passages(empty).count() == 0


class TestSecrets:
    def test_fixed_forms(self, docs, rows):
        found = secret_scan.scan(docs, {}, keep=["doc_id"])
        count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k))
        got = plain(found.select("row.doc_id", count(0), count(1), count(2), F.sha2(secret_scan.span_text(F.col("base")), 256)))
        assert got == by_id([(d, *brute.secrets_row(t)) for d, t in rows])

    def test_random_strings_are_found_and_words_are_not(self, spark):
        rng = np.random.default_rng(9)
        draw = lambda letters, n: "".join(rng.choice(list(letters), n))
        b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        made = [draw(b64, 40) for _ in range(400)]
        plain_words = ["-".join(rng.choice(["the", "Tion", "and", "of", "heat2"], 9)) for _ in range(400)]
        texts = [(f"see {a} and {b} here",) for a, b in zip(made, plain_words)]
        docs = spark.createDataFrame(texts, "text string")
        limits = secret_scan.thresholds(docs)
        spans = [(r.text, [(s.start, s.stop) for s in r.spans]) for r in secret_scan.scan(docs, limits).select("text", "spans").collect()]
        found = [t[a:b] for t, s in spans for a, b in s]
        assert len(set(found) & set(made)) > 300
        assert len(set(found) - set(made)) <= 0.1 * len(found)

    def test_redaction(self, spark, docs, empty):
        found = secret_scan.scan(docs, {("base62", 1): 0.5})
        for r in found.select("text", "spans", secret_scan.redact(F.col("text"), F.col("spans")).alias("clean")).collect():
            want, at = "", 0
            for a, _, b in r.spans:
                if a >= at:
                    want += r.text[at:a] + "[SECRET]"
                at = max(at, b)
            assert r.clean == want + r.text[at:]
        assert secret_scan.thresholds(empty) == {} and secret_scan.scan(empty, {}).count() == 0
