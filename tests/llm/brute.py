"""Plain versions of the operators, straight from their definitions, for small inputs."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPACED.findall(text or "")


def crc(data):
    return zlib.crc32(data.encode() if isinstance(data, str) else data)


def held_out(doc_id, folds):
    return doc_id is not None and crc(str(doc_id)) % folds == 0


def token_rows(rows):
    """op1 by the library, text by text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), crc(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def bpe_rows(rows):
    """op5 by the library."""
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for doc_id, text in rows:
        ids = enc.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(),
                    hashlib.sha256((text or "").encode()).hexdigest()))
    return out


def kneser_ney(train, texts, order=3):
    """op2: (n_tokens, n_known, N, base, score) of each text, with dictionaries."""
    tokens = lambda t: [*words((t or "").translate(LOWER)), None]
    seqs = [tokens(t) for t in train]
    count = Counter(w for s in seqs for w in s)
    total, vocabulary = sum(count.values()), len(count)

    def padded(s, k):
        s = ["<s>"] * (k - 1) + [("w", w) for w in s]
        return [tuple(s[i:i + k]) for i in range(len(s) - k + 1)]

    def discounts(values):
        n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
        out = [0.0]
        for k in (1, 2, 3):
            a, b = n[k - 1], n[k]
            out.append(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) if a and b else min(y, float(k)))
        return out

    grams = {order: Counter(g for s in seqs for g in padded(s, order))}
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    d = {k: discounts(g.values()) for k, g in grams.items()}
    sums, types = {k: Counter() for k in grams}, {k: {} for k in grams}
    for k, g in grams.items():
        for x, n in g.items():
            sums[k][x[:-1]] += n
            types[k].setdefault(x[:-1], []).append(n)
    left = sum(d[1][min(n, 3)] for n in grams[1].values())
    backs = {}

    def probability(gram):
        k = len(gram)
        if k == 1:
            if not grams[1]:
                return 1.0
            n, whole = grams[1].get(gram, 0), sum(sums[1].values())
            return max(n - d[1][min(n, 3)], 0) / whole + left / whole / (vocabulary + 1)
        lower, context = probability(gram[1:]), gram[:-1]
        if context not in sums[k]:
            return lower
        n = grams[k].get(gram, 0)
        if (k, context) not in backs:
            backs[k, context] = sum(d[k][min(x, 3)] for x in types[k][context]) / sums[k][context]
        return max(n - d[k][min(n, 3)], 0) / sums[k][context] + backs[k, context] * lower

    out = []
    for text in texts:
        s = tokens(text)
        base = sum(math.log10((count.get(w, 0) + 0.1) / (total + 0.1 * (vocabulary + 1))) for w in s)
        score = sum(math.log10(probability(g)) for g in padded(s, order))
        out.append((len(s), sum(count.get(w, 0) > 0 for w in s), total, base, score))
    return out, (count, probability)


def quality(text):
    """op3: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated),
            len(w) < 50 or 100 * len(repeated) > 50 * len(w))


def fingerprint(text, size=3):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def simhash_groups(rows, radius=2):
    """op6: fingerprint and the least id reachable."""
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [(d, f"{p:016x}", least.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))]


def jump(key, shards):
    key %= 1 << 64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


CONTENT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(texts, items, window=10):
    """op8: n_words, n_hit, n_items, items_sha256."""
    split = lambda t: CONTENT.findall((t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = split(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for text in texts:
        w = split(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i:i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[x]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def base_secrets(text):
    """op10: sorted (start, kind number, end) of the fixed forms."""
    text, out = text or "", []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def secrets_row(text):
    spans = base_secrets(text)
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
    return (*(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest())


def passages(rows, size=50):
    """op9: per (id, text) the maximal stretches of windows of words that stand in another document."""
    docs = {(d, t): words(t) for d, t in rows if t is not None}
    where = {}
    for key, w in docs.items():
        for i in range(len(w) - size + 1):
            where.setdefault(tuple(w[i:i + size]), set()).add(key)
    out = []
    for key, w in docs.items():
        spans = []
        for i in range(len(w) - size + 1):
            if len(where[tuple(w[i:i + size])]) > 1:
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + size
                else:
                    spans.append([i, i + size])
        if spans:
            out.append((key[0], len(w), sum(b - a for a, b in spans), ",".join(f"{a}:{b}" for a, b in spans)))
    return out
