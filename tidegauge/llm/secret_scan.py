"""Secrets: fixed forms, and strings that pass a battery of randomness tests.

The fixed forms (assignments, access keys, long hexadecimal runs) are regular
expressions.  Other long runs of an encoding's characters are candidates.  For each
the encoding is inferred from its characters, and three tests ask whether its
symbols could be random draws of that alphabet: chi-squared uniformity, runs above
and below the middle, and serial correlation.  Their p-values are combined by Fisher's
rule.

Random strings have uniform p-values, ordinary ones crowd near zero.  Within each
encoding and band of lengths (short strings tell little) the upper half of the
p-values estimates how many are random, and the lowest threshold is taken at which
the others make up at most ``FALSE_DISCOVERIES`` of what is accepted.  Bands of fewer
than ``LEAST_CANDIDATES`` candidates are estimated together, an encoding's at a time;
where those are too few as well nothing is accepted.

Everything is DataFrame expressions.  The threshold table has one row per encoding
and band, counted by Spark over all documents.  A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in order, and their forms.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates: runs of characters of some encoding.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
# A run with characters of both 64-letter encodings is none of either: its parts are.
PARTS = (r"[A-Za-z0-9+/]{20,}={0,2}", r"[A-Za-z0-9_-]{20,}={0,2}")
LEAST_ASSIGNED = 6
FALSE_DISCOVERIES = 0.1
BINS = 20
#: Candidates that a threshold is estimated from, at least.
LEAST_CANDIDATES = 20
#: Code points of the blocks that a text is redacted by.
BLOCK = 4096
GROUP = 64
# Encodings from the narrowest alphabet to the widest: name, form, alphabet.
ENCODINGS = (
    ("digits", "[0-9]+", "0123456789"),
    ("hex", "[0-9a-f]+|[0-9A-F]+", "0123456789abcdef"),
    ("letters", "[a-z]+|[A-Z]+", "abcdefghijklmnopqrstuvwxyz"),
    ("base32", "[A-Z2-7]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "[0-9a-z]+|[0-9A-Z]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "[A-Za-z0-9]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "[A-Za-z0-9+/]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "[A-Za-z0-9_-]+=*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)

SPAN = "array<struct<start:bigint,rank:int,stop:bigint>>"


def _spans(text: Column, pattern: str, rank: int, values: Column | None = None, least: int = 0) -> Column:
    """Spans of all matches, from the lengths of the matches and of what lies between.

    Most texts have none, so the pattern is first only looked for.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    measured = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found,
                          lambda a, b: F.struct(F.length(a).cast("long").alias("gap"), F.length(b).cast("long").alias("own")))
    if values is not None:
        measured = F.zip_with(measured, values, lambda m, v: F.struct(
            m["gap"].alias("gap"), m["own"].alias("own"), F.length(v).alias("value")))
    else:
        measured = F.transform(measured, lambda m: F.struct(
            m["gap"].alias("gap"), m["own"].alias("own"), F.lit(least).alias("value")))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))

    def add(s: Column, m: Column) -> Column:
        start = s["at"] + m["gap"]
        stop = start + m["own"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(m["value"] >= least, F.concat(s["spans"], F.array(span)))
                        .otherwise(s["spans"]).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(measured, state, add, lambda s: s["spans"])).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the fixed forms, by start and kind."""
    assigned = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return F.array_sort(F.concat(
        _spans(text, ASSIGN, 0, assigned, LEAST_ASSIGNED), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by the rational approximation of Abramowitz and Stegun 26.2.17 (error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _tests(text: Column) -> Column:
    """Array of the candidates of a text: start, stop, encoding, band and p (of randomness).

    A run that mixes encodings gives its longest parts of one encoding, which may overlap.
    Runs without a letter or digit are left out.
    """
    # The matches themselves: cutting each out of the text would pass over the text once a match.
    def tokens(t: Column, pattern: str, at: Column) -> Column:
        return F.zip_with(_spans(t, pattern, 3), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda s, token: F.struct(
            (at + s["start"]).alias("start"), (at + s["stop"]).alias("stop"), token.alias("token")))

    mixed = lambda x: x["token"].rlike("[+/]") & x["token"].rlike("[_-]")
    whole = tokens(text, CANDIDATE, F.lit(0).cast("long"))
    found = F.when(F.exists(whole, mixed), F.flatten(F.transform(whole, lambda x: F.when(
        mixed(x), F.array_union(*[tokens(x["token"], p, x["start"]) for p in PARTS])).otherwise(F.array(x))))).otherwise(whole)

    def infer(x: Column) -> Column:
        token = x["token"]
        name, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
        for n, form, letters in reversed(ENCODINGS):
            fits = token.rlike(f"^(?:{form})$")
            name = F.when(fits, n).otherwise(name)
            upper = F.when(token.rlike("[A-Z]"), letters.upper()).otherwise(letters) if letters == letters.lower() else F.lit(letters)
            alphabet = F.when(fits, upper).otherwise(alphabet)
        body = F.regexp_replace(token, "=+$", "")
        return F.struct(x["start"].alias("start"), x["stop"].alias("stop"), name.alias("encoding"), alphabet.alias("alphabet"),
                        body.alias("body"), F.length(alphabet).cast("double").alias("k"), F.length(body).cast("double").alias("n"))

    def symbols(x: Column) -> Column:
        v = F.transform(F.split(x["body"], ""), lambda c: (F.instr(x["alphabet"], c) - 1).cast("double"))
        times = lambda c: (F.length(x["body"]) - F.length(F.replace(x["body"], c, F.lit("")))).cast("double")
        squares = F.aggregate(F.split(x["alphabet"], ""), F.lit(0.0), lambda a, c: a + times(c) * times(c))
        total = F.aggregate(v, F.lit(0.0), lambda a, y: a + y)
        return F.struct(*[x[f].alias(f) for f in ("start", "stop", "encoding", "k", "n")], v.alias("v"),
                        squares.alias("squares"), (total / x["n"]).alias("mean"))

    def sums(x: Column) -> Column:
        high = lambda y: y >= x["k"] / 2
        zero = F.lit(0.0)
        state = F.struct(F.lit(None).cast("double").alias("before"), zero.alias("runs"), zero.alias("high"),
                         zero.alias("square"), zero.alias("lag"))

        def add(s: Column, y: Column) -> Column:
            off = y - x["mean"]
            first = s["before"].isNull()
            return F.struct(
                y.alias("before"), (s["runs"] + F.when(first | (high(s["before"]) != high(y)), 1.0).otherwise(0.0)).alias("runs"),
                (s["high"] + F.when(high(y), 1.0).otherwise(0.0)).alias("high"), (s["square"] + off * off).alias("square"),
                (s["lag"] + F.when(first, 0.0).otherwise((s["before"] - x["mean"]) * off)).alias("lag"))

        return F.struct(*[x[f].alias(f) for f in ("start", "stop", "encoding", "k", "n", "squares")],
                        F.aggregate(x["v"], state, add).alias("s"))

    def combine(x: Column) -> Column:
        n, k, s = x["n"], x["k"], x["s"]
        df = k - 1
        chi = x["squares"] * k / n - n
        z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))  # Wilson and Hilferty
        product = 2 * s["high"] * (n - s["high"])
        spread = product * (product - n) / (n * n * (n - 1))
        # All symbols on one side, or all equal, are as far from random as a test can tell.
        z_runs = F.when(spread > 0, (s["runs"] - 1 - product / n) / F.sqrt(spread)).otherwise(9.0)
        z_lag = F.when(s["square"] > 0, (s["lag"] / s["square"] + 1 / n) * F.sqrt(n)).otherwise(9.0)
        log = lambda p: F.log(F.greatest(p, F.lit(1e-12)))
        half = -(log(_normal_tail(z_chi)) + log(2 * _normal_tail(F.abs(z_runs))) + log(2 * _normal_tail(F.abs(z_lag))))
        return F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["encoding"].alias("encoding"),
                        F.floor(2 * F.log2(n)).cast("int").alias("band"), F.greatest(half, F.lit(0.0)).alias("half"))

    def fisher(x: Column) -> Column:
        h = x["half"]
        return F.struct(*[x[f].alias(f) for f in ("start", "stop", "encoding", "band")],
                        (F.exp(-h) * (1 + h + h * h / 2)).alias("p"))

    kinds = lambda x: sum((x["token"].rlike(c).cast("int") for c in ("[0-9]", "[a-z]", "[A-Z]")), F.lit(0))
    out = F.filter(F.transform(F.filter(found, lambda x: kinds(x) >= 1), infer), lambda x: x["encoding"].isNotNull())
    for step in (symbols, sums, combine, fisher):
        out = F.transform(out, step)
    return out


def thresholds(docs: DataFrame, text: str = "text", rate: float = FALSE_DISCOVERIES) -> dict[tuple[str, int], float]:
    """Least accepted p by encoding and band, from all candidates of all documents.

    One row for each of few encodings and bands (the logarithm of a length) comes to the driver.
    """
    t = docs[text].cast("string")
    tested = docs.where(t.rlike(CANDIDATE)).select(F.explode(_tests(t)).alias("c")).select("c.*")
    level = F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int")
    table: dict[tuple[str, int], list[int]] = {}
    for r in tested.groupBy("encoding", "band", level.alias("level")).agg(F.count("*").alias("n")).collect():
        table.setdefault((r.encoding, r.band), [0] * BINS)[r.level] = r.n
    groups = {key: [key] for key, bins in table.items() if sum(bins) >= LEAST_CANDIDATES}
    for encoding in sorted({e for e, _ in table}):
        few = [key for key in sorted(table) if key[0] == encoding and key not in groups]
        if few:
            groups[encoding, None] = few
    out = {}
    for keys in groups.values():
        bins = [sum(c) for c in zip(*(table[key] for key in keys), strict=True)]
        if sum(bins) < LEAST_CANDIDATES:
            continue
        random = 2 * sum(bins[BINS // 2:])
        for j in range(1, BINS):
            accepted = sum(bins[j:])
            if accepted and 1 - min(1.0, random * (1 - j / BINS) / accepted) <= rate:
                out |= dict.fromkeys(keys, j / BINS)
                break
    return out


def scan(docs: DataFrame, limits: dict[tuple[str, int], float], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``row``, ``base`` and ``spans``: sorted (start, rank of the kind, stop).

    ``spans`` are those of the fixed forms and the accepted candidates that do not lie within one of them.
    """
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("row"),
                       t.alias("text"), base_spans(t).alias("base"))
    limit = F.create_map(*[F.lit(x) for (e, b), at in limits.items() for x in (f"{e}:{b}", at)]) if limits else None
    none = F.array().cast(SPAN)
    if limit is None:
        added = none
    else:
        clear = lambda x: ~F.exists(F.col("base"), lambda s: (s["start"] <= x["start"]) & (x["stop"] <= s["stop"]))
        least = lambda x: F.element_at(limit, F.concat_ws(":", x["encoding"], x["band"].cast("string")))
        accepted = F.filter(_tests(F.col("text")), lambda x: (x["p"] >= least(x)) & clear(x))
        added = F.when(F.col("text").rlike(CANDIDATE), F.transform(accepted, lambda x: F.struct(
            x["start"].alias("start"), F.lit(3).alias("rank"), x["stop"].alias("stop")))).otherwise(none)
    return rows.select("row", "text", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def _kept(spans: Column, end: Column) -> Column:
    """What lies before, between and behind spans sorted by start; those that overlap are one.

    An aggregate copies its state at each step, so steps go over ``GROUP`` spans at a time.
    """
    stops = F.transform(spans, lambda x: x["stop"])
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def step(s: Column, x: Column) -> Column:
        gap = F.struct(s["at"].alias("start"), x["start"].alias("stop"))
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"),
                        F.when(x["start"] >= s["at"], F.concat(s["gaps"], F.array(gap))).otherwise(s["gaps"]).alias("gaps"))

    def group(g: Column) -> Column:
        at = F.coalesce(F.array_max(F.slice(stops, F.lit(1), g * GROUP)), F.lit(0).cast("long"))
        return F.aggregate(F.slice(spans, g * GROUP + 1, F.lit(GROUP)), F.struct(at.alias("at"), none.alias("gaps")), step, lambda s: s["gaps"])

    last = F.array_max(stops)
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / GROUP).cast("int")), group)
    return F.concat(F.flatten(groups), F.array(F.struct(last.alias("start"), F.greatest(end, last).alias("stop"))))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span replaced; overlapping spans are replaced as one.

    The text is cut into blocks of ``BLOCK`` code points in one pass, and what lies between
    two spans is put together from those: a span costs a block, not the text.
    """
    def between(blocks: Column, x: Column) -> Column:
        first, last = (F.floor(x[c] / BLOCK).cast("int") for c in ("start", "stop"))
        skip, rest = ((x[c] % BLOCK).cast("int") for c in ("start", "stop"))
        block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
        whole = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.when(first == last, F.substring(block(first), skip + 1, rest - skip)).otherwise(
            F.concat(F.substring(block(first), skip + 1, F.lit(BLOCK)), whole, F.substring(block(last), F.lit(1), rest)))

    # A list of one: its element is made once, where a name for it is not to be had otherwise.
    blocks = F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    kept = F.transform(blocks, lambda own: F.array_join(
        F.transform(_kept(spans, F.length(text).cast("long")), lambda x: between(own, x)), mark))
    return F.when(F.size(spans) == 0, text).otherwise(kept[0])


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
