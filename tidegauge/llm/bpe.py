"""Byte-level BPE encoding and decoding with recursive DuckDB queries per partition.

Each distinct pre-token of a batch is a group of (word, position, id) rows.  A
recursive query joins neighbouring positions to the merge table and contracts each
word's leftmost pair of least rank, until no word has a pair left.  Its table is keyed
by word and position, so a round replaces the rows it changes and memory does not grow
with the number of rounds.  Decoding joins ids to the vocabulary and concatenates the
bytes in an ordered aggregate.

A text without spaces may be one long pre-token; what keeps its rounds few is this.  A
contraction that gives no pair of a lower rank leaves those further right that make the
same token next in turn, so all up to the first that does give one are contracted in the
same round; in a row of overlapping pairs that is every other.

Words of up to ``SHORT`` bytes, nearly all there are, go by a recursion that copies the rows
of a word from round to round and contracts one pair of it a round: it takes a third of
the time of the keyed one, and so few rounds that its rows are bounded as well.  Both are
the same rule.

A query takes words of ``QUERY_BYTES``, which bounds its memory; one longer word is a
query of its own.  Every partition
is encoded on its own, without a shuffle, so a lost executor costs the repetition of its
tasks and nothing else.

Null and empty texts have no ids; an unknown id in decoding raises.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidegauge.llm.batches import annotate, gather
from tidegauge.llm.segments import SegmentCache, segment

#: Bytes of the words in one query.
QUERY_BYTES = 256 << 10
#: Bytes of the longest words that are contracted a pair a round.
SHORT = 48

# A row is a token: its position, the position after it, its id and the id that follows.
ENCODE_SHORT = """
with recursive t(w, pos, after, id, following, step) as (
  select w, pos, pos + 1, id, lead(id) over (partition by w order by pos), 0 from start
  union all
  select t.w, t.pos,
         case when t.pos = b.chosen then gone.after else t.after end,
         case when t.pos = b.chosen then b.new_id else t.id end,
         case when t.pos = b.chosen then gone.following when t.after = b.chosen then b.new_id else t.following end,
         t.step + 1
  from t
  join (select w, ((best >> 16) & 65535)::int as chosen, (best & 65535)::int as removed, (best >> 32)::int as new_id
        from (select t.w, min((m.new_id::bigint << 32) + (t.pos << 16) + t.after) as best
              from t join merges m on m.first_id = t.id and m.second_id = t.following group by t.w)) b using (w)
  left join t gone on gone.w = t.w and gone.pos = b.removed and t.pos = b.chosen
  where t.pos <> b.removed)
select w, list(id order by pos) as ids
from t join (select w, max(step) as step from t group by w) using (w, step)
group by w order by w
"""

# A row is a token: its position, the position after it, its id (-1: contracted away) and
# the id that follows (-1: none).  ``t`` has the rows changed last, ``recurring.t`` all.
ENCODE = """
with recursive t(w, pos, after, id, following) using key (w, pos) as (
  select w, pos, pos + 1, id, lead(id, 1, -1) over (partition by w order by pos) from start
  union
  (with pairs as (
     select r.w, r.pos, r.after, m.new_id, m.safe, min(m.new_id) over (partition by r.w) as best
     from recurring.t r join merges m on m.first_id = r.id and m.second_id = r.following
     where r.w in (select w from t)),
   least as (
     select w, pos, after, new_id, safe,
            case when lag(after) over (partition by w order by pos) = pos then 0 else 1 end as begins
     from pairs where new_id = best),
   runs as (select *, sum(begins) over (partition by w order by pos) as run from least),
   apart as (
     select w, pos, after, new_id, safe
     from (select *, row_number() over (partition by w, run order by pos) as k from runs) where k % 2 = 1),
   beside as (
     select a.w, a.pos, a.new_id, case when q.pos is null then l.id else a.new_id end as before, s.following as next
     from apart a join recurring.t s on s.w = a.w and s.pos = a.after
     left join recurring.t l on l.w = a.w and l.after = a.pos and l.id >= 0
     left join apart q on q.w = a.w and q.after = l.pos
     where not a.safe),
   stop as (
     select b.w, min(b.pos) as pos from beside b
     where exists (select 1 from merges m where m.first_id = b.before and m.second_id = b.new_id and m.new_id < b.new_id)
        or exists (select 1 from merges m where m.first_id = b.new_id and m.second_id = b.next and m.new_id < b.new_id)
     group by b.w),
   chosen as (
     select a.w, a.pos, a.after, a.new_id from apart a left join stop using (w) where stop.pos is null or a.pos <= stop.pos),
   first as (
     select r.w, r.pos, r.after as second, c.new_id from recurring.t r join chosen c on c.w = r.w and c.pos = r.pos)
   select x.w, x.pos, s.after, x.new_id, case when n.pos is null then s.following else x.new_id end
   from first x join recurring.t s on s.w = x.w and s.pos = x.second left join chosen n on n.w = x.w and n.pos = s.after
   union all
   select w, second, second, -1, -1 from first
   union all
   select r.w, r.pos, r.after, r.id, c.new_id
   from recurring.t r join chosen c on c.w = r.w and c.pos = r.after
   where r.id >= 0 and not exists (select 1 from chosen q where q.w = r.w and q.after = r.pos)))
select w, list(id order by pos) as ids from t where id >= 0 group by w order by w
"""

DECODE = """
select g, from_hex(string_agg(v.hex, '' order by pos)) as bytes
from ids join vocabulary v using (id) group by g order by g
"""


class Codec:
    """A vocabulary of ranks in DuckDB, with caches of encoded segments."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # White space as in the tokenizer's own regular expressions: U+001C to U+001F are none.
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.pattern = regex.compile(
            pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t))
                 if t[:i] in self.ranks and t[i:] in self.ranks]
        first, second, new = (np.array(x, np.int32) for x in zip(*pairs, strict=True))
        # Whether no token of a lower rank has the token made as a part.
        above = np.full(max(self.ranks.values()) + 1, np.iinfo(np.int32).max, np.int32)
        for part in (first, second):
            np.minimum.at(above, part, new)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self._load("merges", {"first_id": first, "second_id": second, "new_id": new, "safe": above[new] > new})
        self._load("vocabulary", {"id": np.fromiter(self.ranks.values(), np.int32), "hex": [t.hex() for t in self.ranks]})
        self.known = np.zeros(max(self.ranks.values()) + 1, bool)
        self.known[list(self.ranks.values())] = True
        self.segments = SegmentCache(self._segments, (np.uint32, np.uint8))

    def _load(self, name: str, columns: dict) -> None:
        self.db.register("loading", pa.table(columns))
        self.db.execute(f"create table {name} as select * from loading")
        self.db.unregister("loading")

    def _query(self, sql: str, name: str, columns: dict) -> pa.Table:
        self.db.register(name, pa.table(columns))
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, which is not split further."""
        out: list = [np.array([self.ranks[w]], np.int32) if w in self.ranks else None for w in words]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for sql, some in ((ENCODE_SHORT, [i for i in rest if len(words[i]) <= SHORT]), (ENCODE, [i for i in rest if len(words[i]) > SHORT])):
            for i, ids in zip(some, self._contract(sql, [words[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _contract(self, sql: str, words: list[bytes]) -> list[np.ndarray]:
        out: list = []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        at = 0
        while at < len(words):
            before = int(ends[at - 1]) if at else 0
            end = max(int(np.searchsorted(ends, before + QUERY_BYTES, "right")), at + 1)
            own = lengths[at:end]
            got = self._query(sql, "start", {
                "w": np.repeat(np.arange(end - at, dtype=np.int32), own),
                "pos": gather(np.zeros(end - at, np.int64), own).astype(np.int32),
                "id": self.byte_ids[np.frombuffer(b"".join(words[at:end]), np.uint8)]})["ids"].combine_chunks()
            values, cuts = got.values.to_numpy(), got.offsets.to_numpy()
            out += [values[cuts[k]:cuts[k + 1]] for k in range(end - at)]
            at = end
        return out

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """Bytes of groups of ids; ``cuts`` are the n+1 offsets of the groups."""
        if len(ids) and (ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        out = [b""] * (len(cuts) - 1)
        step = 50_000
        group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        at = 0
        while at < len(ids):  # whole groups, about ``step`` ids at a time
            last = max(int(np.searchsorted(cuts, at + step, "right")) - 1, int(group[at]) + 1)
            end = int(cuts[last])
            got = self._query(DECODE, "ids", {"g": group[at:end], "pos": np.arange(end - at), "id": ids[at:end].astype(np.int32)})
            for g, b in zip(got["g"].to_pylist(), got["bytes"].to_pylist(), strict=True):
                out[g] = b
            at = end
        return out

    def _segments(self, segments: list[bytes]) -> list[tuple]:
        words = [self.pattern.findall(s.decode()) for s in segments]
        number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        encoded = self.encode_words([w.encode() for w in number])
        ids = [np.concatenate([encoded[number[w]] for w in ws]) if len(ws) != 1 else encoded[number[ws[0]]] for ws in words]
        cuts = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        return [(i, np.frombuffer(b, np.uint8)) for i, b in zip(ids, self.decode(np.concatenate(ids), cuts), strict=True)]

    def batch(self, texts: pa.Array):
        """Ids and decoded bytes of whole texts, each with the n+1 offsets of the rows."""
        codes, distinct, rows = segment(texts)
        numbers = self.segments.find(distinct)[codes]
        return self.segments.join(0, numbers, rows) + self.segments.join(1, numbers, rows)


@lru_cache(maxsize=1)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec a worker process, kept between its tasks."""
    return Codec(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None,
           arrays: bool = True) -> DataFrame:
    """Columns ``row`` and ``out``: token ids, decoded bytes (with ``arrays``) and their digests.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers.
    """
    def make():
        c = codec(ranks_path, pattern)

        def work(texts: pa.Array) -> list:
            ids, id_cuts, data, cuts = c.batch(texts)
            view, plain = memoryview(ids.astype("<u4")).cast("B"), memoryview(data)
            n = len(texts)
            out = [np.diff(id_cuts),
                   pa.array([hashlib.sha256(view[4 * id_cuts[i]:4 * id_cuts[i + 1]]).hexdigest() for i in range(n)], pa.string()),
                   pa.array([hashlib.sha256(plain[cuts[i]:cuts[i + 1]]).hexdigest() for i in range(n)], pa.string())]
            if arrays:
                out += [pa.ListArray.from_arrays(pa.array(id_cuts.astype(np.int32)), pa.array(ids.astype(np.int32))),
                        pa.array([bytes(plain[cuts[i]:cuts[i + 1]]) for i in range(n)], pa.binary())]
            return out
        return work

    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * arrays
    return annotate(docs, text, make, fields, keep)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The rows with the bytes of their ids: columns ``row`` and ``decoded``; null ids give null."""
    from pyspark.sql import functions as F

    row_type = tokens.select(F.struct("*").alias("row")).schema["row"].dataType.simpleString()

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            lists = b.column("ids")
            values = [np.array(x or [], np.int64) for x in lists.to_pylist()]
            cuts = np.concatenate(([0], np.cumsum([len(v) for v in values])))
            data = c.decode(np.concatenate([*values, np.zeros(0, np.int64)]), cuts)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array([d if v else None for d, v in zip(data, lists.is_valid().to_pylist(), strict=True)], pa.binary())],
                ["row", "decoded"])

    return tokens.select(tokens[ids].alias("ids"), F.struct("*").alias("row")).mapInArrow(run, f"row {row_type}, decoded binary")
