"""Byte-level BPE encoding and decoding by recursive DuckDB queries.

Each Python worker holds one in-memory DuckDB database with the merge table: (left, right, merged) for every vocabulary
entry and every cut of it into two entries. A batch's new pretokens become token-position rows. A recursive query joins
neighbouring rows with the merge table and contracts in every word, again and again, the leftmost pair of minimum rank,
until no pair of any word merges. Ordered aggregation turns the rows into ids and bytes again. Results for pretokens are
kept in a bounded cache, so later batches query new pretokens only.

A pretoken of more than SHORT bytes is cut into parts that the same query contracts as words of their own, all in one run.
Contraction of a whole never crosses the bounds between tokens t1 t2 ... if contraction of each neighbouring two, alone,
leaves just those two: the contractions inside both happen in the same order in the pair as in the whole, so a pair across
the bound would come first in the pair as well. So parts are joined two by two: where the tokens at a bound are not such a
pair, some tokens on either side of it are contracted afresh, more of them until the bounds on both sides hold. Steps and
rows are linear in the pretoken, apart from periodic ones whose tokens fall differently in every part (parts begin at a
fixed phase of runs with a period up to 16 bytes, so theirs agree).

Defined results: a null text counts as empty (no tokens, empty bytes); white space, repeated rows and texts of any
length, unbroken ones included, are ordinary input; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, documents, pieces, release

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pretokens remembered by a worker: so many, and those of a generation before.
CACHE = 130_000
#: Texts of more characters are cut into pretokens a piece at a time.
LONG = 1 << 20
#: Pretokens of more bytes are cut into parts of at most so many.
SHORT = 64
#: Bytes beside a bound that are contracted whole to make it hold, at most; beyond, see MergeTable._append.
WHOLE = 512
#: Rows that one recursive query may make, over all its steps: some 40 MB.
ROWS = 600_000

#: One row a token: its place and id, the place and id of the next one, and a key that orders pairs by rank, then place.
LEFTMOST = """
WITH RECURSIVE s(step, w, pos, id, npos, nid, k) AS (
  SELECT 0, s.w, s.pos, s.id, s.npos, s.nid, (m.merged::BIGINT << 46) + (s.pos::BIGINT << 23) + s.npos
  FROM seed s LEFT JOIN merges m ON m.l = s.id AND m.r = s.nid
  UNION ALL
  (WITH least AS (SELECT w, min(k) AS best FROM s GROUP BY w HAVING min(k) IS NOT NULL),
   t AS NOT MATERIALIZED (
     SELECT s.*, (best >> 46)::INT AS merged, ((best >> 23) & 8388607)::INT AS p, (best & 8388607)::INT AS q FROM s JOIN least USING (w)),
   touched AS (
     SELECT a.step, a.w, a.pos, a.merged AS id, z.npos, z.nid
     FROM t a JOIN (SELECT w, npos, nid FROM t WHERE pos = q) z USING (w) WHERE a.pos = a.p
     UNION ALL SELECT step, w, pos, id, npos, merged FROM t WHERE npos = p)
   SELECT step + 1, w, pos, id, npos, nid, k FROM t WHERE pos <> p AND pos <> q AND npos <> p
   UNION ALL
   SELECT c.step + 1, c.w, c.pos, c.id, c.npos, c.nid, (m.merged::BIGINT << 46) + (c.pos::BIGINT << 23) + c.npos
   FROM touched c LEFT JOIN merges m ON m.l = c.id AND m.r = c.nid))
"""

#: The rows of each word's last step, aggregated in order: the database runs one thread, so string_agg meets the sorted rows one after another.
ENDED = """
SELECT w, string_agg(id::VARCHAR, ' ') AS ids, count(*) AS n, unhex(string_agg(hex, '')) AS bytes
FROM (SELECT w, pos, id, hex FROM steps JOIN (SELECT w, max(step) AS step FROM steps GROUP BY w) USING (w, step)
      JOIN vocabulary USING (id) ORDER BY w, pos)
GROUP BY w
"""

DECODED = "SELECT w, unhex(string_agg(hex, '' ORDER BY pos)) FROM given JOIN vocabulary USING (id) GROUP BY w"
NO_IDS = np.zeros(0, dtype=np.int32)
#: Ids that one query decodes.
DECODE = 100_000


def starts(data: bytes, most: int = SHORT) -> list[int]:
    """Where to cut: parts of at most `most` bytes, which in a run of period p (up to 16) begin at one phase, a power of two periods apart."""
    b = np.frombuffer(data, dtype=np.uint8)
    n = len(b)
    able = np.ones(n, dtype=bool)  # may a part begin here?
    taken = np.zeros(n, dtype=bool)
    for p in range(1, 17):
        same = np.concatenate([np.zeros(min(p, n), dtype=bool), b[p:] == b[:-p]])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))).reshape(-1, 2)
        step = p << ((most // 2 // p).bit_length() - 1)
        for x, y in edge[edge[:, 1] - edge[:, 0] >= 2 * step].tolist():
            x = max(x - p, 0)
            free = ~taken[x:y]
            able[x:y] &= ~free | (np.arange(y - x) % step == 0)
            taken[x:y] = True
    last = np.maximum.accumulate(np.where(able, np.arange(n), -1)).tolist()  # the last place up to here where a part may begin
    out = [0]
    while out[-1] + most < n:
        cut = last[out[-1] + most]
        out.append(cut if cut > out[-1] else out[-1] + most)
    return out


class MergeTable:
    """A vocabulary of ranks in DuckDB, with a cache from pretoken to ids, and the decoded bytes of those that decode to others."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        rows = [
            (ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        ]
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        l, r, m = (np.array(x, dtype=np.int32) for x in zip(*rows, strict=True))
        self.tables = {"vocabulary": pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]}), "merges": pa.table({"l": l, "r": r, "merged": m})}
        self.connection: duckdb.DuckDBPyConnection | None = None
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.other: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    @property
    def db(self) -> duckdb.DuckDBPyConnection:
        """The database, opened where it isn't."""
        if self.connection is None:
            # Queries are sized to stay far below the limit, so nothing is ever spilled to a local folder.
            self.connection = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
            for name, rows in self.tables.items():
                self.connection.register("_rows", rows)
                self.connection.execute(f"CREATE TABLE {name} AS SELECT * FROM _rows")
                self.connection.unregister("_rows")
        return self.connection

    def close(self) -> None:
        """Gives the database's memory back; what is known stays."""
        if self.connection is not None:
            self.connection.close()
            self.connection = None
        release()

    def contract(self, words: list[bytes]) -> Iterator[tuple[int, str, int, bytes]]:
        """(number of the word, ids, number of ids, decoded bytes), as many words to a query as ROWS allows."""
        cost = np.cumsum([len(x) * (len(x) + 1) // 2 for x in words])
        begin = 0
        while begin < len(words):
            end = max(begin + 1, int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + ROWS, side="right")))
            raw = words[begin:end]
            n = np.array([len(x) for x in raw])
            first = np.cumsum(n) - n
            ids = self.byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            pos = (np.arange(len(ids)) - np.repeat(first, n)).astype(np.int32)
            after = np.append(ids[1:], np.int32(-1))
            after[np.cumsum(n) - 1] = -1
            w = np.repeat(np.arange(begin, end, dtype=np.int32), n)
            self.db.register("seed", pa.table({"w": w, "pos": pos, "id": ids, "npos": pos + np.int32(1), "nid": after}))
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE steps AS {LEFTMOST} SELECT step, w, pos, id FROM s")
            yield from self.db.execute(ENDED).fetchall()
            self.db.execute("DROP TABLE steps")
            self.db.unregister("seed")
            begin = end

    def ids_of(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids by word, each contracted whole."""
        different = list(dict.fromkeys(words))
        return {different[i]: [int(x) for x in said.split()] for i, said, _, _ in self.contract(different)}

    def _in_parts(self, word: bytes) -> list[int]:
        cut = starts(word)
        parts = [word[a:b] for a, b in zip(cut, [*cut[1:], len(word)], strict=True)]
        said = self.ids_of(parts)
        rows = [said[x] for x in parts]
        while len(rows) > 1:
            rows = self._join(rows[0::2], rows[1::2]) + rows[len(rows) // 2 * 2 :]
        return rows[0]

    def _join(self, left: list[list[int]], right: list[list[int]]) -> list[list[int]]:
        """Ids of left[i] and right[i] together. A left one may be over: it has none to join."""
        out: list = [None] * len(right)
        width = dict.fromkeys(range(len(right)), 0)
        while width:
            text = lambda ids: b"".join([self.bytes_of[x] for x in ids])
            todo = list(width)
            given = {i: text(left[i][-width[i] :] + right[i][: width[i]]) for i in todo if width[i]}
            for i in [i for i, x in given.items() if len(x) > WHOLE]:
                del width[i], given[i]
                todo.remove(i)
                out[i] = self._append(list(left[i]), text(right[i]))
            said = self.ids_of(list(given.values()))
            middles = {i: said[given[i]] if i in given else [] for i in todo}
            bounds = {}
            for i in todo:
                k, m = width[i], middles[i]
                a, b = left[i][: max(0, len(left[i]) - k)], right[i][k:]
                bounds[i] = [(x[-1], y[0]) for x, y in ((a, m), (m, b)) if x and y] if m else [(a[-1], b[0])]
            self._learn_pairs({p for x in bounds.values() for p in x})
            for i in todo:
                if all(self.pairs[p] for p in bounds[i]):
                    k = width.pop(i)
                    out[i] = left[i][: max(0, len(left[i]) - k)] + middles[i] + right[i][k:]
                else:
                    width[i] = max(1, 2 * width[i])
            if len(self.pairs) > CACHE:
                self.pairs.clear()
        return out

    def _learn_pairs(self, pairs: set[tuple[int, int]]) -> None:
        """Which two tokens, next to each other, contract to just those two."""
        new = sorted(pairs - self.pairs.keys())
        text = {(a, b): self.bytes_of[a] + self.bytes_of[b] for a, b in new}
        said = self.ids_of(list(text.values()))
        self.pairs.update((p, said[x] == list(p)) for p, x in text.items())

    def _append(self, ids: list[int], data: bytes) -> list[int]:
        """Ids of a word that begins with `ids` and goes on with `data`, a part at a time from left to right; for parts whose tokens don't fall into step."""
        said: dict[bytes, list[int]] = {}
        for a in range(0, len(data), SHORT):
            part, k = data[a : a + SHORT], 0
            while True:
                window = b"".join([self.bytes_of[x] for x in ids[len(ids) - k :]]) + part
                if window not in said:
                    said = {} if len(said) > 10_000 else said
                    said |= self.ids_of([window])
                fresh = said[window]
                if k < len(ids):
                    self._learn_pairs({(ids[-k - 1], fresh[0])})
                if k >= len(ids) or self.pairs[(ids[-k - 1], fresh[0])]:
                    break
                k = min(len(ids), max(1, 2 * k))
            ids[len(ids) - k :] = fresh
        return ids

    def learn(self, words: set[str]) -> None:
        """Encodes the words that the cache lacks. A full cache becomes the older one, from which words in use come back."""
        missing = words - self.known.keys()
        if len(self.known) + len(missing) > CACHE:
            self.older, self.known = self.known | {w: self.older[w] for w in missing if w in self.older}, {}
            missing = words
        self.known.update((w, self.older[w]) for w in missing if w in self.older)
        new = list(missing - self.known.keys())
        raw = [w.encode() for w in new]
        short = [i for i, x in enumerate(raw) if len(x) <= SHORT]
        words = [raw[i] for i in short]
        for i, said, _, data in self.contract(words):
            self._keep(new[short[i]], said, words[i], data)
        for w, x in zip(new, raw, strict=True):
            if len(x) > SHORT:
                ids = self._in_parts(x)
                self._keep(w, " ".join(map(str, ids)), x, self.decoded(pa.array([ids], pa.list_(pa.int32())))[0])

    def _keep(self, word: str, said: str, raw: bytes, data: bytes) -> None:
        self.known[word] = said
        if data != raw:
            self.other[word] = data

    def bytes_for(self, words: list[str]) -> bytes:
        """The bytes that the words' ids stand for, as decoded when they were learned."""
        if self.other:
            return b"".join([self.other[w] if w in self.other else w.encode() for w in words])
        return "".join(words).encode()

    def decoded(self, ids: pa.ListArray) -> list[bytes | None]:
        """The bytes that each list of ids stands for, by ordered aggregation; a null list's are null."""
        size = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        owner, flat = np.repeat(np.arange(len(ids)), size), ids.flatten()
        parts: list[list[bytes]] = [[] for _ in size]
        for a in range(0, len(flat), DECODE):
            here = flat.slice(a, DECODE)
            self.db.register("given", pa.table({"w": owner[a : a + DECODE], "pos": np.arange(len(here)), "id": here}))
            for w, data in self.db.execute(DECODED).fetchall():
                parts[w].append(data)
            self.db.unregister("given")
        return [b"".join(x) if ok else None for x, ok in zip(parts, ids.is_valid().to_pylist(), strict=True)]


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: The same cuts as public_tokenizers.PATTERN by the standard library's faster engine, for texts without a character of ELSEWHERE.
LATIN = re.compile(rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
ELSEWHERE = re.compile("[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")


class Splitter:
    def __init__(self, pattern: str, usual: str):
        self.exact, self.latin = regex.compile(pattern), pattern == usual

    def of(self, text: str) -> re.Pattern | regex.Pattern:
        return LATIN if self.latin and not ELSEWHERE.search(text) else self.exact


def _cut(find: re.Pattern | regex.Pattern, text: str) -> Iterator[list[str]]:
    if len(text) <= LONG:
        yield find.findall(text)
    else:
        it = (m.group() for m in find.finditer(text))
        while part := list(islice(it, 100_000)):
            yield part


def coded(split: Splitter, table: MergeTable, texts: list[str | None], with_ids: bool) -> list[tuple[int, str, str, np.ndarray]]:
    """(number of ids, their digest, the decoded bytes' digest, ids if wanted) of each text."""
    texts = [x or "" for x in texts]
    short = [split.of(x).findall(x) if len(x) <= LONG else None for x in texts]
    table.learn(set().union(*(x for x in short if x)))
    out: list = [None] * len(texts)
    # Long texts come last: what they learn may clear the cache, and the short ones' words with it.
    for i in sorted(range(len(texts)), key=lambda i: short[i] is None):
        x, words = texts[i], short[i]
        n, ids, sha, back = 0, [], hashlib.sha256(), hashlib.sha256()
        for part in [words] if words is not None else _cut(split.of(x), x):
            if words is None:
                table.learn(set(part))
            if part:
                said = " ".join(map(table.known.__getitem__, part))
                sha.update(f" {said}".encode() if n else said.encode())
                back.update(table.bytes_for(part))
                n += said.count(" ") + 1
                if with_ids:
                    ids.append(np.array(said.split(), dtype=np.int32))
        out[i] = (n, sha.hexdigest(), back.hexdigest(), np.concatenate(ids) if ids else NO_IDS)
    return out


def encode(df: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if with_ids."""
    import public_tokenizers

    path, usual = path or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    pattern = pattern or usual
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, table = Splitter(pattern, usual), merge_table(path)
        for batch in (p for b in batches for p in pieces(b)):
            n, sha, back, ids = zip(*coded(split, table, batch.column("text").to_pylist(), with_ids), strict=True)
            columns = [batch.column("key"), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)
        table.close()

    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode(df: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: key and the bytes that its ids stand for (null ids: null). Ids of many rows are decoded by one ordered aggregation."""
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merge_table(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                here = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([here.column("key"), pa.array(table.decoded(here.column("ids")), pa.binary())], [key, "decoded"])
        table.close()

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, decoded binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), with_ids=False)
