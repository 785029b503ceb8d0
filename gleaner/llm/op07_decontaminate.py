"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Term counts over the corpus pick the two rarest terms of every benchmark window. The index stores a posting for each
occurrence of a rarest term: document row, position, and the terms around it as far as the windows reach that it was
picked for; and one row per document with its number of words. A window's candidates are the postings of its rarest term,
moved by its offset, that its second rarest term confirms at its own. The lists of all its terms, moved by their offsets,
are then intersected on these candidates by a join on (document row, position, term). Where all terms agree the phrase
stands exactly; where `NEAR` of `WIDTH` do, nearly (proximity).

The benchmark's terms are broadcast in blocks of BLOCK terms, one pass over the documents for each block, so there is one
way for benchmarks of any size.

Defined results: null and empty texts have no words; they are clean and count 0; empty items match nothing; repeated rows
are judged separately and alike; items that share a window all count; of terms equally rare the first is taken; an empty
benchmark leaves all clean; a text of any length is indexed whole, its words one after another; empty tables give empty
results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import documents, durable, row_key
from gleaner.llm.repeats import Scratch

WIDTH = 13
#: Terms of a window that agree in a proximity match, of WIDTH.
NEAR = 10
#: Terms that are broadcast at once: 50 bytes or so each.
BLOCK = 500_000
#: What separates words, before A-Z become a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands after a document's last word, so its position is the number of words.
END = ""


def words_of(text: Column) -> Column:
    """Words as written; A-Z not yet lower-cased."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def _plain(word: Column) -> Column:
    """A-Z lower-cased; most words are, and are left as they stand."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def _windows(items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(win, terms), each different window once, and (win, item)."""
    n = F.size("words")
    size = F.least(n, F.lit(width))
    every = items.filter(n > 0).select("item", "words", size.alias("size"), F.explode(F.sequence(F.lit(0), n - size)).alias("begin"))
    every = every.select("item", F.slice("words", F.col("begin") + 1, F.col("size")).alias("terms")).distinct()
    windows = durable(every.select("terms").distinct().select(F.monotonically_increasing_id().alias("win"), "terms"))
    return windows, durable(every.join(windows, "terms").select("win", "item").distinct())


def _blocks(terms: DataFrame) -> list[DataFrame]:
    """terms, cut into blocks that may be broadcast; one, at least."""
    n = max(1, -(-terms.count() // BLOCK))
    return [F.broadcast(terms.filter(F.pmod(F.xxhash64("term"), F.lit(n)) == i)) for i in range(n)]


def _index(docs: DataFrame, items: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, windows with their rarest terms). Postings: key, rid, pos, term, n, begin, near; term END marks a document's end."""
    scratch = Scratch(docs.sparkSession)
    words = docs.select("key", "rid", words_of(F.col("text")).alias("words"))
    terms = durable(items.select(F.explode("words").alias("term")).distinct())
    spoken = words.select(F.explode("words").alias("word")).select(_plain(F.col("word")).alias("term"))
    seen = reduce(DataFrame.unionByName, [spoken.join(block, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")) for block in _blocks(terms)])
    seen = durable(seen)

    each = windows.select("win", "terms", F.posexplode("terms").alias("off", "term")).join(seen, "term", "left")
    ranked = each.groupBy("win", "terms").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term"))).alias("by"))
    # A window whose rarest term the corpus lacks stands nowhere.
    rare = ranked.filter(F.col("by")[0]["n"] > 0).select("win", "terms", F.col("by")[0]["term"].alias("term"), F.col("by")[0]["off"].alias("off"), F.get("by", F.lit(1)).alias("second"))
    rare = durable(rare)
    reach = rare.groupBy("term").agg(F.max("off").alias("left"), F.max(F.size("terms") - 1 - F.col("off")).alias("right"))
    ends = docs.sparkSession.createDataFrame([(END, 0, 0)], reach.schema)

    ended = words.select("key", "rid", "words", F.posexplode(F.concat("words", F.array(F.lit(END)))).alias("pos", "word"))
    ended = ended.select("key", "rid", "words", "pos", _plain(F.col("word")).alias("term"))
    begin = F.greatest(F.col("pos") - F.col("left"), F.lit(0))
    near = F.transform(F.slice("words", begin + 1, F.col("pos") + F.col("right") + 1 - begin), _plain)
    # The join is inside the scan's stage, so the words stay where they are; a block is never shuffled.
    found = [ended.join(block, "term").select("key", "rid", "pos", "term", F.size("words").alias("n"), begin.alias("begin"), F.when(F.col("term") != END, near).alias("near")) for block in _blocks(durable(reach.unionByName(ends)))]
    return scratch.keep(reduce(DataFrame.unionByName, found), "postings"), rare


def alignments(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, documents, windows): places are (key, rid, win, start, size, agreed), documents (key, rid, n), a row for each of docs, windows (win, item)."""
    items = durable(benchmark.select(F.col(item).cast("string").alias("item"), F.transform(words_of(F.col(item_text)), _plain).alias("words")).filter(F.size("words") > 0).distinct())
    windows, names = _windows(items, width)
    given = docs.select(F.col(key).alias("key"), row_key(F.col(key), F.col(text)).alias("rid"), F.col(text).alias("text"))
    postings, rare = _index(given, items, windows)
    here = postings.filter(F.col("term") != END)
    start, size = F.col("pos") - F.col("off"), F.size("terms")
    candidates = (
        here.join(rare, "term")
        .filter((start >= 0) & (start + size <= F.col("n")))
        .filter(F.col("second").isNull() | (F.get("near", start + F.col("second.off") - F.col("begin")) == F.col("second.term")))
        .select("key", "rid", "win", start.alias("start"), size.alias("size"), "terms")
        .distinct()
    )
    wanted = candidates.select("key", "rid", "win", "start", "size", F.posexplode("terms").alias("off", "term")).withColumn("pos", F.col("start") + F.col("off"))
    lists = here.select("key", "rid", "begin", F.posexplode("near").alias("at", "term")).select("key", "rid", (F.col("begin") + F.col("at")).alias("pos"), "term").distinct()
    a, b = wanted.alias("a"), lists.alias("b")
    met = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.rid") == F.col("b.rid")) & (F.col("a.pos") == F.col("b.pos")) & (F.col("a.term") == F.col("b.term")))
    places = met.groupBy("a.key", "a.rid", "win", "start", "size").agg(F.count(F.lit(1)).alias("agreed"))
    return places, postings.filter(F.col("term") == END).select("key", "rid", F.col("pos").cast("long").alias("n")), names


def match(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, near: int = NEAR) -> DataFrame:
    """Phrase and proximity matches: (key, rid, item, begin, end, agreed, exact), the words begin..end-1 of a document row where a window of the item stands or nearly stands."""
    places, _, names = alignments(docs, benchmark, key, text, width=width)
    found = places.filter(F.col("agreed") * width >= F.col("size") * near).join(names, "win")
    return found.select("key", "rid", "item", F.col("start").alias("begin"), (F.col("start") + F.col("size")).alias("end"), "agreed", (F.col("agreed") == F.col("size")).alias("exact")).distinct()


def judge(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, near: int = NEAR) -> DataFrame:
    """Per row of docs: key, rid, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items (items of which a window stands at least nearly)."""
    places, rows, names = alignments(docs, benchmark, key, text, width=width)
    places = durable(places.filter(F.col("agreed") * width >= F.col("size") * near))
    exact = places.filter("agreed = size")
    # Covered words of a row: windows in order, each counted from where the ones before it end. A row has at most its own windows.
    order = Window.partitionBy("key", "rid").orderBy("start", "end")
    spans = exact.select("key", "rid", "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cover = spans.select("key", "rid", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(reach, F.lit(0)))).alias("n")).groupBy("key", "rid").agg(F.sum("n").alias("n_hit"))
    named = places.groupBy("key", "rid", "win").agg(F.max(F.col("agreed") == F.col("size")).alias("exact")).join(names, "win")
    named = named.groupBy("key", "rid", "item").agg(F.max("exact").alias("exact"))
    named = named.groupBy("key", "rid").agg(F.count(F.lit(1)).alias("n_near"), F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"))
    hits = named.alias("x").join(cover.alias("y"), F.col("x.key").eqNullSafe(F.col("y.key")) & (F.col("x.rid") == F.col("y.rid")), "left").select("x.*", "n_hit").alias("h")
    out = rows.alias("r").join(hits, F.col("r.key").eqNullSafe(F.col("h.key")) & (F.col("r.rid") == F.col("h.rid")), "left")
    n_hit, found = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("r.key").alias(key),
        "r.rid",
        F.col("n").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near_items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs that are not contaminated."""
    bad = durable(judge(docs, benchmark, key, text).filter("contaminated").select(F.col(key).alias("key"), "rid").distinct()).alias("b")
    rows = docs.select(F.col(key).alias("key"), row_key(F.col(key), F.col(text)).alias("rid"), F.struct("*").alias("row")).alias("a")
    return rows.join(bad, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.rid") == F.col("b.rid")), "left_anti").select("row.*")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("rid")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[b : b + least(len(w), 13) - 1], ' ') AS win
  FROM i, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS u(b) WHERE len(w) > 0),
dw AS (
  SELECT rid, b, size, array_to_string(w[b : b + size - 1], ' ') AS win
  FROM d, (SELECT DISTINCT size FROM iw) z, unnest(range(1, len(w) - size + 2)) AS u(b) WHERE len(w) >= size),
h AS (SELECT rid, b, dw.size AS size, item FROM dw JOIN iw ON dw.size = iw.size AND dw.win = iw.win),
p AS (SELECT rid, count(DISTINCT x) AS n FROM h, unnest(range(b, b + size)) AS u(x) GROUP BY rid),
t AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid),
f AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY word),
-- Windows that nearly stand: their two rarest terms do, and 10 of 13 of all.
ew AS (SELECT DISTINCT item, w[b : b + least(len(w), 13) - 1] AS win FROM i, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS u(b) WHERE len(w) > 0),
kw AS (SELECT win, unnest(win) AS word, generate_subscripts(win, 1) AS off FROM (SELECT DISTINCT win FROM ew)),
ko AS (SELECT win, word, off, row_number() OVER (PARTITION BY win ORDER BY coalesce(n, 0), off) AS k FROM kw LEFT JOIN f USING (word)),
k2 AS (SELECT a.win, a.word AS t1, a.off AS o1, z.word AS t2, z.off AS o2 FROM ko a LEFT JOIN ko z ON a.win = z.win AND z.k = 2 WHERE a.k = 1),
dp AS (SELECT rid, w, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
al AS (SELECT rid, win, w[p - o1 + 1 : p - o1 + len(win)] AS part FROM dp JOIN k2 ON word = t1
       WHERE p >= o1 AND p - o1 + len(win) <= len(w) AND (t2 IS NULL OR w[p - o1 + o2] = t2)),
nw AS (SELECT DISTINCT rid, win FROM al WHERE 13 * len(list_filter(range(1, len(win) + 1), lambda x: part[x] = win[x])) >= 10 * len(win)),
ni AS (SELECT rid, count(DISTINCT item) AS n FROM nw JOIN ew USING (win) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(p.n, 0) > 0 AND 20 * coalesce(p.n, 0) >= len(w) AS contaminated,
       coalesce(ni.n, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid) LEFT JOIN ni USING (rid)
"""
