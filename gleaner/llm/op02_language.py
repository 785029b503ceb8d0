"""Language identification: script ranges narrow candidates, Viterbi labels spans.

A word is a letter (Unicode category L) with the letters and combining marks (category M) that follow it. Training learns,
per language, log-probabilities of character trigrams inside words (word bounds marked, add-one smoothing) and the share
of letters by script, from a bounded sample of labelled rows: for each language the `per_lang` keys with the least hashes,
one row each. A word's script, from code point ranges, leaves as candidates the languages that use it; each candidate
scores the word by the sum of its trigrams' log-probabilities, relative to the best one. Viterbi over a text's words, with
a penalty for each switch of language, labels every word, so mixed text falls into spans. A text's language is the one
with most letters in its spans, and its score their share of all letters.

Most texts are of one language throughout: where no stretch of words gains as much by other languages as one switch
costs, the path that stays is the best one (``stays``), and the recursion runs for the other texts only.

The model has a rate for at most MODEL trigrams, dealt evenly to the languages, each one's most frequent ones; so what
the driver gathers and broadcasts is bounded by MODEL times the number of languages, which has no cap.

Defined results: null texts and texts without a letter are `und` with score 0 and no spans; a script that no language
uses leaves all languages as candidates; ties go to the language that sorts first; without labelled rows everything is
`und`; rows with equal doc_id are rated separately; an empty table gives an empty result; other columns are ignored. A
text of any length is rated whole: its words are rated in stretches, with some bytes a word and language kept for the way
back.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, bounds, documents, durable, pieces, release

#: Labelled rows of each language that training reads.
PER_LANG = 1500
#: Trigrams in the model, of all languages together.
MODEL = 400_000
#: Cost of a change of language between two words, in nats.
SWITCH = 8.0
#: Share of letters in one language below which a text is rejected.
CONFIDENT = 0.4
#: Words remembered by a worker before it starts anew.
CACHE = 200_000
#: Texts of more characters are taken in stretches.
LONG = 1 << 20
UNKNOWN = "und"
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: The same words by the standard library's faster engine, for texts without a character of ELSEWHERE.
LATIN = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")
ELSEWHERE = re.compile("[\u0250-\U0010ffff]")
#: First and last code points of scripts; anything else is "other".
SCRIPTS = (
    (0x0041, 0x024F, "latin"),
    (0x1E00, 0x1EFF, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x1F00, 0x1FFF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"),
    (0x0750, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"),
    (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"),
    (0x3040, 0x30FF, "kana"),
    (0x3400, 0x4DBF, "han"),
    (0x4E00, 0x9FFF, "han"),
    (0x1100, 0x11FF, "hangul"),
    (0xAC00, 0xD7AF, "hangul"),
)


_STARTS = np.array([a for a, _, _ in sorted(SCRIPTS)])
_ENDS = np.array([b for _, b, _ in sorted(SCRIPTS)])
_NAMES = [name for _, _, name in sorted(SCRIPTS)] + ["other"]


def words_in(text: str) -> re.Pattern | regex.Pattern:
    return WORDS if ELSEWHERE.search(text) else LATIN


def scripts_of(words: list[str]) -> list[str]:
    """The script of each word's first letter."""
    c = np.fromiter((ord(w[0]) for w in words), dtype=np.int64, count=len(words))
    at = np.searchsorted(_STARTS, c, side="right") - 1
    return [_NAMES[i] for i in np.where((at >= 0) & (c <= _ENDS[at]), at, len(_NAMES) - 1).tolist()]


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words' trigrams, a mark at either end of a word, and the first trigram of each word."""
    lower = [w.lower() for w in words]
    c = np.frombuffer("".join(["\0", "\0".join(lower), "\0"]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    inside = c[1:-1] != 0
    codes = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inside]
    sizes = np.fromiter(map(len, lower), dtype=np.int64, count=len(lower))
    return codes, np.cumsum(sizes) - sizes


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # trigrams, sorted
    rates: np.ndarray  # trigrams x languages, the last row for unseen ones
    scripts: dict[str, np.ndarray]
    words: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    @staticmethod
    def fit(counts: list[tuple[str, int, int]], letters: list[tuple[str, str, int]], share: float = 0.01) -> Model:
        """counts: (language, trigram code, count); letters: (language, script, count)."""
        langs = sorted({x[0] for x in counts})
        codes = np.array(sorted({x[1] for x in counts}), dtype=np.int64)
        table = np.zeros((len(codes) + 1, max(1, len(langs))))
        number = {lang: i for i, lang in enumerate(langs)}
        if counts:
            np.add.at(table, (np.searchsorted(codes, [x[1] for x in counts]), [number[x[0]] for x in counts]), [x[2] for x in counts])
        rates = np.log(table + 1.0) - np.log(table.sum(axis=0) + len(table))
        used = dict.fromkeys(langs, 0)
        for lang, _, n in letters:
            used[lang] = used.get(lang, 0) + n
        scripts: dict[str, np.ndarray] = {}
        for lang, script, n in letters:
            if n > share * used[lang] and lang in number:
                scripts.setdefault(script, np.zeros(len(langs), dtype=bool))[number[lang]] = True
        return Model(langs, codes, rates.astype(np.float32), scripts)

    def _rate(self, words: list[str]) -> np.ndarray:
        codes, first = _trigrams(words)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        out = np.add.reduceat(self.rates[np.where(self.codes[at] == codes, at, len(self.codes))], first, axis=0)
        every = np.ones(len(self.langs), dtype=bool)
        able = np.array([self.scripts.get(s, every) for s in scripts_of(words)])
        out[~able] = -np.inf
        return np.maximum(out - out.max(axis=1, keepdims=True), -30.0)

    def learn(self, words: set[str]) -> None:
        """Rates the words that the cache lacks."""
        new = words - self.words.keys()
        if new:
            if len(self.words) + len(new) > CACHE:
                self.words, self.scores = {}, None
                new = words
            order = sorted(new)
            self.words.update(zip(order, range(len(self.words), len(self.words) + len(order)), strict=True))
            fresh = self._rate(order)
            self.scores = fresh if self.scores is None else np.concatenate([self.scores, fresh])

    def index(self, words: list[str]) -> np.ndarray:
        """Row numbers in `scores` of words that are in the cache."""
        return np.fromiter(map(self.words.__getitem__, words), dtype=np.int32, count=len(words))


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """For each text (words x languages) the best language of every word; the texts go abreast, the longest first."""
    if not scores:
        return []
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    longest = int(sizes[0])
    langs = scores[order[0]].shape[1]
    alive = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    flat = np.empty((int(sizes.sum()), langs), dtype=np.float32)  # word 0 of all texts, word 1 of all that have one, ...
    begin = np.append(0, np.cumsum(alive))
    for rank, i in enumerate(order):
        flat[begin[: sizes[rank]] + rank] = scores[i]
    stays = np.empty(flat.shape, dtype=bool)
    came = np.empty(len(flat), dtype=np.int16)
    best = np.zeros((len(order), langs), dtype=np.float32)
    for t in range(longest):
        n = alive[t]
        top = best[:n].argmax(axis=1)
        jump = best[np.arange(n), top][:, None] - switch
        at = slice(begin[t], begin[t] + n)
        came[at] = top
        np.greater_equal(best[:n], jump, out=stays[at])
        best[:n] = np.maximum(best[:n], jump)
        best[:n] += flat[at]
        best[:n] -= best[:n].max(axis=1, keepdims=True)
    said = best.argmax(axis=1)
    # best of a text is final where the text ends, since later steps touch the longer ones only
    label = np.empty(len(flat), dtype=np.int16)
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        at = slice(begin[t], begin[t] + n)
        now = said[:n]
        label[at] = now
        said[:n] = np.where(stays[at][np.arange(n), now], now, came[at])
    out: list = [None] * len(scores)
    for rank, i in enumerate(order):
        out[i] = label[begin[: sizes[rank]] + rank]
    return out


def stays(scores: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """For each text (of `sizes` words, one after another in `scores`) the language that all its words have, or -1 if that is not certain.

    A path that leaves a language for a stretch of words gains at most what the best of the others has over it there, and
    pays one switch at least. Where no stretch gains that much, staying is the only best path.
    """
    ends = np.cumsum(sizes)
    first = ends - sizes
    langs = scores.shape[1]
    best = np.add.reduceat(scores.astype(np.float64), first, axis=0).argmax(axis=1)
    if langs == 1:
        return best
    mine = np.repeat(best, sizes)
    here = np.arange(len(scores))
    own = scores[here, mine].astype(np.float64)
    others = scores.copy()
    others[here, mine] = -np.inf
    gain = others.max(axis=1) - own
    for i, (a, b) in enumerate(zip(first.tolist(), ends.tolist(), strict=True)):
        part = gain[a:b]
        if part.max() > 0:
            total = np.concatenate([[0.0], np.cumsum(part)])
            if (total - np.minimum.accumulate(total)).max() >= switch - 1e-3:
                best[i] = -1
    return best


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, size: int = MODEL) -> Model:
    """Learns from a bounded sample of the rows with a language: per_lang rows of each, whatever keys repeat."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter("l IS NOT NULL AND t IS NOT NULL")
    place = F.shiftrightunsigned(F.xxhash64("k"), 1).cast("double") / F.lit(float(1 << 63))
    # Some three times the rows wanted pass by their hashes alone, so the ranking sees few rows whatever the table's size.
    kinds = durable(rows.groupBy("l").agg(F.approx_count_distinct("k").alias("n")))
    few = rows.select("l", "k").join(F.broadcast(kinds), "l").filter(place * F.col("n") < 3 * per_lang).select("l", "k").distinct()
    order = Window.partitionBy("l").orderBy(F.xxhash64("k"), F.col("k"))
    chosen = durable(few.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_lang).select("l", "k"))
    # per_lang keys of each language, so they may be broadcast.
    found = rows.alias("r").join(F.broadcast(chosen).alias("c"), (F.col("r.l") == F.col("c.l")) & F.col("r.k").eqNullSafe(F.col("c.k")))
    picked = found.groupBy("r.l", "r.k").agg(F.max(F.struct(F.xxhash64("r.t").alias("h"), F.col("r.t").alias("t"))).alias("x")).select("l", "x.t")
    seen = durable(picked.mapInArrow(_count, "l string, script string, code long, n long").groupBy("l", "script", "code").agg(F.sum("n").alias("n")))
    letters = seen.filter("script IS NOT NULL").select("l", "script", "n").collect()
    share = max(1, size // max(1, len({r.l for r in letters})))
    top = Window.partitionBy("l").orderBy(F.desc("n"), "code")
    codes = seen.filter("script IS NULL").withColumn("i", F.row_number().over(top)).filter(F.col("i") <= share).select("l", "code", "n").toArrow()
    return Model.fit(list(zip(*(codes.column(c).to_pylist() for c in ("l", "code", "n")), strict=True)), [tuple(r) for r in letters])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams and letters by script of rows (l, t), added up by language."""
    for batch in (p for b in batches for p in pieces(b, "t")):
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column("l").to_pylist(), batch.column("t").to_pylist(), strict=True):
            words[lang].update(words_in(text).findall(text))
        for lang, seen in words.items():
            if seen:
                order = list(seen)
                n = np.fromiter(seen.values(), dtype=np.int64, count=len(order))
                codes, first = _trigrams(order)
                code, at = np.unique(codes, return_inverse=True)
                total = np.bincount(at, weights=np.repeat(n, np.diff(np.append(first, len(codes))))).astype(np.int64)
                letters: Counter = Counter()
                for script, word, k in zip(scripts_of(order), order, n.tolist(), strict=True):
                    letters[script] += k * len(word)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * (len(code) + len(letters))),
                        pa.array([None] * len(code) + list(letters), pa.string()),
                        pa.array(code.tolist() + [0] * len(letters), pa.int64()),
                        pa.array(total.tolist() + list(letters.values()), pa.int64()),
                    ],
                    ["l", "script", "code", "n"],
                )


def rate(m: Model, texts: list[str | None], switch: float = SWITCH) -> Iterator[tuple[str, float, list[dict]]]:
    """(language, score, spans in characters) of each text."""
    texts = [x or "" for x in texts]
    words = [words_in(x).findall(x) if len(x) < LONG else None for x in texts]
    some = [i for i, w in enumerate(words) if w] if m.langs else []
    label: dict[int, np.ndarray | int] = {}
    if some:
        m.learn(set().union(*(words[i] for i in some)))
        size = np.fromiter((len(words[i]) for i in some), dtype=np.int64, count=len(some))
        scores = m.scores[np.concatenate([m.index(words[i]) for i in some])]
        fixed = stays(scores, size, switch)
        label = {i: int(x) for i, x in zip(some, fixed.tolist(), strict=True) if x >= 0}
        begin = np.append(0, np.cumsum(size)).tolist()
        open_ = [k for k, x in enumerate(fixed.tolist()) if x < 0]
        label |= zip((some[k] for k in open_), viterbi([scores[begin[k] : begin[k + 1]] for k in open_], switch), strict=True)
        del scores
    for i, x in enumerate(texts):
        if words[i] is None and m.langs:  # a long text: by itself, since what it learns may clear the cache
            got = _long(m, x, switch)
            yield got if got else (UNKNOWN, 0.0, [])
        elif i not in label:
            yield UNKNOWN, 0.0, []
        elif isinstance(label[i], int):
            first, last = words[i][0], words[i][-1]
            yield m.langs[label[i]], 1.0, [{"begin": x.find(first), "end": x.rfind(last) + len(last), "lang": m.langs[label[i]]}]
        else:
            yield _summary(m, x, np.fromiter(map(len, words[i]), dtype=np.int64, count=len(words[i])), label[i])


def _long(m: Model, text: str, switch: float) -> tuple[str, float, list[dict]] | None:
    scores, sizes = [], []
    found = (x.group() for x in words_in(text).finditer(text))
    while part := list(islice(found, 50_000)):
        m.learn(set(part))
        scores.append(m.scores[m.index(part)])
        sizes.append(np.fromiter(map(len, part), dtype=np.int64, count=len(part)))
    if not scores:
        return None
    rows, size = np.concatenate(scores), np.concatenate(sizes)
    lang = int(stays(rows, np.array([len(rows)]), switch)[0])
    return _summary(m, text, size, np.full(len(rows), lang) if lang >= 0 else viterbi([rows], switch)[0])


def _summary(m: Model, text: str, sizes: np.ndarray, label: np.ndarray) -> tuple[str, float, list[dict]]:
    share = np.bincount(label, weights=sizes, minlength=len(m.langs))
    edge = np.append(0, np.flatnonzero(label[1:] != label[:-1]) + 1)
    place = np.array([x.span() for x in words_in(text).finditer(text)])
    last = np.append(edge[1:] - 1, len(label) - 1)
    spans = [{"begin": int(place[a, 0]), "end": int(place[b, 1]), "lang": m.langs[label[a]]} for a, b in zip(edge.tolist(), last.tolist(), strict=True)]
    return m.langs[int(share.argmax())], float(share.max() / share.sum()), spans


def labeller(spark: SparkSession, model: Model, switch: float = SWITCH) -> Callable[[Column], Column]:
    """text -> struct<lang_pred, score, spans>. Only the text goes to Python and only the verdict comes back."""
    sent = bounded_batches(spark).sparkContext.broadcast(model)  # bounded, see MODEL
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for texts in batches:
            for a, b in bounds(texts):
                said, score, spans = zip(*rate(m, texts.slice(a, b - a).to_pylist(), switch), strict=True)
                yield pa.StructArray.from_arrays([pa.array(said, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)], ["lang_pred", "score", "spans"])
        m.words, m.scores = {}, None
        release()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Nondeterministic, so that a filter on the verdict doesn't make a second call of it.
    return F.arrow_udf(run, "lang_pred string, score double, spans array<struct<begin: int, end: int, lang: string>>").asNondeterministic()


def label_spans(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", switch: float = SWITCH) -> DataFrame:
    """Per row: key, lang_pred, score, spans (begin, end, lang) in characters of the text."""
    rows = df.select(F.col(key).alias("key"), labeller(df.sparkSession, model, switch)(F.col(text)).alias("said"))
    return rows.select(F.col("key").alias(key), "said.lang_pred", "said.score", "said.spans")


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def _taught(docs: DataFrame) -> Model:
    return train(docs.filter(F.coalesce(~held_out(), F.lit(False))))


def confident(docs: DataFrame, least: float = CONFIDENT) -> DataFrame:
    """Rows of docs whose language is known: not `und`, and `least` of the letters in spans of one language. Learns as op2 does."""
    rated = docs.select(F.struct("*").alias("row"), labeller(docs.sparkSession, _taught(docs))(F.col("text")).alias("said"))
    return rated.filter((F.col("said.lang_pred") != UNKNOWN) & (F.col("said.score") >= least)).select("row.*")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    said = label_spans(docs, _taught(docs))
    return said.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")
