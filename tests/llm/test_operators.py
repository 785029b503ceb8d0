"""Each operator against a brute-force version over nulls, empty and long texts, ties, repeated rows and clashing names."""

import base64
import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gleaner.llm import op01_simhash, op02_language, op03_quality, op04_substring, op05_suffix, op06_rules, op07_decontaminate, op08_bpe, op09_quotes, op10_license
from tests.llm.conftest import texts

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda b: hashlib.sha256(b).hexdigest()


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# 1


def brute_fingerprint(text):
    w = [x.encode() for x in SPACE_WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, radius=3):
    """component by row for (key, print) rows."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    keys = {}
    for i, (k, _) in enumerate(prints):
        keys.setdefault(find(i), []).append(k)
    return [min([k for k in keys[find(i)] if k is not None], default=None) for i in range(len(prints))]


def test_simhash(docs, none):
    prints = [(r[0], brute_fingerprint(r[1])) for r in texts()]
    want = Counter((k, p - (1 << 64) if p >> 63 else p, c) for (k, p), c in zip(prints, brute_classes(prints), strict=True))
    for tile in (4096, 3):  # small tiles force pairs of tiles
        assert rows_of(op01_simhash.near_classes(docs, tile=tile), "doc_id", "fp", "component") == want
    assert op01_simhash.near_classes(none).count() == 0


def test_simhash_links_across_tiles(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (12, 2))] + [base]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for tile in (4096, 2):
        from gleaner.llm.components import components

        got = {r.node: r.root for r in components(op01_simhash.links(df, tile=tile), "a", "b").collect()}
        classes = brute_classes([(int(x), int(x)) for x in fps])
        want = Counter()
        for x, c in zip(fps, classes, strict=True):
            want[c] += 1
        assert Counter(Counter(got.values()).values()) == Counter(n for n in want.values() if n > 1)


def test_keep_one(docs, none):
    kept = op01_simhash.keep_one(docs)
    assert kept.columns == docs.columns
    prints = [(r[0], brute_fingerprint(r[1])) for r in texts()]
    classes = Counter(brute_classes(prints))
    named = {(k, p) for (k, p), c in zip(prints, brute_classes(prints), strict=True) if k == c}  # one row for each class that has a key
    got = Counter((r.doc_id, brute_fingerprint(r.text)) for r in kept.collect())
    assert set(got) - {(None, p) for _, p in prints} <= named and max(got.values()) == 1 and {k for k, _ in got} >= set(classes) - {None}
    assert op01_simhash.keep_one(none).count() == 0


# 2


def test_language(docs, none, spark):
    learn = [(i, f"{a} {b} " * 20, lang, "s", 0, 1, "r", 2, "x", "w", "c", 3) for i, (a, b, lang) in enumerate([("the house", "was there", "en"), ("la maison", "était là", "fr"), ("это дом", "был там", "ru")])]
    model = op02_language.train(spark.createDataFrame(learn, docs.schema))
    mixed = spark.createDataFrame([(1, "the house was there " * 10 + "la maison était là " * 4), (2, None), (3, "123 !"), (4, "был дом"), (4, "house")], "doc_id long, text string")
    got = op02_language.label_spans(mixed, model).orderBy("doc_id", "lang_pred").collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, "en"), (2, "und"), (3, "und"), (4, "en"), (4, "ru")]
    assert [s["lang"] for s in got[0].spans] == ["en", "fr"] and 0.5 < got[0].score < 1 and got[1].score == 0
    labelled = op02_language.label_spans(docs, model)
    assert labelled.count() == docs.count()
    assert {r.lang_pred for r in labelled.filter("doc_id IN (6, 7, 8, 13)").collect()} == {"und"}
    assert op02_language.label_spans(none, op02_language.train(none)).count() == 0
    assert {r.lang_pred for r in op02_language.label_spans(docs, op02_language.train(none)).collect()} == {"und"}
    assert set(op02_language.confident(docs).columns) == set(docs.columns)


def test_letters_and_marks():
    """A letter is of category L; marks go with it, and nothing else makes a word."""
    for text in ("² ½ ①", "Ⅷ", "1 _ 2", "", "\u0301"):
        assert op02_language.words_in(text).findall(text) == []
    assert op02_language.words_in("हिन्दी").findall("हिन्दी बांग्ला x²y") == ["हिन्दी", "बांग्ला", "x", "y"]
    assert op02_language.words_in("é").findall("été l’an a_b ª") == ["été", "l", "an", "a", "b", "ª"]
    latin = "".join(map(chr, range(1, 0x250)))
    assert op02_language.LATIN.findall(latin) == op02_language.WORDS.findall(latin)


def small_model(spark, **more):
    learn = [(i, f"{t} " * 20, lang) for i, (t, lang) in enumerate([("the house was there", "en"), ("la maison est là", "fr"), ("das haus war dort", "de")])]
    return op02_language.train(spark.createDataFrame(learn, "doc_id long, text string, lang string"), **more)


def brute_label(m, text, switch):
    """The best language of each word, over all paths."""
    words = op02_language.WORDS.findall(text)
    rates = [m._rate([w])[0] for w in words]
    best = max(itertools.product(range(len(m.langs)), repeat=len(words)), key=lambda p: (sum(float(r[x]) for r, x in zip(rates, p, strict=True)) - switch * sum(x != y for x, y in zip(p, p[1:], strict=False)), [-x for x in p]))
    return [m.langs[x] for x in best], list(map(len, words))


def test_labels_against_all_paths(spark):
    m, rng = small_model(spark), random.Random(4)
    pool = "the house was there la maison est là das haus war dort other".split()
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 8))) for _ in range(40)] + ["the house was la maison est", None, "12"]
    for switch in (0.5, 3.0, 8.0):
        for text, (said, score, spans) in zip(texts, op02_language.rate(m, texts, switch), strict=True):
            if not text or not op02_language.WORDS.findall(text):
                assert (said, score, spans) == ("und", 0.0, [])
                continue
            label, sizes = brute_label(m, text, switch)
            share = {x: sum(n for y, n in zip(label, sizes, strict=True) if y == x) for x in set(label)}
            assert share[said] == max(share.values()) and score == pytest.approx(share[said] / sum(sizes))
            assert [x["lang"] for x in spans] == [k for k, _ in itertools.groupby(label)]
            assert [len(op02_language.WORDS.findall(text[x["begin"] : x["end"]])) for x in spans] == [len(list(g)) for _, g in itertools.groupby(label)]


def test_language_long_text_between_short_ones(spark, monkeypatch):
    """A long text that clears the cache leaves the short ones' words in reach, and is rated as a short one is."""
    texts = ["the house", "la maison est là " * 9 + "the house was there " * 5, "house was", None, "maison"]
    want = list(op02_language.rate(small_model(spark), texts))
    m = small_model(spark)
    monkeypatch.setattr(op02_language, "LONG", 20)
    monkeypatch.setattr(op02_language, "CACHE", 3)
    assert list(op02_language.rate(m, texts)) == want and [x[0] for x in want] == ["en", "fr", "en", "und", "fr"]
    assert [x["lang"] for x in want[1][2]] == ["fr", "en"]


def test_language_sample_is_bounded(spark):
    """A key that repeats brings one row, and a language with many rows some of them."""
    rows = [(1, f"un deux {i}", "fr") for i in range(300)] + [(i, f"one two {i % 7}", "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = op02_language.train(df, per_lang=20)
    assert m.langs == ["en", "fr"] and len(op02_language.train(df, size=10).codes) <= 10


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    scores = [-rng.random((n, 3)).astype(np.float32) * 3 for n in (1, 5, 7, 2)]
    for s, got in zip(scores, op02_language.viterbi(scores, 1.5), strict=True):
        value = lambda path, s=s: sum(s[i, x] for i, x in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:], strict=False))
        best = max(value(np.unravel_index(k, (3,) * len(s))) for k in range(3 ** len(s)))
        assert value(got.tolist()) == pytest.approx(best, abs=1e-4)


# 3


def test_weak_labels():
    rng = np.random.default_rng(0)
    good = rng.random(5000) < 0.7
    right = np.array([0.95, 0.9, 0.8])
    votes = np.where(rng.random((5000, 3)) < right, good[:, None], ~good[:, None]) * 2
    found, n = np.unique(op03_quality.pattern(votes), return_counts=True)
    post, by, prior = op03_quality.estimate(found, n, labellers=3)
    assert abs(prior - 0.7) < 0.05 and np.abs(by[1, :, 2] - right).max() < 0.06
    labels = dict(zip(found.tolist(), post.tolist(), strict=True))
    assert np.mean([(labels[p] > 0.5) == g for p, g in zip(op03_quality.pattern(votes).tolist(), good, strict=True)]) > 0.93


def test_quality(docs, none):
    got = op03_quality.classify(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.quality_score <= 1 for r in got)
    assert all(r.quality_score == 0 and not r.kept for r in got if not r.n_words)
    assert op03_quality.classify(none).count() == 0


# 4, 5


def brute_words(width):
    words = [SPACE_WORDS.findall(r[1] or "") for r in texts()]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    for r, w in zip(texts(), words, strict=True):
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        yield r[0], len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())


def test_substring(docs, none):
    assert rows_of(op04_substring.remove(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute_words(35))
    assert op04_substring.remove(none).count() == 0


def brute_paths(rows):
    """Sets of ids on one maximal nonbranching path each; rows are (id, a, b)."""
    ways = lambda k: Counter(r[k] for r in rows)
    out, into = ways(1), ways(2)
    starts = {r[1]: r[0] for r in rows}
    group = {r[0]: {r[0]} for r in rows}
    for i, _, b in rows:
        if out[b] == into[b] == 1 and starts[b] not in group[i]:
            both = group[i] | group[starts[b]]
            for j in both:
                group[j] = both
    return {frozenset(g) for g in group.values()}


def test_compacted_paths(spark):
    rng = random.Random(8)
    rows = [(i, i, i + 1, 1, 0, i) for i in range(40)]  # along one document
    rows += [(100 + i, 200 + i, 201 + i, 1, i, 7) for i in range(37)]  # each from another document
    rows += [(300 + i, 400 + i, 400 + (i + 1) % 11, 1, i % 3, 50 + i) for i in range(11)]  # a circle
    rows += [(500, 600, 600, 1, 9, 9)]  # a loop
    rows += [(700 + i, 800 + rng.randrange(30), 800 + rng.randrange(30), rng.randrange(1, 4), rng.randrange(4), 100 + 5 * i) for i in range(40)]
    graph = spark.createDataFrame(rows, "id long, a long, b long, n int, rid long, at int").repartition(5)
    got = {}
    for r in op04_substring.compact(graph, op04_substring.repeats.Scratch(spark)).collect():
        got.setdefault(r.path, set()).add(r.id)
    assert {frozenset(g) for g in got.values()} == brute_paths([r[:3] for r in rows])
    assert all(path in ids for path, ids in got.items())
    assert op04_substring.compact(graph.filter("id < 0"), op04_substring.repeats.Scratch(spark)).count() == 0


def test_pieces_of_texts_together():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, high, (2, int(n)), dtype=np.uint64) for n, high in zip(rng.integers(35, 400, 60), itertools.cycle([1, 3, 1 << 60]), strict=False)]
    find = lambda group: op04_substring.repeats.find_pieces(np.concatenate(group, axis=1), np.cumsum([x.shape[1] for x in group]), 35, 8)
    together, apart = list(zip(*(x.tolist() for x in find(texts)), strict=True)), []
    for i, text in enumerate(texts):
        apart += [(a, d, i, p, n, t) for a, d, _, p, n, t in zip(*(x.tolist() for x in find([text])), strict=True)]
        assert sum(n * t for _, _, k, _, n, t in together if k == i) == text.shape[1] - 34
    assert together == apart


def test_occurrences_with_other_words_stay():
    words = [b"%d" % (i % 50) for i in range(200)]
    check = op04_substring._check(words, 3, 20, 35)
    source = [np.array(x) for x in ([3, 53, 4, 3], [20, 20, 20, 20], [1, 1, 1, 2], [check, check, check, check])]
    assert op04_substring._verified(words, *source, 35).tolist() == [True, True, False, False]
    words = [b"%d" % (i % 5) for i in range(200)]
    check = op04_substring._check(words, 3, 5, 35)
    assert op04_substring._verified(words, *(np.array(x) for x in ([3], [5], [20], [check])), 35).tolist() == [True]
    words[90] = b"x"
    assert op04_substring._verified(words, *(np.array(x) for x in ([3], [5], [20], [check])), 35).tolist() == [False]



def brute_bytes(width):
    data = [(r[1] or "").encode() for r in texts()]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    for r, d in zip(texts(), data, strict=True):
        gone = np.zeros(len(d) + 1, dtype=bool)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((gone[:-1] & ~np.append(False, gone[:-1])[: len(d)]).sum()) if len(d) else 0
        yield r[0], len(d), int(gone.sum()), spans, sha(bytes(x for x, g in zip(d, gone, strict=False) if not g))


@pytest.mark.parametrize("most", [2500, 1])
def test_suffix(docs, none, most, monkeypatch):
    monkeypatch.setattr(op05_suffix, "repeated_spans", lambda *a, f=op05_suffix.repeated_spans, **k: f(*a, **k, most=most, slot=7))
    assert rows_of(op05_suffix.remove(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute_bytes(200))
    assert op05_suffix.remove(none).count() == 0


def test_suffix_in_pipeline(docs):
    out = op05_suffix.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("text IS NULL").count() == 2
    assert all(r.n_chars == len(r.text) for r in out.filter("text IS NOT NULL").collect())


@pytest.mark.parametrize("shard", [2, 7, 100])
def test_merge_of_transforms(shard):
    rng = random.Random(shard)
    for width in (4, 6, 10):
        base = bytes(rng.choice(b"abc") for _ in range(80))
        strings = [bytes(rng.choice(b"abd") for _ in range(rng.randrange(4))) + base[(i := rng.randrange(40)) : i + rng.randrange(width, 40)] for _ in range(30)]
        strings = [s if len(s) >= width else s + b"x" * width for s in strings]
        weights = [rng.choice([1, 1, 2]) for _ in strings]
        seen = Counter()
        for s, n in zip(strings, weights, strict=True):
            for i in range(len(s) - width + 1):
                seen[s[i : i + width]] += n
        for s, runs in zip(strings, op05_suffix.repeated_windows(strings, weights, width, shard), strict=True):
            assert [i for a, n in runs for i in range(a, a + n)] == [i for i in range(len(s) - width + 1) if seen[s[i : i + width]] > 1]


# 6


def test_verdict(docs, spark):
    """kept, against the rules read off by hand."""
    rules = [[("symbols_per_word", ">", 0.5), ("n_words", ">", 25.0)], [("marks_per_word", "<=", 0.02), ("word_length", ">", 6.0)]]
    for r in op06_rules.rate(docs, rules).join(op06_rules.statistics(docs).selectExpr("key AS doc_id", "n_words AS w", "n_marks", "word_chars AS c", "n_symbols AS s", "n_repeat_words AS rep"), "doc_id").filter("doc_id <> 10").collect():
        n = max(r.w, 1)
        failed = r.w < 20 or 100 * r.rep > 30 * r.w
        fires = [r.s / n > 0.5 and r.w > 25, r.n_marks / n <= 0.02 and r.c / n > 6]
        assert r.base_failed == failed and r.kept == (not failed and not any(fires)) and r.rule == (fires.index(True) + 1 if any(fires) else None)


def test_statistics(docs, none):
    def brute(text):
        text = text or ""
        w = SPACE_WORDS.findall(text)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if SPACE_WORDS.search(x)]
        return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)

    got = rows_of(op06_rules.statistics(docs).withColumnRenamed("key", "doc_id"), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == Counter((r[0], *brute(r[1])) for r in texts())
    assert op06_rules.rate(none, []).count() == 0


def test_decision_list(docs, spark):
    rng = np.random.default_rng(3)
    x = rng.random((3000, 2))
    rules = op06_rules.learn(x, (x[:, 0] > 0.8) & (x[:, 1] < 0.5), np.arange(3000) % 3 == 0, ["a", "b"])
    assert rules and {c[0] for c in rules[0]} == {"a", "b"}
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 0, 0), (99, None, 1)], "doc_id long, quality int, toxic int")
    got = op06_rules.rate(docs, op06_rules.fit(docs, labels))
    assert got.count() == docs.count() and got.filter("base_failed AND kept").count() == 0
    assert op06_rules.fit(docs, labels.limit(0)) == []


# 7


def lowered_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_decontamination(docs, none, spark):
    long_text = next(r[1] for r in texts() if r[0] == 14)
    items = [(1, " ".join(long_text.split()[100:140])), (2, "TWO words"), (3, None), (4, ""), (5, "spam spam spam"), (6, "nowhere to be found"), (20, " ".join(long_text.split()[120:133]).upper().lower()), (20, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = {}
    for i, t in items:
        w = lowered_words(t)
        for a in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[a : a + 13]), set()).add(str(i))
    sizes = {len(w) for w in wins}

    def brute(text):
        w, hit, names = lowered_words(text), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    names |= found
        return len(w), len(hit), len(names), sha(",".join(sorted(names)).encode()), bool(hit) and 20 * len(hit) >= len(w)

    got = rows_of(op07_decontaminate.judge(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == Counter((r[0], *brute(r[1])) for r in texts())
    assert op07_decontaminate.clean(docs, bench).count() == sum(not brute(r[1])[-1] for r in texts())
    assert op07_decontaminate.judge(none, bench).count() == 0
    assert op07_decontaminate.judge(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    found = op07_decontaminate.match(docs, bench.filter("item_id = 1"))
    assert found.filter("exact").count() >= 28


def test_decontamination_in_blocks(docs, spark, monkeypatch):
    """Terms that are broadcast a few at a time give the same rows."""
    long_text = next(r[1] for r in texts() if r[0] == 14)
    bench = spark.createDataFrame([(1, " ".join(long_text.split()[100:140])), (2, "TWO words")], "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items"]
    want = rows_of(op07_decontaminate.judge(docs, bench), *columns)
    monkeypatch.setattr(op07_decontaminate, "BLOCK", 12)
    assert rows_of(op07_decontaminate.judge(docs, bench), *columns) == want


def test_proximity(spark):
    """A passage with some words changed is near, not exact; one without its rarest terms is neither."""
    item = [f"w{i}" for i in range(13)]
    changed = lambda *at: " ".join("z" if i in at else w for i, w in enumerate(item))
    common = " ".join(item[2:]) + " x"
    rows = [(1, "a b " + changed(5) + " c"), (2, changed(4, 6, 8)), (3, changed(4, 6, 8, 9)), (4, changed(0)), (5, changed()), *[(10 + i, common) for i in range(3)]]
    found = op07_decontaminate.match(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert {(r.key, r.begin, r.agreed, r.exact) for r in found.collect()} == {(1, 2, 12, False), (2, 0, 10, False), (5, 0, 13, True)}


# 8


def test_bpe(docs, none):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = op08_bpe.encode(docs)
    want = Counter()
    for r in texts():
        ids = enc.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r[1] or "").encode()))] += 1
    assert rows_of(coded, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = Counter((r[0], bytes(r[1])) for r in op08_bpe.decode(coded).collect())
    assert back == Counter((r[0], (r[1] or "").encode()) for r in texts())
    assert op08_bpe.encode(none).count() == 0


def test_bpe_in_stretches(spark, monkeypatch):
    df = spark.createDataFrame([(1, "It's one of  the\n\n words, 123 über " * 50)], "doc_id long, text string")
    whole = op08_bpe.encode(df).first()
    monkeypatch.setattr(op08_bpe, "LONG", 10)
    cut = list(op08_bpe._cut(op08_bpe.LATIN, df.first().text))
    assert [x for p in cut for x in p] == op08_bpe.LATIN.findall(df.first().text) and whole.n_tokens > 0


def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_long_text_between_short_ones(spark, monkeypatch):
    """A long text that clears the cache leaves the short ones' words in reach."""
    import public_tokenizers

    table, split = op08_bpe.MergeTable(public_tokenizers.path("byte_bpe_50k.tiktoken")), op08_bpe.Splitter(public_tokenizers.PATTERN, public_tokenizers.PATTERN)
    rows = ["one two", "three four five six seven eight", "two one", None, "nine ten eleven twelve thirteen", "one"]
    want = [x[:3] for x in op08_bpe.coded(split, table, rows, False)]
    monkeypatch.setattr(op08_bpe, "LONG", 10)
    monkeypatch.setattr(op08_bpe, "CACHE", 3)
    table.known, table.older = {}, {}
    assert [x[:3] for x in op08_bpe.coded(split, table, rows, False)] == want and [x[0] for x in want] == [len(tiktoken_encoding().encode_ordinary(r or "")) for r in rows]


def test_bpe_words_in_use_are_contracted_once(monkeypatch):
    import public_tokenizers

    table, contract, met = op08_bpe.MergeTable(public_tokenizers.path("byte_bpe_50k.tiktoken")), op08_bpe.MergeTable.contract, []
    monkeypatch.setattr(op08_bpe.MergeTable, "contract", lambda self, words: (met.extend(words), contract(self, words))[1])
    parts = [{f"{x}{i}" for i in range(45_000)} for x in "abc"]
    for part in (*parts, parts[0]):
        table.learn(part)
    assert len(met) == 135_000 and table.bytes_for(["a1", "a2"]) == b"a1a2"
    table.other["a2"] = b"?"
    assert table.bytes_for(["a1", "a2"]) == b"a1?"


def test_bpe_unbroken_runs():
    """Pretokens of any length, as tiktoken has them: random letters, digits and characters, runs and periods."""
    import public_tokenizers

    table, enc, rng = op08_bpe.MergeTable(public_tokenizers.path("byte_bpe_50k.tiktoken")), tiktoken_encoding(), random.Random(9)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    cases = [some(letters[:11], 5000), some(letters, 200_000), some("ACGT", 8000), some("0123456789", 8000), "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(4000))]
    cases += ["a" * 50_003, "xyz" + "a" * 2001 + "b" + "a" * 777, "ab" * 9001, "abc" * 3001 + "q" + "bca" * 2001, letters * 500, "=" * 9001, " " * 9001 + "x", "\n" * 3001]
    cases += ["".join(some(letters, 1) * rng.randrange(1, 90) for _ in range(60)), "".join(some(letters, rng.randrange(17, 60)) * rng.randrange(3, 20) for _ in range(20))]
    for n in range(1, 200):
        cases.append(some(letters[:2], n))
    split = op08_bpe.Splitter(public_tokenizers.PATTERN, public_tokenizers.PATTERN)
    for (n, _, back, ids, *_), x in zip(op08_bpe.coded(split, table, cases, True), cases, strict=True):
        assert list(ids) == enc.encode_ordinary(x) and n == len(ids) and back == sha(x.encode())


# 9


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there friend\nhow are you"),
        (1, 1, "assistant", "> hello   THERE friend\nfine"),
        (1, 2, "user", "On Monday X wrote:\n> fine\n>> Hello there friend\nok then"),
        (2, 0, "user", ">ok then\nnew conv"),
        (3, 0, None, None),
        (3, 0, "user", "> nothing known"),
        (4, 5, "user", "> new conv\nyes <|end|>"),
        (4, 9, "assistant", "> hello there friend how are you\n> fine\nmixed"),
        (None, 1, "user", "x"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, conv long, body string")
    got = rows_of(op09_quotes.format_chats(df), "conv_id", "turn", "thread_id", "reply_conv", "reply_turn", "by_quote", "n_quotes", "quote_depth", "body")
    assert got == Counter(
        [
            (1, 0, 1, None, None, False, 0, 0, "Hello there friend\nhow are you"),
            (1, 1, 1, 1, 0, True, 1, 1, "fine"),
            (1, 2, 1, 1, 1, True, 2, 2, "ok then"),
            (2, 0, 1, 1, 2, True, 1, 1, "new conv"),
            (3, 0, 3, None, None, False, 0, 0, ""),
            (3, 0, 3, None, None, False, 1, 1, ""),
            (4, 5, 1, 2, 0, True, 1, 1, "yes <|end|>"),
            (4, 9, 1, 1, 0, True, 3, 1, "mixed"),
            (None, 1, None, None, None, False, 0, 0, "x"),
        ]
    )
    assert op09_quotes.format_chats(df.limit(0)).count() == 0


def test_turn_before(spark):
    turns = [(c, t) for c in (1, 2) for t in (0, 1, 5, 999, 1000, 2500, 2501)]
    got = {(r.conv, r.turn): r.before for r in op09_quotes.turn_before(spark.createDataFrame(turns, "conv long, turn long")).collect()}
    assert all(got[(c, t)] == max((x for d, x in turns if d == c and x < t), default=None) for c, t in turns)


# 10


def test_alignment_is_patient():
    a, b = "x a b c d e f y g".split(), "a b q d e f g".split()
    pairs = op10_license.align(a, b)
    assert [a[i] for i, _ in pairs] == [b[j] for _, j in pairs] == "a b d e f g".split()
    assert pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)


def brute_common(a, b):
    """The longest common subsequence, by dynamic programming."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_against_dynamic_programming():
    """Never more than the longest common subsequence, and just that where words are unique; increasing pairs against all subsequences."""
    rng = random.Random(6)
    for n in range(200):
        b = rng.sample("abcdefghijklmnop", 9)
        a = [x for x in b if rng.random() < 0.8] if n % 2 else [rng.choice("abcdefghxyz") for _ in range(12)]
        a[rng.randrange(len(a) + 1) : 0] = ["?"] * rng.randrange(3)
        pairs = op10_license.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        best = brute_common(a, b)
        assert len(pairs) == best if n % 2 else len(pairs) <= best
        order = list(enumerate(rng.sample(range(20), 8)))
        longest = max(len(c) for k in range(1, 9) for c in itertools.combinations([y for _, y in order], k) if list(c) == sorted(c))
        assert len(op10_license._increasing(order)) == longest


def test_doubled_notices():
    """A notice that stands twice is found twice, a long one also with an edit, whatever the text begins and ends with."""
    wanted = {k: op10_license.words_of(v) for k, v in op10_license.TEMPLATES.items()}
    for name, text in op10_license.TEMPLATES.items():
        words = wanted[name]
        for begin, end in (("", ""), ("page", "end"), (f"{words[0]} page of ours", f"the end {words[-1]}")):
            a = len(op10_license.words_of(begin))
            twice = [x for x in op10_license.scan(f"{begin} {text} and more of it here {text} {end}", wanted) if x["name"] == name]
            assert len(twice) == 2 and {x["coverage"] for x in twice} == {1.0} and min(x["begin"] for x in twice) == a
            for at in (len(words) // 3, len(words) * 2 // 3):
                edited = " ".join([*words[:at], "changed", *words[at + 1 :]])
                found = [x for x in op10_license.scan(f"{begin} {edited} and more of it here {edited} {end}", wanted) if x["name"] == name]
                assert [x["matched"] for x in found] == ([len(words) - 1] * 2 if len(words) >= op10_license.SHORT else [])


def test_strewn_words_are_no_license():
    wanted = {k: op10_license.words_of(v) for k, v in op10_license.TEMPLATES.items()}
    assert op10_license.scan("Work released in May under pressure from the dean of MIT lost its license.", wanted) == []
    full = op10_license.words_of(op10_license.TEMPLATES["isc"])
    assert op10_license.scan(" filler and more ".join(full), wanted) == []
    long = "word " * 30_000 + op10_license.TEMPLATES["isc"] + " word" * 30_000
    assert [(x["name"], x["begin"], x["coverage"]) for x in op10_license.scan(long, wanted)] == [("isc", 30_000, 1.0)]


def test_licenses(docs, none, spark):
    full = op10_license.TEMPLATES["mit"]
    cases = spark.createDataFrame([(1, f"intro {full} outro"), (2, full.replace("merge", "join").replace("publish", "print")), (3, "Released under the MIT License."), (4, " ".join(full.split()[:20])), (5, None), (6, "Released under the GPL License.")], "doc_id long, text string")
    got = {r.doc_id: (r.license, round(r.coverage, 2)) for r in op10_license.scan_licenses(cases).collect()}
    assert got[1] == ("mit", 1.0) and got[2][0] == "mit" and 0.9 < got[2][1] < 1 and got[3] == ("mit-notice", 1.0) and got[4] == got[5] == got[6] == (None, 0.0)
    assert op10_license.scan_licenses(docs).filter("license IS NOT NULL").count() == 0
    assert op10_license.scan_licenses(none).count() == 0


def test_oracle_sql(docs, spark):
    """The SQL of two operators against the operators, on the same rows."""
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas()
    con.register("documents", documents)
    want = Counter(con.execute(op04_substring.ORACLE).fetchall())
    assert rows_of(op04_substring.remove(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    want = Counter(con.execute(op05_suffix.ORACLE).fetchall())
    assert rows_of(op05_suffix.remove(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
