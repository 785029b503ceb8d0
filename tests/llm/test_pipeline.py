"""The pipeline's rows against brute force, stage by stage."""

import base64
from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.conftest import CLASHING, texts
from tests.llm.test_operators import brute_classes, brute_fingerprint, lowered_words, sha


def _without_repeats(rows, width=200):
    data = {k: (t or "").encode() for k, t in rows.items()}
    seen = Counter(d[i : i + width] for d in data.values() for i in range(len(d) - width + 1))
    for k, d in data.items():
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = True
        yield k, bytes(x for x, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore")


def test_pipeline(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    seen = Counter(r[0] for r in texts())
    rows = [r for r in texts() if r[0] is not None and seen[r[0]] == 1]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, f"{columns}, {CLASHING}").select("doc_id", "text", "lang", "source", "n_chars")
    long_text = next(r[1] for r in rows if r[0] == 14)
    bench = [(1, " ".join(long_text.split()[:400])), (2, "spam spam")]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    first = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    kept = {r.doc_id: r.text for r in first.collect()}
    assert not {6, 7, 8, 13} & set(kept) and {1, 2, 3, 4, 5, 14} <= set(kept)
    prints = [(k, brute_fingerprint(t)) for k, t in sorted(kept.items())]
    kept = {k: kept[k] for (k, _), c in zip(prints, brute_classes(prints), strict=True) if k == c}
    kept = dict(_without_repeats(kept))
    windows = {tuple(w[a : a + 13]) for w in (lowered_words(t) for _, t in bench) for a in range(max(1, len(w) - 12))}
    sizes = {len(w) for w in windows}

    def clean(text):
        w = lowered_words(text)
        hit = {j for n in sizes for a in range(len(w) - n + 1) if tuple(w[a : a + n]) in windows for j in range(a, a + n)}
        return not hit or 20 * len(hit) < len(w)

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {(k, sha(" ".join(map(str, enc.encode_ordinary(t))).encode()), sha(t.encode())) for k, t in kept.items() if clean(t)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want) < len(rows)


def test_stages_on_odd_tables(spark, tmp_path):
    """Null and repeated doc_ids, and columns named like those that the stages use inside, go through every stage; empty tables give empty results."""
    extra = "_rid string, kept_key long, kept_rid long, bad_key long, bad_rid long, row string, said string, cut string, key long, rid string, kept string, runs string, text_ string, win long, term string, n long, `a.b` string"
    names = [x.split()[0].strip("`") for x in extra.split(", ")]
    odd = lambda v: [v if x.split()[1] == "long" else str(v) for x in extra.split(", ")]
    rows = [(*r[:5], *odd(i)) for i, r in enumerate(texts())]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, "spam spam"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r[0] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = docs.collect()
        assert {r.doc_id for r in got} <= left and all([str(r[x]) for x in names] == [str(r[names[1]])] * len(names) for r in got), name
        left = {r.doc_id for r in got}
    assert None in left and 10 in left
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
