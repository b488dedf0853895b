"""The whole pipeline against brute force over a small corpus with planted copies, passages and benchmark text."""

import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tessarion.llm import neardup
from tessarion.llm.common import Scratch
from tessarion.llm.language import detect_languages

from tests.llm.test_operators import brute_substrings, fill, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    base = spark.read.parquet(f"{SF}/documents.parquet")
    long = [r for r in base.orderBy("doc_id").collect() if len(words(r["text"])) > 120][:4]
    a, b = long[0]["text"], long[1]["text"]
    passage = " ".join(words(a)[:70])
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    planted = [
        (9000, a, "en", "s"), (9001, a + " extra words here", "en", "s"), (9002, " ".join(words(b)[:40]) + " " + passage, "en", "t"), (9003, " ".join(words(long[2]["text"])[:40]) + " " + item, "en", None),
        (9004, None, None, "t"), (9005, "", "en", "t"), (9006, "123 456", "en", "t"), (9007, long[3]["text"] + "\n" + passage, "de", "u"),
    ]
    rows = spark.createDataFrame([(*p, len(p[1] or "")) for p in planted], base.schema.names[0] + " bigint, text string, lang string, source string, n_chars bigint")
    base.select("doc_id", "text", "lang", "source", "n_chars").unionByName(rows).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_run(corpus, spark):
    got = corpus_pipeline.run(spark, corpus).collect()
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    # language ID
    found = {r["doc_id"]: r for r in detect_languages(spark, docs).collect()}
    left = {i for i, r in found.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE}
    assert not left & {9004, 9005, 9006} and len(left) >= len(rows) - 4
    # near copies: all pairs
    idf, _ = neardup.idf_table(spark.createDataFrame([(rows[i]["text"],) for i in left], "text string"), Scratch(spark, "t"))
    h, _, off = neardup.shingle_sets(pa.array([rows[i]["text"] for i in sorted(left)]))
    sets = {i: h[off[k] : off[k + 1]] for k, i in enumerate(sorted(left))}
    plain = {i: set(s.tolist()) for i, s in sets.items()}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in left:
        for j in left:
            if i < j and len(plain[i] & plain[j]) >= 0.6 * max(len(plain[i]), len(plain[j])) and neardup.weighted_jaccard(sets[i].tobytes(), sets[j].tobytes(), idf) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    left = {i for i in left if find(i) == i}
    assert not left & {9000, 9001}
    # substrings, then benchmark windows
    text = {i: (kept if gone else rows[i]["text"]) for i, n, gone, kept in brute_substrings([(i, rows[i]["text"]) for i in left]) if gone < n or not gone}
    assert len(words(text[9002])) < len(words(rows[9002]["text"]))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = set()
    for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect():
        w = rx.findall(r["text"].translate(low))
        wins |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in wins}
    dirty = {i for i, t in text.items() if any(tuple(w[k : k + n]) in wins for w in [rx.findall(t.translate(low))] for n in sizes for k in range(len(w) - n + 1))}
    assert 9003 in dirty
    text = {i: t for i, t in text.items() if i not in dirty}
    # mixing
    size = {i: len(words(t)) for i, t in text.items()}
    total: dict = {}
    for i, n in size.items():
        total[rows[i]["source"]] = total.get(rows[i]["source"], 0) + n
    target = fill(total, 1.5, 2.0)
    assert {(r["doc_id"], r["source"], r["size"], r["source_size"]) for r in got} == {(i, rows[i]["source"], n, total[rows[i]["source"]]) for i, n in size.items()}
    taken: dict = {}
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert np.allclose([taken[s] for s in total], [target[s] for s in total], atol=1)


def test_near_dup_stage_with_odd_ids(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    rows = [(1, text("a")), (1, text("b")), (None, text("c")), (None, text("d")), (None, text("d")), (None, text("a") + " more"), (2, text("b")), (3, text("e")), (3, text("e"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.near_dup_stage(spark, docs, SF).collect()
    want = [(1, text("a")), (1, text("b")), (None, text("c")), (None, text("d")), (3, text("e"))]
    assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame(want, docs.schema).collect())


def test_stages_with_odd_rows(spark):
    """Empty tables, repeated rows, null texts and ids, and columns under names that the stages use themselves."""
    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    rows = [(1, text("a")), (1, text("a")), (None, text("b")), (2, None), (3, ""), (4, "x " + text("a"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "whole", "k", i) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, whole0 string, key string, id bigint")
    plain = lambda df: sorted((str(r["doc_id"]), r["text"], r["whole0"], r["key"]) for r in df.collect())
    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    want = lambda *kept: sorted((str(i), t, "whole", "k") for i, t in kept)
    assert plain(corpus_pipeline.near_dup_stage(spark, docs, folder)) == want(rows[0], rows[2], rows[3], (3, ""))
    assert plain(corpus_pipeline.substring_stage(spark, docs, folder)) == want(rows[0], rows[0], *rows[2:5], (4, "x"))
    assert plain(corpus_pipeline.benchmark_stage(spark, docs, folder)) == want(*rows)
