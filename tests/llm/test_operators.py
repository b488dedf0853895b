"""The operators against brute force on small fixtures, with nulls, empties, repeats and odd columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessarion.llm import language, neardup, substrings, token_counts
from tessarion.llm.common import Scratch
from tessarion.llm.components import connected_components
from tessarion.llm.decontaminate import clean_documents, decontaminate
from tessarion.llm.html import extract_pages
from tessarion.llm.language import detect_languages
from tessarion.llm.mixing import mix_sources, permuted
from tessarion.llm.neardup import near_dup_classes
from tessarion.llm.quality import score_quality
from tessarion.llm.substrings import dedup_substrings
from tessarion.llm.token_counts import TokenLedger, count_tokens, rollups
from tessarion.llm.vectors import vector_classes
from tessarion.llm.warc import archive_round_trip

SF = "/root/testdata/sf0.001"
RNG = random.Random(11)
VOCAB = ["w%d" % k for k in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


BASE = prose(300)
PASSAGE = prose(70)
TEXTS = [
    None, "", "  \n", "one", BASE, BASE, "other " + BASE, prose(40) + " " + PASSAGE + " " + prose(30), PASSAGE + " " + prose(90), prose(10) + " " + PASSAGE[:-3],
    BASE + " " + prose(20), prose(120), "É " + prose(60), "12345 67890", prose(2500), "short text here", "short text here", PASSAGE + " " + PASSAGE,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "de", None][k % 3], ["a", "b", None][k % 3], len(t or ""), f"key{k}", k, "x") for k, t in enumerate(TEXTS)]
    rows.append(rows[4])  # a repeated row
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, text_key string, n_words bigint, spans string")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select("id", permuted(F.col("id"), F.lit(n), F.lit(5).cast("bigint")).alias("p"))
        df = df.withColumn("back", permuted(F.col("p"), F.lit(n), F.lit(5).cast("bigint"), inverse=True))
        rows = df.collect()
        assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def fill(sizes, share, cap):
    """Targets by resharing again and again."""
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, full, target = share * sum(sizes.values()), {}, {}
    while True:
        left, open_ = total - sum(full.values()), [s for s in sizes if s not in full]
        if not open_:
            return full
        target = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if target[s] > cap * sizes[s]]
        if not over:
            return full | target
        full |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("block", [16, 1024])
def test_mixing(docs, block):
    spark = docs.sparkSession
    out, slots = mix_sources(spark, docs, block=block, slots_per_shard=8)
    rows = out.collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], len(words(r["text"]))) for r in docs.collect())
    sizes = Counter()
    taken = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = fill(sizes, 1.5, 2.0)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sum(r["words"] for r in slots.collect()) == sum(taken.values())
    again = mix_sources(spark, docs.repartition(5), block=block, slots_per_shard=8)[0].collect()
    assert sorted(map(tuple, [[str(x) for x in r] for r in rows])) == sorted(map(tuple, [[str(x) for x in r] for r in again]))


def test_components(spark):
    edges = [(k, k + 1) for k in range(12)] + [(100, 101), (101, 100), (7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect()}
    assert got == {**{k: 0 for k in range(13)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200}


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(100 + k, (base[k % 5] + rng.standard_normal(8) * 0.12).tolist()) for k in range(30)]
    rows += [(200, base[3].tolist()), (201, (base[3] * 7).tolist()), (300, None), (301, []), (302, [0.0] * 8), (303, [1.0, None] + [0.0] * 6), (304, [float("nan")] * 8), (305, [float("inf")] + [0.0] * 7), (306, base[3].tolist()[:4])]
    got = {r["vec_id"]: r for r in vector_classes(spark, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), recall=0.9999).collect()}
    good = {i: np.array(v, float) for i, v in rows if v and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    links = {i: {j for j in good if j != i and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.9} for i in good}
    for i, _ in rows:
        seen, stack = {i}, [i]
        while stack:
            for j in links.get(stack.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links.get(i, ())), min(seen), i == min(seen)), i


def test_decontamination(docs, spark):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(1, PASSAGE.upper()), (2, "Short, Text!"), (3, None), (4, "..."), (5, "nowhere to be found at all in any of these texts ever"), (6, "é"), (10, "É"), (2, "Short, Text!"), (7, "12345-67890")]
    wins = defaultdict(set)
    for i, t in items:
        w = rx.findall((t or "").translate(low))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])].add(str(i))
    want = []
    for r in docs.collect():
        w = rx.findall((r["text"] or "").translate(low))
        hit, found = set(), set()
        for g, ids in wins.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= ids
        want.append((r["doc_id"], len(w), len(hit), sorted(found)))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (64 << 20, 30_000):
        got = decontaminate(spark, docs, table, broadcast_bytes=size).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in got) == sorted(want)
    assert {r["doc_id"] for r in clean_documents(spark, docs, table).collect()} == {w[0] for w in want if not w[2]}
    assert {r["n_hit"] for r in decontaminate(spark, docs, table.limit(0)).collect()} == {0}


def brute_substrings(rows):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("most", [2048, 1])
def test_substrings(docs, most, monkeypatch):
    monkeypatch.setattr(substrings, "AUTOMATON", most)  # 1: every anchor with differing segments elects again
    want = brute_substrings([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = dedup_substrings(docs.sparkSession, docs).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == sorted(want)
    assert sum(w[2] for w in want) > 300
    assert {r["others"]["text_key"] for r in got} == {f"key{k}" for k in range(len(TEXTS))}


def test_near_duplicates(docs):
    got = {r["doc_id"]: r for r in near_dup_classes(docs.sparkSession, docs).collect()}
    assert got[5]["class_id"] == got[6]["class_id"] == 4 and got[4]["n_copies"] == 3
    assert got[10]["class_id"] == 4 and got[16]["class_id"] == 15
    alone = set(range(len(TEXTS))) - {5, 6, 10, 16}
    assert all(got[k]["class_id"] == k and got[k]["kept"] for k in alone)


def brute_classes(spark, texts):
    """Least place of each text's class, over all pairs."""
    idf, _ = neardup.idf_table(spark.createDataFrame([(t,) for t in texts], "text string"), Scratch(spark, "t"))
    h, _, off = neardup.shingle_sets(pa.array(texts))
    sets = [h[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and neardup.weighted_jaccard(sets[a], sets[b], idf) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return dict(enumerate(root))


def variants(rng, groups, size, changes):
    """Groups of texts that differ from a base in up to ``changes`` words."""
    texts = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(300)]
        for _ in range(size):
            t = list(base)
            for k in rng.sample(range(300), rng.randint(0, changes)):
                t[k] = f"x{rng.random()}"
            texts.append(" ".join(t))
    return texts


def test_near_duplicates_around_the_threshold(spark):
    texts = variants(random.Random(5), 25, 10, 14)
    want = brute_classes(spark, texts)
    assert 25 < len(set(want.values())) < 200
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dup_classes(spark, table).collect()} == want


def test_near_duplicates_across_parts(spark, monkeypatch):
    rng = random.Random(6)
    texts = []
    for g in range(2):  # texts of a template, below the threshold to each other, and a near copy of some
        base = [f"g{g}w{k}" for k in range(300)]
        for n in range(40):
            t = list(base)
            for k in rng.sample(range(300), 5):
                t[k] = f"x{rng.random()}"
            texts.append(" ".join(t))
            if n % 4 == 0:
                t[rng.randrange(300)] = f"x{rng.random()}"
                texts.append(" ".join(t))
    want = brute_classes(spark, texts)
    assert 60 < len(set(want.values())) < 85
    monkeypatch.setattr(neardup, "PART", 3)
    monkeypatch.setattr(neardup, "BLOCK", 2)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dup_classes(spark, table).collect()} == want


def test_document_frequencies_are_exact(spark):
    rng = random.Random(8)
    common = [f"c{k}" for k in range(60)]
    texts = [" ".join(common + [f"{k}a{j}" for j in range(40)]) for k in range(30)]
    texts += [" ".join(str(rng.random()) for _ in range(3000)) for _ in range(150)] + [None, ""]
    table = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    idf, n = neardup.idf_table(table, Scratch(spark, "t"))
    assert n == len(texts)
    sets = [Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in map(words, texts)]
    df = Counter(g for x in sets for g in x)
    weight = lambda g: 1 + neardup.IDF_SHARE * np.log((1 + n) / (1 + df[g])) / np.log(2 + n)
    for a, b in ((0, 1), (7, 20)):
        want = sum(map(weight, sets[a].keys() & sets[b].keys())) / sum(map(weight, sets[a].keys() | sets[b].keys()))
        h, _, off = neardup.shingle_sets(pa.array([texts[a], texts[b]]))
        assert abs(neardup.weighted_jaccard(h[: off[1]].tobytes(), h[off[1] :].tobytes(), idf) - want) < 1e-5


def test_languages(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, "en"), (900002, "12 34 !", "en"), (900003, "", None)], "doc_id bigint, text string, lang string")
    rows = detect_languages(spark, table.select("doc_id", "text", "lang").unionByName(odd)).collect()
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows if r["doc_id"] > 900000} == {k: ("und", 0.0) for k in (900001, 900002, 900003)}
    lang = {r["doc_id"]: r["lang"] for r in table.collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in lang]
    assert len(held) > 20 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.9
    assert {r["lang_pred"] for r in detect_languages(spark, odd.where("lang IS NULL")).collect()} == {"und"}
    assert language.train([]) is None


def test_quality(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = score_quality(spark, d, y).join(y, "doc_id", "left").collect()
    assert len(rows) == d.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert len(held) > 50 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93
    assert {r["score"] for r in score_quality(spark, d.limit(3), y.limit(0)).collect()} == {0.5}


def test_pages(spark):
    rows = [(1, "u", "<article><p>Text, here.</p></article>"), (2, None, None), (3, "v", ""), (3, "v", "")]
    got = extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == [(1, "Text, here."), (2, ""), (3, ""), (3, "")]


def test_archives(spark):
    big, other = "x" * 1000, "é" * 600
    rows = [(1, "http://a/1", big), (2, None, big), (9, "u v", big), (3, "c", other), (4, "d", None), (5, "e", ""), (6, "f", "tiny"), (7, "g", "tiny"), (None, "n", "lost")]
    got = archive_round_trip(spark, spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows)
    for i, _, text in rows:
        body = (text or "").encode()
        assert (by[i]["payload_bytes"], by[i]["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        assert by[i]["payload"] is None or bytes(by[i]["payload"]) == body
    assert {i: (by[i]["record_type"], by[i]["refers_to"]) for i in (1, 2, 9, 6, 7)} == {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None), 6: ("response", None), 7: ("response", None)}


def test_ledger(spark, tmp_path):
    schema = "sign int, text string, source string, lang string"
    rows = [(1, "some text here", "a", "en"), (1, None, None, "en"), (1, "more", "a", None), (1, "more", "a", None)]
    load = spark.createDataFrame(rows, schema)
    ledger = TokenLedger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    assert ledger.commit("1", load) and not ledger.commit("1", load.union(load))
    got = {(r["source"], r["lang"]): (r["docs"], r["chars"], r["tokens"]) for r in ledger.totals().collect()}
    assert got == {("a", "en"): (1, 14, 3), (None, "en"): (1, 0, 0), ("a", None): (2, 8, 2)}
    # one document is revised, one goes
    assert ledger.commit("2", spark.createDataFrame([(-1, "some text here", "a", "en"), (1, "some text", "a", "en"), (-1, None, None, "en")], schema))
    got = {(r["source"], r["lang"]): (r["docs"], r["chars"], r["tokens"]) for r in ledger.totals().collect()}
    assert got == {("a", "en"): (1, 9, 2), ("a", None): (2, 8, 2)}
    other = TokenLedger(spark, f"file://{tmp_path}/ledger", version="next")
    assert other.commit("1", load) and {r["tokenizer"] for r in other.totals().collect()} == {"byte_bpe_50k", "next"}
    top = rollups(ledger.totals()).where("level = 1 AND tokenizer = 'byte_bpe_50k'").first()
    assert (top["docs"], top["tokens"]) == (3, 4)


def test_ledger_commits(spark, tmp_path):
    """Of two writers of one batch one counts; a marker without content is none; compaction changes no total."""
    load = spark.createDataFrame([(1, "some text here", "a", "en"), (1, "more", "b", None)], "sign int, text string, source string, lang string")
    ledger = TokenLedger(spark, f"file://{tmp_path}/ledger")
    twin = TokenLedger(spark, f"file://{tmp_path}/ledger")
    twin.committed = lambda batch_id: False  # it looked before the other one was done
    assert ledger.commit("1", load) and not twin.commit("1", load)
    (tmp_path / "ledger" / "_commits" / ledger._name("2")).touch()
    assert not ledger.committed("2") and ledger.commit("2", load)
    before = sorted(map(str, ledger.totals().collect()))
    assert sum(r["docs"] for r in ledger.totals().collect()) == 4
    ledger.compact()
    assert len(ledger.commits.all()) == 1 and sorted(map(str, ledger.totals().collect())) == before
    assert ledger.committed("1") and not ledger.commit("1", load)


def test_token_counts(docs):
    """Every level against plain counts of the texts as they are in the end."""
    want = Counter()
    for path in (token_counts.TOKENIZER, token_counts.NEWER):
        name, enc = path.split("/")[-1].split(".")[0], token_counts.encoding(path, open(path, "rb").read())
        for r in docs.collect():
            text = r["text"]
            if words(text):
                for key in ((3, name, r["source"], r["lang"] or "und"), (2, name, r["source"], None), (1, name, None, None)):
                    for k, n in enumerate((1, len(text), len(enc.encode_ordinary(text)))):
                        want[key, k] += n
    got = {((r["level"], r["tokenizer"], r["source"], r["lang"]), k): r[m] for r in count_tokens(docs.sparkSession, docs).collect() for k, m in enumerate(token_counts.MEASURES)}
    assert got == want


def test_clashing_labels(spark):
    """A document that is labelled both ways teaches nothing, in whatever order its labels come."""
    d = spark.createDataFrame([(k, f"text number {k} " * (3 if k % 2 else 30)) for k in range(40)], "doc_id bigint, text string")
    y = [(k, k % 2) for k in range(40)]
    want = {r["doc_id"]: r["score"] for r in score_quality(spark, d, spark.createDataFrame([r for r in y if r[0] != 4], "doc_id bigint, quality int")).collect()}
    got = {r["doc_id"]: r["score"] for r in score_quality(spark, d, spark.createDataFrame([(4, 1), *y, (4, 0), (7, None)], "doc_id bigint, quality int")).collect()}
    assert got == want


def test_odd_ids(spark):
    """Rows under a null id, or under one id with several texts, are judged by their own text."""
    item = " ".join(f"q{k}" for k in range(12))
    rows = [(None, "a " + item, "x"), (None, "clean", "x"), (1, "clean too", "y"), (1, item, "y"), (2, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, text_key string").withColumn("key", F.lit(1)).withColumn("row", F.lit(2)).withColumn("id", F.lit(3))
    kept = clean_documents(spark, docs, spark.createDataFrame([(1, item), (None, "clean")], "item_id bigint, text string"))
    assert kept.columns == docs.columns and {(r["doc_id"], r["text"]) for r in kept.collect()} == {(None, "clean"), (1, "clean too"), (2, None)}
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(5, long), (None, long), (None, long), (6, "x " + long), (6, "other"), (4, None)]
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in dedup_substrings(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(5, 60): 0, (None, 60): 0, (6, 61): 60, (6, 1): 0, (4, 0): 0}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    out = [
        mix_sources(spark, none)[0], decontaminate(spark, none, items), dedup_substrings(spark, none), detect_languages(spark, none), near_dup_classes(spark, none),
        extract_pages(pages), archive_round_trip(spark, pages), score_quality(spark, none, spark.createDataFrame([], "doc_id bigint, quality int")),
        count_tokens(spark, none), vector_classes(spark, spark.createDataFrame([], "vec_id bigint, embedding array<float>")),
    ]
    assert [df.count() for df in out] == [0] * len(out)
