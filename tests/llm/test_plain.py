"""The parts that need no Spark."""

import hashlib
import io
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tessarion.llm import html, language, neardup, quality, substrings, vectors, warc, words


def test_word_hashes_follow_split(monkeypatch):
    texts = [None, "", " \n", "a bb\tccc", "é ü\x0b\x0cx" * 40, "one", "x" * 3000 + " tail", "\x1ca\x85b c"]
    monkeypatch.setattr(words, "_PIECE", 64)
    h, off = words.word_hashes(*words.buffers(pa.array(texts)))
    parts = [(t or "").encode().split() for t in texts]
    assert np.diff(off).tolist() == [len(p) for p in parts]
    flat = [w for p in parts for w in p]
    assert len(set(flat)) == len(set(h.tolist())) and len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat))


def test_slices_keep_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (k * 7) for k in range(50)])], ["i", "text"])
    assert [i for s in words.slices([b], limit=300) for i in s.column("i").to_pylist()] == list(range(50))


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        known = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(rng.randrange(1, 5))]
        probe = [rng.randrange(3) for _ in range(30)]
        automaton = substrings.Automaton()
        for text in known:
            automaton.add(text)
        inside = lambda w: any(t[k : k + len(w)] == w for t in known for k in range(len(t)))
        want = [max(n for n in range(e + 1) if n == 0 or inside(probe[e - n : e])) for e in range(1, len(probe) + 1)]
        assert automaton.statistics(probe) == want
        cover = {k for e, n in enumerate(want, 1) if n >= 3 for k in range(e - n, e)}
        assert {k for s, n in substrings.known_spans(probe, automaton, 3) for k in range(s, s + n)} == cover


def test_electors_own_every_window_once():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 9, 400).astype(np.uint64)
    off = np.array([0, 30, 180, 180, 400])
    doc, start, n, anchor, content = substrings.electors(words.mix(h), off)
    windows = [(d, k) for d, s, m in zip(doc, start, n, strict=True) for k in range(s, s + m - substrings.WINDOW + 1)]
    assert sorted(windows) == [(d, k) for d in range(4) for k in range(max(0, off[d + 1] - off[d] - substrings.WINDOW + 1))]


def test_sampler_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**32, 400, dtype=np.uint64)).astype(np.uint32)
    wx, wy = rng.uniform(0.5, 2, len(h)), rng.uniform(0.5, 2, len(h))
    x, y = np.arange(len(h)) < 300, np.arange(len(h)) > 60
    both = x & y
    want = np.minimum(wx, wy)[both].sum() / (wx[x].sum() + wy[y].sum() - np.minimum(wx, wy)[both].sum())
    sampler = neardup.Sampler(4000)
    zero = np.zeros(1, np.int64)
    a, b = (sampler(h[m], np.log(w[m]).astype(np.float32), zero)[0] for m, w in ((x, wx), (y, wy)))
    assert abs((a == b).mean() - want) < 0.04


def test_gradient():
    net = language.Network.fresh(["a", "b", "c"], np.random.default_rng(0))
    x, valid, _ = language.segments(*words.buffers(pa.array(["hello world", "xyz"])))
    y = np.array([0, 2])
    _, grads = net.gradient(x, valid, y)
    for k, at in ((0, (104, 3)), (2, (2, 5)), (4, (2, 3)), (6, (1, 2)), (8, (0,))):
        p = net.parameters()[k]
        kept, e = p[at], 1e-2
        p[at] = kept + e
        up = net.gradient(x, valid, y)[0]
        p[at] = kept - e
        down = net.gradient(x, valid, y)[0]
        p[at] = kept
        assert abs((up - down) / (2 * e) - grads[k][at]) < 2e-3 + 0.05 * abs(grads[k][at])
    p = language.softmax(net.logits(x))
    fast = language.probabilities(net, x.astype(np.intp), valid)
    assert np.allclose(np.einsum("tnl,tn->ln", p, valid.astype(np.float32)), fast, atol=1e-4)


def test_segments_hold_every_byte():
    texts = pa.array(["", "a" * 63, "b" * 64, "c" * 65, None, "é" * 100])
    buf, off = words.buffers(texts)
    x, valid, doc = language.segments(buf, off)
    assert valid.sum() == len(buf) and np.bincount(doc, valid.sum(axis=0), 6).tolist() == np.diff(off).tolist()
    assert sorted(x[valid].tolist()) == sorted(buf.tolist())


def test_language_against_a_plain_network():
    """Unit by unit, byte by byte, in plain Python."""
    rng = np.random.default_rng(4)
    net = language.Network.fresh(["a", "b", "c"], rng)
    sig = lambda v: 1 / (1 + math.exp(-v))
    n = language.HIDDEN

    def states(data, d):
        h, out = [0.0] * n, []
        for byte in data:
            a = net.inputs[d][byte]
            z = [sig(a[j] + sum(h[i] * net.gates[d][i][j] for i in range(n))) for j in range(n)]
            r = [sig(a[n + j] + sum(h[i] * net.gates[d][i][n + j] for i in range(n))) for j in range(n)]
            c = [math.tanh(a[2 * n + j] + sum(r[i] * h[i] * net.candidate[d][i][j] for i in range(n))) for j in range(n)]
            h = [h[j] + z[j] * (c[j] - h[j]) for j in range(n)]
            out.append(h)
        return out

    texts = ["hello wörld", "x" * 100 + " end", "", "é"]
    best, score = language.classify(net, pa.array(texts))
    for text, k, p in zip(texts, best, score, strict=True):
        data, total = text.encode(), [0.0] * 3
        for at in range(0, len(data), language.SPAN):
            part = data[at : at + language.SPAN]
            whole = part + bytes(language.SPAN - len(part))  # a short segment is filled up
            there, back = states(whole, 0), states(whole[::-1], 1)[::-1]
            for t in range(len(part)):
                e = [math.exp(net.bias[j] + sum(there[t][i] * net.out[0][i][j] + back[t][i] * net.out[1][i][j] for i in range(n))) for j in range(3)]
                total = [x + y / sum(e) for x, y in zip(total, e, strict=True)]
        if not data:
            assert k == -1
        else:
            assert k == total.index(max(total)) and abs(p - max(total) / len(data)) < 1e-3


def test_votes_against_a_plain_loop():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta!", "gamma 12", "Delta\n"]) for _ in range(rng.randint(1, 40))) for _ in range(90)]
    x = quality.features(pa.array(texts))
    v = quality.fit(x[:60], np.array([k % 2 for k in range(60)]))
    z = v.project(x)
    for k, got in enumerate(v.score(x)):
        sims = sorted(((float(sum(a * b for a, b in zip(z[k].tolist(), w.tolist(), strict=True))), y) for w, y in zip(v.vectors, v.labels, strict=True)), reverse=True)
        weights = [(max(s, 0) ** 4 + 1e-6, y) for s, y in sims[: quality.NEIGHBOURS]]
        assert abs(got - sum(w * y for w, y in weights) / sum(w for w, _ in weights)) < 0.02


def test_tables_needed():
    assert vectors.tables_needed(0.9, 10, 0.995) > vectors.tables_needed(0.9, 6, 0.995) >= 1


def test_quality_features_of_empty_and_odd_texts():
    x = quality.features(pa.array([None, "", "a", "line\nline\nline\n", "!!!"]))
    assert x.shape == (5, quality.GRAMS + quality.RATIOS) and np.isfinite(x).all()
    v = quality.fit(x, np.array([0, 0, 1, 1, 0]))
    s = v.score(x)
    assert ((s >= 0) & (s <= 1)).all()


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy, now, cheap, things.</div><!-- no -->
<div class="wrap"><div class="post"><h1>Head &amp; line</h1><p>First, long, paragraph of the &eacute;ssay, with text.<p>Second   one,<br>
broken.</p><ul><li>item a<li>item b</ul></div><div id="comments"><p>A comment, long, with, many, commas, really, many.</p></div></div>
<aside>side, side, side</aside><form><p>Sign up, please</p></form><footer>&copy; x</footer></body></html>"""


def test_html():
    assert html.main_text(PAGE) == "Head & line\n\nFirst, long, paragraph of the éssay, with text.\n\nSecond one, broken.\n\nitem a\n\nitem b"
    assert [html.main_text(x) for x in (None, "", "<p>", "plain &lt;text&gt;", "<script>only()")] == ["", "", "", "plain <text>", ""]
    assert html.main_text("<article><p>" + "<b>" * 5000 + "deep") == "deep"


@pytest.mark.parametrize("noise", ["page-footer", "post-comments", "entry-meta", "site-header", "cookie-notice", "content-sidebar", "share-bar", "comment"])
def test_html_noise_by_class(noise):
    text = "A paragraph, with commas, of some length, that belongs to the article itself."
    page = f'<body class="has-sidebar"><div class="layout with-sidebar"><article class="post"><h1>T</h1><p>{text}</p><div class="{noise}"><p>Words of, well, something else.</p></div></article><div class="{noise}"><p>{text}</p></div></div></body>'
    assert html.main_text(page) == f"T\n\n{text}"


LONG = "A paragraph, with commas, of some length, that belongs to the article itself, and says so."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<body><form id="aspnetForm"><input name="v"><div><h1>T</h1><p>{LONG}</p><p>Short end.</p><button>Go</button></div></form></body>', f"T\n\n{LONG}\n\nShort end."),
        (f"<body><article><h1>T</h1><p data-t=it's>One.</p><p>Two isn't.</p><p class='x'>{LONG}</p></article></body>", f"T\n\nOne.\n\nTwo isn't.\n\n{LONG}"),
        (f'<body><article><h1>T</h1><p class="x>One.</p><p>{LONG}</p><a href="u">link</a></article></body>', f"T\n\nOne.\n\n{LONG}\n\nlink"),
        (f"<body><article><p>{LONG} Then <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article></body>", f"{LONG} Then x=2 holds."),
        (f'<body><article><p>{LONG}</p><div class="read-more"><p>The folded rest.</p></div><div class="read-more"><a href="/a">Read more</a></div></article></body>', f"{LONG}\n\nThe folded rest."),
        (f'<body><div class="wrap"><div class="lead"><p>What it says.</p></div><div class="body"><p>{LONG}</p><p>{LONG}</p></div><div class="legal"><p>All rights.</p></div></div></body>', f"What it says.\n\n{LONG}\n\n{LONG}"),
        (f"<body><section><p>{LONG}</p><p>{LONG}</p></section><section><p>It ends here.</p></section></body>", f"{LONG}\n\n{LONG}\n\nIt ends here."),
        (f'<body><article><p title="a <b>bold</b> claim">{LONG}</p></article></body>', LONG),
        ("<p =odd>Text &lt;3 &amp; more.<!-->Seen.<!-- not --!>Again.", "Text <3 & more.Seen.Again."),
    ],
)
def test_html_keeps_the_article(page, text):
    assert html.main_text(page) == text


def test_html_costs_follow_length():
    """Forgotten and unmatched tags, and a page of several megabytes."""
    began = time.process_time()
    for page in ("<article><p>" + "<b>" * 60000 + "deep", "<article><p>deep" + "</i>" * 60000, "<article>" + "<b><i>" * 20000 + "<p>deep" + "</u><li>" * 20000, "<article><p a='" + "<p b='" * 40000 + ">deep"):
        assert "deep" in html.main_text(page)
    parts = [f"{LONG} {k}" for k in range(43000)]
    page = "<html><body><article>" + "".join(f"<p>{t}</p>" for t in parts) + "</article></body></html>"
    assert len(page) > 4 << 20 and html.main_text(page) == "\n\n".join(parts)
    assert time.process_time() - began < 90


class Sink(io.BytesIO):
    def close(self):
        pass


def archive(n):
    sink = Sink()
    w = warc.ArchiveWriter(sink)
    for k in range(n):
        body = f"<p>page {k}</p>".encode() * 30
        w.add(warc.record(k, f"http://x/é {k}\n", body, len(body), hashlib.sha1(body).hexdigest(), 7, k % 5 == 4))
    w.close()
    return sink.getvalue()


@pytest.mark.parametrize("n", [0, 1, 3, 400])
def test_archive_round_trip(n):
    data = archive(n)
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    pages = [warc.page_of(*r) for r in warc.read_archive(data)]
    assert [p[0] for p in pages] == list(range(n))
    assert all((p[2] == "revisit") == (k % 5 == 4) and p[3] == (7 if k % 5 == 4 else None) for k, p in enumerate(pages))
    assert all(p[6] is None or hashlib.sha1(p[6]).hexdigest() == p[5] for p in pages)


def test_bad_archives():
    data = archive(3)
    for bad in (data[:-5], data[:20], data[:200] + b"\x00" * 8 + data[208:], data + b"junk"):
        with pytest.raises(ValueError):
            [warc.page_of(*r) for r in warc.read_archive(bad)]
    with pytest.raises(warc.BadArchive):
        warc.parse_record(b"WARC/1.1\r\nWARC-Type: x\r\n\r\nbody\r\n\r\n")
    good = warc.record(1, "u", b"abc", 3, hashlib.sha1(b"abc").hexdigest(), None, False)
    with pytest.raises(warc.BadArchive):
        warc.page_of(*warc.parse_record(good.replace(b"abc", b"abd")))
