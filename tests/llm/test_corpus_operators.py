"""The corpus operators against brute force, and their defined cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.llm import decontaminate, html_extract, language_model, near_dup, packing, quality, suffix_dedup, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use inside.
CLASH = ("k1", "k2", "h", "g", "id", "n", "comp", "host", "spans", "items", "score", "chunk", "rank", "start", "length", "n_words", "held_out", "rid", "url_", "label")


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", None if k % 5 == 4 else f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


def corpus(seed=1, n=40):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(300)]

    def words(k):
        return " ".join(r.choice(vocab) for _ in range(k))

    passage = words(60)
    out = [None, "", " \n\t ", "one", "Two words", "a" * 900, "ab" * 500, (words(5) + "\n") * 40, words(6000)]
    for _ in range(n):
        t = words(r.randint(1, 200)) + "\n" + words(12)
        out.append(t + (" " + passage + " " + words(20) if r.random() < 0.3 else ""))
    base = words(150)
    for _ in range(30):  # near copies
        w = base.split()
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append(" ".join(w))
    return [*out, out[12], out[12], out[15].upper()]


def as_bytes(t):
    return (t or "").encode()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# ---- 1

@pytest.mark.parametrize("limit", [4096, 2])
def test_repeats_equal_brute_force(spark, limit):
    texts = corpus(3)
    got = by_id(suffix_dedup.remove_repeats(frame(spark, texts), group_segments=limit, batch_segments=limit, keep=("doc_id", "text")))
    seen = collections.Counter(b[i : i + 200] for b in map(as_bytes, texts) for i in range(len(b) - 199))
    some = 0
    for i, b in enumerate(map(as_bytes, texts)):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i
        assert r.kept_text == kept.decode("utf-8", "ignore")
        some += r.n_removed > 0
    assert some > 10


def test_repeats_across_buffer_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 1000)
    r = random.Random(5)
    t = "".join(r.choice("abcd ") for _ in range(5000))
    raw = t.encode()
    rows = [(r_, o, n) for rows, _ in suffix_dedup._pieces(_batch([t, t[700:1500]]), 200) for r_, o, n in rows]
    assert sum(max(0, n - 199) for r_, _, n in rows if r_ == 0) == len(raw) - 199  # each window in one piece
    assert all(n <= 1000 for _, _, n in rows)


def _batch(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])


# ---- 2

def test_quality_counts_and_removed_lines(spark):
    texts = [*corpus(4), *(f"shared boilerplate line of this host\n{i} x" for i in range(30)), *(f"shared boilerplate line of this host\n{' '.join(f'w{i}q{k}' for k in range(30))}" for i in range(30))]
    got = by_id(quality.quality_rules(frame(spark, texts)))
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        win = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {p for k in range(len(w) - 4) if win[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = got[i]
        want = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w))
        assert not (r.kept and r.base_failed)
    assert not any(got[i].kept for i in range(len(texts) - 60, len(texts) - 30))  # depleted
    assert all(got[i].kept and got[i].n_line_words_removed for i in range(len(texts) - 30, len(texts)) if i % 5 != 4)


# ---- 3

def test_language_model_base_and_normalisation(spark):
    texts = corpus(6)
    got = by_id(language_model.score_texts(frame(spark, texts), updates=4, cached=50))
    toks = {i: [*as_bytes(t).lower().split(), b""] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c = collections.Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    assert sum(got[i].score for i in toks if not held[i]) > sum(got[i].base_score for i in toks if not held[i])
    w = language_model.Weights(np.random.default_rng(0).normal(size=language_model.Weights().flat.size))
    assert np.allclose(np.exp(w.log_p(np.arange(0, language_model.CONTEXTS, 97))).sum(1), 1)


def test_language_model_gradient():
    r = np.random.default_rng(1)
    w = language_model.Weights(r.normal(0, 0.1, language_model.Weights().flat.size))
    ctx, counts = np.array([3, 77, 40_000]), r.integers(0, 5, (3, language_model.CLASSES)).astype(float)
    g, _ = w.gradient(ctx, counts)
    for at in np.argsort(-np.abs(g.flat))[:5]:
        old, e = w.flat[at], 1e-5
        w.flat[at] = old + e
        up = w.gradient(ctx, counts)[1]
        w.flat[at] = old - e
        down = w.gradient(ctx, counts)[1]
        w.flat[at] = old
        assert abs((up - down) / (2 * e) - g.flat[at]) < 1e-3


# ---- 4

@pytest.mark.parametrize("block", [8 << 20, 300])
def test_decontamination_equals_brute_force(spark, block):
    texts = corpus(7)
    r = random.Random(8)
    items = [None, "", "é", "one", "TWO words", "zzzz unseen"]
    items += [" ".join(re.sub("[^a-zé ]", " ", (t or "").lower()).split()[k : k + r.randint(3, 30)]) for t in texts[9:30] for k in (0, 15)]
    bench = spark.createDataFrame([(k % 30, t, "x") for k, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = by_id(decontaminate.decontaminate(frame(spark, texts), bench, block_bytes=block))
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    windows = collections.defaultdict(set)
    for k, t in enumerate(items):
        w = word.findall((t or "").translate(lower))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(k % 30))
    some = 0
    for i, t in enumerate(texts):
        w = word.findall((t or "").translate(lower))
        hit, own = set(), set()
        for m in range(1, 11):
            for k in range(len(w) - m + 1):
                if found := windows.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    own |= found
        x = got[i]
        assert (x.n_words, x.n_hit, x.n_items, x.contaminated) == (len(w), len(hit), len(own), bool(hit)), i
        assert x.items_sha256 == hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        some += bool(hit)
    assert some > 10


# ---- 5

def test_url_rules_and_model(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.ORG/es/1?x#y", "http://example.org/en/15", "http://b.example.org/en/2", "http://org/x", "http://foo.com/fr/3",
            "https://foo.com/de/", "http://foo.org", "x://y://z/q", "http://cheap-pills.example.com/en/7", "http://www.garden.example.com/en/7", "http://h#/fr/"]
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    want = {0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("a.example.org", "/es/1", "example.org/es/"), 4: ("example.org", "/en/15", "example.org/en/1"),
            5: ("b.example.org", "/en/2", "org/"), 6: ("org", "/x", "org/"), 7: ("foo.com", "/fr/3", "com/fr/"), 8: ("foo.com", "/de/", "com/de/"), 9: ("foo.org", "", None),
            10: ("y:", "//z/q", None), 13: ("h", "", None)}
    for k, w in want.items():
        assert (got[k].host, got[k].path, got[k].rule) == w
    assert [got[k].verdict for k in (3, 4, 5, 7, 8, 11, 12)] == ["block", "block", "allow", "allow", "block", "block", "allow"]
    assert url_filter.filter_urls(df.limit(0)).count() == 0


# ---- 7

def test_toxicity_learns_subwords_and_keeps_clean_texts(spark):
    r = random.Random(2)
    plain = ["".join(r.choice("aeilmnorst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for k in range(300):
        w = [r.choice(plain) for _ in range(r.randint(20, 150))]
        toxic = k % 4 == 0
        for _ in range(3 if toxic else 0):
            w[r.randrange(len(w))] = "zugg" + r.choice("aeiou") + r.choice("xyz") + "k"
        texts.append(" ".join(w))
        labels.append((k, 1, int(toxic)))
    texts += [None, "", "zuggaxxk " * 3 + texts[1]]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = by_id(toxicity.toxicity(frame(spark, texts), lab))
    held = [k for k, _, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(300))
    assert sum(got[k].predicted == labels[k][2] for k in held) >= 0.95 * len(held)
    assert got[302].predicted == 1 and got[300].predicted == 0 and 0 <= got[301].score <= 1
    assert all(x.score == 0 for x in toxicity.toxicity(frame(spark, texts[:5]), lab.limit(0)).collect())


# ---- 8

def test_html_blocks():
    page = "<title>no</title><body><nav><li>a<li>b</nav><!-- c --><article><h1>T &amp; x</h1><p><b>one <i>two</i><br>three<p>four</p>tail<script>if(a<b){}</script></article><footer>f"
    assert [(t, p[-1]) for p, t, _ in html_extract.blocks_of(page)] == [("a", "li"), ("b", "li"), ("T & x", "h1"), ("one two three", "p"), ("four", "p"), ("tail", "article"), ("f", "footer")]
    assert html_extract.blocks_of("<!-- never closed <p>x") == [] and html_extract.blocks_of("a < b")[0][1] == "a < b"


def test_html_skips_end_with_their_element():
    def found(page):
        return [t for _, t, _ in html_extract.blocks_of(page)]

    for tag in ("svg-icon", "select-box", "title-bar", "style-guide", "script-list", "template-x", "iframe-x", "textarea-x", "noscript-x"):
        assert found(f'<{tag} name="x"></{tag}><article><p>one two</p></article>') == ["one two"]
    for svg in ('<svg width="1"/>', "<svg/>", '<svg title="a > b" />', "<svg><title>t</title><path/></svg>", "<SVG\n>x</svg\n>"):
        assert found(f"<p>one {svg} two</p><p>three</p>") == ["one two", "three"]
    for tag in ("script", "style", "template", "iframe", "select", "textarea"):
        assert found(f'<{tag} id="x">no</{tag}-x>no</{tag} x><p>yes</p>') == ["yes"]
    assert found("<title>no</title><p>yes</p>") == ["yes"]
    assert [(t, p) for p, t, _ in html_extract.blocks_of("<article><p>a<noscript>b</noscript>c<noscript> <img src=x> </noscript>d</p></article>")] == [
        ("a", ("article", "p")), ("b", ("article", "p", "noscript")), ("c d", ("article", "p"))]
    assert found("<noscript><p>b</p></noscript><p>c</p>") == ["b", "c"]


def test_html_labeller_gradient_and_held_out_accuracy(spark):
    model = html_extract.train(pages=600)
    r, ok, n = np.random.default_rng(123), 0, 0
    for _ in range(100):
        page, main = html_extract.training_page(r)
        b = html_extract.blocks_of(page)
        label = model.logits(html_extract.Pages([b])) > 0
        ok += sum(bool(k) == (t in main) for k, (_, t, _) in zip(label, b, strict=True))
        n += len(b)
    assert ok > 0.97 * n
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "v", "<p></p>"), (3, "v", "<article><p>Some words of a text, here.</p><p>More of it is here.</p></article>")], "page_id long, url string, html string")
    got = html_extract.extract(df.withColumn("text", F.lit(7)), model).collect()
    assert sorted((x.page_id, x.n_chars) for x in got)[:3] == [(1, 0), (2, 0), (3, 0)] and len(got) == 4
    assert max(got, key=lambda x: x.n_chars).text == "Some words of a text, here.\n\nMore of it is here."


# ---- 9

def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*corpus(9), "x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b <|endoftext|", "<|startoftext|> \n<|endoftext|>\n\n c", "日本語 \u00a0 \U0001f600 it's  9,000\n\n\t"]
    rows = packing.pack(frame(spark, texts)).collect()
    bins = collections.defaultdict(list)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, s, n) for k, (s, n) in enumerate(packing.cut(len(ids)))]
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            bins[r.sequence_id].append((r.offset, r.length))
    total = 0
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
        total += at
    assert len(bins) <= -(-total // 2048) + 1


def test_packing_plan_is_exact_and_tight():
    r = np.random.default_rng(4)
    for _ in range(20):
        cap = int(r.integers(5, 60))
        count = np.zeros(cap + 1, np.int64)
        count[1:] = r.integers(0, 6, cap)
        used, fill = np.zeros(cap + 1, np.int64), collections.defaultdict(list)
        for n, rank, pieces, first, per, offset in packing.plan(count, cap):
            assert rank == used[n]
            used[n] += pieces
            for i in range(pieces):
                fill[first + i // per].append((offset + i % per * n, n))
        assert (used == count).all()
        for b in fill.values():
            at = 0
            for o, n in sorted(b):
                assert o == at
                at += n
            assert at <= cap
            assert sum(n > cap // 3 for _, n in b) <= 2
        assert len(fill) <= 1.25 * (int((count * np.arange(cap + 1)).sum()) / cap) + 2


# ---- 10

@pytest.mark.parametrize("small", [24, 3])
def test_near_duplicates_equal_brute_force(spark, small):
    texts = corpus(11)
    got = by_id(near_dup.near_duplicates(frame(spark, texts), small=small))
    sets = []
    for t in texts:
        w = [x.decode() for x in as_bytes(t).lower().split()]
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i), i
    assert sum(not r.kept for r in got.values()) > 10


def test_estimate_corrects_collisions():
    r = np.random.default_rng(0)
    a, b = near_dup.functions(512, 1)
    common, x, y = r.integers(0, 2**63, 800, np.uint64), r.integers(0, 2**63, 100, np.uint64), r.integers(0, 2**63, 100, np.uint64)
    sig = [np.frombuffer(near_dup.pack_bits(near_dup.minima(np.concatenate((common, o)), a, b), 2), np.uint8)[None] for o in (x, y)]
    assert abs(near_dup.estimate(sig[0], sig[1], 512, 2)[0] - 0.8) < 0.08


# ---- all operators on documents: empty tables, repeated rows, null ids

OPERATORS = {
    1: lambda s, d: suffix_dedup.remove_repeats(d), 2: lambda s, d: quality.quality_rules(d), 3: lambda s, d: language_model.score_texts(d, updates=1),
    4: lambda s, d: decontaminate.decontaminate(d, s.createDataFrame([(1, "two words")], "item_id long, text string")),
    7: lambda s, d: toxicity.toxicity(d, s.createDataFrame([(1, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")),
    9: lambda s, d: packing.pack(d), 10: lambda s, d: near_dup.near_duplicates(d),
}


@pytest.mark.parametrize("n", sorted(OPERATORS))
def test_empty_tables_repeated_rows_and_null_ids(spark, n):
    run = OPERATORS[n]
    assert run(spark, frame(spark, ["a"]).limit(0)).count() == 0
    long = " ".join(f"word{k}" for k in range(80))
    ids, texts = [1, 1, 1, None, None, 2, 2, 3], [long, long, None, long, "", "two words", "other text", "two words"]
    rows = run(spark, frame(spark, texts, ids)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))
