"""The pipeline's stages on a small table: each decision takes effect and clean documents stay."""

from __future__ import annotations

import collections
import re

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        if name != P.STAGES[-1][0]:
            assert tuple(docs.columns) == P.COLUMNS
            docs = P.staged(docs, name)
        seen[name] = docs.collect()
    kept = {name: {r.doc_id: r for r in rows} for name, rows in seen.items()}
    words = lambda t: (t or "").lower().split()
    tox, near, cut, clean, packed = (kept[n] for n, _ in P.STAGES)
    assert set(packed) == set(clean) <= set(cut) <= set(near) <= set(tox) <= set(before)
    # near-duplicates: no two kept documents are alike, and whatever went is like one that was there
    sets = {i: {tuple(words(r.text)[k : k + 5]) for k in range(max(1, len(words(r.text)) - 4))} for i, r in tox.items()}
    alike = lambda a, b: bool(words(tox[a].text)) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ids = sorted(near)
    assert not any(alike(a, b) for k, a in enumerate(ids) for b in ids[:k])
    assert all(any(alike(a, b) for b in tox if b != a) for a in set(tox) - set(near))
    # repeats: texts are their input or a part of it, without any 200-byte string found twice in the input
    strings = collections.Counter(b[i : i + 200] for b in ((r.text or "").encode() for r in near.values()) for i in range(len(b) - 199))
    for i, r in cut.items():
        old = (near[i].text or "").encode()
        if not any(strings[old[k : k + 200]] > 1 for k in range(len(old) - 199)):
            assert r.text == near[i].text
        else:
            assert len(r.text) < len(near[i].text) and r.n_chars == len(r.text)
    # benchmark windows
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for t in items:
        w = word.findall((t or "").lower())
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    for i, r in cut.items():
        w = word.findall((r.text or "").lower())
        hit = any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
        assert (i in clean) == (not hit)


def test_nulls_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (1, "a b c", "en", "s", 5, "x"), (None, "a b c", "en", "s", 5, "x"), (2, "", "en", "s", 0, "x")], "doc_id long, text string, lang string, source string, n_chars long, id string")
    for rows in (docs, docs.limit(0)):
        out = rows
        for _, stage in P.STAGES:
            out = stage(spark, out, SF)
        assert (out.count() > 0) == (rows is docs)


def test_texts_that_share_an_id_or_have_none_stay(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    copy = lambda k: texts[k] + " end"
    rows = [(1, texts["a"]), (1, texts["b"]), (2, copy("a")), (3, copy("b")), (4, texts["c"]), (0, copy("c")), (4, texts["d"]), (5, texts["e"]), (5, copy("e")), (5, texts["e"]),
            (None, texts["f"]), (None, "g h"), (6, ""), (6, None), (6, " \n"), (6, "\u00a0")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    one = {(i, t) for i, t in rows if i != 5} - {(2, copy("a")), (3, copy("b")), (4, texts["c"])}
    got = [(r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, SF).collect()]
    assert {r for r in got if r[0] != 5} == one and len(got) == len(one) + 1
    assert [r for r in got if r[0] == 5][0][1] in (texts["e"], copy("e"))
    comp = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in P.near_dup.near_duplicates(docs).collect()}
    assert {(2, 58, 1, False), (3, 58, 1, False), (4, 57, 0, False), (4, 57, 4, True)} <= comp
