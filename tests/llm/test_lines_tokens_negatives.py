"""Line removal, token alignment and hard negatives against brute force, and their defined cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.llm import hard_negatives, line_dedup, token_alignment
from txrisk.llm.queries import QUERIES

CLASH = ("pos", "line", "key", "h1", "h2", "last", "gone", "pairs", "rid", "n_a", "unit", "block", "dim", "norm", "score", "rank", "slot", "marks", "vec", "id")


def clashing(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3)


# --- lines ---------------------------------------------------------------------------------------------------------

WHITE = " \t\n\r\x0b\x0c"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(WHITE).translate(UPPER)
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    last = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in held.items() if len(v) >= min_docs and len(k) >= min_chars}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(key(x), i) == i]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def line_rows():
    r = random.Random(3)
    shared = ["L" + "".join(r.choice("abcé 　") for _ in range(r.choice([37, 38, 39, 40, 80]))) + "z" for _ in range(12)]
    rows = [(None, None), (None, shared[0]), (None, shared[0]), (7, ""), (8, "\n\n"), (9, " " * 50), (10, "É" * 40)]
    for i in range(20, 60):
        own = [r.choice(["", "\t", " "]) + (s.upper() if r.random() < 0.2 else s) + r.choice(["", "\r", "  "]) for s in shared if r.random() < 0.3]
        own += [f"only here {i} " + "x" * 40, "", own[0] if own else "y"]
        r.shuffle(own)
        rows.append((i, "\n".join(own)))
    rows += [rows[-1], rows[-1], (59, shared[3] + "\n" + shared[4]), (11, "\n".join(shared * 20_000))]  # repeated rows, one id with other texts, over 1 MB
    return rows


@pytest.mark.parametrize("heavy", [1, 2000])
def test_lines_equal_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)  # with 1 every line takes the shuffled join
    df = clashing(spark.createDataFrame(line_rows(), "doc_id long, text string"))
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df).collect())
    assert got == brute_lines(line_rows())
    assert any(r[2] for r in got) and any(not r[2] for r in got)


def test_lines_keep_columns_empty_table_and_text_ids(spark):
    df = spark.createDataFrame([("a", "x", "en"), (None, None, None)], "doc_id string, text string, lang string")
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    out = line_dedup.dedup_lines(df, keep=["text", "lang"]).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(None, None, None, "", 1, 0), ("a", "x", "en", "x", 1, 0)]


def test_lines_plan_runs_no_python(spark):
    plan = QUERIES["op11_line_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- tokens --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tools():
    import public_tokenizers as P
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def brute_alignment(tools, texts):
    """Two pointers over each text, with the file's own library."""
    ta, tb = tools
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    rows, links = [], []
    for t in texts:
        a, b, found = [], [], []
        if t:
            a, b = ta.encode(" " + t, add_special_tokens=False).ids, tb.encode(t)
            ab = [bytes(to_byte[c] for c in ta.id_to_token(i)) for i in a]
            bb = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(ab) == b"".join(bb) == (" " + t).encode():
                a, b = [], []
        i = j = at_a = at_b = 0
        one, two = [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and not (at_a == at_b and one):
                at_a, i = at_a + len(ab[i]), i + 1
                one.append(a[i - 1])
            else:
                at_b, j = at_b + len(bb[j]), j + 1
                two.append(b[j - 1])
            if at_a == at_b:
                found.append((one, two))
                one, two = [], []
        links.append(collections.Counter((x, y) for p, q in found for x in p for y in q))
        rows.append((len(a), len(b), len(found), ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in found)))
    docs = collections.Counter(p for c in links for p in c)
    most = collections.defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    sums = [(sum(c.values()), sum(w for p, w in c.items() if docs[p] == most[p[0]]), sum(w * docs[p] for p, w in c.items())) for c in links]
    return [(*r[:3], *s, r[3]) for r, s in zip(rows, sums, strict=True)]


def token_texts():
    r = random.Random(5)
    marks = ["<|endoftext|>", "<s> </s> <unk>", "a▁b", "<0x41>", "naïve 東京タワー 😀👩‍👩‍👧", "\x00\x01 \r\n\t", "1234567890" * 9, "a" * 3000, " " * 500, "zwölf  Boxkämpfer\n\n\njagen"]
    words = ["the", "them", "antidisestablishment", "foo_bar", "x==y", "don't", "日本", "é", "2024-01-01", "...", "  ", "\n"]
    out = [None, "", " ", "x", *marks, *[" ".join(r.choice(words) for _ in range(r.randint(1, 200))) for _ in range(30)]]
    return [*out, out[-1], out[-1], " ".join(r.choice(words) for _ in range(200_000))]  # repeated rows, over 1 MB


@pytest.mark.parametrize(("heavy", "wide"), [(1 << 18, 64), (1, 2)])
def test_alignment_equals_brute_force(spark, tools, monkeypatch, heavy, wide):
    monkeypatch.setattr(token_alignment, "HEAVY", heavy)  # with 1 nearly all pairs take the join
    monkeypatch.setattr(token_alignment, "WIDE", wide)
    texts = token_texts() if heavy > 1 else token_texts()[:-1]
    rows = [(None if k == 2 else k - k % 2, t) for k, t in enumerate(texts)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    want = sorted((str(i), *w) for (i, _), w in zip(rows, brute_alignment(tools, texts), strict=True))
    got = token_alignment.align(df).collect()
    assert sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got) == want
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got)
    assert sum(r.n_a == 0 for r in got) >= 3 and max(r.n_links for r in got) > 0


def test_alignment_of_an_empty_table(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pointer_jumping_on_a_long_chain():
    # ends never coincide before the last byte: one component of 2,000 tokens
    a, b = np.append(np.arange(1, 2000, 2), 2000), np.arange(2, 2001, 2)
    ga, gb = token_alignment.groups(a, b)
    assert ga.max() == gb.max() == 0
    ga, gb = token_alignment.groups(np.array([1, 3, 6]), np.array([1, 2, 6]))
    assert ga.tolist() == [0, 1, 1] and gb.tolist() == [0, 1, 1]


def test_wide_groups_are_counted_by_distinct_ids():
    n = 500
    a, b, g = np.arange(n) % 3, np.arange(n) % 2, np.zeros(n, np.int64)
    keys, counts = token_alignment._links(a, b, g, g, g, np.array([n]), np.array([n]), 10)
    assert keys.tolist() == [0, 1, 10, 11, 20, 21] and counts.sum() == n * n


# --- hard negatives ------------------------------------------------------------------------------------------------


def brute_negatives(rows):
    seen = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        seen.add((i, (label + 1) % 10 if i % 7 == 0 else label, q))
    out = []
    for i, label, q in seen:
        if i % 100:
            continue
        score = lambda w: sum(x * y for x, y in zip(q, w, strict=True))  # noqa: B023, E731
        others = sorted((-score(w), j, m) for j, m, w in seen if j != i and len(w) == len(q))
        for s, j, _ in [o for o in others if o[2] == label][:5]:
            fit = [o for o in others if o[2] != label and 30 * -s <= 100 * -o[0] <= 90 * -s][:10]
            out += [(i, j, r, o[1], -s, -o[0]) for r, o in enumerate(fit, 1)]
    return sorted(out)


def vectors(n, dim, kind, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    if kind == "clustered":  # few directions, lengths over several octaves: most tiles are cut or skipped
        x = r.normal(size=(8, dim))[r.integers(0, 8, n)] + 0.05 * x
        x *= np.exp(r.normal(size=(n, 1)))
    elif kind == "ties":
        x = np.round(x) / 4
    rows = [(int(i), [float(np.float32(c)) for c in v], int(r.integers(0, 4))) for i, v in enumerate(x)]
    return rows


@pytest.mark.parametrize("kind", ["plain", "clustered", "ties"])
def test_negatives_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(hard_negatives, "TILE", 32)
    monkeypatch.setattr(hard_negatives, "BLOCK", 2)
    rows = vectors(700, 6, kind)
    copy = rows[3][1]
    rows += [(1000 + i, copy, 1) for i in range(80)]  # one vector under many ids
    rows += [rows[100], rows[100], (100, rows[5][1], 2), (200, rows[5][1], None)]  # repeated rows, an id with other content
    rows += [(None, copy, 1), (2001, None, 1), (2002, [*copy[:-1], None], 1), (2003, [*copy[:-1], math.inf], 1), (2004, [*copy[:-1], math.nan], 1)]
    rows += [(2100, [], 1), (2101, [], 1), (2102, [], 2), (2200, [0.0] * 6, 1), (2201, [0.5, -0.5], 2), (2300, [0.3, 0.1], 3)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = sorted(tuple(r) for r in hard_negatives.mine(df).collect())
    assert got == brute_negatives(rows)
    assert len(got) > 50


def test_negatives_of_an_empty_table_and_of_huge_vectors(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0], 1), (1, [2.0, 1.0], 1), (100, [2.0, 1.0], 1), (2, [1.5, 1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(df.limit(0)).count() == 0
    got = [tuple(r) for r in hard_negatives.mine(df).collect()]  # the first row takes no part
    assert got == [(100, 1, 1, 2, 512 * 512 + 256 * 256, 512 * 384 + 256 * 256)]


def test_feasible_ranges_keep_every_row_over_the_limit():
    r = np.random.default_rng(2)
    x = np.floor(256 * r.normal(size=(400, 8)) * np.exp(r.normal(size=(400, 1)))).astype(np.int64)
    x[7] = 0
    q = np.floor(256 * r.normal(size=8)).astype(np.int64)
    length = hard_negatives._lengths(x)
    row = {"n": 400, "dim": 8, "vectors": hard_negatives._pack(x)[0], "lists": hard_negatives._pack(np.argsort(hard_negatives._on_sphere(x, length), axis=0).T)[0]}
    tile = hard_negatives._Tile(row | {c: hard_negatives._pack(np.arange(400))[0] for c in ("ids", "keys", "labels")})
    size = math.sqrt(float(q @ q))
    unit, score = q / size, x @ q
    cut = 0
    for limit in [-10**7, -1000, 0, 1, *np.sort(score)[-40:].tolist(), 10**9]:
        rows = tile.feasible(unit, size, np.argsort(-np.abs(unit))[:4], int(limit))
        if rows is not None:
            cut += len(rows) < 400
            assert set(np.flatnonzero(score >= limit)) <= set(rows.tolist())
    assert cut > 10
