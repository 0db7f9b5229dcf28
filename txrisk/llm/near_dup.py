"""Near-duplicate documents by b-bit MinHash.

Texts become sets of word shingles.  Documents with equal sets are one class, named by the hash of the set
(a doc_id may stand for several texts) and shown by its first row, the smallest (doc_id, md5 of the text).
A component's id is the smallest doc_id of its classes.  The minima of ``bands * rows`` hash functions give the band keys of a class; only the lowest
``bits`` bits of each minimum are kept, packed into bytes.  Classes that meet in a band bucket become
candidates, the matching low bits give the collision-corrected similarity (m - 2^-b) / (1 - 2^-b), and
candidates far below the threshold are set aside; the rest are confirmed on the full shingle sets.

Large buckets never emit all their pairs.  A bucket of at most ``small`` classes is compared pairwise.
In a larger one every class is compared with a few hubs (the smallest ids of hash slots), which joins most
of it.  Classes that are still outside the bucket's largest component are then compared with the whole
bucket, short list against short list on an index of shingles; a task sends only as many links as it takes
to join the two lists as all their links would.  Classes already in one component need no comparison, so
no link between components is lost.

With the default 32 bands of 4 rows a pair at similarity 0.8 escapes all buckets with probability
(1 - 0.8^4)^32, about 5e-8; the set-aside margin of 0.25 on 128 minima is 7 standard deviations.

Defined cases: without words or text the set is empty, the document is its own component and kept;
fewer words than a shingle make one shingle of the whole sequence; every input row is returned, and rows
with equal doc_ids are linked by their own texts only; a null doc_id is returned as its own row without links and kept;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import lean, multiply_mod_hash, staged, texts

SHINGLE = 4
KNOWN_WORDS = 100_000  # words whose hashes a task remembers
CHUNK_ITEMS = 1 << 18  # shingles of a list of sets, one set at least
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def shingle_hashes(text: bytes, k: int, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles (A-Z lower-cased, white space ASCII)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    known = {} if known is None else known
    hashes = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    w = np.array(hashes, np.uint64)
    n = len(w) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = multiply_mod_hash(out + w[j : j + n] * np.uint64(_ODD[j % len(_ODD)]))
    return np.unique(out)


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function (a * x + b, upper 32 bits) over the set."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for s in range(0, len(hashes), 512):  # small blocks stay in the cache
        v = (hashes[s : s + 512, None] * a[None, :] + b[None, :]) >> np.uint64(32)
        np.minimum(out, v.min(0), out=out)
    return out


def functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def pack_bits(mins: np.ndarray, bits: int) -> bytes:
    """The lowest bits of each minimum, packed."""
    low = ((mins[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(low.ravel()).tobytes()


def estimate(a: np.ndarray, b: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Collision-corrected similarity of packed signatures (rows x bytes)."""
    differs = np.unpackbits(a ^ b, axis=1)[:, : n * bits].reshape(len(a), n, bits).any(2)
    chance = 0.5**bits
    return ((~differs).mean(1) - chance) / (1 - chance)


def _signatures(shingle: int, bands: int, rows: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = functions(bands * rows, seed)
        known: dict[bytes, int] = {}
        for batch in batches:
            n, key, sig, band = [], [], [], []
            for t in texts(batch):
                h = shingle_hashes(t, shingle, known)
                n.append(len(h))
                if len(known) > KNOWN_WORDS:
                    known.clear()
                if not len(h):
                    key.append(None)
                    sig.append(None)
                    band.append(None)
                    continue
                m = minima(h, a, b)
                key.append(xxhash.xxh3_128_digest(h.tobytes()))
                sig.append(pack_bits(m, bits))
                parts = m.astype("<u4").reshape(bands, rows)
                band.append([xxhash.xxh3_64_intdigest(parts[i].tobytes(), seed=i) - (1 << 63) for i in range(bands)])
            cols = [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), pa.array(band, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "n_shingles", "set_key", "sig", "bands"])

    return lean(run)


def _sets(shingle: int):
    """The shingle sets of the rows that show a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            if len(known) > KNOWN_WORDS:
                known.clear()
            sets = [shingle_hashes(t, shingle, known).view(np.int64) for t in texts(batch)]
            if len(known) > 500_000:
                known.clear()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "items"])

    return lean(run)


def _likely(n: int, bits: int, least: float):
    """Keeps the pairs whose estimate is not far below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
            keep = pa.array(estimate(x, y, n, bits) >= least)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return lean(run)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, comp) for every id of the edges (a, b): comp is the smallest id reachable.

    Alternating large-star and small-star steps; each round is written to the shared folder.
    """
    both = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = _mark(both)
    for _ in range(max_rounds):
        # large star: every neighbour above u hangs on the smallest of u and its neighbours
        sym = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        both = staged(small.filter("u <> v").distinct(), "edges")
        before, mark = mark, _mark(both)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = both.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return stars.union(both.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def _counted(rows: DataFrame) -> DataFrame:
    """The rows (band, key, id, n) of buckets with two classes or more, with the bucket's size."""
    size = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return rows.join(size, ["band", "key"]).select("band", "key", "members", "id", "n")


def _chunks(rows: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """The classes (band, key, id) of each bucket with their sets, in lists of about ``size`` sets and CHUNK_ITEMS shingles."""
    n = rows.join(sets.select("id", F.size("items").alias("n")), "id").groupBy("band", "key")
    n = n.agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(size)), F.ceil(F.sum("n") / F.lit(CHUNK_ITEMS))).alias("chunks"))
    dealt = rows.join(n, ["band", "key"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks"))).join(sets, "id")
    return dealt.groupBy("band", "key", "chunk").agg(F.collect_list(F.struct("id", "items")).alias("own")).select("band", "key", "own")


def intersections(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of two lists of sets (their items one after another, and their sizes).

    The shingles that both lists hold become columns, some at a time, of two 0/1 tables; the sizes are their product.
    """
    out = np.zeros((len(nx), len(ny)), np.int64)
    both = np.intersect1d(x, y)
    sides = []
    for v, n in ((x, nx), (y, ny)):
        at = np.minimum(np.searchsorted(both, v), max(0, len(both) - 1))
        hit = np.flatnonzero(both[at] == v) if len(both) else at[:0]
        order = hit[np.argsort(at[hit], kind="stable")]
        sides.append((at[order], np.repeat(np.arange(len(n)), n)[order], len(n)))
    for c in range(0, len(both), 8192):
        tables = []
        for at, owner, n in sides:
            a, b = np.searchsorted(at, [c, c + 8192])
            t = np.zeros((n, min(8192, len(both) - c)), np.float32)
            t[owner[a:b], at[a:b] - c] = 1
            tables.append(t)
        out += (tables[0] @ tables[1].T).astype(np.int64)  # at most 8,192, which a float holds exactly
    return out


def _links(num: int, den: int):
    """Links that join the classes of two lists as all their links do."""

    def parts(rows: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        items = pc.struct_field(rows, "items")
        return pc.struct_field(rows, "id").to_pylist(), pc.list_value_length(items).to_numpy(zero_copy_only=False), pc.list_flatten(items).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.schema.field("xs").type.value_type.field("id").type
            for r in range(b.num_rows):
                ids, nx, items = parts(b.column("xs")[r].values)
                other, ny, values = parts(b.column("ys")[r].values)
                inter = intersections(items, nx, values, ny)
                root: dict = {}

                def find(v):
                    while root.setdefault(v, v) != v:
                        v = root[v]
                    return v

                out: list[tuple] = []
                for k, y in zip(*np.nonzero(inter * den >= (nx[:, None] + ny[None, :] - inter) * num), strict=True):
                    u, v = find(ids[k]), find(other[y])
                    if u != v:
                        root[u] = v
                        out.append((ids[k], other[y]))
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], kind), pa.array([v for _, v in out], kind)], ["a", "b"])

    return lean(run)


def text_key(text: str = "text") -> Column:
    """The md5 of a text, which tells the texts of one doc_id apart."""
    return F.unhex(F.md5(F.col(text).cast("string")))


def decisions(
    docs: DataFrame, shingle: int = SHINGLE, num: int = 80, den: int = 100, bands: int = 32, rows: int = 4, bits: int = 4, margin: float = 0.25, small: int = 24, hubs: int = 2, chunk: int = 512, seed: int = 11
) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept, shows for every row.

    ``kept`` says that the row has its component's id; ``shows`` that it is also the component's first text, so
    rows that show one component are equal in doc_id and text.  Links need den * |intersection| >= num * |union|.
    """
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"), text_key().alias("text_key"))
    id_type = dict(src.dtypes)["doc_id"]
    sig = staged(src.mapInArrow(_signatures(shingle, bands, rows, bits, seed), f"doc_id {id_type}, text_key binary, n_shingles long, set_key binary, sig binary, bands array<long>"), "signatures", batch_rows=512)
    # classes of equal sets: the signature of any member is the signature of all
    full = sig.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    cls = full.groupBy(F.col("set_key").alias("id")).agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.min("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    cls = staged(cls, "classes")
    live = staged(_counted(cls.select("id", "n", F.posexplode("bands").alias("band", "key"))), "buckets")
    reps = cls.select("id", "first.doc_id", "first.text_key").join(live.select("id").distinct(), "id", "left_semi")
    own = src.join(reps, ["doc_id", "text_key"]).select("id", "text").mapInArrow(_sets(shingle), "id binary, items array<long>")
    sets = staged(own.groupBy("id").agg(F.first("items").alias("items")), "sets")
    signs = cls.select("id", "sig")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """(a, b, inter, uni) for the pairs (a, b) that the signatures do not rule out."""
        a, b = (signs.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
        likely = pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_likely(bands * rows, bits, num / den - margin), "a binary, b binary")
        sa, sb = (sets.select(F.col("id").alias(c), F.col("items").alias(f"i{c}")) for c in "ab")
        both = staged(likely, "pairs").join(sa, "a").join(sb, "b")
        x = both.select("a", "b", F.size(F.array_intersect("ia", "ib")).cast("long").alias("inter"), (F.size("ia") + F.size("ib")).cast("long").alias("total"))
        return staged(x.select("a", "b", "inter", (F.col("total") - F.col("inter")).alias("uni")), "checked")

    link = F.col("inter") * den >= F.col("uni") * num
    comp: DataFrame | None = None

    if not live.isEmpty():
        few, many = live.filter(F.col("members") <= small), live.filter(F.col("members") > small)
        x, y = few.alias("x"), few.alias("y")
        same = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))
        fits = F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num  # sizes alone rule the others out
        pairs = x.join(y, same & fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        hub = many.groupBy("band", "key", F.pmod(F.xxhash64("id"), F.lit(hubs)).alias("slot")).agg(F.min("id").alias("h")).select("band", "key", "h")
        star = many.join(hub, ["band", "key"]).filter("id <> h").select(F.least("h", "id").alias("a"), F.greatest("h", "id").alias("b"))
        links = confirmed(pairs.union(star).distinct()).filter(link).select("a", "b")
        comp = staged(components(links), "components")
        if not many.isEmpty():
            # classes outside the largest component of their bucket, list against list with the whole bucket
            part = staged(many.select("band", "key", "id").join(comp, "id", "left").select("band", "key", "id", F.coalesce("comp", "id").alias("c")), "parts")
            most = part.groupBy("band", "key", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("band", "key").agg(F.max(F.struct("k", "c")).alias("m")).select("band", "key", F.col("m.c").alias("main"))
            outside = staged(part.join(most, ["band", "key"]).filter("c <> main").select("band", "key", "id"), "outside")
            if not outside.isEmpty():
                whole = part.select("band", "key", "id").join(outside.select("band", "key").distinct(), ["band", "key"], "left_semi")
                xs, ys = _chunks(outside, sets, chunk).withColumnRenamed("own", "xs"), _chunks(whole, sets, chunk).withColumnRenamed("own", "ys")
                found = xs.join(ys, ["band", "key"]).select("xs", "ys").mapInArrow(_links(num, den), "a binary, b binary")
                more = staged(found.distinct(), "links", batch_rows=8, spread=True)
                comp = staged(components(comp.select(F.col("id").alias("a"), F.col("comp").alias("b")).union(more)), "components")

    named = cls.select("id", F.col("first").alias("low"))
    if comp is not None:  # a component is shown by the first of its classes' first rows
        ends = comp.join(named, "id")
        lows = ends.join(ends.groupBy("comp").agg(F.min("low").alias("comp_low")), "comp").select("id", "comp_low")
        named = named.join(lows, "id", "left").select("id", F.coalesce("comp_low", "low").alias("low"))
    out = sig.select("doc_id", "text_key", "n_shingles", "set_key").join(named.withColumnRenamed("id", "set_key"), "set_key", "left")
    first = F.when(F.col("doc_id").isNotNull(), F.coalesce("low.doc_id", "doc_id"))
    kept = F.col("doc_id").eqNullSafe(first)
    shows = kept & (F.col("doc_id").isNull() | F.col("set_key").isNull() | (F.col("text_key") == F.col("low.text_key")))
    return out.select("doc_id", "text_key", "n_shingles", first.alias("component_id"), kept.alias("kept"), shows.alias("shows"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; ``options`` are those of ``decisions``."""
    return decisions(docs, shingle, **options).select("doc_id", "n_shingles", "component_id", "kept")


#: The same rows in SQL: all pairs of documents that share a shingle.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS k
    FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id),
g AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN g ON g.id = d.doc_id
"""
