"""Fill-in-the-middle, SimHash and lexical search against plain versions; odd rows and very long texts."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import fill_middle, fingerprints, lexical
from tidemark.llm.arrays import flat

WORD = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
EXTRA = ["record", "n", "form", "fim", "fp", "bag", "class", "m", "rank", "score", "item", "fingerprint", "component_id", "key", "h1"]
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " ", "\n", "one", "a\nb", "x<S>y\nz\n", "é\n\n日本\n", "The Same Text " * 40, "<P", "<S\n<M"]
    rows = [(i if i % 4 else None, t) for i, t in enumerate(texts * 2)] + [(7, texts[8])] * 5 + [(None, texts[8])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.withColumns({c: F.lit(i) for i, c in enumerate(EXTRA)}).repartition(3)


def random_texts(seed, n, alphabet, most):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(alphabet, rng.integers(0, most))) for _ in range(n)]


# --- fill in the middle ------------------------------------------------------------------


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(units), "plain", text, None, None
    if h[3] % 100 < 50:
        return len(units), "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return len(units), "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


def test_words_of_eight_bytes():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 4001).astype(np.uint8)
    data[rng.random(4001) < 0.3] = 10
    data[500:600] = 11
    marks = fill_middle.Marks(fill_middle.equal_bytes(fill_middle.as_words(data), 10))
    where = np.flatnonzero(data == 10)
    assert marks.select(np.arange(len(where))).tolist() == where.tolist()
    assert marks.rank(np.arange(4002)).tolist() == [int((data[:i] == 10).sum()) for i in range(4002)]
    points = fill_middle.Marks(fill_middle.first_bytes(fill_middle.as_words(data)))
    assert points.rank(np.array([4001])).tolist() == [int((data & 0xC0 != 0x80).sum())]


def test_fill_middle(spark, odd):
    texts = random_texts(3, 800, list("ab\n\né日<PSM>"), 40)
    texts += ["line of a long text\n" * 600_000, "日" * 3_000_000, "x"]  # beyond an Arrow batch
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for frame in (docs, odd):
        done = fill_middle.filled_middle(frame)
        done = done.withColumn("back", fill_middle.restored(F.col("fim"), F.col("form")))
        for r in done.collect():
            assert (r.n, r.form, r.fim, r.prefix_chars, r.middle_chars) == plain_fim(r.record.doc_id, r.record.text)
            assert r.back == (r.record.text or "")
    assert fill_middle.filled_middle(odd.limit(0)).count() == 0


def test_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc").alias("text"))
    forms = Counter(r.form for r in fill_middle.filled_middle(docs, rate=25, suffix_first=10).collect())
    assert 850 < forms["psm"] + forms["spm"] < 1150 and 60 < forms["spm"] < 150


# --- SimHash ----------------------------------------------------------------------------


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=4):
    names = list(range(len(prints)))

    def root(i):
        while names[i] != i:
            i = names[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                names[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def test_fingerprints_of_texts():
    texts = ["", " ", "A", "b c", "a B c d", " x  y z w v ", *random_texts(5, 400, list("ab cdéA\n  "), 120)]
    data, offsets = flat(pa.array(texts))
    assert fingerprints.fingerprints(data, offsets).tolist() == [plain_fingerprint(t) for t in texts]
    long = "some words, Repeated with a number 7 " * 90_000  # beyond a lot and a segment
    data, offsets = flat(pa.array(["x", long, None]))
    assert fingerprints.fingerprints(data, offsets).tolist() == [plain_fingerprint(t) for t in ("x", long, None)]


@pytest.mark.parametrize("crowd", [1, 3, 64])
def test_links_join_all_pairs(spark, crowd):
    """Clusters around centres: with few pairs, with midpoints alone, and with both."""
    rng = np.random.default_rng(6)
    prints = []
    for centre in rng.integers(0, 1 << 64, 12, np.uint64).tolist():
        for _ in range(25):
            for bit in rng.choice(64, rng.integers(0, 7), replace=False).tolist():
                centre ^= 1 << bit
            prints.append(centre)
    prints = sorted(set(prints) | {0, (1 << 64) - 1, 0b1111, 0b11111})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {(r.a, r.b) for r in fingerprints.links(nodes, crowd=crowd).collect()}
    at = {p: i for i, p in enumerate(signed)}
    assert all((prints[at[a]] ^ prints[at[b]]).bit_count() <= 4 for a, b in found)
    names = plain_components(prints)
    by_links = list(range(len(prints)))
    for _ in prints:
        for a, b in found:
            by_links[at[a]] = by_links[at[b]] = min(by_links[at[a]], by_links[at[b]])
    assert len(set(names)) == len(set(by_links)) > 4
    assert len(set(zip(names, by_links))) == len(set(names))
    if crowd == 64:
        pairs = {(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4}
        assert {tuple(sorted((at[a], at[b]), reverse=True)) for a, b in found} == pairs


def test_components_of_documents(spark, odd):
    rng = np.random.default_rng(8)
    base = [" ".join(rng.choice(["w%d" % i for i in range(300)], 120)) for _ in range(30)]
    texts = [t if i % 3 else t + f" end {i}" for i, t in enumerate(base * 4)] + ["", None, " "]
    docs = spark.createDataFrame([(900 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for frame in (docs, odd):
        rows = frame.select("doc_id", "text").collect()
        prints = [plain_fingerprint(r.text) for r in rows]
        names = plain_components(prints)
        keys = [[r.doc_id for r, n in zip(rows, names) if n == name and r.doc_id is not None] for name in names]
        want = Counter((r.doc_id, f"{p:016x}", min(k, default=None), names.count(n)) for r, p, k, n in zip(rows, prints, keys, names))
        assert Counter(tuple(r) for r in fingerprints.near_duplicates(frame).collect()) == want
    assert fingerprints.near_duplicates(odd.limit(0)).count() == 0


# --- lexical search ------------------------------------------------------------------------


def plain_ranking(docs, items, best):
    held = [(k, Counter(TERM.findall((t or "").translate(LOWER)))) for k, t in docs]
    held = [(k, c) for k, c in held if c]
    total = sum(sum(c.values()) for _, c in held)
    holders = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(LOWER)))
        found = []
        for k, c in held:
            m = 50 + 50 * sum(c.values()) * len(held) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(held) + 2) / (2 * holders[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in terms if t in c
            )
            if score > 0:
                found.append((-score, (k is not None, k or 0), k))
        out.update((item, i + 1, k, -s) for i, (s, _, k) in enumerate(sorted(found)[:best]))
    return out


@pytest.mark.parametrize("index_bytes", [1 << 20, 120])
def test_ranking(spark, odd, index_bytes):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "日本", "A1", "a1"]
    docs = [(int(i) if i % 7 else None, " ".join(rng.choice(words, rng.integers(0, 12))) + ".") for i in rng.integers(0, 400, 500)]
    docs += [(1000 - i, "w1-w2_W3") for i in range(60)] + [(3, "w1 " * 400_000 + "日本 " * 100_000), (4, None), (5, "--")]
    items = [(i, " ".join(rng.choice([*words, "none"], rng.integers(0, 6)))) for i in range(12)] + [(1, "w1 w2"), (None, "w3"), (9, None)]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in EXTRA})
    got = lexical.ranked(frame.repartition(4), asked, best=7, index_bytes=index_bytes)
    assert Counter(tuple(r) for r in got.collect()) == plain_ranking(docs, items, 7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_ranking_when_all_bags_share_a_digest(spark):
    docs = [(i, t) for i, t in enumerate(["a b", "b a", "a", "a a", "c b", "b", "d"] * 3)]
    items = [(1, "a"), (2, "b c"), (3, "z")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.ranked(frame, asked, best=5, digest=lambda bag, m: F.lit(b"same"))
    assert Counter(tuple(r) for r in got.collect()) == plain_ranking(docs, items, 5)


def test_terms_that_share_a_hash_are_told_apart():
    index = lexical.build_index([{"item_id": 1, "text": "alpha beta gamma"}])
    data, offsets = flat(pa.array(["beta", "delta", "gamma", "alpha"]))
    index.hashes[:] = lexical.hash_words(data, offsets[:1], offsets[1:2])[0]
    places = []
    for word in (b"alpha", b"beta", b"gamma"):
        places.append(bytes(index.text[index.edges[len(places)] : index.edges[len(places) + 1]]))
    same = np.frombuffer(b"beta", np.uint8)
    assert index.places(same, np.array([0]), np.array([4])).tolist() == [places.index(b"beta")]
    index.text = index.text.copy()
    index.text[index.edges[places.index(b"beta")]] = 1
    assert index.places(same, np.array([0]), np.array([4])).tolist() == [-1]


def test_ranking_of_odd_rows(spark, odd):
    asked = odd.select(F.col("doc_id").alias("item_id"), "text")
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in lexical.ranked(odd, asked).collect()) == plain_ranking(rows, rows, 50)
    assert lexical.ranked(odd, asked.limit(0)).count() == 0 and lexical.ranked(odd.limit(0), asked).count() == 0
