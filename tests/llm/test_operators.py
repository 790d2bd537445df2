"""Each operator against a brute-force version on small tables, and on the whole test tables where that is cheap."""

import hashlib
import math
import os
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, lm, minhash, mixing, pieces, quality, repeats, sharding, token_files, url_rules
from tidemark.llm.arrays import flat, owners
from tidemark.llm.graph import components, hung
from tidemark.llm.queries import QUERIES
from tidemark.session import scratch_path

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas().sort_values("doc_id")


def random_texts(seed, n, alphabet, most):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(alphabet, rng.integers(0, most))) for _ in range(n)]


# --- sharding --------------------------------------------------------------------------


def test_shards_are_a_seeded_permutation_cut_evenly(spark, documents):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    runs = [
        sharding.shuffled_shards(docs, shards=7, seed=s, bucket_bytes=50_000)
        .select("record.doc_id", "shard", "slot").toPandas() for s in (1, 1, 2)
    ]
    places = [r.sort_values(["shard", "slot"]).doc_id.tolist() for r in runs]
    assert places[0] == places[1] != places[2]
    assert sorted(places[0]) == documents.doc_id.tolist() != places[0]
    sizes = runs[0].groupby("shard").slot.agg(["size", "max", "nunique"])
    assert sizes["size"].max() - sizes["size"].min() <= 1
    assert (sizes["max"] + 1 == sizes["size"]).all() and (sizes["nunique"] == sizes["size"]).all()


def test_written_shards_hold_whole_records(spark, documents):
    path = scratch_path(spark, "shards")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    sharding.write_shards(sharding.shuffled_shards(docs, shards=3), path)
    back = spark.read.parquet(path)
    assert back.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0
    assert back.count() == len(documents)


# --- mixing ----------------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [[5, 100, 7], [10, 10, 10, 10], [1, 2, 1000, 1, 1], [0, 50], [0, 0]])
def test_water_filling(spark, sizes):
    sized = spark.createDataFrame([(chr(97 + i), n) for i, n in enumerate(sizes)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    capped: set[int] = set()
    while True:
        rest = sum(sizes) - sum(3 * sizes[i] for i in capped)
        heavy = sum(w for i, w in enumerate(weights) if i not in capped)
        want = [3 * n if i in capped else rest * w / heavy for i, (n, w) in enumerate(zip(sizes, weights))]
        more = {i for i, t in enumerate(want) if t > 3 * sizes[i]} - capped
        if not more:
            break
        capped |= more
    assert [got[chr(97 + i)] for i in range(len(sizes))] == pytest.approx(want)


def test_mix_comes_near_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    one, two = (
        mixing.mixed(d).select("record.doc_id", "record.source", "size", "target", "times").toPandas().sort_values("doc_id")
        for d in (docs, docs.repartition(5))
    )
    assert one.times.tolist() == two.times.tolist() and one.times.max() <= 3
    for _, rows in one.groupby("source", dropna=False):
        assert abs((rows["size"] * rows.times).sum() - rows.target.iloc[0]) <= rows["size"].max() / 2 + 1


# --- URL rules -------------------------------------------------------------------------


def test_automaton_against_regular_expressions():
    rng = np.random.default_rng(4)
    globs = ["".join(rng.choice(list("ab/.?*"), rng.integers(1, 9))) for _ in range(60)] + ["*" * 2, "a" * 70 + "*"]
    texts = random_texts(5, 400, list("ab/."), 12) + ["a" * 75, "", "é/a"]
    got = url_rules.GlobAutomaton(globs).matches(texts)
    for g, glob in enumerate(globs):
        parts = re.split(r"(\*\*|\*|\?)", glob)
        pattern = "".join({"**": "(?s:.*)", "*": "[^/]*", "?": "(?s:.)"}.get(p, re.escape(p)) for p in parts)
        assert got[:, g].tolist() == [bool(re.fullmatch(pattern, t)) for t in texts], glob


def test_odd_urls(spark):
    urls = [None, "", "net/", "http://", "http://NET", "http://a.net/", "x://b.example.net/en/?q", "http://example.net?/en/",
            "http://a.org/fr/#", "http://notnet/", "http://a.com/.net/", "http://a.net://b/", "http://é.example.com/de/x"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judged(pages).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[4] == ("net", "", None, "allow") and got[5] == ("a.net", "/", "net/", "block")
    assert got[6] == ("b.example.net", "/en/", "example.net/en/", "allow")
    assert got[7] == ("example.net", "", None, "allow") and got[8] == ("a.org", "/fr/", "org/fr/", "allow")
    assert got[9][2] is None and got[10] == ("a.com", "/.net/", None, "allow")
    assert got[11] == ("a.net:", "//b/", None, "allow") and got[12][2] == "example.com/de/"


# --- tokens ----------------------------------------------------------------------------

HARD = ["", "a", " ", "  ", "a  b", "a \n\n b\n", " <|endoftext|> x", "foo  <|endoftext|>  bar<|endoftext|>", "a\u00a0b \u2003 c",
        "it's don't 'tis  's", "x\t\ty \x1c z \x85", "<|startoftext|>A <", "ΑΣ Σ á ́b", "日本 語 テスト  。 ", "trail   "]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    alphabet = ["a", "b", " ", "\n", "\t", "'s", "<|endoftext|>", "<", "é", "\u2003", "1", "!", "日", "́", "A", "\x1c", "|>"]
    texts = HARD + random_texts(1, 1500, alphabet, 40)
    whole = pieces.load(public_tokenizers.path(name))
    encoder = pieces.PieceEncoder(public_tokenizers.path(name), keep_ids=True)
    data, offsets = flat(pa.array([*texts, None]))
    starts, ends = encoder.cut(data, offsets)
    places = encoder.places(data, starts, ends)
    counts = np.bincount(owners(offsets, starts), encoder.counts[places], len(texts) + 1).astype(int)
    ids = np.split(encoder.ids_of(places), np.cumsum(counts)[:-1])
    for text, got in zip(texts, ids):
        assert got.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_new_pieces_are_encoded_in_a_row():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, whole = pieces.PieceEncoder(path, keep_ids=True), pieces.load(path)
    calls = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counted()
    texts = [" ".join(f"word{i * 7919} é{i}," for i in range(3000)), "start  here ", " ", "", "x <|endoftext|>  y"]
    broken = b"ab \xff\xfe \xf0\x9f z"  # no UTF-8: the bytes behind its ids are others
    column = pa.array([*[t.encode() for t in texts], broken], pa.large_binary())
    for _ in range(2):
        data, offsets = flat(column)
        starts, ends = encoder.cut(data, offsets)
        places = encoder.places(data, starts, ends)
    counts = np.bincount(owners(offsets, starts), encoder.counts[places], len(column)).astype(int)
    ids = np.split(encoder.ids_of(places), np.cumsum(counts)[:-1])
    for text, got in zip([*texts, broken.decode("utf-8", "replace")], ids):
        assert got.tolist() == whole.encode(text, add_special_tokens=False).ids, text
    calls.clear()
    some = np.frombuffer(b"first" + b"".join(b" new%d" % i for i in range(5000)), np.uint8)
    starts, ends = encoder.cut(some, np.array([0, len(some)]))
    places = encoder.places(some, starts, ends)
    assert encoder.counts[places].sum() == len(whole.encode(some.tobytes().decode()).ids)
    assert len(calls) < 20


def test_blocks_are_read_in_small_groups(spark, tmp_path):
    from pyarrow import parquet

    rng = np.random.default_rng(3)
    text = " ".join(map(str, rng.integers(0, 10**9, 300_000)))
    docs = spark.createDataFrame([(i, text) for i in range(12)], "doc_id long, text string")
    token_files.write_token_files(docs, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"))
    groups = [parquet.ParquetFile(f).metadata for f in (tmp_path / "t").glob("*.parquet")]
    sizes = [m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)]
    assert sum(sizes) > 20 << 20 and max(sizes) < 20 << 20


def test_token_counts(spark, documents):
    whole = pieces.load(public_tokenizers.path("word_bpe_49k.json"))
    got = QUERIES["op7_token_counts"](spark, SF_DIR).toPandas().sort_values("doc_id")
    want = [len(whole.encode(t or "", add_special_tokens=False)) for t in documents.text]
    assert got.n_tokens.tolist() == want and got.over_limit.tolist() == [n > 2048 for n in want]
    assert got.n_bytes.tolist() == [len((t or "").encode()) for t in documents.text]


@pytest.mark.parametrize("layout", ["byte", "bit"])
def test_planes_and_checksums_round_trip(layout):
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 9, 5000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert (token_files.from_planes(token_files.to_planes(ids, layout), n, layout) == ids).all()
    a, b = rng.bytes(1000), rng.bytes(777)
    assert token_files.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize(("layout", "block", "size"), [("byte", 1 << 16, 64 << 20), ("bit", 500, 100_000)])
def test_token_files_read_back(spark, documents, layout, block, size):
    whole, path = pieces.load(public_tokenizers.path("byte_bpe_50k.json")), scratch_path(spark, "tokens")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(3)
    token_files.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), layout, block, size)
    got = {r.doc_id: r for r in token_files.read_documents(spark, path).collect()}
    start = 0
    for doc, text in zip(documents.doc_id, documents.text):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


# --- quality ---------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered), len(lines))


def test_quality_counts():
    texts = [None, "", "\n\n", "a", "a\na", "a\n a\na\n", " x " * 30] + random_texts(2, 400, list("ab \n\n #é\x0b"), 120)
    data, offsets = flat(pa.array(texts))
    got = quality.text_counts(data, offsets)
    for i, text in enumerate(texts):
        assert tuple(int(got[c][i]) for c in quality.COUNTS) == plain_counts(text), text


def test_binomial_tail_is_exact():
    for n in (1, 5, 40, 300):
        for k in {0, 1, n // 3, n - 1, n}:
            for p in (0.01, 0.2, 0.7):
                want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
                assert quality.binomial_below(k, n, p) == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_cutoffs_keep_good_documents(spark):
    """A rule that would reject good documents is not certified; one that spares them is."""
    rows = [(i, "en", 100, 500, 0, 0, 0, 10, False) for i in range(3000)]
    rows += [(i, None, 100, 500, 60 if i % 5 == 0 else 0, 0, 0, 10, False) for i in range(3000, 6000)]
    rows += [(9000 + i, "few", 100, 500, 0, 0, 0, 10, False) for i in range(5)]
    counts = spark.createDataFrame(rows, "doc_id long, lang string, " + ", ".join(f"{c} long" for c in quality.COUNTS) + ", base_failed boolean")
    labels = counts.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got = {r.lang: r for r in quality.certified_cutoffs(counts, labels).collect()}
    assert got["en"].symbols == 0.1 and got[None].symbols == 0.75 and got["few"].symbols is None
    assert quality.judged(counts, quality.certified_cutoffs(counts, labels)).where("NOT kept").count() == 0


# --- near-duplicates -------------------------------------------------------------------


def test_signatures_are_unbiased():
    rng, errors = np.random.default_rng(0), []
    for _ in range(150):
        e = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        a = rng.integers(1, 9, 200) * (rng.random(200) < 0.6)
        b = np.where(rng.random(200) < 0.8, a, rng.integers(0, 9, 200))
        owner = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        found = minhash.signatures(owner, np.concatenate([e[a > 0], e[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2)
        errors.append((found[0] == found[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.012


def plain_classes(texts):
    bags = {}
    for k, t in texts.items():
        words = WORD.findall(t or "")
        n = min(5, len(words))
        bags[k] = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else Counter()
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sum(bags[a].values()), sum(bags[b].values())
            if not x or not y or min(x, y) < 0.8 * max(x, y):
                continue
            shared = sum((bags[a] & bags[b]).values())
            if shared >= 0.8 * (x + y - shared):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {k: root(k) for k in texts}


def near_copies(seed, n, words, changes):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list(string.ascii_lowercase), 6)) for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.integers(0, changes)):
            own[rng.integers(0, words)] = "".join(rng.choice(list(string.ascii_lowercase), 6))
        yield " ".join(own)


def test_near_duplicates_against_all_pairs(spark):
    texts = [None, "", "  ", "a b", "a  b", "a b c d e f", "x " * 50, "x " * 55, "x " * 100]
    for seed, (n, words, changes) in enumerate([(25, 120, 4), (40, 200, 9), (3, 30, 2)]):
        texts += list(near_copies(seed, n, words, changes))
    rows = dict(enumerate(texts * 2))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == plain_classes(rows)
    kept = [r.doc_id for r in minhash.deduplicated(docs).collect()]
    assert sorted(kept) == sorted(set(got.values()))


def test_near_duplicates_around_a_common_passage(spark):
    """Many texts meet in the buckets of a passage without being near, some at a little more or less than 0.8."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(5000)]
    passage = " ".join(rng.choice(words, 100))
    texts = [f"{passage} {' '.join(rng.choice(words, int(n)))}" for n in rng.integers(8, 90, 80)]
    texts += [t + " " + " ".join(rng.choice(words, int(n))) for t, n in zip(texts, rng.integers(1, 40, 80))]
    rows = dict(enumerate(texts))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == plain_classes(rows)


def test_kept_bits_of_registers_bound_how_far_apart_a_pair_may_be(spark):
    rng = np.random.default_rng(5)
    most, counts = minhash.most_apart(0.8), []
    planes = []
    for _ in range(200):  # 400 of 500 shared: exactly 0.8
        units = rng.integers(0, 2**63, 500).astype(np.uint64)
        a, b = np.sort(units[:450]), np.sort(np.concatenate([units[:400], units[450:]]))
        found = minhash.signatures(np.repeat([0, 1], 450), np.concatenate([a, b]), np.ones(900, int), 2)
        bits = minhash.bit_planes(found)
        x = (bits[0] ^ bits[1]).reshape(minhash.PLANES, -1)
        counts.append(int(np.bitwise_count(np.bitwise_or.reduce(x, axis=0).view(np.uint64)).sum()))
        assert counts[-1] <= int((found[0] != found[1]).sum())
        planes.append([int(v) for v in bits.reshape(-1)])
    assert max(counts) <= most and abs(np.mean(counts) - minhash.REGISTERS * 0.2 * 15 / 16) < 2
    width = len(planes[0]) // 2
    schema = ", ".join(f"{c}{i} long" for c in "ab" for i in range(width))
    frame = spark.createDataFrame(planes, schema).select(minhash.registers_apart("a", "b").alias("n"))
    assert sorted(r.n for r in frame.collect()) == sorted(counts)


def test_bits_of_units_never_rule_out_a_near_pair(spark):
    rng = np.random.default_rng(6)
    rows, exact = [], []
    for size in [3, 20, 62, 63, 64, 65, 66, 146, 600, 5000]:
        for change in (0.05, 0.1, 0.12, 0.17, 0.3):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            b = np.where(rng.random(size) < change, rng.integers(0, 2**63, size).astype(np.uint64), a)[: size - int(size * rng.random() * change)]
            bags = [np.unique(np.append(x, x[: size // 8]), return_counts=True) for x in (a, b)]
            units, counts = (np.concatenate([bag[i] for bag in bags]) for i in (0, 1))
            owner = np.repeat([0, 1], [len(bag[0]) for bag in bags])
            places, words = minhash.unit_bits(owner, units, counts, 2)
            bits = [words.view(np.int64)[i:j].tolist() for i, j in zip(places[:-1], places[1:])]
            (x, nx), (y, ny) = bags
            _, i, j = np.intersect1d(x, y, return_indices=True)
            shared = int(np.minimum(nx[i], ny[j]).sum())
            exact.append((int(nx.sum()), int(ny.sum()), shared / (int(nx.sum()) + int(ny.sum()) - shared)))
            rows += [(len(exact) - 1, exact[-1][0], bits[0], exact[-1][1], bits[1])]
    frame = spark.createDataFrame(rows, "k int, a long, x array<long>, b long, y array<long>")
    for first, second in (("a", "b"), ("b", "a")):
        side = {"a": "x", "b": "y"}
        may = minhash.enough_shared(F.col(first), F.col(side[first]), F.col(second), F.col(side[second]), 0.8)
        got = {r.k: r.may for r in frame.select("k", may.alias("may")).collect()}
        assert all(got[k] for k, (_, _, overlap) in enumerate(exact) if overlap >= 0.8)
        assert not any(got[k] for k, (n, _, overlap) in enumerate(exact) if overlap < 0.6 and 20 < n < 1000)


def test_last_join_of_near_copies_makes_few_rows(spark, monkeypatch):
    """Copies of one text that are not near each other: candidates of the last join are verified by bits before they are rows."""
    base = [f"w{i}" for i in range(150)]
    rows = {}
    for i in range(216):  # three places of four words, each in six versions: shingles are shared, so they are no node's own
        words = list(base)
        for place, version in enumerate((i // 36, i // 6 % 6, i % 6)):
            for p in range(4):
                words[10 + 45 * place + 6 * p] = f"e{place}-{version}-{p}"
        rows[i] = " ".join(words)
    stored, real = [], minhash.staged

    def staged(df, label):
        out = real(df, label)
        if label == "pairs":
            stored.append(out.count())
        return out

    monkeypatch.setattr(minhash, "staged", staged)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == plain_classes(rows)
    assert stored[-1] <= 5 * len(rows), stored


def test_near_duplicates_of_the_table(spark, documents):
    got = {r.doc_id: r.class_id for r in QUERIES["op3_near_dedup"](spark, SF_DIR).collect()}
    assert got == plain_classes(dict(zip(documents.doc_id.tolist(), documents.text)))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_links_of_a_dense_group_are_hung_on_few(spark):
    """Before, each of the 1,770 links of 60 nodes was joined in every round."""
    rng = np.random.default_rng(4)
    nodes = [int(n) for n in rng.permutation(1000)[:60]]
    dense = {(min(a, b), max(a, b)) for a in nodes for b in nodes if a != b}
    links = spark.createDataFrame(sorted(dense) + [(2000, 2001), (2001, 2002)], "a long, b long")
    assert hung(links).count() == 59 + 2
    both = links.union(links.select(F.col("b"), F.col("a"))).union(spark.createDataFrame([(3000, 3000)], "a long, b long"))
    got = {r.node: r.component for r in components(both).collect()}
    assert got == {**{n: min(nodes) for n in nodes}, 2000: 2000, 2001: 2000, 2002: 2000, 3000: 3000}
    assert components(links.limit(0)).count() == 0


# --- decontamination -------------------------------------------------------------------


def test_leaks_of_the_table(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontamination"](spark, SF_DIR).collect()}
    assert got >= {(d, i) for d, t in zip(documents.doc_id, documents.text) for i, x in items if x in (t or "")}
    for d, i in got:  # each holds four fifths of the item's shingles
        words = [re.findall(r"\w+", x.lower()) for x in (dict(zip(documents.doc_id, documents.text))[d], dict(items)[i])]
        held, own = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in words)
        assert len(held & own) >= 0.6 * len(own)


def test_leaks_survive_case_and_small_edits_and_many_indexes(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list(string.ascii_lowercase), 5)) for _ in range(3000)]
    items = [(i, " ".join(rng.choice(words, 30)) + ". " + " ".join(rng.choice(words, 6)) + ".") for i in range(80)]
    noise = lambda n: " ".join(rng.choice(words, n))
    edited = items[7][1].split()
    edited[12] = "zzz"
    docs = [(0, noise(500) + " " + items[3][1] + " " + noise(500)), (1, items[5][1].upper()), (2, " ".join(edited)),
            (3, noise(2000)), (4, " ".join(items[9][1].split()[:15])), (5, None), (6, "")]
    questions = decontaminate.question_and_answer(spark.createDataFrame(items, "item_id long, text string"))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, questions).collect()} == {(0, 3), (1, 5), (2, 7)}
    assert len(list(decontaminate.indexes(questions, 4000))) > 2
    assert sorted(r.doc_id for r in decontaminate.without_leaks(frame, questions).collect()) == [3, 4, 5, 6]


def test_block_max_bounds_lose_nothing():
    """All passages scored in full give the same pairs above the threshold."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows = [{"item_id": i, "question": " ".join(rng.choice(words, 12)), "answer": ""} for i in range(100)]
    found = Counter(w for r in rows for w in set(decontaminate.words_of(*flat(pa.array([r["question"]])))[0].tolist()))
    index = decontaminate.build_index(rows, found, len(rows), 12.0)
    texts = [" ".join([*rng.choice(words, 9), *r["question"].split()[:k]]) for r in rows for k in (5, 9, 12)]
    data, offsets = flat(pa.array(texts))
    got = {(t, i) for t, i, *_ in decontaminate.matches(index, data, offsets, least=0.5)}
    question, decontaminate.QUESTION = decontaminate.QUESTION, 0.0
    try:
        loose = {(t, i): s for t, i, s, *_ in decontaminate.matches(index, data, offsets, least=0.5)}
    finally:
        decontaminate.QUESTION = question
    want = {}
    for t, text in enumerate(texts):
        held = set(decontaminate.words_of(*flat(pa.array([text])))[0].tolist())
        for i in range(len(rows)):
            own = [(index.terms[k], index.impacts[p]) for k in range(len(index.terms)) if int(index.terms[k]) in held
                   for p in range(index.first[k], index.first[k + 1]) if index.items[p] == i]
            score = sum(x for _, x in own)
            if score >= 0.5:
                want[t, i] = score
    assert got <= set(loose)
    assert {k for k in want if len(texts[k[0]].split()) <= index.width} == set(loose) & set(want) == set(want)


# --- repeated strings ------------------------------------------------------------------


def plain_repeats(rows, length):
    starts = Counter()
    for _, t in rows:
        b = (t or "").encode()
        starts.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = {}
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(bool(g) and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize(("length", "anchor", "part"), [(40, 24, 500), (20, 8, 3000)])
def test_repeats_against_all_windows(spark, length, anchor, part):
    rng = np.random.default_rng(length)
    base = random_texts(6, 6, list("abé "), 300) + ["a" * 90, "ab" * 60]
    rows = []
    for i in range(60):
        parts = [rng.choice(base) if rng.random() < 0.6 else random_texts(int(rng.integers(1e9)), 1, list("abcdefgh"), 60)[0]
                 for _ in range(rng.integers(0, 6))]
        rows.append((i, None if i % 17 == 0 else "".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = repeats.without_repeats(docs, length, anchor, part_bytes=part).collect()
    assert {r.rest.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found} == plain_repeats(rows, length)


def test_repeats_of_the_table(spark, documents):
    want = plain_repeats(list(zip(documents.doc_id, documents.text)), 400)
    for r in QUERIES["op5_repeated_strings"](spark, SF_DIR).collect():
        n, removed, runs, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, runs, hashlib.sha256(kept).hexdigest())


# --- language model --------------------------------------------------------------------


def test_base_scores_and_held_out_gain(spark, documents):
    rows = QUERIES["op10_lm_scores"](spark, SF_DIR).collect()
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    tokens = {d: [*WORD.findall((t or "").translate(low)), None] for d, t in zip(documents.doc_id, documents.text)}
    trained = {d for d in tokens if zlib.crc32(str(d).encode()) % 5 != 1}
    c = Counter(w for d in trained for w in tokens[d])
    total = sum(c.values())
    for r in rows:
        own = tokens[r.doc_id]
        want = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id not in trained, len(own), sum(c[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(want, rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_shares_add_up_to_one():
    model = lm.Model.fresh(np.arange(5, dtype=np.uint64), np.array([9, 7, 5, 3, 1]), 10, 4)
    before = np.array([[0, 1], [3, 4]])
    shares = [np.exp(model.log_shares(np.full(2, w), before)) for w in range(7)]
    assert np.sum(shares, axis=0) == pytest.approx([1, 1], rel=1e-5)


def test_vocabulary_follows_the_input(spark):
    words = [f"w{i}" for i in range(900)]
    rows = spark.createDataFrame([(i, " ".join(words), False) for i in range(20)] + [(99, "rare", False)], "key long, text string, held_out boolean")
    model, own = lm.fitted(rows, lm.counted(rows))
    assert (len(model.keys), own) == (900, 18000)
    ids = [model.ids[model.keys == h][0] for h in model.keys[:3]]
    assert len(set(ids)) == 3 and min(ids) > 1
    before = np.array([[5, 700]])
    assert sum(np.exp(model.log_shares(np.array([r]), before))[0] for r in range(902)) == pytest.approx(1, rel=1e-4)


def plain_training(model, tokens, before, seed):
    """``Model.train`` token by token, in doubles."""
    rng, w, n = np.random.default_rng(seed), model.width, len(model.share)
    p = {k: v.astype(float) for k, v in model.parts.items()}
    squares = {k: np.full(v.shape, lm.WORD_START if k in ("seen", "said", "bias") else lm.DENSE_START) for k, v in p.items()}
    of_kind, first = np.exp(p["kind_bias"]), model.share[:w]
    draws = lm.Draws(rng, of_kind / of_kind.sum()), lm.Draws(rng, first / first.sum())
    for i in range(0, len(tokens), lm.STEP_TOKENS):
        own, seen = tokens[i : i + lm.STEP_TOKENS], before[i : i + lm.STEP_TOKENS]
        kinds, heads = draws[0].some(), draws[1].some() if (own < w).any() else None
        low = own[own >= w] // w * w
        most = np.minimum(w, n - low)
        drawn = low[:, None] + (rng.random((len(low), lm.INNER_NOISE)) * most[:, None]).astype(int)
        tails, change = iter(zip(drawn, most)), {k: np.zeros(v.shape) for k, v in p.items()}
        for t, b in zip(own, seen):
            q, toward = sum(p["seen"][b[d]] @ p["turn"][d] for d in range(lm.CONTEXT)), 0
            told = [("kind", "kind_bias", t // w, kinds, draws[0].logs)]
            if t < w:
                told.append(("said", "bias", t, heads, draws[1].logs))
            else:
                noise, size = next(tails)
                told.append(("said", "bias", t, noise, np.full(n, np.log(lm.INNER_NOISE / size))))
            for name, bias, true, noise, logs in told:
                for row, sign in [(true, 1), *((r, -1) for r in noise)]:
                    far = sign / (1 + np.exp(sign * (q @ p[name][row] + p[bias][row] - logs[row])))
                    toward = toward + far * p[name][row]
                    change[name][row] += far * q
                    change[bias][row] += far
            for d in range(lm.CONTEXT):
                change["seen"][b[d]] += toward @ p["turn"][d].T
                change["turn"][d] += np.outer(p["seen"][b[d]], toward)
        for k in p:
            squares[k] += (change[k] / len(own)) ** 2
            p[k] += lm.RATE * change[k] / len(own) / np.sqrt(squares[k])
    return p


def test_training_reads_each_parameter_once_a_step():
    rng = np.random.default_rng(4)
    model = lm.Model.fresh(np.arange(60, dtype=np.uint64), np.arange(60, 0, -1) ** 2, 10, 40)
    tokens, before = rng.integers(0, 62, 700), rng.integers(0, 62, (700, lm.CONTEXT))
    want = plain_training(model, tokens, before, 3)
    groups = lm.Groups.of(np.array([7, 3, 7, 9]))
    assert groups.keys.tolist() == [3, 7, 9] and groups.times.tolist() == [1, 2, 1] and groups.place.tolist() == [1, 0, 1, 2]
    assert groups.sums(np.array([[1.0], [2.0], [4.0], [8.0]])).tolist() == [[2.0], [5.0], [8.0]]
    touched = model.train(iter([(tokens, before)]), 3)
    assert touched.tokens == 700 and touched.seen.sum() == 1400
    for k, v in want.items():
        assert model.parts[k] == pytest.approx(v, rel=1e-3, abs=1e-4), k


def test_scores_of_any_size():
    q, said = np.full((3, lm.SIZE), 9, np.float32), np.full((4, lm.SIZE), 1, np.float32)
    said *= np.array([1, -1, 2, 0.9], np.float32)[:, None]
    got = lm._log_softmax(q, said, np.zeros(4, np.float32), np.array([2, 0, 1]))
    assert got == pytest.approx([0, -144, -432], abs=1e-3)


def plain_log_shares(model, tokens, before):
    """``Model.log_shares`` token by token, in doubles."""
    p, out = {k: v.astype(float) for k, v in model.parts.items()}, []
    for t, b in zip(tokens, before):
        q = sum(p["seen"][r] @ p["turn"][d] for d, r in enumerate(b))
        kinds = p["kind"] @ q + p["kind_bias"]
        low = t // model.width * model.width
        inside = (p["said"] @ q + p["bias"])[low : low + model.width]
        out.append(kinds[t // model.width] - np.logaddexp.reduce(kinds) + inside[t - low] - np.logaddexp.reduce(inside))
    return out


def test_tokens_after_the_same_words_share_a_softmax(monkeypatch):
    rng = np.random.default_rng(6)
    model = lm.Model.fresh(np.arange(60, dtype=np.uint64), np.arange(60, 0, -1) ** 2, 10, 40)
    tokens, before = rng.integers(0, 62, 900), rng.integers(0, 5, (900, lm.CONTEXT))
    sizes, real = [], lm._log_softmax
    monkeypatch.setattr(lm, "_log_softmax", lambda q, *a: sizes.append(len(q)) or real(q, *a))
    got = model.log_shares(tokens, before)
    assert got == pytest.approx(plain_log_shares(model, tokens, before), rel=1e-5)
    inside = {(*b, t // model.width) for t, b in zip(tokens.tolist(), before.tolist())}
    assert sizes[0] == 25 and sum(sizes[1:]) == len(inside) < 900
    model.parts["said"] *= 300  # scores beyond what a float's power can hold
    assert np.isfinite(model.log_shares(tokens, before)).all()
    assert model.log_shares(tokens, before) == pytest.approx(plain_log_shares(model, tokens, before), rel=1e-4)


def test_powers_follow_the_code_in_use():
    built = "AVX512_SKX baseline(SSE SSE2 SSE3)"
    assert lm._powers({"exp2": {"ff": {"current": "AVX512_SKX", "available": built}}})[0] is np.exp2
    assert lm._powers({"exp2": {"ff": {"current": "baseline(SSE SSE2 SSE3)", "available": built}}})[0] is np.exp
    assert lm._powers({})[0] is np.exp


def test_hashes_are_found_by_their_top_bits():
    rng = np.random.default_rng(8)
    last = 2**64 - 1
    for keys in ([], [0], [5], [last], [0, 1, 2, 3, last - 1, last], np.unique(rng.integers(0, last, 3000, np.uint64))):
        keys = np.array(keys, np.uint64)
        asked = np.concatenate([keys, rng.integers(0, last, 500, np.uint64), np.array([0, 1, 2**63, last - 1, last], np.uint64)])
        at = {int(k): i for i, k in enumerate(keys)}
        assert lm.Index.of(keys).places(asked).tolist() == [at.get(int(h), len(keys)) for h in asked]
