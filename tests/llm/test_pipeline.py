"""The whole pipeline against a plain version of each stage."""

import hashlib
import math
import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from test_operators import WORD, plain_classes, plain_counts

import corpus_pipeline
from tidemark.llm import mixing, pieces, quality

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rejected(rule, cutoff, counts):
    top, bottom, side, _ = quality.RULES[rule]
    if cutoff is None or not counts[bottom]:
        return False
    value = counts[top] / counts[bottom]
    return value > cutoff if side == "above" else value < cutoff


def plain_quality(docs, good):
    counts = {d: dict(zip(quality.COUNTS, plain_counts(t))) for d, (t, _, _) in docs.items()}
    passed = {d for d, c in counts.items() if c["n_words"] >= 20 and 100 * c["n_repeat_words"] <= 30 * c["n_words"]}
    strata = defaultdict(list)
    for d in passed & good:
        strata[docs[d][1]].append(d)
    cutoffs = defaultdict(dict)
    p = quality.FALSE_REJECTIONS / len(quality.RULES)
    for lang, held in strata.items():
        n = len(held)
        for rule, (*_, grid) in quality.RULES.items():
            for cutoff in grid:
                k = sum(rejected(rule, cutoff, counts[d]) for d in held)
                if sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > quality.ERROR / (len(quality.RULES) * len(strata)):
                    break
                cutoffs[lang][rule] = cutoff
    return {d: docs[d] for d in passed if not any(rejected(r, cutoffs[docs[d][1]].get(r), counts[d]) for r in quality.RULES)}


def plain_mix(docs):
    sizes = {d: len(WORD.findall(t or "")) for d, (t, _, _) in docs.items()}
    own = defaultdict(list)
    for d, (_, _, source) in docs.items():
        own[source].append(d)
    order = sorted(own, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total = {s: sum(sizes[d] for d in own[s]) for s in order}
    capped = set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        heavy = sum(weight[s] for s in order if s not in capped)
        target = {s: float(3 * total[s]) if s in capped else weight[s] * rest / heavy for s in order}
        more = {s for s in order if target[s] > 3 * total[s]} - capped
        if not more:
            break
        capped |= more
    times = {}
    for s in order:
        whole = math.floor(target[s] / total[s]) if total[s] else 0
        left, upto = target[s] - whole * total[s], 0
        for draw, d in sorted((hashlib.md5(f"{mixing.SEED}:{d}:{hashlib.md5((docs[d][0] or '').encode()).hexdigest()}".encode()).hexdigest(), d) for d in own[s]):
            upto += sizes[d]
            times[d] = whole + (upto - sizes[d] / 2 <= left)
    return times


def test_pipeline_against_plain_stages(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    docs = {r.doc_id: (r.text, r.lang, r.source) for r in rows}
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    good = {r.doc_id for r in labels if r.quality == 1 and r.toxic == 0}
    kept = plain_quality(docs, good)
    kept = {d: kept[d] for d in set(plain_classes({d: x[0] for d, x in kept.items()}).values())}
    kept = {d: x for d, x in kept.items() if not any(i in x[0] for i in items)}
    times = plain_mix(kept)
    whole = pieces.load(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want, start = [], 0
    for d in sorted(kept):
        ids = np.array([*whole.encode(kept[d][0], add_special_tokens=False).ids, 0], "<u4")
        for _ in range(times[d]):
            want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect()), key=lambda r: r[1])
    assert got == want and len(want) > 100
