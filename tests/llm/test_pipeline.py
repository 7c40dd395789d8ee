"""The pipeline against a brute-force version of its stages."""

import collections
import hashlib
import math
import os

import numpy as np
import pytest

import corpus_pipeline
from test_corpus import LOWER, WORD, fill, groups_of, shingle_set
from tokensieve import workers
from tokensieve.llm import common, quality, subword

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_run(spark):
    docs = common.documents(spark, SF)
    model = quality.model_of(spark, docs, SF)
    features = {r["doc_id"]: (r["text"], r["lang"], r["source"], np.array(list(r["_f"]))) for r in quality.with_features(docs.selectExpr("*", "text AS _t"), "_t").collect()}
    rest = {}
    for i, (text, lang, source, x) in features.items():
        total = model[1] + sum(w for rule, w in model[0] if quality.holds(rule, x[None])[0])
        if 1 / (1 + math.exp(-total)) >= quality.THRESHOLD:
            rest[i] = (text, lang, source)

    last = {}
    for i in sorted(rest):
        last[rest[i][0].translate(LOWER)] = i
    rest = {i: rest[i] for i in last.values()}

    sets = {i: shingle_set(d[0]) for i, d in rest.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    rest = {i: rest[i] for i, c in groups_of(links, sets).items() if i == c}

    sizes, of = {i: len(WORD.findall(d[0])) for i, d in rest.items()}, collections.Counter()
    for i, d in rest.items():
        of[d[2]] += sizes[i]
    want = {}
    for source, target in fill(of).items():
        budget = math.floor(target + 1e-9)
        epochs, left = divmod(budget, of[source])
        for i in sorted((i for i in rest if rest[i][2] == source), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            taken = epochs * sizes[i] + max(0, min(sizes[i], left))
            left -= sizes[i]
            want[i] = math.ceil(taken / sizes[i])

    rows = corpus_pipeline.run(spark, SF).collect()
    got = collections.Counter(r["doc_id"] for r in rows)
    assert got == {i: n for i, n in want.items() if n}
    pieces = subword.Pieces.load()
    for r in rows:
        assert (r["lang"], r["source"], r["n_tokens"]) == (*rest[r["doc_id"]][1:], len(r["ids"]))
        assert subword.decode_ids(pieces, r["ids"]) == rest[r["doc_id"]][0]


def test_stages(spark):
    docs = common.documents(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "encode"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns


def test_each_stage_tells_its_workers_to_give_memory_back(spark, monkeypatch):
    docs = common.documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        monkeypatch.setattr(spark.sparkContext, "environment", {"MALLOC_ARENA_MAX": "3"})
        stage(spark, docs, SF)
        assert spark.sparkContext.environment == workers.MEMORY | {"MALLOC_ARENA_MAX": "3"}
