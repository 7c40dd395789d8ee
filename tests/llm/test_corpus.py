"""The corpus operators against brute force on small tables, with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokensieve.llm import catalogue, common, components, exact_dedup, language, mixing, near_dedup, passage_dedup, personal, quality, repeats, shingles, substring_dedup, subword, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(common.UPPER, common.LOWER)
VOCABULARY = [a + b for a in "ba ce di fo gu ha ki le mo nu".split() for b in "ra se ti vo zu".split()]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY, n))


def corpus(seed=0, n=60):
    """(doc_id, text): prose with copies, edits, shared passages, and odd texts."""
    rng = np.random.default_rng(seed)
    passage = prose(rng, 40)
    texts = [prose(rng, int(rng.integers(5, 200))) for _ in range(n)]
    texts[3] = texts[2]
    texts[4] = texts[2].upper()
    texts[5] = texts[2] + " extra"
    for i in range(8, 20):
        words = texts[7].split()
        words[i % len(words)] = "edited"
        texts[i] = " ".join(words)
    for i in range(20, 30):
        texts[i] = f"{texts[i]} {passage}\n{texts[i - 10][:150]}"
    texts[30] = "same " * 60
    texts[31] = "x" * 5000 + " " + "ab" * 200
    texts[32:40] = ["", "   \n\t ", "one", "One", "é" * 150, "日本 🎉 " * 30, "a b c", "▁ a  b"]
    texts[40] = None
    texts[41] = prose(rng, 8000) + " " + passage
    return [(int(i), t) for i, t in zip(rng.permutation(n) * 3, texts, strict=True)]


def frame(spark, rows, extra=True):
    """rows as documents whose other columns bear names that the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if not extra:
        return df
    names = ("id", "kept", "component_id", "digest", "norm", "node", "block", "data", "size", "score", "base", "spans", "v", "key", "ids", "_t", "_cand", "a", "b")
    return df.withColumns({n: F.lit("x") for n in names}).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text")})


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def groups_of(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, 5000)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups_of(edges, {x for e in edges for x in e})
    assert all(got.get(i, i) == c for i, c in want.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# exact copies


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1)], ids=["sha256", "colliding"])
def test_exact_dedup(spark, digest):
    rows = corpus(1)
    got = by_id(exact_dedup.exact_dedup(spark, frame(spark, rows), digest=digest))
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    for i, t in rows:
        g = groups[(t or "").translate(LOWER)]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(g), len(g), i == max(g))
        if digest is exact_dedup.sha256:
            assert got[i]["text_sha256"] == hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, None), (3, "")]
    got = exact_dedup.exact_dedup(spark, frame(spark, rows)).collect()
    kept = [(r["doc_id"], r["group_size"]) for r in got if r["kept"]]
    assert sorted(kept, key=str) == sorted([(1, 3), (None, 2), (3, 2)], key=str) and len(got) == 7
    assert sorted(r["text"] for r in exact_dedup.kept_documents(spark, frame(spark, rows)).collect()) == ["", "a", "b"]


def test_exact_dedup_goes_on_with_its_state(spark, tmp_path):
    state = str(tmp_path / "state")
    exact_dedup.exact_dedup(spark, frame(spark, [(9, "a"), (1, "b")]), state_dir=state).count()
    first = spark.read.format("statestore").load(state).count()
    assert first == 2


def test_empty_tables(spark):
    docs = frame(spark, [])
    for df in (
        exact_dedup.exact_dedup(spark, docs),
        near_dedup.near_dedup(spark, docs),
        passage_dedup.passage_dedup(spark, docs),
        substring_dedup.substring_dedup(spark, docs),
        mixing.mix(spark, docs),
        mixing.mixed_documents(spark, docs),
        quality.score(docs, quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))),
        language.predict(spark, docs, language.train(docs)),
        personal.find(docs, personal.train(spark, 400)),
        subword.encode(spark, docs),
        subword.decode(spark, subword.encode(spark, docs)),
        vectors.near_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert df.collect() == []


# near copies


def shingle_set(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup(spark, seed):
    rows = corpus(seed, 80)
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups_of(links, sets)
    got = by_id(near_dedup.near_dedup(spark, frame(spark, rows)))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    kept = near_dedup.kept_documents(spark, frame(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == {i for i in want if want[i] == i} and kept.columns == frame(spark, rows).columns


def test_near_dedup_of_a_large_group(spark):
    """A chain of edits: neighbours link, the ends don't; and hundreds of near copies of one text."""
    rng = np.random.default_rng(4)
    words = prose(rng, 120).split()
    rows = []
    for i in range(300):
        words = words.copy()
        words[int(rng.integers(0, 120))] = f"w{i}"
        rows.append((i, " ".join(words)))
    base = prose(rng, 90).split()
    for i in range(300):
        w = base.copy()
        w[i % 90] = f"v{i}"
        rows.append((1000 + i, " ".join(w)))
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups_of(links, sets)
    got = by_id(near_dedup.near_dedup(spark, frame(spark, rows, extra=False)))
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_near_dedup_of_stars(spark):
    """Copies with scattered edits that link to their original alone, which has the greatest id; more than a block."""
    rng = np.random.default_rng(11)
    rows = []
    for star, (copies, edits) in enumerate(((700, 7), (150, 8))):
        base = prose(rng, 300).split()
        for i in range(copies):
            w = base.copy()
            for at in rng.choice(np.arange(5, 295, 10), edits, replace=False):
                w[at] = f"x{star}y{i}z{at}"
            rows.append((10_000 * star + i, " ".join(w)))
        rows.append((10_000 * star + 9_999, " ".join(base)))
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups_of(links, sets)
    assert set(want.values()) == {0, 10_000} and len(links) < 2 * len(rows)
    got = by_id(near_dedup.near_dedup(spark, frame(spark, rows, extra=False)))
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_near_dedup_of_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, ""), (3, None)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(spark, frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, None, False), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True)], key=str)


def test_near_dedup_scatters_no_small_files(spark):
    """Each file that an executor writes starts processes, so small tables are few files, however many partitions run."""
    rows = corpus(3, 80)
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    with common.settings(spark, {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        got = by_id(near_dedup.near_dedup(spark, frame(spark, rows)))
    files = [(p.name.split("-")[0], len(list(p.glob("part-*")))) for p in set(folder.iterdir()) - before]
    assert {name for name, _ in files} >= {"candidates", "ends", "links", "tops", "edges", "hooks", "jump", "labels"}
    assert max(n for name, n in files if name not in {"signatures", "sets", "nodes", "members"}) <= 2
    assert {i: r["component_id"] for i, r in got.items()} == groups_of(links, sets)


def test_near_dedup_takes_long_texts_in_bounded_batches(spark, monkeypatch):
    """20 texts of 1 MB in one partition; a batch ends at 4 MB."""
    whole = near_dedup._signatures

    def watched(batches):
        for batch in batches:
            assert batch.nbytes < 6 << 20, batch.nbytes
            yield from whole(iter([batch]))

    monkeypatch.setattr(near_dedup, "_signatures", watched)
    rows = [(i, f"word{i // 2} other{i // 2} " * 70_000) for i in range(20)]
    got = by_id(near_dedup.near_dedup(spark, frame(spark, rows, extra=False).coalesce(1)))
    assert {i: r["component_id"] for i, r in got.items()} == {i: i // 2 * 2 for i in range(20)}


# passages


@pytest.mark.parametrize(("seed", "window"), [(1, 13), (2, 13), (3, 5)])
def test_passage_dedup(spark, seed, window):
    rows = corpus(seed)
    first, want = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first.setdefault(tuple(w[j : j + window]), i) < i:
                gone[j : j + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    got = by_id(passage_dedup.passage_dedup(spark, frame(spark, rows), window=window, text=True))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for i, r in got.items()} == want


def test_automata_locate_every_occurrence():
    texts = [b"a b c d e", b"x a b c", b"a b c d", b"q r s"]
    size, ids = np.array([5, 4, 4, 3]), np.array([5, 3, 9, 1])
    hit = passage_dedup.judge(3)(texts, size, ids, np.zeros(4, np.int64), np.array([7, 7, 7, 2]))
    assert hit.tolist() == [True, False, False] + [False, False] + [True, True] + [False]
    assert passage_dedup.confirmed(passage_dedup.spelled(texts), ids, 3) == {"\0\1\2": 3, "\1\2\3": 5}


def test_without_automata_windows_are_lost(spark, monkeypatch):
    """Passages with other words around them aren't whole phrases: only the automata find them."""
    rng = np.random.default_rng(6)
    passage = prose(rng, 30)
    docs = frame(spark, [(i, f"{prose(rng, 20)} {passage} {prose(rng, 20)}") for i in range(6)])
    found = {i: r["n_removed"] for i, r in by_id(passage_dedup.passage_dedup(spark, docs)).items()}
    assert found == {0: 0} | dict.fromkeys(range(1, 6), 30)
    monkeypatch.setattr(passage_dedup, "judge", lambda window: lambda texts, size, ids, start, flank: np.zeros(int((size - window + 1).sum()), bool))
    less = {i: r["n_removed"] for i, r in by_id(passage_dedup.passage_dedup(spark, docs)).items()}
    assert all(less[i] < 30 for i in less)


@pytest.mark.parametrize("hot", [512, 3, 0])
def test_a_passage_among_other_words(spark, monkeypatch, hot):
    """One passage in very many documents, other words around it: edges share a flank. By dictionary and by digests."""
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BLOCK", 30_000)
    rng = np.random.default_rng(9)
    passage = prose(rng, 40)
    rows = [(int(i), f"{prose(rng, int(rng.integers(3, 30)))} {passage[int(rng.integers(0, 9)):]} {prose(rng, int(rng.integers(3, 30)))}") for i in rng.permutation(400)]
    rows += [(int(i) + 1000, t) for i, t in corpus(7)]
    first, seen, words, letters = {}, set(), {}, {}
    for i, t in sorted(rows):
        w, b = WORD.findall(t or ""), (t or "").encode()
        gone, cut = [False] * len(w), bytearray(len(b))
        for j in range(len(w) - 12):
            if first.setdefault(tuple(w[j : j + 13]), i) < i:
                gone[j : j + 13] = [True] * 13
        for j in range(len(b) - 99):
            x = b[j : j + 100]
            if x in seen:
                cut[j : j + 100] = b"\1" * 100
            seen.add(x)
        words[i], letters[i] = sum(gone), sum(cut)
    assert {i: r["n_removed"] for i, r in by_id(passage_dedup.passage_dedup(spark, frame(spark, rows))).items()} == words
    assert {i: r["n_removed"] for i, r in by_id(substring_dedup.substring_dedup(spark, frame(spark, rows))).items()} == letters


@pytest.mark.parametrize(("seed", "window"), [(1, 100), (2, 30)])
def test_substring_dedup(spark, seed, window):
    rows = corpus(seed)
    seen, want = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - window + 1):
            w = b[j : j + window]
            if w in seen:
                gone[j : j + window] = b"\1" * window
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept)
    got = by_id(substring_dedup.substring_dedup(spark, frame(spark, rows), window=window, text=True))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept_text"])) for i, r in got.items()} == want


def test_repeats_of_odd_rows(spark):
    text = prose(np.random.default_rng(1), 60)
    rows = [(None, text), (4, text), (4, text), (5, "short"), (5, None)]
    words = sorted((r["n_words"], r["n_removed"]) for r in passage_dedup.passage_dedup(spark, frame(spark, rows)).collect())
    assert words == [(0, 0), (1, 0), (60, 0), (60, 60), (60, 60)]
    assert sorted(r["n_removed"] for r in substring_dedup.substring_dedup(spark, frame(spark, rows)).collect())[:3] == [0, 0, 0]


# quality and language


def test_quality_learns_and_scores(spark):
    rng = np.random.default_rng(1)
    good = [(i, prose(rng, 80) + ".") for i in range(150)]
    bad = [(1000 + i, (rng.choice(VOCABULARY) + "!! ").upper() * 40) for i in range(150)]
    docs = frame(spark, [*good, *bad, (5000, None), (5001, "")])
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:100]] + [(i, 0) for i, _ in bad[:100]] + [(None, 1), (3, None), (9999, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = by_id(quality.score(docs, model))
    assert len(got) == 302 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(got[i]["score"] >= 0.3) for i, _ in good[100:]], [(got[i]["score"] >= 0.3) for i, _ in bad[100:]]
    assert all(held[0]) and not any(held[1])
    assert model == quality.train(docs, labels) and len(model[0]) < 100
    flat = quality.train(docs, labels.filter("quality = 1"))
    assert {round(r["score"], 6) for r in quality.score(docs, flat).collect()} != {0.5}


def test_quality_columns_equal_python(spark):
    """The compiled rules give what the rules give on the features."""
    rows = [r for r in corpus(3) if r[1] is not None]
    docs = frame(spark, rows)
    rules = [((((2, True, 4.0)), (10, False, 0.01)), 0.7), (((3, False, 0.5),), -1.2)]
    x = {r["doc_id"]: np.array(list(r["_f"])) for r in quality.with_features(docs.select("doc_id", "text"), "text").collect()}
    for i, r in by_id(quality.score(docs, (rules, 0.2))).items():
        total = 0.2 + sum(w * bool(quality.holds(rule, x[i][None])[0]) for rule, w in rules)
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-12


def test_quality_pipeline_filter_keeps_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(spark, corpus(1))
    kept = quality.kept_documents(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == docs.count()


LANGUAGES = {"aa": "the and of to in is was for on that", "bb": "der die und zu den das mit von für nicht", "cc": "le la les et des un une du pour dans"}


def test_language(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(LANGUAGES[x].split(), 30)), x) for i, x in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(900, None, "aa"), (901, "", None), (902, "12 34 !!", "bb"), (903, "der " * 60_000 + "und" * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.filter("doc_id < 90"))
    got = by_id(language.predict(spark, docs, model))
    assert all(got[i]["lang_pred"] == x for i, _, x in rows[:180])
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"] and got[902]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.predict(spark, docs, language.train(docs.filter("false"))).collect()} == {"und"}


def test_language_pieces_change_nothing(spark, monkeypatch):
    text = "der und ça œuvre the " * 50

    def counts():
        total = np.zeros(language.BUCKETS, int)
        for _, codes, starts in language.pieces([text, None, "x"]):
            for bucket, _ in language.features(codes, starts):
                total += np.bincount(bucket, minlength=language.BUCKETS)
        return total

    whole = counts()
    monkeypatch.setattr(language, "PIECE", 64)
    cut = counts()
    assert (whole > 0).sum() == (cut > 0).sum()


# mixing


def fill(sizes, cap=3):
    """Targets by resharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + share * weight[s] >= cap * sizes[s]}
        if not full:
            for s in open_:
                target[s] += share * weight[s]
            break
        for s in full:
            left -= cap * sizes[s] - target[s]
            target[s] = cap * sizes[s]
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, prose(rng, int(rng.integers(0, 30))), rng.choice(["a", "b", "B", "é", None], p=[0.02, 0.1, 0.5, 0.08, 0.3])) for i in range(400)] + [(900, None, "z"), (901, " \t", "a"), (None, "null id", "b")]
    rows.append((5, "twice", rows[5][2]))
    docs = spark.createDataFrame([(i, t, None if s is None else str(s)) for i, t, s in rows], "doc_id long, text string, source string").withColumn("target", F.lit(1))
    got = [r.asDict() for r in mixing.mix(spark, docs).collect()]
    again = sorted(map(str, (r.asDict() for r in mixing.mix(spark, docs).drop("_place").collect())))
    assert again == sorted(str({k: v for k, v in r.items() if k != "_place"}) for r in got)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[None if s is None else str(s)] += len(WORD.findall(t or ""))
    want = fill(sizes)
    source = {}
    for i, _, s in rows:
        source[i] = None if s is None else str(s)
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    copies = mixing.mixed_documents(spark, docs)
    assert copies.columns == docs.columns and copies.filter("text IS NULL").count() == 0


# subwords


@pytest.fixture(scope="module")
def pieces():
    return subword.Pieces.load()


def test_encoding_without_dropout_equals_the_library(pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=subword.MODEL)
    texts = [t for _, t in corpus(2) if t is not None and "▁" not in t] + [" lead", "trail ", "a\n\nb  \n c", "<s> </s>", "\x00\x01", "𝔘𝔫𝔦"]
    got = subword.Encoder(pieces, 0.0).encode(texts, [0] * len(texts))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == sp.encode(texts)


@pytest.mark.parametrize("rate", [0.1, 0.5, 1.0])
def test_dropout_is_lossless_and_columns_equal_the_heap(pieces, rate):
    texts = [t for _, t in corpus(3)]
    encoder = subword.Encoder(pieces, rate)
    got = encoder.encode(texts, list(range(len(texts))))
    assert [None if g is None else subword.decode_ids(pieces, np.frombuffer(g, "<u4").tolist()) if t else "" for g, t in zip(got, texts, strict=True)] == texts
    units = sorted({u for t in texts if t for u in subword.UNIT.findall(" " + t) if len(u) <= subword.SHORT})
    keys = subword.unit_keys(units, 7).tolist()
    assert len(set(keys)) == len(units)
    assert subword.merge_many(pieces, units, lambda numbers, places: subword.dropped(np.array(keys, np.uint64)[numbers], places, encoder.limit)) == [np.array(subword.merge_keyed(pieces, u, k, encoder.limit), "<u4").tobytes() for u, k in zip(units, keys, strict=True)]


def test_pairs_are_found_with_one_look(pieces):
    letters = [chr(0x4E00 + i) for i in range(60)]
    dense = subword.Pieces([("<s>", 0.0, False)] * 3 + [(x, 0.0, False) for x in letters] + [(a + b, -1.0, False) for a in letters for b in letters])
    rng = np.random.default_rng(1)
    for model in (pieces, dense):
        want = {(model.ids[p[:k]], model.ids[p[k:]]): i for p, i in model.ids.items() for k in range(1, len(p)) if p[:k] in model.ids and p[k:] in model.ids}
        some = [(a, b) for a, b in rng.integers(-2, model.size, (20_000, 2)).tolist()] + [(a, b) for a in (-2, -1, 0, model.size - 1) for b in range(-2, model.size)]
        asked = np.array([*want, *some])
        hit, made = model.join(asked[:, 0], asked[:, 1])
        assert dict(zip(hit.tolist(), made.tolist(), strict=True)) == {n: want[a, b] for n, (a, b) in enumerate(map(tuple, asked.tolist())) if (a, b) in want}
        assert all(model.joined(a, b) == want.get((a, b), -1) for a, b in asked[::50].tolist())


def test_a_merge_looks_for_pairs_once(pieces, monkeypatch):
    calls, join = [], subword.Pieces.join
    monkeypatch.setattr(subword.Pieces, "join", lambda self, left, right: calls.append(len(left)) or join(self, left, right))
    word = " international"
    assert subword.merge_many(pieces, [word], lambda numbers, places: np.zeros(len(numbers), bool)) == [np.array(subword.merge_one(pieces, word, lambda place: False), "<u4").tobytes()]
    assert len(calls) <= len(word) + 1  # the first look, one for each merge and an empty one


def test_dropout_varies_with_each_occurrence(pieces):
    """A word has many segmentations, and remembered merges give what the heap gives with the same key."""
    n = 2000
    encoder = subword.Encoder(pieces, 0.1)
    word, texts = " international", ["international" + " international" * (n - 1)] * 2
    for _ in range(2):  # the second time from memory
        got = encoder.encode(texts, [5, 6])
        want = []
        for start in (5, 6):
            keys = encoder.keys([word] * n, np.full(n, start, np.uint64), np.arange(n))
            want.append([np.array(subword.merge_keyed(pieces, word, int(k), encoder.limit), "<u4").tobytes() for k in keys])
        assert got == [b"".join(w) for w in want]
    assert len(set(want[0])) > 8 and want[0] != want[1]


def test_units_and_tables():
    texts = ["", "a", " ", "a  b", "\n\n a\n b  \n", "x \n", "  lead", "tail  ", "é\u2581 🎉\n\n", "a" * 200 + " b"]
    for t in texts:
        codes = np.frombuffer(f" {t}".encode("utf-32-le"), np.uint32)
        at = subword.unit_starts(codes, np.array([0])).tolist()
        assert [f" {t}"[a:b] for a, b in zip(at, [*at[1:], len(t) + 1], strict=True)] == subword.UNIT.findall(" " + t)
    table, rng = subword.Table(4), np.random.default_rng(1)
    a, b = rng.integers(0, 50, 3000).astype(np.uint64), rng.integers(0, 1 << 40, 3000).astype(np.uint64)
    for at in range(0, 3000, 500):
        assert (table.find(a[at:], b[at:]) == -1).all()
        table.add(a[at : at + 500], b[at : at + 500], np.arange(at, at + 500))
        assert table.find(a[: at + 500], b[: at + 500]).tolist() == list(range(at + 500))


@pytest.mark.parametrize("rate", [0.1, 0.4, 0.9])
def test_remembered_states_equal_the_heap(pieces, rate):
    """Whole texts, time and again, from a memory that fills and is emptied: each unit is what its own key makes it."""
    texts = [t for _, t in corpus(5) if t]
    encoder = subword.Encoder(pieces, rate)
    for turn in range(4):
        starts = [1000 * turn + i for i in range(len(texts))]
        got = encoder.encode(texts, starts)
        for t, start, ids in list(zip(texts, starts, got, strict=True))[:: 3 if turn else 1]:
            units = subword.UNIT.findall(" " + t)
            keys = encoder.keys(units, np.full(len(units), start, np.uint64), np.arange(len(units)))
            assert ids == b"".join(np.array(subword.merge_keyed(pieces, u, int(k), encoder.limit), "<u4").tobytes() for u, k in zip(units, keys, strict=True))
        if turn == 2:
            assert encoder.children.size
            encoder.forget()


def test_epochs_are_segmented_anew(spark, pieces):
    import corpus_pipeline

    text = prose(np.random.default_rng(3), 200)
    docs = spark.createDataFrame([(1, text, "en", "a", 0)] * 3 + [(2, text, "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.encode_tokens(spark, docs, "").collect()
    assert len({tuple(r["ids"]) for r in rows}) == 4
    assert {subword.decode_ids(pieces, r["ids"]) for r in rows} == {text}


def test_dropout_varies_with_the_seed(pieces):
    text = [prose(np.random.default_rng(1), 300)]
    a, b, c, d = (subword.Encoder(pieces, 0.1, s).encode(text, [v])[0] for s, v in ((1, 0), (1, 0), (2, 0), (1, 1)))
    assert a == b and a != c and a != d
    assert len(subword.Encoder(pieces, 0.0).encode(text, [0])[0]) < len(a) < len(subword.Encoder(pieces, 1.0).encode(text, [0])[0])


def test_encode_and_decode(spark):
    rows = [*corpus(4), (None, "null id"), (3, "again"), (3, "again")]
    encoded = subword.encode(spark, frame(spark, rows), keep=("text",)).withColumnRenamed("text", "was")
    back = subword.decode(spark, encoded, keep=("doc_id", "was"))
    assert back.count() == len(rows) and back.filter("NOT (text <=> was)").count() == 0


# personal data


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t or ""):
            d = [int(x) for x in m[0] if x in "0123456789"]
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def personal_model(spark):
    return personal.train(spark)


def test_personal_data_base(spark, personal_model):
    rng = np.random.default_rng(1)
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "a@b.c@d.e", "a@b", "@x.y", "1.2.3.4", "256.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "4111111111111111", "4111 1111-1111 1111", "4111  1111 1111 1111", "5555555555554444", "1" * 25, "12-34", "+1 (555) 123-4567", "+1 555", "++49 89 123456789", "+1 (555) 123-4567 (x", "é", "🎉", "\n", " ", "-", ".", "5", "word", "4111111111111111@b.c", "+4111111111111111"]
    texts = ["".join(rng.choice(parts, int(rng.integers(1, 9)))) if i % 2 else " ".join(rng.choice(parts, int(rng.integers(1, 9)))) for i in range(300)]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "1 " * 20_000 + "@" * 100 + "a" * 20_000), (903, "+" + "1" * 30_000), (None, "a@b.c")]
    docs = frame(spark, rows)
    for r in personal.find(docs, personal_model, keep=("text",)).collect():
        want = base_spans(r["text"])
        assert [tuple(x) for x in r["base"]] == want, r["text"][:200]
        spans = [tuple(x) for x in r["spans"]]
        assert set(want) <= set(spans) and spans == sorted(spans)


GENUINE = [
    ("email", "ann.lee (at) example (dot) com", "write to {}, please"),
    ("email", "ann at mailhost dot org", "contact {} today"),
    ("email", "bob[at]site[.]net", "or {}"),
    ("email", "bob @ site.example.org", "reach me: {}"),
    ("ip", "10[.]0[.]12[.]1", "server {} is down"),
    ("ip", "192 dot 168 dot 0 dot 17", "connect to {} now"),
    ("card", "4111/1111/1111/1111", "my visa {} ok"),
    ("card", "5555_5555_5555_4444", "pay by card {}"),
    ("phone", "(555) 123-4567", "call me: {}."),
    ("phone", "555.123.4567", "tel. {} or"),
    ("phone", "0049 89 123 4567", "mobile {}"),
    ("phone", "+1 (826) 555-4081", "and {} 190.137.223.204"),
]
ALIKE = ["we met at noon. dot it", "sold at 12.50 each", "the cat at home dot 9x9", "version 1 . 2 . 3 . 4 is out", "host 300[.]1[.]2[.]3", "my visa 4111/1111/1111/1112 ok", "order 555-123-4567 shipped", "isbn 978-316-1484", "pages 123 456 7890"]


def test_personal_data_adds_what_the_patterns_miss(spark, personal_model):
    """Spelled-out and defanged data, in a table of any size; look-alikes stay."""
    rows = [(i, f.format(x)) for i, (_, x, f) in enumerate(GENUINE)] + [(100 + i, x) for i, x in enumerate(ALIKE)]
    whole = by_id(personal.find(frame(spark, rows), personal_model))
    for i, (kind, x, f) in enumerate(GENUINE):
        at = f.index("{}")
        assert (at, personal.KINDS.index(kind), at + len(x)) in [tuple(s) for s in whole[i]["spans"]], x
        assert (at, personal.KINDS.index(kind), at + len(x)) not in [tuple(s) for s in whole[i]["base"]]
    assert all(whole[100 + i]["spans"] == [] for i in range(len(ALIKE)))
    assert by_id(personal.find(frame(spark, rows[3:4]), personal_model))[3]["spans"] == whole[3]["spans"]


def test_personal_data_precision_on_unseen_examples(spark, personal_model):
    rows = spark.createDataFrame(personal.examples(2000, 99), "i int, t string, k int, s int, e int, y boolean")
    found = personal.find(rows, personal_model, "i", "t", keep=("k", "s", "e", "y")).collect()
    for kind in range(4):
        own = [(r["y"], (r["s"], kind, r["e"]) in [tuple(x) for x in r["spans"]]) for r in found if r["k"] == kind and (r["s"], kind, r["e"]) not in [tuple(x) for x in r["base"]]]
        hits = [y for y, got in own if got]
        assert np.mean(hits) >= 0.9 and sum(hits) >= 0.7 * sum(y for y, _ in own)
    assert personal.train(spark, 400) == personal.train(spark, 400)


def resolved(base, found):
    """What unhit and best_of make of found (s, k, e, p), one after another."""
    free = sorted(c for c in found if not any(b[0] < c[2] and c[0] < b[2] for b in base))
    out, held = [], None
    for c in sorted(free, key=lambda c: (c[0], c[2], c[1], c[3])):
        if held is None or c[0] >= held[2]:
            out += [held] if held else []
            held = c
        elif (c[3], c[2] - c[0]) > (held[3], held[2] - held[0]):
            held = c
    return out + ([held] if held else [])


def test_personal_spans_are_resolved_in_order(spark, monkeypatch):
    monkeypatch.setattr(personal, "CHUNK", 3)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        spans = [(int(s), int(rng.integers(0, 4)), int(s + rng.integers(1, 9))) for s in rng.integers(0, 120, int(rng.integers(0, 40)))]
        n = int(rng.integers(0, len(spans) + 1))
        rows.append((i, sorted(spans[:n]), [(s, k, e, float(rng.integers(0, 5))) for s, k, e in spans[n:]]))
    df = spark.createDataFrame(rows, "i int, base array<struct<s:int,k:int,e:int>>, found array<struct<s:int,k:int,e:int,p:double>>")
    got = df.select("i", personal.best_of(personal.unhit(F.col("base"), F.col("found"))).alias("x")).collect()
    for r in got:
        _, base, found = rows[r["i"]]
        assert [(x["s"], x["k"], x["e"], x["p"]) for x in r["x"]] == [tuple(c) for c in resolved(base, found)]


@pytest.mark.parametrize(("text", "n"), [("a@b" + ".c" * 200_000, 1), ("a@b.c " * 50_000, 50_000), ("write ann at mailhost dot org, " * 10_000, 10_000), ("1.2.3.4 +4111 " * 5_000, 5_000)], ids=["labels", "addresses", "spelled", "mixed"])
def test_personal_data_of_long_texts(spark, personal_model, text, n):
    row = personal.redact(personal.find(frame(spark, [(1, text)]), personal_model, keep=("text",)), "text").collect()[0]
    assert len(row["spans"]) == n and row["text"].count("[") == n


def test_redaction(spark):
    found = spark.createDataFrame([("x a@b.c y 1.2.3.4", [(2, 0, 7), (10, 1, 17)]), ("none", []), (None, [])], "text string, spans array<struct<s:int,k:int,e:int>>")
    assert [r["text"] for r in personal.redact(found, "text").collect()] == ["x [email] y [ip]", "none", None]


# vectors


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + 0.05 * rng.normal(size=16) * (i >= 40)).tolist()) for i in range(160)]
    rows += [(200, rows[3][1]), (201, [2 * x for x in rows[3][1]]), (202, None), (203, [0.0] * 16), (204, [float("nan")] * 16), (205, [1.0, None] + [0.0] * 14), (206, [float("inf")] * 16), (207, [1.0, 2.0]), (208, []), (3, rows[3][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"node": F.lit(1), "v": F.lit(2), "label": F.lit(None)})
    good = {n: np.array(v) / np.linalg.norm(v) for n, (i, v) in enumerate(rows) if v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    ids = [i for i, _ in rows]
    near = {a: [b for b in good if b != a and good[a] @ good[b] >= 0.9] for a in good}
    want = groups_of([(ids[a], ids[b]) for a in near for b in near[a] if ids[a] != ids[b]], set(ids))
    got = vectors.near_vectors(spark, table).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for n in range(len(rows)):
        by[ids[n]].append(len(near.get(n, [])))
    assert {r["vec_id"]: r["n_links"] for r in got} == {i: x[0] for i, x in by.items()}
    assert all(r["component_id"] == want[r["vec_id"]] and r["kept"] == (r["vec_id"] == want[r["vec_id"]]) for r in got)


def test_graph_reaches_all_and_search_finds_what_is_near(monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(3):
        c = rng.normal(size=(20, 24))
        x = c[rng.integers(0, 20, 300)] + 0.05 * rng.normal(size=(300, 24))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links = vectors.graph(x, 1)
        sims = x @ x.T
        computed = []
        monkeypatch.setattr(vectors, "cosines", lambda q, x, rows, cols, of=vectors.cosines: computed.append(len(rows)) or of(q, x, rows, cols))
        rows, cols, cos = vectors.search(x, x, links.astype(np.int64), vectors.medoid(x), 12)
        monkeypatch.undo()
        assert np.allclose(cos, sims[rows, cols]) and len(set(zip(rows.tolist(), cols.tolist(), strict=True))) == len(rows)
        seen = np.zeros(sims.shape, bool)
        seen[rows, cols] = True
        own = seen[np.arange(300), np.arange(300)]
        near = sims >= 0.9
        assert own.mean() > 0.9 and (seen & near)[own].sum() >= 0.99 * near[own].sum()
        assert sum(computed) < 0.8 * sims.size  # only what is visited


def test_vectors_of_several_dimensions(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.99, 0.05]), (3, [1.0, 0.0, 0.0]), (4, [0.9, 0.1, 0.0]), (5, [0.0, 0.0, 1.0]), (6, [1.0]), (7, [1.0, 0.0, 0.0, 0.0])]
    got = by_id(vectors.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vec_id")
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6), 7: (0, 7)}


def test_audit_looks_for_links(spark):
    """Where links are rare the audit asks more; missing ones lower the recall."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 12))
    x[1400:] = x[:100] + 0.01 * rng.normal(size=(100, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, 1, bytes(v.tobytes())) for i, v in enumerate(x)], "node long, mult long, v binary")
    links = (x @ x.T >= 0.9).sum(1) - 1
    found = spark.createDataFrame([(i, int(n), i) for i, n in enumerate(links)], "node long, n_links long, root long")
    assert vectors.audit(nodes, found, 16) == 1
    assert vectors.audit(nodes, found.filter("node < 50 OR node >= 1400"), 16) < 0.9


def test_vector_blocks_of_large_shards(spark, monkeypatch):
    """Shards of more than a block give the same links."""
    monkeypatch.setattr(vectors, "SHARD", 40)
    monkeypatch.setattr(vectors, "CENTRES", 2)
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(30, 8)), 5, 0) + 0.03 * rng.normal(size=(150, 8))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    got = by_id(vectors.near_vectors(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")), "vec_id")
    found = np.array([got[i]["n_links"] for i in range(150)])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()


def test_catalogue():
    assert [n.split("_")[0] for n in catalogue.queries()] == [f"op{i}" for i in range(1, 11)]
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert list(shingles.shingle_sets([b"", b"A b", b"a B"], 5))[0].size == 0


CLASHING = ("_copy", "_copies", "_place", "_metadata", "_gone", "_id", "_k0", "_t", "_f", "score", "kept", "taken", "size", "keep_id", "component_id", "digest", "node", "bucket")


@pytest.mark.parametrize("stored", [False, True])
def test_stages_keep_columns_of_any_name(spark, tmp_path, stored):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    text = prose(np.random.default_rng(8), 30)
    rows = [(1, text, "a"), (2, text, "a"), (2, text, "a"), (None, "null id", None), (3, None, "a"), (4, "other words " * 9, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce("source", F.lit("none"))) for c in CLASHING})
    if stored:
        docs.write.parquet(str(tmp_path / "docs.parquet"))
        docs = spark.read.parquet(str(tmp_path / "docs.parquet"))
    stages = {
        "quality": (lambda d: quality.kept_documents(spark, d, str(tmp_path)), 6),
        "exact": (lambda d: exact_dedup.kept_documents(spark, d), 4),
        "near": (lambda d: near_dedup.kept_documents(spark, d), 4),
        "mix": (lambda d: mixing.mixed_documents(spark, d), None),
    }
    for name, (stage, n) in stages.items():
        got = stage(docs)
        assert got.columns == docs.columns
        found = got.collect()
        assert (len(found) == n if n else len(found) >= 5), name
        assert all(r[c] == f"{c} of {r['source'] or 'none'}" for r in found for c in CLASHING)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "abc", x) for i, x in enumerate("xyz")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="3 languages"):
        language.train(docs)
    assert language.train(docs.filter("lang != 'z'"))[0] == ["x", "y"]


def thue_morse(n):
    """Two words of 2 ** n letters that polynomial hashes modulo 2 ** 64 can't tell apart."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [5, 10, 13])
def test_words_of_equal_structure_differ(spark, n):
    a, b = thue_morse(n)
    h = shingles.word_hashes([f"{a} {b} {a}".encode(), f"{a.upper()} {b}".encode()], lower=True)[0]
    assert h[0] == h[2] == h[3] and h[1] == h[4] and h[0] != h[1]
    rows = [(1, " ".join([a] * 30)), (2, " ".join([b] * 30)), (3, " ".join([a, b] * 15)), (4, " ".join([b, a] * 15))]
    near = by_id(near_dedup.near_dedup(spark, frame(spark, rows)))
    assert [near[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 2, 3, 3]
    assert [by_id(passage_dedup.passage_dedup(spark, frame(spark, rows)))[i]["n_removed"] for i in (1, 2, 3, 4)] == [0, 0, 0, 30]


def test_letters_of_equal_structure_differ(spark):
    a, b = thue_morse(7)
    rows = [(1, f"x{a}"), (2, f"x{b}"), (3, f"y{a}{b}"), (4, f"z{b}{b}")]
    want, seen = {}, set()
    for i, t in rows:
        gone = [False] * len(t)
        for j in range(len(t) - 99):
            if t[j : j + 100] in seen:
                gone[j : j + 100] = [True] * 100
            seen.add(t[j : j + 100])
        want[i] = sum(gone)
    got = by_id(substring_dedup.substring_dedup(spark, frame(spark, rows)))
    assert {i: r["n_removed"] for i, r in got.items()} == want


def test_near_dedup_of_a_template(spark):
    """Documents made of one template are alike, but not enough; planted copies among them are found, all of them."""
    rng = np.random.default_rng(21)
    base = prose(rng, 150).split()
    rows, pairs = [], []
    for i in range(1000):
        w = base.copy()
        for at in rng.choice(np.arange(2, 148), 7, replace=False):
            w[at] = f"t{i}x{at}"
        rows.append((i, " ".join(w)))
        if i % 3 == 0:
            w = w.copy()
            w[int(rng.integers(0, 150))] = "copied"
            rows.append((10_000 + i, " ".join(w)))
            pairs.append((i, 10_000 + i))
    sets = {i: shingle_set(t) for i, t in rows}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    asked = [i for i in sets if i % 20 == 0]  # the recall of links, against all rows
    links = []
    for i in asked:
        same = collections.Counter(j for x in sets[i] for j in holders[x] if j != i)
        links += [(i, j) for j, n in same.items() if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n)]
    got = {i: r["component_id"] for i, r in by_id(near_dedup.near_dedup(spark, frame(spark, rows, extra=False))).items()}
    linked = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(linked) > 300 and len(links) >= 15
    assert all(got[a] == got[b] for a, b in linked + links)
    assert len(set(got.values())) > 500
