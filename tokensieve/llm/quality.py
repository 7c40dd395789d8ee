"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are column expressions. Shallow trees are grown by boosting on a bounded sample of labelled rows; every
path from a root is a rule, a conjunction of comparisons; a lasso logistic regression weighs the rules and drops
most. What remains is compiled into one column expression, so scoring is a projection of the scan: no shuffle, no
Python on the executors.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokensieve.llm import common
from tokensieve.llm.language import remainder

#: Labelled rows used for fitting, at most; those whose hashed id is least.
TRAIN_ROWS = 20_000
TREES, DEPTH, STEP, CUTS = 24, 3, 0.3, 24
LASSO = 0.002
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; null counts as empty, and every ratio of an empty text is 0."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    words = F.filter(F.split(F.translate(t, "\t\n\x0b\f\r", "     "), " "), lambda w: w != "")
    lines = F.split(t, "\n")

    def without(chars: str) -> Column:
        return n - F.length(F.translate(t, chars, ""))

    return {
        "n_chars": n,
        "_words": words,
        "_lines": lines,
        "n_upper": without(common.UPPER),
        "n_digit": without("0123456789"),
        "n_stop": without(".,;:'\"?()-"),
        "n_mark": without("!#$%&*+/<=>@[\\]^_`{|}~"),
        "n_bar": n - F.length(F.replace(t, F.lit("|"), F.lit(""))),
        "n_shout": n - F.length(F.replace(t, F.lit("!"), F.lit(""))),
    }


RATIOS = {
    "chars": lambda c: F.log1p(c["n_chars"]),
    "words": lambda c: F.log1p(c["n_words"]),
    "word_length": lambda c: ratio(c["n_chars"], c["n_words"]),
    "distinct_words": lambda c: ratio(c["n_distinct"], c["n_words"]),
    "distinct_growth": lambda c: ratio(F.log1p(c["n_distinct"]), F.log1p(c["n_words"])),
    "distinct_lines": lambda c: ratio(c["n_distinct_lines"], c["n_lines"]),
    "words_per_line": lambda c: F.log1p(ratio(c["n_words"], c["n_lines"])),
    "upper": lambda c: ratio(c["n_upper"], c["n_chars"]),
    "digits": lambda c: ratio(c["n_digit"], c["n_chars"]),
    "stops": lambda c: ratio(c["n_stop"], c["n_words"]),
    "marks": lambda c: ratio(c["n_mark"], c["n_chars"]),
    "bars": lambda c: ratio(c["n_bar"], c["n_words"]),
    "shouts": lambda c: ratio(c["n_shout"], c["n_words"]),
}


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_features(docs: DataFrame, text_col: str) -> DataFrame:
    """docs without text_col and with _f, a struct of the features."""
    rest = [F.col(c) for c in docs.columns if c != text_col]
    counted = docs.select(*rest, *(c.alias(f"_s_{k}") for k, c in statistics(F.col(text_col)).items()))
    sizes = {
        "n_words": F.size("_s__words"),
        "n_distinct": F.size(F.array_distinct("_s__words")),
        "n_lines": F.size("_s__lines"),
        "n_distinct_lines": F.size(F.array_distinct("_s__lines")),
    }
    counted = counted.select("*", *(c.alias(f"_s_{k}") for k, c in sizes.items()))
    columns = {k.removeprefix("_s_"): F.col(k) for k in counted.columns if k.startswith("_s_")}
    return counted.select(*rest, F.struct(*(f(columns).alias(k) for k, f in RATIOS.items())).alias("_f"))


Rule = tuple[tuple[int, bool, float], ...]  # (feature, above the cut?, cut), sorted


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > cut) == above for f, above, cut in rule])


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, path: Rule = ()) -> tuple[np.ndarray, list[Rule]]:
    """A regression tree for gradients g and curvatures h: its values on x and the path to every node."""
    leaf = np.full(len(x), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(x) < 40:
        return leaf, []
    base, best = g.sum() ** 2 / (h.sum() + 1.0), (1e-6, -1, 0.0)
    for f, at in enumerate(cuts):
        if not len(at):
            continue
        bin_of = np.searchsorted(at, x[:, f], side="left")  # x > at[i] iff bin > i
        gs, hs, ns = (np.bincount(bin_of, w, len(at) + 1).cumsum()[:-1] for w in (g, h, np.ones(len(x))))
        gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - base
        gain[(ns < 10) | (len(x) - ns < 10)] = 0
        if gain.max() > best[0]:
            best = (gain.max(), f, float(at[gain.argmax()]))
    if best[1] < 0:
        return leaf, []
    up, rules = x[:, best[1]] > best[2], []
    for above in (False, True):
        here = (*path, (best[1], above, best[2]))
        side = up == above
        leaf[side], below = grow(x[side], g[side], h[side], cuts, depth - 1, here)
        rules += [tuple(sorted(here)), *below]
    return leaf, rules


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient; the intercept is free."""
    w, b, v, vb, t = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0, 1.0
    probe = np.ones(z.shape[1])
    for _ in range(30):  # the greatest eigenvalue, by power iteration
        probe = z.T @ (z @ probe) / len(z)
        norm = np.linalg.norm(probe)
        probe /= max(norm, 1e-12)
    rate = 1 / (0.25 * (norm + 1) + 1e-9)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ v + vb))) - y
        u = v - rate * (z.T @ r / len(z))
        new, nb = np.sign(u) * np.maximum(np.abs(u) - rate * penalty, 0), vb - rate * r.mean()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return w, b


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> tuple[list[tuple[Rule, float]], float]:
    """([(rule, weight)], intercept) from features and labels 0/1."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return [], math.log(rate / (1 - rate))
    rng = np.random.default_rng(seed)
    cuts = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1]))
        q = np.union1d(q, np.unique(np.quantile(x[y < y.mean(), f], np.linspace(0, 1, CUTS + 2)[1:-1])))
        cuts.append(np.array([float(f"{v:.4g}") for v in q]))
    score, rules = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        use = rng.random(len(y)) < 0.6
        _, paths = grow(x[use], (y - p)[use], (p * (1 - p))[use], cuts, DEPTH)
        rules.update(paths)
        value, _ = grow(x, y - p, p * (1 - p), cuts, DEPTH)
        score += STEP * value
    names = sorted(rules)
    z = np.array([holds(r, x) for r in names], float).T.reshape(len(y), len(names))
    keep = (z.mean(0) > 0.002) & (z.mean(0) < 0.998)
    z, names = z[:, keep], [r for r, k in zip(names, keep, strict=True) if k]
    spread = z.std(0)
    w, b = lasso((z - z.mean(0)) / spread, y, LASSO)
    w = w / spread
    b -= float((w * z.mean(0)).sum())
    return [(r, float(a)) for r, a in zip(names, w, strict=True) if abs(a) > 1e-9], b


def compiled(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The probability of label 1, over the struct _f."""
    names = list(RATIOS)
    total = F.lit(float(intercept))
    for rule, weight in rules:
        terms = [(F.col(f"_f.{names[f]}") > cut) if above else (F.col(f"_f.{names[f]}") <= cut) for f, above, cut in rule]
        both = terms[0]
        for t in terms[1:]:
            both = both & t
        total = total + F.when(both, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_ROWS) -> tuple[list[tuple[Rule, float]], float]:
    """Fit on at most `most` labelled rows. labels: (id_col, label_col); rows with a null in either are left out.

    Labels that name no document are ignored; repeated labels count as often as they stand there. The sample's ids
    are broadcast: its size is bounded.
    """
    some = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).dropna().orderBy(F.xxhash64("_id"), "_id", "_y").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(some), "_id").select("_y", "_id", "_t")
    table = with_features(rows, "_t").select("_id", "_y", "_f.*").toPandas()
    table = table.sort_values(list(table.columns)).drop(columns="_id").to_numpy(dtype=float)  # at most `most` rows for each id
    return fit(table[:, 1:], table[:, 0]) if len(table) else ([], 0.0)


def score(docs: DataFrame, model: tuple[list[tuple[Rule, float]], float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns of keep and score for each row of docs; null and empty texts are scored like any other.

    Without any labelled row every score is 0.5. An empty table gives an empty result.
    """
    rows = docs.select(id_col, *keep, F.col(text_col).alias("_t"))
    return with_features(rows, "_t").select(id_col, *keep, compiled(*model).alias("score"))


def model_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[list[tuple[Rule, float]], float]:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder(F.col("doc_id"), 5) != 0)
    return train(docs, labels)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    scored = score(docs, model_of(spark, docs, sf_dir))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts; the columns stay, whatever their names.

    Null and empty texts are scored like any other, repeated rows alike; null ids are scored too and never learned from.
    An empty table gives an empty result.
    """
    model = model_of(spark, docs, sf_dir)
    plain, names = common.renamed(docs)
    plain = plain.withColumns({"_id": F.col(names["doc_id"]), "_copy": F.col(names["text"])})
    scored = score(plain, model, "_id", "_copy", keep=tuple(names.values()))
    return common.restored(scored.filter(F.col("score") >= THRESHOLD), names)
