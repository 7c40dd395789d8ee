"""Personal data: candidate spans, boosted trees over their format and context, calibrated thresholds.

Base spans are those of the fixed patterns that pass their checks; they always stay. High-recall generators propose
further, overlapping spans: addresses spelled out, defanged numbers, cards with odd separators, numbers without a
country code. A candidate is described by its format (how it is written, how many digits, whether it passes its kind's
check once its separators are undone) and its context (cue words before it, the characters beside it). Boosted trees
score it; it is added if its score reaches the threshold of its kind.

The trees learn from EXAMPLES written-out phrases with known answers, genuine ones and look-alikes in all formats, not
from what the base patterns find; a quarter of them is held out and sets the thresholds by score bin. So what a text
gets depends on that text alone, in any table, and nothing is gathered from the corpus.

Everything that touches rows is a DataFrame expression: texts are scanned once, without a shuffle, all spans of a text
stay in one row as arrays, and the work is linear in their number.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokensieve.llm import common

#: Fixed values of the contract. The patterns match what the contract's do, without backtracking over long runs:
#: an address starts where a run of its characters starts, or where the last match ended; a card number is a whole
#: run of digits with single separators.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Whether a text can hold a kind at all; most texts can't.
CHEAP = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{2}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]"}

_AT = r"(?:\x20?@\x20?|(?i:\x20?[(\[{]at[)\]}]\x20?|\x20at\x20))"
_DOT = r"(?:\.|\[\.\]|\(\.\)|(?i:\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20))"
_POINT = r"(?:\.|\[\.\]|\(\.\)|\x20\.\x20|(?i:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20))"
#: Generators: (kind of the spans, whether a text can hold any, pattern). Wider than the base patterns, and overlapping.
GENERATORS = (
    ("email", rf"@|(?i:[(\[{{]at[)\]}}])|\x20(?i:at)\x20[A-Za-z0-9-]{{1,63}}(?:[\[(]?\.[\])]?[A-Za-z0-9]|(?i:\x20?[(\[{{]dot|\x20dot\x20))", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}"),
    ("ip", rf"[0-9]{_POINT}[0-9]", rf"(?<![0-9])[0-9]{{1,3}}(?:{_POINT}[0-9]{{1,3}}){{3}}(?![0-9])"),
    ("card", r"[0-9](?:[\x20./_-]{0,2}[0-9]){11}", r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){11,18}(?![0-9])"),
    ("phone", r"[0-9][)\x20./-]{1,2}[0-9]{3}", r"(?<![0-9+])(?:(?:\+|00)?[0-9]{1,3}[\x20.(/-]{1,2}|\((?=[0-9]{2,4}\)))?[0-9]{2,4}[)\x20./-]{1,2}[0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9])"),
)
#: Words before a span that speak for its kind, and words that speak for something else.
CUES = {
    "email": r"mail|contact|write|reach|address|correo|courriel|schreib",
    "ip": r"\bip\b|server|host|address|gateway|router|\bdns\b|connect|login",
    "card": r"card|visa|master|amex|credit|debit|payment|karte|tarjeta|carte",
    "phone": r"phone|\btel|call|mobil|cell|\bfax|dial|ring|handy|m[oó]vil|appel",
}
OTHER = r"order|invoice|version|section|chapter|isbn|ref\b|serial|track|score|page|\bpart|model|rows?\b|\bno\b"
#: Characters of context on either side.
CONTEXT = 24

#: Features of a candidate and their numbers of bins.
BINS = {"generator": len(GENERATORS), "form": 4, "valid": 2, "digits": 6, "cue": 4, "mark": 3, "before": 4, "after": 4}
ROUNDS, STEP, DEPTH = 30, 0.4, 3
#: Phrases to learn from, the share held out, and the precision that every score bin above a threshold has there.
EXAMPLES, HELD_OUT, PRECISION, SCORE_BINS = 6000, 0.25, 0.9, 20
#: Spans handled by one step of a scan.
CHUNK = 128

_FOUND = "array<struct<s:int,e:int,m:string,b:string,a:string>>"
_SPANS = "array<struct<s:int,k:int,e:int>>"
_CAND = "array<struct<s:int,k:int,e:int,f:struct<" + ",".join(f"{b}:int" for b in BINS) + ">>>"
_NEVER = (1 << 31) - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: what a lambda refers to is computed again for each element otherwise."""
    return F.transform(F.array(value), use)[0]


def scan(items: Column, state: Column, step: Callable[[Column, Column], Column], state_type: str, out_type: str) -> Column:
    """The `out` of step(state, item) for each item in order; step gives a struct (state, out).

    Arrays grow by copying, so results are gathered in chunks of CHUNK: the work is linear but for n / CHUNK squared.
    """

    def run(items: Column, state: Column, step: Callable[[Column, Column], Column], out_type: str) -> Column:
        zero = F.struct(state.cast(state_type).alias("state"), F.array().cast(f"array<{out_type}>").alias("out"))
        return F.aggregate(items, zero, lambda acc, x: let(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out"))))

    def whole(items: Column) -> Column:
        last = F.floor((F.size(items) - 1) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda c: F.slice(items, c * CHUNK + 1, CHUNK))
        return F.flatten(run(chunks, state, lambda s, part: run(part, s, step, out_type), f"array<{out_type}>")["out"])

    return let(items, whole)


def spans(text: Column, pattern: str, context: bool = False) -> Column:
    """The matches as (s, e, m, b, a): 0-based code points, end exclusive, and what stands before and after if asked for."""

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        edge = (lambda g: F.right(g, F.lit(CONTEXT))) if context else (lambda g: F.lit(""))
        after = (lambda g: F.left(g, F.lit(1))) if context else (lambda g: F.lit(""))
        beside = let(gaps, lambda gaps: F.zip_with(gaps, F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))), lambda g, nxt: F.struct(F.length(g).alias("n"), edge(g).alias("b"), after(F.coalesce(nxt, F.lit(""))).alias("a"))))
        both = F.slice(F.zip_with(beside, found, lambda g, m: F.struct(g["n"].alias("n"), m.alias("m"), g["b"].alias("b"), g["a"].alias("a"))), 1, F.size(found))

        def step(at: Column, x: Column) -> Column:
            start = at + x["n"]
            end = start + F.length(x["m"])
            return F.struct(end.alias("state"), F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a")).alias("out"))

        return scan(both, F.lit(0), step, "int", _FOUND[6:-1])

    none = F.array().cast(_FOUND)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def n_digits(m: Column) -> Column:
    return F.length(m) - F.length(F.translate(m, "0123456789", ""))


def luhn(m: Column) -> Column:
    """Whether the digits of m pass the check sum."""

    def of(d: Column) -> Column:
        def value(i: Column) -> Column:
            x = F.substring(d, i, F.lit(1)).cast("int")
            twice = x * 2
            return F.when(i % 2 == 1, x).when(twice > 9, twice - 9).otherwise(twice)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), lambda acc, i: acc + F.coalesce(value(i), F.lit(0))) % 10 == 0

    return let(F.reverse(F.regexp_replace(m, "[^0-9]", "")), of)


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return n_digits(m).between(12, 19) & luhn(m)
    if kind == "phone":
        return n_digits(m).between(9, 15)
    return F.lit(True)


def with_base(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with _base, array<struct<s, k, e>>: the valid base spans by kind, k being the kind's number."""
    t = F.col(text_col)

    def of(k: int, kind: str) -> Column:
        hint = t.contains("@") if kind == "email" else t.rlike(CHEAP[kind])
        kept = F.filter(spans(t, BASE[kind]), lambda x: valid(kind, x["m"]))
        some = F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
        return F.when(hint, some).otherwise(F.array().cast(_SPANS))

    return docs.withColumn("_base", F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def features(g: int, x: Column) -> Column:
    """The binned features of a candidate x = (s, e, m, b, a) of generator g."""
    kind, m = GENERATORS[g][0], x["m"]
    number = lambda c: F.when(c, 1).otherwise(0)

    def side(c: Column) -> Column:
        return F.when(c == "", 0).when(c.rlike(r"[\s,.;:!?()|]"), 1).when(c.rlike("[A-Za-z0-9]"), 2).otherwise(3)

    plain = F.regexp_replace(F.regexp_replace(F.lower(m), _AT, "@"), _DOT if kind == "email" else _POINT, ".") if kind in ("email", "ip") else m
    if kind == "email":
        form = F.when(m.contains("@"), number(m.contains(" "))).when(m.rlike(r"[(\[{]"), 2).otherwise(3)
        fine, mark = plain.rlike(r"^[a-z0-9._%+-]*[a-z0-9]@(?:[a-z0-9-]+\.)+[a-z]{2,24}$"), F.when(plain.rlike(r"\.(?:com|org|net|edu|gov|info|io)$"), 2).otherwise(number(plain.rlike(r"\.[a-z]{2}$")))
    elif kind == "ip":
        form = F.when(~m.rlike(r"[^0-9.]"), 0).when(m.rlike(r"[\[(]"), 2).when(m.rlike("(?i)dot"), 3).otherwise(1)
        fine, mark = valid("ip", plain), number(plain.startswith("10.") | plain.startswith("192.168.") | plain.startswith("127."))
    elif kind == "card":
        form = F.when(~m.rlike(r"[^0-9]"), 0).when(~m.rlike(r"[^0-9][^0-9]|[^0-9\x20-]"), 1).when(m.rlike(r"[^0-9][^0-9]"), 3).otherwise(2)
        fine, mark = valid("card", m), number(m.rlike("^[3-6]"))
    else:
        form = F.when(m.startswith("+"), 0).when(m.contains("("), 1).when(m.startswith("00"), 2).otherwise(3)
        fine, mark = n_digits(m).between(9, 15), number(m.rlike("^0|[)]"))
    n, before = n_digits(m), F.lower(x["b"])
    return F.struct(
        F.lit(g).alias("generator"),
        form.alias("form"),
        number(fine).alias("valid"),
        F.when(n == 0, 0).when(n < 9, 1).when(n < 12, 2).when(n < 16, 3).when(n == 16, 4).otherwise(5).alias("digits"),
        (number(before.rlike(CUES[kind])) + 2 * number(before.rlike(OTHER))).alias("cue"),
        mark.alias("mark"),
        side(F.right(x["b"], F.lit(1))).alias("before"),
        side(x["a"]).alias("after"),
    )


def with_candidates(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with _cand: array<struct<s, k, e, f>> of the proposals of all generators."""
    t = F.col(text_col)

    def of(g: int, kind: str, hint: str, pattern: str) -> Column:
        some = F.transform(spans(t, pattern, context=True), lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), features(g, x).alias("f")))
        return F.when(t.rlike(hint), some.cast(_CAND)).otherwise(F.array().cast(_CAND))

    return docs.withColumn("_cand", F.concat(*(of(g, *x) for g, x in enumerate(GENERATORS))))


def _with_check_digit(rng: random.Random, first: str, n: int, right: bool) -> str:
    digits = [int(first)] + [rng.randrange(10) for _ in range(n - 2)]
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
    return "".join(map(str, digits)) + str((-total + (0 if right else rng.randrange(1, 10))) % 10)


def examples(n: int = EXAMPLES, seed: int = 17) -> list[tuple[int, str, int, int, int, bool]]:
    """(number, phrase, kind, start, end, genuine) of written-out phrases: each holds one span of its kind or a look-alike.

    Genuine and look-alike share the formats; what tells them apart is the check, the cue words, the ending. A bare
    number in the form of a phone number, without any cue, is either, evenly.
    """
    rng = random.Random(seed)
    syllables = "ba ce di fo gu ha ki le mo nu pra ste vil zon".split()
    pick = rng.choice

    def word() -> str:
        return "".join(pick(syllables) for _ in range(rng.randint(1, 3)))

    def number(most: int) -> str:
        return str(rng.randint(0, most))

    def email(genuine: bool) -> tuple[str, str]:
        at = pick(["@", " @ ", "(at)", " (at) ", "[at]", " [at] ", " at ", "{at}", " AT ", "[AT]"])
        dot = pick([".", "[.]", " dot ", "(dot)", "[dot]", " [dot] ", " DOT "]) if at != "@" else "."
        if genuine:
            parts = [word() + pick(["", f".{word()}", number(99)]), word() + pick(["", f"-{word()}"]), pick("com org net edu info io de fr es uk".split())]
            return pick(["write to", "contact", "e-mail:", "mail me,", "reach me", "", "", ""]), parts[0] + at + dot.join(parts[1:])
        if rng.random() < 0.5:  # prices, places and times after "at"
            return pick(["", "sold", "we met", OTHER.split("|")[0]]), f"{word()}{pick([' @ ', ' at '])}{number(99)}.{number(99)}"
        return pick(["", "we look", "the"]), f"{word()} at {word()}{pick([' dot ', '.'])}{number(9)}{word()}{number(9)}"

    def ip(genuine: bool) -> tuple[str, str]:
        point = pick([".", "[.]", "(.)", " . ", " dot ", "[dot]", " [dot] "])
        if genuine:
            return pick(["server", "the host", "ip", "connect to", "address", "", "seen at"]), point.join(number(255) for _ in range(4))
        if rng.random() < 0.6:
            return pick(["version", "section", "chapter", "score", "rows", "part"]), pick([" . ", " dot ", "."]).join(number(12) for _ in range(4))
        return pick(["", "server", "about"]), point.join([number(255), str(rng.randint(256, 999)), number(255), number(255)])

    def card(genuine: bool) -> tuple[str, str]:
        size = pick([16, 16, 16, 15, 19])
        digits = _with_check_digit(rng, pick("3456") if genuine else pick("0123456789"), size, genuine or rng.random() < 0.1)
        separator = pick(["", " ", "-", ".", "/", "_", "  ", " - "[:2]])
        at = pick([[4, 8, 12], [4, 8, 12], [4, 10]])
        text = separator.join(digits[a:b] for a, b in zip([0, *at], [*at, size], strict=True))
        return pick(["card", "visa", "pay by card", "credit card no", "", ""]) if genuine else pick(["order", "invoice", "tracking", "serial", "", "", "", "card"]), text

    def phone(genuine: bool) -> tuple[str, str]:
        a, b, c = (f"{rng.randint(200, 999)}" for _ in range(3))
        d = f"{rng.randint(1000, 9999)}"
        bare = pick([f"{a}-{b}-{d}", f"{a} {b} {d}", f"{a}.{b}.{d}"])
        if genuine:
            marked = pick([f"({a}) {b}-{d}", f"0049 {a[:2]} {b} {d}", f"0{a}/{b} {d}"])
            if rng.random() < 0.3:
                return pick(["phone", "and", "", ""]), f"+{pick(['1', '44', '49'])} {pick([f'({a})', a])} {b}{pick(' -')}{d}"
            return pick(["phone", "tel.", "call me:", "mobile", "my cell", "fax"]), pick([bare, marked])
        if rng.random() < 0.3:
            return "", bare
        return pick(["order", "invoice", "isbn", "ref", "serial", "page", "model", "tracking", ""]), pick([bare, f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}/{b}/{d}"])

    out = []
    for i in range(n):
        k, genuine = i % len(KINDS), rng.random() < 0.5
        cue, span = (email, ip, card, phone)[k](genuine)
        head = " ".join([*(word() for _ in range(rng.randint(4, 7))), *([cue] if cue else [])]) + pick([" ", " ", ": ", " ("])
        tail = pick([" ", ". ", ", ", ") ", "\n"]) + word()
        out.append((i, head + span + tail, k, len(head), len(head) + len(span), genuine))
    return out


Tree = float | tuple[str, int, "Tree", "Tree"]  # a value, or (feature, bin, if it is that bin, otherwise)
Model = tuple[float, list[Tree], list[float]]  # first score, trees, threshold by kind


def _tree(rows: list[dict], depth: int) -> Tree:
    g, h = sum(r["g"] for r in rows), sum(r["h"] for r in rows)
    leaf, best = STEP * g / (h + 1.0), (1e-3, None, 0)
    if depth:
        for b, v in ((b, v) for b in BINS for v in range(BINS[b])):
            gl, hl = (sum(r[k] for r in rows if r[b] == v) for k in ("g", "h"))
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            if gain > best[0] and any(r[b] == v for r in rows) and any(r[b] != v for r in rows):
                best = (gain, b, v)
    if best[1] is None:
        return leaf
    _, b, v = best
    return (b, v, _tree([r for r in rows if r[b] == v], depth - 1), _tree([r for r in rows if r[b] != v], depth - 1))


def _value(tree: Tree, row: dict) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] == tree[1] else tree[3]
    return tree


def score_of(start: float, trees: list[Tree], row: dict) -> float:
    return start + sum(_value(t, row) for t in trees)


def probability(score: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))


def boost(table: list[dict]) -> tuple[float, list[Tree]]:
    """(first score, trees) for rows with features, n and hits."""
    n, hits = sum(r["n"] for r in table), sum(r["hits"] for r in table)
    if not n:
        return 0.0, []
    start = math.log((hits + 0.5) / (n - hits + 0.5))
    score, trees = [start] * len(table), []
    for _ in range(ROUNDS):
        for r, s in zip(table, score, strict=True):
            p = probability(s)
            r["g"], r["h"] = r["hits"] - r["n"] * p, r["n"] * p * (1 - p)
        trees.append(_tree(table, DEPTH))
        score = [s + _value(trees[-1], r) for s, r in zip(score, table, strict=True)]
    return start, trees


def threshold(rows: list[tuple[float, int, int]]) -> float:
    """The least score from which on every score bin is genuine at PRECISION, of held-out (score, n, hits); or infinity.

    Bins are of equal width in probability; one without any row says nothing.
    """
    bins = [[0, 0] for _ in range(SCORE_BINS)]
    for s, n, hits in rows:
        at = bins[min(SCORE_BINS - 1, int(probability(s) * SCORE_BINS))]
        at[0], at[1] = at[0] + n, at[1] + hits
    least = math.inf
    for i in range(SCORE_BINS - 1, -1, -1):
        n, hits = bins[i]
        if n and hits < PRECISION * n:
            break
        if n:
            least = math.log(i / (SCORE_BINS - i)) if i else -math.inf
    return least


def train(spark: SparkSession, n: int = EXAMPLES, seed: int = 17) -> Model:
    """Trees from three quarters of the examples, thresholds from the rest; nothing but n rows is read."""
    written = json.dumps([{"t": t, "k": k, "s": s, "e": e, "y": y, "held": i % 97 / 97 < HELD_OUT} for i, t, k, s, e, y in examples(n, seed)])
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(written), "array<struct<t:string,k:int,s:int,e:int,y:boolean,held:boolean>>")))
    found = with_candidates(rows, "t").select("held", "k", "y", "s", "e", F.explode("_cand").alias("c"))
    # a candidate of another kind than the phrase's is no answer to it; one of its kind is genuine if it is the span
    found = found.filter("c.k = k").withColumn("hit", F.col("y") & (F.col("c.s") == F.col("s")) & (F.col("c.e") == F.col("e")))
    counted = found.groupBy("held", "k", *(F.col(f"c.f.{b}").alias(b) for b in BINS)).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))
    table = sorted((r.asDict() for r in counted.collect()), key=lambda r: [r["k"], *(r[b] for b in BINS)])
    start, trees = boost([r for r in table if not r["held"]])
    held = [(r["k"], (score_of(start, trees, r), r["n"], r["hits"])) for r in table if r["held"]]
    return start, trees, [threshold([r for k, r in held if k == i]) for i in range(len(KINDS))]


def _column(tree: Tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(f[tree[0]] == tree[1], _column(tree[2], f)).otherwise(_column(tree[3], f))


def unhit(base: Column, found: Column) -> Column:
    """Those of found, by start, that overlap no base span: a scan for spans that start before, and one for those after."""
    one = "struct<s:int,o:int,e:int,k:int,p:double>"
    mark = lambda p: lambda x: F.struct(x["s"].alias("s"), F.lit(0 if p is None else 1).alias("o"), x["e"].alias("e"), x["k"].alias("k"), (F.lit(0.0) if p is None else x["p"]).alias("p"))
    both = F.array_sort(F.concat(F.transform(base, mark(None)).cast(f"array<{one}>"), F.transform(found, mark("p")).cast(f"array<{one}>")))

    def clear(items: Column, first: int, hit: Callable[[Column, Column], Column], further: Callable[[Column, Column], Column]) -> Column:
        def step(at: Column, x: Column) -> Column:
            out = F.when((x["o"] == 1) & hit(at, x), F.lit(None).cast(one)).otherwise(x)
            return F.struct(F.when(x["o"] == 0, further(at, x)).otherwise(at).alias("state"), out.alias("out"))

        return F.filter(scan(items, F.lit(first), step, "int", one), lambda x: x.isNotNull())

    kept = clear(both, -1, lambda at, x: x["s"] < at, lambda at, x: F.greatest(at, x["e"]))
    kept = clear(F.reverse(kept), _NEVER, lambda at, x: x["e"] > at, lambda at, x: F.least(at, x["s"]))
    return F.reverse(F.filter(kept, lambda x: x["o"] == 1))


def best_of(found: Column) -> Column:
    """Of spans in order of their start, without overlaps: a span gives way to a better one (score, then length) that it meets."""
    one = "struct<s:int,o:int,e:int,k:int,p:double>"
    end = F.array(F.struct(F.lit(_NEVER).alias("s"), F.lit(1).alias("o"), F.lit(_NEVER).alias("e"), F.lit(0).alias("k"), F.lit(0.0).alias("p")).cast(one))

    def step(held: Column, x: Column) -> Column:
        apart = held.isNull() | (x["s"] >= held["e"])
        better = (x["p"] > held["p"]) | ((x["p"] == held["p"]) & (x["e"] - x["s"] > held["e"] - held["s"]))
        return F.struct(F.when(apart | better, x).otherwise(held).alias("state"), F.when(apart, held).otherwise(F.lit(None).cast(one)).alias("out"))

    return F.filter(scan(F.concat(found, end), F.lit(None), step, one, one), lambda x: x.isNotNull())


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, keep, base and spans: array<struct<s, k, e>> by start, then kind, for each row of docs.

    base holds the valid spans of the fixed patterns; spans adds those candidates that reach their kind's threshold
    and overlap neither a base span nor a better candidate (higher score, then longer, then earlier). Null texts
    count as empty, null ids and repeated rows are rows like any other, other columns than those named aren't read. An
    empty table gives an empty result.
    """
    start, trees, least = model
    rows = docs.select(id_col, *keep, F.coalesce(text_col, F.lit("")).alias("_t"))
    found = with_candidates(with_base(rows, "_t"), "_t").select(id_col, *keep, "_base", "_cand")
    limits = F.array(*(F.lit(max(-1e300, min(1e300, x))) for x in least))

    def scored(c: Column) -> Column:
        total = F.lit(float(start))
        for t in trees:
            total = total + _column(t, c["f"])
        return F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), total.alias("p"))

    none = F.array().cast("array<struct<s:int,k:int,e:int,p:double>>")
    passing = F.when(F.size("_cand") > 0, F.filter(F.transform("_cand", scored), lambda c: c["p"] >= limits[c["k"]])).otherwise(none)
    found = found.withColumn("_pass", passing)
    added = let(unhit(F.col("_base"), F.col("_pass")), lambda free: F.transform(best_of(free), lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))
    found = found.withColumn("_added", F.when(F.size("_pass") > 0, added.cast(_SPANS)).otherwise(F.array().cast(_SPANS)))
    return found.select(id_col, *keep, F.array_sort("_base").alias("base"), F.array_sort(F.concat("_base", "_added")).alias("spans"))


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(found: DataFrame, text_col: str, spans_col: str = "spans") -> DataFrame:
    """found with text_col's spans replaced by [kind]; the operator's text output. Overlapping spans become the first's kind.

    A null text stays null, a text without spans stays as it is.
    """
    names = F.array(*map(F.lit, KINDS))

    def step(at: Column, x: Column) -> Column:
        inside = x["s"] < at
        out = F.when(~inside, F.struct(at.alias("from"), x["s"].alias("to"), x["k"].alias("k")))
        return F.struct(F.greatest(at, x["e"]).alias("state"), out.alias("out"))

    def replaced(chars: Column, cuts: Column) -> Column:
        part = lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), "")
        pieces = F.transform(cuts, lambda c: F.concat(part(c["from"], c["to"]), F.lit("["), names[c["k"]], F.lit("]")))
        rest = F.aggregate(F.col(spans_col), F.lit(0), lambda at, x: F.greatest(at, x["e"]))
        return F.concat(F.array_join(pieces, ""), let(rest, lambda at: part(at, F.size(chars))))

    cuts = F.filter(scan(F.col(spans_col), F.lit(0), step, "int", "struct<from:int,to:int,k:int>"), lambda x: x.isNotNull())
    chars = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit("(?s)."), F.lit(0))
    done = let(chars, lambda chars: let(cuts, lambda cuts: replaced(chars, cuts)))
    return found.withColumn(text_col, F.when(F.size(spans_col) > 0, done).otherwise(F.col(text_col)))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_added: how many spans the method adds."""
    found = find(common.documents(spark, sf_dir), train(spark))

    def of(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = map(of, range(len(KINDS)))
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), added)
