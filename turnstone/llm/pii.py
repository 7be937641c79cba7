"""Personal data: high-recall generators propose overlapping spans, boosted trees read their format and context, calibrated
thresholds select what to redact.

The main path is Spark expressions only. Patterns give matches (`regexp_extract_all`) and the text between them (`split`), and
prefix sums over both lengths give offsets in code points. The base kinds (email, ip, card, phone) keep every match that passes
its validator. The generators propose more; each candidate's features go through the trees, which are compiled to nested CASE
expressions, and a candidate stays if its probability reaches its kind's threshold and it overlaps no base span and no better
candidate.

The trees are fitted here, on at most `SAMPLE_CANDIDATES` candidates of each kind, chosen by a hash among those of all documents.
There are no labels for personal data, so validators teach: a candidate counts as positive if a checksum, range or strict format
accepts it, and the trees, which see no validator but form and context, carry that over to what no validator covers. Each kind's
threshold is the lowest at which the candidates held back from the fit, counted over the whole table, reach the wanted precision;
a kind without such a threshold, as with few examples, is selected by its strict form.

Defined results: a null text is empty; a null doc_id is kept; repeated rows are judged alike; an empty table fits no trees.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import column, free_names, materialize

SAMPLE_CANDIDATES = 5_000
#: Scores are counted in steps of one part in this many.
SCORE_STEPS = 100
PRECISION = 0.97
ROUNDS, DEPTH, RATE, CUTS = 20, 3, 0.3, 12
CONTEXT = 32
BLOCK = 512

#: The base kinds in the order of reports. Possessive forms of the plain patterns: a run is tried only from its
#: start, or from the end of the match before, which finds the same leftmost matches without trying each place of a long run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for a kind to be looked for.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Kinds that only the method finds: a generator that proposes much, whole runs of any length, and a strict form that teaches.
GENERATORS = {
    "obfuscated_email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)++", r"^\S+ ?[\[(]at[\])] ?\S+ ?(?:\.|[\[(]dot[\])]) ?[A-Za-z]{2,}$"),
    "local_phone": (r"(?<![0-9A-Za-z])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])", r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"),
    "account": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", r"^[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){3,6}(?: ?[0-9]{1,3})?$"),
    "secret": (r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{8,}+|(?:sk|ghp|xox[a-z])[-_][0-9A-Za-z_-]{12,}+|[0-9a-f]{16,}+|[0-9A-Za-z+/_-]{20,}+=*+)(?![0-9A-Za-z])", r"^(?:AKIA[0-9A-Z]{16}|(?:sk|ghp|xox[a-z])[-_][0-9A-Za-z_-]{16,}|(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,})$"),
}
KINDS = [*BASE, *GENERATORS]
_HINTS = r"(?i)(?:mail|phone|tel|call|fax|mobile|card|iban|account|konto|compte|cuenta|passw|token|secret|key|contact)[^\n]{0,12}$"

FEATURES = ["length", "digit_share", "upper_share", "letter_share", "mark_share", "digit_groups", "hint", "assigned", "quoted", "after_space", "before_space", *[f"is_{k}" for k in GENERATORS]]

SPAN = "array<struct<kind:int,start:bigint,end:bigint,text:string>>"


def _bind(value: Column, body) -> Column:
    """body(value), with the value worked out once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, offset: Column) -> Column:
    """Sums of all values before each, from offset on."""
    start = F.struct(offset.cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, start, lambda s, x: F.struct((s["sum"] + x).cast("bigint").alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")), lambda s: s["out"])


def prefix_sums(values: Column) -> Column:
    """As _running from 0, in blocks, so that a long array isn't copied whole for each element."""

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
        total = lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x)
        return _bind(blocks, lambda bs: F.flatten(F.zip_with(bs, _running(F.transform(bs, total), F.lit(0)), _running)))

    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(_bind(values, of))


def prefix_max(values: Column) -> Column:
    """The largest of each value (none is negative) and all before it; in blocks, too."""

    def running(v: Column, first: Column, include: bool) -> Column:
        start = F.struct(first.cast("bigint").alias("top"), F.array().cast("array<bigint>").alias("out"))
        out = lambda s, x: F.greatest(s["top"], x) if include else s["top"]
        return F.aggregate(v, start, lambda s, x: F.struct(F.greatest(s["top"], x).cast("bigint").alias("top"), F.concat(s["out"], F.array(out(s, x))).alias("out")), lambda s: s["out"])

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
        return _bind(blocks, lambda bs: F.flatten(F.zip_with(bs, running(F.transform(bs, lambda b: F.array_max(b)), F.lit(0), False), lambda b, m: running(b, m, True))))

    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(_bind(values, of))


def spans(text: Column, kind: int, pattern: str, needs: str | None) -> Column:
    """All leftmost non-overlapping matches, with their offsets in code points."""

    def of(p: Column) -> Column:
        sizes = F.zip_with(p["found"], F.slice(p["between"], 1, F.size(p["found"])), lambda m, b: (F.length(m) + F.length(b)).cast("bigint"))
        return _bind(
            F.struct(p["found"].alias("found"), p["between"].alias("between"), prefix_sums(sizes).alias("at")),
            lambda q: F.transform(q["found"], lambda m, i: F.struct(F.lit(kind).alias("kind"), (q["at"][i] + F.length(q["between"][i])).alias("start"), (q["at"][i] + F.length(q["between"][i]) + F.length(m)).alias("end"), m.alias("text"))),
        )

    none = F.array().cast(SPAN)
    there = F.contains(text, F.lit(needs)) if needs else F.rlike(text, F.lit(pattern))
    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.when(there, _bind(pair, lambda p: F.when(F.size(p["found"]) == 0, none).otherwise(of(p).cast(SPAN)))).otherwise(none)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True for a string of digits whose Luhn sum is a multiple of ten."""
    places = F.split(F.reverse(digits), "")
    doubled = lambda d, i: F.when(i % 2 == 0, d).when(d < 5, 2 * d).otherwise(2 * d - 9)
    values = F.transform(F.filter(places, lambda c: c != ""), lambda c, i: doubled(c.cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(F.concat(F.lit("0"), p), F.lit(3)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return _bind(_digits(text), lambda d: F.length(d).between(13, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    return F.lit(True)


def _accepts(kind: str):
    return lambda s: valid(kind, s["text"])


def base_spans(text: Column) -> Column:
    """The base spans by kind, then start."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(*[F.filter(spans(t, i, p, NEEDS[k]), _accepts(k)) for i, (k, p) in enumerate(BASE.items())])


def candidates(text: Column) -> Column:
    """What the generators propose; spans of different kinds may overlap."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(*[spans(t, len(BASE) + i, p, "at" if k == "obfuscated_email" else None) for i, (k, (p, _)) in enumerate(GENERATORS.items())])


def features(text: Column, s: Column) -> list[Column]:
    """Numbers that tell the format and the context of span s of the text, in the order of FEATURES."""
    m, n = s["text"], F.length(s["text"])
    share = lambda pattern: F.length(F.regexp_replace(m, pattern, "")) / n
    before = F.substring(text, F.greatest(F.lit(1), (s["start"] - CONTEXT + 1).cast("int")), F.least(F.lit(CONTEXT), s["start"].cast("int")))
    after = F.substring(text, (s["end"] + 1).cast("int"), 1)
    flag = lambda c: c.cast("double")
    return [
        n.cast("double"), share("[^0-9]"), share("[^A-Z]"), share("[^A-Za-z]"), share("[A-Za-z0-9]"), F.size(F.split(m, "[0-9]+", -1)).cast("double") - 1,
        flag(F.rlike(before, F.lit(_HINTS))), flag(F.rlike(before, F.lit(r"[=:]\s*[\"']?$"))), flag(F.rlike(before, F.lit(r"[\"']$"))), flag(F.rlike(before, F.lit(r"(?:^|\s)$"))), flag(F.rlike(after, F.lit(r"^(?:$|[\s.,;!?)])"))),
        *[flag(s["kind"] == len(BASE) + i) for i in range(len(GENERATORS))],
    ]


class Trees:
    """Boosted regression trees for a logistic score. A tree is a leaf's value, or (feature, cut, tree if at or below, tree if above)."""

    def __init__(self, bias: float = 0.0):
        self.bias, self.trees = bias, []

    @staticmethod
    def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        leaf = float(-RATE * g.sum() / (h.sum() + 1.0))
        if not depth or len(x) < 10:
            return leaf
        best, at = 1e-6, None
        for f in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[:-1], method="lower")):
                left = x[:, f] <= cut
                a, b = h[left].sum() + 1.0, h[~left].sum() + 1.0
                gain = g[left].sum() ** 2 / a + g[~left].sum() ** 2 / b - g.sum() ** 2 / (h.sum() + 1.0)
                if left.any() and not left.all() and gain > best:
                    best, at = gain, (f, float(cut), left)
        if at is None:
            return leaf
        f, cut, left = at
        return (f, cut, Trees._grow(x[left], g[left], h[left], depth - 1), Trees._grow(x[~left], g[~left], h[~left], depth - 1))

    @staticmethod
    def _value(tree, x: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, Trees._value(low, x), Trees._value(high, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((self._value(t, x) for t in self.trees), np.zeros(len(x)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        total = np.full(len(y), self.bias)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-total))
            self.trees.append(self._grow(x, p - y, p * (1 - p), DEPTH))
            total += self._value(self.trees[-1], x)
        return self

    def expression(self, columns: Column) -> Column:
        """The score as nested CASE expressions over an array of features."""

        def of(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            f, cut, low, high = tree
            return F.when(columns[f] <= cut, of(low)).otherwise(of(high))

        out = F.lit(self.bias)
        for t in self.trees:
            out = out + of(t)
        return out


def unrivalled(scored: Column) -> Column:
    """Of an array of (start, end, kind, text, score) those that overlap none with a higher score; ties go to the earlier, then the
    smaller kind. Sorted by start, spans fall into runs that overlap, between which nothing does; each is compared within its run."""
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    rank = lambda a: F.struct(-a["score"], a["start"], a["kind"])

    def kept(q: Column) -> Column:
        """q: the spans in order, the largest end up to each, and, after those, where runs begin."""
        c, n = q["c"], F.size(q["c"])
        head = F.transform(c, lambda x, i: F.when(i == 0, True).otherwise(x["start"] >= q["reach"][i - 1]))
        return _bind(
            F.struct(c.alias("c"), n.alias("n"), prefix_max(F.transform(head, lambda h, i: F.when(h, i).otherwise(0).cast("bigint"))).alias("first"), F.reverse(prefix_max(F.reverse(F.transform(head, lambda h, i: F.when(h, n - i).otherwise(0).cast("bigint"))))).alias("back")),
            lambda r: F.filter(r["c"], lambda x, i: ~F.exists(F.slice(r["c"], (r["first"][i] + 1).cast("int"), (r["n"] - F.coalesce(F.get(r["back"], i + 1), F.lit(0)) - r["first"][i]).cast("int")), lambda y: meets(x, y) & (rank(y) < rank(x)))),
        )

    ordered = lambda c: F.struct(c.alias("c"), prefix_max(F.transform(c, lambda x: x["end"])).alias("reach"))
    return _bind(F.array_sort(scored), lambda c: F.when(F.size(c) < 2, c).otherwise(_bind(ordered(c), kept)))


def _strict(s: Column) -> Column:
    """True for a candidate that its kind's strict form accepts."""
    return F.coalesce(*[F.when(s["kind"] == len(BASE) + i, F.rlike(s["text"], F.lit(form))) for i, (_, form) in enumerate(GENERATORS.values())], F.lit(False))


def fit(documents: DataFrame, max_candidates: int = SAMPLE_CANDIDATES, precision: float = PRECISION) -> tuple[Trees, list[float | None]]:
    """The trees, and the score that each generator's candidates must reach (None: its strict form decides)."""
    found = documents.select(F.coalesce("text", F.lit("")).alias("text")).select("text", F.explode(candidates(F.col("text"))).alias("s"))
    every = materialize(found.select(F.array(*features(F.col("text"), F.col("s"))).alias("x"), _strict(F.col("s")).cast("int").alias("y"), F.col("s.kind").alias("kind"), F.xxhash64("s.text").alias("h")), "candidates")
    held = F.pmod("h", F.lit(3)) == 0
    rows = [r for i in range(len(GENERATORS)) for r in every.filter(~held & (F.col("kind") == len(BASE) + i)).orderBy("h", "x").limit(max_candidates).collect()]
    limits: list[float | None] = [None] * len(GENERATORS)
    if not rows:
        return Trees(), limits
    trees = Trees().fit(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float))
    score = _bind(F.col("x"), trees.expression)
    counted = every.filter(held).select("kind", "y", F.floor(score * SCORE_STEPS).alias("step")).groupBy("kind", "step").agg(F.sum("y").alias("right"), F.count(F.lit(1)).alias("n")).collect()
    for i in range(len(GENERATORS)):
        right = n = 0
        for r in sorted((r for r in counted if r["kind"] == len(BASE) + i), key=lambda r: -r["step"]):
            right, n = right + r["right"], n + r["n"]
            if right >= 3 and right >= precision * n:
                limits[i] = r["step"] / SCORE_STEPS
    return trees, limits


def detect(documents: DataFrame, model: tuple[Trees, list[float | None]] | None = None) -> DataFrame:
    """All columns of documents, and behind them `base` and `spans`, under free names if documents has such columns: arrays of
    (kind number, start, end, text), by kind, then start."""
    trees, limits = model or fit(documents)
    keep, (base, spans) = [column(c) for c in documents.columns], free_names(documents.columns, "base", "spans")
    text = F.coalesce("text", F.lit(""))
    passed = lambda v, s: F.coalesce(*[F.when(s["kind"] == len(BASE) + i, v >= x) for i, x in enumerate(limits) if x is not None], _strict(s))
    ranked = lambda s, score: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text"), score.alias("score"))
    scored = F.transform(candidates(text), lambda s: F.struct(s.alias("s"), _bind(F.array(*features(text, s)), trees.expression).alias("score")))
    wanted = F.transform(F.filter(scored, lambda c: passed(c["score"], c["s"])), lambda c: ranked(c["s"], c["score"]))
    added = lambda found: F.transform(F.filter(found, lambda c: c["kind"] >= len(BASE)), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text")))
    # A base span yields to nothing.
    firm = F.transform(base, lambda b: ranked(b, F.lit(float("inf"))))
    chosen = _bind(wanted, lambda w: F.when(F.size(w) == 0, F.array().cast(SPAN)).otherwise(added(unrivalled(F.concat(firm, w))).cast(SPAN)))
    based = documents.select(*keep, base_spans(F.col("text")).alias(base))
    return based.select(*keep, base, F.concat(base, F.array_sort(chosen)).alias(spans))


def redact(found: DataFrame) -> DataFrame:
    """What detect() took, with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    ordered = F.sort_array(F.transform(found.columns[-1], lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    text = F.coalesce("text", F.lit(""))

    def step(a: Column, s: Column) -> Column:
        new = s["start"] >= a["at"]
        kept = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.struct(F.greatest(a["at"], -s["end"]).alias("at"), F.when(new, F.concat(a["out"], kept, names[s["kind"]])).otherwise(a["out"]).alias("out"))

    done = F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return found.select(*[done.alias(c) if c.lower() == "text" else column(c) for c in found.columns[:-2]])


def report(found: DataFrame) -> DataFrame:
    base, spans = map(column, found.columns[-2:])
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    count = lambda i: F.size(F.filter(base, lambda s: s["kind"] == i)).cast("bigint")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
