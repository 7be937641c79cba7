"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every metric is an expression over the text; RULES gives each a lower and an upper bound, and a text is kept if it passes all.
Words are runs without ASCII white space, lines are split at newlines.

Defined results: a null or empty text has no words, fails the base rules and all its counts are zero; repeated rows are judged
alike. Ratios over an empty count are zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import column, free_names

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
WINDOW = 8
BASE_MIN_WORDS = 20
BASE_MAX_REPEAT_PERCENT = 30

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "was", "with",
              "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu", "als",
              "au", "avec", "ce", "dans", "de", "du", "en", "est", "et", "la", "le", "les", "pas", "pour", "par", "que", "qui", "un", "une", "sur",
              "con", "del", "el", "es", "las", "lo", "los", "no", "para", "por", "se", "su", "una", "y"]

#: (metric, lower bound, upper bound); None leaves a side open. Ratios are per word, per character or per line, as their names say.
RULES = [
    ("n_words", 20, None),
    ("repeat_word_ratio", None, 0.30),
    ("mean_word_chars", 1.5, 20.0),
    ("longest_word_chars", None, 2_000),
    ("symbol_word_ratio", None, 0.25),
    ("stop_word_ratio", 0.005, None),
    ("upper_char_ratio", None, 0.50),
    ("digit_char_ratio", None, 0.30),
    ("punctuation_char_ratio", None, 0.30),
    ("dup_line_ratio", None, 0.50),
    ("ellipsis_line_ratio", None, 0.50),
    ("bullet_line_ratio", None, 0.90),
]


def _bind(value: Column, body) -> Column:
    """body(value), with the value worked out once for each row, however often body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+", -1), lambda w: w != "")


def _covered(places: Column, width: int) -> Column:
    """How many places the windows that start at the sorted places cover."""
    start = F.struct(F.lit(-width).cast("int").alias("last"), F.lit(0).cast("int").alias("n"))
    add = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).cast("int").alias("n"))
    return F.aggregate(places, start, add, lambda a: a["n"])


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of `width` words which stands twice or more in the text."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    pairs = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("i"))))
    twice = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_bind(pairs(h), lambda s: _covered(F.array_sort(F.transform(twice(s), lambda x: x["i"])), width)))
    return F.when(F.size(words) < width, 0).otherwise(_bind(hashes, count))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measures(text: Column) -> Column:
    """All counts and ratios of the rules' table, as one struct."""
    t = F.coalesce(text, F.lit(""))
    ratio = lambda n, of: F.when(of > 0, n / of).otherwise(F.lit(0.0))

    def of_chars(solid: Column) -> Column:
        """Counts over the text without white space; letters are letters and digits."""
        left_by = lambda pattern: F.length(solid) - F.length(F.regexp_replace(solid, pattern, ""))
        return F.struct(F.length(solid).alias("chars"), (F.length(solid) - F.length(_without(solid, _SYMBOLS))).alias("symbols"), left_by(r"\p{Lu}+").alias("upper"), left_by(r"[0-9]+").alias("digits"), left_by(r"[\p{L}\p{N}]+").alias("letters"))

    def of_lines(lines: Column) -> Column:
        share = lambda test: F.size(F.filter(lines, test))
        trimmed = lambda x: F.btrim(x, F.lit(_SPACE))
        return F.struct(
            F.size(lines).alias("n"),
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"),
            share(lambda x: F.endswith(trimmed(x), F.lit("...")) | F.endswith(trimmed(x), F.lit("…"))).alias("ellipsis"),
            share(lambda x: F.substring(trimmed(x), 1, 1).isin("-", "*", "•")).alias("bullet"),
        )

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n"),
            F.coalesce(F.array_max(F.transform(w, lambda x: F.length(x))), F.lit(0)).alias("longest"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).alias("stop"),
            repeated_words(w).alias("repeat"),
        )

    lines = _bind(F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^ \t-\r]"))), of_lines)
    both = F.struct(_bind(words_of(t), of_words).alias("w"), lines.alias("l"), _bind(_without(t, _SPACE), of_chars).alias("c"))
    return _bind(
        both,
        lambda m: F.struct(
            m["w"]["n"].cast("bigint").alias("n_words"),
            m["c"]["chars"].cast("bigint").alias("word_chars"),
            m["c"]["symbols"].cast("bigint").alias("n_symbols"),
            m["l"]["dup"].cast("bigint").alias("n_dup_lines"),
            m["w"]["repeat"].cast("bigint").alias("n_repeat_words"),
            ratio(m["w"]["repeat"], m["w"]["n"]).alias("repeat_word_ratio"),
            ratio(m["c"]["chars"], m["w"]["n"]).alias("mean_word_chars"),
            m["w"]["longest"].alias("longest_word_chars"),
            ratio(m["c"]["symbols"], m["w"]["n"]).alias("symbol_word_ratio"),
            ratio(m["w"]["stop"], m["w"]["n"]).alias("stop_word_ratio"),
            ratio(m["c"]["upper"], m["c"]["letters"]).alias("upper_char_ratio"),
            ratio(m["c"]["digits"], m["c"]["chars"]).alias("digit_char_ratio"),
            ratio(m["c"]["chars"] - m["c"]["letters"], m["c"]["chars"]).alias("punctuation_char_ratio"),
            ratio(m["l"]["dup"], m["l"]["n"]).alias("dup_line_ratio"),
            ratio(m["l"]["ellipsis"], m["l"]["n"]).alias("ellipsis_line_ratio"),
            ratio(m["l"]["bullet"], m["l"]["n"]).alias("bullet_line_ratio"),
        ),
    )


def passes(m: Column, rules: list[tuple[str, float | None, float | None]] = RULES) -> Column:
    """True where every metric lies within its bounds."""
    ok = F.lit(True)
    for name, low, high in rules:
        if low is not None:
            ok = ok & (m[name] >= low)
        if high is not None:
            ok = ok & (m[name] <= high)
    return ok


def judge(documents: DataFrame, rules: list[tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """All columns of documents, and behind them `measures`, `base_failed` and `kept`, under free names if documents has such columns."""
    every, names = [column(c) for c in documents.columns], free_names(documents.columns, "measures", "base_failed", "kept")
    m = F.col(names[0])
    base = (m["n_words"] < BASE_MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_MAX_REPEAT_PERCENT * m["n_words"])
    measured = documents.select(*every, measures(F.col("text")).alias(names[0]))
    return measured.select(*every, m, base.alias(names[1]), (~base & passes(m, rules)).alias(names[2]))


def report(judged: DataFrame) -> DataFrame:
    m, base_failed, kept = map(column, judged.columns[-3:])
    return judged.select("doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed.alias("base_failed"), kept.alias("kept"))


def oracle() -> str:
    """The same rules in SQL, from the same table."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    bounds = [f"{name} >= {low}" for name, low, _ in RULES if low is not None] + [f"{name} <= {high}" for name, _, high in RULES if high is not None]
    ratio = lambda n, of: f"CASE WHEN {of} > 0 THEN {n} / {of} ELSE 0.0 END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls, regexp_replace(t, '[ \t-\r]+', '', 'g') AS s FROM d),
g AS (SELECT r, i, array_to_string(ws[i : i + 7], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
q AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM q) GROUP BY r),
c AS (
  SELECT w.r, doc_id, len(ws) AS n_words, length(s) AS word_chars, length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
    coalesce(list_max(list_transform(ws, lambda x: length(x))), 0) AS longest_word_chars, len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS stop, len(ls) AS n_lines,
    length(s) - length(regexp_replace(s, '\p{{Lu}}+', '', 'g')) AS upper, length(s) - length(regexp_replace(s, '[0-9]+', '', 'g')) AS digits, length(s) - length(regexp_replace(s, '[\p{{L}}\p{{N}}]+', '', 'g')) AS letters,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t-\r]*$'))) AS ellipsis, len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t-\r]*[-*•]'))) AS bullet
  FROM w LEFT JOIN p ON w.r = p.r
), m AS (
  SELECT *, {ratio('n_repeat_words', 'n_words')} AS repeat_word_ratio, {ratio('word_chars', 'n_words')} AS mean_word_chars, {ratio('n_symbols', 'n_words')} AS symbol_word_ratio, {ratio('stop', 'n_words')} AS stop_word_ratio, {ratio('upper', 'letters')} AS upper_char_ratio,
    {ratio('digits', 'word_chars')} AS digit_char_ratio, {ratio('(word_chars - letters)', 'word_chars')} AS punctuation_char_ratio, {ratio('n_dup_lines', 'n_lines')} AS dup_line_ratio, {ratio('ellipsis', 'n_lines')} AS ellipsis_line_ratio, {ratio('bullet', 'n_lines')} AS bullet_line_ratio,
    n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(bounds)} AS kept FROM m
"""
