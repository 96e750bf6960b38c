"""Answer normalisation and token-level similarity as Column expressions.

Everything here is a JVM expression (regex, higher-order array functions);
no Python runs per row. Regexes use ``(?U)`` so ``\\b``, ``\\s`` and ``\\w``
are Unicode-aware like Python's ``re``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the reference: the ASCII punctuation set
# removed by answer normalisation, and the English articles it drops.
PUNCTUATION = string.punctuation          # !"#$%&'()*+,-./:;<=>?@[\]^_`{|}~
ARTICLES_RE = r"(?U)\b(a|an|the)\b"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_answer(s: str | Column) -> Column:
    """lower -> drop ASCII punctuation -> articles to space -> collapse blanks."""
    x = F.lower(_c(s))
    x = F.translate(x, PUNCTUATION, "")
    x = F.regexp_replace(x, ARTICLES_RE, " ")
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    return F.trim(x)


def tokens(normalized: str | Column) -> Column:
    """Whitespace tokens of an already normalised string ('' -> [])."""
    n = _c(normalized)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def is_blank(s: str | Column) -> Column:
    """Python's ``not s.strip()`` (Unicode whitespace)."""
    return F.coalesce(F.length(F.regexp_replace(_c(s), r"(?U)\s", "")) == 0, F.lit(True))


def multiset_overlap(p: Column, g: Column) -> Column:
    """sum over distinct tokens of min(count in p, count in g)."""
    return F.aggregate(
        F.array_distinct(p), F.lit(0),
        lambda acc, w: acc + F.least(F.size(F.filter(p, lambda x: x == w)),
                                     F.size(F.filter(g, lambda x: x == w))))


def f1_from_counts(common: Column, n_pred: Column, n_gold: Column, eval_variant: bool) -> Column:
    """F1 from overlap and lengths.

    eval variant: both empty -> 1, one empty -> 0. reward variant: no
    overlap -> 0 (so both empty -> 0).
    """
    p = common / n_pred
    r = common / n_gold
    f1 = F.when(common == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    if eval_variant:
        return (F.when((n_pred == 0) & (n_gold == 0), F.lit(1.0))
                 .when((n_pred == 0) | (n_gold == 0), F.lit(0.0))
                 .otherwise(f1))
    return F.when((n_pred == 0) | (n_gold == 0), F.lit(0.0)).otherwise(f1)


def token_f1(pred: str | Column, gold: str | Column, eval_variant: bool = True) -> Column:
    """Token F1 of two raw strings (short answers; higher-order functions)."""
    p = tokens(normalize_answer(pred))
    g = tokens(normalize_answer(gold))
    return f1_from_counts(multiset_overlap(p, g).cast("double"), F.size(p).cast("double"),
                          F.size(g).cast("double"), eval_variant)


def reward_f1_max(pred: str | Column, golds: str | Column) -> Column:
    """Reward-variant F1, max over a gold list (0 for an empty list)."""
    p = tokens(normalize_answer(pred))
    return F.coalesce(F.array_max(F.transform(
        _c(golds),
        lambda g: f1_from_counts(multiset_overlap(p, tokens(normalize_answer(g))).cast("double"),
                                 F.size(p).cast("double"),
                                 F.size(tokens(normalize_answer(g))).cast("double"), False))),
        F.lit(0.0))


def exact_match_any(pred: str | Column, golds: str | Column) -> Column:
    """1.0 if the normalised prediction equals any normalised gold."""
    n = normalize_answer(pred)
    return F.exists(_c(golds), lambda g: normalize_answer(g) == n).cast("double")


def reward_substring_any(pred: str | Column, golds: str | Column) -> Column:
    """1.0 if any normalised gold occurs inside the normalised prediction."""
    n = normalize_answer(pred)
    return F.exists(_c(golds), lambda g: F.instr(n, normalize_answer(g)) > 0).cast("double")


def eval_substring(norm_pred: Column, norm_gold: Column) -> Column:
    """Either direction; the empty string is contained in everything."""
    return ((F.instr(norm_pred, norm_gold) > 0) | (F.instr(norm_gold, norm_pred) > 0)
            | (norm_gold == "") | (norm_pred == "")).cast("double")


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Lexical fallback similarity: Jaccard of normalised token sets; a blank
    side (before or after normalisation) gives 1."""
    sa = F.array_distinct(tokens(normalize_answer(a)))
    sb = F.array_distinct(tokens(normalize_answer(b)))
    inter = F.size(F.array_intersect(sa, sb)).cast("double")
    union = F.size(F.array_union(sa, sb)).cast("double")
    blank = is_blank(a) | is_blank(b) | (F.size(sa) == 0) | (F.size(sb) == 0)
    return F.when(blank, F.lit(1.0)).otherwise(inter / union)


WORD2_RE = r"(?U)\b\w\w+\b"


def tfidf_words(s: str | Column) -> Column:
    """Default TF-IDF vectoriser tokens: lower-case words of 2+ chars."""
    return F.regexp_extract_all(F.lower(_c(s)), F.lit(WORD2_RE), 0)


def cosine(a: str | Column, b: str | Column) -> Column:
    """SC-9: cosine of two numeric vectors (e.g. precomputed embeddings)."""
    x, y = _c(a), _c(b)
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    nx = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v))
    ny = F.sqrt(F.aggregate(y, F.lit(0.0), lambda acc, v: acc + v * v))
    return dot / (nx * ny)
