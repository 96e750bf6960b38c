"""Math-answer extraction and comparison as Column expressions (MS-1..11,
SC-18..21, SC-28).

String rewrites are ordered exactly as the reference applies them; steps the
reference guards with exceptions are reproduced with explicit flags (e.g. an
answer whose normalisation would raise falls back to raw equality).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rlframe.functions.transcript import assistant_blocks, extract_answer, py_strip
from rlframe.functions.util import let


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _null_s() -> Column:
    return F.lit(None).cast("string")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Chained rewrites reference the previous step several times; binding it
    keeps the expression tree linear instead of exponential in the number
    of steps."""
    return F.element_at(F.transform(F.array(value), body), 1)

# ----------------------------------------------------------- numeric (MS-1)
NUM_STRICT_RE = r"#### (\-?[0-9\.\,]+)"
NUM_ANY_RE = r"(\-?[0-9\.\,]+)"


def numeric_answer(s: str | Column, method: str = "strict") -> Column:
    """strict: first ``#### <num>`` without ',' and '$'; flexible: the last
    number that is not '' or '.', or the first candidate if all are invalid."""
    if method == "strict":
        return let(_c(s), _numeric_strict)
    return let(_c(s), _numeric_flexible)


def _numeric_strict(s: Column) -> Column:
    return F.when(s.rlike(NUM_STRICT_RE), F.regexp_replace(F.regexp_extract(s, NUM_STRICT_RE, 1), "[,$]", ""))


def _numeric_flexible(s: Column) -> Column:
    cands = F.regexp_extract_all(s, F.lit(NUM_ANY_RE), 1)
    valid = F.filter(cands, lambda x: ~x.isin("", "."))
    return (F.when(F.size(cands) == 0, _null_s())
             .when(F.size(valid) > 0, F.try_element_at(valid, F.lit(-1)))
             .otherwise(F.try_element_at(cands, F.lit(1))))


def numeric_score(s: str | Column, gt: str | Column, method: str = "strict", format_score: float = 0.0,
                  score: float = 1.0) -> Column:
    pair = F.struct(numeric_answer(s, method).alias("a"), _c(gt).alias("g"))
    return let(pair, lambda p: F.when(p["a"].isNull(), F.lit(0.0)).when(p["a"] == p["g"], F.lit(score))
               .otherwise(F.lit(format_score)))


# ------------------------------------------------------------ boxed (MS-2)
def _rfind(s: Column, sub: str) -> Column:
    """0-based index of the last occurrence of ``sub`` (-1 if absent)."""
    tail = F.substring_index(s, sub, -1)
    return F.when(F.instr(s, sub) > 0, F.length(s) - F.length(tail) - F.lit(len(sub))).otherwise(F.lit(-1))


def last_boxed(s: str | Column) -> Column:
    """Last ``\\boxed{...}`` (or ``\\fbox{...}``) with balanced braces, or the
    ``\\boxed `` form up to the next '$'. NULL when none closes."""
    return let(_c(s), _last_boxed)


def _last_boxed(s: Column) -> Column:
    space_form = F.concat(F.lit("\\boxed "), F.substring_index(F.substring_index(s, "\\boxed ", -1), "$", 1))
    ib = _rfind(s, "\\boxed")
    idx = F.when(ib >= 0, ib).otherwise(_rfind(s, "\\fbox"))
    rest = s.substr(idx + 1, F.lit((1 << 31) - 1))
    chars = F.split(rest, "")
    # fold: (depth, end position) -- end = first '}' that closes depth to 0
    st = F.aggregate(
        chars, F.struct(F.lit(0).alias("d"), F.lit(-1).alias("e"), F.lit(0).alias("i")),
        lambda acc, ch: F.when(acc["e"] >= 0, acc).otherwise(
            F.struct(
                (acc["d"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)).alias("d"),
                F.when((ch == "}") & (acc["d"] - 1 == 0), acc["i"]).otherwise(F.lit(-1)).alias("e"),
                (acc["i"] + 1).alias("i"))))
    braced = F.when(st["e"] >= 0, rest.substr(F.lit(1), st["e"] + 1))
    return (F.when(F.instr(s, "\\boxed ") > 0, space_form)
             .when(idx < 0, _null_s())
             .otherwise(braced))


def remove_boxed(b: str | Column) -> Column:
    """Strip ``\\boxed `` / ``\\boxed{..}``; NULL where the reference asserts."""
    return let(_c(b), _remove_boxed)


def _remove_boxed(b: Column) -> Column:
    return (F.when(F.instr(b, "\\boxed ") > 0,
                   F.when(b.startswith("\\boxed "), b.substr(F.lit(8), F.lit((1 << 31) - 1))))
             .when(b.startswith("\\boxed{") & b.endswith("}"), b.substr(F.lit(8), F.length(b) - 8)))


# ---------------------------------------------------- strip_string (MS-3)
_INT = r"-?(0|[1-9][0-9]*)"


def _fix_sqrt(x: Column) -> Column:
    parts = F.split(x, r"\\sqrt", -1)
    fixed = F.transform(F.slice(parts, 2, 1 << 30), lambda p: F.when(
        F.substring(p, 1, 1) != "{",
        F.concat(F.lit("\\sqrt{"), F.substring(p, 1, 1), F.lit("}"), F.substring(p, 2, (1 << 31) - 1)))
        .otherwise(F.concat(F.lit("\\sqrt"), p)))
    out = F.concat(F.element_at(parts, 1), F.array_join(fixed, ""))
    return F.when(F.instr(x, "\\sqrt") > 0, out).otherwise(x)


def _fix_fracs(x: Column) -> Column:
    parts = F.split(x, r"\\frac", -1)
    tail = F.slice(parts, 2, 1 << 30)
    fixed = F.transform(tail, lambda p: F.concat(F.lit("\\frac"), F.when(
        F.substring(p, 1, 1) == "{", p).otherwise(F.when(
            F.substring(p, 2, 1) != "{",
            F.concat(F.lit("{"), F.substring(p, 1, 1), F.lit("}{"), F.substring(p, 2, 1), F.lit("}"),
                     F.substring(p, 3, (1 << 31) - 1)))
        .otherwise(F.concat(F.lit("{"), F.substring(p, 1, 1), F.lit("}"), F.substring(p, 2, (1 << 31) - 1))))))
    # a short non-brace part makes the reference return the input unchanged
    bail = F.exists(tail, lambda p: (F.substring(p, 1, 1) != "{") & (F.length(p) < 2))
    return F.when(F.size(parts) <= 1, x).when(bail, x).otherwise(F.concat(F.element_at(parts, 1),
                                                                           F.array_join(fixed, "")))


def strip_string(s: str | Column) -> tuple[Column, Column]:
    """(normalised string, error flag). The flag marks inputs on which the
    reference's normaliser raises (so callers fall back to raw equality)."""
    r = _strip_struct(_c(s))
    return r["s"], r["e"]


def _strip_struct(x: Column) -> Column:
    for a, b in (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"),
                 ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")):
        x = F.replace(x, F.lit(a), F.lit(b))

    def units(v):
        n = F.size(F.split(v, r"\\text\{ ", -1)) - 1
        return F.struct(F.when(n == 1, F.substring_index(v, "\\text{ ", 1)).otherwise(v).alias("s"),
                        (n > 1).alias("e"))
    st = _let(x, units)

    def rest(stv):
        v, err = stv["s"], stv["e"]
        for a, b in (("\\%", ""), (" .", " 0."), ("{.", "{0.")):
            v = F.replace(v, F.lit(a), F.lit(b))
        v = _let(v, lambda u: F.when(u.startswith("."), F.concat(F.lit("0"), u)).otherwise(u))
        v = _let(v, lambda u: _let(F.split(u, "=", -1), lambda eq: F.when(
            (F.size(eq) == 2) & (F.length(F.element_at(eq, 1)) <= 2), F.element_at(eq, 2)).otherwise(u)))
        return _let(v, lambda u: _after_units(u, err))
    return _let(st, rest)


def _after_units(u: Column, err: Column) -> Column:
    # fix_sqrt indexes split[0]: an empty piece after "\sqrt" raises
    err = err | F.exists(F.slice(F.split(u, r"\\sqrt", -1), 2, 1 << 30), lambda p: p == "")
    v = _let(u, _fix_sqrt)
    v = F.replace(v, F.lit(" "), F.lit(""))

    def fr(w):
        e2 = err | F.exists(F.slice(F.split(w, r"\\frac", -1), 2, 1 << 30), lambda p: p == "")
        y = _let(w, _fix_fracs)
        y = _let(y, lambda z: F.when(z == "0.5", F.lit("\\frac{1}{2}")).otherwise(z))
        return _let(y, lambda z: F.struct(_fix_a_slash_b(z).alias("s"), e2.alias("e")))
    return _let(v, fr)


def _fix_a_slash_b(z: Column) -> Column:
    pat = rf"^({_INT})/({_INT})$"
    a_ = F.regexp_extract(z, pat, 1)
    b_ = F.regexp_extract(z, pat, 3)
    canon = z.rlike(pat) & (a_ != "-0") & (b_ != "-0")
    return F.when(canon, F.concat(F.lit("\\frac{"), a_, F.lit("}{"), b_, F.lit("}"))).otherwise(z)


def is_equiv(a: str | Column, b: str | Column) -> Column:
    """Equality after normalisation; raw equality where normalising raises;
    both NULL -> true, one NULL -> false."""
    a, b = _c(a), _c(b)
    pair = F.struct(a.alias("a"), b.alias("b"), _strip_struct(a).alias("x"), _strip_struct(b).alias("y"))

    def decide(p):
        eq = F.when(p["x"]["e"] | p["y"]["e"], p["a"] == p["b"]).otherwise(p["x"]["s"] == p["y"]["s"])
        return (F.when(p["a"].isNull() & p["b"].isNull(), F.lit(True))
                 .when(p["a"].isNull() | p["b"].isNull(), F.lit(False))
                 .otherwise(eq))
    return _let(pair, decide)


def boxed_math_score(s: str | Column, gt: str | Column) -> Column:
    """1.0 when the last boxed answer is equivalent to the ground truth."""
    pair = F.struct(remove_boxed(last_boxed(s)).alias("a"), _c(gt).alias("g"))
    return let(pair, lambda p: F.when(p["a"].isNotNull() & is_equiv(p["a"], p["g"]), F.lit(1.0))
               .otherwise(F.lit(0.0)))


# ------------------------------------------------ final-answer (MS-4, MS-5)
# Fixed values that must match the reference normaliser, in its order.
SUBSTITUTIONS = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"),
    (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
]
REMOVED_EXPRESSIONS = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue",
    "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals",
    "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}",
    "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;",
    ",\\!", "{,}", '"', "\\dots",
]


def normalize_final_answer(s: str | Column) -> Column:
    x = F.substring_index(_c(s), "=", -1)
    x = reduce(lambda acc, ab: F.replace(acc, F.lit(ab[0]), F.lit(ab[1])), SUBSTITUTIONS, x)
    x = reduce(lambda acc, e: F.replace(acc, F.lit(e), F.lit("")), REMOVED_EXPRESSIONS, x)
    x = F.regexp_replace(x, r"(.*?)(\$)(.*?)(\$)(.*)", "\\$$3\\$")
    x = F.regexp_replace(x, r"(\\text\{)(.*?)(\})", "$2")
    x = F.regexp_replace(x, r"(\\textbf\{)(.*?)(\})", "$2")
    x = F.regexp_replace(x, r"(\\overline\{)(.*?)(\})", "$2")
    x = F.regexp_replace(x, r"(\\boxed\{)(.*)(\})", "$2")
    x = F.regexp_replace(x, r"(frac)([^{])(.)", "frac{$2}{$3}")
    x = F.regexp_replace(x, r"(sqrt)([^{])", "sqrt{$2}")
    x = F.replace(x, F.lit("$"), F.lit(""))
    nc = F.replace(x, F.lit(","), F.lit(""))
    x = F.when(nc.rlike(r"^\p{Nd}+$"), nc).otherwise(x)
    return py_strip(x)


ANSWER_LINE_RE = r"(?i)Answer\s*:\s*([^\n]+)"


def minerva_pred(s: str | Column, clip: int = 300) -> Column:
    """Normalised last ``Answer: ...`` of the last ``clip`` characters."""
    tail = F.substring(_c(s), -clip, clip) if clip else _c(s)
    m = F.regexp_extract_all(tail, F.lit(ANSWER_LINE_RE), 1)
    raw = F.coalesce(F.try_element_at(m, F.lit(-1)), F.lit("[INVALID]"))
    return normalize_final_answer(raw)


def final_answer_score(s: str | Column, gt: str | Column) -> Column:
    """MS-5: struct(score +-1, acc, pred) on the last 300 characters."""
    def body(p):
        ok = p["pred"] == p["gold"]
        return F.struct(F.when(ok, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("score"), ok.alias("acc"),
                        p["pred"].alias("pred"))
    return let(F.struct(minerva_pred(s).alias("pred"), normalize_final_answer(gt).alias("gold")), body)


def strict_box_score(s: str | Column, gt: str | Column) -> Column:
    """MS-6: 1 if the boxed answer in the last 100 characters equals gt, else -1."""
    tail = F.substring(_c(s), -100, 100)
    pair = F.struct(remove_boxed(last_boxed(tail)).alias("p"), _c(gt).alias("g"))
    return let(pair, lambda q: F.when(q["p"] == q["g"], F.lit(1)).otherwise(F.lit(-1)))


# ------------------------------------------------------ tolerant (MS-9)
def numeric_close(a: str | Column, b: str | Column, rel: float = 1e-4, include_percentage: bool = True) -> Column:
    """Numbers equal within relative tolerance; optionally also x/100, x*100."""
    x, y = (F.regexp_replace(_c(v), r"\{,\}|,", "").try_cast("double") for v in (a, b))

    def close(u, v):
        return F.abs(u - v) <= F.lit(rel) * F.greatest(F.abs(u), F.abs(v))
    cands = [y] + ([y / 100, y * 100] if include_percentage else [])
    hit = reduce(lambda acc, v: acc | close(x, v), cands[1:], close(x, cands[0]))
    return F.coalesce(hit, F.lit(False))


# --------------------------------------------------- multiple choice (SC-19)
MC_RE = r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?"


def mc_score(s: str | Column, gt: str | Column) -> Column:
    s = _c(s)
    ext = F.when(s.rlike(MC_RE), F.regexp_extract(s, MC_RE, 1))
    return F.when(ext == _c(gt), F.lit(1.0)).otherwise(F.lit(0.0))


# -------------------------------------------------- geometry mix (SC-20)
GEO_FORMAT_RE = r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"


def geo_score(s: str | Column, gt: str | Column) -> Column:
    """0.9 * accuracy + 0.1 * full-match format. Accuracy uses this module's
    boxed-answer equivalence (the reference's external grader is not built)."""
    def body(p):
        fmt = F.when(p["s"].rlike(GEO_FORMAT_RE), F.lit(1.0)).otherwise(F.lit(0.0))
        return F.lit(0.9) * boxed_math_score(p["s"], p["g"]) + F.lit(0.1) * fmt
    return let(F.struct(_c(s).alias("s"), _c(gt).alias("g")), body)


# ------------------------------------------ boxed answer in tags (SC-18)
BOXED_ANSWER_RE = r"(?s)<answer>.*\\boxed\{.*\}.*</answer>(?=\n?\z)"


def boxed_answer_format(t: str | Column) -> Column:
    last = F.try_element_at(assistant_blocks(t), F.lit(-1))
    return F.when(F.coalesce(last.rlike(BOXED_ANSWER_RE), F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


def boxed_answer_score(t: str | Column, gt: str | Column) -> Column:
    """Answer tag -> boxed content -> equivalence; -1 if the format fails."""
    def body(p):
        last = p["last"]
        boxed = remove_boxed(last_boxed(extract_answer(last)))
        acc = let(F.struct(boxed.alias("b"), p["g"].alias("g")), lambda q: F.when(
            q["b"].isNotNull() & is_equiv(q["b"], q["g"]), F.lit(1.0)).otherwise(F.lit(0.0)))
        fmt_ok = F.coalesce(last.rlike(BOXED_ANSWER_RE), F.lit(False))
        return F.when(p["t"].isNull() | p["g"].isNull(), F.lit(0.0)).when(fmt_ok, acc).otherwise(F.lit(-1.0))
    spec = F.struct(_c(t).alias("t"), _c(gt).alias("g"),
                    F.try_element_at(assistant_blocks(t), F.lit(-1)).alias("last"))
    return let(spec, body)


# ----------------------------------------------------- overlong (SC-21)
def overlong_penalty(length: str | Column, max_len: int, buffer: int, factor: float) -> Column:
    exceed = _c(length) - F.lit(max_len - buffer)
    return F.least(-exceed / F.lit(float(buffer)) * F.lit(factor), F.lit(0.0))


# ---------------------------------------------------- prefix (MS-11)
def prefix_reward(pred: str | Column, gold: str | Column) -> Column:
    """Credit 1/(len(gold)+1) per leading character that matches the gold,
    stopping at the first mismatch."""
    p, g = _c(pred), _c(gold)
    n = F.least(F.length(p), F.length(g))
    pos = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    match = F.aggregate(pos, F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")),
                        lambda acc, i: F.when(acc["on"] & (i <= n) & (F.substring(p, i, 1) == F.substring(g, i, 1)),
                                              F.struct((acc["k"] + 1).alias("k"), F.lit(True).alias("on")))
                        .otherwise(F.struct(acc["k"].alias("k"), F.lit(False).alias("on"))))
    return match["k"] / (F.length(g) + 1).cast("double")


# ---------------------------------------------- competition grading (MS-7/8/10)
# Fixed values that must match the reference normaliser: unit words removed
# (with optional plural and power), and tuple delimiters.
UNIT_WORDS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week",
              "month", "year", "foot", "feet", "inch", "yard", "liter"]
TUPLE_CHARS = "()[]"
FORMATTED_COMMA_RE = r"(\d),(?=\d\d\d(?:$|\D))"


def strip_number_commas(x: str | Column) -> Column:
    """Remove thousands separators ('1,234' -> '1234'), keeping tuple commas."""
    return F.regexp_replace(_c(x), FORMATTED_COMMA_RE, "$1")


def _int_string(x: Column) -> Column:
    """If ``x`` parses as a number within 1e-7 of an integer, that integer
    (truncated, as int(float(x)) does) as a string; else NULL."""
    v = strip_number_commas(x).try_cast("double")
    return F.when(F.abs(v - F.round(v)) <= 1e-7, v.cast("long").cast("string"))


def algebra_normalize(s: str | Column) -> Column:
    """MS-7: competition-answer normalisation (the LaTeX-to-text parsing step
    of the reference needs an external parser and is not applied)."""
    def body(x):
        x = F.when(x.rlike(r"^\\text\{(.+?)\}$"), F.regexp_extract(x, r"^\\text\{(.+?)\}$", 1)).otherwise(x)
        for a, b in (("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "),
                     ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")):
            x = F.replace(x, F.lit(a), F.lit(b))
        for unit in UNIT_WORDS:
            x = F.regexp_replace(x, unit + r"(es)?(s)? *(\^[0-9]+)?", "")
        x = F.regexp_replace(x, r"\^ *\\circ", "")
        x = let(x, lambda v: F.when((F.length(v) > 0) & v.startswith("{") & v.endswith("}"),
                                    v.substr(F.lit(2), F.length(v) - 2)).otherwise(v))
        x = F.regexp_replace(x, r",\\! *", "")
        x = let(x, lambda v: let(v.try_cast("double"), lambda d: F.when(
            d.isNotNull() & (F.abs(d - F.round(d)) <= 1e-7), F.round(d).cast("long").cast("string")).otherwise(v)))
        x = F.regexp_replace(x, r"- *", "-")
        x = F.regexp_replace(x, r"([0-9]) +([0-9])", "$1+$2")
        x = F.lower(x)
        return let(x, lambda v: F.coalesce(_int_string(v), v))
    return let(_c(s), body)


def split_tuple(x: str | Column) -> Column:
    """Elements of a tuple/interval ``(a, b)`` / ``[a, b]``; else [x]."""
    def body(v):
        inner = v.substr(F.lit(2), F.length(v) - 2)
        is_tuple = ((F.length(v) > 2) & F.substring(v, 1, 1).isin(*TUPLE_CHARS)
                    & F.substring(v, -1, 1).isin(*TUPLE_CHARS) & ~inner.rlike(r"[\(\)\[\]]"))
        return (F.when(F.length(v) == 0, F.array().cast("array<string>"))
                 .when(is_tuple, F.transform(F.split(inner, ",", -1), lambda e: F.trim(e)))
                 .otherwise(F.array(v)))
    return let(strip_number_commas(x), body)


FRAC_RE = r"^-?[0-9]+.?/0*[1-9][0-9]*.?$"


def tuple_grade(given: str | Column, gt: str | Column) -> Column:
    """MS-8 (without the symbolic step): equal after the MATH normaliser or
    after :func:`algebra_normalize`; otherwise element-wise over tuples, where
    two fractions must match literally, an integer never matches a
    non-integer, and the remaining pairs (which the reference hands to a
    symbolic solver) count as equal only when their normalised text is."""
    def body(p):
        g, t = p["g"], p["t"]
        gn, tn = p["gn"], p["tn"]
        ge, te = split_tuple(gn), split_tuple(tn)
        ends_ok = (F.size(te) <= 1) | ((F.substring(tn, 1, 1) == F.substring(gn, 1, 1))
                                       & (F.substring(tn, -1, 1) == F.substring(gn, -1, 1)))
        pairs = F.arrays_zip(te.alias("t"), ge.alias("g"))
        elem_ok = F.forall(pairs, lambda e: F.when(e["t"].rlike(FRAC_RE) & e["g"].rlike(FRAC_RE), e["t"] == e["g"])
                           .when(_int_string(e["t"]).isNull() != _int_string(e["g"]).isNull(), F.lit(False))
                           .otherwise(e["t"] == e["g"]))
        tuple_ok = ends_ok & (F.size(te) == F.size(ge)) & elem_ok
        mathd = is_equiv(g, t)
        return (F.when(g.isNull(), F.lit(False)).when(mathd, F.lit(True)).when(tn.isNull(), F.lit(False))
                 .when(tn == gn, F.lit(True)).when(F.length(gn) == 0, F.lit(False)).otherwise(tuple_ok))
    spec = F.struct(_c(given).alias("g"), _c(gt).alias("t"), algebra_normalize(given).alias("gn"),
                    algebra_normalize(gt).alias("tn"))
    return let(spec, body)


def match_answer(response: str | Column) -> Column:
    """MS-10: locate the answer span in free text by the last answer marker,
    a boxed answer, the last sentence, and the last 'is/=/:' style marker.
    struct(matched, answer); matched requires a digit in the span."""
    def cut_after(v, marker):
        low = F.lower(v)
        i = _rfind(low, marker)
        rest = py_strip(v.substr(i + len(marker) + 1, F.lit((1 << 31) - 1)))
        rest = F.when(rest.endswith("\n"), rest.substr(F.lit(1), F.length(rest) - 2)).otherwise(rest)
        return F.struct(F.when(i >= 0, rest).otherwise(v).alias("r"), (i >= 0).alias("m"))

    def cut_before(v, marker):
        low = F.lower(v)
        i = _rfind(low, marker)
        rest = py_strip(v.substr(F.lit(1), i))
        rest = F.when(rest.endswith("\n"), rest.substr(F.lit(1), F.length(rest) - 2)).otherwise(rest)
        return F.struct(F.when(i >= 0, rest).otherwise(v).alias("r"), (i >= 0).alias("m"))

    st = F.struct(_c(response).alias("r"), F.lit(False).alias("m"))

    def step(fn, marker):
        return lambda s: let(fn(s["r"], marker), lambda o: F.struct(o["r"].alias("r"), (s["m"] | o["m"]).alias("m")))

    for mk in ("answer:", "answer is", "answers are"):
        st = let(st, step(cut_after, mk))
    for mk in ("is answer", "is the answer", "are answers", "are the answers"):
        st = let(st, step(cut_before, mk))
    st = let(st, lambda s: let(_last_boxed_strict(s["r"]), lambda b: F.struct(
        F.coalesce(b, s["r"]).alias("r"), (s["m"] | b.isNotNull()).alias("m"))))
    st = let(st, lambda s: let(_rfind(F.lower(s["r"]), ". "), lambda i: F.struct(
        F.when(i >= 0, py_strip(s["r"].substr(F.lit(1), i))).otherwise(s["r"]).alias("r"), s["m"].alias("m"))))
    for mk in ("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n"):
        st = let(st, step(cut_after, mk))
    return let(st, lambda s: F.struct((s["m"] & s["r"].rlike(r"\p{Nd}")).alias("matched"), s["r"].alias("answer")))


def _last_boxed_strict(s: Column) -> Column:
    """Stripped content of the first brace pair behind the last \\boxed, or
    \\fbox if there is none; NULL if there is no closed pair or it is empty."""
    def inside(tail):
        # depth after each character; the pair closes where it first returns to 0
        st = F.aggregate(F.split(tail, ""), F.struct(F.lit(0).alias("d"), F.lit(0).alias("i"), F.lit(0).alias("a"), F.lit(0).alias("z")),
                         lambda s, c: F.struct(
                             (s["d"] + F.when(s["z"] > 0, 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("d"),
                             (s["i"] + 1).alias("i"),
                             F.when((s["a"] == 0) & (c == "{"), s["i"] + 1).otherwise(s["a"]).alias("a"),
                             F.when((s["z"] == 0) & (c == "}") & (s["d"] == 1), s["i"] + 1).otherwise(s["z"]).alias("z")))
        return let(st, lambda p: F.when((p["a"] > 0) & (p["z"] > 0),
                                        F.nullif(py_strip(tail.substr(p["a"] + 1, p["z"] - p["a"] - 1)), F.lit(""))))

    def tail_of(v):
        return let(_rfind(v, "\\boxed"), lambda i: let(_rfind(v, "\\fbox"), lambda j: F.when(
            i >= 0, v.substr(i + 1, F.length(v))).when(j >= 0, v.substr(j + 1, F.length(v)))))
    return let(tail_of(s), inside)
