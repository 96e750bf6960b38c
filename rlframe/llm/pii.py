"""Personal data in whole texts: fixed patterns and a semi-Markov CRF.

The base patterns decide e-mail addresses, IP addresses, card and phone
numbers. Around digits and @ signs, a semi-Markov conditional random field
scores every candidate segment of up to ``MAX_TOKENS`` tokens by features of
the whole span (shape, digit count, checksum, word before) and of the types
that meet; dynamic programming picks boundaries and types together. Entities
it finds outside base spans, secrets among them, are added.

The field is trained by stochastic gradient on at most ``TRAIN_ZONES`` zones
of the table, chosen by hash over all rows, labelled by the base patterns and
by the assignment of a long key.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
TRAIN_ZONES = 400
EPOCHS = 4
RATE = 0.5
MAX_TOKENS = 16
MARGIN = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\w+|\W")
_SECRET = re.compile(r"(?i)(?:token|secret|key|password)[ ]?[=:][ ]?\"?([A-Za-z0-9+/_-]{16,})")
_WORD_BEFORE = re.compile(r"(\w+)\W*\Z")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind and start."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGITS.findall(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches within ``MARGIN`` characters of a digit or @, cut at white space.

    A zone's ends are walked once: what lies in the zone before is not walked
    again, so a text without white space costs its length."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.start() + MARGIN)
        done = out[-1][1] if out else -1
        if b <= done:
            continue
        while a > max(done, 0) and not text[a].isspace() and text[a - 1] not in " \n":
            a -= 1
        while b < len(text) and text[b] not in " \n":
            b += 1
        if a <= done:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def candidates(zone: str) -> tuple[list[tuple[int, int]], list[list[tuple[int, tuple[str, ...]]]]]:
    """Tokens of a zone and, per end token, (start token, features) of the
    segments that may be an entity."""
    toks = [m.span() for m in _TOKEN.finditer(zone)]
    kind = []
    for a, b in toks:
        c = zone[a]
        kind.append("\n" if c == "\n" else "w" if c.isalnum() or c == "_" else c)
    has_digit = [bool(_DIGITS.search(zone[a:b])) for a, b in toks]
    by_end: list[list[tuple[int, tuple[str, ...]]]] = [[] for _ in toks]
    for i, (a, _) in enumerate(toks):
        if kind[i] not in "w+(":
            continue
        before = _WORD_BEFORE.search(zone, max(0, a - 30), a)
        before = before[1].lower() if before else ""
        digit = at = False
        for j in range(i, min(len(toks), i + MAX_TOKENS)):
            if kind[j] == "\n":
                break
            digit |= has_digit[j]
            at |= kind[j] == "@"
            b = toks[j][1]
            if kind[j] in "w" and (digit or at) and b - a >= 7:
                by_end[j].append((i, span_features(zone[a:b], before, j - i + 1)))
    return toks, by_end


@lru_cache(maxsize=50_000)
def span_features(span: str, before: str, tokens: int) -> tuple[str, ...]:
    """Features of a whole candidate span."""
    digits = "".join(_DIGITS.findall(span))
    plain = span.replace(" ", "").replace("-", "")
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W0-9_]+", "a", span))
    shape = re.sub(r"(?:9a|a9)[9a]*", "h", shape)
    out = ["bias", f"shape:{shape[:24]}", f"digits:{min(len(digits), 24)}", f"tokens:{tokens}",
           f"first:{shape[:1]}", f"long:{min(len(span) // 8, 6)}"]
    if plain.isdigit() and plain.isascii() and 13 <= len(plain) <= 19:
        out.append(f"luhn:{luhn(plain)}:{len(plain) >= 16}")
    parts = span.split(".")
    if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
        out.append(f"octets:{all(len(p) < 4 and int(p) < 256 for p in parts)}")
    if "@" in span:
        out.append(f"at:{span.count('@')}:{'.' in span.rpartition('@')[2]}:{' ' in span}")
    if before in ("token", "secret", "key", "password"):
        out.append(f"key:{tokens == 1}:{len(span) >= 16}")
    if " " in span and not digits:
        out.append("words")
    return tuple(out)


class Field:
    """Weights of whole-span features by type, and of neighbouring types.

    Type 0 is text outside entities, one token at a time, with score 0."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.follow = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def score(self, features) -> np.ndarray:
        out = np.zeros(len(KINDS))
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                out += w
        return out

    def decode(self, zone: str) -> list[Span]:
        """The best segmentation's entities."""
        toks, by_end = candidates(zone)
        n, k = len(toks), len(KINDS) + 1
        if not any(by_end):
            return []
        best = np.full((n + 1, k), -np.inf)
        best[0, 0] = 0.0
        back: list[list[tuple[int, int]]] = [[(0, 0)] * k for _ in range(n + 1)]
        for j in range(n):
            into = best[j] + self.follow[:, 0]
            p = int(into.argmax())
            best[j + 1, 0], back[j + 1][0] = into[p], (j, p)
            for i, features in by_end[j]:
                ways = best[i][:, None] + self.follow[:, 1:]
                prev = ways.argmax(0)
                total = ways[prev, np.arange(k - 1)] + self.score(features)
                for y in np.flatnonzero(total > best[j + 1, 1:]):
                    best[j + 1, y + 1], back[j + 1][y + 1] = total[y], (i, int(prev[y]))
        out: list[Span] = []
        j, y = n, int(best[n].argmax())
        while j > 0:
            i, p = back[j][y]
            if y:
                out.append((KINDS[y - 1], toks[i][0], toks[j - 1][1]))
            j, y = i, p
        return out[::-1]

    def _forward(self, n: int, by_end, scores) -> np.ndarray:
        f = np.full((n + 1, len(KINDS) + 1), -np.inf)
        f[0, 0] = 0.0
        for j in range(n):
            f[j + 1, 0] = np.logaddexp.reduce(f[j] + self.follow[:, 0])
            for (i, _), s in zip(by_end[j], scores[j]):
                f[j + 1, 1:] = np.logaddexp(f[j + 1, 1:], np.logaddexp.reduce(f[i][:, None] + self.follow[:, 1:]) + s)
        return f

    def learn(self, zone: str, gold: list[Span], rate: float) -> float:
        """One gradient step; returns the negative log-likelihood."""
        toks, by_end = candidates(zone)
        n, k = len(toks), len(KINDS) + 1
        scores = [[self.score(x) for _, x in row] for row in by_end]
        f = self._forward(n, by_end, scores)
        log_z = np.logaddexp.reduce(f[n])
        b = np.full((n + 1, k), -np.inf)
        b[n] = 0.0
        by_start: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for j, row in enumerate(by_end):
            for x, (i, _) in enumerate(row):
                by_start[i].append((j, x))
        for i in range(n - 1, -1, -1):
            b[i] = self.follow[:, 0] + b[i + 1, 0]
            for j, x in by_start[i]:
                b[i] = np.logaddexp(b[i], np.logaddexp.reduce(self.follow[:, 1:] + scores[j][x] + b[j + 1, 1:], axis=1))
        starts = {a: t for t, (a, _) in enumerate(toks)}
        ends = {e: t for t, (_, e) in enumerate(toks)}
        want = {(starts[a], ends[e]): KINDS.index(kind) for kind, a, e in gold if a in starts and e in ends}
        grad_follow = np.zeros_like(self.follow)
        path, j, prev = [], 0, 0
        by_first = {i: (e, y) for (i, e), y in want.items()}
        while j < n:
            e, y = by_first.get(j, (j, -1))
            path.append((j, e, y + 1, prev))
            prev, j = y + 1, e + 1
        gold_score = 0.0
        steps: dict[str, np.ndarray] = {}
        for i, e, y, p in path:
            grad_follow[p, y] += 1
            gold_score += self.follow[p, y]
        for j, row in enumerate(by_end):
            grad_follow[:, 0] -= np.exp(f[j] + self.follow[:, 0] + b[j + 1, 0] - log_z)
            for (i, features), s in zip(row, scores[j]):
                joint = np.exp(f[i][:, None] + self.follow[:, 1:] + (s + b[j + 1, 1:])[None, :] - log_z)
                grad_follow[:, 1:] -= joint
                g = -joint.sum(0)
                y = want.get((i, j))
                if y is not None:
                    g[y] += 1
                    gold_score += s[y]
                if np.abs(g).max() > 1e-4:
                    for x in features:
                        steps[x] = steps.get(x, 0.0) + g
        for x, g in steps.items():
            self.weights[x] = self.weights.get(x, np.zeros(len(KINDS))) * (1 - 1e-3 * rate) + rate * g
        self.follow += 0.1 * rate * grad_follow
        return float(log_z - gold_score)


def weak_labels(zone: str) -> list[Span]:
    """Non-overlapping spans that the patterns name in a zone, for training."""
    found = base_spans(zone) + [("secret", *m.span(1)) for m in _SECRET.finditer(zone)]
    out: list[Span] = []
    for s in sorted(found, key=lambda s: (s[1], -s[2])):
        if not out or s[1] >= out[-1][2]:
            out.append(s)
    return out


def train(zone_texts: list[str]) -> Field:
    field = Field()
    for epoch in range(EPOCHS):
        for z in zone_texts:
            field.learn(z, weak_labels(z), RATE / (1 + epoch))
    return field


def added_spans(text: str, base: list[Span], decode) -> list[Span]:
    """Entities of the field that no base span overlaps."""
    out = []
    for a, b in zones(text):
        for kind, s, e in decode(text[a:b]):
            s, e = a + s, a + e
            if all(e <= x or s >= y for _, x, y in base):
                out.append((kind, s, e))
    return out


def join_spans(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def _triggered(text: str = "text"):
    return F.when(F.col(text).rlike("[0-9@]"), F.col(text))


def training_zones(docs: DataFrame) -> list[str]:
    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column("t").to_pylist():
                for a, b in zones(t):
                    if b - a <= 400:
                        rows.append((hashlib.md5(t[a:b].encode()).hexdigest(), t[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.string())], names=["h", "zone"])
    rows = docs.select(_triggered().alias("t")).filter("t is not null").mapInArrow(run, "h string, zone string")
    # copies of a zone are one case to learn from
    return [r.zone for r in rows.dropDuplicates(["h", "zone"]).orderBy("h", "zone").limit(TRAIN_ZONES).collect()]


def fit(docs: DataFrame) -> Field:
    return train(training_zones(docs))


COLUMNS = "spans string, base_spans string, n_email long, n_ip long, n_card long, n_phone long"


def find_private(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with the columns of ``COLUMNS`` in place of nothing: all its
    columns stay but those that clash with them, which are replaced.

    Null and empty texts have no spans. Each row is judged by itself, so
    repeated rows get equal results; an empty table gives an empty field and
    no rows. Offsets count code points, ends exclusive."""
    field = field or fit(docs)
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    keep = [c for c in docs.columns if c not in names]
    source = docs.select(*[docs[c] for c in keep], _triggered().alias("_seen"))

    def run(batches):
        decode = lru_cache(maxsize=20_000)(field.decode)
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for t in batch.column("_seen").to_pylist():
                base = base_spans(t) if t else []
                more = added_spans(t, base, decode) if t else []
                count = [sum(s[0] == k for s in base) for k in BASE_KINDS]
                for c, v in zip(cols, [join_spans(base + more), join_spans(base), *count]):
                    c.append(v)
            kinds = [pa.string(), pa.string()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, cols, kinds)],
                                             names=[*keep, *names])
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), COLUMNS])
    return source.mapInArrow(run, shape)


def masked(text: str | None, spans: str) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping
    spans are replaced together, by the kind of the first."""
    if not text or not spans:
        return text
    out, end = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(","))):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def mask_private(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced by its kind in brackets.

    All other columns stay as they are, whatever their names. Null and empty
    texts stay; repeated rows get equal texts; an empty table gives no rows."""
    field = field or fit(docs)

    def run(batches):
        decode = lru_cache(maxsize=20_000)(field.decode)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, t in enumerate(texts):
                if t and _TRIGGER.search(t):
                    base = base_spans(t)
                    texts[i] = masked(t, join_spans(base + added_spans(t, base, decode)))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c)
                                              for c in batch.schema.names], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
