"""Personal data: base patterns plus boosted candidate spans.

Base spans follow fixed rules (e-mail, IPv4, card, phone).  On top, high-recall
generators propose overlapping candidates of the same kinds (other separators,
spelled-out or bracketed signs, missing country sign), gradient-boosted trees
score each by its format and context, and a threshold per kind, calibrated on
held-out candidates for precision, selects the spans that are added.

The trees learn from a bounded sample: the documents of lowest hash, about
``SAMPLE_DOCS`` of them and at most ``SAMPLE_ROWS`` feature rows.  Base spans
and rewritten forms of them (digits regrouped, signs spelled out, two numbers side by
side) are the positive rows; parts of those, stretches over both and corrupted ones (wrong check digit, octet beyond 255, dates and
book numbers in the place of phone numbers) and
candidates that overlap no base span are the negative rows, but for those that
would be a base span if they stood alone (two cards with a space between are
one failing match), whose label is open.  Only that sample
and the model (a few kB) pass through the driver.

Edge cases: a null text counts as empty and has no span; without a base span
in the sample of some kind nothing is added for that kind; repeated rows are
scored alike; other columns pass through ``redact`` untouched.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 20_000
SAMPLE_ROWS = 40_000
PRECISION = 0.98

Span = tuple[int, int, str]

# --- base rules -------------------------------------------------------------

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part is the run of its characters before an @."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules by start, then kind as listed."""
    out: list[Span] = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- candidates and their features ------------------------------------------

_AT = r"(?:@| ?\(at\) ?| ?\[at\] ?| at )"
_DOT = r"(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )"
_WIDE_EMAIL = re.compile(rf"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}")
_WIDE_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|\[\.\]|\(\.\)| \. ){_DIGIT.pattern}{{1,3}}){{3}}(?![0-9])")
_EMAIL_CORE = re.compile(rf"{_AT}[A-Za-z0-9-]{{1,63}}{_DOT}[A-Za-z0-9-]")
_GROUP = re.compile(r"(?<![0-9A-Za-z])[0-9]++(?![A-Za-z])")
_GAP = re.compile(r"[ ().\-/_]{1,2}")


def _numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, digits) of every stretch of 7 to 19 digits between separators or ends of a run."""
    groups = [m.span() for m in _GROUP.finditer(text)]
    for i, (a, b) in enumerate(groups):
        n = b - a
        start = a - (text[a - 1:a] == "(")
        start -= text[start - 1:start] == "+" and start > 0
        for j in range(i, len(groups)):
            if j > i:
                if not _GAP.fullmatch(text, groups[j - 1][1], groups[j][0]):
                    break
                n += groups[j][1] - groups[j][0]
            if n > 19:
                break
            if n >= 7:
                yield start, groups[j][1], n


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of high recall; a stretch of digits may be proposed as card and as phone."""
    out: list[Span] = []
    if _EMAIL_CORE.search(text):
        out += [(m.start(), m.end(), "email") for m in _WIDE_EMAIL.finditer(text)]
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _WIDE_IP.finditer(text)]
        for a, b, n in _numbers(text):
            if n <= 15:
                out.append((a, b, "phone"))
            if n >= 13:
                out.append((a, b, "card"))
    return out


_CUES = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("tel", "phone", "call", "fax", "mobile")}
N_FEATURES = 20


def features(text: str, span: Span) -> list[float]:
    """Format of the span and its close context, as numbers."""
    a, b, kind = span
    s = text[a:b]
    d = _digits(s)
    groups = [g for g in re.split(r"[^0-9]+", s) if g] or [""]
    left, right = text[a - 1:a], text[b:b + 1]
    before = text[max(0, a - 24):a].lower()

    def shape(c: str) -> int:
        return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4

    octets = [int(g[:6]) for g in groups if g]
    marks = re.sub(r"[0-9A-Za-z]", "", s)
    return [len(s), len(d), len(groups), max(map(len, groups)), min(map(len, groups)),
            s.startswith("+"), s.startswith("00"), luhn(d) if 13 <= len(d) <= 19 else -1,
            max(octets, default=0), len(set(d)), len(set(marks)), len(marks),
            shape(left), shape(right), any(c in before for c in _CUES[kind]),
            sum(c in s for c in "()"), s.count("-"), s.count("."), len(re.findall(r"dot|\(at\)|\[at\]", s)),
            len(re.split(_DOT, s)[-1])]


def _rewritten(s: str, kind: str, rng: np.random.Generator) -> tuple[str, str]:
    """A positive and a negative form of a base span."""
    if kind == "email":
        local, _, domain = s.rpartition("@")
        signs = [("(at)", "(dot)"), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) ")][rng.integers(4)]
        return local + signs[0] + domain.replace(".", signs[1]), f"{local} at {domain.split('.')[0]}.{rng.integers(10)}"
    if kind == "ip":
        parts = s.split(".")
        return ["[.]", "(.)", " . "][rng.integers(3)].join(parts), ".".join([*parts[:3], str(rng.integers(256, 999))])
    d = _digits(s)
    if kind == "card":
        sep = [".", "/", "_", "  "][rng.integers(4)]
        wrong = d[:-1] + str((int(d[-1]) + rng.integers(1, 10)) % 10)
        return sep.join(d[i:i + 4] for i in range(0, len(d), 4)), wrong
    rest = d[-10:]
    sep = [" ", ".", "-", "/"][rng.integers(4)]
    form = [f"({rest[:3]}) {rest[3:6]}-{rest[6:]}", sep.join((rest[:3], rest[3:6], rest[6:])), f"00{d}"][rng.integers(3)]
    year, month, day, hour, minute = (int(rng.integers(*r)) for r in ((1950, 2050), (1, 13), (1, 29), (0, 24), (0, 60)))
    other = [rest[:int(rng.integers(7, 11))], f"{year}-{month:02}-{day:02} {hour:02}:{minute:02}",
             f"{day:02}.{month:02}.{year} {hour:02}:{minute:02}", f"{year}/{month:02}/{day:02}",
             f"978-{rest[0]}-{rest[1:3]}-{rest[3:9]}-{rest[9]}"][rng.integers(5)]
    return form, other


def _parts(text: str, numbers: list[Span], low: int, high: int) -> list[tuple[str, int, list[float]]]:
    """Negative rows: stretches from ``low`` to ``high`` that are none of ``numbers``; a valid card's label is open."""
    return [(c[2], 0, features(text, c)) for c in candidates(text)
            if c[2] in ("card", "phone") and low <= c[0] and c[1] <= high and not any(c[:2] == n[:2] for n in numbers)
            and not (c[2] == "card" and any(c[1] - c[0] == n[1] - n[0] for n in numbers) and luhn(_digits(text[c[0]:c[1]])))]


def labelled(text: str, seed: int) -> list[tuple[str, int, list[float]]]:
    """(kind, label, features) rows that one text of the sample gives."""
    base = base_spans(text)
    rows = []
    rng = np.random.default_rng(seed & 0x7FFFFFFF)
    for a, b, kind in base:
        rows.append((kind, 1, features(text, (a, b, kind))))
        for label, form in zip((1, 0), _rewritten(text[a:b], kind, rng)):
            near, whole = text[max(0, a - 24):a], form
            if kind == "phone" and ":" in form:  # a candidate ends before the minutes
                form = form[:form.index(":")]
            around = near + whole + text[b:b + 1]
            own = (len(near), len(near) + len(form), kind)
            rows.append((kind, label, features(around, own)))
            if kind in ("card", "phone"):
                rows += _parts(around, [own] if label else [], own[0], own[0] + len(whole))
        if kind in ("card", "phone"):  # two numbers with a space between
            other = "".join(map(str, rng.integers(0, 10, len(_digits(text[a:b])) - 1)))
            other = next(o for o in (other + str(i) for i in range(10)) if luhn(o))
            first, second = (_rewritten(o, kind, rng)[0] for o in (text[a:b], other))
            near = text[max(0, a - 24):a]
            at = len(near) + len(first) + 1
            around = f"{near}{first} {second}{text[b:b + 1]}"
            whole = [(len(near), at - 1, kind), (at, at + len(second), kind)]
            rows += [(kind, 1, features(around, s)) for s in whole] + _parts(around, whole, len(near), at + len(second))
    for a, b, kind in candidates(text):
        alone = (0, b - a, kind) in base_spans(text[a:b])
        if not alone and not any(x < b and a < y for x, y, k in base if k == kind):
            rows.append((kind, 0, features(text, (a, b, kind))))
    return rows


# --- boosted trees -----------------------------------------------------------

@dataclass(frozen=True)
class Trees:
    """Symmetric trees: ``depth`` (feature, cut) tests per tree give the leaf's number."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    threshold: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for k in range(f.size):
                at = 2 * at + (x[:, f[k]] > c[k])
            out += leaf[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3) -> Trees:
    """Gradient boosting on the logistic loss with second-order leaf values."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1])) for j in range(x.shape[1])]
    tests = [(j, c) for j, cs in enumerate(cuts) for c in cs]
    above = np.stack([x[:, j] > c for j, c in tests], 1)
    margin = np.zeros(len(x))
    fs, cs, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(x), np.int64)
        chosen = []
        for k in range(depth):
            n = 2 ** k
            hot = np.eye(n)[at]
            g1, h1 = (hot * g[:, None]).T @ above, (hot * h[:, None]).T @ above
            g0, h0 = (hot * g[:, None]).sum(0)[:, None] - g1, (hot * h[:, None]).sum(0)[:, None] - h1
            gain = (g1 ** 2 / (h1 + 1) + g0 ** 2 / (h0 + 1)).sum(0)
            best = int(gain.argmax())
            chosen.append(tests[best])
            at = 2 * at + above[:, best]
        leaf = rate * np.bincount(at, g, 2 ** depth) / (np.bincount(at, h, 2 ** depth) + 1)
        margin += leaf[at]
        fs.append([j for j, _ in chosen])
        cs.append([c for _, c in chosen])
        leaves.append(leaf)
    return Trees(np.array(fs), np.array(cs), np.array(leaves), np.inf)


def calibrated(trees: Trees, x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> Trees:
    """``trees`` with the lowest margin at which held-out precision is still ``precision``.

    It is never below even odds, whatever the share of positive rows.
    """
    m = trees.margin(x)
    order = np.argsort(-m, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(m[order][1:] < m[order][:-1], True)
    good = np.flatnonzero((right >= precision) & last)
    return Trees(trees.feature, trees.cut, trees.leaf, max(0.0, float(m[order][good[-1]])) if good.size else np.inf)


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS,
          sample_rows: int = SAMPLE_ROWS, precision: float = PRECISION) -> dict[str, Trees]:
    """A model per kind from the bounded sample described above."""
    rows = docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text).cast("string").alias("t"))
    one_in = max(1, rows.count() // sample_docs)
    sample = rows.where((F.pmod("h", F.lit(one_in)) == 0) & F.col("t").rlike("[0-9@]"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, *row) for h, t in zip(*(c.to_pylist() for c in batch.columns)) for row in labelled(t, h)]
            h, kind, label, x = zip(*found) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(kind, pa.string()), pa.array(label, pa.int32()),
                 pa.array([list(map(float, v)) for v in x], pa.list_(pa.float64()))], names=["h", "kind", "label", "x"])

    got = (sample.mapInArrow(run, "h long, kind string, label int, x array<double>")
           .orderBy("h", "kind", "label", "x").limit(sample_rows).toPandas())
    out = {}
    for kind in KINDS:
        own = got[got["kind"] == kind]
        y = own["label"].to_numpy(float)
        if y.sum() < 5 or (1 - y).sum() < 5:
            continue
        x = np.array(own["x"].tolist(), float)
        held = (own["h"].to_numpy() >> 7) % 3 == 0  # documents of the calibration part
        if min(y[held].size, y[~held].size) == 0 or len(set(y[~held])) < 2:
            continue
        out[kind] = calibrated(boost(x[~held], y[~held]), x[held], y[held], precision)
    return out


def spans(text: str, model: dict[str, Trees]) -> tuple[list[Span], list[Span]]:
    """(base spans, base spans and those the model adds), each by start, then kind.

    Candidates that overlap a base span of whatever kind are settled by it, and
    those that overlap each other by the one furthest above its threshold.
    """
    base = base_spans(text)
    new = [c for c in candidates(text) if c[2] in model
           and not any(x < c[1] and c[0] < y for x, y, _ in base)]
    good = []
    for kind in {c[2] for c in new}:
        own = [c for c in new if c[2] == kind]
        m = model[kind].margin(np.array([features(text, c) for c in own], float)) - model[kind].threshold
        good += [(-v, a - b, a, b, kind) for (a, b, _), v in zip(own, m) if v >= 0]
    added: list[Span] = []  # by start, none overlap
    for *_, a, b, kind in sorted(good):
        i = bisect.bisect_left(added, (a, b, kind))
        if not (i and added[i - 1][1] > a or i < len(added) and added[i][0] < b):
            added.insert(i, (a, b, kind))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def masked(text: str, found: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    out, end = [], 0
    merged: list[list] = []
    for a, b, kind in found:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        out += [text[end:a], f"[{kind.upper()}]"]
        end = b
    return "".join([*out, text[end:]])


def find(docs: DataFrame, model: dict[str, Trees], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, all spans, for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("t"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = (f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, "
              + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [spans(t or "", sent.value) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in both], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in both]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()),
                 pa.array([_joined(every) for _, every in both], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return rows.mapInArrow(run, schema)


def personal_data(docs: DataFrame) -> DataFrame:
    """The spans of every row of ``docs``, the model trained on a sample of them."""
    return find(docs, train(docs))


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with every span masked in ``text`` and ``length`` counted anew; other columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, text=text))
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [t if t is None else masked(t, spans(t, sent.value)[1]) for t in batch.column(at).to_pylist()]
            columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = list(docs.columns)
    out = docs.mapInArrow(run, docs.schema)
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.col(length).isNotNull(), F.char_length(text)).cast(docs.schema[length].dataType))
    return out
