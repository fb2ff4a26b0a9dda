"""Personal data: plain rules, and boosted trees over spans that wide generators propose.

The rules give the base spans. Besides, generators with high recall propose overlapping spans; gradient-boosted
trees score them by their format and context; spans above the threshold of their kind, calibrated for precision on
held-out candidates, are added. The trees learn what the rules can't see: base spans of all documents are written in other
forms that no rule matches, in the places where they were found.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .registry import bounded_batches
from .words import slices

KINDS = ("email", "ip", "card", "phone")
#: Groups of equal candidates that the driver fits on its own, rows of one task beyond that, and trees after which scores are stored.
LOCAL_GROUPS, GROUP_ROWS, STORED = 60_000, 100_000, 8
#: Size of the ensemble.
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 32
#: Precision on held-out candidates that a threshold must reach, and candidates it must rest on.
PRECISION, SUPPORT = 0.995, 30
#: Thresholds tried for each unit of the log odds, and log odds beyond which they end.
STEPS, FARTHEST = 1000, 30
#: Sums over candidates are of whole numbers, so many to a unit: they don't depend on the order.
FIXED = 1 << 24

_BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
#: What the generators propose for each kind, never a piece of a longer number. Mail is found from what may stand for its sign.
_SIGN = re.compile(r"\s?@\s?|\s?[(\[]at[)\]]\s?| at ")
_NAME = re.compile(r"[^\s@<>()\[\],;:]{1,64}\Z")
_HOST = re.compile(r"[^\s@<>()\[\],;:]{1,64}(?:(?:\s?[(\[]dot[)\]]\s?| dot )[^\s@<>()\[\],;:]{1,64}){0,8}")
_WIDE = {
    "ip": re.compile(r"(?<![0-9a-zA-Z])[0-9a-fA-F]{1,4}(?:(?:[.:]|\[\.\]|\(\.\))[0-9a-fA-F]{1,4}){3,7}(?![0-9a-zA-Z])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,21}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+|00|\()?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,16}(?![0-9])"),
}
_HINT = re.compile(r"[0-9@]|[(\[]at[)\]]| at ")
# Words near personal data, and near numbers that are none.
_TELLING = re.compile(r"\b(?:e-?mail|mail|contact|write|phone|tel|call|mobile|fax|whatsapp|card|visa|mastercard|credit|pay|ip|address|server|client)\b", re.I)
_OTHER = re.compile(r"\b(?:order|invoice|isbn|issn|version|release|build|serial|part|item|sku|date|page|figure|fig|table|ref|ticket|id|no)\b", re.I)
FEATURES = 25
#: Characters around a rewritten span, and labelled candidates that leave a task together.
AROUND, TOGETHER = 64, 5_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(int((p.lstrip("0") or "0")[:4]) <= 255 for p in text.split("."))
    if kind == "email":
        return True
    digits = re.sub("[^0-9]", "", text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def _mails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the mail rule, from one sign to the next, so that no part of the text is read for each start in it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = _run_start(text, done, at)
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        done = host.end() if host else at + 1
        at = text.find("@", done)


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _run_start(text: str, low: int, end: int) -> int:
    while end > low and text[end - 1] in _LOCAL:
        end -= 1
    return end


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the ip rule: the parts of each chain of numbers, four by four."""
    for chain in _CHAIN.finditer(text):
        if chain[0].count(".") < 3:
            continue
        start, parts = chain.start(), chain[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            end = start + sum(map(len, parts[i : i + 4])) + 3
            yield start, end
            start = end + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` by the rules, by start and then by kind as listed; time is linear in the text."""
    found = [(a, b, "email") for a, b in _mails(text)] if "@" in text else []
    found += [(a, b, "ip") for a, b in _addresses(text) if _valid("ip", text[a:b])] if "." in text else []
    for kind in ("card", "phone"):
        if kind == "card" or "+" in text:
            found += [(m.start(), m.end(), kind) for m in _BASE[kind].finditer(text) if _valid(kind, m[0])]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans the generators propose; they may overlap, also between kinds."""
    if not _HINT.search(text):
        return []
    found = []
    for sign in _SIGN.finditer(text):
        name = _NAME.search(text[max(0, sign.start() - 64) : sign.start()])
        host = _HOST.match(text, sign.end())
        if name and host:
            found.append((sign.start() - len(name[0]), host.end() - (len(host[0]) - len(host[0].rstrip(".!?'\""))), "email"))
    return [s for s in found if s[0] < s[1]] + [(m.start(), m.end(), kind) for kind in _WIDE for m in _WIDE[kind].finditer(text)]


def normal(kind: str, span: str) -> str:
    """The span in the form of its rule, as far as it can be brought into it."""
    if kind == "email":
        span = re.sub(r"\s?[(\[]at[)\]]\s?| at |\s?@\s?", "@", span)
        return re.sub(r"\s?[(\[]dot[)\]]\s?| dot ", ".", span)
    if kind == "ip":
        return re.sub(r"[\[\]()]", "", span)
    return re.sub("[^0-9]", "", span.removeprefix("00") if kind == "phone" else span)


def plausible(kind: str, span: str) -> bool:
    """True if the span, brought into the form of its rule, is valid."""
    span = normal(kind, span)
    if kind == "email":
        return bool(_BASE["email"].fullmatch(span)) and span.rpartition(".")[2].isalpha()
    if kind == "ip":
        parts = re.split("[.:]", span)
        return len(parts) == 8 and "." not in span or len(parts) == 4 and ":" not in span and all(p.isdigit() for p in parts) and _valid("ip", span)
    return _valid(kind, span)


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format of a span and of what stands around it."""
    span, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 24]
    digits = re.sub("[^0-9]", "", span)
    runs = [len(r) for r in re.findall("[0-9]+", span)] or [0]
    parts = span.split(".")

    def side(c: str) -> int:
        return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4

    return [
        *[float(kind == k) for k in KINDS], len(span), len(digits), sum(c.isalpha() for c in span), span.count("."), span.count("-"), span.count("("),
        span.count(" "), span.count("@"), max(runs), len(runs), float(span.startswith("+")), float(len(digits) > 1 and luhn(digits)),
        float(len(parts) == 4 and all(p.isdigit() and int(p[:4]) <= 255 for p in parts)), side(before[-1:]), side(after[:1]),
        sum(c.isalpha() for c in before + after) / max(1, len(before + after)),
        float(plausible(kind, span)), float(bool(_TELLING.search(before))), float(bool(_OTHER.search(before))), len(set(digits)), sum(not c.isalnum() for c in span),
    ]


def rewritten(span: str, kind: str, pick: random.Random) -> list[tuple[str, bool]]:
    """Other forms of a base span with True, and what looks like them but is no personal data with False."""
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        name, _, host = span.partition("@")
        at, dot = pick.choice([(" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" @ ", "."), ("(at)", ".")])
        return [(name + at + host.replace(".", dot), True), (f"{name} at {host.partition('.')[0]}", False), (f"{name} at {pick.randrange(1, 12)}.{pick.randrange(10, 60)}", False)]
    if kind == "ip":
        groups = ":".join(f"{pick.randrange(65536):x}" for _ in range(8))
        dot = pick.choice(["[.]", "(.)"])
        return [(span.replace(".", dot), True), (groups, True), (":".join(f"{pick.randrange(60):02}" for _ in range(pick.randrange(4, 7))), False), (f"{pick.randrange(300, 999)}[.]{span.partition('.')[2].replace('.', '[.]')}", False)]
    if kind == "card":
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + pick.randrange(1, 10)) % 10)
        return [(".".join(groups), True), (".".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), False)]
    sep = pick.choice(" .-/")
    cut = max(1, len(digits) - 10)
    parts = [digits[:cut], digits[cut : cut + 3], digits[cut + 3 : cut + 6], digits[cut + 6 :]]
    day = f"{pick.randrange(1990, 2030)}-{pick.randrange(1, 13):02}-{pick.randrange(1, 29):02} {pick.randrange(24):02}.{pick.randrange(60):02}"
    return [
        (pick.choice(["00", "00 ", ""]) + sep.join(p for p in parts if p), True), (span.removeprefix("+"), True), (f"({parts[1]}) {parts[2]}-{parts[3]}", True),
        (digits, False), (day, False), (".".join(digits[i : i + 2] for i in range(0, 8, 2)), False),
    ]


def examples(text: str) -> Iterator[tuple[list[float], bool]]:
    """Labelled candidates of a text: all base spans rewritten in their places, and all candidates that are surely none.

    A candidate that covers a rewritten span is personal data, one that meets a look-alike is not. Of the other candidates
    outside base spans, those that no rule would pass in any form, or that follow a word for other numbers, are not; the rest
    is left out, as nothing is known of it.
    """
    spans = candidates(text)
    base = base_spans(text) if spans else []
    pick = random.Random(len(text))
    for c in _outside(spans, base):
        if not plausible(c[2], text[c[0] : c[1]]) or _OTHER.search(text[max(0, c[0] - 24) : c[0]]):
            yield features(text, *c), False
    for s, e, kind in base:
        before, after = text[max(0, s - AROUND) : s], text[e : e + AROUND]
        for form, right in rewritten(text[s:e], kind, pick):
            place, a, b = before + form + after, len(before), len(before) + len(form)
            if right and any(x < b and a < y and k == kind for x, y, k in base_spans(place)):
                continue  # the rule sees this form too
            for x, y, k in candidates(place):
                if k == kind and x < b and a < y:
                    same = min(y, b) - max(x, a) >= 0.8 * (max(y, b) - min(x, a))
                    yield features(place, x, y, k), right and same


def _outside(spans: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those of ``spans`` that overlap none of ``base``, which are sorted by start."""
    starts, ends, far = [], [], 0
    for s, e, _ in base:
        far = max(far, e)
        starts.append(s)
        ends.append(far)

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)  # of the base spans that start before b, the furthest end
        return not i or ends[i - 1] <= a

    return [c for c in spans if free(c[0], c[1])]


class Trees(NamedTuple):
    """Boosted trees of equal depth: a split per inner node, a value per leaf."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return 1 / (1 + np.exp(-out))


class Groups(NamedTuple):
    """Equal candidates, a row a group: bins of their features, how many they are, how many personal data, their log odds so far."""

    bins: np.ndarray  # groups x features
    n: np.ndarray
    good: np.ndarray
    raw: np.ndarray

    def raised(self, trees: list[tuple]) -> Groups:
        """With the log odds that ``trees`` add."""
        raw = self.raw.copy()
        for feature, cut, value in trees:
            raw += value[self._nodes(feature, cut, DEPTH) - len(feature)]
        return self._replace(raw=raw)

    def _nodes(self, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
        node, row = np.zeros(len(self.n), np.int64), np.arange(len(self.n))
        for _ in range(levels):
            node = 2 * node + 1 + (self.bins[row, feature[node]] > cut[node])
        return node

    def sums(self, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        """Gradients and weights in each node of a level and bin of a feature, times FIXED."""
        prob = 1 / (1 + np.exp(-self.raw))
        parts = [np.rint(v * FIXED) for v in (self.good - self.n * prob, self.n * np.maximum(prob * (1 - prob), 1e-9))]
        place = (self._nodes(feature, cut, level) - (2**level - 1)) * BINS
        out = np.array([[np.bincount(place + self.bins[:, f], v, 2**level * BINS) for v in parts] for f in range(FEATURES)])
        return out.reshape(FEATURES, 2, 2**level, BINS).astype(np.int64)


def quantiles(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Distinct edges between BINS parts of like size of sorted values that occur ``counts`` times."""
    at = np.linspace(0, 1, BINS + 1)[1:-1] * (counts.sum() - 1)
    low, ends = np.floor(at), np.cumsum(counts)
    a, b = (values[np.searchsorted(ends, np.minimum(x, ends[-1] - 1), "right")] for x in (low, low + 1))
    return np.unique(a + (b - a) * (at - low))


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def boost(edges: list[np.ndarray], start: float, sums, grown) -> Trees:
    """Newton boosting on the logistic loss with histograms of quantile bins.

    ``sums(feature, cut, level)`` gives the histograms of a level as ``Groups.sums`` does, ``grown(tree)`` is told of each tree.
    """
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    features_, cuts, values = [], [], []
    for _ in range(TREES):
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, BINS), np.zeros(leaves)
        for level in range(DEPTH):
            both = np.cumsum(sums(feature, cut, level), axis=3) / FIXED
            for i in range(2**level):
                k, best = 2**level - 1 + i, 1e-6
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    g, h = both[f, :, i, : len(e) + 1]
                    gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1)
                    if gain.max() > best:
                        best, feature[k], cut[k] = gain.max(), f, gain.argmax()
                if level == DEPTH - 1:
                    g, h = both[feature[k], :, i]
                    left = min(cut[k], BINS - 1)
                    value[2 * i : 2 * i + 2] = RATE * g[left] / (h[left] + 1), RATE * (g[-1] - g[left]) / (h[-1] - h[left] + 1)
        grown((feature, cut, value))
        features_.append(feature), values.append(value)
        cuts.append(np.array([edges[f][c] if c < BINS else np.inf for f, c in zip(feature, cut)]))
    return Trees(start, np.array(features_), np.array(cuts), np.array(values))


def _log_odds(n: float, good: float) -> float:
    p = min(max(good / n, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees of candidates that are all at hand."""
    edges = [quantiles(*np.unique(x[:, f], return_counts=True)) for f in range(x.shape[1])]
    return _boosted(edges, Groups(_binned(x, edges), np.ones(len(x)), np.asarray(y, float), np.full(len(x), _log_odds(len(y), y.sum()))))[0]


def _boosted(edges: list[np.ndarray], groups: Groups) -> tuple[Trees, list[tuple]]:
    """The trees, also as splits between bins."""
    state, trees = [groups], []

    def grown(tree: tuple) -> None:
        state[0] = state[0].raised([tree])
        trees.append(tree)

    return boost(edges, float(groups.raw[0]), lambda *of: state[0].sums(*of), grown), trees


class Detector(NamedTuple):
    trees: Trees
    threshold: dict[str, float]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Detector | None:
    """Trees and thresholds from the labelled candidates (``examples``) of all documents.

    Half of the documents are held out; a kind's threshold is the lowest log odds, in steps of 1 / STEPS, above which the precision
    on their candidates, none of which a rule finds, is high enough, and a kind without such a score adds nothing. None if there
    are not both classes. Candidates with the same bins are counted as one group. The driver fits the trees if it is sent few groups;
    beyond that each level of a tree is a job over all groups, with the same sums. The order and the files of the rows don't matter.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, half = [], [], []

        def out() -> pa.RecordBatch:
            values = pa.array(np.array(x, float).ravel())
            made = pa.RecordBatch.from_pydict({"x": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), values), "y": pa.array(y, pa.bool_()), "half": pa.array(half, pa.int32())})
            x.clear(), y.clear(), half.clear()
            return made

        for batch in batches:
            for text in batch.column("text").fill_null("").to_pylist():
                side = zlib.crc32(text.encode("utf-8", "surrogatepass")) % 2
                for values, right in examples(text):
                    x.append(values), y.append(right), half.append(side)
                    if len(x) == TOGETHER:
                        yield out()
        yield out()

    found = materialize(bounded_batches(docs).select(F.col(text_col).alias("text")).mapInArrow(label, "x array<double>, y boolean, half int"), "candidates")
    sides = {r.half: (r.n, r.good) for r in found.groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("good")).collect()}
    if len(sides) < 2 or not 0 < sides[0][1] < sides[0][0]:
        return None
    # Features are counts within a span and shares within its context of bounded size, so each has a bounded number of values.
    seen = found.where("half = 0").select(F.posexplode("x").alias("f", "value")).groupBy("f", "value").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = [sorted((r.value, r.n) for r in seen if r.f == f) for f in range(FEATURES)]
    edges = [quantiles(*np.array(x, float).T) for x in seen]

    def bin_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, FEATURES)
            bins = pa.array([row.tobytes() for row in _binned(x, edges)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("half"), pa.array(x[:, : len(KINDS)].argmax(axis=1), pa.int32()), bins, batch.column("y")], ["half", "kind", "bins", "y"])

    groups = found.mapInArrow(bin_, "half int, kind int, bins binary, y boolean").groupBy("half", "kind", "bins")
    start = _log_odds(*sides[0])
    groups = materialize(groups.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("good"), F.lit(start).alias("raw")), "groups")
    size = groups.count()
    if size <= LOCAL_GROUPS:
        rows = groups.toArrow()
        of = _groups(rows)
        half, kind = (rows.column(c).to_numpy() for c in ("half", "kind"))
        trees, splits = _boosted(edges, Groups(*(v[half == 0] for v in of)))
        held = Groups(*(v[half == 1] for v in of)).raised(splits)
        steps = list(zip(kind[half == 1].tolist(), _steps(held.raw).tolist(), held.n.tolist(), held.good.tolist()))
    else:
        groups = materialize(groups.repartition(-(-size // GROUP_ROWS)), "groups")
        trees, splits = _boosted_by_jobs(edges, start, groups.where("half = 0"))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = _steps(_groups(batch).raised(splits).raw)
                yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(step, pa.int32()), batch.column("n"), batch.column("good")], ["kind", "step", "n", "good"])

        steps = groups.where("half = 1").mapInArrow(score, "kind int, step int, n long, good long").groupBy("kind", "step").agg(F.sum("n"), F.sum("good")).collect()
    return Detector(trees, {kind: _threshold([s[1:] for s in steps if s[0] == i]) for i, kind in enumerate(KINDS)})


def _groups(rows: pa.RecordBatch | pa.Table) -> Groups:
    bins = np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(-1, FEATURES)
    return Groups(bins, *(rows.column(c).to_numpy().astype(float) for c in ("n", "good", "raw")))


def _steps(raw: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(raw, -FARTHEST, FARTHEST) * STEPS).astype(np.int64)


def _boosted_by_jobs(edges: list[np.ndarray], start: float, groups: DataFrame) -> tuple[Trees, list[tuple]]:
    """As ``_boosted``; each task sums up its groups, and the log odds are stored now and then."""
    kinds = "half int, kind int, bins binary, n long, good long, raw double"
    state, waiting, trees = [groups], [], []

    def sums(feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        pending = list(waiting)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((FEATURES, 2, 2**level, BINS), np.int64)
            for batch in batches:
                total += _groups(batch).raised(pending).sums(feature, cut, level)
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total.ravel()[cell])], ["cell", "total"])

        out = np.zeros(FEATURES * 2 * 2**level * BINS, np.int64)
        for row in state[0].mapInArrow(add, "cell int, total long").groupBy("cell").agg(F.sum("total").alias("total")).collect():
            out[row.cell] = row.total
        return out.reshape(FEATURES, 2, 2**level, BINS)

    def grown(tree: tuple) -> None:
        trees.append(tree), waiting.append(tree)
        if len(waiting) == STORED:
            pending = list(waiting)

            def raise_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield batch.set_column(batch.schema.get_field_index("raw"), "raw", pa.array(_groups(batch).raised(pending).raw))

            state[0] = materialize(state[0].mapInArrow(raise_, kinds), "groups")
            waiting.clear()

    return boost(edges, start, sums, grown), trees


def _threshold(steps: list[tuple[int, float, float]]) -> float:
    """The lowest score that is precise enough, from ``(step, n, good)`` of one kind; 2 if there is none."""
    steps = np.array(sorted(steps, reverse=True), float).reshape(-1, 3)
    last = np.append(steps[1:, 0] < steps[:-1, 0], True)[: len(steps)]  # a threshold takes all candidates of its step
    n, good = np.cumsum(steps[:, 1]), np.cumsum(steps[:, 2])
    fine = np.flatnonzero(last & (good >= PRECISION * n) & (n >= SUPPORT))
    return max(float(1 / (1 + np.exp(-steps[fine[-1], 0] / STEPS))), 0.5) if len(fine) else 2.0


def added_spans(text: str, base: list[tuple[int, int, str]], trees: Trees, threshold: dict[str, float]) -> list[tuple[int, int, str]]:
    """Candidates above their threshold that overlap no base span nor a better candidate."""
    spans = _outside(candidates(text), base)
    good: list[tuple[float, int, int, str]] = []
    for i in range(0, len(spans), 5_000):
        part = spans[i : i + 5_000]
        score = trees.score(np.array([features(text, *c) for c in part], float))
        good += [(-x, *c) for x, c in zip(score.tolist(), part) if x >= threshold[c[2]]]
    taken: list[tuple[int, int, str]] = []
    for _, a, b, kind in sorted(good):
        i = bisect_left(taken, (b,))
        if not i or taken[i - 1][1] <= a:
            insort(taken, (a, b, kind))
    return taken


def find_spans(docs: DataFrame, detector: Detector | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans, redacted)``: an array of ``(start, end, kind, base)`` and the text with spans masked.

    Offsets are code points, ends exclusive; spans are ordered by start, then by kind. Null text counts as empty.
    Null ids and repeated rows are documents like others; nothing is shuffled. An empty table gives no rows.
    """
    return _found(docs, detector, id_col, text_col, True)


def _found(docs: DataFrame, detector: Detector | None, id_col: str, text_col: str, redact: bool) -> DataFrame:
    detector = detector or fit(docs, id_col, text_col)
    trees = None if detector is None else tuple(detector.trees)
    threshold = {} if detector is None else detector.threshold
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None if trees is None else Trees(*trees)
        for batch in batches:
            for part in slices(batch):
                spans, texts = [], []
                for text in part.column("text").fill_null("").to_pylist():
                    base = base_spans(text) if _HINT.search(text) else []
                    more = added_spans(text, base, model, threshold) if model else []
                    both = sorted([(*s, True) for s in base] + [(*s, False) for s in more], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                    spans.append([{"start": s, "end": e, "kind": k, "base": b} for s, e, k, b in both])
                    if redact:
                        texts.append(_masked(text, both))
                columns = [part.column("doc_id"), pa.array(spans, span)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())] if redact else columns, ["doc_id", "spans", "redacted"][: 3 if redact else 2])

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, spans array<struct<start:int,end:int,kind:string,base:boolean>>"
    return rows.mapInArrow(scan, schema + (", redacted string" if redact else ""))


def _masked(text: str, spans: list[tuple[int, int, str, bool]]) -> str:
    out, at = [], 0
    for start, end, kind, _ in spans:
        if end <= at:
            continue
        out += [text[at : max(at, start)], f"<{kind}>"] if start >= at else []
        at = end
    return "".join([*out, text[at:]])


def span_digests(docs: DataFrame, detector: Detector | None = None, **columns: str) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of the same spans."""
    found = _found(docs, detector, columns.get("id_col", "doc_id"), columns.get("text_col", "text"), False)

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
