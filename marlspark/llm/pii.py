"""Personal data by weak supervision.

Candidate spans of four kinds get votes (1, -1, or 0 for none) from labelers: the strict regular expressions, a
structure test (checksum, number of digits, range of parts), gazetteers (top-level domains, calling codes, card
issuers) and the words before the span, the last four of the REACH characters before it. Expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability; its posteriors then train a logistic classifier on the votes and the span's shape, which decides
about candidates that the strict expressions don't give. Strict matches always stay.

Patterns are at most 4 kinds * 3^4 votes * 12 shapes however large the corpus is, so only their counts, taken over all
documents, go to the driver. Texts are read once for the counts and once for the spans, and never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "structure", "gazetteer", "context")
ADD_FROM, REACH = 0.9, 40
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wider than the strict expressions: they also find numbers that stand right beside others, and masked addresses.
WIDE = {
    "email": re.compile(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]+(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20|\.)\x20?[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}|[0-9]{12,19})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+?[0-9]{1,3}[\x20.-]?)?\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9])"),
}
DOMAINS = frozenset("com org net edu gov info biz io co us uk de fr es it nl eu ch at".split())
CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98".split())
ISSUERS = ("4", "34", "37", "51", "52", "53", "54", "55", "6011", "65", "35", "22", "23", "24", "25", "26", "27")
FOR = {"email": "mail e-mail email contact write", "ip": "ip host server address from", "card": "card visa credit debit pay mastercard", "phone": "phone tel call mobile fax ring"}
FOR = {k: frozenset(v.split()) for k, v in FOR.items()}
AGAINST = frozenset("version release isbn issn order invoice serial ticket build rev section chapter".split())
WORDS = re.compile(r"[a-z-]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of LOCAL+@DOMAIN, leftmost and apart, in linear time: a start can only lie in the run before an @."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def strict(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches, by start, then kind."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    if "+" in text:
        found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _structure(kind: str, s: str, digits: str) -> int:
    if kind == "card":
        return 1 if luhn(digits) and len(set(digits)) > 2 else -1
    if kind == "ip":
        return 1 if all(int(p) <= 255 for p in s.split(".")) else -1
    if kind == "phone":
        return 1 if 10 <= len(digits) <= 13 else -1 if len(digits) < 9 else 0
    return 1 if "[" in s or "(" in s or "@" in s or " dot " in s else -1


def _gazetteer(kind: str, s: str, digits: str) -> int:
    if kind == "email":
        return 1 if re.split(r"[^A-Za-z]+", s)[-1].lower() in DOMAINS else -1
    if kind == "card":
        return 1 if digits.startswith(ISSUERS) else -1
    if kind == "phone":
        return (1 if digits.startswith(CODES) else -1) if s.startswith("+") else 0
    return -1 if digits.startswith("0") or s.split(".")[0] in ("0", "255") else 0


def _context(kind: str, text: str, start: int) -> int:
    words = WORDS.findall(text[max(0, start - REACH) : start].lower())[-4:]
    return -1 if AGAINST.intersection(words) else 1 if FOR[kind].intersection(words) else 0


def candidates(text: str) -> Iterator[tuple[int, int, str, tuple, bool]]:
    """(start, end, kind, pattern, whether it is a base match); pattern = (kind, votes, separators, digits)."""
    base = strict(text)
    spans = [(*x, True) for x in base]
    for kind, wide in WIDE.items():
        if kind == "email" and not ("[at]" in text or "(at)" in text or (" at " in text and " dot " in text)):
            continue
        spans += [(*m.span(), kind, False) for m in wide.finditer(text)]
    taken = sorted((a, b) for a, b, _ in base)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for start, end, kind, is_base in spans:
        if not is_base:
            k = bisect_left(starts, end)
            if k and ends[k - 1] > start:  # a base match reaches into it
                continue
        s = text[start:end]
        digits = _digits(s)
        votes = (1 if is_base else 0, _structure(kind, s, digits), _gazetteer(kind, s, digits), _context(kind, text, start))
        separators = 2 if "(" in s or "[" in s else 1 if re.search(r"[\x20.-]", s) else 0
        yield start, end, kind, (kind, *votes, separators, min(3, len(digits) // 5)), is_base


def pattern_counts(docs: DataFrame) -> dict[tuple, int]:
    """Counts of the patterns of all candidates in docs(text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                if text:
                    seen.update(p for _, _, _, p, _ in candidates(text))
        rows = [("|".join(map(str, p)), n) for p, n in seen.items()]
        yield pd.DataFrame(rows, columns=["p", "n"]).astype({"p": "object", "n": "int64"})

    found = docs.select("text").mapInPandas(count, "p string, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()
    out = {}
    for r in found:
        kind, *rest = r["p"].split("|")
        out[(kind, *map(int, rest))] = r["n"]
    return out


def reliabilities(counts: dict[tuple, int], rounds: int = 50) -> tuple[dict[str, float], dict[tuple, float]]:
    """EM with one accuracy per labeler, abstentions apart: ({labeler: accuracy}, {pattern: P(personal data)})."""
    accuracy, prior = dict(zip(LABELERS, (0.95, 0.85, 0.75, 0.75), strict=True)), 0.5
    post: dict[tuple, float] = {}
    for _ in range(rounds):
        for p in counts:
            odds = prior / (1 - prior)
            for name, v in zip(LABELERS, p[1:5], strict=True):
                odds *= (accuracy[name] / (1 - accuracy[name])) ** v
            post[p] = odds / (1 + odds)
        total = sum(counts.values())
        for k, name in enumerate(LABELERS, 1):
            right = sum(n * (post[p] if p[k] > 0 else 1 - post[p]) for p, n in counts.items() if p[k])
            voted = sum(n for p, n in counts.items() if p[k])
            accuracy[name] = min(0.99, max(0.55, (right + 8) / (voted + 10)))
        prior = min(0.9, max(0.1, sum(n * post[p] for p, n in counts.items()) / max(1, total)))
    return accuracy, post


def encode(p: tuple) -> np.ndarray:
    """The classifier's features of a pattern; whether the strict expression matched is not one of them."""
    kind = KINDS.index(p[0])
    x = [1.0, *(float(kind == k) for k in range(4))]
    x += [float(kind == k) * p[2] for k in range(4)] + [float(v) for v in p[3:5]]
    return np.array(x + [float(p[5] == k) for k in range(3)] + [float(p[6] == k) for k in range(4)])


def train(counts: dict[tuple, int], post: dict[tuple, float], ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression on the patterns with soft labels, by Newton's method."""
    w = np.zeros(len(encode(("email", 0, 0, 0, 0, 0, 0))))
    if not counts:
        return w
    x, y, n = np.stack([encode(p) for p in counts]), np.array([post[p] for p in counts]), np.array([float(counts[p]) for p in counts])
    n = n / n.sum() * min(n.sum(), 1e6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + ridge * w
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w = w - step / max(1.0, np.abs(step).max() / 2)
    return w


def classifier(counts: dict[tuple, int]) -> dict[tuple, float]:
    """P(personal data) of each pattern that occurs."""
    _, post = reliabilities(counts)
    w = train(counts, post)
    return {p: float(1 / (1 + np.exp(-np.clip(encode(p) @ w, -30, 30)))) for p in counts}


def spans_of(text: str, scores: dict[tuple, float], add_from: float = ADD_FROM) -> tuple[list, list]:
    """(base spans, all spans), each (start, end, kind) by start, then kind; added ones don't overlap."""
    base, more, end = [], [], -1
    for start, stop, kind, pattern, is_base in candidates(text):
        if is_base:
            base.append((start, stop, kind))
        elif scores.get(pattern, 0) >= add_from and pattern[2] > 0:
            more.append((start, stop, kind))
    added = []
    for x in sorted(more, key=lambda x: (x[0], -x[1])):
        if x[0] >= end:
            added.append(x)
            end = x[1]
    return base, sorted([*base, *added], key=lambda x: (x[0], KINDS.index(x[2])))


def written(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", add_from: float = ADD_FROM) -> DataFrame:
    """One row per input row: id_col, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans, n_spans.

    A null or empty text has no spans; null ids and repeated rows stay as they are; an empty table gives none; further
    columns don't matter, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    scores = classifier(pattern_counts(rows))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                base, spans = spans_of(text or "", scores, add_from)
                n = Counter(kind for _, _, kind in base)
                out.append((i, *(n[k] for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans)))
            yield pd.DataFrame(out, columns=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    found = rows.mapInPandas(find, "id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *found.columns[1:])


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
