"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans which the patterns miss.

The model reads candidate spans of several kinds and chooses boundaries and kinds of a zone together. It learns from the
corpus' own spans in other spellings: addresses with words for signs, numbers in other groups and without their sign,
secrets without the word before them, among decoys such as dates, versions and plain numbers.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.llm.common import hash_sample, one_text_each

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
#: Bounds: tokens of a candidate span, code points of a zone beside a trigger, training texts and pieces of text.
SPAN_TOKENS, REACH, TRAIN_DOCS, TRAIN_PIECES = 24, 128, 4_000, 500
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot begin inside a run of digits whose start did not match, so the looks behind change no result.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Each @ once: its local part reaches back to the end of the match before it at most, so time stays linear."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done, "email"
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns: leftmost, not overlapping within a kind; matches that fail a kind's test go."""
    found = list(_emails(text)) if "@" in text else []
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


# --- candidates ------------------------------------------------------------------------------------------------------

#: Words that stand for the signs of an address, alone or in brackets.
_AT = re.compile(r"(?i)@|[(\[{<]\x20?at\x20?[)\]}>]|\bat\b")
_DOT = re.compile(r"(?i)\.|[(\[{<]\x20?(?:dot|\.)\x20?[)\]}>]|\bdot\b")
#: What may belong to personal data: digits, signs of an address, long runs of letters and digits. A token apart from all
#: of them is in no candidate, so a zone without one has one segmentation only.
_TRIGGER = re.compile(r"(?i)[0-9@]+|[(\[{<]\x20?(?:at|dot)\x20?[)\]}>]|\bat(?=\x20[a-z0-9-]+(?:\x20dot\x20|\.)[a-z])|(?<=[a-z0-9]\x20)dot(?=\x20[a-z])|[a-z0-9_/+=-]{24,}")
_WORD, _NEXT_WORD = re.compile(r"\S*"), re.compile(r"\s?\S*")
_PIECE = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
_NUMERIC = re.compile(r"[0-9+().\x20\[\]/-]+")
_WORDY = re.compile(r"(?i)(?:[a-z0-9._%+-]|\x20?(?:@|[(\[{<]\x20?(?:at|dot)\x20?[)\]}>]|\b(?:at|dot)\b)\x20?)+")
_KEYWORD = re.compile(r"(?i)(?:pass(?:word|wd)?|pwd|token|secret|api[_-]?key|auth|key)\W{0,4}$")
#: The corpus' own secrets, whose values are learned from with and without the word before them.
_NAMED_SECRET = re.compile(r"(?i)\b(?:password|token|secret|api[_-]?key)\s*[=:]\s*\"?([A-Za-z0-9]{12,})\"?")


def zones(text: str) -> list[tuple[int, int]]:
    """Ranges around triggers, out to the next blanks, beside signs of an address out to those beyond them, REACH code
    points at most on either side; ranges that touch or lie one code point apart are one."""
    out: list[list[int]] = []
    done = 0
    for m in _TRIGGER.finditer(text):
        if m.end() <= done:
            continue
        beside = _WORD if m.group()[0].isdigit() else _NEXT_WORD
        a = m.start() - beside.match(text[max(done, m.start() - REACH) : m.start()][::-1]).end()
        b = beside.match(text, m.end(), m.end() + REACH).end()
        if out and a - out[-1][1] <= 1:
            out[-1][1] = b
        else:
            out.append([a, b])
        done = b
    return [(a, b) for a, b in out]


def _span_features(text: str, a: int, b: int, tokens: int) -> list[float]:
    """Features of a whole candidate span and of what stands beside it."""
    s = text[a:b]
    n = b - a
    digits = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    words = re.findall(r"[A-Za-z]+", s)
    counts = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    before, after = text[a - 1 : a], text[b : b + 2]
    joined = before.isalnum() or before in ("+", "@", "%") or (before in ("-", ".", "_", "/", ":") and text[max(a - 2, 0) : a - 1].isalnum())
    runs_on = after[:1].isalnum() or (after[:1] in ("@", "-", ".", "_", "/", ":", "[") and after[1:2].isalnum())
    at = _AT.search(s)
    dots = len(_DOT.findall(s[at.end() :])) if at else 0
    plain, k = s.isalnum(), len(digits)
    numeric = not words
    return [
        1.0,
        float(bool(at) and not numeric),
        float(bool(at) and dots > 0 and 2 <= len(words[-1]) <= 6 if words else False),
        float(bool(at) and len(_AT.findall(s)) == 1 and " " not in s[: at.start()].rstrip() if at else False),
        min(dots, 3) / 3,
        float(numeric and len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)),
        float(numeric and len(groups) == 4 and s.count(".") == 3),
        float(numeric and 12 <= k <= 19),
        float(numeric and 12 <= k <= 19 and luhn(digits)),
        float(numeric and 9 <= k <= 11),
        float(numeric and 7 <= k <= 8),
        float(numeric and k > 19),
        float(numeric and len(groups) > 1 and len({len(g) for g in groups}) == 1),
        float(numeric and 3 <= len(groups) <= 5 and len(groups[-1]) == 4),
        float(numeric and len(groups) == 1),
        float(numeric and len(groups) == 2),
        float(s[0] == "+"),
        float("(" in s and numeric),
        float("/" in s or ":" in s),
        float(plain and bool(digits) and k < n),
        float(plain and n >= 12 and k < n),
        float(plain and n >= 20 and 0 < k < n),
        float(plain and k == 0),
        float(plain and all(c in "0123456789abcdefABCDEF" for c in s) and k < n),
        k / n,
        entropy / 4,
        min(n, 40) / 40,
        tokens / SPAN_TOKENS,
        float(bool(_KEYWORD.search(text, max(0, a - 16), a))),
        float(before in ("=", '"', "'")),
        float(joined),
        float(runs_on),
        float(" " in s),
    ]


FEATURES = 33


def candidates(text: str, zone: tuple[int, int]) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
    """Number of tokens, candidate spans as token ranges and as code points, and their features.

    A candidate has 7 code points or more and SPAN_TOKENS tokens or fewer, begins and ends with a letter or digit, or
    begins with a sign of a number, and holds a trigger. Blanks stand within numbers or beside the signs of an address.
    """
    pieces = [(m.start(), m.end()) for m in _PIECE.finditer(text, *zone)]
    ranges, points, rows = [], [], []
    blank = [text[a].isspace() for a, _ in pieces]
    for i, (a, b0) in enumerate(pieces):
        if not (text[a].isalnum() or (text[a] in "+(" and text[b0 : b0 + 1].isdigit())):
            continue
        spaced = False
        for j in range(i, min(i + SPAN_TOKENS, len(pieces))):
            b = pieces[j][1]
            spaced = spaced or blank[j]
            if b - a < 7 or not text[b - 1].isalnum():
                continue
            s = text[a:b]
            if spaced and not _NUMERIC.fullmatch(s):
                if not _AT.search(text, a, zone[1]):
                    break
                if not (_AT.search(s) and _WORDY.fullmatch(s)):
                    continue
            if _TRIGGER.search(s):
                ranges.append((i, j + 1))
                points.append((a, b))
                rows.append(_span_features(text, a, b, j + 1 - i))
    return len(pieces), ranges, points, np.array(rows).reshape(-1, FEATURES)


# --- what the model learns from ---------------------------------------------------------------------------------------

_ATS, _DOTS = (" at ", " (at) ", "(at)", " [at] ", "[at]", " @ "), (" dot ", " (dot) ", "[dot]", ".")
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def respelled(kind: str, value: str, rng: np.random.Generator) -> str:
    """A span's value as it is, or written in a way that no fixed pattern finds."""
    if rng.random() < 0.35:
        return value
    pick = lambda options: options[int(rng.integers(len(options)))]
    digits = _digits(value)
    if kind == "email":
        name, _, host = value.partition("@")
        return name + pick(_ATS) + host.replace(".", pick(_DOTS))
    if kind == "ip":
        return value.replace(".", pick(("[.]", "(.)", ".")))
    if kind == "card":
        return pick(("-", " ", ".", "/")).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "phone":
        body = digits[-10:]
        sign = pick((".", "-", " "))
        return pick((f"({body[:3]}) {body[3:6]}-{body[6:]}", sign.join((body[:3], body[3:6], body[6:])), f"00{digits[:-7]}{sign}{digits[-7:-4]}{sign}{digits[-4:]}", f"0{body[1:4]}/{body[4:]}"))
    size = int(rng.integers(16, 44))
    return "".join(rng.choice(list("0123456789abcdef" if rng.random() < 0.5 else _LETTERS), size))


def decoy(rng: np.random.Generator) -> str:
    """Digits and signs that are no personal data."""
    n = lambda a, b: int(rng.integers(a, b))
    number = "".join(str(n(0, 10)) for _ in range(n(5, 20)))
    made = (f"{n(1990, 2030)}-{n(1, 13):02d}-{n(1, 29):02d}", f"{n(0, 24):02d}:{n(0, 60):02d}:{n(0, 60):02d}", f"{n(1, 20)}.{n(0, 20)}.{n(0, 99)}", f"{n(1, 29)}/{n(1, 13)}/{n(1990, 2030)}", f"{n(100, 999)}.{n(100, 999)}.{n(100, 999)}", f"{n(1, 9999)}-{n(1, 9999)}", number, f"{n(1000, 9999999)}", f"978-{n(0, 9)}-{n(1000, 9999)}-{n(1000, 9999)}-{n(0, 9)}", f"look at page.{n(1, 9)}", "https://www.example.org/2024/05/index7.html", f"DA{n(20, 99)}x{n(1000, 9999)}", f"{n(1, 99)} {n(100, 999)} {n(100, 999)}", f"{n(1, 999)},{n(100, 999)},{n(100, 999)}.{n(10, 99)}", "a-compound-word-of-several-parts")
    value = made[n(0, len(made))]
    digits = _digits(value)
    return value if not (12 <= len(digits) <= 19 and luhn(digits)) else "1234567"


def learned_from(text: str, rng: np.random.Generator) -> tuple[str, dict[tuple[int, int], str]]:
    """A piece of text with its spans respelled and a decoy put in: the new text, and the kind of each span."""
    spans = base_spans(text) + [(*m.span(1), "secret") for m in _NAMED_SECRET.finditer(text)]
    named = {m.start(1): m for m in _NAMED_SECRET.finditer(text)}
    out, told, at = "", {}, 0
    for a, b, kind in sorted(spans):
        if a < at:
            continue
        if kind == "secret" and rng.random() < 0.6:  # without the word before it
            whole = named[a]
            out += text[at : max(at, whole.start())]
            value = respelled(kind, text[a:b], rng)
            told[len(out), len(out) + len(value)] = kind
            out, at = out + value, whole.end()
            continue
        out += text[at:a]
        value = respelled(kind, text[a:b], rng)
        told[len(out), len(out) + len(value)] = kind
        out, at = out + value, b
    out += text[at:]
    return f"{out} {decoy(rng)} {decoy(rng)}.", told


# --- the model -------------------------------------------------------------------------------------------------------


@dataclass
class SpanModel:
    weights: np.ndarray  # FEATURES x kinds

    def best(self, n: int, ranges: list[tuple[int, int]], features: np.ndarray) -> list[tuple[int, int]]:
        """(candidate, kind) of the segmentation with the highest score; a token outside all spans scores 0."""
        score = features @ self.weights
        kind = score.argmax(axis=1)
        top = score[np.arange(len(kind)), kind]
        ending: dict[int, list[int]] = {}
        for c, (_, j) in enumerate(ranges):
            if top[c] > 0:
                ending.setdefault(j, []).append(c)
        value, came = [0.0] * (n + 1), [-1] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for c in ending.get(j, ()):
                total = value[ranges[c][0]] + top[c]
                if total > value[j]:
                    value[j], came[j] = total, c
        out, j = [], n
        while j > 0:
            c = came[j]
            if c >= 0:
                out.append((c, int(kind[c])))
                j = ranges[c][0]
            else:
                j -= 1
        return out[::-1]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """The spans of the model, of all kinds; each of `base` lies within such a span or apart from it, and none is one
        of `base` itself."""
        out = []
        fixed = {(a, b) for a, b, _ in base}
        for zone in zones(text):
            n, ranges, points, features = candidates(text, zone)
            if ranges:
                for c, kind in self.best(n, ranges, features):
                    a, b = points[c]
                    apart = all(b <= x or y <= a for x, y, _ in base)
                    if apart or (KINDS[kind] not in BASE and (a, b) not in fixed and all(b <= x or y <= a or (a <= x and y <= b) for x, y, _ in base)):
                        out.append((a, b, KINDS[kind]))
        return out


Example = tuple[int, list[tuple[int, int]], np.ndarray, dict[int, int]]


def example(text: str, zone: tuple[int, int], told_spans: dict[tuple[int, int], str]) -> Example | None:
    """A zone as span_crf_fit() reads it: tokens, candidates, features, and which candidates are spans of which kind."""
    n, ranges, points, features = candidates(text, zone)
    if not ranges:
        return None
    told = {c: KINDS.index(told_spans[p]) for c, p in enumerate(points) if p in told_spans}
    return n, ranges, features, told


@dataclass
class Lattice:
    """The candidates of many zones as arrays: of each its row (a zone), first and last token, and all features in one matrix. Zones
    are walked together, a position at a time; candidates stand in order of their end, and of their start for the way back."""

    features: np.ndarray
    row: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    tokens: np.ndarray  # of each zone
    told: np.ndarray  # (candidate, kind)

    @classmethod
    def of(cls, examples: list[Example]) -> Lattice:
        sizes = [len(ranges) for _, ranges, _, _ in examples]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        spans = np.concatenate([np.array(ranges, np.int64).reshape(-1, 2) for _, ranges, _, _ in examples])
        told = [(starts[z] + c, kind) for z, (_, _, _, known) in enumerate(examples) for c, kind in known.items()]
        return cls(np.concatenate([f for _, _, f, _ in examples]), np.repeat(np.arange(len(examples)), sizes), spans[:, 0], spans[:, 1], np.array([n for n, _, _, _ in examples]), np.array(told, np.int64).reshape(-1, 2))

    def sums(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log sums over the segmentations of tokens before, and from, each place: zones x (tokens + 1). Beyond a zone's last
        token, `ahead` stays as it was there, `behind` begins there."""
        zones, most = len(self.tokens), int(self.tokens.max())
        ahead, behind = np.zeros((zones, most + 1)), np.zeros((zones, most + 1))
        by_stop, by_first = np.argsort(self.stop, kind="stable"), np.argsort(self.first, kind="stable")
        at_stop = np.searchsorted(self.stop[by_stop], np.arange(most + 2))
        at_first = np.searchsorted(self.first[by_first], np.arange(most + 2))
        for j in range(1, most + 1):
            ahead[:, j] = ahead[:, j - 1]
            c = by_stop[at_stop[j] : at_stop[j + 1]]
            np.logaddexp.at(ahead[:, j], self.row[c], ahead[self.row[c], self.first[c]] + whole[c])
        for i in range(most - 1, -1, -1):
            behind[:, i] = behind[:, i + 1]
            c = by_first[at_first[i] : at_first[i + 1]]
            np.logaddexp.at(behind[:, i], self.row[c], behind[self.row[c], self.stop[c]] + whole[c])
        return ahead, behind


def likelihood(examples: list[Example] | Lattice, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean log likelihood of the told spans among all segmentations of their zones, and its gradient."""
    x = examples if isinstance(examples, Lattice) else Lattice.of(examples)
    score = x.features @ w
    whole = np.logaddexp.reduce(score, axis=1)
    ahead, behind = x.sums(whole)
    every = ahead[np.arange(len(x.tokens)), x.tokens]
    reach = ahead[x.row, x.first] + behind[x.row, x.stop] - every[x.row]
    share = -np.exp(score + reach[:, None])
    share[x.told[:, 0], x.told[:, 1]] += 1
    total = score[x.told[:, 0], x.told[:, 1]].sum() - every.sum()
    return float(total) / len(x.tokens), x.features.T @ share / len(x.tokens)


def span_crf_fit(examples: list[Example], rounds: int = 60, rate: float = 0.3, ridge: float = 1e-3) -> np.ndarray:
    """Weights that maximise the likelihood of the told spans, less a ridge."""
    w, lattice = np.zeros((FEATURES, len(KINDS))), Lattice.of(examples)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        grad = ridge * w - likelihood(lattice, w)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(docs: DataFrame, seed: int = 17) -> SpanModel:
    """Fits on at most TRAIN_PIECES pieces around digits and @ of at most TRAIN_DOCS texts, both chosen by a seeded hash.

    Each piece is read as it is and respelled, see learned_from(). Null and empty texts and rows of null doc_id teach
    nothing. Without pieces an idle model is returned, which adds no span.
    """
    texts = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", F.col("text").cast("string"))
    ids = hash_sample(texts.where(F.col("doc_id").isNotNull()).select("doc_id"), "doc_id", TRAIN_DOCS, seed)

    def surroundings(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(d, a, t[max(0, a - REACH) : b + REACH]) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for a, b in zones(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "at", "piece"])

    pieces = one_text_each(texts, ids).mapInPandas(surroundings, "doc_id long, at long, piece string")
    order = F.xxhash64(F.lit(seed), "doc_id", "at")
    rng = np.random.default_rng(seed)
    examples = []
    for row in pieces.orderBy(order, "doc_id", "at", "piece").limit(TRAIN_PIECES).collect():
        text, told = learned_from(row["piece"], rng)
        examples += [e for zone in zones(text) if (e := example(text, zone, told))]
    return SpanModel(span_crf_fit(examples) if examples else np.zeros((FEATURES, len(KINDS))))


def personal_data(docs: DataFrame, model: SpanModel) -> DataFrame:
    """Spans in each row of `docs` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret and
    n_added.

    Whole texts are read; null texts count as empty. Counts of the four kinds and base_sha256 are those of the fixed
    patterns; spans also holds the n_added spans of the model, of these kinds or of the kind secret, which cut no span of
    a pattern in two. Of segmentations that score alike the one with the earlier choice stands. Rows that repeat or have
    no doc_id come out once each; an empty table gives an empty table.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for text in pdf["text"]:
                base = base_spans(text or "")
                more = model.added(text or "", base)
                n = Counter(k for _, _, k in base)
                out.append((*(n[k] for k in BASE), hashlib.sha256(written(base).encode()).hexdigest(), written(ordered(base + more)), sum(k == "secret" for _, _, k in more), len(more)))
            names = [*(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_secret", "n_added"]
            yield pd.DataFrame(out, columns=names, index=pdf.index).assign(doc_id=pdf["doc_id"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_added long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, schema)


def redacted(text: str | None, model: SpanModel) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced as one."""
    if text is None:
        return None
    base = base_spans(text)
    out, at = [], 0
    for a, b, kind in ordered(base + model.added(text, base)):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: SpanModel) -> DataFrame:
    """`docs` with personal data in text replaced; other columns as they are. Null texts stay null, empty ones empty; rows that repeat
    or have no doc_id come out once each; an empty table gives an empty table."""

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t, model))

    return docs.withColumn("text", replaced(F.col("text").cast("string")))
