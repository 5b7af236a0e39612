"""Personal data by weak supervision.

Patterns propose spans; four labelers vote on each: a check of the span itself, a
gazetteer, the words around it, and what it touches. Expectation-maximisation over
the counts of vote patterns estimates how reliable each labeler is, and its
probabilities teach a logistic span classifier, which sees none of the votes but
features of the text itself, so it also judges spans whose votes never occurred.
Spans of the strict patterns (the base) always stay; the classifier decides on the
looser ones.

Counts of vote patterns cover all spans of all texts. The classifier learns from a
bounded number of spans of each kind, chosen by hash.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchweave.llm.common import map_batches, small_batches
from matchweave.sources.scratch import scratch_table

#: Base kinds in order of output, then the looser ones.
BASE = ["email", "ip", "card", "phone"]
LOOSE = ["email_written", "ip_range", "card_other", "card_part", "phone_local", "phone_part", "ssn", "iban", "secret"]
KINDS = BASE + LOOSE
YES, NO, ABSTAIN = 0, 1, 2
LABELERS = ["check", "gazetteer", "context", "shape"]
#: Hashed features of the classifier.
FEATURES = 1 << 10

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_PHONE_PART = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")
#: Looser patterns: text that must be there at all, then the pattern. Runs are taken whole, however long; an
#: IBAN has at most 34 characters by its standard.
_LOOSE = {
    "email_written": ((" dot ", "[dot]", "(dot)"), re.compile(r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{2,}+ ?(?:\[at\]|\(at\)|\bat\b) ?[A-Za-z0-9-]{2,}+ ?(?:\[dot\]|\(dot\)|\bdot\b) ?[A-Za-z]{2,}+\b")),
    "phone_local": (("1", "2", "3", "4", "5", "6", "7", "8", "9"), re.compile(r"(?<![\w+(-])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])")),
    "ssn": (("-",), re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    "iban": (("0", "1", "2", "3", "4", "5", "6", "7", "8", "9"), re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    "secret": (
        ("AKIA", "password", "passwd", "token", "secret", "api_key", "apikey", "ghp_", "sk-", "xox"),
        re.compile(r"\bAKIA[0-9A-Z]{16,}+|\b(?:ghp_|sk-|xox[a-z]-)[A-Za-z0-9_-]{16,}+|\b(?:password|passwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9_/+-]{12,}+(?:\.[A-Za-z0-9_/+-]{4,}+)*={0,2}\"?"),
    ),
}
_CARD_WORDS, _PHONE_WORDS = ("card", "visa", "credit", "pay"), ("phone", "call", "tel", "fax", "mobile")
_MAIL_WORDS, _HOST_WORDS = ("mail", "contact", "write"), ("ip", "host", "server", "address")
#: Words that announce a kind, looked for around a span.
_CONTEXT = {
    "email": _MAIL_WORDS, "email_written": _MAIL_WORDS, "ip": _HOST_WORDS, "ip_range": _HOST_WORDS, "card": _CARD_WORDS, "card_other": _CARD_WORDS, "card_part": _CARD_WORDS,
    "phone": _PHONE_WORDS, "phone_local": _PHONE_WORDS, "phone_part": _PHONE_WORDS, "ssn": ("ssn", "social"), "iban": ("iban", "bank", "account"), "secret": ("key", "login", "user", "access"),
}
#: Words that speak against a span.
_AGAINST = ("version", "order", "isbn", "serial", "invoice", "page", "section", "figure", "part no", "sample", "placeholder")
#: Common top-level domains, first digits of card issuers, country calling codes, IBAN countries, prefixes of keys.
_TOP = {"com", "org", "net", "edu", "gov", "mil", "int", "io", "ai", "app", "dev", "de", "fr", "es", "it", "nl", "be", "at", "ch", "pl", "pt", "se", "no", "dk", "fi", "ie", "uk", "us", "ca", "au", "nz", "jp", "cn", "in", "br", "mx", "ru", "eu", "info", "biz", "example"}
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "35", "62")
_CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "64", "65", "81", "82", "86", "90", "91")
_IBAN_COUNTRIES = {"AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "HU", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "RO", "SE", "SK"}
_KEYS = ("AKIA", "ghp_", "sk-", "xox")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, found from each @ outwards in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if at >= free and (after := _DOMAIN.match(text, at + 1)):
            lo = at
            while lo > free and (text[lo - 1].isascii() and (text[lo - 1].isalnum() or text[lo - 1] in "._%+-")):
                lo -= 1
            if lo < at:
                out.append((lo, after.end()))
                free = after.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind number, start, end) of the base, and of pattern matches that fail its tests."""
    good, bad = [], []
    if "@" in text:
        good += [(0, a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            (good if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")) else bad).append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            (good if 16 <= len(digits) <= 19 and luhn(digits) else bad).append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                (good if 8 <= sum(c.isdigit() for c in m[0]) <= 15 else bad).append((3, *m.span()))
    return good, bad


def card_parts(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Leftmost runs of whole digit groups in ``text[a:b]`` that make a card number."""
    groups = [(a + m.start(), m[0]) for m in re.finditer(r"[0-9]+", text[a:b])]
    out, k = [], 0
    while k < len(groups):
        digits = ""
        for n in range(k, len(groups)):
            digits += groups[n][1]
            if len(digits) > 19:
                break
            if len(digits) >= 16 and luhn(digits):
                out.append((groups[k][0], groups[n][0] + len(groups[n][1])))
                k = n
                break
        k += 1
    return out


def loose_spans(text: str, taken: list[tuple[int, int, int]], failed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans outside ``taken`` that looser patterns, or failed base matches, propose; none overlaps another."""
    found = []
    for kind, a, b in failed:
        if kind == 1:
            found.append((KINDS.index("ip_range"), a, b))
        elif kind == 3:
            found += [(KINDS.index("phone_part"), *m.span()) for m in _PHONE_PART.finditer(text, a, b)]
        elif parts := card_parts(text, a, b):
            found += [(KINDS.index("card_part"), *p) for p in parts]
        elif 13 <= sum(c.isdigit() for c in text[a : min(b, a + 40)]) <= 19 and b - a <= 40:
            found.append((KINDS.index("card_other"), a, b))
    for name, (needs, pattern) in _LOOSE.items():
        if any(x in text for x in needs):
            found += [(KINDS.index(name), *m.span()) for m in pattern.finditer(text)]
    out: list[tuple[int, int, int]] = []
    busy, end = [], 0  # the places taken, as disjoint ranges in order
    for a, b in sorted((a, b) for _, a, b in taken):
        if busy and a < end:
            end = max(end, b)
            busy[-1] = (busy[-1][0], end)
        else:
            busy.append((a, b))
            end = b
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2], s[0])):
        if out and a < out[-1][2]:
            continue
        k = bisect_left(busy, (b,)) - 1  # the last range that begins before b
        if k < 0 or busy[k][1] <= a:
            out.append((kind, a, b))
    return out


def _checked(name: str, span: str, digits: str) -> int:
    """What the span itself says: checksums, ranges, variety."""
    if name.startswith("email"):
        end = re.split(r"[.\s\])]+", span.rstrip(".)] "))[-1]
        good = end.isalpha() and 2 <= len(end) <= 24
    elif name.startswith("ip"):
        good = all(len(p) <= 3 and int(p) <= 255 and (p == "0" or p[0] != "0") for p in span.split("."))
    elif name.startswith("card"):
        good = len(digits) <= 19 and luhn(digits)
    elif name.startswith("phone"):
        good = 8 <= len(digits) <= 15 and len(set(digits)) > 2
    elif name == "ssn":
        good = digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    elif name == "iban":
        letters = span.replace(" ", "")
        good = int("".join(str(int(c, 36)) for c in letters[4:] + letters[:4])) % 97 == 1
    else:
        value = re.split(r"[=:]\s*", span, maxsplit=1)[-1]
        good = len(set(value)) >= 8 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return YES if good else NO


def _listed(name: str, span: str, digits: str) -> int:
    """What the gazetteers say."""
    if name.startswith("email"):
        return YES if re.split(r"[.\s\])]+", span.rstrip(".)] "))[-1].lower() in _TOP else ABSTAIN
    if name.startswith("ip"):
        return NO if span.startswith(("0.", "127.", "255.")) else YES if 1 <= int(span.split(".")[0][-4:]) < 224 else ABSTAIN
    if name.startswith("card"):
        return YES if digits.startswith(_ISSUERS) else NO
    if name.startswith("phone"):
        return (YES if digits.startswith(_CALLING) else NO) if span.startswith("+") else YES if digits[3:6] == "555" else ABSTAIN
    if name == "iban":
        return YES if span[:2] in _IBAN_COUNTRIES else NO
    return YES if name == "secret" and any(k in span for k in _KEYS) else ABSTAIN


def votes(text: str, kind: int, a: int, b: int) -> tuple[int, int, int, int]:
    """Check, gazetteer, context and shape labelers on one span."""
    name, span = KINDS[kind], text[a:b]
    digits = "".join(c for c in span if c in "0123456789")
    around = text[max(0, a - 40) : a].lower() + " | " + text[b : b + 20].lower()
    context = NO if any(w in around for w in _AGAINST) else YES if any(w in around for w in _CONTEXT[name]) else ABSTAIN
    left, right = text[a - 1 : a], text[b : b + 2]
    touches = left.isalnum() or left in ("_", "#", "$") or right[:1].isalnum() or (right[:1] in (".", "-", "_") and right[1:].isdigit())
    return _checked(name, span, digits), _listed(name, span, digits), context, NO if touches else YES


def pattern_of(text: str, kind: int, a: int, b: int) -> int:
    """Kind and votes of a span as one small number."""
    number = kind
    for v in votes(text, kind, a, b):
        number = number * 3 + v
    return number


def features(text: str, kind: int, a: int, b: int) -> np.ndarray:
    """Numbers of the hashed features that a span has: its characters, its shape and the words around it."""
    name, span = KINDS[kind], text[a : min(b, a + 512)]
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in span))[:40]
    share = lambda n: round(4 * n / len(span))
    known = [
        "", name, f"{name} size {min(7, (b - a) // 6)}", f"{name} digits {share(sum(c.isdigit() for c in span))}", f"{name} variety {min(8, len(set(span)) // 2)}",
        f"{name} begins {span[:2]}", f"{name} ends {span[-3:].lower()}", f"left {text[a - 1 : a]}", f"right {text[b : b + 1]}",
    ]
    if name.startswith("card"):
        known.append(f"{name} sum {luhn(''.join(c for c in span if c.isdigit()))}")
    known += [f"{name} shape {shape[k : k + 3]}" for k in range(max(1, len(shape) - 2))]
    known += [f"{name} before {w}" for w in re.findall(r"\w+", text[max(0, a - 40) : a].lower())[-3:]] + [f"{name} after {w}" for w in re.findall(r"\w+", text[b : b + 20].lower())[:1]]
    return np.unique([zlib.crc32(f.encode()) % FEATURES for f in known])


def unpack(pattern: int) -> tuple[int, tuple[int, ...]]:
    out = []
    for _ in LABELERS:
        pattern, v = divmod(pattern, 3)
        out.append(v)
    return pattern, tuple(reversed(out))


def reliabilities(patterns: dict[int, int], rounds: int = 50) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """Expectation-maximisation over vote patterns.

    Returns the chance of each outcome (yes, no, abstain) per labeler, for
    private and other spans; each kind's share of private spans; and each
    pattern's probability. Starts from the belief that votes are mostly right.
    """
    keys = sorted(patterns)
    if not keys:
        return np.full((len(LABELERS), 2, 3), 1 / 3), np.full(len(KINDS), 0.5), {}
    kinds, seen = zip(*map(unpack, keys), strict=True)
    kinds, seen, n = np.array(kinds), np.array(seen), np.array([patterns[k] for k in keys], dtype=float)
    chance = np.tile(np.array([[0.6, 0.1, 0.3], [0.2, 0.5, 0.3]]), (len(LABELERS), 1, 1))
    share = np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        log = np.stack([np.log(np.where(c, share, 1 - share))[kinds] + sum(np.log(chance[i, 1 - c, seen[:, i]]) for i in range(len(LABELERS))) for c in (1, 0)], axis=1)
        p = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -500, 500)))
        for i in range(len(LABELERS)):
            for c, w in ((0, p * n), (1, (1 - p) * n)):
                count = np.bincount(seen[:, i], w, 3) + chance[i, c] * 5  # a prior keeps outcomes possible
                chance[i, c] = count / count.sum()
        share = np.clip((np.bincount(kinds, p * n, len(KINDS)) + 1) / (np.bincount(kinds, n, len(KINDS)) + 2), 0.01, 0.99)
    return chance, share, dict(zip(keys, p.tolist(), strict=True))


@dataclass
class Model:
    """The labelers' reliabilities, each kind's share of private spans, and the classifier's weights."""

    chance: np.ndarray
    share: np.ndarray
    weights: np.ndarray

    def probability(self, text: str, kind: int, a: int, b: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[features(text, kind, a, b)].sum(), -30, 30))))


def train(patterns: dict[int, int], spans: list[tuple[int, np.ndarray]], rounds: int = 25, ridge: float = 1.0) -> Model:
    """Reliabilities from counts of vote patterns, and a classifier from (pattern, features) of some spans.

    Logistic regression by Newton steps on the probabilities that
    expectation-maximisation gives the spans' patterns. Without a span every
    probability is one half.
    """
    chance, share, target = reliabilities(patterns)
    w = np.zeros(FEATURES)
    if not spans:
        return Model(chance, share, w)
    x, y = np.zeros((len(spans), FEATURES)), np.array([target[p] for p, _ in spans])
    for row, (_, own) in zip(x, spans, strict=True):
        row[own] = 1
    some = np.flatnonzero(x.any(axis=0))
    x, v = x[:, some], np.zeros(len(some))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(v)), x.T @ (p - y) + ridge * v)
        v -= step
        if np.abs(step).max() < 1e-8:
            break
    w[some] = v
    return Model(chance, share, w)


def fit(docs: DataFrame, text_col: str = "text", fit_spans: int = 6500) -> Model:
    """Count the vote patterns of all spans of all texts and train the classifier.

    What reaches the driver is one count per pattern, at most len(KINDS) * 3**4,
    and at most ``fit_spans`` spans, shared evenly by the kinds, whatever the size
    of the corpus. Equal spans in equal surroundings count once among these.
    """
    each = fit_spans // len(KINDS)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        kept: list[dict[int, tuple[int, bytes]]] = [{} for _ in KINDS]  # by kind: hash -> pattern, features
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                good, bad = base_spans(text)
                for s in good + loose_spans(text, good, bad):
                    pattern = pattern_of(text, *s)
                    seen[pattern] += 1
                    place = zlib.crc32(text[max(0, s[1] - 20) : s[1] + 80].encode("utf-8", "replace"))
                    own = kept[s[0]]
                    if place not in own:
                        own[place] = pattern, features(text, *s).astype("<u2").tobytes()
                        if len(own) > 2 * each:
                            kept[s[0]] = {k: own[k] for k in heapq.nsmallest(each, own)}
        spans = [(kind, k, *own[k]) for kind, own in enumerate(kept) for k in heapq.nsmallest(each, own)]
        rows = [(p, n, None, None, None) for p, n in seen.items()] + [(p, None, kind, place, x) for kind, place, p, x in spans]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["pattern", "n", "kind", "place", "features"])

    found = scratch_table(map_batches(docs.select(F.col(text_col).cast("string")), count, "pattern int, n long, kind int, place long, features binary"), "spans")
    counts = found.where("n is not null").groupBy("pattern").agg(F.sum("n").alias("n"))
    spans = found.where("kind is not null").dropDuplicates(["kind", "place"]).withColumn("shard", F.col("place") % 64)
    for by in (["kind", "shard"], ["kind"]):  # first among shards, so that no task sorts what all others kept of a kind
        order = Window.partitionBy(*by).orderBy("place", "pattern", "features")
        spans = spans.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each)
    spans = spans.orderBy("kind", "place")
    return train({r["pattern"]: r["n"] for r in counts.collect()}, [(r["pattern"], np.frombuffer(r["features"], "<u2").astype(np.int64)) for r in spans.collect()])


def spans_of(text: str | None, model: Model | None, least: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans), each by kind and start; without a model none is added."""
    if not text:
        return [], []
    good, bad = base_spans(text)
    added = [s for s in loose_spans(text, good, bad) if model and model.probability(text, *s) >= least]
    return sorted(good), sorted(added)


def detect(docs: DataFrame, model: Model | None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end), in code points, end exclusive.

    ``least`` is the probability at which the classifier adds a span. Null and
    empty texts hold none; repeated rows and null ids stay; other columns are
    ignored.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(t, model, least) for t in batch.column(1).to_pylist()]
            lists = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in pair[side]] for pair in found], pa.list_(span)) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "base", "added"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, f"doc_id long, base {kind}, added {kind}")


def redact(docs: DataFrame, model: Model | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets, such as [EMAIL].

    Spans that overlap are replaced as one, under the kind that starts first.
    Null texts stay null; all columns stay.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            base, added = spans_of(text, model, least)
            parts, free = [], 0
            for a, b, kind in sorted((a, b, k) for k, a, b in base + added):
                if a >= free:
                    parts += [text[free:a], f"[{KINDS[kind].upper()}]"]
                free = max(free, b)
            out.append("".join([*parts, text[free:]]) if parts else text)
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))


def written(spans) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
