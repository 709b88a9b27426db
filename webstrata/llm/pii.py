"""Personal data in texts: fixed patterns, and candidates that boosted trees accept.

The patterns find the leftmost non-overlapping matches of a kind and drop those that fail a check, without a second
try; so a card number beside another, or a phone number followed by an address, is lost with the match that swallowed
it. Generators of high recall therefore propose overlapping candidates of every kind: tight and loose groupings,
spelled-out addresses, numbers inside longer runs. Boosted trees judge each by its format and context, and those above
the calibrated threshold of their kind are added where they overlap nothing already found.

The trees learn from values planted into the table's own texts (`planted`): personal data in every form the generators
propose, and look-alikes such as versions, order numbers, mutated card numbers or identifiers of hardware, with and
without words that hint at them. A planted value is a positive whatever its features say, candidates that cut it
differently are negatives, so labels come from how an example was made and not from a rule that is also a feature. A
bounded sample of different texts trains the trees; all texts of the held-out fold, their own candidates included,
calibrate them and set the threshold of each kind from counts by kind, label and score.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm import boosting
from webstrata.llm.frames import name
from webstrata.llm.tokens import slices

KINDS = ("email", "ip", "card", "phone")
#: Different texts from which the trees learn, about, and candidates of one text among them, at most.
SAMPLE_DOCS, SAMPLE_PER_TEXT = 10_000, 16
#: Precision that a kind's threshold must reach on the held-out fold.
PRECISION = 0.98
#: Margins are counted in bins of this width, up to this number on either side of zero.
BIN, BINS = 0.05, 200
Span = tuple[str, int, int]

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: if the run's start fails, so do its later digits.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from each @: the longest local part before it that is still free."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, accepted) of every match of the four patterns."""
    for start, end in _emails(text):
        yield "email", start, end, True
    for m in _IP.finditer(text):
        yield "ip", m.start(), m.end(), all(map(_small, m.groups()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            yield "card", m.start(), m.end(), 12 <= len(digits) <= 19 and luhn(digits)
    for m in _PHONE.finditer(text):
        yield "phone", m.start(), m.end(), 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15


# --- Candidates -------------------------------------------------------------------------------------------------------

_SPELLED = re.compile(r"\s?(?:\(at\)|\[at\]|\bat\b|@)\s?([A-Za-z0-9-]+(?:\s?(?:\(dot\)|\[dot\]|\bdot\b|\.)\s?[A-Za-z0-9-]+)+)")
_SPELLED_CUE = re.compile(r"[(\[ ](?:dot|at)[)\] ]|@")
_GENERATORS = (
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-][0-9]{4}){2,3}(?:[ .-][0-9]{1,3})?(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5}(?![0-9])")),
    ("phone", re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,4}(?![0-9])")),
    ("phone", re.compile(r"\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3}-[0-9]{4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])\([0-9]{2,4}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9.+-])0?[0-9]{2,4}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")),
)
_DIGIT = re.compile("[0-9]")


def candidates(text: str) -> list[Span]:
    """Spans that the generators propose, overlapping ones included, each once."""
    found: dict[Span, None] = {}
    if _SPELLED_CUE.search(text):
        for m in _SPELLED.finditer(text):
            start = m.start()
            while start > 0 and text[start - 1] in _LOCAL and m.start() - start < 64:
                start -= 1
            if start < m.start():
                found[("email", start, m.end())] = None
    if _DIGIT.search(text):
        for kind, pattern in _GENERATORS:
            for m in pattern.finditer(text):
                found[(kind, m.start(), m.end())] = None
    return list(found)


_CUES = {"email": re.compile(r"mail|contact|write|reach|@", re.I), "ip": re.compile(r"\bip\b|host|server|address|from", re.I),
         "card": re.compile(r"card|visa|master|amex|pay|credit", re.I), "phone": re.compile(r"phone|tel|call|mobile|fax|\+", re.I)}
_CONTRARY = re.compile(r"version|v\.|release|order|invoice|isbn|token|hash|key|section|[=#\"]", re.I)
CONTEXT = 30
_AT, _DOT = re.compile(r"[(\[]at[)\]]|\sat\s|@"), re.compile(r"[(\[]dot[)\]]|\sdot\s|\.")
_ENDING = re.compile(r"[^A-Za-z0-9-]([A-Za-z]{2,24})$")


def _spelling(m: re.Match | None) -> float:
    """0 without the sign, 1 spelled as a word, 2 in brackets, 3 as the sign itself."""
    return 0.0 if m is None else 1.0 if m.group()[0].isspace() else 2.0 if m.group()[0] in "([" else 3.0


def features(text: str, span: Span) -> list[float]:
    """Format of the span, and what stands around it."""
    kind, start, end = span
    own, before, after = text[start:end], text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    digits = _NOT_DIGIT.sub("", own)
    groups = [g for g in _NOT_DIGIT.split(own) if g]
    left, right = before[-1:], after[:1]
    ending = _ENDING.search(own)
    return [
        *(float(kind == k) for k in KINDS), len(own), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        max((int(g) for g in groups if len(g) < 6), default=0), float(luhn(digits)) if digits else 0.0, len(set(digits)),
        float(own.startswith("+")), own.count("("), own.count("."), own.count("-"), own.count(" "), own.count("@"),
        float(left.isalpha()), float(left.isdigit()), float(left.isspace() or not left), float(right.isalpha()), float(right.isdigit()),
        float(right.isspace() or not right), float(left in "\"'=_#/"), sum(c.isdigit() for c in before[-8:]), sum(c.isdigit() for c in after[:8]),
        float(bool(_CUES[kind].search(before))), float(bool(_CONTRARY.search(before))), own.rfind(".") - own.find("@") if "@" in own else 0,
        len(own) - own.rfind(".") if "." in own else 0, own.count(":"), max(map(len, own.split(":"))) if ":" in own else 0,
        _spelling(_AT.search(own)) if kind == "email" else 0.0, _spelling(_DOT.search(own)) if kind == "email" else 0.0,
        len(ending.group(1)) if ending else 0,
    ]


# --- Examples ---------------------------------------------------------------------------------------------------------

# Words before personal data, words before look-alikes, endings of domains.
_HINTS = {"email": ("email", "mail", "contact", "write to", "reach me:"), "ip": ("ip", "host", "server", "address", "from"),
          "card": ("card", "visa", "paid with", "credit card"), "phone": ("phone", "tel.", "call", "mobile", "fax")}
_AGAINST = {"email": ("look", "meet", "arrived", "priced"), "ip": ("version", "release", "v.", "section"),
            "card": ("order", "invoice", "isbn", "token"), "phone": ("order", "invoice", "isbn", "key")}
_ENDINGS = ("com", "org", "net", "de", "fr", "info")
_FILLER = "lorem amount about under site page house street market noon".split()


def _number(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 1))


def _grouped(digits: str, sizes: tuple[int, ...], sep: str) -> str:
    ends = list(accumulate(sizes))
    return sep.join(digits[a:b] for a, b in zip([0, *ends], ends))


def _true_value(kind: str, rng: random.Random) -> str:
    """Personal data in one of the forms the generators propose."""
    if kind == "email":
        user, site, end = rng.choice(_FILLER) + _number(rng, rng.randint(1, 3)), rng.choice(_FILLER) + str(rng.randint(0, 99)), rng.choice(_ENDINGS)
        at, dot = rng.choice(((" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("@", "."), (" at ", "."), ("(at)", "."), (" @ ", " . ")))
        return user + at + site + dot + end
    if kind == "ip":
        if rng.random() < 0.5:
            return ":".join(f"{rng.randrange(1 << 16):0{rng.choice((1, 4))}x}" for _ in range(8))
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        n = rng.choice((15, 16, 16, 16))
        body = rng.choice("3456") + _number(rng, n - 2)
        digits = body + next(d for d in "0123456789" if luhn(body + d))
        sep = rng.choice(("", " ", "-", "."))
        return _grouped(digits, (4, 6, 5) if n == 15 else (4, 4, 4, 4), sep)
    form = rng.randrange(4)
    if form == 0:
        return f"+{rng.randint(1, 99)} {_number(rng, 3)} {_number(rng, 3)} {_number(rng, 4)}"
    if form == 1:
        return f"+{rng.randint(1, 99)} ({_number(rng, 3)}) {_number(rng, 3)}-{_number(rng, 4)}"
    return f"({_number(rng, 3)}) {_number(rng, 3)}-{_number(rng, 4)}" if form == 2 else f"0{_number(rng, 3)}{rng.choice(' -')}{_number(rng, 3)}{rng.choice(' -')}{_number(rng, 4)}"


def _look_alike(kind: str, rng: random.Random) -> str:
    """What the generators of a kind propose as well, and is not personal data."""
    if kind == "email":
        word, place = rng.choice(_FILLER), rng.choice(_FILLER)
        return rng.choice((f"{word} at {place}{rng.randint(0, 99)}.{rng.choice((*_ENDINGS, 'The', 'and'))}", f"{word} at {rng.randint(1, 12)}.{rng.randint(10, 59)}",
                           f"{word} at {place}.{rng.randint(1, 9)}", f"{word} at {place} . {rng.choice(_FILLER).title()}"))
    if kind == "ip":
        return rng.choice((".".join(str(rng.randint(0, 12)) for _ in range(4)), ":".join(f"{rng.randrange(256):02x}" for _ in range(8)),
                           ".".join(str(rng.randint(0, 999)) for _ in range(3)) + f".{rng.randint(256, 9999)}",
                           f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}.{rng.randint(0, 9)}"))
    if kind == "card":
        n = rng.choice((12, 13, 16, 16, 16, 19))
        digits = _number(rng, n)
        if luhn(digits):
            digits = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        return rng.choice((digits, _grouped(digits, (4,) * (n // 4), rng.choice(" -.")) if n % 4 == 0 else digits, " ".join(str(rng.randint(1950, 2030)) for _ in range(4))))
    return rng.choice((f"{_number(rng, 3)}-{_number(rng, 3)}-{_number(rng, 4)}", f"({_number(rng, 3)}) {_number(rng, 3)}-{_number(rng, 4)}",
                       f"0{_number(rng, 3)} {_number(rng, 3)} {_number(rng, 4)}", f"{_number(rng, 4)} {_number(rng, 3)} {_number(rng, 4)}"))


def _surroundings(text: str, rng: random.Random) -> tuple[str, str]:
    """What stands before and behind a place between two words, away from the text's own candidates; nothing if no such
    place is found."""
    for _ in range(4):
        place = text.find(" ", rng.randrange(len(text) + 1))
        place = len(text) if place < 0 else place
        before, after = text[max(0, place - CONTEXT):place], text[place:place + CONTEXT]
        if not candidates(before + after):
            return before, after
    return "", ""


def planted(text: str, rng: random.Random, kind: str, true: bool) -> list[tuple[str, Span, int]]:
    """(window, candidate, label) of a value put into a text, between two of its words.

    Two of three positives have a hint before them and two of three look-alikes the contrary; a few have the other's, so
    no word decides alone.
    """
    value = _true_value(kind, rng) if true else _look_alike(kind, rng)
    before, after = _surroundings(text, rng)
    says, chance = (_HINTS if true else _AGAINST), rng.random()
    word = f" {rng.choice(says[kind])}" if chance < 0.65 else f" {rng.choice((_AGAINST if true else _HINTS)[kind])}" if chance > 0.98 else ""
    left = before + word + " "
    window, own = left + value + after, (kind, len(left), len(left) + len(value))
    return [(window, span, int(true and span == own)) for span in candidates(window)
            if span[0] == kind and span[1] < own[2] and own[1] < span[2]]


def examples(text: str, rng: random.Random, most: int | None = None) -> list[tuple[str, Span, int]]:
    """Labelled candidates of a text: its own, as far as the base patterns tell, and a planted value and look-alike.

    A candidate that equals an accepted match is a positive, one that cuts an accepted match differently a negative.
    `most` limits the text's own, chosen by chance.
    """
    accepted = [(k, a, b) for k, a, b, ok in base_matches(text) if ok]
    taken, known = Taken(accepted), set(accepted)
    own = [(text, span, int(span in known)) for span in candidates(text) if span in known or taken.touches(span)]
    if most is not None and len(own) > most:
        own = rng.sample(own, most)
    return own + planted(text, rng, rng.choice(KINDS), True) + planted(text, rng, rng.choice(KINDS), False)


# --- Model ------------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    trees: boosting.Trees
    scale: tuple[float, float]
    thresholds: dict[str, float]

    def chances(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.trees.margin(x) + self.scale[1], -500, 500)))


class Taken:
    """Stretches of a text, merged where they overlap, that tell in logarithmic time whether a span touches one."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, span: Span) -> bool:
        at = bisect_left(self.starts, span[2])       # the first that starts at the span's end or later
        return at > 0 and self.ends[at - 1] > span[1]

    def add(self, span: Span) -> None:
        """Take a span that touches none."""
        at = bisect_left(self.starts, span[1])
        self.starts.insert(at, span[1])
        self.ends.insert(at, span[2])


def _threshold(chances: np.ndarray, right: np.ndarray, wrong: np.ndarray, precision: float) -> float:
    """The least chance from which on the precision is reached, from counts by ascending chance; above 1, so that nothing
    passes, if there is none."""
    above = np.cumsum(right[::-1])[::-1], np.cumsum(wrong[::-1])[::-1]
    good = np.flatnonzero((above[0] > 0) & (above[0] >= precision * (above[0] + above[1])))
    return max(0.5, float(chances[good[0]])) if len(good) else 2.0


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def _fold(key: Column) -> Column:
    """Texts of fold 3 are held out."""
    return F.pmod(F.shiftright(key, 40), F.lit(4))


def _sample(texts: DataFrame, sample_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled examples of about `sample_docs` different texts, chosen by their hash."""
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [e for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                     for e in examples(text, random.Random(key), SAMPLE_PER_TEXT)]
            yield pa.RecordBatch.from_arrays([pa.array([features(t, span) for t, span, _ in found], pa.list_(pa.float64())),
                                              pa.array([y for _, _, y in found], pa.int32())], names=["x", "y"])

    known = texts.where(_fold(F.col("key")) < 3)
    part = sample_docs / max(1, known.agg(F.approx_count_distinct("key")).first()[0])
    # Whole texts of the sample only, each once.
    if part < 1:
        known = known.where(F.pmod("key", F.lit(1 << 20)) < F.lit(max(1, int(part * (1 << 20)))))
    once = known.groupBy("key").agg(F.min("text").alias("text"))
    rows = once.mapInArrow(label, "x array<double>, y int").toPandas()
    return np.array(rows["x"].tolist(), float).reshape(len(rows), len(rows["x"].iloc[0]) if len(rows) else 1), rows["y"].to_numpy(float)


def _counted(texts: DataFrame, trees: boosting.Trees) -> DataFrame:
    """(kind, y, bin, n): the examples of all held-out texts by margin."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            # The place in the task takes part, so that copies of a text do not repeat one example.
            found = [e for i, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                     for e in examples(text, random.Random(key ^ (n << 20) ^ i))]
            if found:
                margin = trees.margin(np.array([features(t, span) for t, span, _ in found]))
                bins = np.clip(np.floor(margin / BIN), -BINS, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([span[0] for _, span, _ in found]), pa.array([y for _, _, y in found], pa.int32()),
                                                  pa.array(bins)], names=["kind", "y", "bin"])

    held = texts.where(_fold(F.col("key")) == 3)
    return held.mapInArrow(score, "kind string, y int, bin int").groupBy("kind", "y", "bin").agg(F.count("*").alias("n"))


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, precision: float = PRECISION) -> Model:
    """Trees from about `sample_docs` different texts, calibration and thresholds from all texts of the held-out fold.

    A table without texts gives a model that adds nothing.
    """
    texts = docs.select(name(text_col).alias("text")).where("text <> ''").select(_key(F.col("text")).alias("key"), "text")
    x, y = _sample(texts, sample_docs)
    trees = boosting.fit(x, y)
    none = Model(trees, (1.0, 0.0), dict.fromkeys(KINDS, 2.0))
    if not len(y):
        return none
    counts = _counted(texts, trees).collect()
    if not counts:
        return none
    tally = np.zeros((len(KINDS), 2, 2 * BINS))
    for r in counts:
        tally[KINDS.index(r.kind), r.y, r.bin + BINS] += r.n
    middle = (np.arange(-BINS, BINS) + 0.5) * BIN
    wrong, right = tally.sum(axis=0)
    scale = boosting.calibrate(np.concatenate([middle, middle]), np.repeat([0.0, 1.0], 2 * BINS), counts=np.concatenate([wrong, right]))
    model = Model(trees, scale, {})
    edges = 1 / (1 + np.exp(-np.clip(scale[0] * np.arange(-BINS, BINS) * BIN + scale[1], -500, 500)))
    return Model(trees, model.scale, {k: _threshold(edges, tally[i, 1], tally[i, 0], precision) for i, k in enumerate(KINDS)})


def find(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text."""
    found, owner, proposed, rows, taken = [], [], [], [], []
    for i, text in enumerate(texts):
        base = [(k, a, b) for k, a, b, ok in base_matches(text) if ok]
        found.append((base, []))
        taken.append(Taken(base))
        for span in candidates(text):
            if not taken[i].touches(span):
                owner.append(i)
                proposed.append(span)
                rows.append(features(text, span))
    if rows:
        chances = model.chances(np.array(rows))
        for at in np.argsort(-chances, kind="stable").tolist():
            span, i = proposed[at], owner[at]
            if chances[at] >= model.thresholds[span[0]] and not taken[i].touches(span):
                found[i][1].append(span)
                taken[i].add(span)
    return found


def stated(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def find_pii(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row.

    Counts and digest are those of the fixed patterns; `spans` holds all spans. Positions are code points, the end
    exclusive. Null counts as empty and has none; rows that share an id are reported one by one. Without a model one is
    trained on the table. No row is shuffled.
    """
    model = train(docs, text_col) if model is None else model
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(1)):
                found = find([t or "" for t in part.to_pylist()], model)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                digests = pa.array([hashlib.sha256(stated(base).encode()).hexdigest() for base, _ in found])
                spans = pa.array([stated(base + added) for base, added in found])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), *counts, digests, spans,
                                                  pa.array([len(added) for _, added in found], pa.int64())], names=schema.names)

    out = docs.select(name(id_col).alias("id"), name(text_col).alias("text")).mapInArrow(search, schema)
    return out.withColumnRenamed("id", id_col)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced as one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_pii(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """`docs` with the text redacted; null stays null."""
    model = train(docs, text_col) if model is None else model
    kinds = docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = kinds.names.index(text_col)
        for batch in batches:
            for first, part in slices(batch.column(place)):
                texts = part.to_pylist()
                found = find([t or "" for t in texts], model)
                clear = [None if t is None else redact(t, base + added) for t, (base, added) in zip(texts, found)]
                columns = [pa.array(clear, part.type) if i == place else c.slice(first, len(part)) for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=kinds.names)

    return docs.mapInArrow(clean, kinds)
