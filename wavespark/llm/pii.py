"""Personal data: generators propose overlapping candidates, boosted trees score them, calibrated thresholds select."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The four kinds that fixed patterns find, and one that only the method finds: passwords, tokens and keys.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Code points of context that features look at on either side.
CONTEXT = 32
#: Examples that the trees are fitted and calibrated on; trees, depth, rate, and the least share of right calls among
#: what a threshold lets through.
EXAMPLES, TREES, DEPTH, RATE, PRECISION = 7500, 40, 3, 0.3, 0.99

# What always counts, by the contract. Lookbehinds and possessive runs change no match; they keep long runs linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# What may be, with high recall. Each starts at a mark that is rare in prose.
NAME, HOST, DOT = r"(?<![\w.%+-])[\w.%+-]{1,64}", r"[A-Za-z0-9-]{1,63}", r"(?:\s?(?:\(dot\)|\[dot\])\s?|\sdot\s)"
WIDE_EMAIL = re.compile(
    rf"{NAME}(?:\s?(?:@|\(at\)|\[at\])\s?{HOST}(?:(?:\.|\s\.\s|{DOT}){HOST}){{1,4}}|\sat\s{HOST}(?:{DOT}{HOST}){{1,4}})", re.I
)
#: In lower case: a text without any of them has no match of WIDE_EMAIL.
HINTS = ("@", "(at)", "[at]", "dot")
WIDE_NUMBERS = {
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\))\s?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ._/-]?[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[ ./-]?\(?[0-9]{2,4}\)?){2,4}(?![0-9])"),
}
#: A run without a space of 12 or more characters that are used in keys, however long, if it has digits and letters both. A run
#: is tried at its start only and never given back, so a text is read once.
SECRET = re.compile(r"(?<![\w/+.-])(?=[A-Za-z_/+.-]*[0-9])(?=[0-9_/+.-]*[A-Za-z])[A-Za-z0-9_/+.-]{12,}+={0,2}+(?![\w/+=.-])")
#: Where numbers are: no match of a pattern for numbers, fixed or wide, reaches out of such a stretch, or from one to
#: the next. One fast search for them spares the rest of the text the slower patterns.
STRETCH = re.compile(r"[+(0-9][0-9 ().+_/\[\]-]*")

#: Words near a candidate that speak for its kind, or against any.
CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel", "schreib", "address", "reach"),
    "ip": ("ip", "host", "server", "addr", "login", "client"),
    "card": ("card", "visa", "credit", "tarjeta", "carte", "karte", "payment", "kredit", "amex"),
    "phone": ("call", "tel", "phone", "mobile", "fax", "cell", "llam", "appel", "ruf", "whatsapp"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access", "auth", "bearer", "key", "credential", "contraseña", "passwort", "clé"),
}
AGAINST = ("version", "isbn", "order", "ref", "no.", "nr", "#", "$", "€", "=", "id", "price", "total", "date", "page", "v.")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four fixed patterns, by kind, then start; end exclusive."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append(("email", start, end))
        at = text.find("@", end if found else at + 1)
    stretches = [m.span() for m in STRETCH.finditer(text)]
    for m in (m for at in stretches for m in IP.finditer(text, *at)):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in (m for at in stretches for m in CARD.finditer(text, *at)):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in (m for at in stretches for m in PHONE.finditer(text, *at)):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data; they overlap freely."""
    out, low = [], text.lower()
    if any(x in low for x in HINTS):
        out += [("email", m.start(), m.end()) for m in WIDE_EMAIL.finditer(text)]
    out += [("secret", m.start(), m.end()) for m in SECRET.finditer(text)]
    for stretch in STRETCH.finditer(text):
        if stretch.end() - stretch.start() >= 7:
            out += [(kind, m.start(), m.end()) for kind, pattern in WIDE_NUMBERS.items() for m in pattern.finditer(text, *stretch.span())]
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the candidate and its surroundings, as numbers."""
    span = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    seps = [c for c in span if not c.isalnum()]
    last = re.split(r"[^A-Za-z0-9]+", span)[-1]
    near = before + " " + after
    return [
        KINDS.index(kind), len(span), len(digits), len(digits) / len(span), len(seps), len(set(seps)),
        "+" in span, "(" in span, len(digits) > 11 and luhn(digits), len(groups),
        min(map(len, groups), default=0), max(map(len, groups), default=0), max((int(g) if len(g) < 7 else 1e6 for g in groups), default=0),
        int(digits[0]) if digits else -1, len(last) if last.isalpha() else 0, bool(re.search(r"[(\[](?:at|dot|\.)[)\]]", span, re.I)),
        bool(re.search(r"\s(?:at|dot)\s", span, re.I)), any(c in near for c in CUES[kind]), any(c in before for c in AGAINST),
        before[-1:].isalnum(), after[:1].isalnum(), bool(re.search(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}", span)),
        "@" in span, any(c in before[-2:] for c in "$€=#"), *_randomness(span), before.rstrip("\"' :=")[-16:].endswith(CUES[kind]), before[-1:] in ("'", '"'),
    ]


def _randomness(span: str) -> tuple[float, float, float, float]:
    """Bits a character, changes between digits, small and capital letters and others a character, share of capitals, and
    longest run of letters: what keys have and words, numbers, addresses of pages and versions don't."""
    counts = np.array(list(Counter(span).values()), float) / len(span)
    sort = ["d" if "0" <= c <= "9" else "u" if c.isupper() else "l" if c.isalpha() else "o" for c in span]
    changes = sum(a != b for a, b in pairwise(sort)) / len(span)
    return float(-(counts * np.log2(counts)).sum()), changes, sort.count("u") / len(span), max(map(len, re.findall(r"[A-Za-z]+", span)), default=0)


@dataclass(frozen=True)
class Trees:
    """Boosted regression trees on the log-odds. A tree is a list of (feature, cut) in heap order and its leaves' values."""

    splits: np.ndarray  # (trees, 2 ** depth - 1, 2)
    leaves: np.ndarray  # (trees, 2 ** depth)
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for split, leaf in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < len(split):
                node = 2 * node + 1 + (x[rows, split[node, 0].astype(np.int64)] > split[node, 1])
            score += leaf[node - len(split)]
        return 1 / (1 + np.exp(-score))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Second-order gradient boosting of logistic loss, with up to 32 cuts of each feature."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[:-1])) for c in x.T]
    below = [(f, c, x[:, f] > c) for f, cs in enumerate(cuts) for c in cs]
    above = np.stack([b for _, _, b in below]).astype(np.float64)
    bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score, inner = np.full(len(y), bias), 2**depth - 1
    splits, leaves = np.zeros((trees, inner, 2)), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, curve = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for n in range(inner):
            here = node == n
            g, h = slope * here, curve * here
            gr, hr = above @ g, above @ h
            gl, hl = g.sum() - gr, h.sum() - hr
            gain = np.where((hr > 1e-3) & (hl > 1e-3), gr**2 / (hr + 1) + gl**2 / (hl + 1), -1.0)
            best = int(gain.argmax())
            feature, cut, right = below[best]
            splits[t, n] = feature, cut
            node[here] = 2 * n + 1 + right[here]
        for k in range(inner + 1):
            here = node == inner + k
            leaves[t, k] = rate * slope[here].sum() / (curve[here].sum() + 1)
        score += leaves[t, node - inner]
    return Trees(splits, leaves, bias)


@dataclass(frozen=True)
class Model:
    trees: Trees
    thresholds: dict[str, float]


def _valid_card(r: Random, n: int) -> str:
    body = str(r.randint(3, 6)) + "".join(str(r.randint(0, 9)) for _ in range(n - 2))
    return next(body + str(k) for k in range(10) if luhn(body + str(k)))


def example(r: Random) -> tuple[str, str, int, int, bool]:
    """A made-up text with one candidate in it: text, kind, start, end, is it personal data?"""
    word = lambda: "".join(r.choice(("ba", "no", "ti", "er", "la", "mo", "su", "en")) for _ in range(r.randint(1, 4)))
    number = lambda n: "".join(str(r.randint(0, 9)) for _ in range(n))
    kind, good = r.choice(KINDS), r.random() < 0.5
    cue = r.choice(CUES[kind]) + r.choice((" ", ": ", " is "))
    lead = cue if r.random() < (0.6 if good else 0.1) else word() + " "
    if kind == "email":
        tld = r.choice(("com", "org", "net", "de", "fr", "es", "io", "edu"))
        at, dot = r.choice(((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."), ("(at)", "."), (" @ ", " . ")))
        span = word() + r.choice(("", ".", "_")) + word() + at + word() + dot + tld
        if not good:
            span = r.choice((f"{word()} at {word()} dot {word()}{word()}", f"{word()} @ {word()}.{number(2)}", f"{word()} @ {word()} . {word().capitalize()}", f"{word()}@{word()} . {word()}{word()}"))
    elif kind == "ip":
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        span = r.choice(("[.]", "(.)", " [.] ")).join(parts)
        if not good:
            parts[r.randint(0, 3)] = str(r.randint(256, 999))
            span = r.choice((".", " . ", "[.]")).join(parts)
            if r.random() < 0.4:
                span = ". ".join(str(r.randint(1, 30)) for _ in range(4))
    elif kind == "card":
        n = r.choice((13, 14, 15, 16, 16, 16, 19))
        d = _valid_card(r, n)
        if not good:
            if r.random() < 0.3:  # a number that happens to pass, with nothing to say that it is a card
                d, lead = _valid_card(r, r.randint(13, 15)), word() + " "
            else:
                d = number(r.randint(12, 19))
                while luhn(d):
                    d = number(len(d))
        sep = r.choice((".", "_", "/")) if good and n >= 16 else r.choice(("", "", "-", " "))
        if good and n < 16:
            lead = cue
        span = sep.join(d[k : k + 4] for k in range(0, len(d), 4))
    elif kind == "secret":
        pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        span = r.choice((pick("0123456789abcdef", r.choice((16, 20, 24, 32, 40, 48, 64))), pick(letters, r.randint(16, 64)), "AK" + pick(letters[:26] + "0123456789", 18), "sk-" + pick(letters, r.randint(20, 48)), pick(letters + "+/", r.choice((22, 43, 86))) + "=="))
        quote = r.choice(('"', "'", ""))
        lead = r.choice(CUES[kind]) + r.choice((" = ", "=", ": ", ":", " is ", " ")) + quote if good else r.choice((word() + " ", lead))
        if not good:
            date = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"
            span = r.choice((f"{word()}-{word()}-{word()}-{number(3)}", f"{word()}_{word()}_{word()}{number(2)}", f"{date}T{number(2)}", f"www.{word()}{number(2)}.{word()}/{word()}", f"{word()}{word()}{word()}{number(1)}", f"v{number(1)}.{number(2)}.{number(3)}-{word()}{word()}", f"{word()}/{word()}/{word()}{number(4)}.html", f"{word().upper()}{number(10)}", span if r.random() < 0.3 else f"{word()}{number(4)}{word()}{word()}"))
    else:
        a, b, c = number(3), number(3), number(4)
        span = r.choice((f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{number(2)} {a} {b} {c}", f"0{number(2)} {b} {c}"))
        if span[0] != "(":
            lead = cue if good else lead
        if not good:
            date = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"
            span = r.choice((date, number(r.randint(6, 16)), f"{number(2)}.{number(2)}.{number(4)}", f"{number(3)}-{number(2)}", r.choice((" ", "-", ".")).join(number(4) for _ in range(r.randint(3, 4))), f"{number(3)}.{number(3)}.{number(3)}", f"{number(2)}/{number(2)}/{number(2)}", f"{a}-{b}-{c}"))
    if not good and r.random() < 0.3:
        lead = r.choice(AGAINST) + r.choice(("", " "))
    text = f"{word()} {lead}"
    return text + span + r.choice((" ", ". ", ", ")) + word(), kind, len(text), len(text) + len(span), good


def fit(seed: int = 11, examples: int = EXAMPLES) -> Model:
    """Fits the trees on half of a fixed number of made-up examples and sets the thresholds on the other half: for each
    kind the lowest at which PRECISION of what passes is right, or one that nothing passes. Needs no data."""
    r = Random(seed)
    rows = [example(r) for _ in range(examples)]
    x = np.array([features(*row[:4]) for row in rows], np.float64)
    y = np.array([row[4] for row in rows], np.float64)
    half = len(rows) // 2
    trees = boost(x[:half], y[:half])
    p, truth, kind = trees.probability(x[half:]), y[half:], x[half:, 0]
    thresholds = {}
    for k, name in enumerate(KINDS):
        order = np.argsort(-p[kind == k], kind="stable")
        right = np.cumsum(truth[kind == k][order]) / np.arange(1, len(order) + 1)
        fine = np.flatnonzero(right >= PRECISION)
        thresholds[name] = max(0.5, float(p[kind == k][order][fine[-1]])) if len(fine) else 2.0
    return Model(trees, thresholds)


def find(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and these with the ones that the model adds: of overlapping candidates over the threshold the
    likeliest, if it doesn't touch a base span."""
    base = base_spans(text)
    taken = bytearray(len(text))  # what spans cover; candidates are short, so asking it costs little
    for _, start, end in base:
        taken[start:end] = b"\1" * (end - start)
    wide = [c for c in candidates(text) if 1 not in taken[c[1] : c[2]]]
    if not wide:
        return base, base
    p = model.trees.probability(np.array([features(text, *c) for c in wide], np.float64))
    chosen: list[tuple[str, int, int]] = []
    for k in np.lexsort(([c[1] for c in wide], -p)):
        kind, start, end = wide[k]
        if p[k] >= model.thresholds[kind] and 1 not in taken[start:end]:
            taken[start:end] = b"\1" * (end - start)
            chosen.append(wide[k])
    return base, sorted(base + chosen, key=lambda c: (KINDS.index(c[0]), c[1]))


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _found(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"base": [], "spans": []}
        counts = {k: [] for k in BASE_KINDS}
        for value in batch.column(1):
            base, spans = find(value.as_py() or "", model)
            out["base"].append(_written(base))
            out["spans"].append(_written(spans))
            for k in BASE_KINDS:
                counts[k].append(sum(s[0] == k for s in base))
        columns = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), *(pa.array(out[k], pa.string()) for k in out)]
        yield pa.RecordBatch.from_arrays(columns, ["id", *(f"n_{k}" for k in BASE_KINDS), *out])


def find_pii(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds personal data in every whole text: one row for each row of docs, with id_col, n_email, n_ip, n_card, n_phone
    (base spans), base and spans (base spans, and all; each as kind:start:end, joined by commas, by kind, then start).

    One pass that shuffles nothing; the model has a fixed size.

    Defined results: a null text is the empty text and has no spans. Kinds may overlap among base spans; added spans
    overlap neither them nor each other. Among equally likely candidates the first wins. Rows are returned as often as
    they come; an empty table gives none.
    """
    model = model or fit()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    schema = f"id {slim.dtypes[0][1]}, {counts}, base string, spans string"
    return slim.mapInArrow(lambda batches: _found(batches, model), schema).withColumnRenamed("id", id_col)


def redact(text: str, model: Model) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping ones, the first's. An empty text stays
    empty; any length is one pass."""
    out, at = [], 0
    for kind, start, end in sorted(find(text, model)[1], key=lambda c: (c[1], -c[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
        else:
            at = max(at, end)
    return "".join([*out, text[at:]])


def op3_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")

