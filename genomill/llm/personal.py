"""Personal data in whole texts: fixed patterns, and a semi-Markov conditional random field beside them.

The field scores whole candidate segments by features of the span (how many digits in what groups
and separators, checksums, spelled-out signs, the word before it), and a dynamic program over
segment ends of bounded length chooses boundaries and types together. It is trained here, by
gradient ascent on the conditional likelihood of generated sentences with known spans. What the
fixed patterns find always stays; the field labels what lies between.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared
from .bytewise import bounded

KINDS = ("email", "ip", "card", "phone")
#: Tokens of the longest segment: nineteen digits with a separator after each.
LONGEST = 40

# The patterns of the four kinds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed patterns, ordered by start and then kind; leftmost, not overlapping within a kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = "".join(_DIGITS.findall(m.group()))
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- candidate segments and their features

_AT = r"\s?[\[(]\s?at\s?[\])]\s?|\sat\s"
_DOT = r"\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s"
_NUMERIC = re.compile(r"[+(]?[0-9](?:[\x20().+\-/: ‐-–]{0,3}[0-9])+")
_SPELLED = re.compile(rf"[A-Za-z0-9_%+.-]+(?:(?:{_AT})|(?:{_DOT})|@)[A-Za-z0-9-]+(?:(?:{_AT}|{_DOT}|@|\.)[A-Za-z0-9-]+)*")
_GROUP = re.compile(r"[0-9]+")
_NAME = re.compile(r"[A-Za-z0-9_%+-]+")
_WORD_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,3}$")
_CUES = {
    "phone": {"tel", "telephone", "phone", "call", "fax", "mobile", "cell", "whatsapp", "sms"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "iban", "pan"},
    "ip": {"ip", "host", "server", "address", "ping", "addr"},
    "email": {"mail", "email", "contact", "write", "reach"},
}


def numeric_features(text: str, start: int, end: int) -> dict[str, float]:
    span = text[start:end]
    groups = _GROUP.findall(span)
    digits = "".join(groups)
    n = len(digits)
    between = set(_GROUP.sub("", span))
    f = {"bias": 1.0, f"digits{min(n, 20)}": 1.0, f"groups{min(len(groups), 6)}": 1.0}
    f["shape" + "-".join(str(min(len(g), 9)) for g in groups[:6])] = 1.0
    for sign, name in (("+", "plus"), ("(", "paren"), ("-", "hyphen"), (".", "dot"), (" ", "space"), ("/", "slash"), (":", "colon")):
        if sign in between:
            f[name] = 1.0
    if len({c for c in between if c in "-./: "}) > 1:
        f["mixed"] = 1.0
    if 12 <= n <= 19:
        f["luhn" if luhn(digits) else "notluhn"] = 1.0
    if span.count(".") == 3 and len(groups) == 4:
        f["octets" if _octets(groups) else "notoctets"] = 1.0
    if (start and (text[start - 1].isalnum() or text[start - 1] in "_=#$€.-/")) or (end < len(text) and (text[end].isalnum() or text[end] in "_%")):
        f["attached"] = 1.0
    if m := _WORD_BEFORE.search(text, max(0, start - 16), start):
        for kind, cues in _CUES.items():
            if m.group(1).lower() in cues:
                f["cue-" + kind] = 1.0
    return f


def spelled_features(text: str, start: int, end: int) -> dict[str, float]:
    span = text[start:end].lower()
    ats = len(re.findall(_AT, span)) + span.count("@")
    dots = len(re.findall(_DOT, span)) + span.count(".")
    tail = re.split(rf"{_DOT}|\.", span)[-1]
    f = {"bias": 1.0, f"ats{min(ats, 2)}": 1.0, f"dots{min(dots, 3)}": 1.0}
    if re.search(r"[\[(]\s?at", span):
        f["bracketed"] = 1.0
    if re.search(_DOT, span):
        f["spelled-dot"] = 1.0
    if "@" in span:
        f["sign"] = 1.0
    f["tail-word" if re.fullmatch(r"[a-z]{2,6}", tail) else "tail-odd"] = 1.0
    if tail in {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info"}:
        f["tail-known"] = 1.0
    if m := _WORD_BEFORE.search(text, max(0, start - 16), start):
        if m.group(1).lower() in _CUES["email"]:
            f["cue-email"] = 1.0
    return f


def candidates(text: str, first: int = 0, last: int | None = None) -> list[tuple[int, int, int, dict[str, float]]]:
    """Candidate segments between two places: start, end, tokens, features; by start."""
    out = []
    last = len(text) if last is None else last
    for run in _NUMERIC.finditer(text, first, last):
        groups = [m.span() for m in _GROUP.finditer(text, *run.span())]
        for i, (start, _) in enumerate(groups):
            begin = start
            while begin > run.start() and text[begin - 1] in "+(":
                begin -= 1
            n = 0
            for j in range(i, min(len(groups), i + LONGEST // 2)):
                n += groups[j][1] - groups[j][0]
                if n > 19:
                    break
                if n >= 4:
                    for b in {begin, start}:
                        out.append((b, groups[j][1], 2 * (j - i) + 1, numeric_features(text, b, groups[j][1])))
    low = text[first:last]
    if "@" in low or (("dot" in low or "." in low) and re.search(_AT, low)):
        for run in _SPELLED.finditer(text, first, last):
            words = [m.span() for m in _NAME.finditer(text, *run.span())]
            words = [w for w in words if text[w[0] : w[1]].lower() not in ("at", "dot")]
            for i in range(len(words)):
                for j in range(i + 1, min(len(words), i + LONGEST // 2)):
                    out.append((words[i][0], words[j][1], 2 * (j - i) + 1, spelled_features(text, words[i][0], words[j][1])))
    return sorted(out, key=lambda c: c[:3])


@dataclass
class Field:
    """Weights by type and feature. Everything outside segments scores 0."""

    weights: dict[tuple[str, str], float] = field(default_factory=dict)

    def score(self, kind: str, features: dict[str, float]) -> float:
        w = self.weights
        return sum(w.get((kind, f), 0.0) * v for f, v in features.items())

    def scored(self, cands: list) -> list[tuple[int, int, str, float, dict]]:
        return [(s, e, kind, self.score(kind, f), f) for s, e, n, f in cands if n <= LONGEST for kind in KINDS]

    def decode(self, cands: list) -> list[tuple[str, int, int]]:
        """The best set of segments that don't overlap, by dynamic programming over their ends."""
        segments = sorted((s for s in self.scored(cands) if s[3] > 0), key=lambda s: (s[1], s[0]))
        if not segments:
            return []
        ends = sorted({0, *(s[1] for s in segments)})
        best, back = {ends[0]: 0.0}, {}
        k = 0
        for before, e in zip(ends[:-1], ends[1:], strict=True):
            best[e], back[e] = best[before], (before, None)
            while k < len(segments) and segments[k][1] == e:
                s = segments[k]
                at = ends[bisect.bisect_right(ends, s[0]) - 1]
                if best[at] + s[3] > best[e]:
                    best[e], back[e] = best[at] + s[3], (at, s)
                k += 1
        out, e = [], ends[-1]
        while e in back:
            e, s = back[e]
            if s:
                out.append((s[2], s[0], s[1]))
        return out[::-1]

    def gradient(self, cands: list, gold: set[tuple[str, int, int]]) -> tuple[float, dict[tuple[str, str], float]]:
        """Log-likelihood of the gold segments and its gradient, by forward and backward sums over segment ends."""
        segments = sorted(self.scored(cands), key=lambda s: (s[1], s[0]))
        cuts = sorted({0, *(s[0] for s in segments), *(s[1] for s in segments)})
        place = {c: i for i, c in enumerate(cuts)}
        ending: dict[int, list] = {}
        for s in segments:
            ending.setdefault(place[s[1]], []).append(s)
        forward = [0.0] * len(cuts)
        for i in range(1, len(cuts)):
            forward[i] = _log_sum([forward[i - 1], *(forward[place[s[0]]] + s[3] for s in ending.get(i, ()))])
        beginning: dict[int, list] = {}
        for s in segments:
            beginning.setdefault(place[s[0]], []).append(s)
        backward = [0.0] * len(cuts)
        for i in range(len(cuts) - 2, -1, -1):
            backward[i] = _log_sum([backward[i + 1], *(backward[place[s[1]]] + s[3] for s in beginning.get(i, ()))])
        total, out, likelihood = forward[-1], {}, -forward[-1]
        for s, e, kind, score, features in segments:
            is_gold = (kind, s, e) in gold
            likelihood += score * is_gold
            more = is_gold - math.exp(min(0.0, forward[place[s]] + score + backward[place[e]] - total))
            if abs(more) > 1e-6:
                for f, v in features.items():
                    out[kind, f] = out.get((kind, f), 0.0) + more * v
        return likelihood, out


def _log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


# --- training on generated sentences


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random, valid: bool) -> str:
    body = r.choice("3456") + _digits(r, 14)
    good = next(c for c in "0123456789" if luhn(body + c))
    digits = body + (good if valid else str((int(good) + r.randint(1, 9)) % 10))
    sep = r.choice(["", " ", "-", ".", "  "])
    return sep.join(digits[i : i + 4] for i in range(0, 16, 4))


def generated(seed: int = 7, n: int = 600) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """Sentences with their spans: formats that the fixed patterns know and their looser kin, among numbers that are neither."""
    r = random.Random(seed)
    syllables = ["an", "be", "cor", "du", "el", "fi", "gra", "ho", "in", "ju", "ka", "lo", "mi", "no", "op", "pre", "qui", "ro", "st", "tu"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    out = []
    for _ in range(n):
        parts, gold = [], set()

        def say(text, kind=None, parts=parts, gold=gold):
            at = sum(map(len, parts))
            parts.append(text)
            if kind:
                gold.add((kind, at, at + len(text)))

        say(" ".join(word() for _ in range(r.randint(1, 4))) + " ")
        for _ in range(r.randint(1, 3)):
            what = r.randrange(14)
            if what == 0:
                say(f"{word()}.{_digits(r, 2)}@{word()}.example.{r.choice(['com', 'org', 'net'])}", "email")
            elif what in (1, 2):
                at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" [at] ", ".")])
                if r.random() < 0.3:
                    say(r.choice(["mail ", "contact: ", "email "]))
                say(f"{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr'])}", "email")
            elif what == 3:
                say(".".join(str(r.randint(0, 255)) for _ in range(4)), "ip")
            elif what in (4, 5):
                say(r.choice(["card ", "", "visa: "]))
                say(_card(r, True), "card")
            elif what in (6, 7):
                a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
                form = r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"+{a[:2]} {b} {c} {a}"])
                if r.random() < 0.5:
                    say(r.choice(["tel ", "call ", "phone: "]))
                say(form, "phone")
            elif what == 8:
                say(r.choice(["no ", "id ", "", "card "]) + _card(r, False))
            elif what == 9:
                say(f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}" if r.random() < 0.5 else f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2030)}")
            elif what == 10:
                say(r.choice(["", "no ", "id ", "#"]) + _digits(r, r.randint(4, 19)))
            elif what == 11:
                say(f"{word()} at {word()}. {word()}")
            elif what == 12:
                say('token = "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"')
            else:
                say(f"{_digits(r, 3)}.{_digits(r, 3)}.{_digits(r, 3)}" if r.random() < 0.4 else r.choice([f"v{r.randint(1, 9)}.{r.randint(0, 30)}.{r.randint(0, 30)}.{r.randint(256, 9999)}", f"{_digits(r, 3)},{_digits(r, 3)}.{_digits(r, 2)}", f"{_digits(r, 4)} {_digits(r, 4)}"]))
            say(" " + " ".join(word() for _ in range(r.randint(1, 3))) + r.choice([" ", ", ", ". "]))
        out.append(("".join(parts), gold))
    return out


def train(seed: int = 7, sentences: int = 600, rounds: int = 12, rate: float = 0.5, decay: float = 0.002) -> Field:
    """A field fitted by stochastic gradient ascent to a stated number of generated sentences."""
    model = Field()
    data = [(candidates(t), gold) for t, gold in generated(seed, sentences)]
    r = random.Random(seed)
    sums: dict[tuple[str, str], float] = {}
    for _ in range(rounds):
        r.shuffle(data)
        for cands, gold in data:
            if not cands:
                continue
            _, gradient = model.gradient(cands, gold)
            for key, g in gradient.items():
                g -= decay * model.weights.get(key, 0.0)
                sums[key] = sums.get(key, 1e-8) + g * g
                model.weights[key] = model.weights.get(key, 0.0) + rate * g / math.sqrt(sums[key])
    return model


# --- whole texts

_TRIGGER = re.compile(r"[0-9][^A-Za-z0-9]{0,3}[0-9]|[0-9]{4}|@|[\s\[(](?:at|dot)[\s\])]")
REACH = 96


def added_spans(model: Field, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What the field finds between the base spans."""
    if not _TRIGGER.search(text):
        return []
    windows: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        b, e = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        while b and not text[b - 1].isspace():  # never inside a word
            b -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        if windows and b <= windows[-1][1]:
            windows[-1][1] = max(windows[-1][1], e)
        else:
            windows.append([b, e])
    taken = sorted((s, e) for _, s, e in base)
    out = []
    for b, e in windows:
        cands = candidates(text, b, e)
        inside = [(s, t) for s, t in taken if s < e and t > b]
        if inside:
            cands = [c for c in cands if all(c[1] <= s or c[0] >= t for s, t in inside)]
        out += model.decode(cands)
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def find(docs: DataFrame, model: Field) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and base_sha256 are of the spans of the fixed patterns, spans of all of them;
    kind:start:end in code points, comma-joined, by start and then kind. A null or empty text has
    none. Repeated rows give repeated rows, an empty table an empty one; a null doc_id stays null.
    """
    shared.ship(docs.sparkSession)
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(first, 1024) for whole in batches for first in range(0, len(whole), 1024)):
            ids = batch.column("doc_id")
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                more = added_spans(model, text, base)
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), digest, _joined([*base, *more]), len(more)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(bounded(run), kind)
