"""Personal data: fixed patterns, and a semi-Markov conditional random field over spans.

The field scores whole candidate segments by features of the entire span (digit count,
check sum, group shape, separators, what stands to either side, a context word before it).
Dynamic programming over segments of bounded length picks boundaries and kinds jointly.
Its weights are trained by exact gradients of the conditional likelihood on examples that
a fixed-seed generator writes, so every process gets the same model.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from gridloom.llm.common import map_column, map_texts

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that fails at the start of a digit run fails at its other digits too.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each @ back over the local part, on over the domain."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1)
        if m and a < at:
            out.append((a, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start; failing matches are dropped without retry."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = _NOT_DIGIT.sub("", m[0])
                if 13 <= len(d) <= 19 and luhn(d):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# -- segments and their features ------------------------------------------------
#: Bounds of a segment: atoms, characters.
MOST_ATOMS, MOST_CHARS, LEAST_CHARS = 24, 64, 6
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)
_AT = re.compile(r"[(\[{<]\s?at\s?[)\]}>]", re.IGNORECASE)
_TRIGGER = re.compile(r"[0-9@]|[(\[{<]\s?at\s?[)\]}>]", re.IGNORECASE)
_DOT = re.compile(r"[(\[{<]\s?dot\s?[)\]}>]|\sdot\s|\.", re.IGNORECASE)
_SEPARATORS = re.compile(r"[^0-9]+")
#: Separators that features tell apart; other dashes and blanks within a line count as "-" and " ".
_MARKS = frozenset(" -.()/:@+\t\n_")
_ALIKE = str.maketrans(dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63\uff0d", "-") | dict.fromkeys("\u00a0\u1680\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))), " "))
#: Words before an entity of each kind.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "mastercard", "credit", "amex"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp"),
}


def _side(c: str) -> str:
    return "none" if not c or c.isspace() else "word" if c.isalnum() else c if c in ".-$#:/=@_,()\"'" else "mark"


def features(text: str, a: int, b: int) -> list[str]:
    """Names of the whole-span features of text[a:b]."""
    s = text[a:b]
    groups = [g for g in _SEPARATORS.split(s) if g]
    digits = "".join(groups)
    seps = set(re.sub(r"[0-9A-Za-z]", "", s.translate(_ALIKE)))
    letters = sum(c.isalpha() for c in s)
    n = len(digits)
    out = [
        "bias",
        f"digits:{n if n < 20 else 20}",
        f"groups:{min(len(groups), 6)}",
        "shape:" + "-".join(str(min(len(g), 9)) for g in groups[:5]),
        f"first:{s[0] if s[0] in '+(' else _side(s[0])}",
        f"last:{_side(s[-1])}",
        f"before:{_side(text[a - 1 : a])}",
        f"after:{_side(text[b : b + 1])}",
        f"letters:{0 if not letters else 1 if letters < 4 else 2}",
        f"length:{len(s) // 6}",
        "seps:" + "".join(sorted(seps & _MARKS)) + ("?" if seps - _MARKS else ""),
    ]
    if 13 <= n <= 19 and not letters:
        out.append(f"luhn:{luhn(digits)}")
    if s.startswith("00") or s.startswith("0"):
        out.append("zero")
    if ats := s.count("@") + len(_AT.findall(s)):
        out.append(f"at:{min(ats, 2)}")
        left, _, right = re.sub(_AT, "@", s).partition("@")
        dot = _DOT.search(right)
        out.append(f"dotted:{bool(dot)}")
        tail = re.split(_DOT, right)[-1].strip()
        out.append(f"tail:{tail.isascii() and tail.isalpha() and 2 <= len(tail) <= 6}")
        out.append(f"local:{bool(re.fullmatch(r'[A-Za-z0-9._%+-]+', left.strip()))}")
        out.append(f"blanks:{min(s.count(' '), 5)}")
    if len(groups) == 4 and not letters:
        out.append(f"octets:{all(map(octet, groups))}")
    ahead = text[max(0, a - 24) : a].lower()
    out += [f"context:{k}" for k, words in CONTEXT.items() if any(w in ahead for w in words)]
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Parts of a text that can hold an entity: every trigger with the length of the longest segment to either side."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MOST_CHARS), min(len(text), m.end() + MOST_CHARS)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def candidates(text: str, a: int, b: int, taken: list[tuple[int, int, int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """Atom borders of text[a:b], and candidate segments as pairs of border numbers.

    A candidate holds an at sign (or its spelling in brackets), or else only digits and
    marks or blanks of any kind: seven digits, or four with three dots.  No entity of the
    four kinds has less.
    """
    borders = [a, *(m.end() for m in _ATOM.finditer(text, a, b))]
    n = len(borders) - 1
    blank, digits, other, ats, dots = [], [0], [0], [0], [0]
    for x, y in zip(borders, borders[1:], strict=False):
        c = text[x]
        blank.append(c.isspace())
        digits.append(digits[-1] + (y - x if "0" <= c <= "9" else 0))
        other.append(other[-1] + (c.isalnum() and not "0" <= c <= "9"))
        ats.append(ats[-1] + (c == "@" or (c in "([{<" and bool(_AT.match(text, x)))))
        dots.append(dots[-1] + (c == "."))
    out: list[tuple[int, int]] = []
    if not ats[-1] and digits[-1] < 4:
        return borders, out
    blocked = sorted((s, e) for _, s, e in taken if s < b and a < e)
    free = 0
    for i in range(n):
        start = borders[i]
        most = min(n, i + MOST_ATOMS)
        if blank[i] or (ats[most] == ats[i] and digits[most] - digits[i] < 4) or (start and text[start - 1].isalnum() and text[start].isalnum()):
            continue
        while free < len(blocked) and blocked[free][1] <= start:
            free += 1
        stop = max(start, blocked[free][0]) if free < len(blocked) else b
        for j in range(i + 1, most + 1):
            end = borders[j]
            if end > stop or end - start > MOST_CHARS:
                break
            if ats[j] == ats[i]:
                d = digits[j] - digits[i]
                if d < 4 or other[j] > other[i] or (d < 7 and dots[j] - dots[i] < 3):
                    continue
            if end - start < LEAST_CHARS or blank[j - 1] or (end < len(text) and text[end - 1].isalnum() and text[end].isalnum()):
                continue
            out.append((i, j))
    return borders, out


# -- the field --------------------------------------------------------------------
class SemiMarkovField:
    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((len(KINDS), 0))

    def rows(self, text: str, borders: list[int], segments: list[tuple[int, int]], grow: bool = False) -> list[np.ndarray]:
        out = []
        for i, j in segments:
            names = features(text, borders[i], borders[j])
            if grow:
                for f in names:
                    self.index.setdefault(f, len(self.index))
            out.append(np.array([self.index[f] for f in names if f in self.index], np.int64))
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[:, r].sum(axis=1) for r in rows]).reshape(-1, len(KINDS))

    def fit(self, examples: Iterable[tuple[str, list[tuple[int, int, int]]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4) -> SemiMarkovField:
        """AdaGrad on the conditional log likelihood; expectations by forward-backward over segments."""
        ready = []
        for text, gold in examples:
            borders, segments = candidates(text, 0, len(text), [])
            rows = self.rows(text, borders, segments, grow=True)
            at = {(borders[i], borders[j]): k for k, (i, j) in enumerate(segments)}
            if lost := [g for g in gold if g[1:] not in at]:
                raise ValueError(f"no candidate segment for {lost} of {text!r}")
            ready.append((len(borders) - 1, segments, rows, [(at[a, b], kind) for kind, a, b in gold]))
        self.weights = np.zeros((len(KINDS), len(self.index)))
        square = np.full_like(self.weights, 1e-6)
        for _ in range(epochs):
            for n, segments, rows, gold in ready:
                if not segments:
                    continue
                score = self.scores(rows)
                total = np.logaddexp.reduce(score, axis=1)
                ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
                ahead[0] = behind[n] = 0.0
                by_end: dict[int, list[int]] = {}
                by_start: dict[int, list[int]] = {}
                for k, (i, j) in enumerate(segments):
                    by_end.setdefault(j, []).append(k)
                    by_start.setdefault(i, []).append(k)
                for j in range(1, n + 1):
                    ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[segments[k][0]] + total[k] for k in by_end.get(j, ()))])
                for i in range(n - 1, -1, -1):
                    behind[i] = np.logaddexp.reduce([behind[i + 1], *(total[k] + behind[segments[k][1]] for k in by_start.get(i, ()))])
                i, j = np.array(segments).T
                expected = np.exp(ahead[i][:, None] + score + behind[j][:, None] - ahead[n])
                wanted = np.zeros_like(expected)
                for k, kind in gold:
                    wanted[k, kind] = 1.0
                push = wanted - expected
                step = np.zeros_like(self.weights)
                for k in np.flatnonzero(np.abs(push).max(axis=1) > 1e-4):
                    step[:, rows[k]] += push[k][:, None]
                step -= decay * self.weights
                square += step * step
                self.weights += rate * step / np.sqrt(square)
        return self

    def spans(self, text: str, taken: list[tuple[int, int, int]], margin: float = 2.0) -> list[tuple[int, int, int]]:
        """Best joint segmentation of a whole text outside ``taken``; a segment must beat no segment by ``margin``."""
        out = []
        for a, b in regions(text):
            borders, segments = candidates(text, a, b, taken)
            if not segments:
                continue
            score = self.scores(self.rows(text, borders, segments)) - margin
            kind, top = score.argmax(axis=1), score.max(axis=1)
            by_end: dict[int, list[int]] = {}
            for k in np.flatnonzero(top > 0):
                by_end.setdefault(segments[k][1], []).append(int(k))
            if not by_end:
                continue
            best, back = [0.0], [-1]
            for j in range(1, len(borders)):
                value, via = best[j - 1], -1
                for k in by_end.get(j, ()):
                    if best[segments[k][0]] + top[k] > value:
                        value, via = best[segments[k][0]] + top[k], k
                best.append(value)
                back.append(via)
            j = len(borders) - 1
            while j:
                if (k := back[j]) < 0:
                    j -= 1
                else:
                    out.append((int(kind[k]), borders[segments[k][0]], borders[j]))
                    j = segments[k][0]
        return sorted(out)


def examples(n: int = 400, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Training sentences with entities of the four kinds and with numbers that are none."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghilmnoprstuvz") for _ in range(r.randint(2, 9)))

    def card(sep: str) -> str:
        body = r.choice("3456") + d(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return sep.join(body[k : k + 4] for k in range(0, 16, 4))

    def entity() -> tuple[int, str]:
        kind = r.randrange(4)
        if kind == 0:
            at = r.choice(["@", "@", " (at) ", " [at] ", "(at)", "[at]", " {at} "])
            dot = "." if at == "@" else r.choice([".", " (dot) ", " [dot] ", " dot ", "(dot)"])
            return kind, r.choice([w(), f"{w()}.{w()}", w() + d(2), f"{w()}_{w()}"]) + at + r.choice([w(), f"{w()}-{w()}"]) + dot + r.choice(["com", "org", "net", "de", "io", "edu"])
        if kind == 1:
            return kind, r.choice([".", ".", "[.]"]).join(str(r.randint(0, 255)) for _ in range(4))
        if kind == 2:
            return kind, card(r.choice(["", " ", "-", ".", "."]))
        return kind, r.choice([
            f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{r.randint(1, 99)}{d(10)}",
            f"00{r.randint(11, 99)} {d(3)} {d(7)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"0{d(3)}/{d(7)}", f"0{d(4)} {d(6)}",
        ])

    def number() -> str:
        bad = r.choice("3456") + d(14)
        bad += next(c for c in "0123456789" if not luhn(bad + c))
        return r.choice([
            d(r.randint(1, 8)), f"{r.randint(1950, 2030)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{r.randint(1950, 2030)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)}.{d(1)}.", f"version {d(1)}.{d(1)}.{d(2)}", f"${d(1)},{d(3)}.{d(2)}",
            bad, bad, f"{bad[:4]} {bad[4:8]} {bad[8:12]} {bad[12:]}", d(r.randint(20, 30)), f"{r.randint(256, 999)}.{d(2)}.{d(3)}.{d(2)}", "".join(r.choice("0123456789abcdef") for _ in range(40)), f"INV-{d(4)}-{d(5)}", f"{d(2)} | {d(3)} | {d(2)}", " ".join(d(2) for _ in range(6)),
            f"{r.randint(1950, 2030)}-{d(2)}-{d(2)} {d(2)}:{d(2)}", f"AKIA{d(4)}{w().upper()}{d(8)}", f"{d(3)}.{d(3)}.{d(3)}", f"@{w()}", f"{w()}@{w()}", f"ISBN {d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(3)}-{d(4)}", f"{d(5)} {d(5)}", f"{d(3)}%%% {d(4)}***", f"#{d(9)}", f"{d(10)}", f"{d(9)}", f"{d(11)}", f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}",
        ])

    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(w() for _ in range(r.randint(1, 3))) + " "
            if r.random() < 0.5:
                kind, s = entity()
                if r.random() < 0.2:
                    text += r.choice(CONTEXT[KINDS[kind]]) + r.choice([": ", " ", " is "])
                gold.append((kind, len(text), len(text) + len(s)))
            else:
                s = number()
            text += s + r.choice(["", "", "", ".", ",", "!!", "***", "###", "%%%"]) + " "
        out.append((text + w(), gold))
    return out


def parted_examples(n: int = 300, seed: int = 8) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Training sentences with cards, phones and other numbers whose groups are parted by no-break spaces, dashes, tabs, line breaks or underscores."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghilmnoprstuvz") for _ in range(r.randint(2, 9)))

    def card(right: bool) -> list[str]:
        body = r.choice("3456") + d(14)
        body += next(c for c in "0123456789" if luhn(body + c) == right)
        return [body[k : k + 4] for k in range(0, 16, 4)]

    out = []
    for _ in range(n):
        kind = r.choice((2, 3, 3, None))
        if kind == 2:
            groups = card(True)
        elif kind == 3:
            groups = r.choice([[d(3), d(3), d(4)], [f"({d(3)})", d(3), d(4)], ["1", d(3), d(3), d(4)], [f"+{r.randint(1, 99)}", d(3), d(3), d(4)], [f"0{d(4)}", d(6)], [f"00{r.randint(11, 99)}", d(3), d(7)]])
        else:
            groups = r.choice([card(False), [str(r.randint(1950, 2030)), str(r.randint(1950, 2030))], [d(r.randint(1, 5)) for _ in range(r.randint(4, 7))], [d(3)] * 3, [d(5), d(5)], [str(r.randint(1950, 2030)), d(2), d(2)]])
        text = " ".join(w() for _ in range(r.randint(1, 3))) + " "
        if kind and r.random() < 0.4:
            text += r.choice(CONTEXT[KINDS[kind]]) + r.choice([": ", " ", " is "])
        s = r.choice("\u00a0\u2013\u2011\t\n_").join(groups)
        out.append((text + s + r.choice(["", "", ".", ","]) + " " + w(), [(kind, len(text), len(text) + len(s))] if kind else []))
    return out


@lru_cache(maxsize=1)
def trained() -> SemiMarkovField:
    return SemiMarkovField().fit([*parted_examples(), *examples()])


def all_spans(text: str, base: list[tuple[int, int, int]], field: SemiMarkovField) -> list[tuple[int, int, int]]:
    """Base spans and those of the field that overlap none of them, by kind, then start."""
    if not _TRIGGER.search(text):
        return base
    return sorted({*base, *field.spans(text, base)})


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every whole text: counts and digest of the fixed patterns, and all spans.

    Kinds are email, ip, card and phone; spans are ``kind:start:end`` in code points with an
    exclusive end, by kind, then start.  The field adds spans that overlap no base span.
    The model is trained once by the driver and broadcast; its size is fixed.
    The usual edge cases; an empty text has no spans.
    """
    model = df.sparkSession.sparkContext.broadcast(trained())

    def make():
        field = model.value

        def apply(texts: list[str]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_method")}
            for t in texts:
                base = base_spans(t)
                every = all_spans(t, base, field)
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(every))
                out["n_method"].append(len(every) - len(base))
            return out

        return apply

    return map_texts(df, make, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_method long", id_col, text_col)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union goes."""
    out, done = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``df``, with personal data in the text replaced; the usual edge cases, a null text becomes empty."""
    model = df.sparkSession.sparkContext.broadcast(trained())

    def make():
        field = model.value
        return lambda texts: [redact_text(t, all_spans(t, base_spans(t), field)) for t in texts]

    return map_column(df, make, text_col)
