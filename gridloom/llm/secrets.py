"""Secret scanning: fixed patterns, and a guess-cost estimate of credential-context values.

The cost of a value is that of its cheapest segmentation into dictionary words, dates,
repeats, keyboard walks and brute-force spans.  Words, dates and walks are bounded in length
and brute force costs the same for each character, so one pass over a value of any length
finds it in linear time.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

from gridloom.llm.common import map_texts

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Contexts in which a value is taken for a credential, beyond the fixed pattern.
CONTEXT = re.compile(
    r"""(?:(?ai:\b(passwords?|passwd|pwd|passphrase|passcode|secret|secret[_\x20-]key|token|auth[_-]token|api[_\x20-]?key|access[_\x20-]key|private[_\x20-]key|client[_-]secret|credentials?))["'\])]?\x20*(?:(?ai:is|are|was)\x20*:?|[:=]>?|->)\x20*|(?ai:\bbearer\x20+))["'(<]?([^\s"'<>]{6,})"""
)
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer")

#: Common passwords and words in them, commonest first; the other words come from a vocabulary.
COMMON = """password qwerty admin letmein welcome monkey dragon master login princess abc iloveyou
sunshine football shadow superman michael baseball trustno hello freedom whatever ninja mustang access
secret summer winter spring autumn batman love test user root guest default changeme example sample
dummy foobar foo bar qazwsx pass token key server system computer internet google""".split()

#: Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4831!0$57", "aaeeiiosst")
DATE = re.compile(r"(?:(?:19|20)[0-9]{2}[-/._]?[01]?[0-9][-/._]?[0-3]?[0-9]|[0-3]?[0-9][-/._]?[01]?[0-9][-/._]?(?:(?:19|20)[0-9]{2}|[0-9]{2})|(?:19|20)[0-9]{2})")
REPEAT = re.compile(r"(.{1,8}?)\1+", re.DOTALL)


def _neighbours() -> set[tuple[str, str]]:
    at = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
    return {(a, b) for a, (r, k) in at.items() for b, (s, m) in at.items() if a != b and abs(r - s) <= 1 and abs(k - m) <= 1}


NEAR = _neighbours()
#: Characters of the longest dictionary word and of the longest walk that count as one segment.
LONGEST, LONGEST_WALK, LONGEST_PERIOD = 24, 32, 8


def ranks(vocabulary_path: str | None = None) -> dict[str, int]:
    """Words with their ranks: the common passwords, then the whole words of a tokenizer's vocabulary.

    A BPE vocabulary (tokenizers JSON with word ends) lists words in the order in which
    merging met them, the more frequent first.  The table is as large as the vocabulary.
    """
    words = dict.fromkeys(COMMON)
    if vocabulary_path:
        with open(vocabulary_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model["end_of_word_suffix"]
        for t in sorted(model["vocab"], key=model["vocab"].__getitem__):
            w = t[: -len(end)]
            if t.endswith(end) and 3 <= len(w) <= LONGEST and w.isascii() and w.isalpha():
                words.setdefault(w)
    return {w: k + 1 for k, w in enumerate(words)}


RANK = ranks()


def per_character(value: str) -> float:
    """log10 of the alphabet that the whole value draws on: what one unexplained character costs."""
    size = 0
    for test, n in ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10)):
        size += n * any(map(test, value))
    size += 33 * any(not c.isalnum() for c in value) + 100 * any(ord(c) > 127 for c in value)
    return math.log10(max(size, 10))


def _segments(value: str, words: dict[str, int], unit: float) -> Iterable[tuple[int, int, float, str]]:
    """Candidate segments (start, end, log10 guesses, kind) by start, brute force aside."""
    low = value.lower()
    if len(low) != len(value):  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    n = len(value)
    # how far the text goes on repeating itself with each period, from each place
    alike = []
    for period in range(1, min(LONGEST_PERIOD, n) + 1):
        run = [0] * (n + 1)
        for k in range(n - period - 1, -1, -1):
            run[k] = run[k + 1] + 1 if value[k] == value[k + period] else 0
        alike.append(run)
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            for s, more in ((low[i:j], 0.0), (plain[i:j], 1.0)):
                if (rank := words.get(s)) is not None:
                    case = 0.0 if value[i:j] == s or more else 0.5
                    yield i, j, math.log10(rank) + case + more, "word"
                    break
        turns, step = 0, 0
        for j in range(i + 2, min(n, i + LONGEST_WALK) + 1):
            if (low[j - 2], low[j - 1]) not in NEAR:
                break
            was, step = step, ord(low[j - 1]) - ord(low[j - 2])
            turns += j > i + 2 and step != was
            if j >= i + 3:
                yield i, j, math.log10(47 * (j - i)) + 0.7 * turns, "walk"
        if m := DATE.match(value, i):
            yield i, m.end(), math.log10(365 * 60 if len(m[0]) > 4 else 120), "date"
        for period, run in enumerate(alike, 1):
            if run[i] >= period:
                times = run[i] // period + 1
                if period * times >= 3:
                    yield i, i + period * times, period * unit + math.log10(times), "repeat"
                break


def guess_cost(value: str, words: dict[str, int] | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """The least log10 guesses over all segmentations, and the segments of the cheapest one.

    best[j] is the least cost of the first j characters; a further segment costs log10(2)
    more, for the guess of where it starts.  A brute-force span that reaches j either goes
    on from j - 1 or starts there, so values of any length take linear time.
    """
    words = RANK if words is None else words
    n, unit, start = len(value), per_character(value), math.log10(2)
    by_start: dict[int, list[tuple[int, float, str]]] = {}
    for i, j, cost, kind in _segments(value, words, unit):
        by_start.setdefault(i, []).append((j, cost, kind))
    best, back = [0.0] + [math.inf] * n, [(0, "")] * (n + 1)
    brute, since = math.inf, 0  # the cheapest way that ends here inside a brute-force span, and where that began
    for i in range(n + 1):
        if i and brute < best[i] - 1e-12:
            best[i], back[i] = brute, (since, "brute")
        more = start if i else 0.0
        for j, cost, kind in by_start.get(i, ()):
            if (c := best[i] + cost + more) < best[j] - 1e-12:
                best[j], back[j] = c, (i, kind)
        if best[i] + more < brute - 1e-12:
            brute, since = best[i] + more, i
        brute += unit
    parts, j = [], n
    while j:
        i, kind = back[j]
        parts.append((i, j, kind))
        j = i
    return best[n], parts[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns; failing matches are dropped without retry."""
    spans = []
    low = text.lower() if not text.islower() else text
    if any(k in low for k in KEYWORDS) or not text.isascii():
        spans += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return spans


def context_spans(text: str, taken: list[tuple[int, int, int]], least_cost: float, words: dict[str, int] | None) -> list[tuple[int, int, int, float]]:
    """Whole credential-context values of at least ``least_cost`` log10 guesses that no span of ``taken`` covers."""
    low = text.lower()
    if not any(k in low for k in CONTEXT_WORDS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        value = m[2].rstrip(".,;:!?)]}*#%&$|")
        a, b = m.start(2), m.start(2) + len(value)
        if len(value) < 6 or any(s <= a and b <= e for _, s, e in taken):
            continue
        if (cost := guess_cost(value, words)[0]) >= least_cost:
            out.append((0, m.start(), b, cost))
    return out


def joined(spans: Iterable[tuple[int, int, int]], names: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{names[k]}:{a}:{b}" for k, a, b in spans)


def scan_secrets(
    df: DataFrame,
    least_cost: float = 9.0,
    words: dict[str, int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Secrets of every whole text: the fixed patterns' spans and what the guess cost adds.

    n_assign, n_access, n_hex and base_sha256 (of ``kind:start:end`` by start, then kind)
    describe the fixed patterns; ``spans`` joins all spans likewise; n_method counts the
    added ones and ``strongest`` is the greatest log10 guess cost among the values of all
    credential contexts (null if there is none).  An added span has kind ``assign`` and
    covers the context keyword and its value to the value's end, however long it is; it may
    overlap a fixed pattern's span that covers only a part of the value.  ``words``: the
    dictionary with ranks, by default a few common passwords (see ``ranks``); it is broadcast.
    The usual edge cases; an empty text has no spans.
    """
    sent = df.sparkSession.sparkContext.broadcast(RANK if words is None else words)

    def make():
        words = sent.value

        def apply(texts: list[str]) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_method", "strongest")}
            for t in texts:
                base = sorted(base_spans(t), key=lambda s: (s[1], s[0]))
                more = context_spans(t, base, least_cost, words)
                costs = [c for *_, c in more] + [guess_cost(m[2], words)[0] for k, a, b in base if k == 0 and (m := ASSIGN.match(t, a))]
                for k, n in enumerate(("n_assign", "n_access", "n_hex")):
                    out[n].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(sorted([*base, *(m[:3] for m in more)], key=lambda s: (s[1], s[0], s[2]))))
                out["n_method"].append(len(more))
                out["strongest"].append(max(costs) if costs else None)
            return out

        return apply

    return map_texts(df, make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_method long, strongest double", id_col, text_col)
