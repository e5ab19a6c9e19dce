"""Exact token counts of huge documents from overlapping chunks.

A document longer than one chunk is encoded in chunks that overlap.  Two neighbours are
spliced at a boundary inside their overlap that is *proven* stable - it lies before white
space, which no token of the vocabulary and no normalisation step crosses - and at which
both encodings agree on the words to either side.  Where no such boundary exists the
overlap is widened, and in the end the two chunks are encoded as one.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe import blank_split
from gridloom.llm.common import MEMO_CHARS, map_texts

#: Characters of a chunk, and of the first overlap that is tried.
CHUNK, OVERLAP = 16_384, 256
BLANKS = " \t\n\r"
_BLANK = re.compile(f"[{BLANKS}]")
#: Distinct words of at most MEMO_CHARS whose counts a worker keeps in each of two generations.
CACHE_WORDS = 200_000


class JsonEncoder:
    """Token counts and token offsets by the tokenizers library."""

    def __init__(self, blob: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one thread
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.apart = blanks_part_words(json.loads(blob))
        self.known: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def short_counts(self, texts: list[str]) -> list[int]:
        """Counts of texts of one chunk; where every blank is a stable boundary, distinct words are encoded once."""
        if not self.apart:
            return self.counts(texts)
        if len(self.known) > CACHE_WORDS:  # what is still in use comes back from the old generation
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        split = [blank_split(t) for t in texts]
        missing = {w for words in split for w in words}.difference(known)
        known.update((w, old[w]) for w in missing.intersection(old))
        new = list(missing.difference(old))
        known.update(zip(new, self.counts(new), strict=True))
        out = [sum([known[w] for w in words]) for words in split]
        for w in [w for w in new if len(w) > MEMO_CHARS]:
            del known[w]
        return out

    def forget(self) -> None:
        """Empty the caches."""
        self.known, self.old = {}, {}

    def chunk(self, text: str, at: int) -> LibraryTokens:
        return LibraryTokens(self.tokenizer.encode(text, add_special_tokens=False), at, len(text))


def blanks_part_words(spec: dict) -> bool:
    """Whether no token can hold white space: the first split drops what its pattern leaves out, and that is all of it.

    Normalisation to NFC never joins across white space, a replacement may only make runs of
    white space one blank, and special tokens must hold none.
    """
    steps = spec.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    dropped = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    pattern = first.get("pattern", {}).get("Regex", "")
    probe = re.compile("|".join(p for p in pattern.split("|") if "\\p" not in p) or "(?!)")
    classes = [p for p in pattern.split("|") if "\\p" in p]
    blank_free = all(p.startswith(("[^\\s", "[\\p{L}", "[\\p{N}")) for p in classes) and not any(probe.search(b) for b in BLANKS)
    normal = spec.get("normalizer") or {}
    steps = normal.get("normalizers", [normal])
    known = all(n.get("type") in ("NFC", "Lowercase", None) or (n["type"] == "Replace" and n.get("content") == " " and n.get("pattern") == {"Regex": "\\s+"}) for n in steps)
    lone = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    return dropped and bool(pattern) and blank_free and known and lone


class PieceEncoder:
    """The same by sentencepiece; its pieces cross white space only at their start."""

    def __init__(self, blob: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        size = self.model.get_piece_size()
        self.crossing = any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(size))

    def short_counts(self, texts: list[str]) -> list[int]:
        return self.counts(texts)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def forget(self) -> None:
        pass

    def chunk(self, text: str, at: int) -> ArrayTokens:
        p = self.model.encode(text, return_type="proto")
        lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80  # offsets count bytes
        chars = np.concatenate([[0], np.cumsum(lead)])
        ends = np.array([(x.begin, x.end) for x in p.pieces], np.int64).reshape(-1, 2)
        ends = np.where(ends < len(lead), chars[np.minimum(ends, len(lead))], len(text)) + at
        return ArrayTokens([x.id for x in p.pieces], ends[:, 0], ends[:, 1])


class ArrayTokens:
    """Tokens of a chunk with their places in the whole text."""

    def __init__(self, ids: list[int], starts: np.ndarray, ends: np.ndarray) -> None:
        self.ids, self.starts, self.ends = ids, starts, ends

    def __len__(self) -> int:
        return len(self.ids)

    def first(self, p: int) -> int:
        """Number of the first token from p on."""
        return int(np.searchsorted(self.starts, p))

    def window(self, a: int, b: int) -> list[tuple[int, int, int]]:
        """(id, start, end) of the tokens that begin in [a, b)."""
        return [(self.ids[k], int(self.starts[k]), int(self.ends[k])) for k in range(self.first(a), self.first(b))]

    def cut(self, p: int) -> bool:
        """Whether a token lies across p."""
        return bool(((self.starts < p) & (self.ends > p)).any())


class LibraryTokens:
    """The same over an encoding of the tokenizers library, asked only for the tokens near a border."""

    def __init__(self, encoding, at: int, size: int) -> None:
        self.encoding, self.at, self.size, self.ids = encoding, at, size, None

    def __len__(self) -> int:
        return len(self.encoding)

    def first(self, p: int) -> int:
        for c in range(max(0, p - self.at), self.size):
            k = self.encoding.char_to_token(c)
            if k is not None:
                while k and self.place(k - 1)[0] >= p:  # tokens of one character share its place
                    k -= 1
                return k if self.place(k)[0] >= p else k + 1
        return len(self)

    def place(self, k: int) -> tuple[int, int]:
        a, b = self.encoding.token_to_chars(k)
        return a + self.at, b + self.at

    def window(self, a: int, b: int) -> list[tuple[int, int, int]]:
        if self.ids is None:
            self.ids = self.encoding.ids
        out = []
        for k in range(self.first(a), len(self)):
            s, e = self.place(k)
            if s >= b:
                break
            out.append((self.ids[k], s, e))
        return out

    def cut(self, p: int) -> bool:
        k = self.encoding.char_to_token(p - 1 - self.at) if p > self.at else None
        return k is not None and self.place(k)[1] > p


def splice_at(text: str, left, right, low: int, high: int) -> int:
    """A stable common boundary of two chunks' tokens in [low, high), or -1.

    Candidates are the ends of words before white space.  Any at which both encodings agree
    on the word and white space to either side is exact, so the last one is taken.
    """

    def word_end(at: int) -> int:
        """The last end of a word before white space below ``at``, or ``low``."""
        at -= 1
        while at > low and (text[at] not in BLANKS or text[at - 1] in BLANKS):
            at -= 1
        return at

    q = word_end(high)
    p = word_end(q)
    while (start := word_end(p)) > low:
        if left.window(start, q) == right.window(start, q) and not any(x.cut(at) for x in (left, right) for at in (start, p, q)):
            return p
        q, p = p, start
    return -1


def count_long(encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text by overlapping chunks; equal to encoding it whole.

    Two chunks are held at a time.  Where widening the overlap finds no boundary, the left
    chunk is encoded anew up to a chunk beyond the next white space, but at least to twice
    its length, so that all chunks together stay in proportion to the text.  Only a run
    without white space is ever encoded as one: nothing proves a boundary inside it.
    """
    n = len(text)
    if n <= chunk or getattr(encoder, "crossing", False):
        return encoder.counts([text])[0]
    total, start, a, e = 0, 0, 0, chunk
    left = encoder.chunk(text[:e], 0)
    while e < n:
        width, p = overlap, -1
        some = _BLANK.search(text, max(a, start), e)
        while p < 0 and some and e - width > max(a, start):
            b, f = e - width, min(n, e - width + max(chunk, 2 * width))
            right = encoder.chunk(text[b:f], b)
            p = splice_at(text, left, right, max(b, start), e)
            width *= 2
        if p < 0:  # nothing left to widen
            blank = _BLANK.search(text, e)
            e = min(n, max(2 * e - a, (blank.end() if blank else n) + chunk))
            left = encoder.chunk(text[a:e], a)
        else:
            total += left.first(p) - left.first(start)
            start, a, e, left = p, b, f, right
    return total + len(left) - left.first(start)


@lru_cache(maxsize=2)
def encoder_of(blob: bytes, kind: str):
    return PieceEncoder(blob) if kind == "model" else JsonEncoder(blob)


def count_tokens(
    df: DataFrame,
    tokenizer_path: str,
    limit: int = 2048,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    ``tokenizer_path``: a .json file of the tokenizers library or a .model file of
    sentencepiece.  The driver reads and broadcasts it; its size is fixed.
    The usual edge cases; an empty text has 0 bytes and 0 tokens.
    """
    with open(tokenizer_path, "rb") as f:
        blob = df.sparkSession.sparkContext.broadcast(f.read())
    kind = tokenizer_path.rsplit(".", 1)[-1]

    def make():
        encoder = encoder_of(blob.value, kind)

        def apply(texts: list[str]) -> dict[str, list]:
            short = [k for k, t in enumerate(texts) if len(t) <= chunk]
            n = [0] * len(texts)
            for k, c in zip(short, encoder.short_counts([texts[k] for k in short]), strict=True):
                n[k] = c
            for k, t in enumerate(texts):
                if len(t) > chunk:
                    n[k] = count_long(encoder, t, chunk, overlap)
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n}

        apply.cache = encoder
        return apply

    counted = map_texts(df, make, "n_bytes long, n_tokens long", id_col, text_col)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
