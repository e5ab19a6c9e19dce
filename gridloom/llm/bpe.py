"""BPE encoding and decoding over a prefix-sharing trie of distinct words.

In byte-pair encoding the last token of a prefix is settled by the last token of a
shorter prefix: token ``t`` ends prefix ``p`` if and only if ``t`` is a suffix of ``p``
and merging the last token of the remaining prefix together with ``t`` leaves exactly
these two tokens.  So one state per trie node, its last token, is enough; the words of a
batch are walked as a trie in depth-first order and each shared prefix is settled once.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from gridloom.llm.common import MEMO_CHARS, map_texts

#: Distinct words of at most MEMO_CHARS whose encodings a worker keeps in each of two generations; twice as many token pairs.
CACHE_WORDS = 200_000


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in ids)


def _byte_chars() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class TrieBpe:
    """Encoder and decoder for a lower-casing BPE vocabulary with word ends (tokenizers JSON)."""

    def __init__(self, spec: str) -> None:
        j = json.loads(spec)
        model = j["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.split = next(p["pattern"]["Regex"] for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(self.split).findall
        self.by_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        chars = _byte_chars()
        self.byte_table = {b: chars[b] for b in range(256)}
        self.inner = {t: i for t, i in self.vocab.items() if not (self.end and t.endswith(self.end) and len(t) > len(self.end))}
        self.final = {t[: len(t) - len(self.end)]: i for t, i in self.vocab.items() if self.end and t.endswith(self.end) and len(t) > len(self.end)}
        if not self.end:
            self.final = self.inner
        self.longest = max(max(map(len, self.inner)), max(map(len, self.final)))
        self.made_of = {new: (a, b, rank) for (a, b), (rank, new) in self.merges.items()}
        self.edges: tuple[dict, dict] = ({}, {})
        self.alone: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.names = np.array([self.tokens.get(i, "") for i in range(max(self.tokens) + 1)], object)
        self.pieces_done: dict[str, bytes] = {}
        self.words_done: dict[str, bytes] = {}
        self.old: dict[str, dict] = {"pairs": {}, "pieces_done": {}, "words_done": {}}

    # -- pairs ---------------------------------------------------------------
    def symbols(self, token: int) -> list[int]:
        s = self.tokens[token]
        if self.end and s.endswith(self.end) and len(s) > len(self.end):
            s = s[: -len(self.end)]
            return [*(self.vocab[c] for c in s[:-1]), self.vocab[s[-1] + self.end]]
        return [self.vocab[c] for c in s]

    def merged(self, ids: list[int]) -> list[int]:
        """Plain byte-pair merging: the lowest rank first, the leftmost of equals."""
        ids = list(ids)
        while len(ids) > 1:
            found = [(m[0], k, m[1]) for k in range(len(ids) - 1) if (m := self.merges.get((ids[k], ids[k + 1])))]
            if not found:
                break
            _, k, new = min(found)
            ids[k : k + 2] = [new]
        return ids

    def is_alone(self, token: int) -> bool:
        """Whether the token's own text is encoded as this one token."""
        if (known := self.alone.get(token)) is None:
            known = self.alone[token] = self.merged(self.symbols(token)) == [token]
        return known

    def edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The tokens that stand at one edge while ``token`` is merged, with the rank at which each is merged away."""
        known = self.edges[right].get(token)
        if known is None:
            known = [(token, math.inf)]
            while made := self.made_of.get(known[-1][0]):
                known.append((made[right], made[2]))
            self.edges[right][token] = known
        return known

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the symbols of a and b together leaves just these two.

        Ranks rise in the course of merging, so a merge across the border happens if its
        rank comes before both of its parts are merged away to their own side; of equal
        ranks the leftmost goes first.
        """
        key = a << 20 | b
        if (known := self.pairs.get(key)) is None:
            known = self.pairs[key] = self.old["pairs"].get(key)
        if known is None:
            known = self.is_alone(b)
            if known:
                merges, rights = self.merges, self.edge(b, False)
                for x, x_goes in self.edge(a, True):
                    for y, y_goes in rights:
                        m = merges.get((x, y))
                        if m and m[0] < x_goes and m[0] <= y_goes:
                            known = False
            self.pairs[key] = known
        return known

    # -- the trie -------------------------------------------------------------
    def walk(self, words: list[str]) -> list[bytes]:
        """Encode distinct byte-character words to little-endian 32-bit ids.

        Sorted order is the depth-first order of their trie.  ``last[i]`` and ``size[i]``
        hold the state of the node at depth i on the current path; entering a word keeps
        the states of the prefix that it shares with the word before.
        """
        out = [b""] * len(words)
        inner, final, longest, pairs, may_follow = self.inner, self.final, self.longest, self.pairs, self.may_follow
        last, size, known, before = [0], [0], 0, ""
        for at in sorted(range(len(words)), key=words.__getitem__):
            w = words[at]
            n = len(w)
            shared = 0
            for a, b in zip(before[:known], w, strict=False):
                if a != b:
                    break
                shared += 1
            shared = min(shared, n - 1)
            del last[shared + 1 :], size[shared + 1 :]
            for i in range(shared + 1, n + 1):
                tokens = inner if i < n else final
                for j in range(max(0, i - longest), i):
                    t = tokens.get(w[j:i])
                    if t is None:
                        continue
                    if j:
                        ok = pairs.get(last[j] << 20 | t)
                        if ok is None:
                            ok = may_follow(last[j], t)
                    else:
                        ok = self.is_alone(t)
                    if ok:
                        last.append(t)
                        size.append(i - j)
                        break
            ids = []
            i = n
            while i:
                ids.append(last[i])
                i -= size[i]
            ids.reverse()
            out[at] = packed(ids)
            known, before = n - 1, w
        return out

    # -- texts ----------------------------------------------------------------
    def split_word(self, word: str) -> list[str | int]:
        """A blank-free word as byte-character pieces and ids of special tokens."""
        if self.by_special and self.by_special.search(word):
            parts: list[str | int] = []
            for p in self.by_special.split(word):
                if p in self.special:
                    parts.append(self.special[p])
                elif p:
                    parts += self.split_word(p)
            return parts
        if word.isascii():
            word = word.lower()
            if word.isalpha():
                return [word]
        else:
            word = unicodedata.normalize("NFC", word)
            word = "".join(c.lower() for c in word) if "Σ" in word else word.lower()
        return [p.encode().decode("latin-1").translate(self.byte_table) for p in self.pieces(word)]

    def turn(self) -> None:
        """Make full caches the old generation; what is still in use comes back from there."""
        for name, most in (("pairs", 2 * CACHE_WORDS), ("pieces_done", CACHE_WORDS), ("words_done", CACHE_WORDS)):
            if len(getattr(self, name)) > most:
                self.old[name] = getattr(self, name)
                setattr(self, name, {})

    def forget(self) -> None:
        """Empty the caches."""
        self.pairs, self.pieces_done, self.words_done = {}, {}, {}
        self.old = {"pairs": {}, "pieces_done": {}, "words_done": {}}

    def known(self, name: str, wanted: set[str]) -> set[str]:
        """Bring what the old generation has into the cache; the rest is returned."""
        new, old = getattr(self, name), self.old[name]
        missing = wanted.difference(new)
        found = missing.intersection(old)
        new.update((k, old[k]) for k in found)
        return missing - found

    def learn(self, words: set[str]) -> None:
        """Encode words that the cache lacks."""
        split = {w: self.split_word(w) for w in words}
        new = list(self.known("pieces_done", {p for parts in split.values() for p in parts if isinstance(p, str)}))
        self.pieces_done.update(zip(new, self.walk(new), strict=True))
        done = self.pieces_done
        for w, parts in split.items():
            self.words_done[w] = done[parts[0]] if len(parts) == 1 and isinstance(parts[0], str) else b"".join([done[p] if isinstance(p, str) else packed([p]) for p in parts])
        for p in [p for p in new if len(p) > MEMO_CHARS]:
            done.pop(p)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids as little-endian 32-bit integers, and the decoded text, of each text."""
        self.turn()
        split = [blank_split(t) for t in texts]
        distinct: set[str] = set()
        for words in split:
            distinct.update(words)
        if missing := self.known("words_done", distinct):
            self.learn(missing)
        done = self.words_done
        ids = [b"".join([done[w] for w in words]) for words in split]
        for w in [w for w in distinct if len(w) > MEMO_CHARS]:  # the bytes of a cache are bounded, not only its entries
            done.pop(w)
        return ids, [" ".join(self.names[np.frombuffer(i, "<i4")].tolist()) for i in ids]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)


#: Unicode's White_Space besides SPACES: these part words for the tokenizer's normaliser too.
_MORE_BLANKS = re.compile("[ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def blank_split(text: str) -> list[str]:
    """Words between Unicode white space; str.split() takes four control characters more."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [w for w in _MORE_BLANKS.split(text) if w]
    return text.split()


@lru_cache(maxsize=2)
def encoder(spec: str) -> TrieBpe:
    """One encoder per worker process and vocabulary."""
    return TrieBpe(spec)


FIELDS = {
    "n_tokens": "long",
    "ids": "array<int>",
    "decoded": "string",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


def bpe_encode(
    df: DataFrame,
    tokenizer_path: str,
    outputs: tuple[str, ...] = ("n_tokens", "ids"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode every whole text, and decode it again where an output asks for that.

    ``outputs`` names any of FIELDS: the count, the ids, the decoded text, and the digests
    of the ids (as little-endian unsigned 32-bit integers) and of the decoded text.
    The vocabulary file is read by the driver and broadcast; its size is fixed.
    The usual edge cases; an empty text has no ids and decodes to the empty text.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    want = set(outputs)

    def make():
        enc = encoder(spec.value)

        def apply(texts: list[str]) -> dict[str, list]:
            ids, decoded = enc.encode(texts)
            out: dict[str, list] = {"n_tokens": [len(b) // 4 for b in ids]}
            if "ids" in want:
                out["ids"] = [np.frombuffer(b, "<i4") for b in ids]
            if "decoded" in want:
                out["decoded"] = decoded
            if "ids_sha256" in want:
                out["ids_sha256"] = [hashlib.sha256(b).hexdigest() for b in ids]
            if "decoded_sha256" in want:
                out["decoded_sha256"] = [hashlib.sha256(d.encode()).hexdigest() for d in decoded]
            return out

        apply.cache = enc
        return apply

    return map_texts(df, make, ", ".join(f"{n} {FIELDS[n]}" for n in outputs), id_col, text_col)


def bpe_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id lists: native array look-ups in the fixed token table.  A null list decodes to the empty text."""
    from pyspark.sql import functions as F

    with open(tokenizer_path, encoding="utf-8") as f:
        tokens = TrieBpe(f.read()).tokens
    spark = df.sparkSession
    table = spark.createDataFrame([([tokens[i] for i in range(max(tokens) + 1)],)], "tokens array<string>")
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    one = df.select(F.col(id_col), ids.alias("ids"), F.lit(1).alias("one"))
    joined = one.join(F.broadcast(table.withColumn("one", F.lit(1))), "one")
    return joined.select(id_col, F.array_join(F.transform("ids", lambda i: F.get(F.col("tokens"), i)), " ").alias("decoded"))
