"""Each document operator against a brute-force version or the library whose results it gives."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from gridloom.llm import bpe, decontaminate, licenses, mixing_lm, near_dups, pii, quality, quality_rules, secrets, token_counts
from gridloom.llm.common import ascii_lower, words_of
from gridloom.llm.queries import word_bpe

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = ["", "  ", "It's we'll DON'T <|endoftext|>x<|startoftext|> a<|endoftext|>", "ΑΣ ΣΑΣ. İstanbul ﬁ", "a\x1cb\x85c d e", "日本語 テスト １２３ ½ ²", "😀👍🏽 <|endoftext|", "ß ẞ ſ K Å", "th" * 2000, "é́ a" * 50]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe())


def test_words_are_what_the_pattern_finds():
    r = random.Random(1)
    for _ in range(2000):
        t = "".join(r.choice("ab \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 é") for _ in range(r.randint(0, 12)))
        assert words_of(t) == WORD.findall(t)


# -- personal data ---------------------------------------------------------------
def pii_brute(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_pii_base_equals_the_patterns(spark, docs, texts):
    for r in pii.find_pii(docs).collect():
        want = pii_brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in range(4))
        assert set(filter(None, r.spans.split(","))) >= set(filter(None, pii.joined(want).split(",")))


def test_pii_base_on_random_marks():
    r = random.Random(1)
    for _ in range(5000):
        t = "".join(r.choice("ab1234.@@-+ ()é5") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == pii_brute(t)


def test_field_finds_unseen_examples():
    field = pii.trained()
    hit = wrong = missed = 0
    for text, gold in pii.examples(120, 99):
        got = set(field.spans(text, []))
        hit += len(got & set(gold))
        wrong += len(got - set(gold))
        missed += len(set(gold) - got)
    assert hit > 20 * (wrong + missed)


def test_field_finds_entities_with_other_separators():
    field = pii.trained()
    for sep in "\u00a0\u202f\u2013\u2011\t\n_":
        for kind, groups, before in ((3, ("212", "555", "0199"), "tel "), (2, ("4111", "1111", "1111", "1111"), "card: ")):
            s = sep.join(groups)
            assert (kind, len(before), len(before) + len(s)) in field.spans(f"{before}{s} and so on", []), (sep, kind)
    assert not field.spans("from 1950\u20131990 on", [])


@pytest.mark.parametrize("n", [38, 50, 54, 55])
def test_long_entities_are_found_whole(n):
    text = "write to " + "j" * n + "(at)ab.de and wait"
    assert pii.trained().spans(text, []) == [(0, 9, 9 + n + 9)]


def test_a_gold_entity_that_is_no_candidate_is_refused():
    with pytest.raises(ValueError):
        pii.SemiMarkovField().fit([("a bc", [(0, 2, 4)])])


def test_decoding_is_the_best_of_all_segmentations():
    field = pii.trained()
    r = random.Random(5)
    for _ in range(40):
        text = " ".join(r.choice(["tel", "12", "555-0199", "(212)", "a@b.com", "4.0.", "10.1.2.3"]) for _ in range(3))
        borders, segments = pii.candidates(text, 0, len(text), [])
        score = field.scores(field.rows(text, borders, segments)) - 2.0
        best = {0: (0.0, ())}
        for j in range(1, len(borders)):
            options = [best[j - 1]]
            options += [(best[i][0] + score[k].max(), (*best[i][1], (int(score[k].argmax()), borders[i], borders[j]))) for k, (i, e) in enumerate(segments) if e == j]
            best[j] = max(options, key=lambda x: x[0])
        assert field.spans(text, []) == sorted(best[len(borders) - 1][1])


def test_redaction_leaves_no_base_span(spark, docs):
    out = pii.redact_pii(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(not pii.base_spans(r.text) for r in out.collect())


# -- quality rules -----------------------------------------------------------------
def rules_brute(t):
    w = WORD.findall(t)
    c, cover = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover)


def test_quality_rules_counts(spark, docs, texts):
    more = spark.createDataFrame([(-1 - k, t) for k, t in enumerate([*ODD, "a b c " * 40, "a\nb\na\n\n \n", " ".join(str(k % 97) for k in range(3000)), "x y"])], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    every = texts | {r.doc_id: r.text for r in more.collect()}
    got = quality_rules.apply_quality_rules(both, spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")).collect()
    assert len(got) == len(every)
    for r in got:
        n, *rest = rules_brute(every[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[3] > 50 * n) and not (r.base_failed and r.kept)


def test_quality_ratio_separates(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_rules.apply_quality_rules(docs, labels.where("quality = 1")).join(labels, "doc_id").where("not base_failed").collect()
    right = [r.kept == bool(r.quality) for r in got]
    assert np.mean(right) > 0.95


def test_every_trusted_document_counts(spark):
    n = 6000
    docs = spark.range(2 * n).selectExpr("id doc_id", f"if(id < {n}, 'good', 'poor') text")
    trusted = spark.range(n).selectExpr("id doc_id")
    best = quality_rules.apply_quality_rules(docs, trusted).agg({"ratio": "max"}).first()[0]
    assert best == pytest.approx(math.log((n + 1) / (n + quality_rules.BUCKETS)) - math.log((n + 1) / (2 * n + quality_rules.BUCKETS)), abs=1e-6)


def test_quality_rules_equal_sql(spark, docs):
    import duckdb

    con = duckdb.connect()
    odd = [(-1 - k, t, None, None, None) for k, t in enumerate([*ODD, None, "a b c " * 40, "x y", "one  two\x0bthree\n\none two", "\x1cq \x85 w"])]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    both_rows = both.toArrow()  # noqa: F841
    con.execute("create table documents as select * from both_rows")
    con.execute(f"create view labels as select * from '{SF}/labels.parquet'")
    got = quality_rules.apply_quality_rules(both, spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")).toPandas()
    want = con.execute(quality_rules.ORACLE).df()
    plain = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(str).values.tolist()))
    assert plain(got) == plain(want)


def test_other_words_give_another_ratio(spark):
    rows = [(k, " ".join(w * 1 for w in ("alpha beta gamma delta epsilon" if k % 2 else "omega sigma lambda kappa theta").split() * 3)) for k in range(20)]
    got = quality_rules.apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), spark.range(1, 20, 2).selectExpr("id doc_id")).collect()
    assert all((r.ratio > 0) == bool(r.doc_id % 2) for r in got)


# -- secrets --------------------------------------------------------------------------
def secrets_brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secret_base_equals_the_patterns(spark, docs, texts):
    more = ['Password: "hunter2!" TOKEN=abcdef APIKEY = 12345', "AKIA" + "A" * 16 + " AKIAAKIA" + "0" * 30, "0123456789abcdef" * 4, "passworD = short tokenſ=abcdefg", 'api_key":"abc.def=="']
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    every = texts | {-1 - k: t for k, t in enumerate(more)}
    for r in secrets.scan_secrets(table).collect():
        want = secrets_brute(every[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in want) for k in range(3))


def test_guess_cost_is_the_least_of_all_segmentations():
    r = random.Random(2)
    for _ in range(60):
        v = "".join(r.choice(["pass", "1999", "aaa", "qwe", "x", "7", "Q"]) for _ in range(r.randint(1, 3)))
        unit = secrets.per_character(v)
        cost: dict[tuple[int, int], float] = {(i, j): (j - i) * unit for i in range(len(v)) for j in range(i + 1, len(v) + 1)}
        for i, j, c, _ in secrets._segments(v, secrets.RANK, unit):
            cost[i, j] = min(cost[i, j], c)
        cuts = [[k + 1 for k in range(len(v) - 1) if m >> k & 1] for m in range(1 << (len(v) - 1))]
        want = min(sum(cost[a, b] for a, b in zip([0, *c], [*c, len(v)], strict=True)) + len(c) * math.log10(2) for c in cuts)
        assert abs(secrets.guess_cost(v)[0] - want) < 1e-9


def test_guess_cost_orders_passwords():
    cost = [secrets.guess_cost(v)[0] for v in ("password", "aaaaaaaa", "P4ssw0rd123", "qwertyuiop", "x7Kq9zT2mB", "1eb9c654e721b4f812088970e66a6345")]
    assert cost == sorted(cost)


def test_contexts_add_strong_values_only(spark):
    rows = ["my password is Xk29vQz! and", "the secret is wonderful", "the pwd -> password1", "Authorization: Bearer abcD3fgh12Zx99", "passphrase: QwzXpLkVbnTrGhYs", "password is correcthorsebatterystaple", "pin passcode: 83920174650293"]
    got = secrets.scan_secrets(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), words=secrets.ranks(word_bpe())).orderBy("doc_id").collect()
    assert [r.n_method for r in got] == [1, 0, 0, 1, 1, 1, 1]


def test_added_spans_reach_the_end_of_long_values(spark):
    r = random.Random(9)
    for n in (200, 440, 30_000):
        value = "".join(r.choice("abcXYZ0189+/") for _ in range(n))
        text = f"see: Bearer {value} and passphrase -> {value}!x, end"
        (row,) = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        a, b = text.index("Bearer"), text.index("passphrase")
        spans = set(row.spans.split(","))
        assert {f"assign:{a}:{a + 7 + n}", f"assign:{b}:{b + 14 + n + 2}"} <= spans, (n, row.spans)


def test_a_value_beyond_its_fixed_span_is_added_whole():
    text = "password: hunter2!kq#Zx9vW8 end"
    base = secrets.base_spans(text)
    assert base == [(0, 0, 17)]
    assert [m[:3] for m in secrets.context_spans(text, base, 9.0, None)] == [(0, 0, 27)]


# -- tokens -------------------------------------------------------------------------------
def test_bpe_equals_the_library(spark, docs, texts, library):
    more = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    every = texts | {-1 - k: t for k, t in enumerate(ODD)}
    got = bpe.bpe_encode(docs.select("doc_id", "text").unionByName(more), word_bpe(), ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"))
    back = {r.doc_id: r.decoded for r in bpe.bpe_decode(got, word_bpe()).collect()}
    for r in got.collect():
        want = library.encode(every[r.doc_id], add_special_tokens=False)
        assert r.ids == want.ids and r.n_tokens == len(want.ids)
        text = library.decode(want.ids, skip_special_tokens=False)
        assert r.decoded == text == back[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(want.ids, "<u4").tobytes()).hexdigest()


def test_pairs_are_those_that_plain_merging_leaves():
    e = bpe.encoder(open(word_bpe()).read())
    r = random.Random(3)
    inner = [i for t, i in e.inner.items() if e.is_alone(i)]
    final = [i for i in e.final.values() if e.is_alone(i)]
    for _ in range(3000):
        a, b = r.choice(inner), r.choice(inner + final)
        assert e.may_follow(a, b) == (e.merged(e.symbols(a) + e.symbols(b)) == [a, b])


def test_walk_survives_a_small_cache(monkeypatch, texts, library):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    e = bpe.TrieBpe(open(word_bpe()).read())
    some = list(texts.values())[:20]
    ids, _ = e.encode(some)
    assert [np.frombuffer(b, "<u4").tolist() for b in ids] == [x.ids for x in library.encode_batch(some, add_special_tokens=False)]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_chunked_counts_equal_whole_ones(file, texts):
    import public_tokenizers

    with open(public_tokenizers.path(file), "rb") as f:
        e = token_counts.encoder_of(f.read(), file.rsplit(".", 1)[-1])
    long = [t for t in texts.values() if len(t) > 3000][:8]
    for t in [*long, *ODD, "a" * 9000, ("x" * 300 + " ") * 30, " " * 5000 + "a b", "\n\n  a   b \t" * 800, "the <|endoftext|> x" * 400]:
        assert token_counts.count_long(e, t, 1000, 20) == e.counts([t])[0]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_texts_without_blanks_are_encoded_in_proportion(file):
    import public_tokenizers

    with open(public_tokenizers.path(file), "rb") as f:
        e = token_counts.JsonEncoder(f.read())
    seen, plain = [], e.chunk
    e.chunk = lambda text, at: (seen.append(len(text)), plain(text, at))[1]
    for t in ("abcde1" * 50_000, ("x" * 40_000 + " b ") * 5, "a b " * 20_000):
        seen.clear()
        assert token_counts.count_long(e, t, 4000, 100) == e.counts([t])[0]
        assert sum(seen) < 6 * len(t)


def test_other_replacements_prove_nothing():
    import json

    import public_tokenizers

    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json")))
    assert token_counts.blanks_part_words(spec)
    spec["normalizer"]["normalizers"].append({"type": "Replace", "pattern": {"String": "a"}, "content": " "})
    assert not token_counts.blanks_part_words(spec)


def test_counts_by_words_equal_whole_ones(texts, monkeypatch):
    import public_tokenizers

    encoders = {f: token_counts.JsonEncoder(open(public_tokenizers.path(f), "rb").read()) for f in ("word_bpe_49k.json", "byte_bpe_50k.json")}
    assert encoders["word_bpe_49k.json"].apart and not encoders["byte_bpe_50k.json"].apart
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 300)
    for e in encoders.values():
        for part in (list(texts.values()), ODD):
            assert e.short_counts(part) == e.counts(part)


def test_token_counts(spark, docs, texts, library):
    got = token_counts.count_tokens(docs, word_bpe(), chunk=2000, overlap=64).collect()
    for r in got:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


# -- language model ---------------------------------------------------------------------
def lm(spark, rows, **more):
    return {r.doc_id: r for r in mixing_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect()}


def trains(d):
    return zlib.crc32(str(d).encode()) % 7 != 2


def test_base_score_and_counts(spark, docs, texts, monkeypatch):
    for known in (20, mixing_lm.KNOWN_WORDS):
        monkeypatch.setattr(mixing_lm, "KNOWN_WORDS", known)
        monkeypatch.setattr(mixing_lm, "TREE_WORDS", max(10, known // 2))
        got = mixing_lm.score_documents(docs).collect()
        words = {d: WORD.findall(ascii_lower(t)) for d, t in texts.items()}
        train = [d for d in texts if trains(d)]
        c = Counter(w for d in train for w in words[d])
        n, v = sum(c.values()) + len(train), len(c) + 1
        assert len(got) == len(texts)
        for r in got:
            base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[r.doc_id]) + math.log10((len(train) + 1) / (n + v + 1))
            assert r.held_out == (r.doc_id not in train) and r.train_tokens == n and r.n_tokens == len(words[r.doc_id]) + 1
            assert r.n_known == sum(c[w] > 0 for w in words[r.doc_id]) + 1 and abs(r.base_score - base) < 1e-6 * abs(base)
            size = sum(len(w.encode()) + 1 for w in words[r.doc_id]) + 1
            assert r.score < 0 and abs(r.bits_per_byte + r.score * math.log2(10) / size) < 1e-9


def mixed_brute(tree, counts, words, own):
    """Bits of each token of one text, bit by bit in plain Python."""
    sigmoid = lambda s: 1 / (1 + math.exp(-s))
    weights = {g: [float(x) for x in row] for g, row in enumerate(mixing_lm.gates())}
    squares = {g: [1.0] * 3 for g in weights}
    seen = [[mixing_lm.PRIOR * (1 - sigmoid(k / 32 * 24 - 12)), mixing_lm.PRIOR * sigmoid(k / 32 * 24 - 12)] for k in range(33)]
    table, out, steps, met = counts.reshape(2, -1, 2), [], {}, Counter()
    symbols = [*(tree.number.get(w, mixing_lm.ESCAPE) for w in words), mixing_lm.END]
    mask, c, p = (1 << 64) - 1, int(mixing_lm._C), int(mixing_lm._P)
    for i, symbol in enumerate(symbols):
        one, two = (symbols[i - 1] + 1 if i else 0), (symbols[i - 2] + 1 if i > 1 else 0)
        contexts = [(one + 1) * c & mask, ((one + 7) * p + two) * c & mask]
        bits = 0.0
        for k in range(tree.start[symbol], tree.start[symbol] + tree.length[symbol]):
            node, bit = int(tree.node[k]), int(tree.bit[k])
            inputs, gate = [float(tree.stretched[node])], 0
            for j in range(2):
                slot = ((contexts[j] ^ (node * p & mask)) * c & mask) >> (64 - mixing_lm.CONTEXT_BITS)
                zeros, ones = (float(x) for x in table[j, slot])
                zeros, ones = max(zeros - own * (1 - bit), 0), max(ones - own * bit, 0)
                inputs.append(math.log((ones + mixing_lm.SMALL) / (zeros + mixing_lm.SMALL)))
                gate = 4 * gate + sum(zeros + ones > x for x in (0, 2, 15))
            s = min(max(sum(w * x for w, x in zip(weights[gate], inputs, strict=True)), -12), 12)
            near = round((s + 12) / 24 * 32)
            refined = min(max((sigmoid(s) + seen[near][1] / sum(seen[near])) / 2, 1e-6), 1 - 1e-6)
            bits -= math.log2(refined if bit else 1 - refined)
            for j, x in enumerate(inputs):
                steps.setdefault(gate, [0.0] * 3)[j] += (bit - sigmoid(s)) * x
            met[near, bit] += 1
        out.append(bits)
        if i % mixing_lm.BLOCK == mixing_lm.BLOCK - 1:
            for g, step in steps.items():
                for j in range(3):
                    squares[g][j] += step[j] ** 2
                    weights[g][j] += mixing_lm.RATE * step[j] / math.sqrt(squares[g][j])
            for (k, bit), n in met.items():
                seen[k][bit] += n
            steps, met = {}, Counter()
    return out


def test_mixing_equals_plain_python(texts):
    some = [WORD.findall(ascii_lower(t)) for t in list(texts.values())[:25]] + [[], ["only"]]
    common = Counter(w for words in some for w in words).most_common(40)
    tree = mixing_lm.Tree([w for w, _ in common], np.array([len(some), 500, *(n for _, n in common)], np.float64))
    batch = mixing_lm.Batch.of([tree.symbols(words) for words in some])
    symbol = batch.spread(batch.number, mixing_lm.END)
    contexts = batch.contexts(symbol)
    counts = np.zeros(mixing_lm.CONTEXTS << (mixing_lm.CONTEXT_BITS + 1), np.float32)
    token, node, bit = tree.bits(symbol)
    for k in range(2):
        np.add.at(counts, (k << (mixing_lm.CONTEXT_BITS + 1)) + 2 * mixing_lm.slots(contexts[k][token], node) + bit, 1)
    own = np.arange(len(some)) % 3 > 0
    cost = mixing_lm.Mixer(tree, counts).costs(batch, symbol, own)
    for k, words in enumerate(some):
        want = mixed_brute(tree, counts, words, float(own[k]))
        got = cost[batch.first[k] : batch.first[k] + len(words) + 1]
        assert np.allclose(got, want, rtol=1e-4, atol=1e-4) and abs(got.sum() - sum(want)) < 1e-6 * sum(want) + 1e-4
    alone = mixing_lm.Batch.of([tree.symbols(some[3])])
    place = slice(batch.first[3], batch.first[3] + len(some[3]) + 1)
    assert np.array_equal(mixing_lm.Mixer(tree, counts).costs(alone, symbol[place], own[3:4]), cost[place])


def test_tree_is_a_code():
    tree = mixing_lm.Tree([f"w{k}" for k in range(300)], np.concatenate([[5, 7], np.arange(300, 0, -1)]).astype(float))
    assert sum(0.5**n for n in tree.length.tolist()) == pytest.approx(1)
    ways = {tuple(zip(tree.node[a : a + n].tolist(), tree.bit[a : a + n].tolist(), strict=True)) for a, n in zip(tree.start, tree.length, strict=True)}
    assert len(ways) == 302
    total = sum(np.prod([1 / (1 + math.exp(-s if b else s)) for s, b in zip(tree.stretched[tree.node[a : a + n]], tree.bit[a : a + n], strict=True)]) for a, n in zip(tree.start, tree.length, strict=True))
    assert total == pytest.approx(1)


def test_phrases_cover_texts_and_repeat_with_them():
    r = np.random.default_rng(14)
    h = r.integers(1, 2**63, 1000).astype(np.uint64)
    h[200:600] = h[0]  # no end in sight, or one at every word
    batch = mixing_lm.Batch.of([np.arange(100), np.arange(0), np.arange(500), np.arange(400)])
    starts, hashes = mixing_lm.phrases(h, batch.last())
    size = np.diff(np.append(starts, 1000))
    assert starts[0] == 0 and {0, 100, 600} <= set(starts.tolist()) and size.max() <= mixing_lm.LONGEST_PHRASE
    again, same = mixing_lm.phrases(h[600:], np.arange(400) == 399)
    assert np.array_equal(again + 600, starts[starts >= 600]) and np.array_equal(same, hashes[starts >= 600])
    assert len(mixing_lm.phrases(h[:0], np.zeros(0, bool))[0]) == 0


def natural(r, n):
    """Sentences in which each word depends on the one before."""
    after = {w: [f"{w}{x}" for x in "abc"] for w in ("the", "of", "in")} | {f"{w}{x}": ["the", "of", "in"][k : k + 2] for w in ("the", "of", "in") for k, x in enumerate("abc")}
    w, out = "the", []
    for _ in range(n):
        out.append(w)
        w = r.choice(after[w] or ["the"])
    return out


def test_order_counts_and_copies_are_known(spark):
    r = random.Random(15)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    rows = [(k, " ".join(natural(r, 300))) for k in range(200)]
    held = [d for d in range(1000, 1200) if not trains(d)]
    fluent = natural(r, 300)
    salad = fluent[:]
    r.shuffle(salad)
    rows += [(held[0], " ".join(fluent)), (held[1], " ".join(salad))]
    copied = " ".join(word() for _ in range(120))
    learnt = [d for d in range(2000, 2100) if trains(d)]
    rows += [(learnt[0], copied), (learnt[1], copied), (held[2], copied), (learnt[2], " ".join(word() for _ in range(120))), (held[3], " ".join(word() for _ in range(120)))]
    got = lm(spark, rows)
    assert got[held[0]].score > 0.8 * got[held[1]].score  # in bits the salad costs more by a quarter
    assert all(got[d].bits_per_byte < 0.5 < 2 < got[e].bits_per_byte for d in (learnt[0], learnt[1], held[2]) for e in (learnt[2], held[3]))


def test_scores_do_not_depend_on_partitions(spark, docs):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in (1, 8):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append({r.doc_id: r.score for r in mixing_lm.score_documents(docs.repartition(n)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got[0].keys() == got[1].keys() and all(abs(got[0][d] - s) < 1e-9 * abs(s) for d, s in got[1].items())


def test_every_row_is_scored(spark):
    rows = [(5, "the same row"), (5, "the same row"), (5, "another text"), (6, None), (7, "")]
    got = mixing_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [5, 5, 5, 6, 7] and {r.n_tokens for r in got if r.doc_id > 5} == {1}


def test_model_learns(spark, docs):
    got = mixing_lm.score_documents(docs).where("held_out and n_tokens > 50").agg({"bits_per_byte": "avg"}).first()[0]
    assert got < 3.2  # eight bits untrained, about four by letter frequencies


def test_word_costs_add_up_and_share_prefixes():
    m = mixing_lm.Speller(np.zeros(mixing_lm.SLOTS, np.float32), np.zeros(mixing_lm.SLOTS, np.float32))
    words = [b"the", b"then", b"thin", b"a", b"x" * 200, "été".encode(), b"the!"]
    m.learn(words, np.array([5.0, 2, 1, 9, 1, 2, 1]))
    together = m.log10(words)
    assert np.allclose(together, [m.log10([w])[0] for w in words]) and (together < 0).all()


def test_code_is_a_probability():
    """All one-byte words and the ways on after them share the mass of a model between them."""
    m = mixing_lm.Speller(np.zeros(mixing_lm.SLOTS, np.float32), np.zeros(mixing_lm.SLOTS, np.float32))
    for b in range(256):
        assert (mixing_lm.NODES[b, : mixing_lm.LENGTH[b]] < 512).all()
    codes = {(tuple(mixing_lm.CODE[b, : mixing_lm.LENGTH[b]])) for b in range(256)}
    assert len(codes) == 256 and sum(0.5 ** len(c) for c in codes) <= 1
    assert m.refined(np.zeros(4, np.float32), np.array([1, 2, 3, 4])).tolist() == pytest.approx([0.5] * 4)


# -- decontamination ------------------------------------------------------------------------
def test_leaks_equal_shared_eight_grams(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: [w for w in (re.sub(r"[\W_]+", "", x).lower() for x in t.split()) if w]
    grams = {r.item_id: {tuple(w[k : k + 8]) for w in [plain(r.text)] for k in range(len(w) - 7)} for r in bench.collect()}
    want = set()
    for d, t in texts.items():
        w = plain(t)
        own = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        want |= {(d, i) for i, g in grams.items() if len(g & own) >= 3}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == want
    one_by_one = decontaminate.find_leaks(docs, bench, block_words=40)
    assert {(r.doc_id, r.item_id) for r in one_by_one.collect()} == want
    left = {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()}
    assert left == set(texts) - {d for d, _ in want}


def test_leaks_tolerate_substitutions(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items = [" ".join(word() for _ in range(30)) for _ in range(20)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    changed = [" ".join(word() if k % 9 == 4 else w for k, w in enumerate(t.split())) for t in items]
    clean = [" ".join(word() for _ in range(80)) for _ in range(20)]
    rows = [(k, " ".join(word() for _ in range(40)) + " " + t + " end") for k, t in enumerate(changed)] + [(100 + k, t) for k, t in enumerate(clean)]
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(20)} and all(r.n_equal < r.n_words for r in got)


def test_recall_under_random_substitution():
    """Copies that fit the rule, by the rate of substituted words: the seeds may miss few of them."""
    r = random.Random(12)
    for rate, floor in ((0.1, 0.99), (0.2, 0.97)):
        found = fit = 0
        for _ in range(400):
            n = r.choice((15, 20, 30))
            item = [f"w{r.randrange(10**6)}" for _ in range(n)]
            same = [r.random() >= rate for _ in item]
            if not any(sum(same[a:b]) >= 10 and 10 * sum(same[a:b]) >= 7 * (b - a) for a in range(n) for b in range(a + 10, n + 1)):
                continue
            fit += 1
            copy = [w if s else f"other{k}" for k, (w, s) in enumerate(zip(item, same, strict=True))]
            seeds = decontaminate.Seeds.build([(1, " ".join(item))])
            found += seeds.any(decontaminate.WordNumbers().of(" ".join(["before", *copy, "after"])), 10, 0.7)
        assert found >= floor * fit and fit > 300


def test_repetitive_texts_against_alike_items(monkeypatch):
    monkeypatch.setattr(decontaminate, "SEEN", 100)
    seeds = decontaminate.Seeds.build([(k, "the same words come again and again " * 4 + f"end {k}") for k in range(20)])
    words = decontaminate.WordNumbers().of("the same words come again and again " * 300)
    assert set(seeds.found(words, 10, 0.7)) == set(range(20)) and seeds.any(words, 10, 0.7)


def test_every_segment_of_a_diagonal_counts(spark):
    item = [f"w{k}" for k in range(15)]
    copy = [w if k not in (2, 12) else "other" for k, w in enumerate(item)]  # its best segment has 9 equal words of 9
    numbers = decontaminate.WordNumbers()
    docs, bench = spark.createDataFrame([(1, " ".join(copy))], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [(r.n_equal, r.n_words, r.at) for r in decontaminate.find_leaks(docs, bench).collect()] == [(13, 15, 0)]
    assert decontaminate.drop_leaks(docs, bench).count() == 0
    r = random.Random(7)
    for _ in range(2000):
        item = [f"w{k}" for k in range(r.randint(10, 40))]
        same = [r.random() < 0.75 for _ in item]
        seeds = decontaminate.Seeds.build([(1, " ".join(item))])
        words = numbers.of(" ".join(w if s else "other" for w, s in zip(item, same, strict=True)))
        n, length, at = seeds.verify(words, 0, 0, 10, 0.7)
        fits = any(sum(same[a:b]) >= 10 and 10 * sum(same[a:b]) >= 7 * (b - a) for a in range(len(item)) for b in range(a + 1, len(item) + 1))
        assert fits == (n >= 10) and (not fits or (n == sum(same[at : at + length]) and 10 * n >= 7 * length and same[at] and same[at + length - 1]))


def test_short_items_match_whole(spark):
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, ""), (4, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x Alpha, BETA y"), (2, "alpha x beta"), (3, "gamma!")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == {(1, 1), (3, 2)}


# -- quality classifier ----------------------------------------------------------------------
def test_classifier_on_held_out_rows(spark):
    base = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    kept = {r.doc_id for r in quality.filter_quality(docs, model).collect()}
    assert kept == {r.doc_id for r in quality.score_quality(docs, model).where("predicted = 1").collect()}
    assert np.array_equal(quality.fit_quality(docs.repartition(7), labels.repartition(3))[0], model[0])


def test_training_equals_plain_ftrl():
    """The update written out for one coordinate at a time."""
    r = np.random.default_rng(13)
    bits, alpha, beta, l1, l2 = 6, 2.0, 1.0, 0.001, 0.01
    rows = []
    for _ in range(60):
        at = np.sort(r.choice(64, 8, replace=False))
        value = r.random(8).astype(np.float32)
        rows.append(((at, value / np.linalg.norm(value)), int(r.random() < 0.5)))
    z, n = [0.0] * 65, [0.0] * 65
    weight = lambda k: 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)
    for _ in range(6):
        for (at, value), label in rows:
            x = [*zip(at.tolist(), value.tolist(), strict=True), (64, 1.0)]
            w = {k: weight(k) for k, _ in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x)))
            for k, v in x:
                g = (p - label) * v
                sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha
                z[k] += g - sigma * w[k]
                n[k] += g * g
    got, bias = quality.train_ftrl(rows, bits)
    assert np.allclose(got, [weight(k) for k in range(64)], atol=1e-6) and abs(bias - weight(64)) < 1e-6


def test_a_repeated_document_trains_once(spark):
    docs = spark.createDataFrame([(k, f"word{k} good text here") for k in range(1, 40)], "doc_id long, text string")
    marks = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    once, twice = quality.fit_quality(docs, marks), quality.fit_quality(docs.unionAll(docs), marks)
    assert np.array_equal(once[0], twice[0]) and once[1] == twice[1]


def test_without_labels_all_scores_are_even(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(docs, quality.fit_quality(docs, none)).collect()} == {0.5}


# -- near duplicates ----------------------------------------------------------------------------
def shingle_sets(texts, width):
    out = {}
    for d, t in texts.items():
        w = WORD.findall(ascii_lower(t or ""))
        out[d] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    return out


def components_brute(sets):
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {d: top(d) for d in sets}


def family(r, n, edits, words=120):
    """A text and copies with random word changes; the origin need not have the least id."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    r.shuffle(out)
    return out


def test_repeated_ids_lose_no_link(spark):
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    a, c = [word() for _ in range(60)], [word() for _ in range(60)]
    rows = [(5, " ".join(a)), (5, " ".join(c)), (7, " ".join([*a[:-1], "x"])), (8, " ".join([*c[:-1], "y"]))]
    got = near_dups.find_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.component_id) for x in got} == {(5, 5), (7, 5), (8, 5)}
    left = near_dups.drop_near_duplicates(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")).collect()
    assert sorted(map(tuple, left)) == sorted(rows[:2])


def test_random_repeated_ids_equal_brute_force(spark):
    """Rows are numbered for the brute-force version; a component is that of the rows' sets, named by its least id."""
    r = random.Random(11)
    made = [t for n, edits in ((20, 8), (12, 4), (6, 2), (3, 1)) for t in family(r, n, edits, 60)]
    rows = [(r.randrange(12), t) for t in made for _ in range(r.choice((1, 1, 2)))]
    top = components_brute(shingle_sets(dict(enumerate(t for _, t in rows)), 5))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top[k]] = min(least.get(top[k], i), i)
    want = sorted((i, least[top[k]]) for k, (i, _) in enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((x.doc_id, x.component_id) for x in near_dups.find_near_duplicates(docs).collect()) == want
    left = near_dups.drop_near_duplicates(docs).collect()
    assert sorted(x.doc_id for x in left) == sorted(least.values())


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(TypeError):
        near_dups.find_near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, texts, width, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 16)  # several blocks per bucket
    r = random.Random(6)
    made = [t for n, edits in ((60, 12), (20, 3), (5, 8), (1, 1)) for t in family(r, n, edits)] + ["one two", "ONE Two", "one", "", "  "]
    every = texts | {-1 - k: t for k, t in enumerate(made)}
    docs = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    sets = shingle_sets(every, width)
    want = components_brute(sets)
    got = near_dups.find_near_duplicates(docs, width=width).collect()
    assert len(got) == len(every)
    for row in got:
        assert (row.n_shingles, row.component_id, row.kept) == (len(sets[row.doc_id]), want[row.doc_id], want[row.doc_id] == row.doc_id)
    assert {r.doc_id for r in near_dups.drop_near_duplicates(docs, width=width).collect()} == set(want.values())


def test_sketch_estimates_similarity():
    r = np.random.default_rng(7)
    a = r.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], r.integers(0, 2**63, 100).astype(np.uint64)])
    same = np.mean(near_dups.similarity_sketch(np.unique(a), 1024) == near_dups.similarity_sketch(np.unique(b), 1024))
    assert abs(same - 0.6) < 0.08
    one = near_dups.similarity_sketch(np.array([5], np.uint64), 128)
    assert one.max() < np.iinfo(np.uint64).max  # a single element fills all


def test_sketch_rounds_at_once_equal_rounds_in_turn():
    e = np.unique(np.random.default_rng(8).integers(0, 2**63, 37).astype(np.uint64))
    t, seeds = 64, near_dups.round_seeds(64)
    want = [None] * t
    for i in range(2 * t):
        for x in e:
            h = int(near_dups.mix(np.array([x ^ seeds[i]], np.uint64))[0])
            b = h >> 58 if i < t else i - t
            v = i << 48 | h & ((1 << 48) - 1)
            want[b] = v if want[b] is None else min(want[b], v)
        if None not in want:
            break
    assert near_dups.similarity_sketch(e, t).tolist() == want


def block_of(sets, band=0, **columns):
    """One block as block_pairs takes it, each set a component of its own."""
    n = len(sets)
    same = {"rep": range(n), "component": range(n), "block": [0] * n, "band": [band] * n, "low": [0] * n, "high": [0] * n, "is_pivot": [False] * n}
    return pa.table({k: list(v) for k, v in same.items()} | {"n_shingles": [len(s) for s in sets], "fine": [near_dups.fine_sketch(s) for s in sets]} | columns)


def test_no_link_is_pruned_by_a_sketch():
    r = np.random.default_rng(9)

    def draw(n):
        return r.integers(0, 2**63, n).astype(np.uint64)

    def bits(s):  # of a similarity sketch of 2,048 coordinates
        return near_dups.mix(near_dups.similarity_sketch(np.unique(s), 2048)) & np.uint64(1)

    # 40 shingles, 32 of them common: a similarity of 0.8, made so that an estimate from these bits is far too low
    a = b = draw(32)
    for _ in range(4):
        a = np.append(a, max(draw(300), key=lambda x: (bits(np.append(a, x)) != bits(b)).sum()))
        b = np.append(b, max(draw(300), key=lambda x: (bits(np.append(b, x)) != bits(a)).sum()))
    a, b = np.unique(a), np.unique(b)
    assert (bits(a) != bits(b)).sum() > 2048 * 0.1 + 5.5 * (2048 * 0.9 * 0.1) ** 0.5
    assert near_dups.block_pairs(80)(block_of([a, b], marks=[bytes(128), bytes(128)])).to_pylist() == [{"a": 0, "b": 1}]

    # just similar enough, and one shingle less; sizes on both sides of where the sketch's length doubles
    for common in (4, 900, 1000, 1800, 4000, 40000):
        c, d = draw(common), draw(common // 4)
        for more in (d, np.append(d, draw(1))):
            whole = np.unique(np.append(c, more))
            got = near_dups.block_pairs(80)(block_of([np.unique(c), whole])).num_rows
            assert got == 1 if len(more) == len(d) else got in (0, 1)
    assert near_dups.block_pairs(80)(block_of([draw(300), draw(300)])).num_rows == 0

    # an earlier band is common only if all its bits are
    for other, n in (((7 << 32) + 5, 1), (5, 0)):
        assert near_dups.block_pairs(80)(block_of([a, b], 1, earlier=[[5], [other]])).num_rows == n


def test_texts_without_near_copies_are_not_shuffled(spark):
    r = random.Random(11)
    made = [" ".join(f"{r.getrandbits(64):x}" for _ in range(1500)) for _ in range(200)]
    made += [t + " and more" for t in made[:4]] + [made[5]]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").localCheckpoint()
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        executors = store.executorList(True)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    joins = "spark.sql.autoBroadcastJoinThreshold"
    before, threshold = written(), spark.conf.get(joins)
    spark.conf.set(joins, "-1")  # as if all tables were large
    try:
        left = {x.doc_id for x in near_dups.drop_near_duplicates(docs).collect()}
    finally:
        spark.conf.set(joins, threshold)
    assert left == set(range(200))
    assert written() - before < sum(map(len, made)) / 4


def test_lower_similarity_is_refused(docs):
    with pytest.raises(ValueError):
        near_dups.find_near_duplicates(docs, percent=50)


def test_spelling_equals_sums_along_each_word_and_takes_no_step_per_byte():
    r = random.Random(12)
    words = {"".join(r.choices("abcdxyz\u00e9", k=r.choice((1, 2, 3, 40, 60)))) for _ in range(2000)}
    words = sorted(w.encode() for w in words | {w[:20] + "qq" for w in words})
    zeros, ones = np.zeros(mixing_lm.SLOTS), np.zeros(mixing_lm.SLOTS)
    e = mixing_lm.events(words)
    mixing_lm.add_events(zeros, ones, e, np.ones(len(words)))
    model = mixing_lm.Speller(zeros.astype(np.float32), ones.astype(np.float32))
    model.learn(words[::2], np.ones(len(words[::2])))
    n = np.arange(5000, dtype=np.float32)
    assert mixing_lm.Speller.gate(n).tolist() == [min(int(x).bit_length() if x else 0, 11) for x in [0, *range(2, 5001)]]
    for once in (False, True):
        p = model.refined(model.mixed(e, once)[0], e.node)
        cost = np.bincount(e.byte, np.log10(np.where(e.bit == 1, p, 1 - p)), len(e.pos))
        want, path = [], []
        for w in range(len(words)):
            path = path[: e.shared[w]] + cost[e.word == w].tolist()
            want.append(sum(path))
        calls = Counter()
        sys.setprofile(lambda frame, event, arg: calls.update([event]))
        try:
            got = model.log10(words, once)
        finally:
            sys.setprofile(None)
        assert np.allclose(got, want, rtol=1e-9, atol=0)
        assert calls["c_call"] < 10 * len(words)


def test_words_of_a_batch_equal_those_of_each_text():
    odd = ["", None, "one", " \t\n\x0b\x0c\r", "Two TWO two", "\x1cA\x85b\u2003C \u00c9t\u00c9 \u0130\U0001f600", "a" * 3000 + "\rB", None, "z\x00z", " end ", "start"]
    for texts in (pa.array(odd), pa.array(["before", *odd, "after"])[1:-1], pa.array(odd, pa.large_string()), pa.array([], pa.string()), pa.array([None, None], pa.string())):
        got = mixing_lm.Words.of(texts)
        want = [WORD.findall(ascii_lower(t or "")) for t in texts.to_pylist()]
        own = mixing_lm.strings(got.distinct)
        assert [own[k] for k in got.number.tolist()] == [w for words in want for w in words] and len(own) == len(set(own))
        assert got.size.tolist() == [len(words) for words in want] and got.n_bytes.tolist() == [sum(len(w.encode()) for w in words) for words in want]


def test_tallies_and_scores_take_no_step_per_word_and_give_each_word_once(monkeypatch):
    r = random.Random(16)
    texts = [" ".join(f"{r.choice('aB')}{int(r.paretovariate(0.3)) % 30_000}" for _ in range(400)) for _ in range(100)]
    own = np.array([r.random() < 0.8 for _ in texts])
    count = [Counter(w for t, mine in zip(texts, own, strict=True) if mine == which for w in ascii_lower(t).split()) for which in (True, False)]
    calls, tally, rows = Counter(), mixing_lm.Tally(), []

    def counted(make):
        sys.setprofile(lambda frame, event, arg: calls.update([event]))
        try:
            return make()
        finally:
            sys.setprofile(None)

    for k in range(0, len(texts), 10):
        counted(lambda k=k: tally.add(mixing_lm.Words.of(pa.array(texts[k : k + 10])), own[k : k + 10]))
    for b in counted(lambda: [*tally.rows(3)]):
        assert set(b["grp"].to_pylist()) == {3}
        rows += zip(*(b[c].to_pylist() for c in ("key", "n", "others")), strict=True)
    words = {k: (n, others) for k, n, others in rows if k and k[0] != " "}
    assert words == {w: (count[0][w], count[1][w]) for w in count[0] | count[1]} and len({k for k, _, _ in rows}) == len(rows)
    assert rows[0] == ("", own.sum(), (~own).sum())

    leaves = [w for w, _ in count[0].most_common(50)]
    tree = mixing_lm.Tree(leaves, np.array([own.sum(), 1000, *(count[0][w] for w in leaves)], np.float64))
    speller = mixing_lm.Speller(np.zeros(mixing_lm.SLOTS, np.float32), np.zeros(mixing_lm.SLOTS, np.float32))
    monkeypatch.setattr(speller, "log10", lambda words, leave_out: np.full(len(words), -5.0))
    total = count[0].total()
    corpus = mixing_lm.Corpus(mixing_lm.Mixer(tree, np.zeros(mixing_lm.CONTEXTS << (mixing_lm.CONTEXT_BITS + 1), np.float32)), speller, {w: count[0][w] for w in leaves}, total + int(own.sum()), len(count[0]) + 1, int(own.sum()), 1000, 0.1, 1)
    scorer = mixing_lm.GroupScorer(corpus, {w: n for w, n in count[0].items() if n > 1 or count[1][w]})
    got = counted(lambda: scorer.score(mixing_lm.Words.of(pa.array(texts)), own))
    for k, t in enumerate(texts):
        known = [count[0][w] for w in ascii_lower(t).split()]
        assert got["n_tokens"][k] == 401 and got["n_known"][k] == sum(n > 0 for n in known) + 1
        assert got["base_score"][k] == pytest.approx(sum(math.log10((n + 1) / (corpus.tokens + corpus.distinct + 1)) for n in [*known, corpus.ends]))
    assert calls["call"] < len(words) / 2


# -- licences ------------------------------------------------------------------------------------
def test_licenses_equal_sql(spark, docs):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = licenses.document_licenses(docs).toPandas()
    assert (got["basis"] == "inherited").sum() > 0
    want = con.execute(licenses.ORACLE).df()
    plain = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(lambda x: x.notna(), -1).astype(str).values.tolist()))
    assert plain(got) == plain(want)


def test_whole_texts_and_headers_are_matched(spark):
    """Wrapped texts without their titles: the two BSD licences differ in one clause only, and ISC's has no cue but 'copyright'."""
    by = {}
    for name, body in licenses.TEMPLATES:
        by.setdefault(name, []).append(body)
    wrap = lambda t, mark: "\n".join(mark + " ".join(t.split()[k : k + 9]) for k in range(0, len(t.split()), 9))
    rows = []
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"):
        rows.append((len(rows), f"Copyright (c) 2020 A. Body\n\n{wrap(by[name][-1], '')}\n", f"{name}/LICENSE", name))
        rows.append((len(rows), "int x;", f"{name}/src/a.c", name))
    for name in ("Apache-2.0", "GPL-3.0", "GPL-2.0"):
        rows.append((len(rows), f"{wrap(by[name][-1], '# ')}\n\nimport os\n", f"code/{name}.py", name))
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, path string, want string"), more=("want",)).collect()
    assert len(got) == len(rows) and all(r.license == r.want for r in got)
    assert {r.from_dir for r in got if r.basis == "inherited"} == {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"}


def test_ties_go_to_the_first_name(spark, monkeypatch):
    monkeypatch.setattr(licenses, "TEMPLATES", (("B", "Licensed in some way."), ("A", "Licensed in some way."), ("C", "Other words.")))
    rows = [(1, "Licensed in some way.", "x"), (2, "Licensed in some way. Licensed in some way.", "y")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, path string")).orderBy("doc_id").collect()
    assert [(r.own_license, r.n_notices) for r in got] == [("A", 1), ("A", 2)]


def test_licenses_come_from_the_nearest_directory(spark):
    rows = [
        (1, "Released under the MIT License.", "a/LICENSE"),
        (2, "Licensed under the Apache License, Version 2.0.", "a/b/COPYING.txt"),
        (3, "code", "a/x.py"),
        (4, "code", "a/b/c/d.py"),
        (5, "code", "z/y.py"),
        (6, "This work is licensed under the GNU General Public License, version 3.", "a/b/own.py"),
        (7, None, None),
    ]
    got = {r.doc_id: (r.license, r.basis, r.from_dir) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got == {
        1: ("MIT", "notice", None), 2: ("Apache-2.0", "notice", None), 3: ("MIT", "inherited", "a"), 4: ("Apache-2.0", "inherited", "a/b"), 5: (None, "none", None), 6: ("GPL-3.0", "notice", None), 7: (None, "none", None),
    }
