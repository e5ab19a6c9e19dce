"""Quality rules with an importance ratio: hashed n-grams of trusted against raw text.

DataFrame functions only.  Two multinomials over hashed word unigrams and bigrams are
counted, one over trusted target documents and one over all documents; a document's score
is its mean log-likelihood ratio per n-gram, and a fixed threshold decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored

#: Hash space of the n-grams; pseudo-count of every bucket in both multinomials.
BUCKETS, PRIOR = 1 << 18, 1
#: A bigram's hash is that of its first word times this, and that of its second.
STEP = 1_000_003
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_column(text: Column) -> Column:
    """All maximal runs outside the six separators."""
    return let(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def duplicate_lines(text: Column) -> Column:
    """Lines that hold a word and equal an earlier line."""
    lines = F.filter(F.split(text, r"\n"), lambda line: line.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def cover(places: Column) -> Column:
    """Words under 3-word windows at sorted places: each adds three, or the distance to the next if that is less."""
    return F.coalesce(F.aggregate(F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1), p + 3) - p, F.lit(3))), F.lit(0), lambda a, x: a + x), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, each counted once.

    Windows are compared by a 64-bit hash.  A set tells the texts that repeat nothing; in
    the others sorting brings equal hashes together.  Where few windows repeat, the places
    are found by looking through these few, else by sorting (hash, place) pairs.
    """

    def from_pairs(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        places = let(pairs, lambda s: F.filter(F.transform(s, lambda w, i: F.when((w["h"] == F.get(s, i - 1)["h"]) | (w["h"] == F.get(s, i + 1)["h"]), w["p"])), lambda p: p.isNotNull()))
        return let(F.sort_array(places), cover)

    def from_few(h: Column, few: Column) -> Column:
        places = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(few, x), i)), lambda p: p.isNotNull())
        return let(places, cover)

    def count(h: Column) -> Column:
        repeats = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
        some = let(repeats, lambda few: F.when(F.size(few) <= 24, from_few(h, few)).otherwise(from_pairs(h)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(some)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), count)))


def grams(words: Column) -> Column:
    """Hashes of a document's unigrams and bigrams, from the crc32 of its words; a bucket is the remainder."""

    def both(h: Column) -> Column:
        n = F.size(h) - 1
        bi = F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: a * STEP + b)
        return F.when(n > 0, F.concat(h, bi)).otherwise(h)

    return let(F.transform(words, F.crc32), both)


def bucket(gram: Column, buckets: int) -> Column:
    return (gram % buckets).cast("int")


def ratio_table(docs: DataFrame, trusted: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """(g, value): the log-likelihood ratio of every bucket that occurs, from one pass over all documents that adds up map-side first.

    The raw multinomial counts every document, the target one every trusted one.  Trusted
    ids grow with the corpus, so a merge join marks the documents at every size, which
    shuffles the texts once.  The table has one row per bucket at most, whatever the input.
    """
    good = trusted.select(F.col(id_col).alias("good")).where("good is not null").distinct()
    bare = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = bare.join(good.hint("merge"), F.col("id") == F.col("good"), "left")
    rows = marked.select(F.col("good").isNotNull().cast("long").alias("good"), F.explode(grams(words_column(F.col("text")))).alias("gram"))
    counts = stored(rows.groupBy(bucket(F.col("gram"), buckets).alias("g")).agg((F.count(F.lit(1)) + PRIOR).alias("raw"), (F.sum("good") + PRIOR).alias("good")))
    unseen = F.lit(buckets * PRIOR) - F.count(F.lit(1)) * PRIOR
    all_raw, all_good = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)) + unseen, F.coalesce(F.sum("good"), F.lit(0)) + unseen).first()
    return counts.select("g", (F.log(F.col("good") / F.lit(all_good)) - F.log(F.col("raw") / F.lit(all_raw))).alias("value"))


def apply_quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = -0.4,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rule counts, base_failed, the ratio and kept for every whole text.

    ``trusted``: ids of target documents.  ratio is the mean over a text's hashed unigrams
    and bigrams, to six digits (0 for a text without words); kept if the base rules hold and
    ratio >= threshold.  Without trusted documents the target multinomial is uniform.
    The usual edge cases; a null or empty text has no words and fails the base rules.
    """
    ratios = ratio_table(docs, trusted, buckets, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(id_col).alias("id"), text.alias("text"), words_column(text).alias("w"))
    counts = {
        "n_words": F.size("w").cast("long"),
        "word_chars": F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
        "n_symbols": (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": duplicate_lines(F.col("text")).cast("long"),
        "n_repeat_words": repeated_words(F.col("w")).cast("long"),
    }
    # a text's n-grams stay in its task: they meet their ratios and are added up again before the shuffle, which has a row per text
    counted = words.select("id", F.monotonically_increasing_id().alias("row"), *(c.alias(n) for n, c in counts.items()), grams(F.col("w")).alias("grams"))
    spread = counted.select("id", "row", *counts, F.explode_outer("grams").alias("gram")).withColumn("g", bucket(F.col("gram"), buckets))
    per = spread.join(F.broadcast(ratios), "g", "left").groupBy("row", "id", *counts).agg(F.sum("value").alias("total"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    ratio = F.round(F.coalesce(F.col("total") / (2 * F.col("n_words") - 1), F.lit(0.0)), 6)
    out = per.select(F.col("id").alias(id_col), *counts, failed.alias("base_failed"), ratio.alias("ratio"))
    return out.select(id_col, *counts, "base_failed", (~F.col("base_failed") & (F.col("ratio") >= threshold)).alias("kept"), "ratio")


#: The query's rows in SQL: crc32 byte by byte over distinct words, then counts and sums.
ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AS good FROM documents d),
numbered AS (SELECT row_number() OVER () AS r, * FROM docs),
tokens AS (SELECT r, good, unnest(list_filter(string_split_regex(text, '[\x09-\x0D\x20]+'), lambda x: x <> '')) AS word,
                  generate_subscripts(list_filter(string_split_regex(text, '[\x09-\x0D\x20]+'), lambda x: x <> ''), 1) AS k FROM numbered),
bytes_of AS (SELECT word, hex(encode(word)) AS hx FROM (SELECT DISTINCT word FROM tokens)),
tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
crc AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(hx) // 2),
          lambda k: (instr('0123456789ABCDEF', substr(hx, 2 * k + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hx, 2 * k + 2, 1)) - 1)),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM bytes_of, tab),
hashed AS (SELECT r, good, word, k, h, lag(word, 1) OVER w AS w1, lag(word, 2) OVER w AS w2, lag(h) OVER w AS h1 FROM tokens JOIN crc USING (word) WINDOW w AS (PARTITION BY r ORDER BY k)),
grams AS (SELECT r, good, h % 262144 AS g FROM hashed UNION ALL SELECT r, good, (h1 * 1000003 + h) % 262144 FROM hashed WHERE h1 IS NOT NULL),
counts AS (SELECT g, count(*) + 1 AS raw, count(*) FILTER (good) + 1 AS good FROM grams GROUP BY g),
sums AS (SELECT (SELECT sum(raw - 1) FROM counts) + 262144 AS all_raw, (SELECT sum(good - 1) FROM counts) + 262144 AS all_good),
ratios AS (SELECT g, ln(good / (all_good * 1e0)) - ln(raw / (all_raw * 1e0)) AS v FROM counts, sums),
mean AS (SELECT r, avg(v) AS ratio FROM grams JOIN ratios USING (g) GROUP BY r),
again AS (SELECT r, w2, w1, word FROM hashed WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT k) AS n FROM (
  SELECT h.r, unnest([h.k - 2, h.k - 1, h.k]) AS k FROM hashed h JOIN again a ON h.r = a.r AND h.w2 = a.w2 AND h.w1 = a.w1 AND h.word = a.word) GROUP BY r),
sizes AS (SELECT r, count(*) AS n, sum(length(word))::BIGINT AS chars FROM tokens GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM numbered) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
rows_ AS (SELECT d.doc_id, coalesce(s.n, 0) AS n_words, coalesce(s.chars, 0) AS word_chars,
                 length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines,
                 coalesce(c.n, 0) AS n_repeat_words, round(coalesce(m.ratio, 0), 6) AS ratio
          FROM numbered d LEFT JOIN sizes s USING (r) LEFT JOIN lines l USING (r) LEFT JOIN covered c USING (r) LEFT JOIN mean m USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND ratio >= -4e-1 AS kept, ratio
FROM rows_
"""
