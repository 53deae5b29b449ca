"""Quality rules: base counts, and hashed n-gram log-likelihood ratios, with SQL functions only.

Words and pairs of neighbouring words are hashed to ``BUCKETS`` buckets. Two multinomials are
counted over them: the *raw* corpus (all documents) and the *trusted* target (documents labelled
good). A bucket's weight is the logarithm of its smoothed share in the target less that in the raw
corpus, in whole thousandths. A document's score is the sum of its grams' weights divided by their
number. The threshold is the score that all but ``LOW_SHARE`` of the trusted documents reach (the
discrete quantile, so the least score where they are few); a document is kept if it reaches it too
and no base rule failed. Sums are integers and scores are compared in whole hundred-thousandths, so
every verdict is the same on every run and partitioning.

Only the two histograms (``BUCKETS`` rows) and the threshold reach the driver; the weights return to
the tasks as one constant. Counting is one scan with partial aggregation, the threshold a scan of
the trusted documents, scoring a scan without any shuffle.

Repeated 3-word windows are found within a row by sorting 64-bit numbers that hold a window's hash
in the high bits and its position in the low ones. Those that meet are compared by their words, so the
count is exact.

Defined cases: a null text has no words; it fails the base rules. A document without grams scores 0.
Labels that are null or not 1 are not trusted; without any trusted document all weights and the
threshold are 0. Rows
that repeat a ``doc_id``, or have none, are judged each. An empty table gives an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenflow.llm import common

BUCKETS = 8192
SMOOTH = 1.0
#: Share of the trusted documents that may lie below the threshold.
LOW_SHARE = 0.001
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_WHITE = r"[\\x20\\x09-\\x0D]+"


def _worded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return text.selectExpr("doc_id", "t", f"array_remove(split(t, '{_WHITE}'), '') AS w")


_HASHED = "transform(w, x -> xxhash64(x)) AS u"
_PAIRS = "CASE WHEN size(u) > 1 THEN sequence(1, size(u) - 1) ELSE cast(array() AS array<int>) END"


def _gramed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """u, the words' hashes, and at, the places of pairs."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    texts = docs.select(*rest, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return texts.selectExpr(*rest, f"array_remove(split(t, '{_WHITE}'), '') AS w").selectExpr(*rest, _HASHED).selectExpr(*rest, "u", f"{_PAIRS} AS at")


def histograms(docs: DataFrame) -> tuple[list[int], list[int]]:
    """Number of grams in each bucket over the rows (doc_id, text, trusted) that are trusted, and over all."""
    buckets = _gramed(docs, "doc_id", "text").selectExpr("trusted", f"explode(concat(transform(u, x -> cast(pmod(x, {BUCKETS}L) AS int)), transform(at, i -> cast(pmod(xxhash64(u[i - 1], u[i]), {BUCKETS}L) AS int)))) AS b")
    target, raw = [0] * BUCKETS, [0] * BUCKETS
    for r in buckets.groupBy("b").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target")).collect():  # BUCKETS rows at most
        target[r["b"]], raw[r["b"]] = r["target"], r["raw"]
    return target, raw


def weights(target: list[int], raw: list[int]) -> list[int]:
    """Log-ratio of smoothed shares for each bucket, in thousandths."""
    t, r = sum(target), sum(raw)
    if not t:
        return [0] * len(raw)
    n = len(raw)
    return [round(1000 * (math.log((a + SMOOTH) / (t + SMOOTH * n)) - math.log((b + SMOOTH) / (r + SMOOTH * n)))) for a, b in zip(target, raw, strict=True)]


def _total(table: list[int]) -> Column:
    """Sum of the weights of a row's grams, from u and at."""
    constant = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")  # folded to one constant
    gram = lambda b: F.get(constant, b.cast("int"))
    single = F.aggregate("u", F.lit(0).cast("long"), lambda acc, x: acc + gram(F.pmod(x, F.lit(BUCKETS))))
    double = F.aggregate("at", F.lit(0).cast("long"), lambda acc, i: acc + gram(F.pmod(F.xxhash64(F.get("u", i - 1), F.get("u", i)), F.lit(BUCKETS))))
    return single + double


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> tuple[list[int], int]:
    """The buckets' weights from all of ``docs`` and those that ``labels`` marks 1, and the threshold in hundred-thousandths."""
    good = common.settle(labels.filter(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "quality-trusted")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    few = good.limit(common.BROADCAST_IDS + 1).count() <= common.BROADCAST_IDS
    marked = good.withColumn("good", F.lit(1))
    rows = own.join(F.broadcast(marked) if few else marked, "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(0)).alias("trusted"))
    table = weights(*histograms(rows))
    if not any(table):
        return table, 0
    scored = _gramed(common.rows_with_ids(own, good, "doc_id"), "doc_id", "text").filter("size(u) > 0").select(_total(table).alias("total"), (2 * F.size("u") - 1).alias("grams"))
    least = scored.selectExpr("cast(floor(total * 100 / grams) AS long) AS v").selectExpr(f"percentile_disc({LOW_SHARE}) WITHIN GROUP (ORDER BY v) AS v").first()["v"]
    return table, int(least or 0)


def score(docs: DataFrame, table: list[int], threshold: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: base counts, score, base_failed and kept (``threshold`` in hundred-thousandths)."""
    white, symbols = r"\t\n\x0b\x0c\r ".encode().decode("unicode_escape"), "#*$%&|<>"
    bare = lambda c: F.translate(c, white, "")
    lines = F.filter(F.split("t", "\n"), lambda x: bare(x) != "")
    rows = _worded(docs, id_col, text_col).select("doc_id", "w", F.size("w").alias("n"), F.length(bare(F.col("t"))).cast("long").alias("word_chars"), (F.length("t") - F.length(F.translate("t", symbols, ""))).cast("long").alias("n_symbols"), lines.alias("lines"))
    base = ["doc_id", "n", "word_chars", "n_symbols", "n_dup_lines"]
    rows = rows.selectExpr(*base[:-1], "cast(size(lines) - size(array_distinct(lines)) AS long) AS n_dup_lines", "w", _HASHED)
    rows = rows.selectExpr(*base, "w", "u", f"{_PAIRS} AS at", "CASE WHEN n > 2 THEN sequence(0, n - 3) ELSE cast(array() AS array<int>) END AS windows", "cast(ceil(log2(greatest(n, 2))) AS int) AS bits")
    rows = rows.select(*base, "w", "bits", _total(table).alias("total"), F.expr("sort_array(transform(windows, i -> shiftleft(xxhash64(u[i], u[i + 1], u[i + 2]), bits) | i)) AS s"))
    twice = "filter(s, (x, i) -> shiftright(x, bits) = shiftright(get(s, i - 1), bits) OR shiftright(x, bits) = shiftright(get(s, i + 1), bits))"
    rows = rows.selectExpr(*base, "w", "total", f"transform({twice}, x -> cast(x & (shiftleft(1L, bits) - 1) AS int)) AS met")
    rows = rows.selectExpr(*base, "total", "sort_array(transform(met, i -> struct(w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, cast(i AS long) AS i))) AS s")
    same = lambda k: " AND ".join(f"x.{c} = get(s, {k}).{c}" for c in "abc")
    rows = rows.selectExpr(*base, "total", f"sort_array(transform(filter(s, (x, k) -> ({same('k - 1')}) OR ({same('k + 1')})), x -> x.i)) AS p")
    covered = "aggregate(p, struct(0L AS n, -3L AS last), (a, x) -> struct(a.n + least(3L, x - a.last) AS n, x AS last), a -> a.n)"
    rows = rows.selectExpr(*base, "total", f"{covered} AS n_repeat_words")
    rows = rows.selectExpr("doc_id", "cast(n AS long) AS n_words", *base[2:], "n_repeat_words", f"n < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n AS base_failed", "total", "cast(greatest(2 * n - 1, 0) AS long) AS grams")
    return rows.selectExpr("doc_id", "n_words", *base[2:], "n_repeat_words", "base_failed", f"NOT base_failed AND 100 * total >= {threshold} * grams AS kept", "CASE WHEN grams > 0 THEN total / (1000.0D * grams) ELSE 0.0D END AS score")


def judge(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit the weights and score every document."""
    return score(docs, *fit(docs, labels, label_col, id_col, text_col), id_col, text_col)
