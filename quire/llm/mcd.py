"""Quality rules: base limits, and robust multivariate outliers of text statistics.

Per text: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, all from the whole
text. A text fails the base rule with fewer than 10 words or more than 20 % of its words in repeated
5-word windows. The others have a vector of transformed statistics, and per language and source the
minimum-covariance-determinant estimate of its location and spread: from two starts at the medians, one with the quartile
distances and one with the median deviations (which a third of outlying rows can't widen much),
concentration steps take the ``COVER`` share of the rows nearest by Mahalanobis distance and estimate
mean and covariance anew from them, until no estimate changes or for ``STEPS`` steps. ``COVER`` of at least ``LEAST_ROWS`` rows is no less than the
(n + p + 1) / 2 rows of the usual coverage, so up to 45 % of a group may be junk. The start with the lesser determinant is taken; then the spread is scaled to the median distance, and a last step
takes all rows within the 97.5 % quantile. Rows farther than ``CUT`` from their group's estimate are rejected.

A group with fewer than ``LEAST_ROWS`` rows uses the estimate of its language, and a language with fewer
that of all rows. ``FLOORS``, the rounding of the statistics, are added to the variances, so that a statistic that is the same for most rows
doesn't reject on its least step. ``CUT`` is the 0.9999 quantile of the chi-square distribution. Each step is two sums over the rows, with partial sums in the tasks first: one
of counts by distance class (which gives the distance that covers the share), and one of moments.
Vectors are rounded to binary fractions, so sums don't depend on the order.

Null texts have no words and fail. Null languages and sources are groups of their own. Repeated rows
count each. Windows are compared by 64-bit hashes within a text. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, WORD, stored

WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
NAMES = ("words", "length", "symbols", "lines", "repeats")
DIM = len(NAMES)
#: Variances of the statistics' steps: a deviation of one word or letter in LEAST_WORDS; the rounding to one symbol or line, and to
#: the WINDOW + 1 words that the least repeat has, in 100 words.
FLOORS = (1 / LEAST_WORDS**2, 1 / LEAST_WORDS**2, math.log(2) ** 2 / 12, math.log(2) ** 2 / 12, math.log(WINDOW + 2) ** 2 / 12)
COVER, STEPS, LEAST_ROWS = 0.55, 20, 60
CHI_MEDIAN, CHI_975 = 4.351, 12.833  # quantiles of 5 degrees of freedom
CUT = 25.745  # the quantile of 0.9999: of normal rows one in ten thousand is rejected
FRACTION, CLASSES = 1024.0, 32


def statistics(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and the five statistics of each row of ``docs(text, ...)``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    first = docs.select(
        *keep,
        F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "").alias("_words"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    kept = [*keep, "word_chars", "n_symbols"]
    window = lambda i: F.xxhash64(*[F.element_at("_words", i + k) for k in range(WINDOW)])
    hashed = first.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), window)).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    kept += ["n_words", "n_dup_lines"]
    twice = F.size("_windows") > F.size(F.array_distinct("_windows"))
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = hashed.select(*kept, F.when(twice, placed).alias("_placed"))
    n = F.size("_placed")
    hash_at = lambda k: F.get(F.col("_placed"), k)["h"]
    again = F.filter("_placed", lambda x, k: ((k > 0) & (hash_at(k - 1) == x["h"])) | ((k + 1 < n) & (hash_at(k + 1) == x["h"])))
    places = ordered.select(*kept, F.sort_array(F.transform(again, lambda x: x["i"])).alias("_places"))
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).cast("long").alias("n"))
    covered = F.aggregate("_places", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), step, lambda a: a["n"])
    return places.select(*keep, *[F.col(s) for s in STATS[:-1]], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def vector() -> list[Column]:
    """The transformed statistics: logs of size and word length, and of symbols, repeated lines and repeated words per 100 words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    per_100 = lambda c: F.log1p(F.col(c) * 100.0 / n)
    raw = [F.log(n), F.log((F.col("word_chars") + 1.0) / n), per_100("n_symbols"), per_100("n_dup_lines"), per_100("n_repeat_words")]
    return [(F.round(x * FRACTION) / FRACTION).alias(f"x_{name}") for x, name in zip(raw, NAMES, strict=True)]


X = [f"x_{name}" for name in NAMES]


def group_key(level: int) -> Column:
    """Name of the row's group: 2 language and source, 1 language, 0 all rows."""
    part = lambda c, on: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) if on else F.lit("*")
    return F.concat_ws("\u0001", part("lang", level > 0), part("source", level > 1))


def _means(rows: DataFrame, where: Column) -> DataFrame:
    """Means and covariances, with the floors, of each key's rows for which ``where`` holds."""
    inside = rows.where(where)
    products = [F.avg(F.col(a) * F.col(b)).alias(f"p{i}{j}") for i, a in enumerate(X) for j, b in enumerate(X) if j <= i]
    sums = inside.groupBy("key").agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(X)], *products)
    cov = [(F.col(f"p{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + (FLOORS[i] if i == j else 0.0)).alias(f"c{i}{j}") for i in range(DIM) for j in range(i + 1)]
    return sums.select("key", *[f"m{i}" for i in range(DIM)], *cov)


def _whitened(estimate: DataFrame, scale: Column | float = 1.0) -> DataFrame:
    """``estimate`` with ``w_ij``, the inverse of the Cholesky factor of the covariance times ``scale``."""
    out = estimate
    for i in range(DIM):  # row i of the factor, then of its inverse
        for j in range(i):
            done = reduce(add, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") * scale - done) / F.col(f"l{j}{j}"))
        done = reduce(add, [F.col(f"l{i}{k}") * F.col(f"l{i}{k}") for k in range(i)], F.lit(0.0))
        out = out.withColumn(f"l{i}{i}", F.sqrt(F.greatest(F.col(f"c{i}{i}") * scale - done, F.lit(1e-9))))
        for j in range(i):
            above = reduce(add, [F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)])
            out = out.withColumn(f"w{i}{j}", -above / F.col(f"l{i}{i}"))
        out = out.withColumn(f"w{i}{i}", 1.0 / F.col(f"l{i}{i}"))
    return out.select("key", *[f"m{i}" for i in range(DIM)], *[f"w{i}{j}" for i in range(DIM) for j in range(i + 1)])


def _with_distance(rows: DataFrame, estimate: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with ``d``, the squared Mahalanobis distance to their key's estimate."""
    turned = [reduce(add, [F.col(f"w{i}{j}") * (F.col(X[j]) - F.col(f"m{j}")) for j in range(i + 1)]) for i in range(DIM)]
    return rows.join(estimate, "key", how).select(*[rows[c] for c in rows.columns], reduce(add, [t * t for t in turned]).alias("d"))


def _class_of(d: Column) -> Column:
    return F.floor(F.log2(d + 1) * CLASSES).cast("int")


def _covering(rows: DataFrame, share: float) -> DataFrame:
    """``key, upto``: the lowest distance class up to which lies the share of the key's rows."""
    counts = rows.groupBy("key", _class_of(F.col("d")).alias("_class")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("key")
    upto = w.orderBy("_class").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("sum", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(w))
    return ranked.where(F.col("sum") >= share * F.col("all")).groupBy("key").agg(F.min("_class").alias("upto"))


def _ranked(counts: DataFrame) -> DataFrame:
    w = Window.partitionBy("key", "at")
    upto = w.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("sum", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(w))


def _starts(rows: DataFrame) -> DataFrame:
    """First estimates from medians, and quartile distances (start 0) or median deviations (start 1) of each statistic, from counts of its rounded values."""
    values = rows.select("key", F.posexplode(F.array(*X)).alias("at", "x")).withColumn("x", F.round(F.col("x") * 32) / 32)
    counts = stored(values.groupBy("key", "at", "x").agg(F.count("*").alias("n")))
    quantile = lambda q: F.min(F.when(F.col("sum") >= q * F.col("all"), F.col("x")))
    each = stored(_ranked(counts).groupBy("key", "at").agg(quantile(0.25).alias("low"), quantile(0.5).alias("middle"), quantile(0.75).alias("high")))
    off = counts.join(each.select("key", "at", "middle"), ["key", "at"]).groupBy("key", "at", F.abs(F.col("x") - F.col("middle")).alias("x")).agg(F.sum("n").alias("n"))
    each = stored(each.join(_ranked(off).groupBy("key", "at").agg(quantile(0.5).alias("off")), ["key", "at"]))
    at = lambda c, i: F.max(F.when(F.col("at") == i, F.col(c)))
    spreads = [lambda i: F.pow((at("high", i) - at("low", i)) / 1.349, 2) + FLOORS[i], lambda i: F.pow(at("off", i) * 1.4826, 2) + FLOORS[i]]
    out = []
    for k, spread in enumerate(spreads):
        cov = [(spread(i) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(DIM) for j in range(i + 1)]
        out.append(each.groupBy("key").agg(*[at("middle", i).alias(f"m{i}") for i in range(DIM)], *cov).withColumn("key", _of_start(k)))
    return out[0].unionByName(out[1])


def _of_start(k: int) -> Column:
    return F.concat("key", F.lit(f"\u0002{k}"))


def estimates(rows: DataFrame, cover: float = COVER, steps: int = STEPS) -> DataFrame:
    """Reweighted MCD estimates of ``rows(key, x_...)``, whitened: a row per key."""
    twice = rows.select(F.explode(F.array(_of_start(0), _of_start(1))).alias("key"), *X)
    now, raw = stored(_whitened(_starts(rows))), None
    for _ in range(steps):
        far = _with_distance(twice, now)
        limit = stored(_covering(far, cover))
        before, raw = raw, stored(_means(far.join(limit, "key"), _class_of(F.col("d")) <= F.col("upto")))
        now = stored(_whitened(raw))
        if before is not None and raw.join(before, raw.columns, "left_anti").isEmpty():
            break
    # of the two starts the one with the lesser determinant, the first of equal ones
    size = reduce(lambda a, b: a * b, [F.col(f"w{i}{i}") for i in range(DIM)])
    best = now.groupBy(F.substring_index("key", "\u0002", 1).alias("_base")).agg(F.min(F.struct((-size).alias("size"), F.col("key"))).alias("_b"))
    best = stored(best.select("_base", F.col("_b.key").alias("key")))
    chosen = lambda df: stored(df.join(best, "key").withColumn("key", F.col("_base")).drop("_base"))
    now, raw = chosen(now), chosen(raw)
    # the spread of the nearest rows is too small by a factor; the median distance tells it
    middle = _covering(_with_distance(rows, now), 0.5).select("key", ((F.pow(F.lit(2.0), F.col("upto") / CLASSES) - 1) / CHI_MEDIAN).alias("factor"))
    scaled = stored(_whitened(raw.join(middle, "key"), F.greatest(F.col("factor"), F.lit(1.0))))
    return stored(_whitened(_means(_with_distance(rows, scaled), F.col("d") <= CHI_975)))


def judge(docs: DataFrame, cut: float = CUT, least_rows: int = LEAST_ROWS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the statistics, ``base_failed``, ``distance`` (null where the base rule fails) and ``kept`` of every row of ``docs(doc_id, text, lang, source)``."""
    found = statistics(docs, (*keep, *[c for c in ("lang", "source") if c not in keep]))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = stored(found.withColumn("base_failed", failed).select("*", *vector()))
    good = rows.where(~F.col("base_failed"))
    sizes = good.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("in_lang", F.sum("n").over(Window.partitionBy("lang")))
    level = F.when(F.col("n") >= least_rows, 2).when(F.col("in_lang") >= least_rows, 1).otherwise(0)
    chosen = F.when(level == 2, group_key(2)).when(level == 1, group_key(1)).otherwise(group_key(0))
    plan = stored(sizes.select(group_key(2).alias("group"), chosen.alias("key")))
    members = good.select(F.explode(F.array(*[group_key(k) for k in (0, 1, 2)])).alias("key"), *X)
    members = stored(members.join(plan.select("key").distinct(), "key", "left_semi"))
    fitted = estimates(members)
    grouped = rows.withColumn("group", F.when(~F.col("base_failed"), group_key(2))).join(plan, "group", "left")
    far = _with_distance(grouped, fitted, "left")
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d"), F.lit(0.0)) <= cut)
    return far.select(*keep, *STATS, "base_failed", F.col("d").alias("distance"), kept.alias("kept"))
