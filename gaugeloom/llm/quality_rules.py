"""Quality rules by robust multivariate outliers.

Every document has a vector of transformed text statistics. For each (language, source) a minimum
covariance determinant estimate says what is usual there: concentration steps keep the share SUPPORT
of documents that are nearest by Mahalanobis distance, and estimate location and scatter again from
those, from several starts, of which the least determinant counts. Documents too far from their
group's estimate are rejected, and so are those that fail the base rules. Only DataFrame functions
are used; what meets in one place are sums by group and by rounded distance, however large a group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

SYMBOLS = "#*$%&|<>"
#: Characters that count as marks, and most characters of a short word.
MARKS, SHORT = r"[!-/:-@\[-`{-~]", 3
#: Share of a group that the estimate rests on, most concentration steps, least documents of a group.
SUPPORT, STEPS, LEAST = 0.75, 12, 100
#: Statistics of a vector, and the chi-square's median with as many degrees.
D, CHI2_MEDIAN = 4, 3.3567
#: Squared distance from which a document is rejected: the chi-square's quantile of 1 - 10^-8 with 4 degrees. Clean texts have
#: longer tails than a normal distribution, as short ones vary more: 99 % (13.28) would reject several per cent of them.
CUTOFF = 43.07
#: Added to variances, so that a scatter in which a statistic doesn't vary has an inverse.
RIDGE = 1e-9
#: Starts of the concentration steps, and steps after which the best start of a group goes on alone.
STARTS, FIRST_STEPS = 4, 2


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """row (the document's columns, if whole; else null), doc_id, lang, source, the counts that rules use, and further ones for the vector."""
    text = C.text_of(text_col)
    have = {c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")}
    d = docs.select((F.struct("*") if whole else F.lit(None).cast("boolean")).alias("row"), F.col(id_col).alias("doc_id"), have["lang"].alias("lang"), have["source"].alias("source"), text.alias("text"))
    d = d.withColumn("bare", F.btrim("text", F.lit(C.BLANKS)))
    d = d.withColumn("words", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", r"[\x20\x09-\x0D]+")))
    d = d.select(
        "row", "doc_id", "lang", "source", "text", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), F.size(F.filter("words", lambda w: F.length(w) <= SHORT)).cast("long").alias("n_short"),
    )
    # 64-bit hashes of three-word windows; two windows of one text agree by chance once in 10^11 texts of 20,000 words
    d = d.withColumn("grams", F.when(F.col("n_words") >= 3, F.slice(F.transform("hashes", lambda w, i: F.xxhash64(w, F.get("hashes", i + 1), F.get("hashes", i + 2))), 1, F.col("n_words").cast("int") - 2)).otherwise(F.array().cast("array<long>")))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.rtrim(x, F.lit(C.BLANKS)) != ""))
    bare = F.col("text")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    d = d.select(
        "row", "doc_id", "lang", "source", "n_words", "word_chars", "n_short",
        (F.length("text") - F.length(bare)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit(MARKS)).cast("long").alias("n_marks"),
        F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct"),
        "grams",
    )
    # sorted by hash, equal windows are neighbours; covered words are the union of their three places
    d = d.withColumn("sorted", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
    d = d.withColumn("found", F.filter("sorted", lambda x, j: same(x, F.get("sorted", j - 1)) | same(x, F.get("sorted", j + 1))))
    covered = F.size(F.array_distinct(F.flatten(F.transform("found", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return d.withColumn("n_repeat_words", F.when(F.col("found").isNull(), 0).otherwise(covered).cast("long")).drop("grams", "sorted", "found")


def vectors(stats: DataFrame) -> DataFrame:
    """stats with x0 .. x3: mean word length, marks a character, distinct words, short words, each transformed towards a normal shape."""
    words, chars = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars"))
    return stats.withColumns({
        "x0": F.log(chars / words),
        "x1": F.sqrt(F.col("n_marks") / chars),
        "x2": F.log(F.greatest(F.col("n_distinct"), F.lit(1)).cast("double")) / F.log(words + 1),
        "x3": F.asin(F.sqrt(F.col("n_short") / words)),
    })


CELLS = [(i, j) for i in range(D) for j in range(i + 1)]
ESTIMATE = [f"m{i}" for i in range(D)] + [f"l{i}{j}" for i, j in CELLS] + ["det"]


def _distance(rows: DataFrame) -> DataFrame:
    """rows (x, m, l: lower triangle of the scatter's Cholesky factor) with d2, by forward substitution."""
    for i in range(D):
        y: Column = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(D)), F.lit(0.0))).drop(*[f"y{i}" for i in range(D)])


def _factor(groups: DataFrame) -> DataFrame:
    """groups (m, s: covariance) with the Cholesky factor l of the scatter, the ridge added, and det, its diagonal's product."""
    for i, j in CELLS:
        v = F.col(f"s{i}{j}") + RIDGE if i == j else F.col(f"s{i}{j}")
        for k in range(j):
            v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        groups = groups.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(RIDGE))) if i == j else v / F.col(f"l{j}{j}"))
    det = F.lit(1.0)
    for i in range(D):
        det = det * F.col(f"l{i}{i}")
    return groups.withColumn("det", det)


def _starts(rows: DataFrame, small: bool) -> DataFrame:
    """Four first estimates of each key: medians, with scatters of clipped, of squashed and of projected deviations, and the plain diagonal.

    The first three are moments of the rows that no far-off row can dominate; the fourth knows no correlation.
    """
    quartiles = F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75)])
    med = rows.groupBy("key").agg(*[F.percentile_approx(f"x{i}", quartiles, 1000).alias(f"q{i}") for i in range(D)])
    med = C.stored(med.select("key", *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(D)], *[((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) * 0.7413 + 1e-6).alias(f"r{i}") for i in range(D)]), "mcd-medians")
    z = C.join_groups(rows, med, "key", small=small).select("key", *[((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"r{i}")).alias(f"z{i}") for i in range(D)])
    norm = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(D)), F.lit(1e-12)))
    shapes = {
        "a": lambda i: F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col(f"z{i}"))),
        "b": lambda i: F.tanh(f"z{i}"),
        "c": lambda i: F.col(f"z{i}") / norm * D**0.5,
    }
    moments = z.groupBy("key").agg(*[F.avg(of(i) * of(j)).alias(f"{n}{i}{j}") for n, of in shapes.items() for i, j in CELLS])
    starts = F.array(*[
        F.struct(F.lit(k).alias("start"), *[((F.col(f"{n}{i}{j}") if n else F.lit(float(i == j))) * F.col(f"r{i}") * F.col(f"r{j}")).alias(f"s{i}{j}") for i, j in CELLS])
        for k, n in enumerate([*shapes, None])
    ])
    spread = moments.join(med, "key").select("key", *[f"m{i}" for i in range(D)], F.explode(starts).alias("s")).select("key", *[f"m{i}" for i in range(D)], "s.*")
    # a start is no estimate from a share of the rows: its determinant doesn't count
    return C.stored(_factor(spread).withColumn("det", F.lit(float("inf"))).select("key", "start", *ESTIMATE), "mcd-starts")


def _binned(rows: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """Sums of the rows about their estimate's location, by key, start and rounded distance (steps of 5 %)."""
    near = _distance(C.join_groups(rows, groups, "key", small=small)).withColumn("bin", F.floor(F.log(F.col("d2") + 0.001) * 20).cast("int"))
    c = {i: F.col(f"x{i}") - F.col(f"m{i}") for i in range(D)}
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(c[i]).alias(f"t{i}") for i in range(D)], *[F.sum(c[i] * c[j]).alias(f"t{i}{j}") for i, j in CELLS]]
    return near.groupBy("key", "start", "bin").agg(*sums)


def _below(bins: DataFrame) -> DataFrame:
    """bins with the number of rows in nearer bins, and in all."""
    own = Window.partitionBy("key", "start")
    return bins.withColumns({"below": F.coalesce(F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("n").over(own)})


def _step(rows: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """One concentration step: estimates from the nearest SUPPORT of each key's rows, with old_det, the determinant before."""
    kept = _below(_binned(rows, groups, small)).where(F.col("below") < F.col("all") * SUPPORT)
    total = kept.groupBy("key", "start").agg(F.sum("n").alias("n"), *[F.sum(f"t{i}").alias(f"t{i}") for i in range(D)], *[F.sum(f"t{i}{j}").alias(f"t{i}{j}") for i, j in CELLS])
    total = total.join(groups.select("key", "start", *[F.col(f"m{i}").alias(f"o{i}") for i in range(D)], F.col("det").alias("old_det")), ["key", "start"])
    new = {f"m{i}": F.col(f"o{i}") + F.col(f"t{i}") / F.col("n") for i in range(D)}
    new |= {f"s{i}{j}": F.col(f"t{i}{j}") / F.col("n") - F.col(f"t{i}") * F.col(f"t{j}") / (F.col("n") * F.col("n")) for i, j in CELLS}
    return C.stored(_factor(total.withColumns(new)).select("key", "start", *ESTIMATE, "old_det"), "mcd-step")


def mcd(rows: DataFrame, small: bool) -> DataFrame:
    """Location, Cholesky factor and scale of each key's rows (key, x0 .. x3), a row a key, and n, the rows.

    From several starts, each concentration step takes the nearest SUPPORT of a group and estimates
    location and scatter again from those. After FIRST_STEPS the start of the least determinant goes on,
    until no group's determinant falls any more (STEPS at most): a group keeps the least it has had.
    small: the keys are few enough to be broadcast.
    """
    groups = _starts(rows, small)
    for _ in range(FIRST_STEPS):
        groups = _step(rows, groups, small).drop("old_det")
    first = Window.partitionBy("key").orderBy("det", "start")
    groups = C.stored(groups.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth"), "mcd-best")
    for _ in range(STEPS - FIRST_STEPS):
        moved = _step(rows, groups, small)
        falls = F.col("det") < F.col("old_det") * (1 - 1e-6)
        if moved.where(falls).isEmpty():
            break
        moved = moved.where(falls).drop("old_det")
        groups = C.stored(groups.join(moved.select("key"), "key", "left_anti").unionByName(moved), "mcd-groups")
    # the estimate is of the group's inner part: distances are scaled so that their median is the chi-square's
    half = _below(_binned(rows, groups, small)).where(F.col("below") < F.col("all") * 0.5).groupBy("key").agg(F.max("bin").alias("bin"), F.max("all").alias("n"))
    median = F.greatest(F.exp((F.col("bin") + 0.5) / 20) - 0.001, F.lit(1e-6))
    return C.stored(groups.drop("det", "start").join(half.select("key", (median / CHI2_MEDIAN).alias("scale"), "n"), "key"), "mcd-estimates")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """statistics of docs with base_failed, distance and kept."""
    stats = vectors(C.stored(statistics(docs, id_col, text_col, whole), "rules-statistics"))
    stats = stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    stats = stats.withColumns({"own": F.concat_ws("\x00", name("lang"), name("source")), "wide": name("lang")})
    # a source that is small in its language goes to the language's pool, a pool that is small to the table's
    sizes = C.stored(stats.where("not base_failed").groupBy("own", "wide").agg(F.count(F.lit(1)).alias("n")), "rules-sizes")
    pool = Window.partitionBy("wide", F.col("n") >= LEAST)
    keys = sizes.withColumn("pooled", F.sum("n").over(pool))
    key = F.when(F.col("n") >= LEAST, F.concat(F.lit("2"), "own")).when(F.col("pooled") >= LEAST, F.concat(F.lit("1"), "wide")).otherwise(F.lit("0"))
    keys = C.stored(keys.select("own", key.alias("key")), "rules-keys")
    small = C.is_small(keys, C.FEW_ROWS // STARTS)
    rows = C.stored(C.join_groups(stats.where("not base_failed"), keys, "own", small=small).select("key", *[f"x{i}" for i in range(D)]), "rules-vectors")
    estimates = mcd(rows, small)
    chosen = C.stored(keys.join(estimates, "key", "left").drop("key"), "rules-chosen")
    out = _distance(C.join_groups(stats, chosen, "own", "left", small))
    distance = F.when(~F.col("base_failed") & (F.col("n") > 2 * D), F.col("d2") / F.col("scale"))
    out = out.withColumn("distance", distance)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    Null and empty texts have no words and fail the base rules. Null languages and sources are values
    of their own; tables without these columns are one group. Of the documents that pass the base
    rules, those of a source with fewer than LEAST in its language are estimated together with the
    language's other small sources, and those of small languages together. A group of 2 * D documents
    or fewer has no estimate; the base rules alone judge it, and its distances are null. Rows are
    judged each by itself, so repeated rows get the same verdict (estimates count each). An empty
    table gives an empty result; other columns are ignored.
    """
    return judged(docs, id_col, text_col).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that quality_rules keeps, with all their columns. Their texts are never shuffled."""
    return judged(docs, id_col, text_col, whole=True).where("kept").select("row.*")
