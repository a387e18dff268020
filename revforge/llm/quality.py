"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Fixed cutoffs judge every language and source alike; here each (language, source) group gets its own.
A sketch is a table (lang, source, metric, bin, rows): the count of documents per integer value 0..1000 of a
metric. Counts add up, so sketches of days, tables or map tasks merge by one grouped sum, and a group's
quantiles are exact to one bin. From the quartiles comes an upper fence ``q75 + SPREAD * (q75 - q25)``,
never under the metric's tolerance (what no group calls abnormal). Groups with under ``FEW`` documents
use the merged sketch of their language, and if that is small too, of all documents. The limits (one row
per group) are joined to the documents; a document over any limit, or failing the base rules, goes.

Defined results: null or blank text has no words and fails the base rules; null lang or source is a
group value of its own; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, text_of, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
SPREAD = 4
FEW = 100
# metric -> tolerance: values up to it are normal in every group (per thousand; letters of a word times ten)
TOLERANCE = {"symbols": 50, "upper": 200, "dup_lines": 400, "repeats": 250, "word_length": 150}
_SYMBOLS = r"[#*$%&|<>]"


def repeated_words(words: Column) -> Column:
    """Number of words inside 8-word windows that occur twice or more in the text (all occurrences)."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))

    def covered(at: Column) -> Column:
        steps = F.aggregate(F.sequence(F.lit(1), F.size(at) - 1), F.lit(0),
                            lambda acc, i: acc + F.least(F.lit(WINDOW), F.get(at, i) - F.get(at, i - 1)))
        return F.when(F.size(at) > 1, steps).otherwise(F.lit(0)) + F.lit(WINDOW)

    def spread(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i + 1) | ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))))
            return let(F.array_sort(F.transform(hit, lambda i: F.get(s, i)["i"])), covered)

        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, twice)).otherwise(F.lit(0))

    return F.when(n > WINDOW, let(hashes, spread)).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """Struct of the base counts and the metrics (integers) of one text; one pass, row-local."""
    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"),
                                          (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper")), _with_metrics)

    return let(words_of(text), of)


def _with_metrics(m: Column) -> Column:
    def rate(a: Column, b: Column, per: int) -> Column:
        return F.least(F.lit(1000), F.floor(a * F.lit(per) / F.greatest(b, F.lit(1)))).cast("int")

    return F.struct(m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
                    m["lines"]["dup"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"),
                    rate(m["n_symbols"], m["n_words"], 1000).alias("symbols"),
                    rate(m["n_upper"], m["word_chars"], 1000).alias("upper"),
                    rate(m["lines"]["dup"], m["lines"]["all"], 1000).alias("dup_lines"),
                    rate(m["n_repeat_words"], m["n_words"], 1000).alias("repeats"),
                    rate(m["word_chars"], m["n_words"], 10).alias("word_length"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bin, rows) of rows with lang, source and the metrics as columns."""
    bins = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("bin")) for m in TOLERANCE]))
    pairs = measured.select("lang", "source", bins.alias("_b"))
    return pairs.groupBy("lang", "source", F.col("_b.metric").alias("metric"), F.col("_b.bin").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def merge(*sketches: DataFrame) -> DataFrame:
    """One sketch of several: their counts added."""
    every = sketches[0]
    for s in sketches[1:]:
        every = every.unionByName(s)
    return every.groupBy("lang", "source", "metric", "bin").agg(F.sum("rows").alias("rows"))


def quartiles(sk: DataFrame, by: list[str]) -> DataFrame:
    """q25, q75 and the number of rows per group and metric: the smallest bin reaching that share of rows.
    A group's window holds at most 1,001 bins."""
    bins = sk.groupBy(*by, "metric", "bin").agg(F.sum("rows").alias("rows"))
    group = Window.partitionBy(*by, "metric")
    run = F.sum("rows").over(group.orderBy("bin"))
    total = F.sum("rows").over(group)
    at = bins.select(*by, "metric", "bin", run.alias("_run"), total.alias("_n"))
    least = lambda pct: F.min(F.when(F.col("_run") * 100 >= F.col("_n") * pct, F.col("bin")))
    return at.groupBy(*by, "metric").agg(F.max("_n").alias("n"), least(25).alias("q25"), least(75).alias("q75"))


def limits(sk: DataFrame) -> DataFrame:
    """(lang, source, one limit per metric): one row per group that occurs."""
    tolerance = F.create_map(*[F.lit(x) for kv in TOLERANCE.items() for x in kv])

    def fences(by: list[str]) -> DataFrame:
        q = quartiles(sk, by)
        fence = F.greatest(tolerance[F.col("metric")], F.col("q75") + F.lit(SPREAD) * (F.col("q75") - F.col("q25")))
        return q.select(*by, "metric", "n", fence.alias("fence"))

    own = fences(["lang", "source"])
    lang = fences(["lang"]).select(F.col("lang").alias("_l"), F.col("metric").alias("_lm"), F.col("n").alias("_ln"), F.col("fence").alias("_lf"))
    every = fences([]).select(F.col("metric").alias("_am"), F.col("fence").alias("_af"))
    own = own.join(lang, own["lang"].eqNullSafe(lang["_l"]) & (own["metric"] == lang["_lm"])).join(every, own["metric"] == every["_am"])
    use = F.when(F.col("n") >= FEW, F.col("fence")).when(F.col("_ln") >= FEW, F.col("_lf")).otherwise(F.col("_af"))
    own = own.select("lang", "source", "metric", use.alias("use"))
    return own.groupBy(F.col("lang").alias("_ql"), F.col("source").alias("_qs")).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("use"))).alias(f"_limit_{m}") for m in TOLERANCE])


def judged(measured: DataFrame, limit: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept, by the joined limits of its group."""
    on = measured["lang"].eqNullSafe(limit["_ql"]) & measured["source"].eqNullSafe(limit["_qs"])
    over = F.lit(False)
    for m in TOLERANCE:
        over = over | (F.col(m) > F.col(f"_limit_{m}"))
    return (measured.join(limit, on).withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & ~over)
            .drop("_ql", "_qs", *[f"_limit_{m}" for m in TOLERANCE]))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts and metrics) of every row."""
    return docs.select("doc_id", "lang", "source", measures(text_of()).alias("_m")).select("doc_id", "lang", "source", "_m.*")


def quality(docs: DataFrame) -> DataFrame:
    """Every row's counts, base_failed and kept. Texts are read once; the counts are a small written table."""
    rows = materialize(measured(docs))
    limit = materialize(limits(sketch(rows)))
    return judged(rows, limit)


def quality_digest(docs: DataFrame) -> DataFrame:
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that the rules keep. The limits come from one pass over the texts;
    a second pass judges each row where it is, so no text is shuffled and no id needs to be unique."""
    limit = materialize(limits(sketch(measured(docs))))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("lang").alias("lang"),
                       F.col("source").alias("source"), measures(text_of()).alias("_m")).select("_row", "lang", "source", "_m.*")
    return judged(rows, limit).where("kept").select("_row.*")
