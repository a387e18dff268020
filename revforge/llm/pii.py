"""Personal data by candidate gradient boosting, in column expressions only.

High-recall generators propose overlapping spans: the four base patterns, and looser ones (blanks around
``@`` and dots, octets over 255, digit runs of card length that fail the checksum, phone numbers without
``+``). Each candidate has a few small integer features of its format (digits, groups, separators, length, a
validity check of its kind) and context (neighbouring characters, words before it), packed into one code.

Base spans always stay; boosted trees decide about the rest. They are trained on the candidates that are not base
themselves, weighted by how often a code occurs. Positive is, first, a loose generator's view of a confirmed span (it
overlaps a base span of its kind, whose mark is hidden from the features), so the trees learn what personal data looks
like around its base form; and second, evidence that no base pattern sees: a word of the kind before the span (call, mail,
card) where the validity check holds (digit groups that can be dialled, a checksum, a top-level name). The thresholds are
calibrated on what they decide about: of the candidates without any base overlap, on documents kept from training, the share with
evidence among those scored no lower must be at least ``PRECISION``, per kind, with ``LEAST_SEEN`` of them at least.
So a number shaped like a phone number is no span where most of its like have no evidence. An accepted span is added if it
overlaps no base span and no earlier added one of its kind.

The feature space is fixed, so the table of codes and the accepted list are of bounded size whatever the
input. Texts are read once; candidates are a small written table. Possessive patterns keep every match linear in the text.

Defined results: null or empty text has no spans; offsets are code points, end exclusive; rows repeating
an id are handled each; with candidates of one class only, no span is added; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, text_of

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
LEAST_SEEN = 20
TREES, DEPTH = 12, 4
_CHUNK = 512
_LOCAL = "[A-Za-z0-9._%+-]"
_START = r"(?:(?<!" + _LOCAL + r")|\G)"  # a run that fails from its start fails from inside too
# (kind, pattern, what a text must hold); same matches as the base patterns, without backtracking
GENERATORS = (
    ("email", _START + _LOCAL + r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    ("email", _START + _LOCAL + r"++\x20?@\x20?[A-Za-z0-9-]++(?:\x20?\.\x20?[A-Za-z0-9-]++)++", "@"),
    ("phone", r"\(?(?<![0-9])[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", None),
)
_FEATURES = (("generator", 6), ("digits", 21), ("groups", 7), ("separator", 4), ("left", 5), ("right", 5), ("word", 2), ("valid", 2), ("length", 16))
_WORDS = {"email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|credit|konto|pay",
          "phone": "phone|tel|call|fax|mobil"}


def running(lengths: Column) -> Column:
    """Sum of the elements before each element; in chunks, so that long arrays stay near linear."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")),
                         lambda c: F.slice(lengths, c * _CHUNK + 1, F.lit(_CHUNK)))

    def sums(a: Column, start: Column) -> Column:
        zero = F.struct(start.cast("long").alias("s"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(a, zero, lambda t, x: F.struct((t["s"] + x).alias("s"), F.concat(t["out"], F.array(t["s"])).alias("out")),
                           lambda t: t["out"])

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x))
        return let(sums(totals, F.lit(0)), lambda base: F.flatten(F.transform(parts, lambda p, i: sums(p, F.get(base, i)))))

    return F.when(F.size(lengths) > 0, let(chunks, joined)).otherwise(F.expr("cast(array() as array<bigint>)"))


def _side(c: Column) -> Column:
    return (F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike("^[0-9]$"), 2).when(c.rlike(r"^[\"'=:]$"), 3)
            .when(c.rlike(r"^\p{L}$"), 1).otherwise(4))


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = (F.length(digits) - i) % 2 == 1
        return total + F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _base_check(kind: str, value: Column, digits: Column) -> Column:
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _valid(kind: str, value: Column, digits: Column) -> Column:
    """What the format alone says about a loose span of the kind."""
    if kind == "email":
        return F.replace(value, F.lit(" ")).rlike(r"\.[A-Za-z]{2,6}\z")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return digits.rlike(r"\A[2-9][0-9]{2}[2-9][0-9]{6}\z")
    return _base_check(kind, value, digits)


def _generated(text: Column, no: int, kind: str, pattern: str, holds: str | None) -> Column:
    """Array of candidates of one generator: kind number, start, end, base, sure, code."""
    base_generator = no < len(KINDS)

    def build(m: Column) -> Column:
        def zipped(gaps: Column) -> Column:
            steps = F.transform(m, lambda x, i: (F.length(x) + F.length(F.get(gaps, i))).cast("long"))
            return let(running(steps), lambda before: F.transform(m, lambda x, i: one(x, F.get(gaps, i), F.get(gaps, i + 1), F.get(before, i))))

        return F.when(F.size(m) > 0, let(F.split(text, pattern, -1), zipped)).otherwise(F.expr(f"cast(array() as {CANDIDATES})"))

    def one(x: Column, gap: Column, after: Column, before: Column) -> Column:
        return let(F.regexp_replace(x, "[^0-9]", ""), lambda digits: candidate(x, gap, after, before, digits))

    def candidate(x: Column, gap: Column, after: Column, before: Column, digits: Column) -> Column:
        start = before + F.length(gap)
        base = _base_check(kind, x, digits) if base_generator else F.lit(False)
        valid = _valid(kind, x, digits)
        word = F.when(F.lower(F.right(gap, F.lit(24))).rlike(_WORDS[kind]), 1).otherwise(0)
        sep = (F.when(x.rlike(r"\x20") & x.rlike(r"[.-]"), 3).when(x.rlike(r"\x20"), 1).when(x.rlike(r"[.-]"), 2).otherwise(0))
        values = {"generator": F.lit(no), "digits": F.least(F.length(digits), F.lit(20)),
                  "groups": F.least(F.regexp_count(x, F.lit("[0-9]+")), F.lit(6)), "separator": sep,
                  "left": _side(F.right(gap, F.lit(1))), "right": _side(F.left(after, F.lit(1))), "word": word, "valid": F.when(valid, 1).otherwise(0),
                  "length": F.least(F.length(x) / 4, F.lit(15))}
        code = F.lit(0).cast("long")
        for name, size in _FEATURES:
            code = code * size + values[name].cast("long")
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.cast("long").alias("start"),
                        (start + F.length(x)).cast("long").alias("end"), base.alias("base"), ((word == 1) & valid).alias("sure"), code.alias("code"))

    found = let(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), build)
    if kind == "card":  # shorter runs are no candidates at all
        found = F.filter(found, lambda c: c["end"] - c["start"] >= 13)
    if holds:
        found = F.when(F.contains(text, F.lit(holds)), found).otherwise(F.expr(f"cast(array() as {CANDIDATES})"))
    return found


CANDIDATES = "array<struct<kind:int,start:bigint,end:bigint,base:boolean,sure:boolean,code:bigint>>"


def candidates(text: Column) -> Column:
    """All candidates of a text, by generator, then start."""
    return F.flatten(F.array(*[_generated(text, i, *g) for i, g in enumerate(GENERATORS)]))


def confirmed(found: Column) -> Column:
    """Array of booleans: the candidate is base or overlaps a base span of its kind."""
    base = F.filter(found, lambda c: c["base"])
    return let(base, lambda b: F.transform(found, lambda c: F.exists(
        b, lambda x: (x["kind"] == c["kind"]) & (x["start"] < c["end"]) & (c["start"] < x["end"]))))


def _features() -> list[Column]:
    """The features of a code column, unpacked."""
    out, rest = [], F.col("code")
    for name, size in reversed(_FEATURES):
        out.append(F.pmod(rest, F.lit(size)).cast("double").alias(name))
        rest = F.floor(rest / size)
    return out[::-1]


def accepted_codes(found: DataFrame) -> list[int]:
    """Codes of non-base candidates whose calibrated precision is high enough. ``found``: doc_id, found.

    Everything is trained and calibrated on one row per (code, part, label); the result is at most the feature space.
    """
    each = found.where(F.size("found") > 0).select(
        (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("train"),
        F.explode(F.arrays_zip(F.col("found"), confirmed(F.col("found")).alias("met"))).alias("c")).where(~F.col("c.found.base"))
    codes = materialize(each.groupBy("train", F.col("c.found.code").alias("code"), F.col("c.found.kind").alias("kind"), F.col("c.met").alias("met"),
                                     (F.col("c.met") | F.col("c.found.sure")).alias("yes")).agg(F.count(F.lit(1)).cast("double").alias("n"))
                        .coalesce(1).sortWithinPartitions("code", "train", "met", "yes"))
    classes = codes.where("train").agg(F.min(F.col("yes").cast("int")).alias("lo"), F.max(F.col("yes").cast("int")).alias("hi")).first()
    if classes["lo"] is None or classes["lo"] == classes["hi"]:
        return []
    names = [n for n, _ in _FEATURES]
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(
        codes.select("train", "code", "kind", "met", F.col("yes").cast("double").alias("label"), "n", *_features()))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, weightCol="n").fit(vectors.where("train"))
    scored = model.transform(vectors).select("train", "code", "kind", "met", "label", "n", F.round(vector_to_array("probability")[1], 9).alias("p"))
    scored = scored.where(~F.col("met"))  # what touches a base span is never added, so it says nothing about the cut
    by_score = scored.where(~F.col("train")).groupBy("kind", "p").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("yes"))
    down = Window.partitionBy("kind").orderBy(F.desc("p"))
    cut = by_score.withColumn("share", F.sum("yes").over(down) / F.sum("n").over(down)).withColumn("seen", F.sum("n").over(down))
    cut = cut.where((F.col("share") >= PRECISION) & (F.col("seen") >= LEAST_SEEN)).groupBy("kind").agg(F.min("p").alias("cut"))
    good = scored.join(cut, "kind").where(F.col("p") >= F.col("cut")).select("code").distinct()
    return sorted(r["code"] for r in good.collect())


def chosen(found: Column, codes: list[int]) -> Column:
    """Base spans and accepted ones, by kind, then start."""
    def pick(base: Column) -> Column:
        def free(c: Column) -> Column:
            return ~F.exists(base, lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"]))

        if not codes:
            return base
        extra = F.array_sort(F.filter(found, lambda c: ~c["base"] & c["code"].isin(codes) & free(c)))
        # left to right within a kind, what overlaps the span before goes
        zero = F.struct(F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("end"), F.expr(f"cast(array() as {CANDIDATES})").alias("out"))
        keep = F.aggregate(extra, zero, lambda t, c: F.when(
            (c["kind"] == t["kind"]) & (c["start"] < t["end"]), t).otherwise(
            F.struct(c["kind"].alias("kind"), c["end"].alias("end"), F.concat(t["out"], F.array(c)).alias("out"))), lambda t: t["out"])
        return F.array_sort(F.concat(base, keep))

    return let(F.array_sort(F.filter(found, lambda c: c["base"])), pick)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id and the array of chosen spans (kind number, start, end, base, sure, code) of every row."""
    found = materialize(docs.select("doc_id", candidates(text_of()).alias("found")))
    codes = accepted_codes(found)
    return found.select("doc_id", chosen(F.col("found"), codes).alias("spans"))


def _written(s: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(s, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda c: c["base"])

    def count(no: int) -> Column:
        return F.size(F.filter("spans", lambda c: c["base"] & (c["kind"] == no))).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return spans(docs).select("doc_id", *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """The text with every span (overlapping ones of several kinds as one) replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def rebuild(s: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
        step: Callable[[Column, Column], Column] = lambda t, c: F.when(c["start"] < t["at"], F.struct(
            F.greatest(t["at"], c["end"]).alias("at"), t["out"].alias("out"))).otherwise(F.struct(
                c["end"].alias("at"), F.concat(t["out"], F.array(F.substr(text, (t["at"] + 1).cast("int"), (c["start"] - t["at"]).cast("int")),
                                                                 F.get(names, c["kind"]))).alias("out")))
        return F.aggregate(s, zero, step, lambda t: F.concat(F.array_join(t["out"], ""), F.substr(text, (t["at"] + 1).cast("int"), F.length(text))))

    by_start = F.array_sort(F.transform(found, lambda c: F.struct(c["start"], c["end"], c["kind"])))
    return F.when(F.size(found) > 0, let(by_start, rebuild)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with personal data in ``text`` replaced; a null text stays null. The codes are learned
    in one pass over the texts; a second pass finds and replaces row by row, so no text is shuffled."""
    codes = accepted_codes(materialize(docs.select("doc_id", candidates(text_of()).alias("found"))))
    new = let(chosen(candidates(text_of()), codes), lambda s: redacted(F.col("text"), s))
    return docs.select([F.when(F.col("text").isNotNull(), new).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
