"""Porter suffix stripping in its extended mode as a column program (JVM side, no Python worker).

A word is followed by its mask, one letter a character: ``c`` for a consonant, ``v`` for a vowel (a ``y`` is a vowel
behind a consonant, so runs of them alternate). The measure of a stem is the number of ``vc`` in its mask, and all
conditions of the algorithm are patterns on the mask or the end of the word. Each step is one expression of the word
of the step before, bound once by a lambda variable. It runs on distinct terms (``operators.textops.stem_vocabulary``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: irregular forms of the extended algorithm (form -> stem) ----
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
# ---- fixed values: step tables of the published algorithm (suffix, replacement), in their order ----
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
         ("bli", "ble"), ("alli", "al"), ("fulli", "ful"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
         ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
         ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
         "ism", "ate", "iti", "ous", "ive", "ize"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mask(word: Column) -> Column:
    """One ``c`` or ``v`` for each character of ``word``."""
    marks = F.regexp_replace(F.regexp_replace(word, "(?s)[^aeiouy]", "c"), "[aeiou]", "v")

    def resolve(done: Column, m: Column) -> Column:
        return F.concat(done, F.when(m != "y", m).when(done.endswith("c"), F.lit("v")).otherwise(F.lit("c")))

    return F.when(marks.contains("y"), F.aggregate(F.split(marks, ""), F.lit(""), resolve)).otherwise(marks)


class Word:
    """A word and its mask as columns; ``stem(n)`` is what is left without the last n characters."""

    def __init__(self, text: Column, marks: Column) -> None:
        self.text, self.marks = text, marks

    def stem(self, n: int) -> Column:
        return F.left(self.text, F.length(self.text) - n)

    def stem_marks(self, n: int) -> Column:
        return F.left(self.marks, F.length(self.marks) - n)

    def measure(self, n: int = 0) -> Column:
        return F.regexp_count(self.stem_marks(n), F.lit("vc"))

    def has_vowel(self, n: int) -> Column:
        return self.stem_marks(n).contains("v")

    def ends(self, *suffixes: str) -> Column:
        out = self.text.endswith(suffixes[0])
        for s in suffixes[1:]:
            out = out | self.text.endswith(s)
        return out

    def double(self, n: int = 0) -> Column:
        """Ends in two equal characters, the last one a consonant."""
        return self.stem(n).rlike(r"(?s)(.)\1\z") & self.stem_marks(n).endswith("c")

    def short(self, n: int = 0) -> Column:
        """Consonant, vowel, consonant (not w, x, y) at the end; or the whole stem is a vowel and a consonant."""
        cvc = self.stem_marks(n).endswith("cvc") & ~self.stem(n).rlike(r"[wxy]\z")
        return cvc | (self.stem_marks(n) == "vc")


def step(word: Column, body: Callable[[Word], Column]) -> Column:
    """``body`` over the word and its mask, both computed once."""
    both = let(word, lambda w: F.struct(w.alias("w"), mask(w).alias("m")))
    return let(both, lambda b: body(Word(b["w"], b["m"])))


def _plural(w: Word) -> Column:
    return (F.when(w.ends("sses"), w.stem(2)).when(w.ends("ies"), F.when(F.length(w.text) == 4, w.stem(1)).otherwise(w.stem(2)))
            .when(w.ends("ss"), w.text).when(w.ends("s"), w.stem(1)).otherwise(w.text))


def _past(w: Word) -> Column:
    """(word, whether an ending that may need mending was cut)."""
    cut = lambda n: F.struct(w.stem(n).alias("w"), F.lit(True).alias("cut"))
    same = lambda c: F.struct(c.alias("w"), F.lit(False).alias("cut"))
    return (F.when(w.ends("ied"), same(F.when(F.length(w.text) == 4, w.stem(1)).otherwise(w.stem(2))))
            .when(w.ends("eed"), same(F.when(w.measure(3) > 0, w.stem(1)).otherwise(w.text)))
            .when(w.ends("ed") & w.has_vowel(2), cut(2)).when(w.ends("ing") & w.has_vowel(3), cut(3)).otherwise(same(w.text)))


def _mended(w: Word) -> Column:
    return (F.when(w.ends("at", "bl", "iz"), F.concat(w.text, F.lit("e")))
            .when(w.double() & ~w.ends("l", "s", "z"), w.stem(1))
            .when((w.measure() == 1) & w.short(), F.concat(w.text, F.lit("e"))).otherwise(w.text))


def _last_y(w: Word) -> Column:
    return F.when(w.ends("y") & (F.length(w.text) > 2) & w.stem_marks(1).endswith("c"), F.concat(w.stem(1), F.lit("i"))).otherwise(w.text)


def _table(w: Word, rules: list[tuple[str, str]]) -> Column:
    """The first suffix that matches decides; it is replaced if its stem has a measure over 0."""
    out = None
    for suffix, new in rules:
        n = len(suffix)
        value = F.when(w.measure(n) > 0, F.concat(w.stem(n), F.lit(new))).otherwise(w.text)
        out = F.when(w.ends(suffix), value) if out is None else out.when(w.ends(suffix), value)
    return out.otherwise(w.text)


def _step2(w: Word) -> Column:
    return F.when(w.ends("logi"), F.when(w.measure(3) > 0, w.stem(1)).otherwise(w.text)).otherwise(_table(w, STEP2))


def _step4(w: Word) -> Column:
    out = None
    for suffix in STEP4:
        n = len(suffix)
        long = w.measure(n) > 1
        if suffix == "ion":
            long = long & w.stem(n).rlike(r"[st]\z")
        value = F.when(long, w.stem(n)).otherwise(w.text)
        out = F.when(w.ends(suffix), value) if out is None else out.when(w.ends(suffix), value)
    return out.otherwise(w.text)


def _last_e(w: Word) -> Column:
    m = w.measure(1)
    return F.when(w.ends("e") & ((m > 1) | ((m == 1) & ~w.short(1))), w.stem(1)).otherwise(w.text)


def stem(term: Column) -> Column:
    """The stem of a word, lower-cased first; null stays null."""
    def regular(low: Column) -> Column:
        w = step(low, _plural)
        w = let(step(w, _past), lambda p: F.when(p["cut"], step(p["w"], _mended)).otherwise(p["w"]))
        w = step(w, _last_y)
        w = step(w, lambda x: F.when(x.ends("alli") & (x.measure(4) > 0), x.stem(2)).otherwise(x.text))
        w = step(w, _step2)
        w = step(w, lambda x: _table(x, STEP3))
        w = step(w, _step4)
        w = step(w, _last_e)
        return step(w, lambda x: F.when((x.measure() > 1) & x.double() & x.ends("l"), x.stem(1)).otherwise(x.text))

    def of(low: Column) -> Column:
        irregular = None
        for form, base in IRREGULAR.items():
            irregular = F.when(low == form, F.lit(base)) if irregular is None else irregular.when(low == form, F.lit(base))
        return irregular.when(F.length(low) <= 2, low).otherwise(regular(low))

    return F.when(term.isNotNull(), let(F.lower(term), of))
