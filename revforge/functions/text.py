"""Column expressions for review text. All are built-in Spark expressions (JVM side, codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import STOP_WORDS

# Anything outside printable ASCII (space .. tilde) is deleted, newlines and tabs included.
NON_PRINTABLE = r"[^\x20-\x7E]"
# A word: letters, marks and digits of any script; single inner hyphens, periods, apostrophes, slashes and
# underscores stay inside it ("well-known", "v3.5"), commas and colons only before a digit ("12,500").
WORD = r"[\p{L}\p{M}\p{N}]+(?:[-.'/_][\p{L}\p{M}\p{N}]+|[,:]\p{N}[\p{L}\p{M}\p{N}]*)*"
# Tokens: words, an ellipsis, a double hyphen, any other single character that is neither blank nor control.
TOKEN = WORD + r"|\.\.\.|--|[^\x00-\x20\x7F-\xA0\p{Z}\p{L}\p{M}\p{N}]"

# ---- fixed values: endings split off a word, and words split in two (word, length of the first part) ----
NEGATION = "n't"
CLITICS = ["'s", "'m", "'d", "'ll", "'re", "'ve"]
SPLIT_WORDS = [("cannot", 3), ("d'ye", 1), ("gimme", 3), ("gonna", 3), ("gotta", 3), ("lemme", 3),
               ("more'n", 4), ("wanna", 3)]


def clean_ascii(c: Column | str) -> Column:
    """Delete every character outside 0x20-0x7E; null stays null."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, NON_PRINTABLE, "")


def text_length(c: Column | str) -> Column:
    """Length in code points (null for null)."""
    return F.length(F.col(c) if isinstance(c, str) else c)


def _split_contraction(token: Column) -> Column:
    """The parts of one token, whatever its case: ("Do", "n't"), ("it", "'s"), ("can", "not"), or the token alone."""
    low = F.lower(token)

    def tail(n: int) -> Column:
        return F.array(F.left(token, F.length(token) - F.lit(n)), F.right(token, F.lit(n)))

    apostrophe = F.when(low.endswith(NEGATION) & (F.length(token) > F.lit(len(NEGATION))), tail(len(NEGATION)))
    for c in CLITICS:
        apostrophe = apostrophe.when(low.endswith(c) & (F.length(token) > F.lit(len(c))), tail(len(c)))
    whole = F.array(token)
    parts = F.when(low.isin([w for w, _ in SPLIT_WORDS]),
                   F.coalesce(*[F.when(low == w, tail(len(w) - n)) for w, n in SPLIT_WORDS]))
    return parts.when(token.contains("'"), apostrophe.otherwise(whole)).otherwise(whole)


def word_tokens(c: Column | str) -> Column:
    """Words and punctuation as separate tokens, contractions split (Treebank-like), of any script."""
    col = F.col(c) if isinstance(c, str) else c
    return F.flatten(F.transform(F.regexp_extract_all(col, F.lit(TOKEN), 0), _split_contraction))


def drop_stop_words(tokens: Column) -> Column:
    """Keep a token unless its lower-case form is a stop word; kept tokens keep their case.

    ``isin`` over the literal list is planned as a hash-set lookup (InSet), not a linear scan."""
    return F.filter(tokens, lambda t: ~F.lower(t).isin(STOP_WORDS))


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")
