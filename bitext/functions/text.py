"""Text column expressions (Column -> Column), all built-in Spark functions.

Every function here is a stateless expression, so it runs inside the scan
stage (no shuffle) and also accepts a streaming DataFrame unchanged.
Regexes use Java syntax; the whitespace class is pinned to ASCII so the
DuckDB oracle (RE2) sees the same characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's cleaning rules and markers).
WS = r"[ \t\n\x0B\f\r]"          # ASCII whitespace, as one character class
NON_WS_RUN = r"[^ \t\n\x0B\f\r]+"  # one word = maximal non-whitespace run
PAUSE_MARK = r"\(pause \d+\.\d+\)"
COMMA_RUN = r",\s*,+"
REPEAT_PUNCT = r"([.!?])\1+"
SPACE_RUN = r"\s{2,}|[\t\n\x0B\f\r]"  # a lone space is one already: no match to replace per word
PUNCT_THEN_NONSPACE = r"([.,!?])(?=[^\s])"  # a search for the mark, not a look around at every place
START_MARK = "[start]"
END_MARK = "[end]"
ANGLE_START = "<start>"
ANGLE_END = "<end>"
# ASCII punctuation removed by the word standardiser (the default strip set of
# the Keras TextVectorization layer): !"#$%&'()*+,-./:;<=>?@[\]^_`{|}~
ASCII_PUNCT_CLASS = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---- STR1..STR6: cleaning steps, in the reference's order -----------------

def remove_pause(col) -> Column:
    """STR1: drop timed pause marks such as ``(pause 1.23)``."""
    return F.regexp_replace(_c(col), PAUSE_MARK, "")


def squeeze_commas(col) -> Column:
    """STR2: ``, ,,`` -> ``,`` (one left-to-right pass)."""
    return F.regexp_replace(_c(col), COMMA_RUN, ",")


def squeeze_repeat_punct(col) -> Column:
    """STR3: ``..`` / ``!!`` / ``??`` runs -> one mark."""
    return F.regexp_replace(_c(col), REPEAT_PUNCT, "$1")


def collapse_space(col) -> Column:
    """STR4: whitespace runs -> one space, then trim."""
    return F.trim(F.regexp_replace(_c(col), SPACE_RUN, " "))


def space_after_punct(col) -> Column:
    """STR5: insert a space after . , ! ? when a non-space follows."""
    return F.regexp_replace(_c(col), PUNCT_THEN_NONSPACE, "$1 ")


def rejoin_words(col) -> Column:
    """STR6: split on whitespace and join with one space."""
    return F.array_join(words(col), " ")


def clean_text(col) -> Column:
    """STR7: the full cleaning chain STR1 -> STR6.

    STR6 (split on whitespace, join with one space) is the identity here:
    after STR4 the text is single-spaced and trimmed, and STR5 only inserts a
    space in front of a non-space character, so it never creates a double,
    leading or trailing space.  The chain therefore stops after STR5
    (``tests/test_clean.py`` checks the equality on the real tables)."""
    c = _c(col)
    squeezed = collapse_space(squeeze_repeat_punct(squeeze_commas(remove_pause(c))))
    return space_after_punct(F.when(_to_squeeze(c), squeezed).otherwise(F.trim(c)))


def _to_squeeze(c: Column) -> Column:
    """Whether STR1 to STR4 may change more than the ends of a text: each of their matches
    holds one of these, and a search for bytes is cheaper than their patterns on every text."""
    found = F.lit(False)
    for part in ("(pause ", ",,", ", ,", "..", "!!", "??", "  ", *"\t\n\x0B\f\r"):
        found = found | F.contains(c, F.lit(part))
    return found


# ---- tokens and measures ----------------------------------------------------

def words(col) -> Column:
    """STR12: maximal non-whitespace runs; '' -> [] (never [''])."""
    return F.regexp_extract_all(_c(col), F.lit(NON_WS_RUN), 0)


def clean_words(col) -> Column:
    """STR12 of a text that ``clean_text`` made: its words stand one space apart, so no
    pattern looks for them."""
    c = _c(col)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def word_count(col) -> Column:
    """STR13: number of words, as BIGINT; null stays null."""
    return F.regexp_count(_c(col), F.lit(NON_WS_RUN)).cast("long")


def word_ratio(tgt_words, src_words) -> Column:
    """STR14: tgt words / (src words + 1e-9)."""
    return _c(tgt_words).cast("double") / (_c(src_words).cast("double") + F.lit(1e-9))


# ---- case, markers ----------------------------------------------------------

def lower(col) -> Column:
    """STR8."""
    return F.lower(_c(col))


def wrap_markers(col, start: str = START_MARK, end: str = END_MARK) -> Column:
    """STR9: ``start text end`` joined by single spaces."""
    return F.concat_ws(" ", F.lit(start), _c(col), F.lit(end))


def unwrap_markers(col, start: str = START_MARK, end: str = END_MARK) -> Column:
    """STR10: remove ``start `` prefix and `` end`` suffix when both present."""
    c = _c(col)
    pre, suf = len(start) + 1, len(end) + 1
    body = c.substr(F.lit(pre + 1), F.length(c) - F.lit(pre + suf))
    guarded = F.startswith(c, F.lit(start + " ")) & F.endswith(c, F.lit(" " + end)) & (
        F.length(c) >= F.lit(pre + suf)
    )
    return F.when(guarded, body).otherwise(c)


def cut_at_marker(col, marker: str = END_MARK) -> Column:
    """STR11: text before the first marker, trimmed."""
    return F.trim(F.substring_index(_c(col), marker, 1))


def standardize_words(col, protect=(START_MARK, END_MARK)) -> Column:
    """STR16: lower-case and strip ASCII punctuation, keeping the markers
    whole (so ``[start]`` stays a token instead of turning into ``start``)."""
    # one regex pass over the row: a whole-word marker is matched first and
    # written back ($1); any other punctuation character matches the second
    # alternative, where group 1 is unset and the replacement is empty
    alts = "|".join(_regex_quote(p) for p in protect)
    marker = rf"(?<![^ \t\n\x0B\f\r])({alts})(?![^ \t\n\x0B\f\r])"
    stripped = F.regexp_replace(F.lower(_c(col)), rf"{marker}|{ASCII_PUNCT_CLASS}", "$1")
    return words(stripped)


# Unicode classes that Java and RE2 both know: word characters and white space.
WORD_CLASS = r"\p{L}\p{N}\p{M}_"
SPACE_CLASS = r"\t-\r\x{85}\p{Z}"


def pretokenize(col, protect=(START_MARK, END_MARK)) -> Column:
    """STR17: word runs (letters, digits and marks of any script) and runs of
    other visible characters; markers kept whole."""
    alts = "|".join(_regex_quote(p) for p in protect)
    return F.regexp_extract_all(_c(col), F.lit(rf"{alts}|[{WORD_CLASS}]+|[^{WORD_CLASS}{SPACE_CLASS}]+"), 0)


def _regex_quote(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in s)


def array_to_text(col, sep: str = " ") -> Column:
    """Render an array as one string (ids or words)."""
    return F.array_join(F.transform(_c(col), lambda x: x.cast("string")), sep)
