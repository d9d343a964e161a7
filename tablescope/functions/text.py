"""Rule-based clean-up of spoken-text transcripts, as one Column expression.

The steps run in this order, each over the whole text:

1. delete every filler word or phrase below as a whole word, any case
   (one regular-expression pass, see ``FILLER_PATTERN``);
2. collapse runs of white space to one blank and trim;
3. drop white space before a comma, merge ``,<space>*,`` into one comma (a
   single left-to-right pass, so ``, , ,`` becomes ``,,``), drop a leading
   comma;
4. upper-case the first character;
5. if nothing is left, return the original text.

Everything is ``regexp_replace`` / ``upper`` / ``substring`` inside the JVM;
no Python runs per row.  White space follows Unicode (``(?U)``), with the
separators U+001C..U+001F added.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the filler words and phrases removed, in the order they are applied
FILLER_WORDS = [
    "um",
    "uh",
    "er",
    "ah",
    "like",
    "you know",
    "basically",
    "actually",
    "so",
    "well",
    "I mean",
    "kind of",
    "sort of",
]

_WS = r"[\s\x{1C}-\x{1F}]"


def _quoted(word: str) -> str:
    return r"\Q" + word + r"\E"


# A border lies where no letter, digit or underscore touches the word.  One
# pass with an alternation removes what one pass per word would: no two
# entries share a word, and deleting a whole word leaves two borders side by
# side, so a deletion can neither create nor break a later match.
_LETTER = r"[\p{L}\p{N}_]"
FILLER_PATTERN = rf"(?iu)(?<!{_LETTER})(?:" + "|".join(_quoted(w) for w in FILLER_WORDS) + rf")(?!{_LETTER})"


def curate(text: Column | str) -> Column:
    """Cleaned prompt of a transcript column (NULL stays NULL)."""
    original = F.col(text) if isinstance(text, str) else text
    r = F.regexp_replace(original, F.lit(FILLER_PATTERN), F.lit(""))
    r = F.trim(F.regexp_replace(r, F.lit(rf"(?U){_WS}+"), F.lit(" ")))
    r = F.regexp_replace(r, F.lit(rf"(?U){_WS}+,"), F.lit(","))
    r = F.regexp_replace(r, F.lit(rf"(?U),{_WS}*,"), F.lit(","))
    r = F.regexp_replace(r, F.lit(rf"(?U)^{_WS}*,{_WS}*"), F.lit(""))
    r = F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 2147483647))
    return F.when(F.length(r) > 0, r).otherwise(original)
