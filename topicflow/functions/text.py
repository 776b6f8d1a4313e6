"""Text expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extra stop words and the usual English list.
EXTRA_STOP_WORDS = (
    "that a to of which and while in for those their these this but howev it also the onli "
    "have one t s v d at has what"
).split()
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don don't should should've now d ll m o re ve y ain aren aren't "
    "couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma "
    "mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren "
    "weren't won won't wouldn wouldn't"
).split()
STOP_WORDS = sorted({*EXTRA_STOP_WORDS, *ENGLISH_STOP_WORDS})
STUB = "$$$STUB$$$"
# for lower-cased text: a run of other characters, spaces among them, becomes one space
NOT_LETTERS = "[^a-zа-я]+"


def normalize_ws(col: Column) -> Column:
    """Strip and turn every run of whitespace into one space."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def clean_text(col: Column) -> Column:
    """Lower case, letters of the two alphabets only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(col), NOT_LETTERS, " "))


def tokenize(cleaned: Column, min_length: int = 1) -> Column:
    """Words of a cleaned text; empty text has none."""
    return F.filter(F.split(cleaned, " "), lambda w: F.length(w) >= min_length)


def remove_stopwords(tokens: Column, words: Iterable[str] = STOP_WORDS) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*words))


def stub_if_empty(col: Column) -> Column:
    # a pattern instead of a comparison: the text is computed once
    return F.regexp_replace(col, r"^\z", STUB.replace("$", r"\$"))


def preprocess(col: Column, words: Iterable[str] = STOP_WORDS) -> Column:
    """Clean text without stop words, as a string; the stub when nothing is left."""
    kept = remove_stopwords(tokenize(clean_text(col)), words)
    return stub_if_empty(F.array_join(kept, " "))


def content_hash(col: Column) -> Column:
    """sha-256 of the text; a missing text hashes as the word None."""
    return F.sha2(F.coalesce(col, F.lit("None")), 256)


def sentences(col: Column) -> Column:
    return F.split(col, r"\.")


def lead_summary(col: Column, n: int = 2) -> Column:
    """The first ``n`` sentence pieces joined by a space, without outer whitespace."""
    return strip(F.array_join(F.slice(sentences(col), 1, n), " "))


def capitalize_sentence(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.substring(col, 2, 2**31 - 1), F.lit("."))


def wrap_summary(col: Column) -> Column:
    """Line break after each full stop."""
    return F.replace(col, F.lit("."), F.lit(".\n"))


SENTENCE_END = r"([.!?]+[\"')\]]*)\s+"


def first_sentences(col: Column, n: int = 3) -> Column:
    """The first ``n`` sentences, cut after end punctuation followed by space, joined by a space."""
    marked = F.regexp_replace(strip(col), SENTENCE_END, "$1\u0001")
    return F.array_join(F.slice(F.split(marked, "\u0001"), 1, n), " ")


# Characters and what they become; others stay as they are.
FOLDED = {
    "àáâãāăąåạả": "a", "ä": "ae", "æ": "ae", "çćĉċč": "c", "ďđ": "d", "èéêëēĕėęěẽ": "e",
    "ĝğġģ": "g", "ĥħ": "h", "ìíîïĩīĭįı": "i", "ĵ": "j", "ķ": "k", "ĺļľł": "l", "ñńņň": "n",
    "òóôõōŏőø": "o", "ö": "oe", "œ": "oe", "ŕŗř": "r", "śŝşš": "s", "ß": "ss", "ţťŧ": "t",
    "ùúûũūŭůűų": "u", "ü": "ue", "ŵ": "w", "ýÿŷ": "y", "źżž": "z",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z",
    "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "sch", "ы": "y", "э": "e", "ю": "yu", "я": "ya",
}


def folding_table() -> dict[str, str]:
    """One entry per lower-case character, and its capital with a capitalised result."""
    table: dict[str, str] = {}
    for characters, folded in FOLDED.items():
        for c in characters:
            table[c] = folded
            if len(c.upper()) == 1 and c.upper() != c:
                table.setdefault(c.upper(), folded.capitalize())
    table.pop("I", None)
    return table


# stand-ins for characters that become several, or none, until all are found
_STAND_INS = range(0xE000, 0xF8FF)


def fold_characters(col: Column, mapping: dict[str, str] | None = None) -> Column:
    """Replace single characters by their folded form; unknown characters stay.

    Every character of the text is looked up once: what one becomes is not looked up again.  Keys of
    several characters match nothing.
    """
    mapping = folding_table() if mapping is None else mapping
    singles = {k: v for k, v in mapping.items() if len(k) == 1}
    if not singles:
        return col
    pairs = [F.lit(x) for kv in singles.items() for x in kv]
    slow = F.array_join(F.transform(F.split(col, ""), lambda c: F.coalesce(F.element_at(F.create_map(*pairs), c), c)), "")
    several = {k: v for k, v in singles.items() if len(v) != 1}
    if len(several) > len(_STAND_INS):
        return slow
    stand_ins = {k: chr(mark) for k, mark in zip(several, _STAND_INS)}
    folded = F.translate(col, "".join(singles), "".join(stand_ins.get(k, v) for k, v in singles.items()))
    for source, mark in stand_ins.items():
        folded = F.replace(folded, F.lit(mark), F.lit(several[source]))
    # a text or a target with a stand-in of its own goes character by character
    if any(chr(_STAND_INS[0]) <= c <= chr(_STAND_INS[-1]) for kv in singles.items() for x in kv for c in x):
        return slow
    return F.when(col.rlike("[\ue000-\uf8ff]"), slow).otherwise(folded)


def format_time(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
