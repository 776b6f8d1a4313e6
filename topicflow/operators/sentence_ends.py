"""Sentence ends with abbreviations learned from the corpus.

A full stop after a word ends a sentence unless the word is an abbreviation.  Which words are
abbreviations is read off their counts with and without a full stop over the whole corpus, by the
scaled log-likelihood ratio of Kiss and Strunk (Computational Linguistics 32, 2006): the full stop
belongs to the word (probability 0.99) against it follows by chance; short words and words with inner
full stops score higher, words that also occur without one score lower.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SENTENCE_END, strip

MIN_SCORE = 0.3
BELONGS = 0.99
WORD = r"\p{L}(?:[\p{L}.]*\p{L})?"
OPENING = r"[\"'(\[]*"
CLOSING = r"[,;:!?\"')\]]*"
# a token of the text that is a word, with its full stop; tokens end at white space, or at the text's end and
# its last line mark
TOKEN = rf"(?<!\S){OPENING}({WORD}[.]?){CLOSING}(?=[\u0085\u2028\u2029]?(?:\s|\z))"
_BREAK = "\u0001"
FEW = 10_000  # abbreviations up to here are looked up in place


def stop_counts(texts: DataFrame, text: str = "content") -> DataFrame:
    """(word, dotted, plain): lower-cased words with their counts before a full stop and elsewhere."""
    tokens = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(1))).alias("token"))
    # a word ends in a letter, so a full stop at the end is not its own
    parts = tokens.select(F.rtrim("token", F.lit(".")).alias("word"), F.endswith("token", F.lit(".")).alias("dot"))
    counted = parts.groupBy("word")
    return counted.agg(F.count_if("dot").alias("dotted"), F.count_if(~F.col("dot")).alias("plain"))


def abbreviations(texts: DataFrame, text: str = "content", min_score: float = MIN_SCORE) -> DataFrame:
    """(word, dotted, plain, score) of the words whose full stop is part of them.

    Null and empty texts count nothing; a corpus without full stops has no abbreviations.
    """
    counts = stop_counts(texts, text)
    total = counts.agg(F.sum("dotted").alias("all_dotted"), F.sum(F.col("dotted") + F.col("plain")).alias("all_words"))
    dotted, words = total.first()
    share = (dotted or 0) / (words or 1)
    chance = F.col("dotted") * F.log(F.lit(share)) + F.when(F.col("plain") > 0, F.col("plain") * F.log(F.lit(1 - share))).otherwise(0)
    belongs = F.col("dotted") * F.log(F.lit(BELONGS)) + F.col("plain") * F.log(F.lit(1 - BELONGS))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    scale = F.exp(-letters) * (F.length("word") - letters + 1) * F.pow(letters, -F.col("plain"))
    scored = counts.where("dotted > 0").withColumn("score", 2 * (belongs - chance) * scale)
    return scored.where(F.col("score") >= min_score)


def _pieces(text: Column) -> Column:
    return F.split(F.regexp_replace(strip(text), SENTENCE_END, f"$1{_BREAK}"), _BREAK)


def _last_word(piece: Column) -> Column:
    """The lower-cased word before a full stop that ends the piece, or the empty string."""
    # what stands behind the last space decides
    return F.regexp_extract(F.lower(F.substring_index(piece, " ", -1)), rf"(?:^|\s){OPENING}({WORD})[.]$", 1)


def learned_sentences(df: DataFrame, known: DataFrame, key: str = "url", text: str = "content") -> DataFrame:
    """``df``'s key and its sentences, an array: cut after end punctuation followed by space, but not
    after an abbreviation of ``known`` (word).

    Up to ``FEW`` known words are looked up where the text lies.  With more, the distinct words before
    full stops are joined with them, and a text gets back those that are abbreviations.  A null text has null sentences, an empty one the empty sentence.  Rows that repeat
    a key keep their own sentences.
    """
    words = known.select("word").where("word IS NOT NULL").distinct()
    few = [r.word for r in words.limit(FEW + 1).collect()]

    def joined_by(pieces: Column, inside: Callable[[Column, Column], Column]) -> Column:
        def joined(own: Column) -> Column:
            def glued(piece: Column, i: Column) -> Column:
                return F.concat(piece, F.when(i == F.size(own) - 1, "").when(inside(piece, i), " ").otherwise(_BREAK))

            return F.split(F.array_join(F.transform(own, glued), ""), _BREAK)

        # the pieces are a variable: a filter pushed below would cut the text again for every piece
        return F.get(F.transform(F.array(pieces), joined), 0).alias("sentences")

    if len(few) <= FEW:
        return df.select(F.col(key), joined_by(_pieces(F.col(text)), lambda piece, _: _last_word(piece).isin(few)))
    rows = df.select(F.col(key).alias("_key"), _pieces(F.col(text)).alias("_pieces"))
    rows = rows.withColumn("_ends", F.transform("_pieces", _last_word))
    asked = rows.select("_key", F.explode(F.array_distinct("_ends")).alias("word")).where("word <> ''")
    found = asked.join(words, "word").groupBy(F.col("_key").alias("_found_key"))
    found = found.agg(F.collect_set("word").alias("_found"))
    joined = rows.join(found, F.col("_key").eqNullSafe(F.col("_found_key")), "left")
    sentences = joined_by(F.col("_pieces"), lambda _, i: F.array_contains("_found", F.get("_ends", i)))
    return joined.select(F.col("_key").alias(key), sentences)
