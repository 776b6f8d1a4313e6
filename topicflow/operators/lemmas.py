"""Lemmas from suffix rules and a vocabulary, for callers without a dictionary of forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Endings of English plural nouns and what they become.
NOUN_RULES = (
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
)


def lemma_dictionary(
    forms: DataFrame,
    vocabulary: DataFrame,
    exceptions: DataFrame | None = None,
    rules: Sequence[tuple[str, str]] = NOUN_RULES,
) -> DataFrame:
    """(form, lemma) of the forms that have another lemma, for ``terms.lemmatize``.

    ``forms`` (form) gives candidates by every rule whose ending it has; those in ``vocabulary`` (word)
    stand, the form itself among them, and the shortest is taken, the earlier rule's on a tie.  A form in
    ``exceptions`` (form, lemma; the least lemma of a repeated form) takes that lemma instead.  Words are
    joined once each, not their occurrences.  Nulls and empty forms have no lemma.
    """
    forms = forms.select("form").where("form <> ''").distinct()
    made = [F.struct(F.lit(0).alias("rule"), F.col("form").alias("word"))]
    for i, (ending, stem) in enumerate(rules, 1):
        word = F.concat(F.expr(f"left(form, length(form) - {len(ending)})"), F.lit(stem))
        made.append(F.struct(F.lit(i).alias("rule"), F.when(F.endswith("form", F.lit(ending)), word).alias("word")))
    candidates = forms.select("form", F.inline(F.array(*made))).where("word <> ''")
    standing = candidates.join(vocabulary.select("word").distinct(), "word")
    best = standing.groupBy("form").agg(F.min(F.struct(F.length("word").alias("n"), "rule", "word")).alias("b"))
    lemmas = best.select("form", F.col("b.word").alias("lemma"))
    if exceptions is not None:
        fixed = exceptions.groupBy("form").agg(F.min("lemma").alias("fixed"))
        known = forms.join(fixed, "form").select("form", F.col("fixed").alias("lemma"))
        lemmas = known.unionByName(lemmas.join(fixed, "form", "left_anti"))
    return lemmas.where("lemma <> form")
