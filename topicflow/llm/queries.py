"""The registered queries of this folder and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_windows import chat_windows, read_back
from .fill_middle import fill_in_middle, restored
from .frames import held_out
from .languages import identify_languages
from .lm_scoring import cross_entropy_difference
from .merkle import folded, leaf_digest, merkle_manifest, proof_digest
from .minhash import near_duplicates
from .mixing import mix_rates
from .packing import pack
from .quality_rules import judge_documents
from .suffix_dedup import remove_repeated_bytes
from .toxicity import THRESHOLD, score_toxicity
from .vector_join import link_vectors
from .window_dedup import remove_repeated_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), public_tokenizers.path(TOKENIZER))


@query("op2_language_bitmask")
def language_bitmask(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"))
    found = identify_languages(docs, ~out)
    return found.select(
        "doc_id", out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )


@query("op3_toxicity_machine")
def toxicity_machine(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"))
    scored = score_toxicity(docs, table(spark, sf, "labels"), ~out)
    score = F.col("toxicity")
    return scored.select("doc_id", out.alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


@query(
    "op4_quality_rules",
    rf"""
WITH words AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS_SQL} AS words FROM documents),
lines AS (
    SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nth
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup_lines AS (SELECT doc_id, count(*) AS n FROM lines WHERE nth > 1 GROUP BY doc_id),
windows AS (
    SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS w
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM words WHERE len(words) >= 5)),
repeated AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS p FROM repeated WHERE n >= 2),
repeat_words AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
measured AS (
    SELECT w.doc_id, w.source, len(words) AS n_words,
        length(array_to_string(words, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
    FROM words w LEFT JOIN dup_lines d USING (doc_id) LEFT JOIN repeat_words r USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
hosts AS (SELECT source, count(*) AS n, sum(base_failed :: INT) AS failed FROM judged GROUP BY source),
moments AS (SELECT avg(failed / n) AS m, var_samp(failed / n) AS v FROM hosts),
prior AS (
    SELECT CASE WHEN m * (1 - m) > 0 THEN m ELSE 0.5 END AS mean,
        CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 2.0 END AS strength FROM moments),
verdicts AS (SELECT source, n, failed, (failed + mean * strength) / (n + strength) AS rate FROM hosts, prior)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND rate < 0.5 AS kept
FROM judged JOIN verdicts ON verdicts.source IS NOT DISTINCT FROM judged.source""",
)
def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = judge_documents(table(spark, sf, "documents").select("doc_id", "text", "source"))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[F.col(f"quality.{f}").alias(f) for f in fields])


WINDOW_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS w
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM words WHERE len(words) >= 20)),
later AS (SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
kept AS (
    SELECT w.doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
    FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM words) w
    ANTI JOIN covered USING (doc_id, p) GROUP BY w.doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)"""


@query("op5_window_doubling", WINDOW_SQL)
def window_doubling(spark: SparkSession, sf: str) -> DataFrame:
    cut = remove_repeated_windows(table(spark, sf, "documents"))
    digest = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return cut.select("doc_id", "n_words", "n_removed", digest)


@query(
    "op6_source_mixing",
    f"""
WITH sized AS (SELECT doc_id, source, len({WORDS_SQL}) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sources),
capped AS (
    SELECT source, source_size, rank, [1.0, 2.0, 3.0][rank % 3 + 1] :: DOUBLE AS weight, 3.0 :: DOUBLE * source_size AS cap FROM weighed),
levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM capped WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
    SELECT source, source_size,
        least(cap, weight * (SELECT max(level) FROM levels)) AS target FROM levels),
rated AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        CAST('0x' || substr(md5(doc_id || ':17'), 1, 8) AS BIGINT) / 4294967296.0 :: DOUBLE AS draw
    FROM sized JOIN targets ON targets.source IS NOT DISTINCT FROM sized.source)
SELECT doc_id, size, source_size, target,
    size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM rated""",
)
def source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mix = mix_rates(table(spark, sf, "documents").select("doc_id", "text", "source"))
    taken = (F.col("mix.size") * F.col("mix.copies")).alias("taken")
    return mix.select("doc_id", "mix.size", "mix.source_size", "mix.target", taken)


@query("op7_suffix_merge")
def suffix_merge(spark: SparkSession, sf: str) -> DataFrame:
    cut = remove_repeated_bytes(table(spark, sf, "documents").select("doc_id", "text"))
    counts = [f"suffix.{c}" for c in ("n_bytes", "n_removed", "n_spans")]
    return cut.select("doc_id", *counts, F.sha2("suffix.kept", 256).alias("kept_sha256"))


@query("op8_cross_entropy_difference")
def cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return cross_entropy_difference(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(
    "op9_vector_near_duplicates",
    """
WITH RECURSIVE units AS (
    SELECT vec_id, list_transform(embedding, lambda x: x :: DOUBLE) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
        AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM roots LEFT JOIN counts USING (vec_id)""",
)
def vector_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return link_vectors(table(spark, sf, "embeddings"))


@query("op10_minhash_near_duplicates")
def minhash_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


@query(
    "op11_fill_in_middle",
    r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
        sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
    SELECT doc_id, text, units, len(units) AS n,
        CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS one, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS other,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
            WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
    SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:least(one, other)], ''), '') AS prefix,
        coalesce(array_to_string(units[least(one, other) + 1:greatest(one, other)], ''), '') AS middle,
        coalesce(array_to_string(units[greatest(one, other) + 1:], ''), '') AS suffix FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle)
        ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts""",
)
def fill_middle(spark: SparkSession, sf: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf, "documents").select("doc_id", "text"))
    output, form = F.col("fim.output"), F.col("fim.form")
    digests = [F.sha2(output, 256).alias("output_sha256"), F.sha2(restored(output, form), 256).alias("restored_sha256")]
    return cut.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", *digests)


LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _leaf_sql(text: str) -> str:
    values = [*(f"CAST({c} AS VARCHAR)" for c in LEAF_FIELDS[:-1]), text]
    parts = [f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values]
    return f"sha256(concat({', '.join(parts)}))"


@query(
    "op12_interval_manifest",
    f"""
WITH RECURSIVE crc_table AS (
    SELECT list(entry ORDER BY i) AS entries FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) AS entry
        FROM (SELECT unnest(range(256)) AS i))),
leaves AS (
    SELECT doc_id, lang, {_leaf_sql('text')} AS leaf,
        {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS tampered,
        xor(4294967295, list_reduce(
            list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda c, b: xor(c >> 8, entries[xor(c, b) % 256 + 1]))) AS crc
    FROM documents, crc_table),
placed AS (
    SELECT doc_id, lang, leaf, CASE WHEN crc % 3 = 0 THEN tampered ELSE leaf END AS claimed,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
nodes AS (
    SELECT lang, 0 AS level, place, leaf AS digest FROM placed
    UNION ALL
    SELECT lang, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place))
    FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM nodes) WHERE n > 1 GROUP BY lang, level, place // 8),
langs AS (
    SELECT lang, subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
    FROM (SELECT lang, arg_max(digest, level) AS subroot FROM nodes GROUP BY lang)),
crown AS (
    SELECT 0 AS level, place, subroot AS digest FROM langs
    UNION ALL
    SELECT level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place))
    FROM (SELECT *, count(*) OVER () AS n FROM crown) WHERE n > 1 GROUP BY level, place // 8),
both_trees AS (
    SELECT 'in ' || coalesce('=' || lang, '') AS tree, level, place, digest FROM nodes UNION ALL SELECT 'crown', * FROM crown),
sibling_runs AS (
    SELECT tree, level, place // 8 AS run, list(place ORDER BY place) AS places, list(digest ORDER BY place) AS digests,
        level < max(level) OVER (PARTITION BY tree) AS inner_run
    FROM both_trees GROUP BY tree, level, place // 8),
paths AS (
    SELECT lang, place AS leaf_place, 'in ' || coalesce('=' || lang, '') AS tree, 0 AS part, place FROM placed
    UNION ALL
    SELECT p.lang, p.place, 'crown', 1, l.place FROM placed p JOIN langs l ON l.lang IS NOT DISTINCT FROM p.lang),
steps AS (
    SELECT lang, leaf_place, part, r.level,
        coalesce(array_to_string(list_filter(digests, lambda d, i: places[i] < p.place // CAST(pow(8, r.level) AS BIGINT)), ''), '') AS l,
        coalesce(array_to_string(list_filter(digests, lambda d, i: places[i] > p.place // CAST(pow(8, r.level) AS BIGINT)), ''), '') AS r
    FROM paths p JOIN sibling_runs r ON r.tree = p.tree AND r.inner_run AND r.run = p.place // CAST(pow(8, r.level + 1) AS BIGINT)),
proofs AS (
    SELECT lang, leaf_place, string_agg(l || r, '' ORDER BY part, level) AS proof, list(l || '|' || r ORDER BY part, level) AS path
    FROM steps GROUP BY lang, leaf_place),
folded AS (
    SELECT doc_id, p.lang, leaf, sha256(coalesce(proof, '')) AS proof_sha256,
        list_reduce(list_prepend(claimed, coalesce(path, [])),
            lambda own, s: sha256(concat(split_part(s, '|', 1), own, split_part(s, '|', 2)))) AS folded_root
    FROM placed p LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.leaf_place = p.place)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM folded f JOIN langs s ON s.lang IS NOT DISTINCT FROM f.lang, (SELECT arg_max(digest, level) AS root FROM crown)""",
)
def interval_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(*LEAF_FIELDS)
    upper = "".join(map(chr, range(0x41, 0x5B)))
    changed = leaf_digest([*(F.col(c) for c in LEAF_FIELDS[:-1]), F.translate("text", upper, upper.lower())])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    # where nothing is changed, a row's claim is its leaf
    rows = merkle_manifest(docs, LEAF_FIELDS, carry={"claimed": F.when(tampered, changed)}).rows
    root = folded(F.coalesce("claimed", "leaf"), F.col("steps"))
    found = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), root.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


CONTROL_TEXT = r"\### Assistant: </turn> ok"


@query("op13_chat_windows")
def chats(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    rows = given.union(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string"))
    return read_back(chat_windows(rows, public_tokenizers.path(TOKENIZER)), ordered=True)
