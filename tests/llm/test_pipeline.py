"""Each stage, on the table that the stage before wrote, against a brute-force version."""

import brute
import public_tokenizers
from brute import SF
from pyspark.sql import functions as F
from test_packing import check_layout

import __spark_entry__ as entry
import corpus_pipeline
from topicflow.llm.frames import held_out
from topicflow.llm.mixing import mix_rates
from topicflow.llm.toxicity import score_toxicity
from topicflow.session import materialize


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        tables[name] = docs = materialize(stage(spark, docs, SF))
        assert docs.columns == columns
    given = spark.read.parquet(f"{SF}/documents.parquet")

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = score_toxicity(given, labels, ~held_out(F.col("doc_id"))).where("toxicity < 0.3").drop("toxicity")
    assert rows_of(tables["toxicity"]) == rows_of(scored)

    before = rows_of(tables["toxicity"])
    owners = brute.near_duplicates([(r[0], r[1]) for r in before], percent=80, size=5)
    assert rows_of(tables["near_duplicates"]) == [r for r in before if owners[r[0]][1] == r[0]]

    before = rows_of(tables["near_duplicates"])
    kept = {k: text.decode(errors="ignore") for k, _, _, text in brute.suffix_cuts([(r[0], r[1]) for r in before])}
    assert rows_of(tables["repeated_passages"]) == sorted(((r[0], kept[r[0]], *r[2:]) for r in before), key=str)

    rates = mix_rates(tables["repeated_passages"]).collect()
    assert rows_of(tables["source_mix"]) == sorted((tuple(r)[:-1] for r in rates for _ in range(r.mix.copies)), key=str)

    packed = corpus_pipeline.STAGES[-1][1](spark, tables["source_mix"], SF)
    distinct = tables["source_mix"].dropDuplicates(["doc_id"])
    texts = [tuple(r) for r in distinct.select("doc_id", "text").collect()]
    check_layout(corpus_pipeline.STAGES[-1][1](spark, distinct, SF).collect(), texts, 2048)
    assert packed.agg(F.countDistinct("sequence_id", "offset")).first()[0] == packed.count()


def test_the_query_runs_all_stages(spark):
    result = entry.queries()["pipeline"](spark, SF)
    assert result.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert result.count() > 0
    assert public_tokenizers.path(corpus_pipeline.TOKENIZER)


def test_clean_distinct_documents_survive_the_filters(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)), "en", f"s{i % 2}", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
    assert sorted(tuple(r) for r in docs.collect()) == rows
