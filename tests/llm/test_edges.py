"""Every operator on the awkward table, an empty table, and a table of nulls."""

import pytest

import corpus_pipeline
from spanweave.llm import decontamination, language, lines, mixing, passages, registry, repetition, sharding, simhash, substrings, token_files

from .cases import SCHEMA, awkward, table


def tokens(docs, tmp=[]):  # noqa: B006
    import tempfile

    place = tempfile.mkdtemp() + "/files"
    token_files.write_token_files(docs, place)
    return token_files.read_token_files(docs.sparkSession, place)


def items(docs):
    return docs.sparkSession.createDataFrame([(1, " ".join(f"w{i}" for i in range(20))), (2, None), (3, ""), (4, "short")], "item_id long, text string")


OPERATORS = {
    "repetition": repetition.repetition_rules,
    "tokens": tokens,
    "mixing": mixing.mix_sources,
    "mixed": mixing.mixed_documents,
    "language": lambda d: language.predict(d, *language.learn(d, 20, 2)),
    "passages": passages.shared_passages,
    "substrings": substrings.substring_dedup,
    "contaminated": lambda d: decontamination.contaminated(d, items(d)),
    "decontaminated": lambda d: decontamination.decontaminated(d, items(d)),
    "shards": sharding.shard_documents,
    "lines": lines.dedup_lines,
    "simhash": simhash.simhash_groups,
    "one_of_each": simhash.one_of_each_group,
}
ONE_EACH = {"repetition", "tokens", "mixing", "language", "substrings", "shards", "lines", "simhash"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables_and_nulls(spark, name):
    empty = spark.createDataFrame([], SCHEMA)
    assert OPERATORS[name](empty).count() == 0
    nulls = spark.createDataFrame([(None,) * 12] * 3, SCHEMA)
    got = OPERATORS[name](nulls).count()
    assert got == 3 or name not in ONE_EACH


@pytest.mark.parametrize("name", sorted(ONE_EACH))
def test_one_row_for_each(spark, name):
    assert OPERATORS[name](table(spark)).count() == len(awkward())


def test_columns_are_carried(spark):
    docs = table(spark)
    assert decontamination.decontaminated(docs, items(docs)).columns == docs.columns
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert language.recognised(docs).columns == docs.columns
    assert simhash.one_of_each_group(docs).columns == docs.columns
    assert sharding.shard_documents(docs).columns == [c for c in docs.columns if c != "slot"] + ["shard", "slot"]


def test_names(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "shard"]
    assert sorted(int(n[2:].split("_")[0]) for n in registry.MODULES) == list(range(1, 14))
    assert set(registry.oracle_sql()) == {"op1_suffix_repetition", "op3_source_mixing", "op9_line_suffix_dedup", "op12_merkle_manifest", "op13_url_filter"}
