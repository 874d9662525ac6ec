import ast
import pathlib

import pytest

import __spark_entry__ as contract
from check import compare, connect

# Queries beyond SQL, and the test that holds each against a plain version.
BRUTE_FORCE = {
    "op2_simhash": "llm/test_operators.py::test_simhash",
    "op3_shard": "llm/test_operators.py::test_sharding",
    "op4_secret_scan": "llm/test_operators.py::test_secrets",
    "op5_quality_model": "llm/test_models.py::test_quality_training",
    "op6_quality_rules": "llm/test_models.py::test_quality_rules_score",
    "op7_toxicity": "llm/test_models.py::test_toxicity_training",
    "op8_decontaminate": "llm/test_operators.py::test_decontamination_finds_regions_within_the_budget_only",
    "op9_pack": "llm/test_operators.py::test_packing",
    "op10_suffix_dedup": "llm/test_operators.py::test_suffix_dedup",
    "op12_resample": "llm/test_importance.py::test_query_over_whole_tables",
    "pipeline": "llm/test_operators.py::test_pipeline_on_given_tables",
}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql_or_a_plain_version():
    without = set(contract.queries()) - set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries()) and without <= set(BRUTE_FORCE)
    for name in without:
        file, test = BRUTE_FORCE[name].split("::")
        tree = ast.parse((pathlib.Path(__file__).parent / file).read_text())
        assert test in {f.name for f in tree.body if isinstance(f, ast.FunctionDef)}, test


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_result_as_sql(spark, sf, con, name):
    assert compare(spark, con, sf, name) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:3] == ["query_id", "rank", "id"] and df.count() > 0
