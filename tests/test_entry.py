import __spark_entry__ as entry
from spanloom.oracle import ORACLE_SQL
from spanloom.queries import QUERIES


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["source1_entity_id", "matched_entity_ids"]
    assert df.count() == 100


def test_only_models_and_string_matchers_lack_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"heuristic_scores", "heuristic_matches", "gbt_scores", "gbt_evaluation", "gbt_importances"}
