"""The driver's correctness gate, on the smallest tables: every query with oracle SQL must match DuckDB."""

import pytest

from tests.conftest import SF001
from tests.oracle_harness import compare, duck
from txrisk.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[name])
    problems = compare(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description])
    assert not problems, problems


def test_every_query_has_a_callable_and_known_checks():
    assert set(ORACLE) <= set(QUERIES)
    rows_only = set(QUERIES) - set(ORACLE)
    # rows-only entries are the seeded / trained / streamed ones
    assert rows_only == {
        "train_test_split", "undersample_rows", "smote_rows", "model_scores", "model_evaluation",
        "model_feature_importance", "local_explanations", "record_scoring", "stream_prediction_log",
    }
