"""Every registered query against its check SQL, at the smallest scale."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from compare import connect, difference  # noqa: E402
from tracelake.plans.oracles import ORACLES  # noqa: E402
from tracelake.plans.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    assert difference(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name]) is None


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("missing", ["tracelake.llm", "corpus_pipeline", "public_tokenizers"])
def test_other_queries_stay_without_the_training_data_part(monkeypatch, missing):
    """``None`` in ``sys.modules`` makes an import fail, as an absent module or one with an absent dependency does."""
    for name in [n for n in sys.modules if n.startswith(("tracelake.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert "pipeline" not in entry.queries()
