"""Tables of nodes meet by shuffles, whatever the planner guesses: on the small pages it would broadcast every one of them."""

import pytest

from pagespine import scratch
from pagespine.operators import addresses, observe, reducers, sequences


@pytest.fixture
def plans(monkeypatch):
    """The physical plans of a query and of all that it writes on the way."""
    seen = []

    def told(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    for module in (addresses, observe, reducers, sequences):
        monkeypatch.setattr(module, "written", lambda df, label: scratch.written(told(df), label))
    return lambda df: told(df) and seen


@pytest.mark.parametrize("module, name", [(sequences, "tree_integrity"), (reducers, "dom_entries"), (observe, "region_index"), (addresses, "page_addresses"), (addresses, "region_expansions"), (addresses, "member_inspections")])
def test_no_table_of_nodes_is_broadcast(spark, tiny, plans, module, name):
    found = plans(module.QUERIES[name](spark, tiny))
    assert found and not [p for p in found if "BroadcastHashJoin" in p.replace("BroadcastHashJoin [fault", "")]


@pytest.mark.parametrize("module, name", [(sequences, "tree_integrity"), (reducers, "dom_entries"), (observe, "region_index"), (addresses, "page_addresses")])
def test_pages_are_parsed_once(spark, tiny, plans, module, name):
    assert sum(p.count("[nodes(html") for p in plans(module.QUERIES[name](spark, tiny))) == 1
