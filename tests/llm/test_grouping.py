import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm.grouping import suffix_array


@given(st.integers(1, 6).flatmap(lambda k: st.lists(st.integers(0, k), max_size=60)))
@settings(max_examples=400, deadline=None)
def test_equals_sorting(symbols):
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("symbols", [[0] * 3000, [1, 0] * 1500, [0, 1] * 1500, [0, 0, 1] * 1000, list(range(3000)), list(range(3000, 0, -1))])
def test_regular_strings(symbols):
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])
