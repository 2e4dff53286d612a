import re

import pytest
from hypothesis import given, settings, strategies as st

from logprism.functions.signal_table import SIGNALS


@pytest.mark.parametrize("signal", SIGNALS, ids=lambda s: s.label)
def test_every_match_holds_a_needle(signal):
    matching = st.from_regex(re.compile(signal.pattern, re.I | re.A))

    @settings(max_examples=60, deadline=None, database=None)
    @given(matching)
    def check(text):
        assert any(needle in text.lower() for needle in signal.needles), text

    check()
