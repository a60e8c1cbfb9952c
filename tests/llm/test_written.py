"""Written-out addresses in any case of letters."""

import pytest

from wordvane.llm import pii


@pytest.mark.parametrize("text", ["bob (At) example (Dot) com", "BOB ( AT ) EXAMPLE ( DOT ) COM", "bob[aT ]example.com", "bob (at) example (dot) com", "bob [AT] example.com"])
def test_written_addresses(text):
    assert pii.loose_spans(f"write to {text}") == [("email", 9, 9 + len(text))]
