"""Words and lower case against the contract's patterns."""

from hypothesis import given
from hypothesis import strategies as st

from gristmill.llm.common import WORD, lower_ascii, words

LETTERS = "aBZ z\t\n\x0b\x0c\r\x1c\x1d\x1f\x85\xa0 éÉİ\u0000　日𝒳"


@given(st.text(st.sampled_from(LETTERS)) | st.text())
def test_words_and_lower_case_equal_the_pattern(text):
    assert words(text) == WORD.findall(text)
    assert lower_ascii(text) == "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
