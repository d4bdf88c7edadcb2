"""States of a varied vocabulary are kept, not made again (op2)."""

import random

import public_tokenizers

from propensia.llm import queries
from propensia.llm.token_counts import Transducer


def test_states_of_many_words_are_kept():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(40_000)]
    t = Transducer(public_tokenizers.path(queries.WORD_TOKENIZER))
    first = [t.count(w) for w in words]
    made = len(t.states)
    assert 100_000 < made < 120_000                  # more than 100,000 were forgotten before
    t.words.clear()
    assert [t.count(w) for w in words] == first and len(t.states) == made
