import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cohortry.llm.encoders import SpaceLed, WordEnded


@pytest.mark.parametrize("kind,name", [(SpaceLed, "byte_bpe_50k.json"), (WordEnded, "word_bpe_49k.json")])
def test_texts_that_spell_special_tokens_equal_the_untouched_library(kind, name):
    tok = Tokenizer.from_file(P.path(name))
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    rng = random.Random(9)
    parts = [*special, "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "a", "Bc,", " ", "  ", "\n", "é", "12", "endoftext"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert kind(P.path(name)).encode(texts) == want
