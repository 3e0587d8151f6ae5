import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reportloom.llm import packing


@pytest.mark.parametrize("token", ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|StartOfText|>", "<|", "<|other|>"])
def test_special_tokens_as_the_plain_tokenizer(token):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"End {token} Next", f"End{token}Next.", f"{token}", f"{token}{token}!", f"a {token}. B", f"A,{token}\nB",
             f"9{token}X1! {token.lower()} {token.upper()}", "Plain text, no token."]
    plain = Tokenizer.from_file(path)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing._WordEncoder(path).encode(texts)] == want
