"""Token ids against the JSON form as it comes, where texts hold its added token."""

from __future__ import annotations

import numpy as np

from tessera.llm import packing, tokens

from .fixtures import frame, texts

END_OF_TEXT = [
    "<|endoftext|>", "aa <|endoftext|> bb", "aa<|endoftext|><|endoftext|>bb", " <|endoftext|>\n\n<|endoftext|>  it's", "<|endoftext|", "|<|endoftext|>|", "<|ENDOFTEXT|>", "é<|endoftext|>😀", "a  <|endoftext|>  b",
]


def json_form():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_matches_the_json_form_as_it_comes():
    other = json_form()
    assert {t.content: i for i, t in other.get_added_tokens_decoder().items()} == tokens.ADDED
    for t in [*END_OF_TEXT, *filter(None, texts())]:
        assert tokens.encode(t) == other.encode(t, add_special_tokens=False).ids


def test_packed_ids_match_the_json_form(spark):
    other = json_form()
    rows = packing.pack(frame(spark, list(enumerate(END_OF_TEXT))), keep_ids=True).collect()
    want = {i: [*other.encode(t, add_special_tokens=False).ids, packing.END] for i, t in enumerate(END_OF_TEXT)}
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rows} == want
