"""op8 on texts that hold the tokenizer's special tokens, against the untouched library."""

import public_tokenizers
from tokenizers import Tokenizer

from telemara.llm import token_orc
from telemara.llm.queries import WORD_TOKENIZER


def test_special_tokens_are_encoded_as_the_library_does(spark, tmp_path):
    path = public_tokenizers.path(WORD_TOKENIZER)
    made = Tokenizer.from_file(path)
    texts = ["one <|endoftext|> two", "<|startoftext|>", "glued<|endoftext|>word <|endoftext|><|startoftext|>", "x<|endoftext|>", "<|EndOfText|> and", " <|endoftext|>\n\t<|endoftext|>  y", "plain words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_orc.write_tokens(docs, f"{tmp_path}/t", path)
    got = {r.doc_id: r.ids for r in token_orc.read_tokens(spark, f"{tmp_path}/t").collect()}
    assert got == {i: made.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    assert 49407 in got[0] and 49406 in got[1]
