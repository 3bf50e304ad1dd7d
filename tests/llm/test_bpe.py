import random

import public_tokenizers
from tokenizers import Tokenizer

from tessella.llm.bpe import ByteBpe, decode_ids, encode_texts, read_definition

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_matches_the_library(spark):
    rng = random.Random(1)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "ß", "中", "🙂", "1", "23", "'s", "'ll", "!!", "###", " ", " ", "<|endoftext|>", "aaaa", "\x00", "İ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["", None, "a" * 5000, " " * 3000, "=" * 999, "<|endoftext|><|endoftext|>", "x" + " " * 7 + "y ", "".join(rng.choice("abcdefgh") for _ in range(3000))]
    library = Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    definition = read_definition(PATH)
    for r in [*decode_ids(encode_texts(df, definition), definition).collect(), *encode_texts(df, definition, decode=True).collect()]:
        expected = library.encode(texts[r.doc["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == expected
        assert r.decoded == library.decode(expected, skip_special_tokens=False)


def test_invalid_ids_and_empty_table(spark):
    import json

    import numpy as np

    model = ByteBpe(json.loads(read_definition(PATH)))
    assert model.decode(np.array([-1, 10**6, 64]), np.array([2, 1])) == [b"", b"a"]
    definition = read_definition(PATH)
    assert decode_ids(encode_texts(spark.createDataFrame([], "doc_id bigint, text string"), definition), definition).collect() == []
