import zlib

import numpy as np
import public_tokenizers
import xxhash
from llm_data import ODD, empty, odd
from tokenizers import Tokenizer

from searchloom.llm import token_files
from searchloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def text_hash(text):
    """The 64-bit hash that orders rows of one id; a null text has the seed."""
    value = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def naive(pairs):
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, text_hash(p[1]), p[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_is_an_exact_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op2_token_files"](spark, sf_dir).orderBy("start").collect()
    assert [tuple(r) for r in got] == naive([tuple(d) for d in docs])


def test_odd_rows(spark):
    shards = token_files.write_tokens(odd(spark).repartition(3), PATH)
    got = token_files.read_tokens(spark, shards).drop("shard").orderBy("start").collect()
    assert [tuple(r) for r in got] == naive([(i, t) for i, t, _ in ODD])
    assert token_files.read_tokens(spark, token_files.write_tokens(empty(spark), PATH)).count() == 0


def test_encoder_equals_the_library_on_white_space_and_marks():
    texts = ["a  b", " a\n\n b\t\tc ", " x y\x1cz\x1fq", "it's 'tis we'll", "١٢٣ ½ Ⅷ x²", "<|endoftext|>", "éa​b", "\n", " ", "a \n b"]
    texts += ["Plain words, with marks: and two\nlines... of 'text'!", "x", "?!", "a.\n.b (c), d;", "é,\u2028f", "'s it's\n're", "²! ½. x_. <a>."]
    enc, tokenizer = token_files.Encoder(PATH), Tokenizer.from_file(PATH)
    for text, packed in zip(texts, enc.encode(texts)):
        assert np.frombuffer(packed, enc.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
