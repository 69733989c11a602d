import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quirefold.llm import tokenfile
from quirefold.llm.shared import fresh_path

PATH = P.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(PATH)


@given(st.lists(st.integers(0, (1 << 32) - 1)))
def test_coding_round_trip(values):
    v = np.array(values, np.uint32)
    control, data = tokenfile.pack(v)
    assert len(control) == -(-len(v) // 4)
    assert tokenfile.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(v)).tolist() == v.tolist()


def test_edges(spark, docs, nothing):
    path = fresh_path(spark, "t")
    tokenfile.write_tokens(docs, PATH, path)
    rows = tokenfile.read_tokens(spark, path).orderBy("start").collect()
    t = library()
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, t.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in docs.collect()), key=lambda x: x[:2])
    assert [r.doc_id for r in rows] == [x[1] if x[0] else None for x in texts]
    assert sorted((r.doc_id or -1, r.ids) for r in rows) == sorted((x[1] if x[0] else -1, x[2]) for x in texts)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    empty = fresh_path(spark, "t")
    tokenfile.write_tokens(nothing, PATH, empty)
    assert tokenfile.read_tokens(spark, empty).count() == 0


def test_special_tokens_are_the_librarys():
    texts = ["a <|endoftext|> b", "x<|endoftext|>", "  <|endoftext|>  y  z", "plain  text", ""]
    words = tokenfile.Chunks(PATH)
    got = [np.frombuffer(x, words.kind).tolist() for x in words.encode(texts)]
    assert got == [library().encode(t, add_special_tokens=False).ids for t in texts]


def test_query(spark, sf):
    t, at = library(), 0
    got = {r.doc_id: r for r in tokenfile.op3_tokens(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = t.encode(d.text, add_special_tokens=False).ids + [0]
        r = got.pop(d.doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got
