import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from quirefold.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_replay_is_the_librarys(library):
    random.seed(1)
    parts = [" ", "\n", "  ", "a", "b", "'s", "é", "1", "!", "<|endoftext|>", "the", "ß漢", "　", "\x1c", "\xa0", " the", "aaaa"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(3000)]
    words = bpe.Words(bpe.read_ranks(PATH), P.PATTERN, {})
    for at in range(0, len(texts), 500):
        for t, ids in zip(texts[at : at + 500], words.ids(texts[at : at + 500])):
            assert ids == library.encode_ordinary(t)


def test_merges_out_of_order_are_done_again():
    # bc (3) comes late, but abc (2) before it: the plain loop decides
    ranks = {b"a": 0, b"b": 1, b"abc": 2, b"bc": 3, b"c": 4, b"d": 5, b"abcd": 6}
    words = [b"abc", b"abcd", b"aabcbc", b"dabcabcd", b"bcbc"]
    assert bpe.MergeReplay(ranks).encode(words) == [[ranks[w]] if w in ranks else bpe.merge_alone(w, ranks) for w in words]


def test_round_trip_and_edges(docs, nothing, library):
    rows = bpe.encode_decode(docs, PATH, P.PATTERN, head=3).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
        assert r.Shard == 7 and not hasattr(r, "IDS")
    assert bpe.encode_decode(nothing, PATH, P.PATTERN).count() == 0


def test_query(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op4_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
