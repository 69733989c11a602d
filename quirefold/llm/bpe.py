"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Words (the matches of a split pattern) are counted over the whole corpus. The merges are replayed over the commonest
``head`` words at once: an inverted index leads from a token that two neighbours could form to the positions of such
neighbours, tokens are taken in rank order, and a merge updates only the neighbours that it touches. The head, whose
size has a fixed bound, is sent to all tasks. Words outside it are replayed in the same way, as many at once as a
slice of a task's rows holds. So no text is shuffled, and nothing that is sent grows with the corpus.

Null text: no tokens, as for an empty one. Repeated rows, null ids and other columns are kept as they are; an empty
table gives an empty result. Of words that are as common it doesn't matter which are in the head: the ids are the same.
Very long texts are only limited by memory for one row, and one without blanks is a single chunk. Lone surrogates cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.shared import Recent, chunks, commonest, kept_in_worker, map_batches, stored

HEAD_WORDS = 250_000
HEAD_WORD_BYTES = 64
#: Entries of a task's counter; entries that a worker remembers, at least.
CACHE = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file whose lines are a token in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_alone(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One word, by looking for the lowest rank again after each merge. Slow; for words whose merges don't come in rank order."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 62:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class MergeReplay:
    """Replays all merges over many words at once. Words are UTF-8, in which the byte 255 doesn't occur."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks.get(bytes([b]), -1) if b < 255 else -1 for b in range(256)], np.int64)
        self.bytes_join = np.full(1 << 16, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2 and 255 not in token:
                self.bytes_join[token[0] << 8 | token[1]] = rank
        # by token: what it forms with a token behind it, and with one before it, as far as that was asked for
        self.behind: dict[int, dict[int, int]] = {}
        self.before: dict[int, dict[int, int]] = {}
        self.asked = 0

    def joined(self, a: int, b: int) -> int:
        """The token that a and b form, or -1."""
        self.asked += 1
        return self.ranks.get(self.tokens[a] + self.tokens[b], -1)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        if self.asked > 2_000_000:
            self.behind, self.before, self.asked = {}, {}, 0
        ranks, joined = self.ranks, self.joined
        out: list[list[int] | None] = [None if (whole := ranks.get(w)) is None else [whole] for w in words]
        open_ = [i for i, x in enumerate(out) if x is None]
        raw = np.frombuffer(b"\xff" + b"".join([words[i] + b"\xff" for i in open_]), np.uint8)
        n = len(raw)
        symbol = self.single[raw].tolist()
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        # the inverted index: where each token could be formed, and for each place by which token now
        pair = self.bytes_join[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        forms = pair.tolist()
        forms.append(-1)
        at_all = np.flatnonzero(pair >= 0)
        at_all = at_all[np.argsort(pair[at_all], kind="stable")]
        present, cut = np.unique(pair[at_all], return_index=True)
        places = at_all.tolist()
        ends = [*cut.tolist()[1:], len(places)]
        index = {rank: places[a:b] for rank, a, b in zip(present.tolist(), cut.tolist(), ends)}
        todo = list(index)  # ascending, so a heap
        odd: set[int] = set()
        push, pop = heapq.heappush, heapq.heappop
        while todo:
            rank = pop(todo)
            positions = index.pop(rank)
            positions.sort()
            with_next, with_last = self.behind.setdefault(rank, {}), self.before.setdefault(rank, {})
            for at in positions:
                if forms[at] != rank:
                    continue  # one of the two is part of another token by now
                then = after[at]
                far = after[then]
                near = before[at]
                symbol[at], symbol[then] = rank, -2
                forms[then] = -1
                after[at] = far
                before[far] = at
                b = symbol[far]
                if b < 0:
                    new = -1
                else:
                    new = with_next.get(b)
                    if new is None:
                        new = with_next[b] = joined(rank, b)
                forms[at] = new
                if new >= 0:
                    if new <= rank:
                        odd.add(at)  # it goes before merges that are done already
                    if new in index:
                        index[new].append(at)
                    else:
                        index[new] = [at]
                        push(todo, new)
                a = symbol[near]
                if a >= 0:
                    new = with_last.get(a)
                    if new is None:
                        new = with_last[a] = joined(a, rank)
                    forms[near] = new
                    if new >= 0:
                        if new <= rank:
                            odd.add(at)
                        if new in index:
                            index[new].append(near)
                        else:
                            index[new] = [near]
                            push(todo, new)
        at = 1
        again = sorted(odd)
        for i in open_:
            end = at + len(words[i])
            k = bisect_left(again, at)
            out[i] = merge_alone(words[i], ranks) if k < len(again) and again[k] < end else [x for x in symbol[at:end] if x >= 0]
            at = end + 1
        return out  # type: ignore[return-value]


class Words:
    """A worker's encoder: what ``piece`` makes of each word's ids, by the head and, outside it, by replay over a slice's words.

    Pieces are tuples, whose parts add up to those of a chunk of several words.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, head: dict[str, bytes], piece: Callable = lambda tokens: lambda ids: (ids,)):
        import regex

        self.find = regex.compile(pattern).findall
        self.replay = MergeReplay(ranks)
        self.head, self.piece = head, piece(self.replay.tokens)
        self.later, self.leading, self.known = Recent(CACHE), Recent(CACHE // 8), Recent(CACHE)

    def pieces(self, texts: list[str]) -> list[list[tuple]]:
        """For each text the pieces of its chunks."""
        cut = [chunks(t) for t in texts]
        distinct: set[str] = set()
        for _, rest in cut:
            distinct.update(rest)
        later, leading = self.later.missing(distinct), self.leading.missing({x for x, _ in cut})
        find, head, piece = self.find, self.head, self.piece
        found = [find(" " + x) for x in later] + [find(x) for x in leading]
        new = self.known.missing({w for words in found for w in words})
        known = self.known.now
        rare = [w for w in new if w not in head]
        known.update(zip(rare, map(piece, self.replay.encode([w.encode() for w in rare]))))
        for w in new:
            if w in head:
                known[w] = piece(np.frombuffer(head[w], "<u4").tolist())
        none = piece([])
        made = [known[words[0]] if len(words) == 1 else tuple(map(add, *[known[w] for w in words])) if len(words) == 2 else tuple(reduce(add, x) for x in zip(*[known[w] for w in words])) if words else none for words in found]
        self.later.now.update(zip(later, made))
        self.leading.now.update(zip(leading, made[len(later) :]))
        get, first = self.later.now.__getitem__, self.leading.now
        return [[first[lead], *map(get, rest)] for lead, rest in cut]

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, where pieces are the ids."""
        return [[i for p in x for i in p[0]] for x in self.pieces(texts)]


def decode(ids: list[int], tokens: list[bytes]) -> bytes:
    """Bytes of ids; tokens by id."""
    return b"".join([tokens[i] for i in ids])


def word_counts(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """(word, n) over all texts. Tasks count before anything is shuffled, and hold at most CACHE chunks at a time."""

    def count(parts: Iterable[dict[str, list]]):
        import regex

        find = regex.compile(pattern).findall
        seen: Counter[str] = Counter()
        lead: Counter[str] = Counter()

        def flush():
            words: Counter[str] = Counter()
            for chunk, n in seen.items():
                for w in find(" " + chunk):
                    words[w] += n
            for chunk, n in lead.items():
                for w in find(chunk):
                    words[w] += n
            seen.clear()
            lead.clear()
            return {"word": list(words), "n": list(words.values())}

        for part in parts:
            for t in part[text]:
                if t:
                    first, rest = chunks(t)
                    lead[first] += 1
                    seen.update(rest)
            if len(seen) > CACHE:
                yield flush()
        yield flush()

    return map_batches(df.select(text), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(df: DataFrame, text: str, ranks: pyspark.Broadcast, pattern: str, head: int) -> bytes:
    """The corpus's commonest words and their ids, about ``head`` words of at most HEAD_WORD_BYTES bytes, as an Arrow stream."""
    spark = df.sparkSession
    counted = word_counts(df, text, pattern).where(F.octet_length("word") <= HEAD_WORD_BYTES)
    top = commonest(stored(counted, "words"), "n", "word", head)

    def replayed(parts: Iterable[dict[str, list]]):
        replay = MergeReplay(ranks.value)
        for part in parts:
            ids = replay.encode([w.encode() for w in part["word"]])
            yield {"word": part["word"], "ids": [np.array(x, "<u4").tobytes() for x in ids]}

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = map_batches(top.repartition(n, "word").select("word"), replayed, "word string, ids binary").toArrow()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, found.schema) as stream:
        stream.write_table(found)
    return out.getvalue().to_pybytes()


def read_head(raw: bytes) -> dict[str, bytes]:
    """The words and ids of ``head_words``; made in the tasks, so that the driver holds the bytes alone."""
    found = pa.ipc.open_stream(raw).read_all()
    return dict(zip(found["word"].to_pylist(), found["ids"].to_pylist()))


def encoded(df: DataFrame, ranks_path: str, pattern: str, piece: Callable, make: Callable, schema: str, keep: list[str], text: str = "text", head: int = HEAD_WORDS) -> DataFrame:
    """Columns ``keep`` of df and what make returns, a dict of lists by schema.

    piece(tokens) gives a function that is called with the ids of each word, once as long as a worker remembers it;
    make is called with the lists of pieces of some texts at a time.
    """
    sc = df.sparkSession.sparkContext
    ranks = sc.broadcast(read_ranks(ranks_path))
    top = sc.broadcast(head_words(df, text, ranks, pattern, head))
    name = uuid.uuid4().hex

    def run(parts: Iterable[dict[str, list]]):
        words = kept_in_worker(("bpe", name), lambda: Words(ranks.value, pattern, read_head(top.value), piece))
        for part in parts:
            yield {k: part[k] for k in keep} | make(words.pieces([t or "" for t in part[text]]))

    from pyspark.sql import types as T

    kept = T.StructType([df.schema[k] for k in keep])
    return map_batches(df.select(*dict.fromkeys([*keep, text])), run, T.StructType([*kept.fields, *T._parse_datatype_string(schema).fields]))


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", head: int = HEAD_WORDS) -> DataFrame:
    """df with ``ids`` (array of int) and ``decoded`` (binary, made from the ids) for each row; own columns of these names, in any case of letters, are replaced."""
    keep = [c for c in df.columns if c.lower() not in ("ids", "decoded")]

    def piece(tokens):
        return lambda ids: (np.array(ids, "<i4").tobytes(), decode(ids, tokens))

    def make(texts):
        return {"ids": [np.frombuffer(b"".join([p[0] for p in x]), "<i4") for x in texts], "decoded": [b"".join([p[1] for p in x]) for x in texts]}

    return encoded(df, ranks_path, pattern, piece, make, "ids array<int>, decoded binary", keep, text, head)


def digest_piece(tokens: list[bytes]) -> Callable:
    """Number of ids, the ids in decimal, each after a comma, and the bytes that they decode to."""
    names = [f",{i}" for i in range(len(tokens))]

    def piece(ids: list[int]) -> tuple[int, str, bytes]:
        return len(ids), "".join([names[i] for i in ids]), decode(ids, tokens)

    return piece


def digests(texts: list[list]) -> dict[str, list]:
    import hashlib

    return {
        "n_tokens": [sum([p[0] for p in x]) for x in texts],
        "ids_sha256": [hashlib.sha256("".join([p[1] for p in x])[1:].encode()).hexdigest() for x in texts],
        "decoded_sha256": [hashlib.sha256(b"".join([p[2] for p in x])).hexdigest() for x in texts],
    }


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, their digest and the digest of the decoded bytes of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encoded(docs, path, public_tokenizers.PATTERN, digest_piece, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id"])
