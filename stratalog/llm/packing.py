"""Packing: concatenate and cut.

Every document becomes its token ids plus one end id. Pass one writes the ids
with their start inside their task's output and sums each task's ids; the sums'
prefixes (one number a task) give each document its global offset, so pass two
cuts fixed windows row by row, without a shuffle, and a document that crosses a
window's end leaves one record on either side of it.

Null text counts as empty (only the end id). Rows with equal or null doc_id are
packed each on its own. An empty table gives no pieces. Further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, stored, table

LENGTH = 1024
VOCABULARY = "byte_bpe_50k"
#: Bytes of text tokenised together.
BLOCK = 4_000_000
_tokenizers: dict[str, Tokens] = {}


class Tokens:
    """Ids of texts, equal to those of the `tokenizers` library.

    The vocabulary's pre-tokeniser always cuts before a space that follows a
    non-space, so a text's ids are those of its space-led words joined. A block's
    distinct words are encoded in one call. A word that is empty or ends in white
    space would break the rule, a special token's string too: such texts are
    encoded whole.
    """

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.parts = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, i in ranks.items():
            self.bytes[i] = len(word)

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.parts.encode_ordinary(text)

    def block(self, texts: pa.Array) -> list[bytes]:
        """Of each text (none null), its ids and the end id as little-endian uint16."""
        split = pc.split_pattern(texts, " ")
        at, words = split.offsets.to_numpy().astype(np.int64), split.flatten().dictionary_encode()
        at -= at[0]
        of, own, docs = words.indices.to_numpy().astype(np.int64), words.dictionary, len(texts)
        # distinct words, each after a space, in one string
        flat = np.asarray(self.parts.encode_to_numpy(" " + " ".join(own.to_pylist()), disallowed_special=()), np.int64)
        ends = np.searchsorted(np.cumsum(self.bytes[flat]), np.cumsum(pc.binary_length(own).to_numpy().astype(np.int64) + 1)) + 1
        first = [self.parts.encode_ordinary(x.as_py()) for x in own.take(pa.array(of[at[:-1]]))]
        begin = np.concatenate([[0], ends[:-1], len(flat) + np.cumsum([0, *map(len, first)])])
        size = np.concatenate([np.diff(ends, prepend=0), [len(x) for x in first], [1]])
        flat = np.concatenate([flat, np.array([i for x in first for i in x], np.int64), [0]])
        odd = pc.or_(pc.equal(own, ""), pc.match_substring_regex(own, r"[\s\p{Z}\x0b\x1c-\x1f\x85]$")).to_numpy(zero_copy_only=False)[of]
        odd = np.add.reduceat(odd.astype(np.int64), at[:-1]) * (np.diff(at) > 1) > 0
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        of[at[:-1]] = len(own) + np.arange(docs)
        of = np.insert(of, at[1:], len(own) + docs)
        n, stop = size[of], np.cumsum(size[of])
        ids = flat[np.repeat(begin[of] - (stop - n), n) + np.arange(stop[-1])].astype("<u2").tobytes()
        stop = [0, *(2 * stop[at[1:] + np.arange(docs)]).tolist()]
        out = [ids[a:b] for a, b in zip(stop, stop[1:], strict=False)]
        for i in np.nonzero(odd)[0].tolist():
            out[i] = np.array([*self.encode(texts[i].as_py()), 0], "<u2").tobytes()
        return out

    def batch(self, texts: pa.Array) -> list[bytes]:
        texts, out = pc.fill_null(texts.cast(pa.string()), ""), []
        block = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // BLOCK
        cuts = [0, *(np.nonzero(np.diff(block))[0] + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                out += self.block(texts.slice(a, b - a))
        return out


def tokens(name: str = VOCABULARY) -> Tokens:
    if name not in _tokenizers:
        _tokenizers[name] = Tokens(name)
    return _tokenizers[name]


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(part, part_start, doc_id, doc_tokens, ids): a document's ids and where they start in its task's output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at = tokens(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = own.batch(batch.column("text"))
            n = [len(x) // 2 for x in ids]
            starts = list(accumulate(n, initial=at))
            at = starts.pop()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64()), batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                names=["part", "part_start", "doc_id", "doc_tokens", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(released(run), "part int, part_start long, doc_id long, doc_tokens long, ids binary")


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of fixed windows over all ids.

    ids: little-endian unsigned 32-bit ids of the piece. To the driver goes one
    total a task of pass one.
    """
    encoded = stored(tokenize(docs, vocabulary), "packing")
    totals = sorted(map(tuple, encoded.groupBy("part").agg(F.sum("doc_tokens")).collect()))
    bases = dict(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for part, at, doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "part_start", "doc_id", "doc_tokens", "ids")), strict=True):
                wide = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                begin = bases[part] + at
                for window in range(begin // length, (begin + n - 1) // length + 1):
                    a, b = max(begin, window * length), min(begin + n, (window + 1) * length)
                    out.append((doc, a - begin, b - a, n, window, a - window * length, wide[4 * (a - begin) : 4 * (b - begin)]))
            if out:
                kinds = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return encoded.mapInArrow(released(run), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
