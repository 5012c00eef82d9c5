"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rank file and pre-tokenization pattern of a public byte-level BPE tokenizer (fixed values, see the tokenizers' README).
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(ranks: str = RANKS):
    """The tokenizer of a rank file, loaded once in each worker."""
    import tiktoken

    with open(ranks, "rb") as lines:
        held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=held, special_tokens={})


def counted(docs: DataFrame, keep: list[str], text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """``keep`` and n_tokens INT: the length of the whole text in tokens; null and empty texts have 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(ranks)
        for batch in batches:
            sizes = [len(tokenizer.encode_ordinary(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int32())], names=[*keep, "n_tokens"])

    keyed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, text_col).mapInArrow(count, f"{keyed}, n_tokens int")
