"""Token counts: pieces are counted once for each distinct pre-token of a block, joined to the documents' pre-token frequencies
and summed; no token id of a document is ever held."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, in_arrow, table
from .packing import _path
from .packing import tokenizer as load
from .pieces import Memory, plain_rows, runs, word_level_cuts

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Distinct pre-tokens whose piece counts a task remembers from block to block; beyond it the memory starts anew.
CACHE = 800_000


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row (null text: empty, 0 tokens; repeated rows count each).

    A block of rows is cut into pre-tokens; its distinct ones are counted by the tokenizer, unless the task remembers them, and the
    counts are joined to the (row, pre-token) occurrences by number and summed. The join stays inside a task: shipping frequencies to
    a global join would move several times the input. Rows with characters whose class a byte does not tell, or with special strings,
    are counted whole. Memory is bounded by CACHE and one block; no shuffle, no driver state. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(_path(tokenizer))
        sizes = lambda texts: [len(e) for lo in range(0, len(texts), 2_000) for e in tok.encode_batch_fast(texts[lo : lo + 2_000], add_special_tokens=False)]
        memory = Memory(sizes, CACHE)
        for batch, data, offs in blocks(batches):
            n = np.zeros(batch.num_rows, np.int64)
            for a, b, plain in runs(plain_rows(data, offs)):
                part, at = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                if not plain:
                    raw = part.tobytes()
                    n[a:b] = sizes([raw[i:j].decode() for i, j in zip(at[:-1], at[1:], strict=True)])
                elif len(part):
                    s = word_level_cuts(part, at)
                    number, inverse = memory.numbers(part, s, lower=True)
                    pieces = np.fromiter((memory.values[i] for i in number.tolist()), np.int64, len(number))
                    n[a:b] = np.bincount(np.searchsorted(at, s, "right") - 1, pieces[inverse], b - a).astype(np.int64)
            yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "n_bytes": pa.array(np.diff(offs)), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
